"""Dashboard, ordering, paging and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import scores
from pricetide.operators import dashboard as ops
from pricetide.operators import joins, sets, summary
from pricetide.operators.stats import median
from pricetide.plans.history import tidy
from pricetide.plans.joins import DATES, D_DAYS, D_PANEL
from pricetide.plans.joins import panel as decision_panel
from pricetide.plans.normalised import DASHBOARD as DASHBOARD_SQL
from pricetide.plans.normalised import dashboard as dashboard_rows
from pricetide.plans.registry import query
from pricetide.sources.domain import clean, table, trades, with_trades

TYPES = """
SELECT sido, gu, dong, complex, key, min(built) AS built, min(area) AS area, min(area) / 3.3058 AS area_pyeong, count(*) AS n,
  max(price_oku) AS price, CASE WHEN min(linenumber) = 1 THEN max(orderkey) % 900 END AS households,
  max(orderkey) % 700 AS subway_m, max(partkey) % 2 = 0 AS elementary_500m, max(tax) * 1000 AS parking,
  CASE WHEN max(orderkey) % 4 = 0 THEN NULL ELSE CAST(max(orderkey) % 900 AS DOUBLE) / 10 END AS score,
  min(price_oku) AS p10, max(price_oku) - 1 AS p50, max(price_oku) AS p90, max(building_name) AS building_name,
  CAST(greatest(0, 2001 - min(built)) AS INT) AS age FROM {clean} GROUP BY sido, gu, dong, complex, key
"""
T = f", types AS ({TYPES.format(clean='clean')})"


def types(spark, sf_dir):
    rows = spark.sql(TYPES, clean=clean(spark, sf_dir)).withColumn("area_pyeong", F.col("area") / F.lit(3.3058))
    rows = rows.withColumns({"parking": F.col("parking").cast("double"), "score": F.col("score").cast("double")})
    return rows.withColumns(
        {"age_category": scores.age_category(F.col("age")), "area_category": scores.area_category(F.col("area_pyeong")),
         "subway_lines": F.array(F.concat((F.col("area") % 9).cast("string"), F.lit("호선")))}
    )


FACETS = ops.Facets(gu=("ASIA", "EUROPE"), area=("lte14", "gt14_lte26"), age=("semi_new", "middle"), min_price=5.0, min_households=100,
                    min_trades=10, subway_minutes=6, subway_lines=("5호선", "6호선", "7호선"))
FACET_WHERE = """gu IN ('ASIA', 'EUROPE') AND area / 3.3058 <= 26 AND age > 5 AND age <= 20 AND price >= 5.0 AND households >= 100 AND n >= 10
  AND subway_m <= 480 AND area % 9 IN (5, 6, 7)"""


@query("ui1_facet_filter", with_trades(T + f"SELECT key, n, price, households FROM types WHERE {FACET_WHERE}"))
def facet_filter(spark, sf_dir):
    return ops.facet_filter(types(spark, sf_dir), FACETS).select("key", "n", "price", "households")


@query(
    "ui2_search",
    with_trades(T + "SELECT key, building_name FROM types WHERE contains(lower(gu || ' ' || dong || ' ' || key || ' ' || building_name), 'nation_1')"),
)
def search(spark, sf_dir):
    return ops.search(types(spark, sf_dir), " Nation_1 ", ["gu", "dong", "key", "building_name"]).select("key", "building_name")


@query(
    "ui3_region_metric",
    with_trades(
        T
        + """SELECT gu, dong, round(sum(price * n) / sum(n), 6) AS value, round(avg(score), 6) AS score, CAST(sum(n) AS BIGINT) AS trades FROM types GROUP BY gu, dong"""
    ),
)
def region_metric(spark, sf_dir):
    rows, region = types(spark, sf_dir), ["gu", "dong"]
    out = ops.region_metric(rows, region, "price")
    out = out.join(ops.region_metric(rows, region, "score").withColumnRenamed("value", "score"), region)
    return tidy(out.join(ops.region_metric(rows, region, "count").withColumnRenamed("value", "trades"), region))


@query(
    "ui4_distribution",
    with_trades(
        T
        + """, r AS (SELECT dong, sum(price * n) / sum(n) AS v FROM types GROUP BY dong)
SELECT round(min(v), 6) AS min, round(median(v), 6) AS mid, round(max(v), 6) AS max FROM r"""
    ),
)
def distribution(spark, sf_dir):
    return tidy(ops.distribution(ops.region_metric(types(spark, sf_dir), ["dong"], "price")))


@query(
    "ui5_complex_groups",
    with_trades(
        T
        + """SELECT dong, complex, count(*) AS type_count, CAST(sum(n) AS BIGINT) AS n, round(sum(price * n) / sum(n), 6) AS value,
  CAST(max(built) AS BIGINT) AS latest_built_year FROM types GROUP BY dong, complex"""
    ),
)
def complex_groups(spark, sf_dir):
    return tidy(ops.complex_groups(types(spark, sf_dir), "price"))


HISTORY = """
, hist AS (SELECT sido, gu, dong, key, year, count(*) AS n, median(price / (area / 3.3058)) AS p FROM clean GROUP BY ALL),
yoy AS (SELECT a.sido, a.gu, a.dong, a.key, a.year, (a.p - b.p) / b.p * 100 AS rate FROM hist a JOIN hist b ON b.dong = a.dong AND b.key = a.key
  AND b.year = a.year - 1 WHERE a.n >= 3 AND b.n >= 3 AND a.year < 2001)
"""


def history(spark, sf_dir):
    rows = clean(spark, sf_dir).withColumn("_p", F.col("price") / (F.col("area") / F.lit(3.3058)))
    return median(rows, ["sido", "gu", "dong", "key", "year"], "_p", "price_per_pyeong")


@query("wn5_type_yoy", with_trades(HISTORY + "SELECT dong, key, CAST(year AS BIGINT) AS year, round(rate, 6) + 0.0 AS rate FROM yoy"))
def type_yoy(spark, sf_dir):
    return tidy(ops.type_yoy(history(spark, sf_dir), 2001).select("dong", "key", "year", "rate"))


@query(
    "ui6_growth_ranking",
    with_trades(
        HISTORY
        + """, r AS (SELECT year, sido, gu, dong, avg(rate) AS v FROM yoy GROUP BY ALL),
l AS (SELECT year, 'sido' AS level, sido AS name, v FROM r UNION ALL SELECT year, 'gu', sido || ' ' || gu, v FROM r
  UNION ALL SELECT year, 'dong', sido || ' ' || gu || ' ' || dong, v FROM r)
SELECT CAST(year AS BIGINT) AS year, level, name, round(avg(v), 6) + 0.0 AS value, count(*) AS regions FROM l GROUP BY ALL HAVING avg(v) >= -20"""
    ),
)
def growth_ranking(spark, sf_dir):
    return tidy(ops.level_ranking(ops.type_yoy(history(spark, sf_dir), 2001), "rate", ["year"], -20.0))


@query(
    "ui6_full_period",
    with_trades(
        HISTORY
        + """, e AS (SELECT min(year) AS a, max(year) AS b FROM hist WHERE year < 2001),
p AS (SELECT x.sido, x.gu, x.dong, avg((y.p - x.p) / x.p * 100) AS v FROM hist x JOIN hist y USING (dong, key) JOIN e ON x.year = e.a AND y.year = e.b
  WHERE x.n >= 3 AND y.n >= 3 GROUP BY x.sido, x.gu, x.dong)
SELECT level, name, round(avg(v), 6) + 0.0 AS value, count(*) AS regions FROM (SELECT 'sido' AS level, sido AS name, v FROM p UNION ALL SELECT 'gu', sido || ' ' || gu, v FROM p
  UNION ALL SELECT 'dong', sido || ' ' || gu || ' ' || dong, v FROM p) GROUP BY ALL"""
    ),
)
def full_period(spark, sf_dir):
    return tidy(ops.level_ranking(ops.full_period_rate(history(spark, sf_dir), 2001), "rate"))


@query(
    "ui7_score_ranking",
    with_trades(
        T
        + """, r AS (SELECT sido, gu, dong, avg(score) AS v FROM types GROUP BY ALL HAVING avg(score) IS NOT NULL)
SELECT level, name, round(avg(v), 6) AS value, count(*) AS regions FROM (SELECT 'sido' AS level, sido AS name, v FROM r UNION ALL SELECT 'gu', sido || ' ' || gu, v FROM r
  UNION ALL SELECT 'dong', sido || ' ' || gu || ' ' || dong, v FROM r) GROUP BY ALL"""
    ),
)
def score_ranking(spark, sf_dir):
    return tidy(ops.level_ranking(types(spark, sf_dir), "score"))




@query(
    "ui8_potential_list",
    with_trades(
        T
        + """, r AS (SELECT *, row_number() OVER (PARTITION BY gu ORDER BY price DESC, key) AS rank, count(*) OVER (PARTITION BY gu) AS c FROM types)
SELECT key, rank AS research_rank, CASE WHEN area <= 60 THEN 'small' WHEN area <= 85 THEN 'medium' ELSE 'large' END AS area_class FROM r
WHERE gu IN ('ASIA', 'AFRICA') AND price >= 6.0 AND 100.0 * rank / c <= 60 AND n >= 5"""
    ),
)
def potential_list(spark, sf_dir):
    from pricetide.operators.evaluation import rank_candidates

    rows = rank_candidates(types(spark, sf_dir), ["gu"], "price")
    rows = rows.select("key", "gu", "area", F.col("n").alias("entry_n"), F.col("price").alias("entry_reference_oku"),
                       F.col("rank").alias("research_rank"), "top_percent", (F.col("top_percent") <= 10).alias("both_top_decile"))
    out = ops.potential_list(rows, ("ASIA", "AFRICA"), min_price=6.0, area=("small", "medium", "large"), top=60, trades=5, sort="trades")
    return out.select("key", "research_rank", "area_class")


BEST = """, b AS (SELECT *, row_number() OVER (PARTITION BY dong, complex ORDER BY coalesce(score, -1) DESC, key) AS r FROM types),
a AS (SELECT dong, complex, array_to_string(list_sort(list(DISTINCT area)), ',') AS areas FROM types GROUP BY ALL)
"""


@query(
    "so6_best_type",
    with_trades(T + BEST + "SELECT b.dong, b.complex, key, score, areas FROM b JOIN a USING (dong, complex) WHERE r = 1"),
)
def best_type(spark, sf_dir):
    out = ops.best_type(types(spark, sf_dir))
    return out.withColumn("areas", F.array_join(F.transform("areas", lambda x: x.cast("string")), ","))


@query(
    "ui9_comparison_sheet",
    with_trades(
        T
        + BEST
        + """SELECT b.dong, b.complex, key, score, CAST(households AS BIGINT) AS households, CAST(built AS BIGINT) AS built, round(parking, 6) AS parking, round(price, 6) AS price, round(p10, 6) AS p10,
  round(p50, 6) AS p50, round(p90, 6) AS p90, areas, CAST(greatest(0, 2001 - built) AS BIGINT) AS building_age,
  round(parking / nullif(households, 0), 6) AS parking_per_household FROM b JOIN a USING (dong, complex) WHERE r = 1"""
    ),
)
def comparison_sheet(spark, sf_dir):
    out = ops.comparison_sheet(types(spark, sf_dir), 2001)
    return tidy(out.withColumn("areas", F.array_join(F.transform("areas", lambda x: x.cast("string")), ",")))


ROUTES = """
SELECT event_id AS id, user_id AS complex_id, CASE event_type WHEN 'view' THEN 'station' WHEN 'signup' THEN 'station' WHEN 'click' THEN 'school' ELSE 'bus_stop' END AS purpose,
  'D' || CAST(event_id % 6 AS STRING) AS destination, CASE WHEN event_id % 7 = 0 THEN 'disconnected' ELSE 'assumed_connector_total' END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'needs_review' ELSE 'no_specific_flag' END AS route_review_status, value AS total_m FROM {events}
"""


def routes(spark, sf_dir):
    return spark.sql(ROUTES, events=table(spark, sf_dir, "events"))


_PURPOSE_SQL = ", ".join(
    f"arg_max(class, id) FILTER (WHERE purpose = '{p}') AS {p}_class, max(CASE WHEN class = 'estimate' THEN total_m END) FILTER (WHERE purpose = '{p}' AND last) AS {p}_m, "
    f"count(DISTINCT destination) FILTER (WHERE purpose = '{p}') AS {p}_destinations"
    for p in ops.PURPOSES
)


@query(
    "ui10_route_review",
    f"""WITH r AS (SELECT *, CASE WHEN status = 'disconnected' THEN 'disconnected' WHEN route_review_status = 'needs_review' THEN 'needs_review' ELSE 'estimate' END AS class,
  id = max(id) OVER (PARTITION BY complex_id, purpose) AS last FROM ({ROUTES.format(events='events')}))
SELECT complex_id, {_PURPOSE_SQL} FROM r GROUP BY complex_id""",
)
def route_review(spark, sf_dir):
    return ops.route_review(routes(spark, sf_dir))


@query(
    "ui10_route_counts",
    f"""WITH r AS ({ROUTES.format(events='events')})
SELECT count(DISTINCT complex_id) AS complexes, count(*) AS routes, count(*) FILTER (WHERE status <> 'disconnected') AS estimated,
  count(*) FILTER (WHERE status = 'disconnected') AS disconnected, count(*) FILTER (WHERE route_review_status = 'needs_review') AS route_review,
  count(*) FILTER (WHERE route_review_status = 'needs_review' AND status <> 'disconnected') AS review_estimated,
  count(*) FILTER (WHERE route_review_status <> 'needs_review' AND status <> 'disconnected') AS comparison_estimated FROM r""",
)
def route_counts(spark, sf_dir):
    return ops.route_counts(routes(spark, sf_dir))


@query(
    "ui11_summary_counts",
    with_trades(T + "SELECT CAST(sum(n) AS BIGINT) AS trades_used, count(DISTINCT dong || complex) AS complexes FROM types"),
)
def summary_counts(spark, sf_dir):
    return ops.summary_counts(types(spark, sf_dir))


@query(
    "ui12_eligible_candidates",
    f"""WITH p AS ({D_PANEL}), {D_DAYS},
o AS (SELECT d, asset_id, arg_max(event_id, (observed_at, available_at, event_id)) AS observation_id, arg_max(price_krw, (observed_at, available_at, event_id)) AS price_krw,
    arg_max(score, (observed_at, available_at, event_id)) AS score FROM p JOIN d ON greatest(available_at, observed_at) <= d + INTERVAL 15 HOUR - INTERVAL 1 MICROSECOND
  AND d + INTERVAL 15 HOUR - INTERVAL 1 MICROSECOND - observed_at <= INTERVAL 7 DAY GROUP BY d, asset_id),
c AS (SELECT *, price_krw + CAST(ceil(CAST(price_krw AS DECIMAL(18,0)) * 0.011) AS BIGINT) + 100 AS total_krw FROM o),
e AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, asset_id) AS r, count(*) OVER (PARTITION BY d) AS eligible_count FROM c WHERE price_krw <= 20000 AND total_krw + 500 <= 18000)
SELECT CAST(d AS VARCHAR) AS decision_date, eligible_count, asset_id, observation_id, price_krw, total_krw, score FROM e WHERE r = 1""",
)
def eligible_candidates(spark, sf_dir):
    seen = joins.observations_asof(decision_panel(spark, sf_dir), DATES, 7)
    total = F.col("price_krw") + scores.charge(F.col("price_krw"), "0.011") + 100
    return tidy(ops.eligible_candidates(seen, total, 20000, 18000, 500), 10)


@query(
    "so2_hot_cold",
    with_trades(
        T
        + """, g AS (SELECT dong || '|' || complex AS id, sum(price * n) / sum(n) AS v FROM types GROUP BY 1),
r AS (SELECT id, row_number() OVER (ORDER BY round(v, 9) DESC, id) AS rank, count(*) OVER () AS c FROM g)
SELECT id, rank, 'hot' AS list FROM r WHERE rank <= greatest(1, ceil(c * 0.3)) UNION ALL SELECT id, rank, 'cold' FROM r WHERE rank > c - greatest(1, ceil(c * 0.3))"""
    ),
)
def hot_cold(spark, sf_dir):
    groups = ops.complex_groups(types(spark, sf_dir), "price").select(
        F.concat_ws("|", "dong", "complex").alias("id"), F.round("value", 9).alias("value")
    )
    return ops.hot_cold(groups, "value", "id").select("id", "rank", "list")


@query(
    "so3_ordered",
    with_trades(T + "SELECT key, score, households, row_number() OVER (ORDER BY score DESC NULLS LAST, households ASC NULLS LAST, key) AS position FROM types"),
)
def ordered(spark, sf_dir):
    out = ops.numbered(types(spark, sf_dir), [("score", "desc"), ("households", "asc")], ["key"])
    return out.select("key", "score", "households", "position")


@query(
    "so4_paginate",
    with_trades(
        T
        + """, r AS (SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS position, count(*) OVER () AS total FROM types)
SELECT key, n, position, total, CAST(ceil(total / 40.0) AS BIGINT) AS page_count, CAST(ceil(total / 40.0) AS BIGINT) AS page FROM r WHERE position > (ceil(total / 40.0) - 1) * 40"""
    ),
)
def paginate(spark, sf_dir):
    out = ops.paginate(types(spark, sf_dir).select("key", "n"), [("n", "desc")], ["key"], page=9999, size=40)
    return tidy(out.select("key", "n", "position", "total", "page_count", "page"))


@query(
    "so5_page_after",
    """WITH r AS (SELECT event_id AS row_no, event_type || '|' || CAST(user_id AS VARCHAR) AS payload FROM events WHERE event_id > 700 ORDER BY event_id LIMIT 200)
SELECT row_no, payload FROM (SELECT *, sum(strlen(payload)) OVER (ORDER BY row_no) AS used FROM r) WHERE used <= 1500""",
)
def page_after(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_no"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("payload")
    )
    return ops.page_after(rows, 700, 200, 1500)


@query(
    "so7_hash_choice",
    with_trades(
        T
        + """SELECT gu, key FROM (SELECT gu, key, row_number() OVER (PARTITION BY gu ORDER BY sha256('random_hold_v1|7|2001-06-01|' || key), key) AS r FROM types) WHERE r = 1"""
    ),
)
def hash_choice(spark, sf_dir):
    return ops.hash_choice(types(spark, sf_dir), ["gu"], 7, F.lit("2001-06-01"), "key")


@query(
    "wn7_occurrence",
    with_trades(
        """SELECT key, month, occurrence, count(*) AS n FROM (SELECT key, month, row_number() OVER (PARTITION BY key, month ORDER BY price, floor) AS occurrence FROM trades) GROUP BY ALL"""
    ),
)
def occurrence(spark, sf_dir):
    out = joins.occurrence(trades(spark, sf_dir).select("key", "month", "price", "floor"), ["key", "month"], [F.col("price"), F.col("floor")])
    return out.groupBy("key", "month", "occurrence").agg(F.count("*").alias("n"))


ATTRIBUTES = """
SELECT dong, complex, key, CASE WHEN max(orderkey) % 3 = 0 THEN NULL ELSE min(built) END AS built,
  CASE WHEN max(orderkey) % 2 = 0 THEN NULL ELSE max(orderkey) % 1000 END AS school_m, CASE WHEN max(orderkey) % 2 = 0 THEN NULL ELSE 'S' || key END AS school_name,
  CASE WHEN max(orderkey) % 2 = 0 THEN NULL ELSE max(orderkey) % 1000 <= 500 END AS school_500m,
  CASE WHEN max(partkey) % 3 = 0 THEN NULL ELSE max(partkey) % 800 END AS subway_m, CASE WHEN max(partkey) % 3 = 0 THEN NULL ELSE 'U' || key END AS subway_station,
  CASE WHEN min(partkey) % 2 = 0 THEN min(partkey) % 300 END AS bus_m, CASE WHEN min(orderkey) % 3 = 0 THEN NULL ELSE min(orderkey) % 5 END AS education_n,
  CASE WHEN min(orderkey) % 3 = 0 THEN NULL ELSE 'E' || key END AS education FROM {clean} GROUP BY dong, complex, key
"""


@query(
    "wn8_fill_from_complex",
    with_trades(
        f", a AS ({ATTRIBUTES.format(clean='clean')})"
        + """, b AS (SELECT dong, complex, arg_min(built, key) FILTER (WHERE built IS NOT NULL) AS built, min((school_m, key, school_name, school_500m)) FILTER (WHERE school_m IS NOT NULL) AS s,
  min((subway_m, key, subway_station)) FILTER (WHERE subway_m IS NOT NULL) AS u, min(bus_m) AS bus, min((-education_n, key, education, education_n)) FILTER (WHERE education_n IS NOT NULL) AS e
  FROM a GROUP BY dong, complex)
SELECT a.dong, a.complex, a.key, CAST(coalesce(a.built, b.built) AS BIGINT) AS built, CASE WHEN school_m IS NULL THEN s[3] ELSE school_name END AS school_name,
  CASE WHEN school_m IS NULL THEN s[4] ELSE school_500m END AS school_500m, coalesce(school_m, s[1]) AS school_m, CASE WHEN subway_m IS NULL THEN u[3] ELSE subway_station END AS subway_station,
  coalesce(subway_m, u[1]) AS subway_m, coalesce(bus_m, bus) AS bus_m, CASE WHEN education_n IS NULL THEN e[3] ELSE education END AS education, coalesce(education_n, e[4]) AS education_n
FROM a JOIN b USING (dong, complex)"""
    ),
)
def fill_from_complex(spark, sf_dir):
    rows = spark.sql(ATTRIBUTES, clean=clean(spark, sf_dir))
    return tidy(summary.fill_from_complex(rows, ["dong", "complex"]))


@query(
    "se1_union_disjoint",
    with_trades("SELECT gu, year < 1998 AS older, count(*) AS n FROM clean GROUP BY ALL"),
)
def union_disjoint(spark, sf_dir):
    rows = clean(spark, sf_dir).select("gu", "date", "year")
    both = sets.union_disjoint(rows.where("year < 1998"), rows.where("year >= 1998"))
    return both.groupBy("gu", (F.col("year") < 1998).alias("older")).agg(F.count("*").alias("n"))


@query(
    "se2_merge_existing",
    with_trades(
        DASHBOARD_SQL
        + """, d AS (SELECT CAST(strptime("CTRT_DAY", '%Y%m%d') AS DATE) AS d, "CGG_CD" AS c FROM dashboard)
SELECT CASE WHEN d <= DATE '2000-06-30' AND c IN ('1', '2', '3', '4') AND d < DATE '1999-01-01' THEN 'written_rows' ELSE 'outside_owned_scope_excluded' END AS reason,
  count(*) AS rows, CAST(min(d) AS VARCHAR) AS contract_min, CAST(max(d) AS VARCHAR) AS contract_max FROM d GROUP BY 1"""
    ),
)
def merge_existing(spark, sf_dir):
    owner = F.when(F.col("CGG_CD").isin("1", "2", "3", "4") & (F.col("_date") < F.lit("1999-01-01").cast("date")), "existing")
    return tidy(sets.merge_existing(dashboard_rows(spark, sf_dir), owner, "existing", "2000-06-30")[1])


@query(
    "se4_poll_delta",
    with_trades(
        """, d AS (SELECT key, floor, count(*) FILTER (WHERE year = 1998) AS before, count(*) FILTER (WHERE year = 1999) AS after FROM trades GROUP BY ALL)
SELECT key, floor, before, after, CASE WHEN before = 0 THEN 'added' WHEN after = 0 THEN 'removed' ELSE 'count_changed' END AS change FROM d WHERE before <> after"""
    ),
)
def poll_delta(spark, sf_dir):
    rows = trades(spark, sf_dir)
    return sets.poll_delta(rows.where("year = 1998"), rows.where("year = 1999"), ["key", "floor"])


@query(
    "se5_document_delta",
    """WITH o AS (SELECT doc_id, text FROM documents WHERE source <> 'src0'), n AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text FROM documents)
SELECT n.doc_id, sha256(n.text) AS after_sha256, sha256(o.text) AS before_sha256 FROM n LEFT JOIN o USING (doc_id) WHERE o.text IS NULL OR o.text <> n.text""",
)
def document_delta(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs.where("source <> 'src0'").select("doc_id", "text")
    after = docs.select("doc_id", F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    out = sets.document_delta(before, after, "doc_id", "text")
    return out.select("doc_id", F.sha2("text", 256).alias("after_sha256"), "before_sha256")


@query(
    "se6_shared",
    with_trades("SELECT DISTINCT key FROM clean WHERE year = 1996 AND key IN (SELECT key FROM clean WHERE year = 2000)"),
)
def shared(spark, sf_dir):
    rows = clean(spark, sf_dir)
    return sets.shared(rows.where("year = 1996"), rows.where("year = 2000"), ["key"])


@query(
    "se7_select_partitions",
    with_trades("SELECT gu, year, count(*) AS n FROM trades WHERE gu IN ('ASIA', 'EUROPE') AND year IN (1997, 1999) GROUP BY ALL"),
)
def select_partitions(spark, sf_dir):
    rows = trades(spark, sf_dir)
    expected = rows.select("gu", "year").where("gu IN ('ASIA', 'EUROPE') AND year IN (1997, 1999)")
    return sets.select_partitions(rows, expected, ["gu", "year"]).groupBy("gu", "year").agg(F.count("*").alias("n"))
