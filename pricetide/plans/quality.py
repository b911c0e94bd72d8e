"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import normalise, summary
from pricetide.operators import quality as ops
from pricetide.plans.history import F_FIRST, F_LAST, POLICY, POLICY_SERVED, tidy
from pricetide.plans.normalised import (
    CANONICAL_SALES, D_CLASS, DASHBOARD, D_DATE, MATCH, canonical_sales, d_flag, dashboard,
)
from pricetide.plans.registry import query
from pricetide.sources import domain
from pricetide.sources.domain import EXPORT_SQL, clean, table, trades, with_trades


@query(
    "dq1_inspect_export",
    with_trades(
        EXPORT_SQL
        + f""", r AS (SELECT source_id, CAST({D_DATE} AS DATE) AS d, split_part(trim(address_text), ' ', 1) = source_id AS inside,
    {d_flag('area', 'a', '? <= 0')} IS NOT NULL AS bad_area, {d_flag('amount', 'a', '? <= 0')} IS NOT NULL AS bad_amount,
    trim(cancelled_on) NOT IN ('', '-', '--', 'N') AS cancelled FROM sales)
SELECT source_id, count(*) AS rows, CAST(min(d) AS VARCHAR) AS minimum_contract_date, CAST(max(d) AS VARCHAR) AS maximum_contract_date,
  count(*) FILTER (WHERE cancelled) AS cancellation_marked_rows, count(*) FILTER (WHERE d IS NULL) AS invalid_dates,
  count(*) FILTER (WHERE d NOT BETWEEN DATE '1995-06-01' AND DATE '2001-06-30') AS outside_dates,
  count(*) FILTER (WHERE NOT inside) AS outside_province, count(*) FILTER (WHERE bad_area) AS invalid_areas,
  count(*) FILTER (WHERE bad_amount) AS invalid_amounts FROM r GROUP BY source_id"""
    ),
)
def inspect_export(spark, sf_dir):
    rows = domain.sale_export(spark, sf_dir)
    return tidy(ops.inspect_export(rows, ["source_id"], F.col("source_id"), "1995-06-01", "2001-06-30"))


@query(
    "dq1_month_counts",
    with_trades(EXPORT_SQL + "SELECT source_id, trim(contract_month) AS contract_month, count(*) AS rows FROM sales GROUP BY ALL"),
)
def month_counts(spark, sf_dir):
    return ops.month_counts(domain.sale_export(spark, sf_dir), ["source_id"])


@query(
    "dq2_monthly_quality",
    with_trades(
        DASHBOARD
        + f""", c AS (SELECT substr("CTRT_DAY", 1, 6) AS month, {D_CLASS} AS class, "DCLR_SE" = '' AS u FROM dashboard)
SELECT month, count(*) AS raw, count(*) FILTER (WHERE class = 'used') AS used, count(*) FILTER (WHERE class = 'cancelled') AS cancelled,
  count(*) FILTER (WHERE class = 'property_type') AS property_type, count(*) FILTER (WHERE class = 'direct') AS direct,
  count(*) FILTER (WHERE class = 'invalid') AS invalid, count(*) FILTER (WHERE class = 'used' AND u) AS unknown_deal_type,
  count(*) FILTER (WHERE class = 'used') AS floor_observed FROM c GROUP BY month"""
    ),
)
def monthly_quality(spark, sf_dir):
    return ops.monthly_quality(dashboard(spark, sf_dir))


D_REASON = (
    "nullif(array_to_string(list_sort(list_filter(flags, lambda x: x IN ("
    + ", ".join(f"'{f}'" for f in normalise.BLOCKING_FLAGS)
    + "))), '|'), '')"
)


def _reason():
    bad = F.array_intersect("quality_flags", F.array(*[F.lit(f) for f in normalise.BLOCKING_FLAGS]))
    return F.when(F.size(bad) > 0, F.array_join(F.array_sort(bad), "|"))


@query(
    "dq3_source_summary",
    with_trades(
        EXPORT_SQL
        + MATCH
        + CANONICAL_SALES
        + f"""SELECT source_id, what, label, count(*) AS rows FROM (
  SELECT source_id, 'flag' AS what, unnest(flags) AS label FROM canonical
  UNION ALL SELECT source_id, 'address_match', address_match FROM canonical
  UNION ALL SELECT source_id, 'exclusion', {D_REASON} FROM canonical) WHERE label IS NOT NULL GROUP BY ALL"""
    ),
)
def source_summary(spark, sf_dir):
    return ops.source_summary(canonical_sales(spark, sf_dir), _reason())[0]


@query(
    "dq3_unresolved_examples",
    with_trades(
        EXPORT_SQL
        + MATCH
        + """SELECT source_id, array_to_string(list_sort(list(address_text)), ';') AS examples FROM (
  SELECT DISTINCT source_id, address_text FROM sales JOIN matched USING (address_text) WHERE address_match <> 'unique_exact_registry_name'
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY address_text) <= 20) GROUP BY source_id""".replace(
            "SELECT DISTINCT source_id, address_text FROM sales JOIN matched USING (address_text) WHERE address_match <> 'unique_exact_registry_name'",
            "SELECT source_id, address_text FROM (SELECT DISTINCT source_id, address_text FROM sales JOIN matched USING (address_text) WHERE address_match <> 'unique_exact_registry_name')",
        )
    ),
)
def unresolved_examples(spark, sf_dir):
    out = ops.source_summary(canonical_sales(spark, sf_dir), _reason())[1]
    return out.withColumn("examples", F.array_join("examples", ";"))


SOURCES = """
SELECT 'sale' AS kind, gu AS sido, dong || CAST(year AS STRING) || CAST(linenumber % 2 AS STRING) AS source_id,
  min(date) AS start, max(date) AS {end}, CASE WHEN dong = 'NATION_3' THEN 'same' || CAST(year AS STRING) ELSE dong || CAST(year AS STRING) || CAST(linenumber % 2 AS STRING) END AS sha256
FROM {trades} GROUP BY gu, dong, year, linenumber % 2
"""


@query(
    "dq4_overlapping_sources",
    with_trades(
        f", s AS ({SOURCES.format(trades='trades', end='fin')})"
        + """, w AS (SELECT *, max(fin) OVER p AS reach, max((fin, source_id)) OVER p AS reach_id, count(*) OVER (PARTITION BY sha256) AS copies FROM s
  WINDOW p AS (PARTITION BY kind, sido ORDER BY start, fin, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source_id, CAST(start AS VARCHAR) AS start, CASE WHEN start <= reach THEN reach_id[2] END AS overlaps_with, copies > 1 AS repeated_file
FROM w WHERE start <= reach OR copies > 1"""
    ),
)
def overlapping_sources(spark, sf_dir):
    sources = spark.sql(SOURCES.replace("{end}", "fin"), trades=trades(spark, sf_dir)).withColumnRenamed("fin", "end")
    return tidy(ops.overlapping_sources(sources).select("source_id", "start", "overlaps_with", "repeated_file"))


@query(
    "dq5_missing_partitions",
    with_trades(
        """, p AS (SELECT month, dong AS region, count(*) AS copies FROM (SELECT DISTINCT month, dong, linestatus FROM clean) GROUP BY ALL),
g AS (SELECT n_name AS region, strftime(m, '%Y-%m') AS month FROM nation CROSS JOIN range(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) t(m))
SELECT month, region, coalesce(copies, 0) AS copies FROM g LEFT JOIN p USING (month, region) WHERE coalesce(copies, 0) <> 1"""
    ),
)
def missing_partitions(spark, sf_dir):
    cells = clean(spark, sf_dir).select("month", F.col("dong").alias("region"), "linestatus").distinct()
    regions = table(spark, sf_dir, "nation").select(F.col("n_name").alias("region"))
    return ops.missing_partitions(cells, regions, "1995-01-01", "2001-11-01")


@query(
    "dq6_sale_owner",
    with_trades(
        """, d AS (SELECT gu, CAST(date + INTERVAL 24 YEAR AS DATE) AS dt FROM trades)
SELECT gu, CASE WHEN gu NOT IN ('ASIA', 'EUROPE', 'AFRICA') THEN NULL WHEN dt BETWEEN DATE '2006-01-01' AND DATE '2020-12-31'
    THEN CASE WHEN gu = 'ASIA' THEN 'existing_history' ELSE 'csv' END
  WHEN dt BETWEEN DATE '2021-01-01' AND DATE '2025-12-31' THEN 'existing_recent'
  WHEN dt BETWEEN DATE '2026-01-01' AND DATE '2026-12-31' THEN 'csv' END AS owner, count(*) AS n FROM d GROUP BY ALL"""
    ),
)
def sale_owner(spark, sf_dir):
    owner = ops.sale_owner(F.col("gu"), F.add_months("date", 288), True, "ASIA", ["ASIA", "EUROPE", "AFRICA"])
    return trades(spark, sf_dir).select("gu", owner.alias("owner")).groupBy("gu", "owner").agg(F.count("*").alias("n"))


@query(
    "dq7_partition_digest",
    with_trades(
        """, h AS (SELECT gu, year, sha256('{"complex":"' || complex || '","floor":' || CAST(CAST(floor AS INTEGER) AS VARCHAR) || ',"month":"' || month || '"}') AS h FROM trades)
SELECT gu, year, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS DECIMAL(20,0))) AS VARCHAR) AS digest FROM h GROUP BY ALL"""
    ),
)
def partition_digest(spark, sf_dir):
    rows = trades(spark, sf_dir).withColumn("floor", F.col("floor").cast("int"))
    return tidy(ops.partition_digest(rows, ["gu", "year"], ["complex", "floor", "month"]))


@query(
    "dq7_row_hash",
    with_trades(
        """SELECT sha256('{"complex":"' || complex || '","dong":"' || dong || '","month":"' || month || '"}') AS row_hash, count(*) AS n FROM trades GROUP BY 1"""
    ),
)
def row_hash(spark, sf_dir):
    out = ops.row_hash(trades(spark, sf_dir), ["complex", "dong", "month"])
    return out.groupBy("row_hash").agg(F.count("*").alias("n"))


@query(
    "dq7_same_multiset",
    with_trades(
        """SELECT key, floor, CAST(sum(CASE WHEN linestatus = 'F' THEN 1 ELSE -1 END) AS BIGINT) AS difference FROM trades
GROUP BY key, floor HAVING sum(CASE WHEN linestatus = 'F' THEN 1 ELSE -1 END) <> 0"""
    ),
)
def same_multiset(spark, sf_dir):
    rows = trades(spark, sf_dir)
    side = lambda s: rows.where(F.col("linestatus") == s).select("key", "floor")
    return ops.same_multiset(side("F"), side("O"))


@query(
    "dq8_coverage",
    with_trades(
        """, t AS (SELECT b.bucket, key, count(*) AS n FROM clean c CROSS JOIN LATERAL (VALUES (CAST(c.year AS VARCHAR)), ('all')) b(bucket) GROUP BY ALL),
s AS (SELECT b.bucket, count(*) AS n FROM clean c CROSS JOIN LATERAL (VALUES (CAST(c.year AS VARCHAR)), ('all')) b(bucket) GROUP BY ALL)
SELECT s.bucket, any_value(s.n) AS source_trades, CAST(sum(t.n) AS BIGINT) AS represented_trades, count(*) AS available_types,
  CAST(any_value(s.n) - sum(t.n) AS BIGINT) AS unrepresented_trades, any_value(s.n) = sum(t.n) AS complete FROM s JOIN t USING (bucket) GROUP BY s.bucket"""
    ),
)
def coverage(spark, sf_dir):
    rows = summary.with_buckets(clean(spark, sf_dir))
    types = rows.groupBy("bucket", "key").agg(F.count("*").alias("n"))
    regions = rows.groupBy("bucket", "dong").agg(F.count("*").alias("n"))
    return ops.coverage(types, regions)


@query(
    "dq9_province_year_audit",
    with_trades(
        "SELECT gu, CAST(year AS BIGINT) AS year, count(*) AS used_rows, count(DISTINCT key) AS exact_types, count(DISTINCT complex) AS complexes FROM clean GROUP BY gu, year"
    ),
)
def province_year_audit(spark, sf_dir):
    return tidy(ops.province_year_audit(clean(spark, sf_dir)))


RULES = {
    "new_district_before_1997": (("ASIA", "EUROPE"), None, "1996-12-31"),
    "abolished_district": (("ASIA", "AFRICA"), "1998-07-01", "1999-12-31"),
}


@query(
    "dq10_boundary_flags",
    with_trades(
        """SELECT issue, count(*) AS rows, count(DISTINCT key) AS exact_types FROM (
  SELECT 'new_district_before_1997' AS issue, key FROM clean WHERE gu IN ('ASIA', 'EUROPE') AND date <= DATE '1996-12-31'
  UNION ALL SELECT 'abolished_district', key FROM clean WHERE gu IN ('ASIA', 'AFRICA') AND date BETWEEN DATE '1998-07-01' AND DATE '1999-12-31')
GROUP BY issue"""
    ),
)
def boundary_flags(spark, sf_dir):
    return ops.boundary_flags(clean(spark, sf_dir), RULES)


@query(
    "dq11_key_continuity",
    with_trades(
        """SELECT gu, count(*) AS recent_exact_types, count(*) FILTER (WHERE f < 1997) AS same_key_existed_before FROM (
  SELECT gu, key, max(year) AS l, min(year) AS f FROM clean GROUP BY ALL) WHERE l >= 1997 GROUP BY gu"""
    ),
)
def key_continuity(spark, sf_dir):
    return ops.key_continuity(clean(spark, sf_dir), 1997)


@query(
    "dq12_profile",
    with_trades(
        """, r AS (SELECT key, CAST(date AS VARCHAR) AS day, strlen('{"complex":"' || complex || '","dong":"' || dong || '","key":"' || key || '"}') AS size FROM trades),
c AS (SELECT substr(day, 1, 7) AS month, key, day, count(*) AS n, sum(size) AS b, max(size) AS m FROM r GROUP BY ALL)
SELECT month, CAST(sum(n) AS BIGINT) AS rows, round(sum(b) / sum(n), 6) AS mean_json_bytes, max(m) AS max_json_bytes,
  CAST(sum(n - 1) AS BIGINT) AS duplicate_entity_days, count(DISTINCT key) AS entities FROM c GROUP BY month"""
    ),
)
def profile(spark, sf_dir):
    rows = trades(spark, sf_dir).withColumn("day", F.col("date").cast("string"))
    return tidy(ops.profile(rows, ["complex", "dong", "key"], "key", "day"))


@query(
    "dq13_check_training",
    with_trades(
        POLICY_SERVED
        + """SELECT count(*) AS rows, count(*) FILTER (WHERE month < '1997-01' OR month > '2000-12') AS outside_months,
  count(*) FILTER (WHERE CAST(feature_cutoff AS DATE) > CAST(month || '-01' AS DATE) - 31) AS cutoff_breaches,
  count(*) FILTER (WHERE anchor IS NULL) AS invalid_values FROM features"""
    ),
)
def check_training(spark, sf_dir):
    from pricetide.operators import history

    frame = history.monthly_features(clean(spark, sf_dir), POLICY, F_FIRST, F_LAST)
    return ops.check_training(frame, "2000-12-31", "1997-01-01")




@query(
    "dq15_validate_panel",
    """WITH p AS (SELECT *, ts AS observed_at, ts + CASE WHEN event_type = 'view' THEN INTERVAL '-1' HOUR ELSE INTERVAL '2' HOUR END AS available_at,
    ts + CASE WHEN event_type = 'click' THEN INTERVAL '1' HOUR ELSE INTERVAL '48' HOUR END AS valid_until, event_id // 2 AS quote_id,
    CAST(floor(value * 100) AS BIGINT) - 200 AS price_krw, CASE WHEN event_type = 'error' THEN 'hold' ELSE 'buy' END AS side,
    CASE WHEN event_id % 7 = 0 THEN 'synthetic' WHEN event_id % 7 = 1 THEN 'archived_offer' WHEN event_id % 7 = 2 THEN 'transaction_proxy'
      WHEN event_id % 7 < 6 THEN 'observed_archive' END AS evidence_kind FROM events),
r AS (SELECT count(*) FILTER (WHERE event_id % 11 = 0) AS no_source, count(*) FILTER (WHERE event_id % 13 = 0) AS bad_hash, count(*) FILTER (WHERE price_krw <= 0) AS bad_price,
  count(*) FILTER (WHERE observed_at > available_at) AS late, count(*) FILTER (WHERE evidence_kind = 'synthetic') AS made,
  count(*) FILTER (WHERE evidence_kind IS DISTINCT FROM 'observed_archive') AS unarchived, count(*) FILTER (WHERE event_id % 17 = 0) AS no_model,
  count(*) FILTER (WHERE event_id % 19 = 0 OR event_id % 23 = 0) AS no_time, count(*) FILTER (WHERE side = 'hold') AS hold,
  count(*) FILTER (WHERE valid_until < available_at) AS expired, count(*) FILTER (WHERE evidence_kind IS NULL OR evidence_kind = 'observed_archive') AS undeclared FROM p),
d AS (SELECT count(*) AS twice FROM p WHERE quote_id IN (SELECT quote_id FROM p GROUP BY quote_id HAVING count(*) > 1))
SELECT 'observations' AS source, unnest(['missing_identity', 'missing_source', 'malformed_source_hash', 'price_not_positive', 'observed_after_available', 'synthetic_row_in_history',
    'score_not_finite', 'missing_model_version', 'missing_feature_time', 'not_archived', 'duplicate_id']) AS rule,
  unnest([0, no_source, bad_hash, bad_price, late, made, 0, no_model, no_time, unarchived, 0]) AS rows FROM r
UNION ALL SELECT 'quotes', unnest(['missing_identity', 'missing_source', 'malformed_source_hash', 'price_not_positive', 'observed_after_available', 'synthetic_row_in_history',
    'unknown_side', 'expired_before_available', 'undeclared_evidence', 'duplicate_id']), unnest([0, no_source, bad_hash, bad_price, late, made, hold, expired, undeclared, twice]) FROM r, d""",
)
def validate_panel(spark, sf_dir):
    e, ts, kind, k = table(spark, sf_dir, "events"), F.col("ts").cast("timestamp"), F.col("event_type"), F.col("event_id")
    hours = lambda c: F.make_interval(hours=c)
    digest = F.sha2(k.cast("string"), 256)
    told = F.when(k % 7 == 0, "synthetic").when(k % 7 == 1, "archived_offer").when(k % 7 == 2, "transaction_proxy").when(k % 7 < 6, "observed_archive")
    panel = e.select(
        F.col("user_id").cast("string").alias("asset_id"), k.alias("observation_id"),
        F.floor(k / 2).alias("quote_id"), (F.floor(F.col("value") * 100) - 200).alias("price_krw"),
        F.col("value").alias("score"), ts.alias("observed_at"), (ts + hours(F.when(kind == "view", -1).otherwise(2))).alias("available_at"),
        (ts + hours(F.when(kind == "click", 1).otherwise(48))).alias("valid_until"), F.when(kind == "error", "hold").otherwise("buy").alias("side"),
        F.when(k % 11 == 0, " ").otherwise(kind).alias("source_id"), F.when(k % 13 == 0, F.concat(F.lit("x"), F.substring(digest, 2, 63))).otherwise(digest).alias("source_sha256"),
        told.alias("evidence_kind"), F.when(k % 17 != 0, "v1").alias("model_version"), F.when(k % 19 != 0, ts).alias("max_feature_available_at"),
        F.when(k % 23 != 0, ts).alias("max_training_label_available_at"),
    )
    return ops.validate_panel(panel, panel)


@query(
    "dq16_validate_months",
    with_trades(
        """, a AS (SELECT month, count(*) AS actual_rows, count(*) FILTER (WHERE strftime(order_date, '%Y-%m') <> month) AS foreign_rows FROM trades GROUP BY month),
m AS (SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS declared_rows FROM trades GROUP BY 1)
SELECT month, coalesce(declared_rows, 0) AS declared_rows, coalesce(actual_rows, 0) AS actual_rows, coalesce(foreign_rows, 0) AS foreign_rows
FROM m FULL JOIN a USING (month) WHERE coalesce(declared_rows, 0) <> coalesce(actual_rows, 0) OR coalesce(foreign_rows, 0) > 0"""
    ),
)
def validate_months(spark, sf_dir):
    rows = trades(spark, sf_dir).select("month", F.col("order_date").cast("string").alias("day"))
    manifest = trades(spark, sf_dir).groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("rows"))
    return ops.validate_months(rows, manifest)


ROUTES = """
SELECT event_id AS id, user_id AS complex_id, CASE event_type WHEN 'view' THEN 'station' WHEN 'click' THEN 'school' WHEN 'purchase' THEN 'bus_stop'
    WHEN 'signup' THEN 'station' ELSE 'park' END AS purpose, CASE WHEN event_type = 'error' THEN 'disconnected' ELSE 'assumed_connector_total' END AS status,
  value AS origin_m, value * 2 AS network_m, 10.0 AS destination_m,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL WHEN event_id % 5 = 0 THEN value * 3 ELSE value * 3 + 10.0 END AS total_m FROM {events}
"""


def routes(spark, sf_dir):
    rows = spark.sql(ROUTES, events=table(spark, sf_dir, "events"))
    speed = lambda v: (F.col("total_m") / v)
    return rows.select(
        "id", "complex_id", "purpose", "status",
        F.struct("origin_m", "network_m", F.col("destination_m").cast("double").alias("destination_m"), "total_m").alias("distance"),
        F.struct(speed(80).alias("base_min"), speed(90).alias("fast_min"), speed(60).alias("slow_min")).alias("time"),
    )


@query(
    "dq18_validate_routes",
    f"""WITH r AS ({ROUTES.format(events='events')})
SELECT 'unknown_status' AS rule, 0 AS violations UNION ALL SELECT 'unknown_purpose', count(*) FROM r WHERE purpose = 'park'
UNION ALL SELECT 'total_differs_from_parts', count(*) FROM r WHERE status <> 'disconnected' AND abs(total_m - (origin_m + network_m + destination_m)) >= 1e-7
UNION ALL SELECT 'time_differs_from_speed', 0
UNION ALL SELECT 'disconnected_has_values', count(*) FROM r WHERE status = 'disconnected' AND total_m IS NOT NULL
UNION ALL SELECT 'one_route_per_purpose', count(*) FROM (SELECT complex_id FROM r GROUP BY complex_id HAVING count(*) <> 3 OR count(DISTINCT purpose) <> 3)
UNION ALL SELECT 'duplicate_route_id', 0""",
)
def validate_routes(spark, sf_dir):
    return ops.validate_routes(routes(spark, sf_dir))
