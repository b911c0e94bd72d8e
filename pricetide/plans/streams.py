"""Streaming, versioned tables, readers and writers over files derived from the driver tables.

The files go below the folder of :func:`pricetide.session.scratch_path`.
"""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricetide.operators import quality

from pricetide.plans.history import tidy
from pricetide.plans.normalised import DASHBOARD, MATCH, CANONICAL_SALES, canonical_sales, dashboard
from pricetide.plans.registry import query
from pricetide.session import scratch_path
from pricetide.sources import readers, sinks
from pricetide.sources.domain import EXPORT_SQL, clean, sale_export, table, trades, with_trades
from pricetide.streaming import ledger, refresh

POLLS = """
WITH r AS (SELECT event_type AS partition, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS observed_at, CAST(CAST(floor(value / 4) AS INTEGER) AS VARCHAR) AS row FROM events),
c AS (SELECT partition, observed_at, row, count(*) AS n FROM r GROUP BY ALL),
p AS (SELECT DISTINCT partition, observed_at FROM r),
g AS (SELECT k.partition, k.row, p.observed_at, coalesce(n, 0) AS n FROM (SELECT DISTINCT partition, row FROM r) k JOIN p USING (partition) LEFT JOIN c USING (partition, row, observed_at)),
ch AS (SELECT * FROM (SELECT *, coalesce(lag(n) OVER (PARTITION BY partition, row ORDER BY observed_at), 0) AS b FROM g) WHERE n <> b)
"""


def poll_rows(spark, sf_dir):
    """One poll per event type and day; a row is the value's 4-wide bucket."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("partition"), F.to_date("ts").cast("timestamp").alias("observed_at"),
        F.floor(F.col("value") / 4).cast("int").cast("string").alias("row"),
    )


def _text(df):
    return df.withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd"))


def run_ledger(spark, sf_dir, name):
    root = scratch_path(spark, name)
    ledger.write_polls(poll_rows(spark, sf_dir), f"{root}/polls")
    book = ledger.Ledger(spark, f"{root}/ledger")
    book.run(ledger.read_polls(spark, f"{root}/polls"), f"{root}/checkpoint")
    return book


@query(
    "st1_read_polls",
    POLLS + "SELECT partition, strftime(observed_at, '%Y-%m-%d') AS observed_at, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY ALL",
)
def read_polls(spark, sf_dir):
    root = scratch_path(spark, "polls")
    ledger.write_polls(poll_rows(spark, sf_dir), f"{root}/polls")
    stream = ledger.read_polls(spark, f"{root}/polls")
    sink = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
    sink.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(ledger.POLL_SCHEMA).parquet(f"{root}/out")
    return _text(rows.groupBy("partition", "observed_at").agg(F.count("row").alias("rows")))


@query(
    "st2_ledger",
    POLLS + "SELECT partition, row, strftime(observed_at, '%Y-%m-%d') AS observed_at, n AS count FROM ch",
)
def ledger_changes(spark, sf_dir):
    return _text(run_ledger(spark, sf_dir, "ledger").changes().select("partition", "row", "observed_at", "count"))


@query(
    "st3_rejected_polls",
    """WITH d AS (SELECT DISTINCT event_type AS partition, CAST(ts AS DATE) AS day FROM events)
SELECT partition, strftime(day, '%Y-%m-%d') AS observed_at, CASE WHEN day = DATE '2024-01-10' THEN 'repeated_instant' ELSE 'older_than_latest' END AS reason FROM d
WHERE day < DATE '2024-01-10' OR (day = DATE '2024-01-10' AND partition = 'error')
UNION ALL SELECT DISTINCT x.partition, strftime(x.day, '%Y-%m-%d'), 'older_than_latest' FROM d x JOIN d y ON x.partition = y.partition AND y.day > x.day AND y.day <= DATE '2024-01-14' AND x.day > DATE '2024-01-10'""",
)
def rejected_polls(spark, sf_dir):
    root = scratch_path(spark, "late")
    rows = poll_rows(spark, sf_dir)
    book = ledger.Ledger(spark, f"{root}/ledger")
    ledger.write_polls(rows.where("observed_at = TIMESTAMP '2024-01-10'"), f"{root}/polls")
    stream = ledger.read_polls(spark, f"{root}/polls")
    book.run(stream, f"{root}/checkpoint")
    # The other partitions' last polls come once more unchanged, which is no fault; four later days come in one batch, the newest first.
    again = F.when(F.expr("partition = 'error' AND observed_at = TIMESTAMP '2024-01-10'"), F.concat("row", F.lit("!"))).otherwise(F.col("row"))
    old = rows.where("observed_at <= TIMESTAMP '2024-01-10'").withColumn("row", again).withColumn("delivered_at", F.col("observed_at"))
    backwards = rows.where("observed_at > TIMESTAMP '2024-01-10' AND observed_at <= TIMESTAMP '2024-01-14'")
    backwards = backwards.withColumn("delivered_at", F.expr("TIMESTAMP '2024-03-01' - (observed_at - TIMESTAMP '2024-01-01')"))
    ledger.write_polls(old.unionByName(backwards), f"{root}/polls")
    book.run(stream, f"{root}/checkpoint")
    return _text(book.rejected().select("partition", "observed_at", "reason"))


@query(
    "st4_rows_as_observed",
    POLLS + "SELECT partition, row, n FROM g WHERE observed_at = TIMESTAMP '2024-01-17' AND n > 0",
)
def rows_as_observed(spark, sf_dir):
    root = scratch_path(spark, "observed")
    polls = poll_rows(spark, sf_dir)
    book = ledger.Ledger(spark, f"{root}/ledger", compact_every=1)
    # Two batches, a generation after each: the answer comes from the first generation and the changes after it.
    for part in ("observed_at < TIMESTAMP '2024-01-16'", "observed_at >= TIMESTAMP '2024-01-16'"):
        ledger.write_polls(polls.where(part), f"{root}/polls")
        book.run(ledger.read_polls(spark, f"{root}/polls"), f"{root}/checkpoint")
    rows = book.rows_as_observed("2024-01-17 12:00:00")
    return rows.groupBy("partition", "row").agg(F.count("*").alias("n"))


@query(
    "st5_bootstrap",
    POLLS
    + """, first AS (SELECT * FROM c WHERE observed_at = TIMESTAMP '2024-01-05'), second AS (SELECT * FROM c WHERE observed_at = TIMESTAMP '2024-01-06'),
b AS (SELECT partition, row, coalesce(first.n, 0) AS before, coalesce(second.n, 0) AS after FROM first FULL JOIN second USING (partition, row))
SELECT partition, row, '2024-01-05' AS observed_at, before AS count FROM b WHERE before > 0 UNION ALL SELECT partition, row, '2024-01-06', after FROM b WHERE before <> after""",
)
def bootstrap(spark, sf_dir):
    root = scratch_path(spark, "bootstrap")
    rows = poll_rows(spark, sf_dir)
    book = ledger.Ledger(spark, f"{root}/ledger")
    book.bootstrap(rows.where("observed_at = TIMESTAMP '2024-01-05'").withColumnRenamed("observed_at", "fetched_at"))
    ledger.write_polls(rows.where("observed_at = TIMESTAMP '2024-01-06'"), f"{root}/polls")
    book.run(ledger.read_polls(spark, f"{root}/polls"), f"{root}/checkpoint")
    return _text(book.changes().select("partition", "row", "observed_at", "count"))


LAG_EVENTS = (
    POLLS
    + """, f AS (SELECT partition, row, min(observed_at) AS first_at, arg_min(n, observed_at) AS copies FROM ch GROUP BY ALL),
e AS (SELECT f.*, (SELECT max(p.observed_at) FROM p WHERE p.partition = f.partition AND p.observed_at < first_at) AS prior,
  (SELECT count(*) FROM p WHERE p.partition = f.partition AND p.observed_at < first_at) AS k,
  date_diff('day', DATE '2023-12-01' + CAST(row AS INTEGER), CAST(first_at + INTERVAL 9 HOUR AS DATE)) AS age FROM f)
"""
)


def _contract_date():
    return F.date_add(F.lit("2023-12-01").cast("date"), F.col("row").cast("int"))


@query(
    "ag42_reporting_ages",
    LAG_EVENTS
    + """SELECT CASE WHEN age < 0 THEN 'negative' WHEN age <= 7 THEN '0-7' WHEN age <= 14 THEN '8-14' WHEN age <= 30 THEN '15-30' WHEN age <= 60 THEN '31-60' WHEN age <= 90 THEN '61-90'
    WHEN age <= 180 THEN '91-180' ELSE '181+' END AS age_bin, CASE WHEN k = 1 THEN 'baseline' ELSE 'explicit_poll' END AS absence_bound, count(*) AS new_signatures,
  CAST(sum(copies) AS BIGINT) AS new_row_copies, count(*) FILTER (WHERE first_at - prior > INTERVAL 7 DAY) AS wide_intervals FROM e WHERE prior IS NOT NULL GROUP BY ALL""",
)
def reporting_ages(spark, sf_dir):
    book = run_ledger(spark, sf_dir, "ages")
    return ledger.reporting_lag_audit(book.changes(), book.polls(), _contract_date())[0]


@query(
    "ag42_revisions",
    LAG_EVENTS
    + """, s AS (SELECT *, lag(n) OVER (PARTITION BY partition, row ORDER BY observed_at) AS x FROM ch)
SELECT partition, any_value(q.a) AS ledger_signatures, any_value(q.b) AS left_censored_signatures, count(x) AS revision_events, count(*) FILTER (WHERE n > x) AS count_increase_events,
  count(*) FILTER (WHERE n < x) AS count_decrease_events, count(*) FILTER (WHERE n > x AND x = 0) AS reappearance_events,
  CAST(coalesce(sum(x - n) FILTER (WHERE n < x), 0) AS BIGINT) AS removed_row_copies
FROM s JOIN (SELECT partition, count(*) AS a, count(*) FILTER (WHERE prior IS NULL) AS b FROM e GROUP BY partition) q USING (partition) GROUP BY partition""",
)
def revisions(spark, sf_dir):
    book = run_ledger(spark, sf_dir, "revisions")
    return ledger.reporting_lag_audit(book.changes(), book.polls(), _contract_date())[1]


@query(
    "st6_refresh_plan",
    with_trades(
        """, s AS (SELECT dong AS scope, min(date) AS a, max(date) AS b FROM trades GROUP BY dong),
m AS (SELECT scope, b, CAST(unnest(generate_series(CAST(date_trunc('month', a) AS DATE), CAST(date_trunc('month', b) AS DATE), INTERVAL 1 MONTH)) AS DATE) AS month FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY scope) - 3 AS old FROM m),
k AS (SELECT * FROM i WHERE i >= old OR i = (b - DATE '0001-01-01' + 1) % old),
g AS (SELECT *, i - row_number() OVER (PARTITION BY scope, year(month) ORDER BY i) AS isl FROM k)
SELECT scope, CAST(min(month) AS VARCHAR) AS first_day, CAST(max(least(last_day(month), b)) AS VARCHAR) AS last_day, count(*) AS months FROM g GROUP BY scope, year(month), isl"""
    ),
)
def refresh_plan(spark, sf_dir):
    scopes = trades(spark, sf_dir).groupBy(F.col("dong").alias("scope")).agg(F.min("date").alias("start"), F.max("date").alias("cutoff"))
    return tidy(refresh.refresh_plan(scopes))


@query(
    "st7_apply_refresh",
    with_trades(
        """SELECT gu, year, count(*) AS n, max(price) AS top FROM (SELECT gu, year, CASE WHEN gu = 'ASIA' AND year = 1999 THEN price * 2 ELSE price END AS price
  FROM trades WHERE NOT (gu = 'ASIA' AND year = 1999 AND cancelled)) GROUP BY ALL"""
    ),
)
def apply_refresh(spark, sf_dir):
    path = scratch_path(spark, "refresh")
    rows = trades(spark, sf_dir).select("gu", "year", "key", "price", "cancelled")
    refresh.write_partitions(rows, path, ["gu", "year"])
    new = rows.where("gu = 'ASIA' AND year = 1999 AND NOT cancelled").withColumn("price", F.col("price") * 2)
    if refresh.apply_refresh(spark, path, new, ["gu", "year"]).where("NOT matches").count():
        raise ValueError("refreshed partitions do not reconcile")
    back = spark.read.schema("key string, price double, cancelled boolean, gu string, year int").parquet(path)
    return back.groupBy("gu", "year").agg(F.count("*").alias("n"), F.max("price").alias("top"))


def _store(spark, sf_dir, name):
    store = refresh.VersionedStore(spark, scratch_path(spark, name))
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("row_no"), F.col("user_id").cast("string").alias("entity_key"),
        F.date_format("ts", "yyyy-MM-dd").alias("observed_day"), F.col("event_type").alias("region_code"), F.col("props").alias("payload"),
    )
    return store, rows


@query(
    "st8_publish_version",
    """SELECT 'events' AS dataset_key, count(*) AS row_count, 2 AS publications FROM events WHERE event_type <> 'error'""",
)
def publish_version(spark, sf_dir):
    store, rows = _store(spark, sf_dir, "publish")
    store.publish(rows, "events")
    store.publish(rows, "events")
    store.publish(rows.where("region_code <> 'error'"), "events")
    log = store.log().groupBy("dataset_key").agg(F.count("*").alias("publications"))
    return store.heads().join(log, "dataset_key").select("dataset_key", "row_count", F.col("publications"))


@query(
    "st9_query_rows",
    """SELECT event_id + 1 AS row_no, CAST(user_id AS VARCHAR) AS entity_key, strftime(ts, '%Y-%m-%d') AS observed_day, event_type AS region_code, props AS payload FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' AND event_id + 1 > 100 ORDER BY event_id LIMIT 50""",
)
def query_rows(spark, sf_dir):
    store, rows = _store(spark, sf_dir, "query")
    pinned = store.publish(rows, "events")["version"]
    store.publish(rows.where("region_code = 'view'"), "events")
    return store.query("events", pinned, region="click", start="2024-01-05", end="2024-01-20", after=100, limit=50).drop("version_id")




@query(
    "st10_changed_months",
    with_trades(
        """, n AS (SELECT month, count(*) AS v FROM trades GROUP BY month), h AS (SELECT month, count(*) AS v FROM trades WHERE NOT (year = 2000 AND cancelled) AND year <> 2001 GROUP BY month)
SELECT n.month AS dataset_key, CAST(n.v AS VARCHAR) AS version_id, h.v IS NULL AS is_new FROM n LEFT JOIN h USING (month) WHERE h.v IS DISTINCT FROM n.v"""
    ),
)
def changed_months(spark, sf_dir):
    rows = trades(spark, sf_dir)
    version = lambda d: d.groupBy(F.col("month").alias("dataset_key")).agg(F.count("*").cast("string").alias("version_id"))
    return refresh.changed_months(version(rows), version(rows.where("NOT (year = 2000 AND cancelled) AND year <> 2001")))


@query(
    "st11_prunable_versions",
    with_trades(
        """, v AS (SELECT dong AS dataset_key, month AS version_id, CASE WHEN count(*) > 25 THEN 'complete' ELSE 'archived' END AS status, count(*) AS row_count FROM trades GROUP BY ALL),
h AS (SELECT dataset_key, max(version_id) AS version_id FROM v WHERE dataset_key <> 'NATION_5' GROUP BY 1)
SELECT v.* FROM v JOIN h USING (dataset_key) WHERE status = 'complete' AND v.version_id <> h.version_id"""
    ),
)
def prunable_versions(spark, sf_dir):
    counts = trades(spark, sf_dir).groupBy(F.col("dong").alias("dataset_key"), F.col("month").alias("version_id")).agg(F.count("*").alias("row_count"))
    versions = counts.withColumn("status", F.when(F.col("row_count") > 25, "complete").otherwise("archived"))
    heads = versions.where("dataset_key <> 'NATION_5'").groupBy("dataset_key").agg(F.max("version_id").alias("version_id"))
    return refresh.prunable_versions(versions, heads).select("dataset_key", "version_id", "status", "row_count")


@query(
    "st12_verify_shards",
    with_trades(
        """, s AS (SELECT dong, linenumber - 1 AS shard_index, CASE WHEN dong = 'NATION_4' AND linenumber = 3 THEN 'other' ELSE gu END AS snapshot_id FROM trades GROUP BY ALL)
SELECT dong AS collection, count(*) AS shards, count(DISTINCT shard_index) AS distinct_shards, count(DISTINCT snapshot_id) AS snapshots,
  count(*) FILTER (WHERE shard_index NOT BETWEEN 0 AND 6) AS unknown_shards,
  count(*) = 7 AND count(DISTINCT shard_index) = 7 AND count(DISTINCT snapshot_id) = 1 AND count(*) FILTER (WHERE shard_index NOT BETWEEN 0 AND 6) = 0 AS verified FROM s GROUP BY dong"""
    ),
)
def verify_shards(spark, sf_dir):
    other = (F.col("dong") == "NATION_4") & (F.col("linenumber") == 3)
    shards = trades(spark, sf_dir).select(
        F.col("dong").alias("collection"), (F.col("linenumber") - 1).alias("shard_index"), F.when(other, "other").otherwise(F.col("gu")).alias("snapshot_id")
    ).distinct()
    return refresh.verify_shards(shards, 7)


# --- Readers and writers ------------------------------------------------------


@query("src1_read_trades", with_trades(DASHBOARD + 'SELECT "CGG_CD", "CTRT_DAY", "THING_AMT", "RTRCN_DAY", "DCLR_SE", count(*) AS n FROM dashboard GROUP BY ALL'))
def read_trades(spark, sf_dir):
    path = scratch_path(spark, "trades")
    dashboard(spark, sf_dir).write.option("header", True).option("emptyValue", "").csv(path)
    return readers.read_trades(spark, path).groupBy("CGG_CD", "CTRT_DAY", "THING_AMT", "RTRCN_DAY", "DCLR_SE").agg(F.count("*").alias("n"))


PREAMBLE = (
    "□ 검색조건", "계약일자 : 1995-06-01 ~ 2001-06-30", "실거래구분 : 아파트(매매)", "주소구분 : 지번주소", "시도 : {sido}", "시군구 : 전체",
    "읍면동 : 전체", "면적 : 전체", "금액선택 : 전체",
)


def write_exports(spark, sf_dir, path):
    """One export folder per region, its rows in several files, each with preamble and header, as the publisher delivers them."""
    from pricetide.operators.normalise import SALE_HEADERS

    rows = sale_export(spark, sf_dir)
    have = set(rows.columns)
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    line = F.concat_ws(",", *[quoted(F.col(n) if n in have and n != "road" else F.lit("")) for n in SALE_HEADERS.values()])
    body = rows.select("source_id", F.col("contract_month").alias("part"), F.lit(len(PREAMBLE) + 2).alias("_o"), line.alias("value"))
    header = ",".join(f'"{h}"' for h in SALE_HEADERS)
    # One delivered file per (region, month): its preamble and header lines are rows too, and the writer keeps the order of the sort.
    top = [F.concat(F.lit('"'), F.regexp_replace(F.lit(p), r"\{sido\}", F.col("source_id")), F.lit('"')) for p in PREAMBLE] + [F.lit(header), F.lit("," * (len(SALE_HEADERS) - 1))]
    heads = body.select("source_id", "part").distinct().select("source_id", "part", F.posexplode(F.array(*top)).alias("_o", "value"))
    files = heads.unionByName(body).repartition("source_id", "part").sortWithinPartitions("source_id", "part", "_o", "value")
    # Most of a line is empty cells.
    files.select("source_id", "part", "value").write.partitionBy("source_id", "part").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


@query(
    "src2_read_export",
    with_trades(
        EXPORT_SQL
        + """SELECT source_id AS region, contract_month, count(*) AS rows, max(count(*)) OVER (PARTITION BY source_id, contract_month) AS last_row_number,
  count(DISTINCT amount) AS amounts, min(address_text) AS first_address FROM sales GROUP BY source_id, contract_month"""
    ),
)
def read_export(spark, sf_dir):
    path = scratch_path(spark, "exports")
    write_exports(spark, sf_dir, path)
    rows = readers.read_export(spark, f"{path}/*/*", "sale")
    region = F.regexp_replace(F.regexp_extract("file", r"source_id=([^/]+)/", 1), "%20", " ")
    return rows.groupBy(region.alias("region"), "contract_month").agg(
        F.count("*").alias("rows"), F.max("row_number").alias("last_row_number"), F.count_distinct("amount").alias("amounts"),
        F.min("address_text").alias("first_address"),
    )


@query(
    "src3_export_scope",
    with_trades(EXPORT_SQL + "SELECT source_id AS sido, '1995-06-01' AS first, '2001-06-30' AS last, true AS proven, count(DISTINCT contract_month) AS files FROM sales GROUP BY source_id"),
)
def export_scope(spark, sf_dir):
    path = scratch_path(spark, "scope")
    write_exports(spark, sf_dir, path)
    scope = readers.proven_scope(readers.export_scope(spark, f"{path}/*/*"), "sale")
    return tidy(scope.groupBy("sido", F.col("start").alias("first"), F.col("end").alias("last"), "proven").agg(F.count("*").alias("files")))


@query(
    "src4_read_xml_items",
    with_trades(
        """SELECT CAST(year AS VARCHAR) AS "RCPT_YR", dong AS "STDG_NM", strftime(date, '%Y%m%d') AS "CTRT_DAY", CASE WHEN linenumber = 1 AND cancelled THEN 'cancelled' WHEN cancelled THEN CAST(date AS VARCHAR) ELSE '' END AS "RTRCN_DAY",
  CAST(built AS VARCHAR) AS "MNO", CAST(linenumber AS VARCHAR) AS "SNO", count(*) AS n FROM trades GROUP BY ALL"""
    ),
)
def read_xml_items(spark, sf_dir):
    path = scratch_path(spark, "xml")
    rows = trades(spark, sf_dir)
    first = F.col("linenumber") == 1
    items = rows.select(
        F.col("year").cast("string").alias("dealYear"), F.month("date").cast("string").alias("dealMonth"), F.dayofmonth("date").cast("string").alias("dealDay"),
        F.when(first, F.col("dong")).alias("umdNm"), F.when(~first, F.col("dong")).alias("umdNmKor"),
        F.concat_ws("-", F.col("built").cast("string"), F.col("linenumber").cast("string")).alias("jibun"),
        F.col("price").cast("string").alias("dealAmount"), F.col("area").cast("string").alias("excluUseAr"),
        F.when(first, F.when(F.col("cancelled"), "O").otherwise("-")).alias("cdealType"),
        F.when(~first, F.when(F.col("cancelled"), F.col("date").cast("string")).otherwise("-")).alias("cancelDealDate"),
    )
    items.write.format("xml").option("rowTag", "item").option("rootTag", "items").save(path)
    keys = ["RCPT_YR", "STDG_NM", "CTRT_DAY", "RTRCN_DAY", "MNO", "SNO"]
    return readers.read_xml_items(spark, path).groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "src5_read_leases",
    with_trades(
        """SELECT receipt_year AS source_file_year, CAST(receipt_year AS VARCHAR) AS receipt_year, gu AS district, count(*) AS n, min(strftime(date, '%Y%m%d')) AS first_day FROM trades GROUP BY ALL"""
    ),
)
def read_leases(spark, sf_dir):
    from pricetide.plans.normalised import annual_leases

    path = scratch_path(spark, "leases")
    names = {v: k for k, v in readers.ANNUAL_LEASE_HEADERS.items()}
    rows = annual_leases(spark, sf_dir).withColumnsRenamed(names).withColumn("file_year", F.col(names["receipt_year"]))
    rows.write.partitionBy("file_year").option("header", True).csv(path)
    back = readers.read_leases(spark, f"{path}/*")
    return back.groupBy("source_file_year", "receipt_year", "district").agg(F.count("*").alias("n"), F.min("contract_day").alias("first_day"))


@query(
    "src6_unpivot_index",
    with_trades(
        """SELECT CAST(date_trunc('month', date) AS DATE)::VARCHAR AS period, gu, 'sale' AS kind, CAST(count(*) AS DOUBLE) AS value FROM clean GROUP BY ALL"""
    ),
)
def unpivot_index(spark, sf_dir):
    areas = sorted(r["r_name"] for r in table(spark, sf_dir, "region").select("r_name").collect())
    wide = clean(spark, sf_dir).groupBy(F.trunc("date", "MM").alias("m")).agg(
        *[F.nullif(F.count_if(F.col("gu") == g), F.lit(0).cast("long")).cast("string").alias(g) for g in areas]
    )
    token = F.when(F.col("m") == "1995-01-01", F.lit("1995.1")).when(F.month("m") == 1, F.concat(F.lit("'"), F.date_format("m", "yy.M"))).otherwise(F.date_format("m", "M"))
    path = scratch_path(spark, "index")
    # A sheet holds one row per month, in the order of months.
    sheet = wide.withColumn("token", token).repartition(1).sortWithinPartitions("m").select("token", *areas)
    sheet.write.option("header", True).csv(path)
    return tidy(readers.read_index(spark, path, areas, "sale"), 10)


def documents(rows, part, element, start, end, path):
    """One JSON document per part, written line by line in sorted partitions: an opening line, an element a line, a closing line."""
    key = F.col(part).alias("part")
    lines = rows.select(key, F.lit(1).alias("_o"), element.alias("value"))
    ends = lines.select("part").distinct().select("part", F.inline(F.array(F.struct(F.lit(0).alias("_o"), F.lit(start).alias("value")), F.struct(F.lit(2).alias("_o"), F.lit(end).alias("value")))))
    files = lines.unionByName(ends).repartition("part").sortWithinPartitions("part", "_o", "value")
    # A comma before each element but the first.
    after = F.lag("_o").over(Window.partitionBy("part").orderBy("_o", "value")) == 1
    comma = F.when((F.col("_o") == 1) & after, F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value"))
    files.select("part", "_o", F.col("value").alias("_v"), comma.alias("value")).sortWithinPartitions("part", "_o", "_v").select("part", "value").write.partitionBy("part").text(path)


@query(
    "src7_read_rows",
    "SELECT f.fmt, c_nationkey, count(*) AS n, max(c_name) AS last FROM customer CROSS JOIN (VALUES ('csv'), ('jsonl'), ('json')) f(fmt) GROUP BY ALL",
)
def read_rows(spark, sf_dir):
    path = scratch_path(spark, "rows")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    schema = "c_custkey long, c_name string, c_nationkey int"
    rows.write.option("header", True).option("compression", "gzip").csv(f"{path}/csv")
    rows.write.option("compression", "gzip").json(f"{path}/jsonl")
    # JSON arrays, one document per nation and thousand keys: arrays cannot be split, so each stays small.
    documents(rows.withColumn("part", F.concat_ws("-", "c_nationkey", F.floor(F.col("c_custkey") / 1000))), "part", F.to_json(F.struct(*rows.columns)), "[", "]", f"{path}/json")
    parts = [readers.read_rows(spark, p, fmt, schema).withColumn("fmt", F.lit(fmt)) for p, fmt in
             ((f"{path}/csv", "csv"), (f"{path}/jsonl", "jsonl"), (f"{path}/json/*", "json"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("fmt", "c_nationkey").agg(F.count("*").alias("n"), F.max("c_name").alias("last"))


@query(
    "src8_read_register",
    """SELECT CAST(c_custkey AS VARCHAR) AS apt_cd, c_name AS apt_nm, CAST(c_nationkey AS VARCHAR) AS tnohsh FROM customer""",
)
def read_register(spark, sf_dir):
    path = scratch_path(spark, "register")
    rows = table(spark, sf_dir, "customer").select(
        "c_nationkey",
        F.struct(F.col("c_custkey").cast("string").alias("apt_cd"), F.col("c_name").alias("apt_nm"), F.col("c_mktsegment").alias("apt_rdn_addr"),
                 F.col("c_nationkey").cast("string").alias("tnohsh"), F.lit("1").alias("whol_dong_cnt"), F.lit("1700000000000").alias("mdfcn_ymd")).alias("r"),
    )
    told = json.dumps(dict(zip(("TNOHSH", "WHOL_DONG_CNT"), readers.REGISTER_DESCRIPTION)), ensure_ascii=False)
    part = F.concat_ws("-", "c_nationkey", F.floor(F.col("r.apt_cd").cast("long") / 1000))
    documents(rows.withColumn("part", part), "part", F.to_json("r"), f'{{"DESCRIPTION": {told}, "DATA": [', "]}", path)
    return readers.read_register(spark, f"{path}/*").select("apt_cd", "apt_nm", "tnohsh")


@query(
    "src9_read_details",
    """SELECT CAST(p_partkey AS VARCHAR) AS apt_cd, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN ['2호선', '9호선'] ELSE [CAST(p_size AS VARCHAR) || '호선'] END, ',') AS subway_lines,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS subway_station, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10.0 ELSE p_size * 80.0 END AS subway_m FROM part""",
)
def read_details(spark, sf_dir):
    path = scratch_path(spark, "details")
    even = F.col("p_partkey") % 2 == 0
    raw = F.to_json(F.struct(F.concat(F.col("p_size").cast("string"), F.lit("호선")).alias("subwayLine"), F.concat(F.col("p_name"), F.lit("역")).alias("subwayStation"),
                             F.concat(F.lit("도보 "), F.col("p_size").cast("string"), F.lit("분")).alias("kaptdWtimesub")))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("apt_cd"), F.col("p_name").alias("apt_nm"), F.col("p_brand").alias("bjd_code"),
        F.when(even, "9, 2호선").otherwise("").alias("subway_line"), F.when(even, F.concat("p_brand", F.lit("지하철역/기타"))).otherwise("").alias("subway_station"),
        F.when(even, (F.col("p_size") * 10).cast("string")).otherwise("").alias("subway_distance_m"), F.lit("").alias("bus_stop_distance_m"),
        F.lit("").alias("education_facilities"), raw.alias("raw_json"),
    )
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    out = readers.read_details(spark, path).select("apt_cd", F.array_join("subway_lines", ",").alias("subway_lines"), "subway_station", "subway_m")
    return out


@query("src10_scan", "SELECT l_suppkey, count(*) AS n, max(l_extendedprice) AS top FROM lineitem WHERE l_quantity >= 45 GROUP BY l_suppkey")
def scan(spark, sf_dir):
    rows = readers.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_suppkey", "l_extendedprice"], F.col("l_quantity") >= 45)
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("top"))


@query(
    "snk1_write_canonical",
    with_trades(
        EXPORT_SQL + MATCH + CANONICAL_SALES
        + "SELECT 'sale' AS kind, coalesce(sido, 'unresolved') AS sido, coalesce(CAST(year(contract_date) AS VARCHAR), 'unknown') AS year, count(*) AS n FROM canonical GROUP BY ALL"
    ),
)
def write_canonical(spark, sf_dir):
    path = scratch_path(spark, "canonical")
    sinks.write_canonical(canonical_sales(spark, sf_dir), path)
    back = spark.read.schema("contract_date string, kind string, sido string, year string").json(path)
    return back.groupBy("kind", "sido", "year").agg(F.count("*").alias("n"))


@query(
    "snk2_write_trades",
    with_trades(DASHBOARD + 'SELECT substr("CGG_CD", 1, 2) AS sido, substr("CTRT_DAY", 1, 4) AS year, count(*) AS n, max("THING_AMT") AS top FROM dashboard GROUP BY ALL'),
)
def write_trades(spark, sf_dir):
    from pricetide.operators.normalise import DASHBOARD_COLUMNS

    path = scratch_path(spark, "trade-sink")
    sinks.write_trades(dashboard(spark, sf_dir), path)
    schema = ", ".join(f"`{c}` string" for c in [*DASHBOARD_COLUMNS, "sido", "year"])
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.groupBy("sido", "year").agg(F.count("*").alias("n"), F.max("THING_AMT").alias("top"))


@query(
    "snk3_export_months",
    with_trades(
        """, h AS (SELECT month, sha256('{"complex":"' || complex || '","dong":"' || dong || '"}') AS h FROM trades)
SELECT month, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS DECIMAL(20,0))) AS VARCHAR) AS digest FROM h GROUP BY month"""
    ),
)
def export_months(spark, sf_dir):
    path = scratch_path(spark, "months")
    manifest = sinks.export_months(trades(spark, sf_dir).select("month", "complex", "dong"), path)
    back = spark.read.schema("complex string, dong string, month string").json(path)
    return quality.partition_digest(back, ["month"], ["complex", "dong"]).join(manifest, ["month", "rows", "digest"], "left_semi")


@query("snk4_save_features", with_trades("SELECT gu, count(*) AS n, max(price) AS top FROM clean GROUP BY gu"))
def save_features(spark, sf_dir):
    path = scratch_path(spark, "features")
    sinks.save_features(clean(spark, sf_dir).select("gu", "key", "price"), path)
    return spark.read.parquet(path).groupBy("gu").agg(F.count("*").alias("n"), F.max("price").alias("top"))


@query(
    "snk5_publish_bundle",
    with_trades("SELECT dong, complex, key, CAST(built AS BIGINT) AS built, CAST(year AS BIGINT) AS year, count(*) AS n, max(price) AS top FROM clean GROUP BY ALL"),
)
def publish_bundle(spark, sf_dir):
    types = clean(spark, sf_dir).groupBy("dong", "complex", "key", "built", "year").agg(F.count("*").alias("n"), F.max("price").alias("top"))
    catalog, facts = sinks.publish_bundle(types, ["dong", "complex", "key", "built"], ["n", "top"], "year")
    return tidy(sinks.decode_bundle(catalog, facts), 10)


@query(
    "snk6_export_csv",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name WHEN c_custkey % 3 = 1 THEN 'a "' || c_name || '", b' ELSE c_name END AS name, CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || CAST(c_acctbal AS VARCHAR) AS balance FROM customer""",
)
def export_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    kind = F.col("c_custkey") % 3
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(kind == 0, F.concat(F.lit("="), "c_name")).when(kind == 1, F.concat(F.lit('a "'), "c_name", F.lit('", b'))).otherwise(F.col("c_name")).alias("name"),
        F.col("c_acctbal").cast("string").alias("balance"),
    )
    sinks.export_csv(rows, path)
    return spark.read.schema("c_custkey long, name string, balance string").option("header", True).option("escape", '"').csv(path)
