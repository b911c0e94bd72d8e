"""Summary queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import summary as ops
from pricetide.plans.registry import query
from pricetide.sources.domain import clean, with_trades

PYEONG = "3.3058"
METRIC_ROWS = f"""
, m AS (
  SELECT c.*, b.bucket, x.metric, x.value FROM clean c
  CROSS JOIN LATERAL (VALUES (CAST(c.year AS VARCHAR)), ('all')) b(bucket)
  CROSS JOIN LATERAL (VALUES ('price_billion', c.price / 10000), ('area_pyeong', c.area / {PYEONG}),
    ('price_per_pyeong', c.price / (c.area / {PYEONG}))) x(metric, value))
"""


def _rounded(df, places, *cols):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query(
    "ag1_region_summary",
    with_trades(
        METRIC_ROWS
        + """
SELECT sido, gu, dong, bucket, metric, count(*) AS n, round(avg(value), 4) AS avg,
  round(median(value), 7) AS median, min(value) AS min, max(value) AS max
FROM m GROUP BY ALL"""
    ),
)
def region_summary(spark, sf_dir):
    out = _rounded(ops.region_summary(clean(spark, sf_dir)), 4, "avg")
    return _rounded(out, 7, "median")


# Attributes of an observation, made from its columns; each expression is valid in both dialects.
OBSERVED = {
    "school_m": "CASE WHEN linenumber = 3 THEN NULL ELSE CAST(orderkey % 900 AS INT) + 100 END",
    "school_name": "'S' || CAST(partkey % 50 AS VARCHAR(9))",
    "school_500m": "CASE WHEN linenumber = 3 THEN NULL ELSE orderkey % 900 < 400 END",
    "subway_m": "CASE WHEN linenumber = 2 THEN NULL ELSE CAST(partkey % 700 AS INT) END",
    "bus_m": "CASE WHEN tax = 0.0 THEN NULL ELSE CAST(orderkey % 300 AS INT) END",
    "subway_station": "CASE WHEN linenumber = 2 THEN '' ELSE 'T' || CAST(partkey % 30 AS VARCHAR(9)) END",
    "education_n": "CASE WHEN linenumber = 5 THEN NULL ELSE CAST(partkey % 12 AS INT) END",
    "education": "CASE WHEN linenumber = 5 THEN NULL ELSE 'E' || CAST(partkey % 12 AS VARCHAR(9)) END",
    "households": "CASE WHEN linenumber < 4 THEN NULL ELSE CAST(partkey % 400 AS INT) END",
}
RULES = ops.Attributes(
    order=("date", "price", "floor", "orderkey", "linenumber"), nearest={"school_m": ["school_name"]}, largest={"education_n": ["education"]},
    smallest=["subway_m", "bus_m"], any_true=["school_500m"], first_known=["built", "households", "subway_station"],
)


@query(
    "ag2_type_summary",
    with_trades(
        f"""
, s AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in OBSERVED.items())} FROM clean),
o AS (SELECT *, row_number() OVER (ORDER BY date, price, floor, orderkey, linenumber) AS pos FROM s)
SELECT gu, dong, b.bucket, key, min(complex) AS complex, count(*) AS n, min(built) AS built,
  count(floor) AS floor_n, min(floor) AS floor_min, max(floor) AS floor_max, median(floor) AS floor_median,
  min(price) AS price_min, max(price) AS price_max, round(median(price), 4) AS price_median,
  min(school_m) AS school_m, arg_min(school_name, [school_m, pos]) FILTER (WHERE school_m IS NOT NULL) AS school_name, bool_or(school_500m) AS school_500m,
  max(education_n) AS education_n, arg_min(education, [-education_n, pos]) FILTER (WHERE education_n IS NOT NULL) AS education,
  min(subway_m) AS subway_m, min(bus_m) AS bus_m, arg_min(households, pos) FILTER (WHERE households IS NOT NULL) AS households,
  arg_min(subway_station, pos) FILTER (WHERE subway_station <> '') AS subway_station
FROM o CROSS JOIN LATERAL (VALUES (CAST(o.year AS VARCHAR)), ('all')) b(bucket)
GROUP BY gu, dong, b.bucket, key"""
    ),
)
def type_summary(spark, sf_dir):
    rows = clean(spark, sf_dir).withColumns({n: F.expr(e) for n, e in OBSERVED.items()})
    return _rounded(ops.type_summary(rows, attributes=RULES), 4, "price_median")


@query(
    "ag3_recent_contracts",
    with_trades(
        """
SELECT gu, dong, bucket, position, CAST(date AS VARCHAR) AS date, key, price, floor FROM (
  SELECT c.*, b.bucket, row_number() OVER (PARTITION BY gu, dong, b.bucket
    ORDER BY date DESC, price DESC, floor DESC, key DESC) AS position
  FROM clean c CROSS JOIN LATERAL (VALUES (CAST(c.year AS VARCHAR)), ('all')) b(bucket))
WHERE position <= 5"""
    ),
)
def recent_contracts(spark, sf_dir):
    out = ops.recent(clean(spark, sf_dir), 5, tie=("price", "floor", "key"))
    return out.select(
        "gu", "dong", "bucket", F.col("position").cast("long").alias("position"),
        F.col("date").cast("string").alias("date"), "key", "price", "floor",
    )
