"""Point-in-time history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import history as ops
from pricetide.operators import summary
from pricetide.operators.stats import median
from pricetide.plans.registry import query
from pricetide.session import stored
from pricetide.sources.domain import LAW_CHANGE, clean, with_trades

FIRST, LAST = "1995-07-01", "2001-12-01"
UNIFORM = ops.Lag(uniform=31)
POLICY = ops.Lag(law_change=LAW_CHANGE)

SERVED = f"""
, origins AS (SELECT CAST(o AS DATE) AS origin FROM range(DATE '{FIRST}', DATE '{LAST}' + 1, INTERVAL 6 MONTH) t(o)),
served AS (SELECT c.*, origin, 31 AS lag, origin - date AS age FROM clean c
  JOIN origins ON date + 31 <= origin AND origin - date <= 31 + 365)
"""


def _served(spark, sf_dir):
    return ops.history_join(clean(spark, sf_dir), UNIFORM, FIRST, LAST, every=6)


def tidy(df, places=6, dates=("origin",)):
    """Doubles rounded, dates as text: the form the twins return."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "double":
            out[name] = F.round(name, places)
        elif kind == "date":
            out[name] = F.col(name).cast("string")
        elif kind in ("int", "smallint"):
            out[name] = F.col(name).cast("long")
    return df.withColumns(out)


@query(
    "jn12_history_join",
    with_trades(SERVED + "SELECT CAST(origin AS VARCHAR) AS origin, key, CAST(date AS VARCHAR) AS date, price, age FROM served"),
)
def history_join(spark, sf_dir):
    return tidy(_served(spark, sf_dir).select("origin", "key", "date", "price", "age"), 10)


def _windows(kind):
    if kind == "n":
        return ", ".join(f"count(*) FILTER (WHERE age <= lag + {n}) AS n{n}" for n in ops.WINDOWS)
    return ", ".join(f"round(median(log_price) FILTER (WHERE age <= lag + {n}), 6) AS median{n}" for n in ops.WINDOWS)


@query(
    "ag4_window_stats",
    with_trades(
        SERVED
        + f"SELECT CAST(origin AS VARCHAR) AS origin, key, {_windows('n')}, {_windows('m')} FROM served GROUP BY origin, key"
    ),
)
def window_stats(spark, sf_dir):
    return tidy(ops.window_stats(_served(spark, sf_dir)))


def decay_sql(source, prefix="ew"):
    picks = ", ".join(f"min(log_price) FILTER (WHERE h = {h} AND cw >= tw * 0.5) AS {prefix}{h}" for h in ops.HALF_LIVES)
    values = ", ".join(f"({h})" for h in ops.HALF_LIVES)
    return f"""SELECT origin, key, {picks} FROM (
      SELECT *, sum(w) OVER (PARTITION BY origin, key, h ORDER BY log_price ROWS UNBOUNDED PRECEDING) AS cw,
        sum(w) OVER (PARTITION BY origin, key, h) AS tw
      FROM (SELECT origin, key, h, log_price, round(pow(2.0, -age / CAST(h AS DOUBLE)) * 1e9) AS w
            FROM {source} CROSS JOIN (VALUES {values}) t(h)))
    GROUP BY origin, key"""


@query(
    "ag5_ew_median",
    with_trades(
        SERVED
        + ", d AS ("
        + decay_sql("served")
        + ") SELECT CAST(origin AS VARCHAR) AS origin, key, "
        + ", ".join(f"round(ew{h}, 6) AS ew{h}" for h in ops.HALF_LIVES)
        + " FROM d"
    ),
)
def ew_median(spark, sf_dir):
    return tidy(ops.ew_medians(_served(spark, sf_dir)))


EVIDENCE = """
  pow(sum(pow(2.0, -age / 90.0)), 2) / sum(pow(2.0, -age / 90.0) * pow(2.0, -age / 90.0)) AS eff90,
  sum(pow(2.0, -age / 90.0)) AS mass90, count(DISTINCT day) FILTER (WHERE age <= lag + 90) AS active_days90,
  CASE WHEN count(*) FILTER (WHERE age <= lag + 90) >= 2 THEN
    quantile_cont(log_price, 0.75) FILTER (WHERE age <= lag + 90)
    - quantile_cont(log_price, 0.25) FILTER (WHERE age <= lag + 90) END AS spread90,
  median(floor) FILTER (WHERE age <= lag + 90) AS hist_floor
"""


@query(
    "ag6_evidence_stats",
    with_trades(
        SERVED
        + f""", e AS (SELECT origin, key, {EVIDENCE} FROM served GROUP BY origin, key)
SELECT CAST(origin AS VARCHAR) AS origin, key, round(eff90, 6) AS eff90, round(mass90, 6) AS mass90, active_days90,
  round(spread90, 6) AS spread90, hist_floor FROM e"""
    ),
)
def evidence_stats(spark, sf_dir):
    return tidy(ops.evidence_stats(_served(spark, sf_dir)))


@query(
    "ag7_annual_activity",
    with_trades(
        SERVED
        + """, n AS (SELECT origin, key, count(*) FILTER (WHERE age <= lag + 30) AS n30,
  count(*) FILTER (WHERE age <= lag + 90) AS n90, count(*) AS n365 FROM served
  WHERE month(origin) >= 3 GROUP BY origin, key),
p AS (SELECT origin, key, median(log_price) AS prior_annual FROM clean JOIN origins
  ON year = year(origin) - 1 AND date + 31 <= origin GROUP BY origin, key)
SELECT CAST(origin AS VARCHAR) AS origin, key, round(prior_annual, 6) AS prior_annual,
  round(n30 / greatest(n90, 1), 6) AS concentration,
  round(((n90 + 1) / 90) / ((n365 - n90 + 1) / 275), 6) AS activity_ratio
FROM n LEFT JOIN p USING (origin, key)"""
    ),
)
def annual_activity(spark, sf_dir):
    return tidy(ops.annual_activity(clean(spark, sf_dir), _served(spark, sf_dir), UNIFORM))


POOLS = """
  median(log_price) FILTER (WHERE age < lag + 90) AS pool90, median(log_price) AS pool365,
  count(*) FILTER (WHERE age < lag + 90) AS pool_n90, count(*) AS pool_n365
"""


@query(
    "ag8_pools",
    with_trades(
        SERVED
        + f""", p AS (
  SELECT origin, 'complex' AS scope, complex AS id, {POOLS} FROM served WHERE age < lag + 365 GROUP BY origin, complex
  UNION ALL SELECT origin, 'peer', peer, {POOLS} FROM served WHERE age < lag + 365 GROUP BY origin, peer)
SELECT CAST(origin AS VARCHAR) AS origin, scope, id, round(pool90, 6) AS pool90, round(pool365, 6) AS pool365,
  pool_n90, pool_n365 FROM p"""
    ),
)
def pools(spark, sf_dir):
    return tidy(ops.pools(_served(spark, sf_dir)))


F_FIRST, F_LAST = "1996-03-01", "2001-11-01"
LAW = f"DATE '{LAW_CHANGE}'"
# Monthly origins under the 61/31 policy.
POLICY_SERVED = f"""
, origins AS (SELECT CAST(o AS DATE) AS origin,
    CASE WHEN CAST(o AS DATE) - 31 < {LAW} THEN 61 ELSE 31 END AS lag
  FROM range(DATE '{F_FIRST}', DATE '{F_LAST}' + 1, INTERVAL 1 MONTH) t(o) WHERE month(o) >= 3),
served AS (SELECT c.*, origin, lag, origin - date AS age FROM clean c
  JOIN origins ON available_date <= origin AND origin - date BETWEEN lag AND lag + 365),
tk AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS origin, key FROM clean
  WHERE month(date) >= 3 AND date_trunc('month', date) BETWEEN DATE '{F_FIRST}' AND DATE '{F_LAST}'),
own AS (SELECT served.* FROM served JOIN tk USING (origin, key)),
hist AS (SELECT origin, key, {', '.join(f'count(*) FILTER (WHERE age <= lag + {n}) AS n{n}' for n in ops.WINDOWS)},
  {', '.join(f'median(log_price) FILTER (WHERE age <= lag + {n}) AS median{n}' for n in ops.WINDOWS)}, {EVIDENCE}
  FROM own GROUP BY origin, key),
decay AS ({decay_sql('own')}),
cpool AS (SELECT origin, complex, {POOLS} FROM served WHERE age < lag + 365 GROUP BY origin, complex),
ppool AS (SELECT origin, peer, {POOLS} FROM served WHERE age < lag + 365 GROUP BY origin, peer),
newest AS (SELECT origin, key, max(date) AS last_date, arg_max(log_price, (date, log_price)) AS last
  FROM clean JOIN tk USING (key) WHERE available_date <= origin GROUP BY origin, key),
prior AS (SELECT origin, key, median(log_price) AS prior_annual FROM clean JOIN tk USING (key)
  WHERE year = year(origin) - 1 AND available_date <= origin GROUP BY origin, key),
raw_features AS (
  SELECT c.key, c.complex, c.peer, c.gu, c.area, c.floor, c.price_oku, c.log_price AS actual,
    CAST(c.date AS VARCHAR) AS contract_date, year(origin) AS year, strftime(origin, '%Y-%m') AS month, o.lag AS lag_days,
    CAST(origin - o.lag AS VARCHAR) AS feature_cutoff, year(origin) - built AS age,
    c.floor - hist_floor AS floor_delta, CASE WHEN c.floor <= 2 THEN 1.0 ELSE 0.0 END AS low_floor,
    coalesce(ew90, cpool.pool90, cpool.pool365, ppool.pool90, ppool.pool365) AS anchor,
    {', '.join(f'coalesce(hist.n{n}, 0) AS n{n}' for n in ops.WINDOWS)},
    median30, median90, median180, median365, ew30, ew60, ew90, ew180, last, origin - last_date AS last_age,
    spread90, coalesce(eff90, 0) AS eff90, coalesce(mass90, 0) AS mass90, coalesce(active_days90, 0) AS active_days90,
    prior_annual, cpool.pool90 AS complex90, cpool.pool365 AS complex365, ppool.pool90 AS peer90, ppool.pool365 AS peer365,
    coalesce(cpool.pool_n90, 0) AS complex_n90, coalesce(cpool.pool_n365, 0) AS complex_n365,
    coalesce(ppool.pool_n90, 0) AS peer_n90, coalesce(ppool.pool_n365, 0) AS peer_n365
  FROM clean c JOIN origins o ON CAST(date_trunc('month', c.date) AS DATE) = o.origin
    LEFT JOIN hist USING (origin, key) LEFT JOIN decay USING (origin, key)
    LEFT JOIN newest USING (origin, key) LEFT JOIN prior USING (origin, key)
    LEFT JOIN cpool ON cpool.origin = o.origin AND cpool.complex = c.complex
    LEFT JOIN ppool ON ppool.origin = o.origin AND ppool.peer = c.peer
  WHERE o.origin IN (SELECT origin FROM cpool)),
features AS (SELECT * REPLACE (
    coalesce(ew30, anchor) AS ew30, coalesce(ew60, anchor) AS ew60, coalesce(ew90, anchor) AS ew90,
    coalesce(ew180, anchor) AS ew180, coalesce(last, anchor) AS last, coalesce(median90, anchor) AS median90,
    coalesce(median365, anchor) AS median365, coalesce(prior_annual, anchor) AS prior_annual),
  n30 / greatest(n90, 1) AS concentration, ((n90 + 1) / 90) / ((n365 - n90 + 1) / 275) AS activity_ratio
  FROM raw_features)
"""
_DOUBLES = (
    "anchor median30 median90 median180 median365 ew30 ew60 ew90 ew180 last spread90 eff90 mass90 prior_annual "
    "complex90 complex365 peer90 peer365 concentration activity_ratio actual price_oku"
).split()


@query(
    "ag9_monthly_features",
    with_trades(
        POLICY_SERVED
        + "SELECT * REPLACE ("
        + ", ".join(f"round({c}, 6) AS {c}" for c in _DOUBLES)
        + ") FROM features"
    ),
)
def monthly_features(spark, sf_dir):
    return tidy(ops.monthly_features(clean(spark, sf_dir), POLICY, F_FIRST, F_LAST))


def _index(spark, sf_dir):
    """Monthly median price per district (``sale``) and per unit of area (``rent``)."""
    rows = clean(spark, sf_dir).withColumn("period", F.trunc("date", "MM"))
    sale = median(rows, ["gu", "period"], "price", "value").withColumn("kind", F.lit("sale"))
    rent = median(rows, ["gu", "period"], F.col("price") / F.col("area"), "value").withColumn("kind", F.lit("rent"))
    return sale.unionByName(rent).select("gu", "kind", "period", "value")


INDEX = """
, idx AS (
  SELECT gu, 'sale' AS kind, CAST(date_trunc('month', date) AS DATE) AS period, median(price) AS value FROM clean GROUP BY ALL
  UNION ALL SELECT gu, 'rent', CAST(date_trunc('month', date) AS DATE), median(price / area) FROM clean GROUP BY ALL)
"""
_CHANGES = ", ".join(
    f"CASE WHEN b{n}.value IS NOT NULL THEN round(ln(i.value / b{n}.value), 6) END AS change_{n}m" for n in (1, 3, 6, 12)
)
_BEFORE = " ".join(
    f"LEFT JOIN idx b{n} ON b{n}.gu = s.gu AND b{n}.kind = s.kind AND b{n}.period = s.period - INTERVAL {n} MONTH"
    for n in (1, 3, 6, 12)
)


@query(
    "wn4_index_change",
    with_trades(
        INDEX
        + f""", s AS (SELECT gu, kind, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM (
    SELECT gu, kind, min(period) AS lo, max(period) AS hi FROM idx GROUP BY gu, kind))
SELECT s.gu, s.kind, CAST(s.period AS VARCHAR) AS period, {_CHANGES}
FROM s LEFT JOIN idx i USING (gu, kind, period) {_BEFORE}"""
    ),
)
def index_change(spark, sf_dir):
    return tidy(ops.observed_index(_index(spark, sf_dir), ["sale", "rent"]))


_KB = ", ".join(
    f"round(ln(n{k}.value / b{k}{n}.value), 6) AS kb_{k}_{n}m" for k in ("sale", "rent") for n in (1, 3, 6, 12)
)
_KB_JOIN = " ".join(
    f"LEFT JOIN idx n{k} ON n{k}.gu = c.gu AND n{k}.kind = '{k}' AND n{k}.period = c.m - INTERVAL 2 MONTH "
    + " ".join(
        f"LEFT JOIN idx b{k}{n} ON b{k}{n}.gu = c.gu AND b{k}{n}.kind = '{k}' AND b{k}{n}.period = c.m - INTERVAL {n + 2} MONTH"
        for n in (1, 3, 6, 12)
    )
    for k in ("sale", "rent")
)


@query(
    "jn10_lagged_index",
    with_trades(
        INDEX
        + f""", t AS (SELECT gu, month, CAST(date_trunc('month', date) AS DATE) AS m, count(*) AS n FROM clean GROUP BY ALL)
SELECT c.gu, c.month, n, {_KB} FROM t c {_KB_JOIN}"""
    ),
)
def lagged_index(spark, sf_dir):
    frame = clean(spark, sf_dir).groupBy("gu", "month").agg(F.count("*").alias("n"))
    return tidy(ops.join_index(frame, _index(spark, sf_dir)))


@query(
    "ag43_market_context",
    with_trades(
        INDEX
        + """, l AS (SELECT max(period) AS p FROM idx)
SELECT i.gu, i.kind, strftime(i.period, '%Y-%m') AS period, CAST(n AS BIGINT) AS months,
  round((i.value / b.value - 1) * 100, 6) AS change_pct
FROM idx i JOIN l ON i.period = l.p CROSS JOIN (VALUES (1), (3), (6), (12)) t(n)
JOIN idx b ON b.gu = i.gu AND b.kind = i.kind AND b.period = i.period - to_months(n)"""
    ),
)
def market_context(spark, sf_dir):
    return tidy(summary.market_context(_index(spark, sf_dir)))


@query(
    "ag45_cadence",
    with_trades(
        POLICY_SERVED
        + """, f AS (SELECT *, make_date(CAST(year AS INTEGER), CAST(((CAST(substr(month, 6, 2) AS INTEGER) - 3) // 3) * 3 + 3 AS INTEGER), 1) AS refresh
  FROM features),
a AS (SELECT DISTINCT refresh AS origin, key FROM f),
fown AS (SELECT served.* FROM served JOIN a USING (origin, key)),
fdecay AS ("""
        + decay_sql("fown")
        + """),
j AS (SELECT f.*, coalesce(d.ew90, c.pool90, c.pool365, p.pool90, p.pool365) AS frozen FROM f
  LEFT JOIN fdecay d ON d.origin = f.refresh AND d.key = f.key
  LEFT JOIN cpool c ON c.origin = f.refresh AND c.complex = f.complex
  LEFT JOIN ppool p ON p.origin = f.refresh AND p.peer = f.peer)
SELECT year, count(*) AS n, round(avg(abs(exp(anchor - actual) - 1)), 6) AS monthly_mape,
  round(avg(abs(exp(frozen - actual) - 1)), 6) AS frozen_mape
FROM j WHERE anchor IS NOT NULL AND frozen IS NOT NULL GROUP BY year"""
    ),
)
def cadence(spark, sf_dir):
    # Both kinds of inputs read the joined trades.
    trades = stored(clean(spark, sf_dir).select("key", "complex", "peer", "gu", "area", "built", "floor", "date", "day", "log_price", "price_oku"))
    features = ops.monthly_features(trades, POLICY, F_FIRST, F_LAST).select(
        "key", "complex", "peer", "month", "year", "anchor", "actual"
    )
    both = ops.frozen_features(features, trades, POLICY, F_FIRST, F_LAST, 3).where("anchor IS NOT NULL AND frozen_anchor IS NOT NULL")
    error = lambda c: F.avg(F.abs(F.expm1(F.col(c) - F.col("actual"))))
    return tidy(
        both.groupBy("year").agg(
            F.count("*").alias("n"), error("anchor").alias("monthly_mape"), error("frozen_anchor").alias("frozen_mape")
        )
    )
