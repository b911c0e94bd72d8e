"""Relative-growth snapshots, outcome labels and lease evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import leases as lease_ops
from pricetide.operators import snapshot as ops
from pricetide.plans.history import tidy
from pricetide.plans.registry import query
from pricetide.session import stored
from pricetide.sources.domain import LAW_CHANGE, clean, table, with_trades

FIRST, LAST = "1996-01-01", "2001-07-01"
HORIZONS = (12, 24)
PATH = (24, 36, 48, 60)
LAW = f"DATE '{LAW_CHANGE}'"

SNAP = f"""
, d AS (SELECT * FROM clean WHERE floor BETWEEN 3 AND 50),
origins AS (SELECT CAST(o AS DATE) AS origin,
    CAST(o AS DATE) - CASE WHEN CAST(o AS DATE) - 31 < {LAW} THEN 61 ELSE 31 END AS cutoff
  FROM range(DATE '{FIRST}', DATE '{LAST}' + 1, INTERVAL 6 MONTH) t(o)),
past AS (SELECT d.*, origin, cutoff, cutoff - date AS back FROM d JOIN origins ON available_date <= origin AND date <= cutoff),
meta AS (SELECT DISTINCT key, complex, gu, area, built, peer FROM d),
e AS (SELECT origin, key, any_value(cutoff) AS cutoff, count(*) FILTER (WHERE back < 180) AS entry_n,
  median(log_price) FILTER (WHERE back < 180) AS entry,
  median(log_price) FILTER (WHERE back BETWEEN 180 AND 359) AS prior,
  count(*) FILTER (WHERE back < 90) AS n90, count(*) FILTER (WHERE back < 180) AS n180,
  count(*) FILTER (WHERE back < 365) AS n365, origin - max(date) AS last_age
  FROM past GROUP BY origin, key HAVING count(*) FILTER (WHERE back < 180) >= 3),
s0 AS (SELECT e.*, complex, gu, area, built, peer, year(origin) - built AS age, entry - prior AS momentum,
  (n90 + 1) / ((n365 - n90 + 1) / 3) AS activity FROM e JOIN meta USING (key)),
snap AS (SELECT s0.*, entry - median(entry) OVER w AS relative_level, median(momentum) OVER w AS peer_momentum,
  momentum - median(momentum) OVER w AS relative_momentum FROM s0 WINDOW w AS (PARTITION BY origin, peer))
"""


def trades(spark, sf_dir):
    """Read several times by each query: the joins of the tables run once."""
    rows = clean(spark, sf_dir).where(F.col("floor").between(3, 50))
    return stored(rows.select("key", "complex", "gu", "area", "built", "peer", "date", "price", "floor", "log_price"))


def snapshot(spark, sf_dir, rows=None):
    return ops.price_snapshot(trades(spark, sf_dir) if rows is None else rows, LAW_CHANGE, FIRST, LAST)


@query(
    "ag10_price_snapshot",
    with_trades(
        SNAP
        + """SELECT CAST(origin AS VARCHAR) AS origin, key, CAST(cutoff AS VARCHAR) AS cutoff, entry_n, round(entry, 6) AS entry,
  n90, n180, n365, complex, gu, area, built, peer, age, round(momentum, 6) AS momentum, round(activity, 6) AS activity,
  last_age, 'historical_policy' AS availability_regime, round(relative_level, 6) + 0.0 AS relative_level,
  round(peer_momentum, 6) + 0.0 AS peer_momentum, round(relative_momentum, 6) + 0.0 AS relative_momentum FROM snap"""
    ),
)
def price_snapshot(spark, sf_dir):
    return tidy(snapshot(spark, sf_dir))


@query(
    "ag11_dispersion",
    with_trades(
        SNAP
        + """SELECT CAST(snap.origin AS VARCHAR) AS origin, key,
  round(any_value(entry) - quantile_cont(log_price, 0.1), 6) AS lower_spread,
  round(quantile_cont(log_price, 0.9) - any_value(entry), 6) AS upper_spread,
  count(DISTINCT date) AS active_days, median(floor) AS median_floor
FROM snap JOIN past USING (origin, key) WHERE back < 180 GROUP BY snap.origin, key"""
    ),
)
def dispersion(spark, sf_dir):
    rows = trades(spark, sf_dir)
    out = ops.dispersion(rows, snapshot(spark, sf_dir, rows), LAW_CHANGE, FIRST, LAST)
    return tidy(out.select("origin", "key", "lower_spread", "upper_spread", "active_days", "median_floor"))


@query(
    "wn3_peer_relative",
    with_trades(
        SNAP
        + """SELECT CAST(origin AS VARCHAR) AS origin, key, peer, round(relative_level, 6) + 0.0 AS relative_level,
  round(relative_momentum, 6) + 0.0 AS relative_momentum FROM snap"""
    ),
)
def peer_relative(spark, sf_dir):
    snap = snapshot(spark, sf_dir).drop("relative_level", "peer_momentum", "relative_momentum")
    return tidy(ops.peer_relative(snap).select("origin", "key", "peer", "relative_level", "relative_momentum"))


def panel_sql(horizons, months, inclusive):
    """Outcome CTEs: panel(origin, horizon_months, key, growth, benchmark, target, label_available)."""
    values = ", ".join(f"({h})" for h in horizons)
    opens = ">=" if inclusive else ">"
    shift = "" if inclusive else " + 1"
    return f"""
, hz AS (SELECT *, CAST(origin + to_months(h) AS DATE) AS fin, CAST(origin + to_months(h - {months}) AS DATE) AS ini
  FROM origins CROSS JOIN (VALUES {values}) t(h)),
ex AS (SELECT origin, h, key, median(log_price) AS exit, count(*) AS exit_n FROM d JOIN hz
  ON date {opens} ini AND date <= fin GROUP BY origin, h, key),
p0 AS (SELECT snap.*, hz.h AS horizon_months, ini, fin, coalesce(exit_n, 0) AS exit_n, exit,
  CASE WHEN exit_n >= 3 THEN exit - entry END AS growth
  FROM snap JOIN hz USING (origin) LEFT JOIN ex ON ex.origin = hz.origin AND ex.h = hz.h AND ex.key = snap.key),
cm AS (SELECT origin, horizon_months, peer, complex, median(growth) AS g FROM p0 WHERE growth IS NOT NULL GROUP BY ALL),
lo AS (SELECT a.origin, a.horizon_months, a.peer, a.complex, CASE WHEN count(b.g) >= 5 THEN median(b.g) END AS benchmark
  FROM (SELECT DISTINCT origin, horizon_months, peer, complex FROM p0) a LEFT JOIN cm b
    ON a.origin = b.origin AND a.horizon_months = b.horizon_months AND a.peer = b.peer AND a.complex <> b.complex
  GROUP BY ALL),
panel AS (SELECT p0.*, benchmark, growth - benchmark AS target,
  greatest(fin + CASE WHEN fin < {LAW} THEN 61 ELSE 31 END,
    CASE WHEN ini{shift} <= {LAW} - 1 AND {LAW} - 1 <= fin THEN {LAW} - 1 + 61 END) AS label_available
  FROM p0 LEFT JOIN lo USING (origin, horizon_months, peer, complex))
"""


LABEL_COLUMNS = """CAST(origin AS VARCHAR) AS origin, key, CAST(horizon_months AS BIGINT) AS horizon_months, exit_n,
  round(exit, 6) AS exit, round(growth, 6) + 0.0 AS growth, round(benchmark, 6) + 0.0 AS benchmark,
  round(target, 6) + 0.0 AS target, CAST(label_available AS VARCHAR) AS label_available"""


def label_panel(spark, sf_dir, horizons=HORIZONS):
    rows = trades(spark, sf_dir)
    return stored(ops.labels(rows, snapshot(spark, sf_dir, rows), horizons, LAW_CHANGE, FIRST, LAST))


@query("ag12_exit_labels", with_trades(SNAP + panel_sql(HORIZONS, 6, True) + f"SELECT {LABEL_COLUMNS} FROM panel"))
def exit_labels(spark, sf_dir):
    return tidy(
        label_panel(spark, sf_dir).select(
            "origin", "key", "horizon_months", "exit_n", "exit", "growth", "benchmark", "target", "label_available"
        )
    )


@query(
    "ag13_path_labels",
    with_trades(
        SNAP
        + panel_sql(PATH, 12, False)
        + f"SELECT {LABEL_COLUMNS}, CAST(ini AS VARCHAR) AS exit_start_exclusive, CAST(fin AS VARCHAR) AS exit_end_inclusive FROM panel"
    ),
)
def path_labels(spark, sf_dir):
    rows = trades(spark, sf_dir)
    out = ops.path_labels(rows, snapshot(spark, sf_dir, rows), PATH, LAW_CHANGE, FIRST, LAST)
    return tidy(
        out.select(
            "origin", "key", "horizon_months", "exit_n", "exit", "growth", "benchmark", "target", "label_available",
            "exit_start_exclusive", "exit_end_inclusive",
        )
    )


@query(
    "jn19_loo_benchmark",
    with_trades(
        SNAP
        + panel_sql(HORIZONS, 6, True)
        + """SELECT DISTINCT CAST(origin AS VARCHAR) AS origin, CAST(horizon_months AS BIGINT) AS horizon_months, peer, complex,
  round(benchmark, 6) + 0.0 AS benchmark FROM panel"""
    ),
)
def loo_benchmark(spark, sf_dir):
    panel = label_panel(spark, sf_dir).drop("benchmark", "target")
    out = ops.loo_benchmark(panel)
    return tidy(out.select("origin", "horizon_months", "peer", "complex", "benchmark").distinct())


@query(
    "ag14_observation_counts",
    with_trades(
        SNAP
        + panel_sql(PATH, 12, False)
        + """, o AS (SELECT *, exit_n >= 3 AS observed, count(DISTINCT complex) FILTER (WHERE exit_n >= 3)
    OVER (PARTITION BY origin, horizon_months, peer) AS peers FROM p0)
SELECT CAST(origin AS VARCHAR) AS origin, CAST(horizon_months AS BIGINT) AS horizon_months, count(*) AS cohort,
  count(*) FILTER (WHERE observed) AS exit_with_three_trades,
  count(*) FILTER (WHERE observed AND peers >= 6) AS relative_outcome_observed,
  round(count(*) FILTER (WHERE observed AND peers >= 6) * 100 / count(*), 6) AS relative_observation_rate_pct
FROM o GROUP BY origin, horizon_months"""
    ),
)
def observation_counts(spark, sf_dir):
    rows = trades(spark, sf_dir)
    return tidy(ops.observation_counts(rows, snapshot(spark, sf_dir, rows), PATH, FIRST, LAST))


@query(
    "ag15_cohort_coverage",
    with_trades(
        SNAP
        + panel_sql(HORIZONS, 6, True)
        + """SELECT 'historical_policy' AS availability_regime, CAST(horizon_months AS BIGINT) AS horizon_months,
  CAST(origin AS VARCHAR) AS origin, count(*) AS cohort, count(*) FILTER (WHERE exit_n >= 3) AS exit_with_three_trades,
  count(target) AS relative_outcome_observed FROM panel GROUP BY origin, horizon_months"""
    ),
)
def cohort_coverage(spark, sf_dir):
    return tidy(ops.cohort_coverage(label_panel(spark, sf_dir)))


CASES = ("11", "42")
CASE_ORIGINS = ("1998-01-01", "1998-07-01")


@query(
    "ag16_case_horizons",
    with_trades(
        f"""
, d AS (SELECT * FROM clean WHERE floor BETWEEN 3 AND 50),
o AS (SELECT CAST(x AS DATE) AS origin, CAST(x AS DATE) - 31 AS cutoff FROM (VALUES {', '.join(f"('{c}')" for c in CASE_ORIGINS)}) t(x)),
e AS (SELECT origin, key, median(log_price) AS entry, count(*) AS entry_n FROM d JOIN o ON date BETWEEN cutoff - 179 AND cutoff
  GROUP BY ALL HAVING count(*) >= 3),
w AS (SELECT * FROM (VALUES (6, 12), (12, 18), (18, 24)) t(lo, hi)),
x AS (SELECT origin, lo, hi, key, median(log_price) AS exit, count(*) AS exit_n FROM d JOIN o ON true JOIN w
  ON date BETWEEN origin + to_months(lo) AND origin + to_months(hi) GROUP BY ALL),
b AS (SELECT e.*, w.lo, w.hi, m.complex, m.peer, m.area, exit_n, CASE WHEN exit_n >= 3 THEN exit - entry END AS growth
  FROM e JOIN (SELECT DISTINCT key, complex, peer, area FROM d) m USING (key) CROSS JOIN w
  LEFT JOIN x ON x.origin = e.origin AND x.lo = w.lo AND x.key = e.key)
SELECT CAST(a.origin AS VARCHAR) AS origin, CAST(a.lo AS BIGINT) AS lo, CAST(a.hi AS BIGINT) AS hi, a.key, a.complex, CAST(a.area AS BIGINT) AS area,
  a.entry_n, a.exit_n, round((exp(any_value(a.growth)) - 1) * 100, 6) AS growth_pct,
  count(DISTINCT p.complex) AS peer_complexes,
  CASE WHEN count(DISTINCT p.complex) >= 5 THEN round((exp(any_value(a.growth) - median(p.growth)) - 1) * 100, 6) + 0.0 END AS excess_pct
FROM b a LEFT JOIN b p ON p.origin = a.origin AND p.lo = a.lo AND p.peer = a.peer AND p.complex <> a.complex AND p.growth IS NOT NULL
WHERE a.complex IN {CASES} GROUP BY a.origin, a.lo, a.hi, a.key, a.complex, a.area, a.entry_n, a.exit_n"""
    ),
)
def case_horizons(spark, sf_dir):
    out = ops.case_horizons(trades(spark, sf_dir), F.col("complex").isin(*CASES), CASE_ORIGINS)
    return tidy(
        out.select(
            "origin", "lo", "hi", "key", "complex", "area", "entry_n", "exit_n", "growth_pct", "peer_complexes", "excess_pct"
        )
    )


@query(
    "ag31_baseline_signals",
    with_trades(
        SNAP
        + """SELECT CAST(origin AS VARCHAR) AS origin, key, round(-relative_momentum, 6) + 0.0 AS laggard,
  round(-relative_level, 6) + 0.0 AS cheap_peer, round(relative_momentum, 6) + 0.0 AS momentum_signal FROM snap"""
    ),
)
def baseline_signals(spark, sf_dir):
    out = ops.baseline_signals(snapshot(spark, sf_dir))
    return tidy(out.select("origin", "key", "laggard", "cheap_peer", "momentum_signal"))


@query(
    "ag32_mature_training",
    with_trades(
        SNAP
        + panel_sql(HORIZONS, 6, True)
        + f"""SELECT CAST(origin AS VARCHAR) AS origin, key, CAST(horizon_months AS BIGINT) AS horizon_months,
  round(target, 6) + 0.0 AS target, round(1.0 / count(*) OVER (PARTITION BY origin, key), 6) AS sample_weight
FROM panel WHERE label_available <= DATE '1999-07-01' AND target IS NOT NULL AND complex NOT IN {CASES}"""
    ),
)
def mature_training(spark, sf_dir):
    train, _ = ops.mature_training(label_panel(spark, sf_dir), "1999-07-01", HORIZONS, F.col("complex").isin(*CASES))
    return tidy(train.select("origin", "key", "horizon_months", "target", "sample_weight"))


@query(
    "ag32_training_support",
    with_trades(
        SNAP
        + panel_sql(HORIZONS, 6, True)
        + f""", t AS (SELECT * FROM panel WHERE label_available <= DATE '1999-07-01' AND target IS NOT NULL AND complex NOT IN {CASES})
SELECT CAST(h AS BIGINT) AS horizon_months, count(key) AS rows, count(DISTINCT origin) AS origins,
  count(key) >= 500 AND count(DISTINCT origin) >= 3 AS sufficient
FROM (VALUES (12), (24)) v(h) LEFT JOIN t ON horizon_months = h GROUP BY h"""
    ),
)
def training_support(spark, sf_dir):
    return tidy(
        ops.mature_training(label_panel(spark, sf_dir), "1999-07-01", HORIZONS, F.col("complex").isin(*CASES))[1]
    )


# Leases: line status as contract type, tax as monthly rent (0 = pure deposit lease).
LEASES = """
, leases AS (SELECT key, complex, gu, date, floor, price AS deposit, tax AS monthly_rent,
    CASE WHEN linestatus = 'F' THEN '신규' WHEN priority = '1-URGENT' THEN '미상' ELSE '갱신' END AS contract_type,
    receipt_year, ln(price / area) AS log_rent FROM trades)
"""


def leases(spark, sf_dir):
    from pricetide.sources.domain import trades as all_trades

    kind = (
        F.when(F.col("linestatus") == "F", lease_ops.NEW)
        .when(F.col("priority") == "1-URGENT", lease_ops.UNKNOWN)
        .otherwise(lease_ops.RENEWAL)
    )
    return all_trades(spark, sf_dir).select(
        "key", "complex", "gu", "date", "floor", F.col("price").alias("deposit"), F.col("tax").alias("monthly_rent"),
        kind.alias("contract_type"), "receipt_year", F.col("log_price").alias("log_rent"),
    )


@query(
    "ag17_lease_snapshot",
    with_trades(
        LEASES
        + """, v AS (SELECT DISTINCT key, date, floor, deposit, monthly_rent, contract_type, log_rent, DATE '1999-07-01' - 31 - date AS back
  FROM leases WHERE date <= DATE '1999-07-01' - 31 AND receipt_year <= 1999 AND date > DATE '1999-07-01' - 31 - 365)
SELECT key, count(*) FILTER (WHERE contract_type = '신규' AND back < 90) AS lease_new_n90,
  count(*) FILTER (WHERE contract_type = '신규' AND back < 180) AS lease_new_n180,
  count(*) FILTER (WHERE contract_type = '갱신' AND back < 180) AS lease_renewal_n180,
  count(*) FILTER (WHERE contract_type = '미상' AND back < 180) AS lease_unknown_n180,
  DATE '1999-07-01' - max(date) FILTER (WHERE contract_type = '신규') AS lease_last_age,
  CASE WHEN count(*) FILTER (WHERE contract_type = '신규' AND back < 90) >= 3
    THEN round(median(log_rent) FILTER (WHERE contract_type = '신규' AND back < 90), 6) END AS lease_log90,
  CASE WHEN count(*) FILTER (WHERE contract_type = '신규' AND back < 180) >= 3
    THEN round(median(log_rent) FILTER (WHERE contract_type = '신규' AND back < 180), 6) END AS lease_log180,
  CASE WHEN count(*) FILTER (WHERE contract_type = '신규' AND back < 180) >= 3
      AND count(*) FILTER (WHERE contract_type = '신규' AND back BETWEEN 180 AND 359) >= 3
    THEN round(median(log_rent) FILTER (WHERE contract_type = '신규' AND back < 180)
      - median(log_rent) FILTER (WHERE contract_type = '신규' AND back BETWEEN 180 AND 359), 6) + 0.0 END AS lease_momentum
FROM v GROUP BY key"""
    ),
)
def lease_snapshot(spark, sf_dir):
    return tidy(lease_ops.lease_snapshot(leases(spark, sf_dir), "1999-07-01"))


@query(
    "ag18_jeonse_ratio",
    with_trades(
        LEASES
        + """, l AS (SELECT *, date + 31 AS available FROM leases WHERE date BETWEEN DATE '2000-07-01' - 180 AND DATE '2000-07-01'
    AND date + 31 <= DATE '2000-07-01' AND monthly_rent = 0 AND deposit > 0),
s AS (SELECT key, median(price) AS m FROM trades WHERE date BETWEEN DATE '2000-07-01' - 180 AND DATE '2000-07-01'
    AND date + 31 <= DATE '2000-07-01' AND price > 0 AND NOT cancelled GROUP BY key HAVING count(*) >= 3),
a AS (SELECT key, count(*) FILTER (WHERE contract_type = '신규') AS n, count(*) FILTER (WHERE contract_type = '갱신') AS r,
  count(*) FILTER (WHERE contract_type = '미상') AS u, median(deposit) FILTER (WHERE contract_type = '신규') AS m FROM l GROUP BY key)
SELECT key, coalesce(n, 0) AS new_jeonse_count, coalesce(r, 0) AS renewal_count, coalesce(u, 0) AS unknown_contract_type_count,
  CASE WHEN n >= 3 THEN round(a.m, 6) END AS new_jeonse_median, round(s.m, 6) AS sale_median,
  CASE WHEN n >= 3 THEN round(a.m / s.m, 6) END AS new_jeonse_ratio
FROM a FULL JOIN s USING (key)"""
    ),
)
def jeonse_ratio(spark, sf_dir):
    from pricetide.sources.domain import trades as all_trades

    when = F.date_add("contract_date", 31).cast("timestamp")
    rents = leases(spark, sf_dir).withColumnRenamed("date", "contract_date").withColumn("available_at", when)
    sales = all_trades(spark, sf_dir).withColumnRenamed("date", "contract_date").withColumn("available_at", when)
    return tidy(lease_ops.jeonse_ratio(rents, sales, "2000-07-01"))


@query(
    "se3_distinct_signature",
    with_trades(
        LEASES
        + "SELECT DISTINCT key, CAST(date AS VARCHAR) AS date, floor, deposit, monthly_rent, contract_type FROM leases"
    ),
)
def distinct_signature(spark, sf_dir):
    return tidy(lease_ops.distinct_signature(leases(spark, sf_dir)).select(*lease_ops.SIGNATURE), 10)


def listings(spark, sf_dir):
    """Events as listing snapshots: user = listing, event type = district, error = withdrawn."""
    status = F.when(F.col("event_type") == "error", "withdrawn").otherwise("active")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("string").alias("key"),
        F.col("user_id").alias("listing_id"),
        status.alias("status"),
        F.col("value").alias("price"),
        F.col("ts").cast("timestamp").alias("available_at"),
        "event_id",
    )


@query(
    "jn21_asking_change",
    """
WITH l AS (SELECT CAST(user_id % 10 AS VARCHAR) AS key, user_id AS id, value AS price, ts, event_id,
  CASE WHEN event_type = 'error' THEN 'withdrawn' ELSE 'active' END AS status FROM events WHERE value > 0),
n AS (SELECT key, id, arg_max(status, (ts, event_id)) AS status, arg_max(price, (ts, event_id)) AS price FROM l
  WHERE ts <= TIMESTAMP '2024-01-25' GROUP BY key, id),
o AS (SELECT key, id, arg_max(status, (ts, event_id)) AS status, arg_max(price, (ts, event_id)) AS price FROM l
  WHERE ts <= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY GROUP BY key, id),
p AS (SELECT n.key, n.price, ln(n.price / o.price) AS c FROM n LEFT JOIN o ON n.key = o.key AND n.id = o.id AND o.status = 'active'
  WHERE n.status = 'active')
SELECT key, count(*) AS active_listing_ids, count(c) AS matched_listing_ids,
  CASE WHEN count(*) >= 3 THEN round(quantile_cont(price, 0.25), 6) END AS asking_q25,
  CASE WHEN count(c) >= 3 THEN round(exp(median(c)) - 1, 6) + 0.0 END AS matched_change,
  CASE WHEN count(c) >= 3 THEN round(avg(CASE WHEN c < 0 THEN 1.0 WHEN c >= 0 THEN 0.0 END), 6) END AS price_cut_share
FROM p GROUP BY key""",
)
def asking_change(spark, sf_dir):
    return tidy(lease_ops.asking_change(listings(spark, sf_dir), "2024-01-25", 7, tie=("event_id",)))


VINTAGES = """
WITH v AS (SELECT event_type AS series_id, CAST(user_id % 12 + 1 AS VARCHAR) AS period, ts AS available_at, value, event_id FROM events)
"""


def vintages(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"),
        (F.col("user_id") % 12 + 1).cast("string").alias("period"),
        F.col("ts").cast("timestamp").alias("available_at"),
        "value",
        "event_id",
    )


@query(
    "jn15_latest_vintage",
    VINTAGES
    + """SELECT series_id, period, arg_max(value, (available_at, event_id)) AS value
FROM v WHERE available_at <= TIMESTAMP '2024-01-20' GROUP BY series_id, period""",
)
def latest_vintage(spark, sf_dir):
    out = lease_ops.latest_vintage(vintages(spark, sf_dir), "2024-01-20", tie=("event_id",), levels=False)
    return out.select("series_id", "period", "value")


@query(
    "dq14_observable",
    VINTAGES
    + "SELECT series_id, count(*) AS n, max(event_id) AS newest FROM v WHERE available_at <= TIMESTAMP '2024-01-20' GROUP BY series_id",
)
def observable(spark, sf_dir):
    seen = lease_ops.observable(vintages(spark, sf_dir), "2024-01-20")
    return seen.groupBy("series_id").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))
