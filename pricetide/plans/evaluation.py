"""Valuation, evaluation and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import evaluation as ops
from pricetide.operators import joins as join_ops
from pricetide.operators import quality
from pricetide.operators.stats import median
from pricetide.plans.history import tidy
from pricetide.plans.joins import panel as decision_panel
from pricetide.plans.registry import query
from pricetide.plans.snapshots import HORIZONS, SNAP, label_panel, panel_sql, snapshot
from pricetide.sources.domain import clean, trades, with_trades

PREDICTIONS = """
SELECT key, complex, gu AS region, month, year, CAST(date AS STRING) AS contract_date, date, floor, linenumber AS n90, area, price, price_oku,
  log_price AS actual, log_price + (tax - 0.04) AS base, log_price + (discount - 0.07) * 0.8 AS candidate, log_price + (tax - 0.04) - 0.031 AS p10,
  log_price + (tax - 0.04) AS p50, log_price + (tax - 0.04) + 0.031 AS p90, 0.015 + discount * 0.2 + linenumber * 0.00037 AS radius, orderkey, linenumber
FROM {clean}
"""
PRED = f", pred AS ({PREDICTIONS.format(clean='clean')})"


def predictions(spark, sf_dir):
    return spark.sql(PREDICTIONS, clean=clean(spark, sf_dir))


D_CANON = "floor(({c}) * 10000 + 0.5) / 10000"


@query(
    "ag19_recent_comparison",
    with_trades(
        """, e AS (SELECT max(date) AS d FROM clean WHERE date <= DATE '2000-09-30')
SELECT key, count(*) AS trade_count, floor(median(price_oku) * 10000 + 0.5) / 10000 AS median_price_billion, CAST(min(date) AS VARCHAR) AS first_contract_date,
  CAST(max(date) AS VARCHAR) AS last_contract_date, CAST(any_value(d) - 89 AS VARCHAR) AS window_start, CAST(any_value(d) AS VARCHAR) AS window_end
FROM clean JOIN e ON date BETWEEN d - 89 AND d GROUP BY key"""
    ),
)
def recent_comparison(spark, sf_dir):
    return tidy(ops.recent_comparison(clean(spark, sf_dir), "2000-09"), 10)


REPLAY = (
    PRED
    + f"""
, sc0 AS (SELECT *, {D_CANON.format(c='exp(base) * area / 10000')} AS neutral, {D_CANON.format(c='price_oku')} AS observed FROM pred),
sc AS (SELECT *, CASE WHEN neutral = observed THEN 50.0 ELSE floor((50 + 40 * tanh(ln(neutral / observed) / 0.1)) * 10 + 0.5) / 10 END AS score,
  (1 - observed / neutral) * 100 AS discount_pct FROM sc0)
"""
)


def _replay(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return ops.transaction_replay(rows, F.exp("base") * F.col("area") / 10000, F.col("price_oku"), 0.1)


@query(
    "ag20_replay_monthly",
    with_trades(
        REPLAY
        + f"""SELECT key, month, count(*) AS trade_count, round(median(score), 6) AS median_score, round(median(discount_pct), 6) + 0.0 AS median_discount_pct,
  round(median(observed), 6) AS median_price_billion, round(median(neutral), 6) AS median_neutral_price_billion,
  median(CAST(n90 AS DOUBLE)) AS recent_history_median_count FROM sc GROUP BY key, month"""
    ),
)
def replay_monthly(spark, sf_dir):
    return tidy(_replay(spark, sf_dir)[0])


@query(
    "ag20_replay_latest",
    with_trades(
        REPLAY
        + """SELECT key, contract_date, floor, observed AS price, neutral, score, position FROM (SELECT *, row_number() OVER (PARTITION BY key
  ORDER BY contract_date DESC, floor DESC, observed DESC) AS position FROM sc) WHERE position <= 3"""
    ),
)
def replay_latest(spark, sf_dir):
    return tidy(_replay(spark, sf_dir)[1].select("key", "contract_date", "floor", "price", "neutral", "score", "position"), 10)


VALUATIONS = """
SELECT key, min(gu) AS region_code, CASE WHEN count(*) % 7 = 0 THEN 'insufficient_history' ELSE 'available' END AS status,
  max(price_oku) AS price_billion, 0.2 AS score_error_scale, count(*) % 9 AS recent_trade_count FROM {clean} GROUP BY key
"""


@query(
    "ag21_current_comparisons",
    with_trades(
        f""", e AS (SELECT max(date) AS d FROM clean WHERE date <= DATE '2000-09-30'),
rc AS (SELECT key, count(*) AS n, {D_CANON.format(c='median(price_oku)')} AS m FROM clean JOIN e ON date BETWEEN d - 89 AND d GROUP BY key),
v AS (SELECT * REPLACE ({D_CANON.format(c='price_billion')} AS price_billion) FROM ({VALUATIONS.format(clean='clean')})),
j AS (SELECT v.*, n, m, CASE WHEN price_billion = m THEN 50.0 ELSE floor((50 + 40 * tanh(ln(price_billion / m) / 0.2)) * 10 + 0.5) / 10 END AS s FROM v LEFT JOIN rc USING (key))
SELECT key, region_code, CASE WHEN status <> 'available' THEN status WHEN m IS NULL THEN 'no_recent_transactions' ELSE 'available' END AS comparison_status,
  CASE WHEN status = 'available' THEN s END AS score, n AS comparison_trade_count,
  CASE WHEN status = 'available' AND m IS NOT NULL THEN CASE WHEN n >= 3 AND recent_trade_count >= 3 THEN 'recent_evidence' ELSE 'sparse_history' END END AS evidence_level FROM j"""
    ),
)
def current_comparisons(spark, sf_dir):
    rows = clean(spark, sf_dir)
    values = spark.sql(VALUATIONS, clean=rows)
    out = ops.current_comparisons(values, ops.recent_comparison(rows, "2000-09")).orderBy(*ops.comparison_order())
    return tidy(out.select("key", "region_code", "comparison_status", "score", "comparison_trade_count", "evidence_level"), 10)


def d_metric(p, group):
    e = f"(exp({p} - actual) - 1)"
    return f"""SELECT {group}, count(*) AS transactions, count(DISTINCT complex) AS complexes, round(avg(abs{e}) * 100, 6) AS mape_pct,
  round(avg(cb) * 100, 6) AS complex_balanced_mape_pct, round(median(abs{e}) * 100, 6) AS median_ape_pct, round(avg(abs{e} * price_oku), 6) AS mae_oku,
  round(avg{e} * 100, 6) + 0.0 AS bias_pct, round(avg(CASE WHEN abs{e} <= 0.1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS within10_pct
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {group}, complex) = 1 THEN avg(abs{e}) OVER (PARTITION BY {group}, complex) END AS cb FROM src) GROUP BY {group}"""


@query("ag22_metric", with_trades(PRED + ", src AS (SELECT * FROM pred) " + d_metric("candidate", "year").replace("SELECT year,", "SELECT CAST(year AS BIGINT) AS year,", 1)))
def metric(spark, sf_dir):
    return tidy(ops.metric(predictions(spark, sf_dir), "candidate", ["year"]))


SEGMENTS = {
    "asia": "region = 'ASIA'", "europe": "region = 'EUROPE'", "recent_1to2": "n90 BETWEEN 1 AND 2", "recent_3plus": "n90 >= 3", "low_floor": "floor <= 2",
}


@query(
    "ag23_segment_metrics",
    with_trades(
        PRED
        + ", src AS ("
        + " UNION ALL ".join(f"SELECT *, '{n}' AS segment FROM pred WHERE {c}" for n, c in SEGMENTS.items())
        + ") "
        + d_metric("base", "segment")
    ),
)
def segment_metrics(spark, sf_dir):
    return tidy(ops.segment_metrics(predictions(spark, sf_dir), "base", {n: F.expr(c) for n, c in SEGMENTS.items()}))


D_PIN = {n: f"greatest({q} * (actual - {n}), ({q} - 1) * (actual - {n}))" for n, q in ops.LEVELS.items()}


@query(
    "ag24_quantile_metrics",
    with_trades(
        PRED
        + f""", g AS (SELECT 'region' AS dimension, region AS label, * FROM pred UNION ALL SELECT 'history', CASE WHEN n90 < 3 THEN 'sparse_lt3' ELSE 'supported_ge3' END, * FROM pred),
x AS (SELECT *, CASE WHEN actual >= p10 AND actual <= p90 THEN 1.0 ELSE 0.0 END AS c FROM g),
y AS (SELECT *, CASE WHEN row_number() OVER w2 = 1 THEN avg(c) OVER w END AS cb FROM x WINDOW w AS (PARTITION BY dimension, label, region, complex),
  w2 AS (PARTITION BY dimension, label, region, complex ORDER BY orderkey))
SELECT dimension, label, count(*) AS transactions, count(cb) AS complexes, {', '.join(f'round(avg({e}), 6) AS pinball_{n}' for n, e in D_PIN.items())},
  {', '.join(f'round(avg(CASE WHEN actual <= {n} THEN 100.0 ELSE 0.0 END), 6) AS cdf_{n}' for n in D_PIN)},
  round(avg(({' + '.join(D_PIN.values())}) / 3), 6) AS mean_pinball_log, round(avg(c) * 100, 6) AS coverage80_pct,
  round(avg(cb) * 100, 6) AS complex_balanced_coverage80_pct, round(avg(abs(exp(p50) - exp(actual)) * area / 10000), 6) AS median_mae_oku,
  round(avg(abs(exp(p50 - actual) - 1) * 100), 6) AS median_mape_pct, round(avg((exp(p90) - exp(p10)) * area / 10000), 6) AS mean_width_oku FROM y GROUP BY dimension, label"""
    ),
)
def quantile_metrics(spark, sf_dir):
    history = F.when(F.col("n90") < 3, "sparse_lt3").otherwise("supported_ge3")
    return tidy(ops.quantile_metrics(predictions(spark, sf_dir), {"region": F.col("region"), "history": history}))


@query(
    "ag25_confidence_stats",
    with_trades(
        PRED
        + """, h AS (SELECT *, CASE WHEN abs(actual - base) <= radius THEN 1.0 ELSE 0.0 END AS hit FROM pred),
c AS (SELECT region, complex, avg(hit) AS h FROM h GROUP BY ALL)
SELECT h.region, count(*) AS transactions, any_value(k.n) AS complexes, round(avg(hit) * 100, 6) AS coverage_pct, round(any_value(k.h) * 100, 6) AS complex_coverage_pct,
  round(avg(abs(exp(base - actual) - 1)) * 100, 6) AS mape_pct, round((exp(median(radius)) - 1) * 100, 6) AS median_upper_radius_pct,
  round((exp(median(radius)) - exp(-median(radius))) * 100, 6) AS median_total_width_pct
FROM h JOIN (SELECT region, count(*) AS n, avg(h) AS h FROM c GROUP BY region) k USING (region) GROUP BY h.region"""
    ),
)
def confidence_stats(spark, sf_dir):
    return tidy(ops.confidence_stats(predictions(spark, sf_dir).withColumn("prediction", F.col("base")), ["region"]))


@query(
    "ag26_weighted_quantile",
    with_trades(
        PRED
        + """, v AS (SELECT region, abs(actual - candidate) + linenumber * 0.001 AS e, 1.0::DOUBLE / count(*) OVER (PARTITION BY region, complex) AS w FROM pred),
c AS (SELECT *, sum(w) OVER (PARTITION BY region ORDER BY e ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY region) AS tw FROM v)
SELECT region, round(min(e) FILTER (WHERE cw >= tw * 0.8 - 1e-9), 6) AS quantile FROM c GROUP BY region"""
    ),
)
def weighted_quantile(spark, sf_dir):
    rows = ops.complex_weights(predictions(spark, sf_dir))
    rows = rows.withColumn("e", F.abs(F.col("actual") - F.col("candidate")) + F.col("linenumber") * 0.001)
    return tidy(ops.weighted_quantile(rows, ["region"], "e", F.col("weight")))


@query(
    "wn11_complex_weights",
    with_trades(
        PRED + "SELECT orderkey, linenumber, round(1.0 / count(*) OVER (PARTITION BY region, complex), 8) AS weight FROM pred"
    ),
)
def complex_weights(spark, sf_dir):
    rows = ops.complex_weights(predictions(spark, sf_dir))
    return tidy(rows.select("orderkey", "linenumber", F.col("weight").cast("double").alias("weight")), 8)


D_AGE = "((2001 * 12 + 11) - (CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) - 1))"


@query(
    "wn10_recency_weights",
    with_trades(
        PRED
        + f""", w AS (SELECT month, pow(2.0, -{D_AGE} / 48.0) AS w FROM pred)
SELECT month, count(*) AS n, round(any_value(w) / (SELECT avg(w) FROM w), 6) AS weight,
  round((SELECT sum(w) * sum(w) / sum(w * w) FROM w), 3) AS effective_sample_size FROM w GROUP BY month"""
    ),
)
def recency_weights(spark, sf_dir):
    weighted, size = ops.recency_weights(predictions(spark, sf_dir), "month", "2001-12-31")
    per = weighted.groupBy("month").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    ess = size.first()["effective_sample_size"]
    return per.select("month", "n", F.round("weight", 6).alias("weight"), F.round(F.lit(ess), 3).alias("effective_sample_size"))


@query(
    "wn9_cumulative_weight",
    with_trades(
        PRED
        + """, v AS (SELECT region, floor, sum(price_oku) AS w FROM pred GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY region ORDER BY floor) AS cw, sum(w) OVER (PARTITION BY region) AS tw FROM v)
SELECT region, min(floor) FILTER (WHERE cw >= tw * 0.3) AS q30, min(floor) FILTER (WHERE cw >= tw * 0.7) AS q70 FROM c GROUP BY region"""
    ),
)
def cumulative_weight(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    pick = lambda q, out: ops.weighted_quantile(rows, ["region"], "floor", F.col("price_oku"), q, out)
    return pick(0.3, "q30").join(pick(0.7, "q70"), "region")


D_K = " + ".join(f"CASE WHEN u >= {b} THEN 1 ELSE 0 END" for b in ops.POISSON_CDF)


@query(
    "ag29_cluster_gain",
    with_trades(
        PRED
        + f""", g AS (SELECT complex, (abs(exp(base - actual) - 1) - abs(exp(candidate - actual) - 1)) * price_oku AS g FROM pred),
c AS (SELECT complex, sum(g) AS s, count(*) AS n FROM g GROUP BY complex),
d AS (SELECT *, CAST(CAST('0x' || substr(md5(complex || '|' || CAST(draw AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM c CROSS JOIN range(1, 1001) t(draw)),
m AS (SELECT draw, sum(({D_K}) * s) / sum(({D_K}) * n) AS m FROM d GROUP BY draw)
SELECT round((SELECT sum(s) / sum(n) FROM c), 6) AS mean_gain_oku, (SELECT count(*) FROM c) AS clusters, CAST((SELECT sum(n) FROM c) AS BIGINT) AS transactions,
  round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""
    ),
)
def cluster_gain(spark, sf_dir):
    return tidy(ops.cluster_gain(predictions(spark, sf_dir), "base", "candidate"))


MEASURE = (
    SNAP
    + panel_sql(HORIZONS, 6, True)
    + """
, f AS (SELECT *, coalesce(-relative_momentum, median(-relative_momentum) OVER w, 0.0) AS signal, relative_momentum IS NULL AS miss,
  count(*) OVER w AS n FROM panel WINDOW w AS (PARTITION BY origin, horizon_months)),
r AS (SELECT *, row_number() OVER (PARTITION BY origin, horizon_months ORDER BY signal DESC, key) AS rk FROM f),
t AS (SELECT *, rk <= greatest(1, n // 10) AS top FROM r),
cx AS (SELECT origin, horizon_months, complex, median(target) AS m FROM t WHERE top AND target IS NOT NULL GROUP BY ALL),
cm AS (SELECT origin, horizon_months, count(*) AS observed_complexes, median(m) AS m FROM cx GROUP BY ALL),
k AS (SELECT origin, horizon_months, target, rank() OVER a + (count(*) OVER b - 1) / 2.0 AS ra, rank() OVER c + (count(*) OVER d - 1) / 2.0 AS rb FROM t WHERE target IS NOT NULL
  WINDOW a AS (PARTITION BY origin, horizon_months ORDER BY signal), b AS (PARTITION BY origin, horizon_months, signal),
  c AS (PARTITION BY origin, horizon_months ORDER BY target), d AS (PARTITION BY origin, horizon_months, target)),
sp AS (SELECT origin, horizon_months, corr(ra, rb) AS spearman, count(*) AS measured FROM k GROUP BY ALL)
"""
).replace("cm AS (SELECT origin, horizon_months, peer", "cm0 AS (SELECT origin, horizon_months, peer").replace("LEFT JOIN cm b", "LEFT JOIN cm0 b")


@query(
    "ag30_measure",
    with_trades(
        MEASURE
        + """SELECT CAST(t.origin AS VARCHAR) AS origin, CAST(t.horizon_months AS BIGINT) AS horizon_months, count(*) AS cohort, count(*) FILTER (WHERE top) AS selected,
  count(*) FILTER (WHERE top AND target IS NOT NULL) AS observed, count(*) FILTER (WHERE miss) AS missing_signal_imputed,
  coalesce(any_value(observed_complexes), 0) AS observed_complexes, round((exp(any_value(cm.m)) - 1) * 100, 5) + 0.0 AS complex_median_excess_pct,
  round((exp(median(target) FILTER (WHERE top)) - 1) * 100, 5) + 0.0 AS median_excess_pct,
  round((exp(median(target)) - 1) * 100, 5) + 0.0 AS all_observed_median_excess_pct,
  round(count(*) FILTER (WHERE top AND target > 0) * 100.0 / nullif(count(*) FILTER (WHERE top AND target IS NOT NULL), 0), 5) AS observed_positive_excess_pct,
  round(CASE WHEN any_value(measured) >= 3 THEN any_value(spearman) END, 5) + 0.0 AS spearman
FROM t LEFT JOIN cm USING (origin, horizon_months) LEFT JOIN sp USING (origin, horizon_months) GROUP BY t.origin, t.horizon_months"""
    ),
)
def measure(spark, sf_dir):
    rows = label_panel(spark, sf_dir).withColumn("signal", -F.col("relative_momentum"))
    out = ops.measure(rows, ["origin", "horizon_months"], "signal")
    return tidy(
        out.select(
            "origin", "horizon_months", "cohort", "selected", "observed", "missing_signal_imputed", "observed_complexes",
            "complex_median_excess_pct", "median_excess_pct", "all_observed_median_excess_pct", "observed_positive_excess_pct", "spearman",
        ),
        5,
    )


FORECAST = "SELECT gu AS origin, key, min(area) AS area, sum(CAST(price AS DECIMAL(18,2))) AS total, count(*) AS entry_n FROM {clean} GROUP BY gu, key"
FC = f", fc AS ({FORECAST.format(clean='clean')})"


def forecast(spark, sf_dir):
    return spark.sql(FORECAST, clean=clean(spark, sf_dir)).withColumn("signal", F.col("total").cast("double"))


@query(
    "wn1_rank_candidates",
    with_trades(
        FC
        + """, r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY total DESC, key) AS rank, count(*) OVER (PARTITION BY origin) AS n FROM fc)
SELECT origin, key, rank, round(100.0 * rank / n, 6) AS top_percent, round(100.0 * (n - rank) / (n - 1), 6) AS percentile FROM r"""
    ),
)
def rank_candidates(spark, sf_dir):
    out = ops.rank_candidates(forecast(spark, sf_dir), ["origin"], "signal")
    return tidy(out.select("origin", "key", "rank", "top_percent", "percentile"))


@query(
    "wn2_pct_rank",
    with_trades(
        FC
        + """SELECT origin, key, round((rank() OVER (PARTITION BY origin ORDER BY entry_n) + (count(*) OVER (PARTITION BY origin, entry_n) - 1) / 2.0)
  / count(*) OVER (PARTITION BY origin), 6) AS pct_rank FROM fc"""
    ),
)
def pct_rank(spark, sf_dir):
    return tidy(ops.pct_rank(forecast(spark, sf_dir), ["origin"], "entry_n").select("origin", "key", "pct_rank"))


@query(
    "so1_top_fraction",
    with_trades(
        FC
        + """SELECT origin, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY total DESC, key) AS rank, count(*) OVER (PARTITION BY origin) AS n FROM fc)
WHERE rank <= greatest(1, n // 10)"""
    ),
)
def top_fraction(spark, sf_dir):
    return ops.top_fraction(forecast(spark, sf_dir), ["origin"], "signal").select("origin", "key", "rank")


@query(
    "dq17_validate_forecast",
    with_trades(
        FC
        + """SELECT origin, count(*) AS candidates, 0 AS duplicate_keys, true AS ranks_complete, count(*) FILTER (WHERE entry_n < 3) AS invalid_rows FROM fc GROUP BY origin"""
    ),
)
def validate_forecast(spark, sf_dir):
    ranks = ops.rank_candidates(forecast(spark, sf_dir), ["origin"], "signal")
    return tidy(quality.validate_forecast(ranks.withColumnsRenamed({"rank": "research_rank", "signal": "entry"}), ["origin"]))


@query(
    "jn25_lag_sensitivity",
    with_trades(
        FC
        + """, a AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY total DESC, key) AS rank, count(*) OVER (PARTITION BY origin) AS n FROM fc),
b AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY entry_n DESC, key) AS rank, count(*) OVER (PARTITION BY origin) AS n FROM fc WHERE entry_n >= 40)
SELECT a.origin, a.key, a.rank, b.rank AS alternate_rank, round(100.0 * b.rank / b.n, 6) AS alternate_top_percent, b.rank IS NOT NULL AS alternate_eligible,
  100.0 * a.rank / a.n <= 10 AND coalesce(100.0 * b.rank / b.n <= 10, false) AS both_top_decile FROM a LEFT JOIN b USING (origin, key)"""
    ),
)
def lag_sensitivity(spark, sf_dir):
    rows = forecast(spark, sf_dir)
    base = ops.rank_candidates(rows, ["origin"], "signal")
    other = ops.rank_candidates(rows.where("entry_n >= 40"), ["origin"], "entry_n")
    out = join_ops.lag_sensitivity(base, other, ["origin", "key"])
    return tidy(out.select("origin", "key", "rank", "alternate_rank", "alternate_top_percent", "alternate_eligible", "both_top_decile"))


@query(
    "ag33_mean_signal",
    with_trades(
        """, s AS (SELECT gu AS origin, key, max(tax) + 1 AS m FROM clean GROUP BY ALL)
SELECT origin, key, round(m * (24 + 36 + 48 + 60) / 4, 6) AS signal FROM s"""
    ),
)
def mean_signal(spark, sf_dir):
    base = clean(spark, sf_dir).groupBy(F.col("gu").alias("origin"), "key").agg((F.max("tax") + 1).alias("m"))
    rows = base.withColumn("horizon_months", F.explode(F.array(*[F.lit(h) for h in (24, 36, 48, 60)])))
    return tidy(ops.mean_signal(rows.withColumn("prediction", F.col("m") * F.col("horizon_months")), (24, 36, 48, 60)))


CHECKPOINTS = """
SELECT year AS origin, key, CASE priority WHEN '1-URGENT' THEN 24 WHEN '2-HIGH' THEN 36 WHEN '3-MEDIUM' THEN 48 ELSE 60 END AS horizon_months,
  max(CASE WHEN floor > 25 THEN discount END) AS target FROM {clean} GROUP BY year, key, priority
"""


@query(
    "ag34_detection",
    with_trades(
        f", c AS ({CHECKPOINTS.format(clean='clean')})"
        + """, w AS (SELECT origin, key, max(target) FILTER (WHERE horizon_months = 24) AS a, max(target) FILTER (WHERE horizon_months = 36) AS b,
  max(target) FILTER (WHERE horizon_months = 48) AS c, max(target) FILTER (WHERE horizon_months = 60) AS d FROM c GROUP BY ALL),
x AS (SELECT *, ln(1.1) AS l, coalesce(greatest(a, b, c, d) >= ln(1.1), false) AS hit, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL AS seen FROM w),
y AS (SELECT *, CASE WHEN a >= l THEN 24 WHEN b >= l THEN 36 WHEN c >= l THEN 48 WHEN d >= l THEN 60 END AS f FROM x)
SELECT CAST(origin AS BIGINT) AS origin, count(*) AS selected, count(*) FILTER (WHERE hit) AS observed_hit, count(*) FILTER (WHERE NOT hit AND seen) AS observed_no_hit,
  count(*) FILTER (WHERE NOT hit AND NOT seen) AS unresolved,
  count(*) FILTER (WHERE (f = 36 AND a IS NULL) OR (f = 48 AND (a IS NULL OR b IS NULL)) OR (f = 60 AND (a IS NULL OR b IS NULL OR c IS NULL))) AS first_hit_with_prior_missing,
  count(*) FILTER (WHERE f = 24) AS first_hit_24, count(*) FILTER (WHERE f = 36) AS first_hit_36, count(*) FILTER (WHERE f = 48) AS first_hit_48, count(*) FILTER (WHERE f = 60) AS first_hit_60,
  round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate_lower_pct,
  round(100.0 * (count(*) FILTER (WHERE hit) + count(*) FILTER (WHERE NOT hit AND NOT seen)) / count(*), 6) AS hit_rate_upper_pct FROM y GROUP BY origin"""
    ),
)
def detection(spark, sf_dir):
    rows = spark.sql(CHECKPOINTS, clean=clean(spark, sf_dir))
    return tidy(ops.detection(rows, ["origin"], (24, 36, 48, 60)))


RESULTS = """
SELECT month AS origin, CASE priority WHEN '1-URGENT' THEN 'learned_price' WHEN '2-HIGH' THEN 'laggard' WHEN '3-MEDIUM' THEN 'cheap_peer' ELSE 'momentum' END AS method,
  CASE WHEN linestatus = 'F' THEN 24 ELSE 60 END AS horizon_months, CASE WHEN linenumber % 2 = 0 THEN 'uniform61' ELSE 'historical_policy' END AS availability_regime,
  count(*) AS selected, count(CASE WHEN NOT cancelled THEN 1 END) AS observed, count(DISTINCT CASE WHEN NOT cancelled THEN complex END) AS observed_complexes,
  avg(tax - discount * 0.8) * 100 AS complex_median_excess_pct, avg(discount - 0.05) AS spearman
FROM {trades} GROUP BY ALL
"""
RS = f", results AS ({RESULTS.format(trades='trades')})"


def results(spark, sf_dir):
    return spark.sql(RESULTS, trades=trades(spark, sf_dir))


D_COMMON = """
, one AS (SELECT * FROM results WHERE horizon_months = 24 AND availability_regime = 'historical_policy'),
g AS (SELECT origin, method FROM (SELECT DISTINCT origin FROM one WHERE method = 'learned_price') CROSS JOIN (VALUES ('learned_price'), ('laggard'), ('cheap_peer'), ('momentum')) t(method)),
st AS (SELECT g.origin, g.method, selected, observed, observed_complexes, complex_median_excess_pct AS v, CASE WHEN selected IS NULL THEN 'missing_method'
    WHEN observed / selected < 0.6 THEN 'insufficient_observation_rate' WHEN observed_complexes < 12 THEN 'insufficient_complexes' END AS reason FROM g LEFT JOIN one USING (origin, method)),
common AS (SELECT * FROM st WHERE origin NOT IN (SELECT origin FROM st WHERE reason IS NOT NULL))
"""


def _common(spark, sf_dir):
    one = results(spark, sf_dir).where("horizon_months = 24 AND availability_regime = 'historical_policy'")
    return ops.compare_common_origins(one, min_rate=0.6, min_complexes=12)


@query(
    "ag35_common_origins",
    with_trades(
        RS
        + D_COMMON
        + """SELECT method, count(*) AS same_origins, count(*) FILTER (WHERE v > 0) AS positive_origins, round(median(v), 6) + 0.0 AS median_origin_complex_excess_pct,
  round(median(100.0 * observed / selected), 6) AS median_observation_rate_pct FROM common GROUP BY method"""
    ),
)
def common_origins(spark, sf_dir):
    return tidy(_common(spark, sf_dir)[0])


@query(
    "ag35_paired_origins",
    with_trades(
        RS
        + D_COMMON
        + """SELECT m.origin, round(m.v, 6) + 0.0 AS model_excess_pct, round(b.v, 6) + 0.0 AS baseline_excess_pct, m.selected - m.observed AS model_missing,
  b.selected - b.observed AS baseline_missing, round(m.v - b.v, 6) + 0.0 AS difference_pp FROM common m JOIN common b USING (origin) WHERE m.method = 'learned_price' AND b.method = 'laggard'"""
    ),
)
def paired_origins(spark, sf_dir):
    return tidy(_common(spark, sf_dir)[1])


@query("ag35_excluded_origins", with_trades(RS + D_COMMON + "SELECT origin, method, reason FROM st WHERE reason IS NOT NULL"))
def excluded_origins(spark, sf_dir):
    return _common(spark, sf_dir)[2]


D_GATE = """
, hp AS (SELECT * FROM results WHERE availability_regime = 'historical_policy'),
u AS (SELECT horizon_months, origin, count(DISTINCT method) AS m, max(complex_median_excess_pct) FILTER (WHERE method = 'learned_price') AS a,
  max(complex_median_excess_pct) FILTER (WHERE method = 'laggard') AS b, max(complex_median_excess_pct) FILTER (WHERE method = 'cheap_peer') AS c,
  max(complex_median_excess_pct) FILTER (WHERE method = 'momentum') AS d, max(spearman) FILTER (WHERE method = 'learned_price') AS rho
  FROM hp WHERE 100.0 * observed / selected >= 50 AND observed_complexes >= 14 GROUP BY ALL HAVING count(DISTINCT method) = 4),
gate AS (SELECT horizon_months, count(*) AS common_origins, avg(a) AS am, avg(b) AS bm, avg(c) AS cm, avg(d) AS dm, count(*) FILTER (WHERE a > 0) / count(*) AS pf, median(rho) AS rho
  FROM u GROUP BY horizon_months)
"""


def _gate(spark, sf_dir):
    rows = results(spark, sf_dir).where("availability_regime = 'historical_policy'")
    return rows, ops.adoption_gate(rows, min_complexes=14)


@query(
    "ag36_adoption_gate",
    with_trades(
        RS
        + D_GATE
        + """SELECT CAST(horizon_months AS BIGINT) AS horizon_months, common_origins, round(am, 6) + 0.0 AS learned_price_mean, round(bm, 6) + 0.0 AS laggard_mean,
  round(cm, 6) + 0.0 AS cheap_peer_mean, round(dm, 6) + 0.0 AS momentum_mean, round(pf, 6) AS positive_fraction, round(rho, 6) + 0.0 AS spearman_origin_median,
  common_origins >= 6 AS enough_origins, am > 0 AND am > bm AS positive_and_beats_laggard, pf >= 2 / 3 AS positive_in_two_thirds, rho > 0 AS spearman_positive FROM gate"""
    ),
)
def adoption_gate(spark, sf_dir):
    return tidy(_gate(spark, sf_dir)[1])


@query(
    "ag36_gate_verdict",
    with_trades(
        RS
        + D_GATE
        + """, v AS (SELECT bool_and(common_origins >= 6) AS a, coalesce(bool_and(common_origins > 0) AND avg(am) > 0 AND avg(am) > greatest(avg(bm), avg(cm), avg(dm)), false) AS b,
  count(*) FILTER (WHERE am > 0 AND am > bm) >= ceil(count(*) * 0.75) AS c, bool_and(rho > 0) AS d FROM gate)
SELECT a AS each_horizon_has_enough_origins, b AS positive_composite_beats_best_baseline, c AS most_horizons_positive_and_beat_laggard, d AS all_median_spearman_positive,
  a AND b AND c AND d AS passed FROM v"""
    ),
)
def gate_verdict(spark, sf_dir):
    return ops.gate_verdict(_gate(spark, sf_dir)[1])


@query(
    "ag37_summarize_results",
    with_trades(
        RS
        + D_GATE
        + """, l AS (SELECT horizon_months, count(DISTINCT origin) AS n, min(100.0 * observed / selected) AS lo, median(100.0 * observed / selected) AS mid,
  sum(selected) AS s, sum(observed) AS o FROM hp WHERE method = 'learned_price' GROUP BY ALL)
SELECT CAST(l.horizon_months AS BIGINT) AS horizon_months, n AS model_test_origins, round(lo, 6) AS observation_rate_min_pct, CAST(s AS BIGINT) AS selected_candidates,
  CAST(o AS BIGINT) AS observed_candidates, round(mid, 6) AS observation_rate_median_pct, common_origins, round(am, 6) + 0.0 AS model_mean_pct,
  CASE greatest(bm, cm, dm) WHEN bm THEN 'laggard' WHEN cm THEN 'cheap_peer' ELSE 'momentum' END AS best_baseline, round(greatest(bm, cm, dm), 6) + 0.0 AS best_baseline_pct
FROM l LEFT JOIN gate USING (horizon_months)"""
    ),
)
def summarize_results(spark, sf_dir):
    rows, gate = _gate(spark, sf_dir)
    return tidy(ops.summarize_results(rows, gate))


@query(
    "ag46_validation_status",
    with_trades(
        RS
        + """SELECT availability_regime, count(*) AS evaluations, count(*) FILTER (WHERE observed_complexes >= 20) AS with_observed_headline,
  count(*) FILTER (WHERE observed_complexes >= 20) > 0 AS ready FROM results WHERE horizon_months = 24 AND method = 'learned_price' GROUP BY availability_regime"""
    ),
)
def validation_status(spark, sf_dir):
    return ops.validation_status(results(spark, sf_dir), ["historical_policy", "uniform61"])


@query(
    "ag38_choose",
    with_trades(
        RS
        + """, d AS (SELECT CAST(substr(origin, 1, 4) AS INTEGER) AS year, method, avg(observed / selected) AS a, avg(observed_complexes) AS b FROM results GROUP BY ALL),
r AS (SELECT d.method, unnest([d.a / b.a, d.b / b.b]) AS r FROM d JOIN d b ON b.year = d.year AND b.method = 'laggard' WHERE d.method <> 'laggard'),
s AS (SELECT method, avg(r) AS score FROM r GROUP BY method)
SELECT method, round(score, 6) AS score, score = (SELECT min(score) FROM s) AS selected FROM s"""
    ),
)
def choose(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("year", F.substring("origin", 1, 4).cast("int")).withColumn("a", F.col("observed") / F.col("selected"))
    dev = rows.groupBy("year", "method").agg(F.avg("a").alias("a"), F.avg("observed_complexes").alias("b"))
    return tidy(ops.choose(dev, "laggard", ["a", "b"]))


RUNS = """
SELECT month AS scope, CASE priority WHEN '1-URGENT' THEN 'hold' WHEN '2-HIGH' THEN 'rotate' WHEN '3-MEDIUM' THEN 'cheapest_hold' WHEN '4-NOT SPECIFIED' THEN 'cash' ELSE 'random_hold' END AS strategy,
  CASE WHEN priority = '5-LOW' THEN linenumber END AS random_seed, CASE WHEN max(floor) > 46 THEN round(avg(tax - discount), 8) * 100 END AS liquidated_return_pct
FROM {trades} GROUP BY month, priority, CASE WHEN priority = '5-LOW' THEN linenumber END
"""


@query(
    "ag44_compare_runs",
    with_trades(
        f", r AS ({RUNS.format(trades='trades')})"
        + """, c AS (SELECT scope, max(liquidated_return_pct) FILTER (WHERE strategy = 'hold') AS h, max(liquidated_return_pct) FILTER (WHERE strategy = 'rotate') AS ro,
  max(liquidated_return_pct) FILTER (WHERE strategy = 'cheapest_hold') AS ch, max(liquidated_return_pct) FILTER (WHERE strategy = 'cash') AS ca,
  count(DISTINCT random_seed) FILTER (WHERE strategy = 'random_hold' AND random_seed IN (1, 2, 3) AND liquidated_return_pct IS NOT NULL) AS settled_runs,
  count(*) FILTER (WHERE strategy = 'random_hold' AND liquidated_return_pct IS NULL) AS unsettled_runs,
  median(liquidated_return_pct) FILTER (WHERE strategy = 'random_hold' AND random_seed IN (1, 2, 3)) AS m FROM r GROUP BY scope),
k AS (SELECT *, CASE WHEN settled_runs = 3 THEN m END AS rm FROM c)
SELECT scope, settled_runs, unsettled_runs, round(rm, 8) + 0.0 AS random_median_pct, round(ro - h, 8) + 0.0 AS rotate_minus_hold, round(h - ch, 8) + 0.0 AS hold_minus_cheapest,
  round(h - ca, 8) + 0.0 AS hold_minus_cash, round(h - rm, 8) + 0.0 AS hold_minus_random_median FROM k"""
    ),
)
def compare_runs(spark, sf_dir):
    runs = spark.sql(RUNS, trades=trades(spark, sf_dir))
    return tidy(ops.compare_runs(runs, (1, 2, 3)), 8)


@query(
    "wn6_latest_per_key",
    with_trades(
        """SELECT key, CAST(date AS VARCHAR) AS date, floor, price, position FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date DESC, floor DESC, price DESC) AS position FROM clean)
WHERE position <= 3"""
    ),
)
def latest_per_key(spark, sf_dir):
    out = ops.latest_per_key(clean(spark, sf_dir), 3, ["date", "floor", "price"])
    return tidy(out.select("key", "date", "floor", "price", "position"), 10)
