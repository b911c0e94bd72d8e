"""Scoring, error, coverage and ranking evaluation, and the gates built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import calendar as cal
from pricetide.functions import scores
from pricetide.functions.parsing import present
from pricetide.operators.stats import Quantile, WEIGHT, average_rank, median, quantiles, ranked_within

LEVELS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


# --- Valuation ---------------------------------------------------------------


def recent_comparison(trades: DataFrame, month: str, days: int = 90) -> DataFrame:
    """Per key: count and median price over the last ``days`` calendar days, both ends in.

    The window ends at the last observed contract, capped at the month's end.
    Keys without a recent trade are simply absent; nothing stands in for them.
    """
    month_end = F.last_day(cal.as_date(f"{month}-01"))
    end = trades.where(F.col("date") <= month_end).agg(F.max("date").alias("end")).first()["end"]
    if end is None:
        raise ValueError("nothing was traded up to the end of the month")
    last = F.lit(end)
    window = trades.where(F.col("date").between(F.date_sub(last, days - 1), last))
    plain = window.groupBy("key").agg(F.min("date").alias("first_contract_date"), F.max("date").alias("last_contract_date"))
    mids = median(window, ["key"], "price_oku", "_m").withColumnRenamed("n", "trade_count")
    return (
        mids.join(plain, "key")
        .withColumn("median_price_billion", scores.canonical_price(F.col("_m")))
        .withColumn("window_start", F.date_sub(last, days - 1))
        .withColumn("window_end", last)
        .drop("_m")
    )


def transaction_replay(features: DataFrame, neutral: Column, price: Column, scale: float, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(medians per key and month, latest ``n`` scored contracts per key).

    Needs key, month, contract_date, floor and n90.  Only rows with a positive
    neutral and observed price are valued.  Medians stay unrounded; whole 만원
    are applied where results are exported.
    """
    rows = scores.with_score(features, neutral, price, F.lit(scale)).where("score IS NOT NULL")
    what = {"median_score": "score", "median_discount_pct": "discount_pct", "median_price_billion": "price",
            "median_neutral_price_billion": "neutral", "recent_history_median_count": "n90"}
    pairs = F.array(*[F.struct(F.lit(k).alias("what"), F.col(c).cast("double").alias("v")) for k, c in what.items()])
    mids = median(rows.select("key", "month", F.inline(pairs)), ["key", "month", "what"], "v", "m")
    monthly = mids.groupBy("key", "month").agg(
        F.max("n").alias("trade_count"), *[F.max(F.when(F.col("what") == k, F.col("m"))).alias(k) for k in what]
    )
    return monthly, latest_per_key(rows, n, ["contract_date", "floor", "price"])


def latest_per_key(df: DataFrame, n: int, order: Sequence[str], key: str = "key", out: str = "position") -> DataFrame:
    """Latest ``n`` rows per key, all order columns descending.

    Spark applies the row-number limit before the shuffle as well, so a hot
    key sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def current_comparisons(valuations: DataFrame, recent: DataFrame, minimum: int = 3) -> DataFrame:
    """Score of the current valuation against the recent median, with status and evidence level.

    ``valuations``: key, region_code, status, price_billion, score_error_scale,
    recent_trade_count.  Order rows by the columns of :func:`comparison_order`.
    """
    right = recent.select("key", F.col("trade_count").alias("comparison_trade_count"), F.col("median_price_billion").alias("_recent"))
    joined = scores.with_score(
        valuations.join(right, "key", "left"), F.col("price_billion"), F.col("_recent"), F.col("score_error_scale")
    )
    available = (F.col("status") == "available") & F.col("score").isNotNull()
    status = (
        F.when(F.col("status") != "available", F.col("status"))
        .when(F.col("_recent").isNull(), "no_recent_transactions")
        .when(F.col("score").isNull(), "insufficient_history")
        .otherwise("available")
    )
    enough = (F.col("recent_trade_count") >= minimum) & (F.col("comparison_trade_count") >= minimum)
    level = F.when(F.coalesce(enough, F.lit(False)), "recent_evidence").otherwise("sparse_history")
    return joined.withColumns(
        {
            "comparison_status": status,
            "score": F.when(available, F.col("score")),
            "discount_pct": F.when(available, F.col("discount_pct")),
            "evidence_level": F.when(available, level),
        }
    ).drop("_recent")


def comparison_order() -> list[Column]:
    return [
        (F.col("comparison_status") != "available").asc(), F.col("score").desc_nulls_last(), F.col("region_code").asc(), F.col("key").asc(),
    ]


# --- Errors and coverage -----------------------------------------------------


def metric(df: DataFrame, prediction: str, groups: Sequence[str] = (), actual: str = "actual", price: str = "price_oku") -> DataFrame:
    """MAPE, complex-balanced MAPE, median APE, MAE in 억, bias and share within 10 %."""
    groups = list(groups)
    error = F.expm1(F.col(prediction) - F.col(actual))
    rows = df.select(*groups, "complex", error.alias("_e"), F.abs(error).alias("_ape"), F.col(price).alias("_p"))
    per_complex = rows.groupBy(*groups, "complex").agg(
        F.count("*").alias("_n"),
        F.sum("_ape").alias("_ape"),
        F.sum(F.col("_ape") * F.col("_p")).alias("_mae"),
        F.sum("_e").alias("_bias"),
        F.count_if(F.col("_ape") <= 0.1).alias("_near"),
    )
    n = F.sum("_n")
    totals = per_complex.groupBy(*groups).agg(
        n.alias("transactions"),
        F.count("*").alias("complexes"),
        (F.sum("_ape") / n * 100).alias("mape_pct"),
        (F.avg(F.col("_ape") / F.col("_n")) * 100).alias("complex_balanced_mape_pct"),
        (F.sum("_mae") / n).alias("mae_oku"),
        (F.sum("_bias") / n * 100).alias("bias_pct"),
        (F.sum("_near") / n * 100).alias("within10_pct"),
    )
    if groups:
        mids = median(rows, groups, "_ape", "_m").drop("n")
        return totals.join(mids, groups).withColumn("median_ape_pct", F.col("_m") * 100).drop("_m")
    keyed = rows.withColumn("_g", F.lit(0))
    mids = median(keyed, ["_g"], "_ape", "_m").drop("n")
    return totals.withColumn("_g", F.lit(0)).join(mids, "_g").withColumn("median_ape_pct", F.col("_m") * 100).drop("_m", "_g")


def segment_rows(df: DataFrame, segments: Mapping[str, Column]) -> DataFrame:
    """Each row once per segment it belongs to; segments may overlap."""
    names = present(*[F.when(c, F.lit(name)) for name, c in segments.items()])
    return df.withColumn("segment", F.explode(names))


def segment_metrics(df: DataFrame, prediction: str, segments: Mapping[str, Column]) -> DataFrame:
    return metric(segment_rows(df, segments), prediction, ["segment"])


def quantile_metrics(df: DataFrame, groups: Mapping[str, Column]) -> DataFrame:
    """Pinball loss, CDF hits, 80 % coverage and width of log quantiles p10, p50, p90, long over ``groups``.

    Needs actual, area, region, complex.  ``groups`` maps a dimension to its
    label column; every row counts once per dimension.
    """
    labels = F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("label")) for d, c in groups.items()])
    covered = ((F.col("actual") >= F.col("p10")) & (F.col("actual") <= F.col("p90"))).cast("double")
    factor = F.col("area") / 10000
    loss = {f"pinball_{name}": F.greatest(q * (F.col("actual") - F.col(name)), (q - 1) * (F.col("actual") - F.col(name))) for name, q in LEVELS.items()}
    hits = {f"cdf_{name}": (F.col("actual") <= F.col(name)).cast("double") * 100 for name in LEVELS}
    amounts = {
        "mae": F.abs(F.exp("p50") - F.exp("actual")) * factor,
        "mape": F.abs(F.exp(F.col("p50") - F.col("actual")) - 1) * 100,
        "width": (F.exp("p90") - F.exp("p10")) * factor,
    }
    rows = df.select(F.inline(labels), "region", "complex", covered.alias("_c"), *[c.alias(n) for n, c in {**loss, **hits, **amounts}.items()])
    keys = ["dimension", "label"]
    names = [*loss, *hits, *amounts]
    per = rows.groupBy(*keys, "region", "complex").agg(
        F.count("*").alias("_n"), F.sum("_c").alias("_c"), *[F.sum(c).alias(c) for c in names]
    )
    n = F.sum("_n")
    mean = lambda c: F.sum(c) / n
    return per.groupBy(*keys).agg(
        n.alias("transactions"),
        F.count("*").alias("complexes"),
        *[mean(c).alias(c) for c in [*loss, *hits]],
        (sum((F.sum(c) for c in loss), F.lit(0.0)) / n / 3).alias("mean_pinball_log"),
        (mean("_c") * 100).alias("coverage80_pct"),
        (F.avg(F.col("_c") / F.col("_n")) * 100).alias("complex_balanced_coverage80_pct"),
        mean("mae").alias("median_mae_oku"),
        mean("mape").alias("median_mape_pct"),
        mean("width").alias("mean_width_oku"),
    )


def complex_weights(df: DataFrame, keys: Sequence[str] = ("region", "complex"), out: str = "weight") -> DataFrame:
    """1 / rows of the complex, so every complex weighs the same; a decimal of 24 places."""
    sizes = df.groupBy(*keys).agg((F.lit(1).cast(WEIGHT) / F.count("*").cast("decimal(19,0)")).cast(WEIGHT).alias(out))
    return df.join(sizes, list(keys))


def recency_weights(df: DataFrame, month: str, through: str, half_life: float = 48.0) -> tuple[DataFrame, DataFrame]:
    """Weights ``2^(−age in months / 48)`` scaled to mean 1, and their effective sample size."""
    end = cal.as_date(through)
    age = cal.month_index(end) - cal.month_index(F.to_date(F.concat(month, F.lit("-01"))))
    raw = F.pow(F.lit(2.0), -age / half_life)
    # The weight depends on the month only, so the mean comes from month counts.
    totals = df.groupBy(month).agg(F.count("*").alias("_n")).withColumn("_w", raw).agg(
        (F.sum(F.col("_n") * F.col("_w")) / F.sum("_n")).alias("_mean"),
        F.sum(F.col("_n") * F.col("_w")).alias("_s"),
        F.sum(F.col("_n") * F.col("_w") * F.col("_w")).alias("_ss"),
        F.sum("_n").alias("rows"),
    )
    scale = totals.first()
    weighted = df.withColumn("weight", raw / F.lit(scale["_mean"]))
    return weighted, totals.select("rows", (F.col("_s") * F.col("_s") / F.col("_ss")).alias("effective_sample_size"))


def confidence_stats(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Coverage of |actual − prediction| ≤ radius by row and by complex, and typical band widths."""
    groups = list(groups)
    rows = df.withColumn("_hit", (F.abs(F.col("actual") - F.col("prediction")) <= F.col("radius")).cast("double"))
    per = rows.groupBy(*groups, "region", "complex").agg(
        F.count("*").alias("_n"), F.sum("_hit").alias("_h"),
        F.sum(F.abs(F.expm1(F.col("prediction") - F.col("actual")))).alias("_ape"),
    )
    totals = per.groupBy(*groups).agg(
        F.sum("_n").alias("transactions"),
        F.count("*").alias("complexes"),
        (F.sum("_h") / F.sum("_n") * 100).alias("coverage_pct"),
        (F.avg(F.col("_h") / F.col("_n")) * 100).alias("complex_coverage_pct"),
        (F.sum("_ape") / F.sum("_n") * 100).alias("mape_pct"),
    )
    mids = median(rows, groups, "radius", "_r").drop("n")
    return (
        totals.join(mids, groups)
        .withColumn("median_upper_radius_pct", F.expm1("_r") * 100)
        .withColumn("median_total_width_pct", (F.exp("_r") - F.exp(-F.col("_r"))) * 100)
        .drop("_r")
    )


def weighted_quantile(df: DataFrame, groups: Sequence[str], value: str, weight: Column, q: float = 0.8, out: str = "quantile") -> DataFrame:
    """First value whose cumulative weight reaches ``q`` of the group's total."""
    return quantiles(df, groups, value, {out: Quantile(q, "w", linear=False)}, {"w": weight}).select(*groups, out)


# Upper bounds of the Poisson(1) distribution function, k = 0..6 (fixed values).
POISSON_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def poisson_weight(cluster: Column, draw: Column) -> Column:
    """How often a cluster is drawn: Poisson(1) from a hash, identical wherever it is computed."""
    digest = F.md5(F.concat_ws("|", cluster.cast("string"), draw.cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum((F.when(u >= b, 1).otherwise(0) for b in POISSON_CDF), F.lit(0))


def cluster_gain(df: DataFrame, first: str, second: str, groups: Sequence[str] = (), draws: int = 1000, cluster: str = "complex",
                 price: str = "price_oku") -> DataFrame:
    """Mean error gain of ``second`` over ``first`` in 억 with a cluster-bootstrap 95 % interval.

    Whole complexes are resampled.  Rows are reduced to (sum, count) per
    complex before the draws are made.
    """
    groups = list(groups)
    ape = lambda c: F.abs(F.expm1(F.col(c) - F.col("actual")))
    rows = df.withColumn("_g", (ape(first) - ape(second)) * F.col(price))
    per = rows.groupBy(*groups, cluster).agg(F.sum("_g").alias("_s"), F.count("*").alias("_n"))
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn(
        "_k", poisson_weight(F.col(cluster), F.col("draw"))
    )
    means = drawn.groupBy(*groups, "draw").agg(F.try_divide(F.sum(F.col("_k") * F.col("_s")), F.sum(F.col("_k") * F.col("_n"))).alias("_m"))
    if not groups:
        means, per, groups = means.withColumn("_all", F.lit(0)), per.withColumn("_all", F.lit(0)), ["_all"]
    # At most ``draws`` values per group remain here.
    band = quantiles(means, groups, "_m", {"low": Quantile(0.025), "high": Quantile(0.975)}).select(*groups, "low", "high")
    mean = per.groupBy(*groups).agg(
        (F.sum("_s") / F.sum("_n")).alias("mean_gain_oku"), F.count("*").alias("clusters"), F.sum("_n").alias("transactions")
    )
    return mean.join(band, groups).drop("_all")


# --- Ranking -----------------------------------------------------------------


def filled_signal(df: DataFrame, scope: Sequence[str], signal: str) -> DataFrame:
    """A missing signal takes the cohort median, then 0; no candidate is dropped for it."""
    mids = median(df, list(scope), signal, "_m").drop("n")
    return df.join(mids, list(scope), "left").withColumn(signal, F.coalesce(signal, "_m", F.lit(0.0))).drop("_m")


def rank_candidates(df: DataFrame, scope: Sequence[str], signal: str, key: str = "key") -> DataFrame:
    """Rank by (signal desc, key asc) with top percent and percentile inside each cohort."""
    out = ranked_within(df, scope, [F.col(signal).desc(), F.col(key).asc()], "rank", "_n")
    n, r = F.col("_n"), F.col("rank")
    return out.withColumn("top_percent", 100 * r / n).withColumn("percentile", F.when(n > 1, 100 * (n - r) / (n - 1))).drop("_n")


def top_fraction(df: DataFrame, scope: Sequence[str], signal: str, fraction: float = 0.1, key: str = "key") -> DataFrame:
    """The best tenth of each cohort, at least one row."""
    out = ranked_within(df, scope, [F.col(signal).desc(), F.col(key).asc()], "rank", "_n")
    return out.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).drop("_n")


def measure(panel: DataFrame, scope: Sequence[str], signal: str) -> DataFrame:
    """Outcome of the top tenth of each cohort, selected before any outcome is looked at.

    Missing outcomes stay in the denominators.  Medians are over rows and over
    complexes; Spearman correlates average ranks of the observed rows.
    """
    scope = list(scope)
    missing = panel.groupBy(*scope).agg(F.count_if(F.col(signal).isNull()).alias("missing_signal_imputed"))
    rows = ranked_within(filled_signal(panel, scope, signal), scope, [F.col(signal).desc(), F.col("key").asc()], "rank", "_n")
    rows = rows.withColumn("_top", F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    known = F.col("target").isNotNull()
    counts = rows.groupBy(*scope).agg(
        F.count("*").alias("cohort"),
        F.count_if("_top").alias("selected"),
        F.count_if(F.col("_top") & known).alias("observed"),
        F.count_if(known).alias("_measured"),
        (F.try_divide(F.count_if(F.col("_top") & (F.col("target") > 0)), F.count_if(F.col("_top") & known)) * 100).alias(
            "observed_positive_excess_pct"
        ),
    )
    top = rows.where(F.col("_top") & known)
    per_complex = median(top, [*scope, "complex"], "target", "_t")
    as_pct = lambda c: (F.expm1(c) * 100)
    tables = [
        median(per_complex, scope, "_t", "_m").select(*scope, F.col("n").alias("observed_complexes"), as_pct("_m").alias("complex_median_excess_pct")),
        median(top, scope, "target", "_m").select(*scope, as_pct("_m").alias("median_excess_pct")),
        median(top, scope, "growth", "_m").select(*scope, as_pct("_m").alias("median_growth_pct")),
        median(rows, scope, "target", "_m").select(*scope, as_pct("_m").alias("all_observed_median_excess_pct")),
        spearman(rows.where(known), scope, signal, "target"),
    ]
    out = counts.join(missing, scope)
    for t in tables:
        out = out.join(t, scope, "left")
    return out.withColumns(
        {
            "observed_complexes": F.coalesce("observed_complexes", F.lit(0)),
            "missing_outcomes": F.col("selected") - F.col("observed"),
            "observation_rate_pct": 100 * F.col("observed") / F.col("selected"),
            "spearman": F.when(F.col("_measured") >= 3, F.col("spearman")),
        }
    ).drop("_measured")


def spearman(df: DataFrame, scope: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks inside each scope."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*scope, a, b)
    ranks = average_rank(average_rank(both, scope, a, "_ra"), scope, b, "_rb")
    return ranks.groupBy(*scope).agg(F.corr("_ra", "_rb").alias("spearman"))


def pct_rank(df: DataFrame, scope: Sequence[str], signal: str, out: str = "pct_rank") -> DataFrame:
    """Average rank of equal values divided by the number of ranked rows."""
    ranks = average_rank(df, scope, signal, "_r")
    return ranks.withColumn(out, F.col("_r") / F.col("_r_n")).drop("_r", "_r_n")


def mean_signal(df: DataFrame, horizons: Sequence[int], scope: Sequence[str] = ("origin",), message: str = "every candidate must have all fixed predictions") -> DataFrame:
    """Mean of the checkpoint predictions of each candidate; missing, duplicate or non-finite ones raise."""
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    stats = df.groupBy(*scope, "key").agg(
        F.count("*").alias("_n"),
        F.count_distinct("horizon_months").alias("_d"),
        F.count_if(finite & F.col("horizon_months").isin(*horizons)).alias("_ok"),
        F.avg("prediction").alias("_mean"),
    )
    n = len(horizons)
    good = (F.col("_n") == n) & (F.col("_d") == n) & (F.col("_ok") == n)
    return stats.select(*scope, "key", F.when(good, F.col("_mean")).otherwise(F.raise_error(F.lit(message)).cast("double")).alias("signal"))


def detection(rows: DataFrame, scope: Sequence[str], horizons: Sequence[int], threshold: float = 0.1) -> DataFrame:
    """First +10 % observation at fixed checkpoints, with bounds for unresolved candidates.

    Unknown outcomes are neither hits nor misses: the lower bound counts none
    of the unresolved candidates, the upper bound all of them.
    """
    level = F.log1p(F.lit(threshold))
    value = lambda h: F.max(F.when(F.col("horizon_months") == h, F.col("target"))).alias(f"_t{h}")
    wide = rows.groupBy(*scope, "key").agg(*[value(h) for h in horizons])
    hit = {h: F.coalesce(F.col(f"_t{h}") >= level, F.lit(False)) for h in horizons}
    seen = {h: F.col(f"_t{h}").isNotNull() for h in horizons}
    any_hit, all_seen = F.lit(False), F.lit(True)
    for h in horizons:
        any_hit, all_seen = any_hit | hit[h], all_seen & seen[h]
    first, gap = F.lit(None).cast("int"), F.lit(False)
    earlier = F.lit(True)
    chain, gaps = F, F
    for h in horizons:
        chain = chain.when(hit[h], h)
        gaps = gaps.when(hit[h], ~earlier)
        earlier = earlier & seen[h]
    wide = wide.withColumns({"_hit": any_hit, "_all": all_seen, "_first": chain.otherwise(first), "_gap": gaps.otherwise(gap)})
    n = F.count("*")
    unresolved = F.count_if(~F.col("_hit") & ~F.col("_all"))
    return wide.groupBy(*scope).agg(
        n.alias("selected"),
        F.count_if("_hit").alias("observed_hit"),
        F.count_if(~F.col("_hit") & F.col("_all")).alias("observed_no_hit"),
        unresolved.alias("unresolved"),
        F.count_if("_gap").alias("first_hit_with_prior_missing"),
        *[F.count_if(F.col("_first") == h).alias(f"first_hit_{h}") for h in horizons],
        (100 * F.count_if("_hit") / n).alias("hit_rate_lower_pct"),
        (100 * (F.count_if("_hit") + unresolved) / n).alias("hit_rate_upper_pct"),
    )


# --- Result tables -----------------------------------------------------------

METHODS = ("learned_price", "laggard", "cheap_peer", "momentum")


def _reason(min_rate: float, min_complexes: int) -> Column:
    rate = F.col("observed") / F.col("selected")
    return (
        F.when(F.col("selected").isNull(), "missing_method")
        .when((F.col("selected") == 0) | (rate < min_rate), "insufficient_observation_rate")
        .when(F.col("observed_complexes") < min_complexes, "insufficient_complexes")
        .when(F.col("complex_median_excess_pct").isNull() | F.isnan("complex_median_excess_pct"), "missing_complex_outcome")
    )


def origin_status(results: DataFrame, methods: Sequence[str] = METHODS, min_rate: float = 0.5, min_complexes: int = 20) -> DataFrame:
    """One row per (origin, method) of the origins where the model was evaluated, with an exclusion reason or null.

    A duplicated (origin, method) raises: compare one horizon and regime at a time.
    """
    grid = results.where(F.col("method") == methods[0]).select("origin").distinct()
    grid = grid.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    rows = results.groupBy("origin", "method").agg(
        F.count("*").alias("_n"),
        *[F.max(c).alias(c) for c in ("selected", "observed", "observed_complexes", "complex_median_excess_pct")],
    )
    rows = rows.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("duplicate origin/method")).cast("boolean")))
    return grid.join(rows.drop("_n"), ["origin", "method"], "left").withColumn("reason", _reason(min_rate, min_complexes))


def compare_common_origins(results: DataFrame, methods: Sequence[str] = METHODS, min_rate: float = 0.5,
                           min_complexes: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per method, paired model minus first baseline, excluded origins) over origins sufficient for every method."""
    status = origin_status(results, methods, min_rate, min_complexes)
    excluded = status.where(F.col("reason").isNotNull()).select("origin", "method", "reason")
    common = status.join(excluded.select("origin").distinct(), "origin", "left_anti")
    value = F.col("complex_median_excess_pct")
    per = common.groupBy("method").agg(F.count("*").alias("same_origins"), F.count_if(value > 0).alias("positive_origins"))
    for column, source in (("median_origin_complex_excess_pct", value), ("median_observation_rate_pct", 100 * F.col("observed") / F.col("selected"))):
        per = per.join(quantiles(common, ["method"], source, {column: Quantile(0.5)}).select("method", column), "method")
    model, baseline = methods[0], methods[1]
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    pairs = common.groupBy("origin").agg(
        pick(model, "complex_median_excess_pct").alias("model_excess_pct"),
        pick(baseline, "complex_median_excess_pct").alias("baseline_excess_pct"),
        (pick(model, "selected") - pick(model, "observed")).alias("model_missing"),
        (pick(baseline, "selected") - pick(baseline, "observed")).alias("baseline_missing"),
    )
    return per, pairs.withColumn("difference_pp", F.col("model_excess_pct") - F.col("baseline_excess_pct")), excluded


def adoption_gate(results: DataFrame, methods: Sequence[str] = METHODS, min_rate_pct: float = 50, min_complexes: int = 20,
                  min_origins: int = 6) -> DataFrame:
    """Per horizon: common origins, equal-origin means per method, median Spearman and the gate booleans."""
    rows = results.withColumn("_rate", 100 * F.col("observed") / F.col("selected"))
    enough = (F.col("_rate") >= min_rate_pct) & (F.col("observed_complexes") >= min_complexes)
    usable = rows.where(enough & F.col("method").isin(*methods)).groupBy("horizon_months", "origin").agg(
        F.count_distinct("method").alias("_m"),
        *[F.max(F.when(F.col("method") == m, F.col("complex_median_excess_pct"))).alias(m) for m in methods],
        F.max(F.when(F.col("method") == methods[0], F.col("spearman"))).alias("_rho"),
    ).where(F.col("_m") == len(methods))
    per = usable.groupBy("horizon_months").agg(
        F.count("*").alias("common_origins"),
        *[F.avg(m).alias(f"{m}_mean") for m in methods],
        (F.count_if(F.col(methods[0]) > 0) / F.count("*")).alias("positive_fraction"),
    )
    rho = median(usable, ["horizon_months"], "_rho", "spearman_origin_median").drop("n")
    horizons = results.select("horizon_months").distinct()
    out = horizons.join(per, "horizon_months", "left").join(rho, "horizon_months", "left").fillna(0, subset=["common_origins"])
    model, laggard = F.col(f"{methods[0]}_mean"), F.col(f"{methods[1]}_mean")
    truth = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns(
        {
            "enough_origins": F.col("common_origins") >= min_origins,
            "positive_and_beats_laggard": truth((model > 0) & (model > laggard)),
            "positive_in_two_thirds": truth(F.col("positive_fraction") >= 2 / 3),
            "spearman_positive": truth(F.col("spearman_origin_median") > 0),
        }
    )


def gate_verdict(gate: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """One row: every gate of the adoption rule and whether all passed."""
    composite = lambda m: F.avg(f"{m}_mean")
    complete = F.bool_and(F.col("common_origins") > 0)
    best = F.greatest(*[composite(m) for m in methods[1:]])
    checks = {
        "each_horizon_has_enough_origins": F.bool_and("enough_origins"),
        "positive_composite_beats_best_baseline": F.coalesce(complete & (composite(methods[0]) > 0) & (composite(methods[0]) > best), F.lit(False)),
        "most_horizons_positive_and_beat_laggard": F.count_if("positive_and_beats_laggard") >= F.ceil(F.count("*") * 0.75),
        "all_median_spearman_positive": F.bool_and("spearman_positive"),
    }
    out = gate.agg(*[c.alias(n) for n, c in checks.items()])
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return out.withColumn("passed", passed)


def summarize_results(results: DataFrame, gate: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Per horizon: model origins, best baseline, observation-rate median and minimum, selected and observed totals."""
    rate = 100 * F.col("observed") / F.col("selected")
    model = results.where(F.col("method") == methods[0]).withColumn("_rate", rate)
    per = model.groupBy("horizon_months").agg(
        F.count_distinct("origin").alias("model_test_origins"),
        F.min("_rate").alias("observation_rate_min_pct"),
        F.sum("selected").alias("selected_candidates"),
        F.sum("observed").alias("observed_candidates"),
    )
    mids = median(model, ["horizon_months"], "_rate", "observation_rate_median_pct").drop("n")
    best = F.greatest(*[F.when(F.col(f"{m}_mean").isNotNull(), F.struct(F.col(f"{m}_mean").alias("v"), F.lit(m).alias("m"))) for m in methods[1:]])
    means = gate.select("horizon_months", "common_origins", F.col(f"{methods[0]}_mean").alias("model_mean_pct"), best.alias("_b"))
    means = means.select("*", F.col("_b.m").alias("best_baseline"), F.col("_b.v").alias("best_baseline_pct")).drop("_b")
    return per.join(mids, "horizon_months").join(means, "horizon_months", "left")


def choose(development: DataFrame, baseline: str, measures: Sequence[str], by: Sequence[str] = ("year",)) -> DataFrame:
    """Mean ratio to the baseline over years and measures per method; ``selected`` marks the lowest."""
    keys = list(by)
    base = development.where(F.col("method") == baseline).select(*keys, *[F.col(m).alias(f"_b_{m}") for m in measures])
    ratios = F.array(*[F.try_divide(F.col(m), F.col(f"_b_{m}")) for m in measures])
    rows = development.where(F.col("method") != baseline).join(base, keys).select("method", F.explode(ratios).alias("_r"))
    scored = rows.groupBy("method").agg(F.avg("_r").alias("score"))
    # One row per candidate method from here on.
    lowest = scored.agg(F.min(F.struct("score", "method")).alias("_best")).select(F.col("_best.method").alias("method"), F.lit(True).alias("_s"))
    return scored.join(lowest, "method", "left").withColumn("selected", F.coalesce("_s", F.lit(False))).drop("_s")


def compare_runs(runs: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Control differences of settled strategy runs; the random median exists only if every declared seed settled.

    ``runs``: scope, strategy, random_seed, liquidated_return_pct (null = unsettled).
    """
    r = F.col("liquidated_return_pct")
    control = lambda s: F.max(F.when(F.col("strategy") == s, r))
    random = F.col("strategy") == "random_hold"
    declared = F.col("random_seed").isin(*seeds)
    per = runs.groupBy("scope").agg(
        *[control(s).alias(s) for s in ("hold", "rotate", "cheapest_hold", "cash")],
        F.count_distinct(F.when(random & declared & r.isNotNull(), F.col("random_seed"))).alias("settled_runs"),
        F.count_if(random & r.isNull()).alias("unsettled_runs"),
    )
    mids = quantiles(runs.where(random & declared), ["scope"], "liquidated_return_pct", {"_m": Quantile(0.5)}).select("scope", "_m")
    out = per.join(mids, "scope", "left").withColumn("random_median_pct", F.when(F.col("settled_runs") == len(seeds), F.col("_m")))
    gap = lambda a, b: F.col(a) - F.col(b)
    return out.select(
        "scope", "settled_runs", "unsettled_runs", "random_median_pct",
        gap("rotate", "hold").alias("rotate_minus_hold"), gap("hold", "cheapest_hold").alias("hold_minus_cheapest"),
        gap("hold", "cash").alias("hold_minus_cash"), gap("hold", "random_median_pct").alias("hold_minus_random_median"),
    )


def validation_status(results: DataFrame, regimes: Sequence[str], horizon: int = 24, method: str = METHODS[0], min_complexes: int = 20) -> DataFrame:
    """Evaluations and displayable evaluations per regime, and whether every regime has one."""
    rows = results.where((F.col("horizon_months") == horizon) & (F.col("method") == method))
    per = rows.groupBy("availability_regime").agg(
        F.count("*").alias("evaluations"), F.count_if(F.col("observed_complexes") >= min_complexes).alias("with_observed_headline")
    )
    declared = results.sparkSession.createDataFrame([(r,) for r in regimes], "availability_regime string")
    out = declared.join(per, "availability_regime", "left").fillna(0, subset=["evaluations", "with_observed_headline"])
    return out.withColumn("ready", F.col("with_observed_headline") > 0)
