"""Relative-growth snapshots, their later outcomes and the leave-one-complex-out benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import calendar as cal
from pricetide.operators.stats import Quantile, crowded, leave_one_out_median, median, median_of, quantiles_of, ranked_within
from pricetide.session import durable, stored

MIN_TRADES = 3
MIN_OTHER_COMPLEXES = 5
REGIMES = ("historical_policy", "uniform61")


def law_of(regime: str, law_change: str) -> str | None:
    """The law-change date a regime works with; the uniform regime has none."""
    if regime not in REGIMES:
        raise ValueError(f"unknown availability regime {regime}")
    return None if regime == "uniform61" else law_change


def lookback(trades: DataFrame, law: str | None, first: str, last: str, every: int = 6, phase: int = 0) -> DataFrame:
    """Trades once per origin whose cut-off they precede by less than 365 days.

    Adds ``origin``, ``cutoff`` and ``back`` = days before the cut-off (0 = on it).
    """
    months = cal.grid_months(
        F.greatest(cal.available_date(F.col("date"), law), cal.as_date(first)),
        F.least(F.date_add("date", cal.OLD_LAG + 364), cal.as_date(last)),
        every,
        phase,
    )
    rows = trades.withColumn("origin", F.explode(months)).withColumn("origin", cal.month_start(F.col("origin")))
    rows = rows.withColumn("cutoff", F.date_sub("origin", cal.origin_lag(F.col("origin"), law)))
    rows = rows.withColumn("back", F.datediff("cutoff", "date"))
    return rows.where((F.col("back") >= 0) & (F.col("back") <= 364))


def price_snapshot(trades: DataFrame, law: str | None, first: str, last: str, regime: str = "historical_policy",
                   window: int = 180, every: int = 6, phase: int = 0) -> DataFrame:
    """Types with at least 3 visible trades in the entry window of each origin, and their signals."""
    crowd = crowded(trades, ["key"])
    rows = lookback(trades, law, first, last, every, phase)
    keys = ["origin", "key"]
    entry = (F.col("back") < window).cast("int")
    half = (F.col("back") < 180).cast("int")
    prior = F.col("back").between(180, 359).cast("int")
    levels = quantiles_of(
        rows,
        keys,
        "log_price",
        {"entry": Quantile(0.5, "entry"), "_half": Quantile(0.5, "half"), "_prior": Quantile(0.5, "prior")},
        {"entry": entry, "half": half, "prior": prior},
        crowd,
    ).where(F.col("total_entry") >= MIN_TRADES)
    counts = rows.groupBy(*keys).agg(
        F.first("cutoff").alias("cutoff"),
        F.count_if(F.col("back") < 90).alias("n90"),
        F.count_if(F.col("back") < 180).alias("n180"),
        F.count("*").alias("n365"),
        F.max("date").alias("_last"),
    )
    # The earliest row of a type names its attributes.
    order = F.struct("date", "price", "floor")
    attributes = trades.groupBy("key").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("complex", "gu", "area", "built")]
    )
    snap = (
        levels.select(*keys, F.col("total_entry").cast("long").alias("entry_n"), "entry", "_half", "_prior")
        .join(counts, keys)
        .join(attributes, "key")
        .withColumns(
            {
                "age": F.year("origin") - F.col("built"),
                "momentum": F.col("_half") - F.col("_prior"),
                "peer": F.concat_ws(":", "gu", F.floor(F.col("area") / 15).cast("string")),
                "activity": (F.col("n90") + 1) / ((F.col("n365") - F.col("n90") + 1) / 3),
                "last_age": F.datediff("origin", "_last"),
                "availability_regime": F.lit(regime),
            }
        )
        .drop("_half", "_prior", "_last")
    )
    # One row per origin and type, read several times below and by callers.
    return peer_relative(stored(snap))


def peer_relative(snap: DataFrame, scope: Sequence[str] = ("origin", "peer")) -> DataFrame:
    """Level and momentum relative to the peer group's median type."""
    scope = list(scope)
    pairs = F.array(
        F.struct(F.lit("entry").alias("what"), F.col("entry").alias("v")),
        F.struct(F.lit("momentum").alias("what"), F.col("momentum").alias("v")),
    )
    mids = median(snap.select(*scope, F.inline(pairs)), [*scope, "what"], "v", "m")
    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("m"))).alias(f"_{what}")
    wide = mids.groupBy(*scope).agg(pick("entry"), pick("momentum"))
    return (
        snap.join(wide, scope, "left")
        .withColumn("relative_level", F.col("entry") - F.col("_entry"))
        .withColumn("peer_momentum", F.col("_momentum"))
        .withColumn("relative_momentum", F.col("momentum") - F.col("_momentum"))
        .drop("_entry", "_momentum")
    )


def dispersion(trades: DataFrame, snap: DataFrame, law: str | None, first: str, last: str, every: int = 6) -> DataFrame:
    """Adds lower/upper spread, active days and median floor of the 180-day entry window."""
    rows = lookback(trades, law, first, last, every).where(F.col("back") < 180)
    keys = ["origin", "key"]
    crowd = crowded(trades, ["key"])
    tails = quantiles_of(rows, keys, "log_price", {"_p10": Quantile(0.1), "_p90": Quantile(0.9)}, crowd=crowd).select(*keys, "_p10", "_p90")
    days = rows.groupBy(*keys).agg(F.count_distinct("date").alias("active_days"))
    floors = median_of(rows, keys, "floor", "median_floor", crowd).select(*keys, "median_floor")
    return (
        snap.join(tails, keys, "left")
        .join(days, keys, "left")
        .join(floors, keys, "left")
        .withColumn("lower_spread", F.col("entry") - F.col("_p10"))
        .withColumn("upper_spread", F.col("_p90") - F.col("entry"))
        .drop("_p10", "_p90")
    )


def exits(trades: DataFrame, horizons: Sequence[int], window_months: int, start_inclusive: bool, first: str, last: str,
          every: int = 6, phase: int = 0) -> DataFrame:
    """Each trade once per (origin, horizon) whose exit window holds it.

    The window ends at origin + horizon months (inclusive) and starts
    ``window_months`` before it.
    """
    rows = trades.withColumn("horizon_months", F.explode(F.array(*[F.lit(h) for h in horizons])))
    low = cal.month_index(F.date_sub("date", 1)) + 1
    high = cal.month_index(F.add_months("date", window_months))
    target = F.pmod(F.lit(phase) + F.col("horizon_months"), F.lit(every))
    low = low + F.pmod(target - low, F.lit(every))
    ends = F.when(low <= high, F.sequence(low, high, F.lit(every))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_end", F.explode(ends))
    rows = rows.withColumns(
        {"exit_end": cal.month_start(F.col("_end")), "origin": cal.month_start(F.col("_end") - F.col("horizon_months"))}
    ).withColumn("exit_start", F.add_months("exit_end", -window_months))
    opens = F.col("date") >= F.col("exit_start") if start_inclusive else F.col("date") > F.col("exit_start")
    inside = opens & (F.col("date") <= F.col("exit_end"))
    return rows.where(inside & F.col("origin").between(cal.as_date(first), cal.as_date(last))).drop("_end")


def loo_benchmark(panel: DataFrame, scope: Sequence[str] = ("origin", "horizon_months", "peer"), value: str = "growth",
                  out: str = "benchmark") -> DataFrame:
    """Median over the *other* complexes' median growth in the peer group; at least 5 others.

    Every complex counts once.  No complex is paired with another: the
    leave-one-out median is read off three order statistics of the peer group.
    """
    scope = list(scope)
    panel = stored(panel)
    measured = median_of(panel, [*scope, "complex"], value, "_growth", crowded(panel, ["complex"])).select(*scope, "complex", "_growth")
    complexes = panel.select(*scope, "complex").distinct().join(measured, [*scope, "complex"], "left")
    bench = leave_one_out_median(complexes, scope, "_growth", out, MIN_OTHER_COMPLEXES)
    return panel.join(bench.select(*scope, "complex", out), [*scope, "complex"], "left")


def _outcomes(trades, snap, horizons, window_months, start_inclusive, law, first, last, every, phase):
    keys = ["origin", "horizon_months", "key"]
    exit_rows = exits(trades, horizons, window_months, start_inclusive, first, last, every, phase)
    # A type's trades serve several windows of several horizons, but each window once.
    values = median_of(exit_rows, keys, "log_price", "exit", crowded(trades, ["key"])).withColumnRenamed("n", "exit_n")
    panel = snap.withColumn("horizon_months", F.explode(F.array(*[F.lit(h) for h in horizons])))
    panel = panel.join(values, keys, "left").fillna(0, subset=["exit_n"])
    panel = panel.withColumn("growth", F.when(F.col("exit_n") >= MIN_TRADES, F.col("exit") - F.col("entry")))
    panel = loo_benchmark(panel).withColumn("target", F.col("growth") - F.col("benchmark"))
    end = F.add_months("origin", F.col("horizon_months"))
    start = F.add_months(end, -window_months)
    opening = start if start_inclusive else F.date_add(start, 1)
    return panel.withColumn("label_available", cal.maturity_date(opening, end, law)), start, end


def labels(trades: DataFrame, snap: DataFrame, horizons: Sequence[int], law: str | None, first: str, last: str,
           every: int = 6, phase: int = 0) -> DataFrame:
    """Outcome of the last six months before each horizon (both ends in)."""
    return _outcomes(trades, snap, horizons, 6, True, law, first, last, every, phase)[0]


def path_labels(trades: DataFrame, snap: DataFrame, horizons: Sequence[int], law: str | None, first: str, last: str,
                every: int = 6, phase: int = 0) -> DataFrame:
    """Outcome of the trailing twelve months ``(end - 12 months, end]`` at each checkpoint."""
    panel, start, end = _outcomes(trades, snap, horizons, 12, False, law, first, last, every, phase)
    return panel.withColumn("exit_start_exclusive", start).withColumn("exit_end_inclusive", end)


def observation_counts(trades: DataFrame, snap: DataFrame, horizons: Sequence[int], first: str, last: str,
                       every: int = 6) -> DataFrame:
    """How many candidates will be measurable, without computing any price."""
    keys = ["origin", "horizon_months", "key"]
    seen = exits(trades, horizons, 12, False, first, last, every).groupBy(*keys).agg(F.count("*").alias("n"))
    panel = snap.select("origin", "key", "complex", "peer").withColumn(
        "horizon_months", F.explode(F.array(*[F.lit(h) for h in horizons]))
    )
    panel = panel.join(seen, keys, "left").withColumn("observed", F.coalesce(F.col("n"), F.lit(0)) >= MIN_TRADES)
    scope = ["origin", "horizon_months", "peer"]
    support = panel.where("observed").groupBy(*scope).agg(F.count_distinct("complex").alias("_complexes"))
    panel = panel.join(support, scope, "left").withColumn(
        "relative", F.col("observed") & (F.coalesce(F.col("_complexes"), F.lit(0)) >= MIN_OTHER_COMPLEXES + 1)
    )
    return panel.groupBy("origin", "horizon_months").agg(
        F.count("*").alias("cohort"),
        F.count_if("observed").alias("exit_with_three_trades"),
        F.count_if("relative").alias("relative_outcome_observed"),
        (F.count_if("relative") * 100 / F.count("*")).alias("relative_observation_rate_pct"),
    )


def cohort_coverage(panel: DataFrame) -> DataFrame:
    return panel.groupBy("availability_regime", "horizon_months", "origin").agg(
        F.count("*").alias("cohort"),
        F.count_if(F.col("exit_n") >= MIN_TRADES).alias("exit_with_three_trades"),
        F.count("target").alias("relative_outcome_observed"),
    )


def case_horizons(trades: DataFrame, cases: Column, origins: Sequence[str],
                  windows: Sequence[tuple[int, int]] = ((6, 12), (12, 18), (18, 24))) -> DataFrame:
    """Exit windows of named complexes against the pooled growth of their peers.

    ``cases`` selects the complexes under study.  The benchmark is the median
    over all measured *types* of other complexes, from at least 5 of them.
    """
    grid = F.explode(F.array(*[cal.as_date(o) for o in origins])).alias("origin")
    based = trades.select("*", grid).withColumn("cutoff", F.date_sub("origin", cal.NEW_LAG))
    order = F.struct("date", "price", "floor")
    attributes = trades.groupBy("key").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("complex", "gu", "area")]
    )
    entry = median(
        based.where(F.col("date").between(F.date_sub("cutoff", 179), F.col("cutoff"))), ["origin", "key"], "log_price", "entry"
    ).where(F.col("n") >= MIN_TRADES)
    span = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in windows]))
    ahead = trades.select("*", grid).withColumn("w", span).select("*", "w.*")
    ahead = ahead.where(F.col("date").between(F.add_months("origin", F.col("lo")), F.add_months("origin", F.col("hi"))))
    future = median(ahead, ["origin", "lo", "hi", "key"], "log_price", "exit").withColumnRenamed("n", "exit_n")
    base = (
        entry.withColumnRenamed("n", "entry_n")
        .join(attributes, "key")
        .withColumn("peer", F.concat_ws(":", "gu", F.floor(F.col("area") / 15).cast("string")))
        .withColumn("w", span)
        .select("*", "w.*")
        .drop("w")
        .join(future, ["origin", "lo", "hi", "key"], "left")
        .withColumn("growth", F.when(F.col("exit_n") >= MIN_TRADES, F.col("exit") - F.col("entry")))
    )
    base = durable(base)
    studied = base.where(cases)
    # Every peer group is ordered once.  Leaving a complex out moves a middle
    # place up by the number of its own types at or below it, so each case
    # looks up two places, however large its peer group is.
    scope = ["origin", "lo", "peer"]
    known = base.where(F.col("growth").isNotNull()).select(*scope, "complex", "key", "growth")
    placed = durable(ranked_within(known, scope, [F.col("growth").asc(), F.col("key").asc()], "_place"))
    groups = placed.groupBy(*scope).agg(F.count("*").alias("_n"), F.count_distinct("complex").alias("_complexes"))
    # A complex has a handful of types in one area band.
    own = placed.where(cases).groupBy(*scope, "complex").agg(F.array_sort(F.collect_list("_place")).alias("_own"))
    asked = studied.join(groups, scope, "left").join(own, [*scope, "complex"], "left")
    asked = asked.withColumn("_own", F.coalesce("_own", F.array().cast("array<long>")))
    left = F.coalesce("_n", F.lit(0)) - F.size("_own")
    shifted = lambda place: F.aggregate("_own", place.cast("long"), lambda at, r: F.when(r <= at, at + 1).otherwise(at))
    asked = asked.withColumns(
        {
            "peer_complexes": F.coalesce("_complexes", F.lit(0)) - (F.size("_own") > 0).cast("int"),
            "_low": F.when(left > 0, shifted(F.floor((left + 1) / 2))),
            "_high": F.when(left > 0, shifted(F.floor((left + 2) / 2))),
        }
    )
    at = lambda place, out: placed.select(*scope, F.col("_place").alias(place), F.col("growth").alias(out))
    found = asked.join(at("_low", "_a"), [*scope, "_low"], "left").join(at("_high", "_b"), [*scope, "_high"], "left")
    found = found.withColumn("benchmark", (F.col("_a") + F.col("_b")) / 2)
    enough = F.col("peer_complexes") >= MIN_OTHER_COMPLEXES
    return (
        found.withColumn("growth_pct", F.expm1("growth") * 100)
        .withColumn("excess_pct", F.when(enough, F.expm1(F.col("growth") - F.col("benchmark")) * 100))
        .drop("_n", "_complexes", "_own", "_low", "_high", "_a", "_b")
    )


def baseline_signals(panel: DataFrame) -> DataFrame:
    """Three rules without any model: laggard, cheap against peers, momentum."""
    return panel.withColumns(
        {
            "laggard": -F.col("relative_momentum"),
            "cheap_peer": -F.col("relative_level"),
            "momentum_signal": F.col("relative_momentum"),
        }
    )


def mature_training(panel: DataFrame, origin: str, horizons: Sequence[int], excluded: Column | None = None,
                    min_rows: int = 500, min_origins: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows whose label was public at ``origin``, weighted 1/number of their horizons, and the support per horizon.

    The weight is taken at each prediction origin anew, so an immature horizon
    of the same type never changes an available row's weight.
    """
    train = panel.where((F.col("label_available") <= cal.as_date(origin)) & F.col("target").isNotNull())
    if excluded is not None:
        train = train.where(~excluded)
    size = train.groupBy("origin", "key").agg(F.count("*").alias("_size"))
    train = train.join(size, ["origin", "key"]).withColumn("sample_weight", 1 / F.col("_size")).drop("_size")
    support = train.groupBy("horizon_months").agg(
        F.count("*").alias("rows"), F.count_distinct("origin").alias("origins")
    )
    declared = train.sparkSession.createDataFrame([(h,) for h in horizons], "horizon_months int")
    support = declared.join(support, "horizon_months", "left").fillna(0, subset=["rows", "origins"])
    support = support.withColumn("sufficient", (F.col("rows") >= min_rows) & (F.col("origins") >= min_origins))
    return train, support
