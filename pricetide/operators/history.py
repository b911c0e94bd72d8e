"""Publication-lag-aware features of a type's own history, its complex and its peers.

The as-of range join "all trades visible at origin O within n days" is
expressed as a bounded fan-out: a trade of day t can only serve the monthly
origins between its availability and t + lag + 365, so exploding it to those
origins turns the join into a hash aggregate on (origin, key).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import calendar as cal
from pricetide.operators import traces
from pricetide.operators.stats import Quantile, crowded, quantiles, quantiles_of, quantiles_with, value_bin
from pricetide.session import stored

HALF_LIVES = (30, 60, 90, 180)
WINDOWS = (30, 90, 180, 365)
HORIZON_DAYS = 365
# Recency weights are counted in whole units of 1e-9, so their sums, and with
# them the "reaches half of the total" test, do not depend on row order.
WEIGHT_UNIT = 1e9
# Trades that one task copies to their origins.
TRADES_PER_TASK = 100_000


@dataclass(frozen=True)
class Lag:
    """Publication assumption: a uniform number of days, or the 61/31 law change."""

    uniform: int | None = None
    law_change: str | None = None

    def at_origin(self, origin: Column) -> Column:
        return F.lit(self.uniform) if self.uniform is not None else cal.origin_lag(origin, self.law_change)

    def available(self, date: Column) -> Column:
        if self.uniform is not None:
            return F.date_add(date, self.uniform)
        return cal.available_date(date, self.law_change)


def history_join(trades: DataFrame, lag: Lag, first: str, last: str, every: int = 1, phase: int = 0, only: Column | None = None) -> DataFrame:
    """Every trade once per origin it can serve, with ``origin``, ``lag`` and ``age`` in days.

    Origins are the grid month starts of [first, last].  A trade is visible
    when its availability is not after the origin; ``age <= lag + 365``.
    ``only`` holds the indexes of the months that a row is asked for.
    """
    longest = lag.uniform if lag.uniform is not None else cal.OLD_LAG
    months = cal.grid_months(
        F.greatest(lag.available(F.col("date")), cal.as_date(first)),
        F.least(F.date_add("date", longest + HORIZON_DAYS), cal.as_date(last)),
        every,
        phase,
    )
    months = months if only is None else F.array_intersect(months, only)
    served = trades.withColumn("origin", F.explode(months)).withColumn("origin", cal.month_start(F.col("origin")))
    served = served.withColumns(
        {"lag": lag.at_origin(F.col("origin")), "age": F.datediff("origin", F.col("date"))}
    )
    return served.where((F.col("age") >= F.col("lag")) & (F.col("age") <= F.col("lag") + HORIZON_DAYS))


def within(days: int) -> Column:
    """Own-history window: age up to lag + days, i.e. days + 1 calendar days."""
    return F.col("age") <= F.col("lag") + days


def recency_weight(half_life: int) -> Column:
    return F.round(F.pow(F.lit(2.0), -F.col("age") / half_life) * WEIGHT_UNIT).cast("long")


def _window_request():
    weights = {f"n{n}": F.when(within(n), 1).otherwise(0) for n in WINDOWS}
    return weights, {f"median{n}": Quantile(0.5, f"n{n}") for n in WINDOWS}


def _decay_request():
    weights = {f"e{h}": recency_weight(h) for h in HALF_LIVES}
    return weights, {f"ew{h}": Quantile(0.5, f"e{h}", linear=False) for h in HALF_LIVES}


def _spread_request():
    weights = {"n90": F.when(within(90), 1).otherwise(0)}
    return weights, {"p25": Quantile(0.25, "n90", min_weight=2), "p75": Quantile(0.75, "n90", min_weight=2)}


def _stats(rows: DataFrame, groups: Sequence[str], wanted, weights, crowd: DataFrame | None, counted: bool) -> DataFrame:
    """Quantiles of log prices; groups that were ``counted`` take one shuffle, but for those of ``crowd``."""
    return quantiles_of(rows, groups, "log_price", wanted, weights, crowd) if counted else quantiles(rows, groups, "log_price", wanted, weights)


def window_stats(served: DataFrame, keys: Sequence[str] = ("origin", "key"), crowd: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """Count and median of the trailing 30/90/180/365-day windows.

    ``counted`` says that the keys were counted and ``crowd`` holds the crowded ones.
    """
    weights, wanted = _window_request()
    stats = _stats(served, keys, wanted, weights, crowd, counted)
    counts = [F.col(f"total_n{n}").cast("long").alias(f"n{n}") for n in WINDOWS]
    return stats.select(*keys, *counts, *wanted)


def ew_medians(served: DataFrame, keys: Sequence[str] = ("origin", "key"), crowd: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """Exponentially weighted medians for half-lives of 30, 60, 90 and 180 days; ``crowd`` and ``counted`` as in :func:`window_stats`."""
    weights, wanted = _decay_request()
    return _stats(served, keys, wanted, weights, crowd, counted).select(*keys, *wanted)


def _evidence_aggregates() -> list[Column]:
    w = F.pow(F.lit(2.0), -F.col("age") / 90)
    return [
        F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("eff90"),
        F.sum(w).alias("mass90"),
        F.count_distinct(F.when(within(90), F.col("day"))).alias("active_days90"),
    ]


EVIDENCE = ("eff90", "mass90", "active_days90")


def evidence_stats(served: DataFrame, keys: Sequence[str] = ("origin", "key")) -> DataFrame:
    """Effective sample size, weight mass, active days, inter-quartile spread and median floor."""
    plain = served.groupBy(*keys).agg(*_evidence_aggregates())
    weights, wanted = _spread_request()
    spread = quantiles(served, keys, "log_price", wanted, weights)
    spread = spread.select(*keys, (F.col("p75") - F.col("p25")).alias("spread90"))
    floors = quantiles(served.where(within(90)), keys, "floor", {"hist_floor": Quantile(0.5)})
    return plain.join(spread, list(keys), "left").join(floors.select(*keys, "hist_floor"), list(keys), "left")


def activity_columns() -> dict[str, Column]:
    """Share of the last month and recent versus earlier trading pace."""
    n30, n90, n365 = F.col("n30"), F.col("n90"), F.col("n365")
    return {
        "concentration": n30 / F.greatest(n90, F.lit(1)),
        "activity_ratio": ((n90 + 1) / 90) / ((n365 - n90 + 1) / 275),
    }


def complete_month(lag: Lag) -> int:
    """First month of a year by whose first day the whole year before has been published; at most December."""
    days = lag.uniform if lag.uniform is not None else cal.OLD_LAG
    return next((m for m in range(3, 12) if (dt.date(2001, m, 1) - dt.date(2000, 12, 31)).days >= days), 12)


def prior_annual(trades: DataFrame, lag: Lag) -> DataFrame:
    """Median of the previous calendar year per (key, target_year, stage).

    A stage is a month from March on, and holds what is visible on its first
    day.  The stages end with the month by which the year is complete: April
    for lags up to 90 days.
    """
    target, last = F.year("date") + 1, complete_month(lag)
    seen = lag.available(F.col("date"))
    first = cal.month_index(F.date_sub(seen, 1)) + 1 - target * 12 + 1  # month of the target year that starts at or after it
    first = F.greatest(first, F.lit(3))
    stages = F.when(first <= last, F.sequence(first, F.lit(last))).otherwise(F.array().cast("array<int>"))
    rows = trades.select("key", "log_price", target.alias("target_year"), F.explode(stages).alias("stage"))
    stats = quantiles_of(rows, ["key", "target_year", "stage"], "log_price", {"prior_annual": Quantile(0.5)}, crowd=crowded(trades, ["key"]))
    return stats.select("key", "target_year", "stage", "prior_annual")


def annual_activity(trades: DataFrame, served: DataFrame, lag: Lag) -> DataFrame:
    """Previous-year median, concentration and activity ratio per (origin, key); origins from March on."""
    counts = served.groupBy("origin", "key").agg(*[F.count_if(within(n)).alias(f"n{n}") for n in (30, 90, 365)])
    counts = counts.where(F.month("origin") >= 3).withColumns(
        {"target_year": F.year("origin"), "stage": F.least(F.month("origin"), F.lit(complete_month(lag))), **activity_columns()}
    )
    joined = counts.join(prior_annual(trades, lag), ["key", "target_year", "stage"], "left")
    return joined.select("origin", "key", "prior_annual", "concentration", "activity_ratio")


def scoped(trades: DataFrame, scopes: Sequence[str], *carried: str) -> DataFrame:
    """(scope, id) of each row's pools, and what is carried along."""
    return trades.select(*carried, F.inline(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(s).alias("id")) for s in scopes])))


def pools(served: DataFrame, scopes: Sequence[str] = ("complex", "peer"), crowd: DataFrame | None = None, counted: bool = False) -> DataFrame:
    """Medians and counts of the surrounding pools, long form (origin, scope, id).

    Pools look back exactly n days: ``age < lag + n``.  ``counted`` says that
    the pools were counted and ``crowd`` holds the crowded ones.
    """
    pairs = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(s).alias("id")) for s in scopes])
    rows = served.select("origin", "lag", "age", "log_price", F.inline(pairs)).where(
        F.col("age") < F.col("lag") + HORIZON_DAYS
    )
    weights = {f"p{n}": F.when(F.col("age") < F.col("lag") + n, 1).otherwise(0) for n in (90, 365)}
    groups, wanted = ["origin", "scope", "id"], {f"pool{n}": Quantile(0.5, f"p{n}") for n in (90, 365)}
    stats = _stats(rows, groups, wanted, weights, crowd, counted)
    counts = [F.col(f"total_p{n}").cast("long").alias(f"pool_n{n}") for n in (90, 365)]
    return stats.select("origin", "scope", "id", "pool90", "pool365", *counts)


def dealt(trades: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by ``by`` before they are copied to origins: what is grouped by origin and ``by`` moves once, uncopied."""
    return trades.repartition(max(1, trades.count() // TRADES_PER_TASK), *by)


def pools_of(trades: DataFrame, lag: Lag, first: str, last: str, every: int = 1, phase: int = 0, scopes: Sequence[str] = ("complex", "peer"),
             origins: Column | None = None) -> DataFrame:
    """:func:`pools` of all origins that ``origins`` selects, from the trades themselves.

    A pool's trades meet in one task, those of a crowded pool by value bins.
    """
    origins = F.lit(True) if origins is None else origins
    rows = stored(scoped(trades, scopes, "date", "log_price").where(F.col("id").isNotNull()))
    crowd = crowded(rows, ["scope", "id"])
    weights = {f"p{n}": F.when(F.col("age") < F.col("lag") + n, 1).otherwise(0) for n in (90, 365)}
    groups, wanted = ["origin", "scope", "id"], {f"pool{n}": Quantile(0.5, f"p{n}") for n in (90, 365)}

    def of(part: DataFrame) -> DataFrame:
        return history_join(part, lag, first, last, every, phase).where(origins & (F.col("age") < F.col("lag") + HORIZON_DAYS))

    rows = rows.select("scope", F.col("id").cast("string").alias("id"), "date", lag.available(F.col("date")).alias("seen"), F.col("log_price").cast("double").alias("log_price"))
    rows = rows.where(F.col("date").isNotNull() & F.col("log_price").isNotNull() & ~F.isnan("log_price"))
    few = rows if crowd is None else rows.join(crowd, ["scope", "id"], "left_anti")
    # The calendar's months, not rows, reach the driver.
    grid = rows.sparkSession.range(1).select(F.explode(cal.grid_months(cal.as_date(first), cal.as_date(last), every, phase)).alias("origin"))
    grid = grid.select(cal.month_start(F.col("origin")).alias("origin")).where(origins).select(F.unix_date("origin").alias("origin"), lag.at_origin(F.col("origin")).alias("lag"))
    at = {r["origin"]: r["lag"] for r in grid.collect()}
    stats = traces.pools(dealt(few, "id").sortWithinPartitions("scope", "id", "log_price"), at, 90, HORIZON_DAYS)
    if crowd is not None:
        many = stored(rows.join(crowd, ["scope", "id"], "left_semi").withColumn("_bin", value_bin(F.col("log_price"))))
        # Where many rows share a few values, no task may hold a bin either.
        if crowded(many, ["scope", "id", "_bin"]) is None:
            stats = stats.unionByName(_crowded_pools(many, at, lag))
        else:
            counts = [F.col(f"total_p{n}").cast("long").alias(f"pool_n{n}") for n in (90, 365)]
            stats = stats.unionByName(quantiles(of(dealt(many, "id", "_bin")), groups, "log_price", wanted, weights).select(*groups, "pool90", "pool365", *counts))
    return stats


def _crowded_pools(rows: DataFrame, at: Mapping[int, int], lag: Lag) -> DataFrame:
    """Pools that no task may hold: bins are counted per origin where they are, only rows of bins that hold a middle are copied and ordered."""
    groups = ["origin", "scope", "id"]
    spans = (90, HORIZON_DAYS)
    histogram = traces.slices(dealt(rows, "id", "_bin").sortWithinPartitions("scope", "id", "_bin").select("scope", "id", "_bin", "date", "seen"), at, *spans)
    below, whole = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups)
    bins = histogram.withColumns(
        {f"_o{n}": F.coalesce(F.sum(f"_h{n}").over(below), F.lit(0)) for n in spans} | {f"_n{n}": F.sum(f"_h{n}").over(whole) for n in spans}
    )
    # Ranks of the two middle rows inside the bin, null where it doesn't hold them.
    middles = {f"_lo{n}": F.floor((F.col(f"_n{n}") - 1) * 0.5) + 1 - F.col(f"_o{n}") for n in spans} | {f"_hi{n}": F.ceil((F.col(f"_n{n}") - 1) * 0.5) + 1 - F.col(f"_o{n}") for n in spans}
    inside = {c: F.when((F.col(f"_n{c[3:]}") > 0) & (rank >= 1) & (rank <= F.col(f"_h{c[3:]}")), rank) for c, rank in middles.items()}
    asked = bins.select(*groups, "_bin", *[f"_n{n}" for n in spans], *[v.alias(c) for c, v in inside.items()]).where(F.coalesce(*inside).isNotNull())
    # A few bins for each crowded pool and origin.
    asked = stored(asked)
    age = F.datediff("origin", F.col("date")) - lag.at_origin(F.col("origin"))
    held = rows.join(F.broadcast(asked), ["scope", "id", "_bin"]).withColumn("_age", age)
    held = held.where((F.col("seen") <= F.col("origin")) & F.col("_age").between(0, HORIZON_DAYS - 1))
    upto = Window.partitionBy(*groups, "_bin").orderBy("log_price").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumns({f"_c{n}": F.count_if(F.col("_age") < n).over(upto) for n in spans})
    found = ranked.groupBy(*groups).agg(
        *[F.max(f"_n{n}").alias(f"_n{n}") for n in spans], *[F.min(F.when(F.col(f"_c{c[3:]}") >= F.col(c), F.col("log_price"))).alias(c) for c in middles]
    )
    place = lambda n: (F.col(f"_n{n}") - 1) * 0.5
    middle = lambda n: F.col(f"_lo{n}") + (F.col(f"_hi{n}") - F.col(f"_lo{n}")) * (place(n) - F.floor(place(n)))
    return found.select(*groups, middle(90).alias("pool90"), middle(HORIZON_DAYS).alias("pool365"), F.col("_n90").alias("pool_n90"), F.col(f"_n{HORIZON_DAYS}").alias("pool_n365"))


def served_of(trades: DataFrame, wanted: DataFrame, lag: Lag, first: str, last: str, every: int = 1, phase: int = 0) -> DataFrame:
    """:func:`history_join` of the wanted (origin, key) alone; a key's trades meet in one task before they are copied."""
    asked = wanted.groupBy("key").agg(F.collect_set(cal.month_index(F.col("origin"))).alias("_asked"))
    return history_join(dealt(trades, "key").join(asked, "key"), lag, first, last, every, phase, F.col("_asked")).drop("_asked")


def own_stats(few: DataFrame, many: DataFrame | None, keys_crowd: DataFrame | None, value: str, wanted, weights=None, also=(), extra=()) -> DataFrame:
    """Statistics by (origin, key) of the rows of ordinary keys and of those of crowded ones."""
    keys = ["origin", "key"]
    stats = quantiles_with(few, keys, value, wanted, weights, also, extra)
    return stats if many is None else stats.unionByName(quantiles_with(many, keys, value, wanted, weights, also, extra, keys_crowd))


def _age_weights(rows: DataFrame, lag: Lag) -> dict[int, list[int]]:
    """Recency weights of every age in days by half-life, as the executors compute them."""
    oldest = HORIZON_DAYS + (lag.uniform if lag.uniform is not None else cal.OLD_LAG)
    ages = rows.sparkSession.range(oldest + 1).select(F.col("id").alias("age")).select("age", *[recency_weight(h).alias(f"e{h}") for h in HALF_LIVES])
    found = ages.orderBy("age").collect()
    return {h: [r[f"e{h}"] for r in found] for h in HALF_LIVES}


def histories_of(trades: DataFrame, asked: Column, lag: Lag) -> DataFrame:
    """History, evidence, floors, newest trade and previous year by (origin, key) of the origins that ``asked`` gives trades.

    A key's trades meet in one task and are never copied: see :mod:`traces`.
    """
    rows = dealt(trades.where(F.col("key").isNotNull()).select("key", "date", "log_price", "floor", asked.alias("origin")), "key")
    stage = F.make_date(F.year("origin"), F.least(F.month("origin"), F.lit(complete_month(lag))), F.lit(1))
    rows = rows.sortWithinPartitions("key", "date", "log_price").select(
        "key", "date", lag.available(F.col("date")).alias("seen"), F.col("log_price").cast("double").alias("log_price"), F.col("floor").cast("double").alias("floor"),
        F.lit(True).alias("is_trade"), "origin", lag.at_origin(F.col("origin")).cast("int").alias("lag"), stage.alias("stage"),
    )
    return traces.histories(rows, WINDOWS, _age_weights(trades, lag), HORIZON_DAYS)


def crowded_histories(trades: DataFrame, wanted_keys: DataFrame, lag: Lag, first: str, last: str, crowd: DataFrame) -> DataFrame:
    """:func:`histories_of` for the keys of ``crowd``, whose trades no task may hold."""
    keys = ["origin", "key"]
    trades, wanted_keys = (df.join(crowd, "key", "left_semi") for df in (trades, wanted_keys))
    many = history_join(trades.select("key", "floor", "date", "day", "log_price"), lag, first, last).join(wanted_keys, keys, "left_semi")
    weights, wanted = {}, {}
    for request in (_window_request(), _decay_request(), _spread_request()):
        weights |= request[0]
        wanted |= request[1]
    history = quantiles_with(many, keys, "log_price", wanted, weights, _evidence_aggregates(), ["age", "lag", "day"], crowd).select(
        *keys,
        *[F.col(f"total_n{n}").cast("long").alias(f"n{n}") for n in WINDOWS],
        *[f"median{n}" for n in WINDOWS],
        *[f"ew{h}" for h in HALF_LIVES],
        (F.col("p75") - F.col("p25")).alias("spread90"),
        *EVIDENCE,
    )
    floors = quantiles_with(many.where(within(90)), keys, "floor", {"hist_floor": Quantile(0.5)}, crowd=crowd).select(*keys, "hist_floor")
    return (
        wanted_keys.join(history, keys, "left")
        .join(floors, keys, "left")
        .join(last_trade(trades, wanted_keys, lag), keys, "left")
        .withColumns({"target_year": F.year("origin"), "stage": F.least(F.month("origin"), F.lit(complete_month(lag)))})
        .join(prior_annual(trades, lag), ["key", "target_year", "stage"], "left")
        .drop("target_year", "stage")
    )


def last_trade(trades: DataFrame, targets: DataFrame, lag: Lag) -> DataFrame:
    """Newest visible trade per (key, origin), however old: ``last`` and ``last_age``.

    Ties on a day are broken by the larger price.  Trades are first reduced to
    one row per key and day, so the ordered pass over a key is bounded by the
    calendar, not by its number of trades.
    """
    daily = trades.groupBy("key", "date").agg(F.max("log_price").alias("log_price"))
    newest = F.struct(F.col("date"), F.col("log_price"))
    events = daily.select("key", lag.available(F.col("date")).alias("at"), newest.alias("trade"), F.lit(None).cast("date").alias("origin"))
    asks = targets.select("key", F.col("origin").alias("at"), F.lit(None).cast(events.schema["trade"].dataType).alias("trade"), "origin")
    w = Window.partitionBy("key").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.unionByName(asks).withColumn("seen", F.max("trade").over(w)).where(F.col("origin").isNotNull())
    return seen.where(F.col("seen").isNotNull()).select(
        "origin", "key", F.col("seen.log_price").alias("last"), F.datediff("origin", F.col("seen.date")).alias("last_age")
    )


def monthly_features(trades: DataFrame, lag: Lag, first: str, last: str) -> DataFrame:
    """One row per contract of March to December months in [first, last] with its lag-safe inputs.

    Anchor = first known of ew90, complex90, complex365, peer90, peer365; the
    other price levels fall back to it.
    """
    month_first = F.trunc("date", "MM")
    # Read many times below: the narrow rows are written once.
    trades = stored(trades.select("key", "complex", "peer", "gu", "area", "built", "floor", "date", "day", "log_price", "price_oku"))
    keys_crowd = crowded(trades, ["key"])
    asks = (F.month("date") >= 3) & (month_first >= cal.as_date(first)) & (month_first <= cal.as_date(last))
    targets = trades.where(asks).withColumn("origin", month_first)
    keys = ["origin", "key"]
    few = trades if keys_crowd is None else trades.join(keys_crowd, "key", "left_anti")
    own = histories_of(few, F.when(asks, month_first), lag)
    if keys_crowd is not None:
        own = own.unionByName(crowded_histories(trades, targets.select(*keys).distinct(), lag, first, last, keys_crowd))

    # One row per pool and origin, read by every contract of it.
    around = stored(pools_of(trades, lag, first, last, origins=F.month("origin") >= 3))
    scope = lambda s: around.where(F.col("scope") == s).select(
        "origin",
        F.col("id").alias(s),
        F.col("pool90").alias(f"{s}90"),
        F.col("pool365").alias(f"{s}365"),
        F.col("pool_n90").alias(f"{s}_n90"),
        F.col("pool_n365").alias(f"{s}_n365"),
    )
    # An origin without any visible trade in the year before it is skipped.
    supported = around.select("origin").distinct()

    frame = own.join(supported, "origin", "left_semi")
    carried = ["key", "complex", "peer", "gu", "area", "built", "floor", "date", "log_price", "price_oku", "origin"]
    rows = (
        targets.select(*carried)
        .join(frame, keys)
        .join(scope("complex"), ["origin", "complex"], "left")
        .join(scope("peer"), ["origin", "peer"], "left")
    )
    zero = [f"n{n}" for n in WINDOWS] + ["eff90", "mass90", "active_days90", "complex_n90", "complex_n365", "peer_n90", "peer_n365"]
    rows = rows.fillna(0, subset=zero)
    anchor = F.coalesce("ew90", "complex90", "complex365", "peer90", "peer365")
    filled = [f"ew{h}" for h in HALF_LIVES] + ["last", "median90", "median365", "prior_annual"]
    rows = rows.withColumn("anchor", anchor).withColumns({c: F.coalesce(c, "anchor") for c in filled})
    lag_days = lag.at_origin(F.col("origin"))
    return rows.withColumns(
        {
            **activity_columns(),
            "age": F.year("origin") - F.col("built"),
            "floor_delta": F.col("floor") - F.col("hist_floor"),
            "low_floor": (F.col("floor") <= 2).cast("double"),
            "actual": F.col("log_price"),
            "contract_date": F.col("date").cast("string"),
            "year": F.year("origin"),
            "month": F.date_format("origin", "yyyy-MM"),
            "lag_days": lag_days,
            "feature_cutoff": F.date_sub("origin", lag_days).cast("string"),
        }
    ).drop("built", "hist_floor", "date", "log_price", "origin")


# Model inputs, in the order the models read them (fixed values).
PRICE_FEATURES = (
    "area age anchor last median90 median365 ew30 ew60 ew90 ew180 "
    "peer90 peer365 complex90 complex365 prior_annual"
).split()
ACTIVITY_FEATURES = (
    "n30 n90 n180 n365 last_age spread90 eff90 mass90 active_days90 concentration "
    "activity_ratio complex_n90 complex_n365 peer_n90 peer_n365"
).split()
FLOOR_FEATURES = ["floor", "floor_delta", "low_floor"]
FEATURES = PRICE_FEATURES + ACTIVITY_FEATURES + FLOOR_FEATURES
PRICE_LEVELS = [c for c in PRICE_FEATURES if c not in ("area", "age", "anchor")]


def relative_inputs(frame: DataFrame) -> DataFrame:
    """Price levels relative to the anchor; the anchor itself is dropped."""
    return frame.withColumns({c: F.col(c) - F.col("anchor") for c in PRICE_LEVELS}).drop("anchor")


def observed_index(index: DataFrame, kinds: Sequence[str], months: Sequence[int] = (1, 3, 6, 12)) -> DataFrame:
    """n-month log change on a gap-free monthly calendar: a missing month gives null, never a skip.

    Input (gu, period, kind, value) with ``period`` a month start.  A change is
    a self-lookup on the exact earlier month, which cannot skip a gap; months
    absent from the series but inside its range appear with nulls.
    """
    span = index.groupBy("gu", "kind").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    calendar = span.select(
        "gu", "kind", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("period")
    )
    series = calendar.join(index, ["gu", "kind", "period"], "left")
    w = Window.partitionBy("gu", "kind").orderBy("period")
    changes = {f"change_{n}m": F.ln(F.try_divide("value", F.lag("value", n).over(w))) for n in months}
    return series.withColumns(changes).where(F.col("kind").isin(*kinds)).select("gu", "kind", "period", *changes)


def join_index(frame: DataFrame, index: DataFrame, kinds: Sequence[str] = ("sale", "rent"), months_lag: int = 2,
               months: Sequence[int] = (1, 3, 6, 12), parent: Column | None = None) -> DataFrame:
    """Adds ``kb_<kind>_<n>m`` from the index ``months_lag`` months before the row's month.

    A district without its own series uses its parent region's (first two
    characters of the code unless ``parent`` says otherwise).
    """
    parent = F.substring("gu", 1, 2) if parent is None else parent
    changes = observed_index(index, kinds, months)
    wide = changes.groupBy(F.col("gu").alias("_gu"), F.col("period").alias("_period")).agg(
        *[
            F.max(F.when(F.col("kind") == k, F.col(f"change_{n}m"))).alias(f"kb_{k}_{n}m")
            for k in kinds
            for n in months
        ]
    )
    known = index.select(F.col("gu").alias("_own")).distinct()
    keyed = (
        frame.join(known, F.col("gu") == F.col("_own"), "left")
        .withColumn("_gu", F.coalesce("_own", parent))
        .withColumn("_period", F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -months_lag))
    )
    return keyed.join(wide, ["_gu", "_period"], "left").drop("_own", "_gu", "_period")


def frozen_features(targets: DataFrame, trades: DataFrame, lag: Lag, first: str, last: str, span: int) -> DataFrame:
    """Anchors of a valuation refreshed only every ``span`` months (first in March).

    Adds ``refresh`` (the origin used) and ``frozen_anchor`` so that the same
    trades can be compared under monthly and frozen inputs.
    """
    month = F.to_date(F.concat("month", F.lit("-01")))
    block = F.floor((F.month(month) - 3) / span) * span + 3
    keyed = targets.withColumn("refresh", F.make_date(F.year(month), block.cast("int"), F.lit(1)))
    # Only months 3, 3+span, 6+span... are ever refreshed.
    keyed = stored(keyed)
    trades = stored(trades.select("key", "complex", "peer", "date", "log_price"))
    # Where the same months of every year are refreshed, the other origins are never made.
    grid = (span, 2 % span) if 12 % span == 0 else (1, 0)
    refreshed = (F.month("origin") >= 3) & ((F.month("origin") - 3) % span == 0)
    used = keyed.select(F.col("refresh").alias("origin"), "key").distinct()
    keys_crowd = crowded(trades, ["key"])
    few, many = served_of(trades if keys_crowd is None else trades.join(keys_crowd, "key", "left_anti"), used, lag, first, last, *grid), None
    if keys_crowd is not None:
        many = history_join(trades.join(keys_crowd, "key", "left_semi"), lag, first, last, *grid).join(used, ["origin", "key"], "left_semi")
    own = own_stats(few, many, keys_crowd, "log_price", {"ew90": Quantile(0.5, "e90", linear=False)}, {"e90": recency_weight(90)}).select("origin", "key", "ew90")
    around = pools_of(trades, lag, first, last, *grid, origins=refreshed)
    scope = lambda s: around.where(F.col("scope") == s).select(
        F.col("origin").alias("refresh"), F.col("id").alias(s), F.col("pool90").alias(f"_{s}90"), F.col("pool365").alias(f"_{s}365")
    )
    joined = (
        keyed.join(own.select(F.col("origin").alias("refresh"), "key", F.col("ew90").alias("_ew90")), ["refresh", "key"], "left")
        .join(scope("complex"), ["refresh", "complex"], "left")
        .join(scope("peer"), ["refresh", "peer"], "left")
    )
    chain = ["_ew90", "_complex90", "_complex365", "_peer90", "_peer365"]
    return joined.withColumn("frozen_anchor", F.coalesce(*chain)).drop(*chain)
