"""Exact order statistics and ranks that never put one group in one task.

A grouped median is the operator this package needs most, and the place where
one hot group hurts most.  ``percentile`` keeps every distinct value of a group
in one aggregation buffer; here the group is cut into value bins instead:

1. rows are counted per (group, bin, value), so copies collapse map-side;
2. a small histogram per group gives each bin the weight that lies below it
   and names the few bins that hold a wanted statistic;
3. the values of such a bin, often a few per cent of a hot group, are cut
   again into parts of equal width between its smallest and largest value, and
   a second histogram names the parts that hold a wanted statistic;
4. inside those parts cumulative weights are taken and shifted by the offset;
5. each statistic is the smallest value whose cumulative weight reaches its
   target, which is a map-side combinable ``min``.

The bin is a fixed order-preserving function of the value, so a group has at
most about 26,000 bins, and a bin at most 4,096 parts, whatever its row count.
The same pass serves any number of statistics and weightings over one value
column.

Weights are whole numbers or decimals from end to end, never doubles, so sums
don't depend on the order of rows.  Where a caller has counted its groups,
:func:`quantiles_of` sends the crowded ones this way and the others, whose rows
one task may order, through a single shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.session import durable, stored

BINS_PER_E_FOLD = 256
PARTS_PER_BIN = 4096
# Rows that one task may order on behalf of a group.
CROWD = 1_000_000
WEIGHT = "decimal(38,24)"
# Quotients such as 1/3 end at 24 places; sums of them reach a target that they miss by less than this.
SLACK = Decimal("1e-15")


def exact_weight(df: DataFrame, weight: Column) -> Column:
    """A weight that sums without rounding: whole numbers as long, others as decimals; null counts as 0."""
    kind = df.select(weight.alias("w")).dtypes[0][1]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(weight.cast("bigint" if whole else WEIGHT), F.lit(0).cast("bigint" if whole else WEIGHT))


def value_bin(value: Column) -> Column:
    """Order-preserving bin: about 0.4 % of the value's magnitude wide."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * 1e4) * BINS_PER_E_FOLD)


def value_part(value: Column, low: Column, high: Column) -> Column:
    """Order-preserving part of a bin whose values lie between low and high."""
    at = F.floor((value - low) / (high - low) * PARTS_PER_BIN)
    return F.when(high > low, F.least(at, F.lit(PARTS_PER_BIN - 1))).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Quantile:
    """One requested statistic.

    ``weight`` names an entry of the weights mapping (default: every row 1).
    ``linear`` interpolates between neighbouring rows as numpy and SQL's
    quantile_cont do; otherwise the result is the first value whose cumulative
    weight reaches ``q`` of the total.
    """

    q: float
    weight: str = "one"
    linear: bool = True
    min_weight: float = 0.0


Target = Callable[[Column], Column]


def _holds(picks: Mapping[str, tuple[str, Target]]) -> Column:
    """Whether a slice of weight _h after an offset of _o holds a wanted statistic."""
    found = F.lit(False)
    for w, target in picks.values():
        total, low = F.col(f"_t_{w}"), F.col(f"_o_{w}")
        wanted = target(total)
        found = found | ((total > 0) & (low < wanted) & (low + F.col(f"_h_{w}") >= wanted))
    return found


def _weighted(df: DataFrame, groups: Sequence[str], value: str | Column, used: Sequence[str], weights: Mapping[str, Column] | None,
              extra: Sequence[str] = ()) -> DataFrame:
    """Groups, ``_v`` and the weights, without rows that count nowhere."""
    value = F.col(value) if isinstance(value, str) else value
    weights = {"one": F.lit(1), **(weights or {})}
    base = df.select(*groups, *extra, value.cast("double").alias("_v"), *[exact_weight(df, weights[w]).alias(f"_w_{w}") for w in used])
    # Spelling out every null check keeps the two reads of `counted` identical,
    # so the second one reuses the first one's shuffle.
    present = F.col("_v").isNotNull() & ~F.isnan("_v")
    for g in groups:
        present = present & F.col(g).isNotNull()
    base = base.where(present)
    if "one" not in used:
        some = F.lit(False)
        for w in used:
            some = some | (F.col(f"_w_{w}") > 0)
        base = base.where(some)
    return base


def _reached(picks: Mapping[str, tuple[str, Target]]) -> list[Column]:
    """Per pick the smallest value whose cumulative weight _c reaches the target of the total _t."""
    found = []
    for name, (w, target) in picks.items():
        total = F.col(f"_t_{w}")
        found.append(F.min(F.when((total > 0) & (F.col(f"_c_{w}") >= target(total)), F.col("_v"))).alias(name))
    return found


def order_statistics(
    df: DataFrame,
    groups: Sequence[str],
    value: str | Column,
    picks: Mapping[str, tuple[str, Target]],
    weights: Mapping[str, Column] | None = None,
    counted_by: Sequence[str] | None = None,
    fan: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Groups, ``total_<weight>`` and, per pick, the value reaching its target.

    Rows whose group or value is null are left out.  A pick is null where its
    weight totals 0.  Rows that belong to several groups are counted once by
    the finer columns ``counted_by``; ``fan`` then gives a row its groups.
    """
    used = sorted({w for w, _ in picks.values()})
    groups = list(groups)
    finer = groups if counted_by is None else list(counted_by)
    # Rows may come dealt out by their bins already.
    dealt = ["_bin"] if "_bin" in df.columns else []
    base = _weighted(df, finer, value, used, weights, dealt)
    base = base if dealt else base.withColumn("_bin", value_bin(F.col("_v")))
    zero = {w: F.lit(0).cast(base.schema[f"_w_{w}"].dataType) for w in used}
    counted = base.groupBy(*finer, "_bin", "_v").agg(
        *[F.sum(f"_w_{w}").cast(base.schema[f"_w_{w}"].dataType).alias(f"_w_{w}") for w in used]
    )
    slices = [*[F.sum(f"_w_{w}").alias(f"_h_{w}") for w in used], F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    histogram = counted.groupBy(*finer, "_bin").agg(*slices)
    if counted_by is not None:
        merged = [*[F.sum(f"_h_{w}").alias(f"_h_{w}") for w in used], F.min("_low").alias("_low"), F.max("_high").alias("_high")]
        histogram = fan(histogram).groupBy(*groups, "_bin").agg(*merged)
        counted = fan(counted)
    below = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    bins = histogram.select(
        *groups,
        "_bin",
        "_low",
        "_high",
        *[F.coalesce(F.sum(f"_h_{w}").over(below), zero[w]).alias(f"_o_{w}") for w in used],
        *[F.sum(f"_h_{w}").over(whole).alias(f"_t_{w}") for w in used],
        *[f"_h_{w}" for w in used],
    )
    bins = bins.where(_holds(picks)).drop(*[f"_h_{w}" for w in used])
    # Of rows dealt out by bins, only those of wanted bins move again: a few bins for each crowded group.
    held = F.broadcast(bins) if dealt else bins
    inside = counted.join(held, [*groups, "_bin"]).withColumn("_part", value_part(F.col("_v"), F.col("_low"), F.col("_high")))
    slim = inside.groupBy(*groups, "_bin", "_part").agg(
        *[F.sum(f"_w_{w}").alias(f"_h_{w}") for w in used],
        *[F.max(f"_{x}_{w}").alias(f"_{x}_{w}") for w in used for x in "ot"],
    )
    before = Window.partitionBy(*groups, "_bin").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = slim.withColumns({f"_o_{w}": F.col(f"_o_{w}") + F.coalesce(F.sum(f"_h_{w}").over(before), zero[w]) for w in used})
    parts = parts.where(_holds(picks)).drop(*[f"_h_{w}" for w in used])
    last = Window.partitionBy(*groups, "_bin", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    chosen = inside.select(*groups, "_bin", "_part", "_v", *[f"_w_{w}" for w in used]).join(parts, [*groups, "_bin", "_part"])
    cumulative = chosen.select(
        *groups,
        "_v",
        *[(F.col(f"_o_{w}") + F.sum(f"_w_{w}").over(last)).alias(f"_c_{w}") for w in used],
        *[f"_t_{w}" for w in used],
    )
    return cumulative.groupBy(*groups).agg(*[F.max(f"_t_{w}").alias(f"total_{w}") for w in used], *_reached(picks))


def ordered_statistics(
    df: DataFrame,
    groups: Sequence[str],
    value: str | Column,
    picks: Mapping[str, tuple[str, Target]],
    weights: Mapping[str, Column] | None = None,
    also: Sequence[Column] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """:func:`order_statistics` for groups that one task may order: one shuffle by group, one sort, running sums.

    ``also`` are further aggregates, which may read the ``extra`` columns.
    """
    used = sorted({w for w, _ in picks.values()})
    base = _weighted(df, groups, value, used, weights, extra)
    whole = Window.partitionBy(*groups)
    # Equal values need no common rank: the smallest value that reaches the target is the same.
    upto = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_c_{w}": F.sum(f"_w_{w}").over(upto) for w in used} | {f"_t_{w}": F.sum(f"_w_{w}").over(whole) for w in used}
    return base.withColumns(sums).groupBy(*groups).agg(*[F.max(f"_t_{w}").alias(f"total_{w}") for w in used], *_reached(picks), *also)


def _picks(wanted: Mapping[str, Quantile]) -> dict[str, tuple[str, Target]]:
    picks: dict[str, tuple[str, Target]] = {}
    for name, spec in wanted.items():
        if spec.linear:
            picks[f"_lo_{name}"] = (spec.weight, lambda n, q=spec.q: F.floor((n - 1) * q) + 1)
            picks[f"_hi_{name}"] = (spec.weight, lambda n, q=spec.q: F.ceil((n - 1) * q) + 1)
        else:
            picks[name] = (spec.weight, lambda n, q=spec.q: n * F.lit(Decimal(str(q))) - F.lit(SLACK))
    return picks


def _between(stats: DataFrame, groups: Sequence[str], wanted: Mapping[str, Quantile], more: Sequence[str] = ()) -> DataFrame:
    columns: list[Column] = [F.col(g) for g in groups]
    columns += [F.col(c) for c in stats.columns if c.startswith("total_")]
    for name, spec in wanted.items():
        total = F.col(f"total_{spec.weight}")
        if spec.linear:
            lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            position = (total - 1) * spec.q
            result = lo + (hi - lo) * (position - F.floor(position))
        else:
            result = F.col(name)
        if spec.min_weight > 0:
            result = F.when(total >= spec.min_weight, result)
        columns.append(result.alias(name))
    return stats.select(*columns, *more)


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str | Column,
    wanted: Mapping[str, Quantile],
    weights: Mapping[str, Column] | None = None,
    counted_by: Sequence[str] | None = None,
    fan: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Exact grouped quantiles; see :class:`Quantile`.  Keeps ``total_*``."""
    return _between(order_statistics(df, groups, value, _picks(wanted), weights, counted_by, fan), groups, wanted)


def crowded(df: DataFrame, by: Sequence[str], most: int = CROWD) -> DataFrame | None:
    """The values of ``by`` that more than ``most`` rows have, or None without any.

    A table of rows / ``most`` rows at most.
    """
    found = stored(df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*by))
    return None if found.isEmpty() else found


def quantiles_of(
    df: DataFrame,
    groups: Sequence[str],
    value: str | Column,
    wanted: Mapping[str, Quantile],
    weights: Mapping[str, Column] | None = None,
    crowd: DataFrame | None = None,
) -> DataFrame:
    """:func:`quantiles` where the rows of ``crowd`` name the groups, by some of their columns, that no task may order.

    All other groups take one shuffle.
    """
    return quantiles_with(df, groups, value, wanted, weights, (), (), crowd)


def quantiles_with(
    df: DataFrame,
    groups: Sequence[str],
    value: str | Column,
    wanted: Mapping[str, Quantile],
    weights: Mapping[str, Column] | None = None,
    also: Sequence[Column] = (),
    extra: Sequence[str] = (),
    crowd: DataFrame | None = None,
) -> DataFrame:
    """:func:`quantiles_of` with further aggregates ``also`` over the ``extra`` columns of the rows with a value."""
    groups = list(groups)

    def ordered(rows: DataFrame) -> DataFrame:
        stats = ordered_statistics(rows, groups, value, _picks(wanted), weights, also, extra)
        known = {*groups, *(c for c in stats.columns if c.startswith("total_")), *_picks(wanted)}
        return _between(stats, groups, wanted, [c for c in stats.columns if c not in known])

    if crowd is None:
        return ordered(df)
    by = crowd.columns
    hot = df.join(crowd, by, "left_semi")
    many = quantiles(hot, groups, value, wanted, weights)
    if also:
        many = many.join(hot.where((F.col(value) if isinstance(value, str) else value).isNotNull()).groupBy(*groups).agg(*also), groups)
    return ordered(df.join(crowd, by, "left_anti")).unionByName(many)


def median(df: DataFrame, groups: Sequence[str], value: str | Column, out: str = "median") -> DataFrame:
    """Groups, ``n`` (rows with a value) and the exact median."""
    stats = quantiles(df, groups, value, {out: Quantile(0.5)})
    return stats.select(*groups, F.col("total_one").cast("long").alias("n"), out)


def median_of(df: DataFrame, groups: Sequence[str], value: str | Column, out: str, crowd: DataFrame | None) -> DataFrame:
    """:func:`median` where ``crowd`` names the groups that no task may order; see :func:`quantiles_of`."""
    stats = quantiles_of(df, groups, value, {out: Quantile(0.5)}, crowd=crowd)
    return stats.select(*groups, F.col("total_one").cast("long").alias("n"), out)


def leave_one_out_median(
    df: DataFrame, group: Sequence[str], value: str, out: str, min_others: int = 1
) -> DataFrame:
    """Adds the median of the *other* rows of the group, without any pairing.

    Removing one element moves the median to a neighbouring order statistic,
    so three order statistics per group answer the question for every row.
    Rows whose value is null are not part of the pool and see all of it.
    """
    half = lambda n: F.floor(n / 2)
    pool = order_statistics(
        df,
        group,
        value,
        {
            "_a": ("one", lambda n: F.greatest(half(n), F.lit(1))),
            "_b": ("one", lambda n: half(n) + 1),
            "_c": ("one", lambda n: F.least(half(n) + 2, n)),
        },
    ).withColumnRenamed("total_one", "_n")
    v, n = F.col(value), F.col("_n")
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    even = (n % 2) == 0
    # n even: n-1 others, the middle one is b unless the removed row lies above a.
    # n odd: n-1 others, average of the two middle ones after the removal.
    others = (
        F.when(v.isNull() & even, (a + b) / 2)
        .when(v.isNull(), b)
        .when(even, F.when(v <= a, b).otherwise(a))
        .otherwise((F.when(v <= a, b).otherwise(a) + F.when(v <= b, c).otherwise(b)) / 2)
    )
    left = F.coalesce(n, F.lit(0)) - F.when(v.isNull(), 0).otherwise(1)
    joined = df.join(pool, list(group), "left")
    return joined.withColumn(out, F.when(left >= min_others, others)).drop("_n", "_a", "_b", "_c")


def ranked(df: DataFrame, order: Sequence[Column], out: str = "rank", total: str | None = None) -> DataFrame:
    """Row number over the whole table in a total order, without a single-task window.

    The frame is range-sorted, pinned with a reliable checkpoint so both reads
    see the same placement, and numbered inside each partition; the offsets
    table has one row per partition, so broadcasting it is bounded.
    """
    pinned = durable(
        df.orderBy(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    parts = pinned.groupBy("_pid").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_pid",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(everything).alias("_total"),
    )
    numbered = pinned.join(F.broadcast(offsets), "_pid").withColumn(
        out, F.col("_offset") + F.col("_at") - F.col("_first") + 1
    )
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop("_pid", "_at", "_first", "_offset", "_total")


def ranked_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str = "rank", total: str | None = None
) -> DataFrame:
    """Row number inside each group; a hot group is spread over many tasks."""
    numbered = ranked(df, [*[F.col(g).asc() for g in groups], *order], "_global")
    firsts = numbered.groupBy(*groups).agg(F.min("_global").alias("_start"), F.count("*").alias("_size"))
    result = numbered.join(firsts, list(groups)).withColumn(out, F.col("_global") - F.col("_start") + 1)
    if total:
        result = result.withColumn(total, F.col("_size"))
    return result.drop("_global", "_start", "_size")


def average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank among equal values (ascending), and ``<out>_n`` = rows ranked."""
    groups = list(groups)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value_bin(F.col(value)).alias("_bin"), F.col(value))
        .agg(F.count("*").alias("_c"))
    )
    v = F.col(value)
    histogram = counted.groupBy(*groups, "_bin").agg(F.sum("_c").alias("_h"), F.min(v).alias("_low"), F.max(v).alias("_high"))
    below = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = histogram.select(
        *groups,
        "_bin",
        "_low",
        "_high",
        F.coalesce(F.sum("_h").over(below), F.lit(0)).alias("_o"),
        F.sum("_h").over(Window.partitionBy(*groups)).alias(f"{out}_n"),
    )
    inside = counted.join(bins, [*groups, "_bin"]).withColumn("_part", value_part(v, F.col("_low"), F.col("_high")))
    slim = inside.groupBy(*groups, "_bin", "_part").agg(
        F.sum("_c").alias("_h"), F.max("_o").alias("_o"), F.max(f"{out}_n").alias(f"{out}_n")
    )
    before = Window.partitionBy(*groups, "_bin").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = slim.select(
        *groups, "_bin", "_part", f"{out}_n", (F.col("_o") + F.coalesce(F.sum("_h").over(before), F.lit(0))).alias("_o")
    )
    last = Window.partitionBy(*groups, "_bin", "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.select(*groups, "_bin", "_part", value, "_c").join(parts, [*groups, "_bin", "_part"])
    ranks = placed.select(
        *groups,
        value,
        (F.col("_o") + F.sum("_c").over(last) - (F.col("_c") - 1) / 2).alias(out),
        f"{out}_n",
    )
    return df.join(ranks, [*groups, value], "left")
