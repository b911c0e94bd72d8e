"""Region and type summaries over {each year, all years}."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.operators.stats import Quantile, crowded, quantiles, quantiles_of
from pricetide.session import stored

SQM_PER_PYEONG = 3.3058

METRICS = ("price_billion", "area_pyeong", "price_per_pyeong")


def price_metrics(df: DataFrame, price: str = "price", area: str = "area", land: str | None = None) -> DataFrame:
    """Price in 억, area in 평 and price per 평; null unless both inputs are positive and finite."""
    p, a = F.col(price).cast("double"), F.col(area).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = finite(p) & finite(a) & (p > 0) & (a > 0)
    pyeong = a / SQM_PER_PYEONG
    out = df.withColumns(
        {
            "price_billion": F.when(usable, p / 10000),
            "area_pyeong": F.when(usable, pyeong),
            "price_per_pyeong": F.when(usable, p / pyeong),
        }
    )
    if land is None:
        return out
    share = F.col(land).cast("double")
    known = usable & finite(share) & (share != 0)
    land_pyeong = share / SQM_PER_PYEONG
    return out.withColumns(
        {
            "land_pyeong": F.when(known, land_pyeong),
            "land_ratio": F.when(known, share / a),
            "land_efficiency": F.when(known, land_pyeong / (p / 10000)),
        }
    )


def with_buckets(df: DataFrame, year: str = "year") -> DataFrame:
    """Two copies per row: its own year and the bucket ``all``."""
    return df.withColumn("bucket", F.explode(F.array(F.col(year).cast("string"), F.lit("all"))))


def _to_buckets(counted: DataFrame) -> DataFrame:
    return with_buckets(counted).drop("year")


def _placed(df: DataFrame, region: Sequence[str]) -> DataFrame:
    """The region's columns as one value, which is known and joins even where a column isn't."""
    return df.withColumn("_region", F.struct(*region))


def metric_summary(df: DataFrame, region: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Long form: region, bucket, metric, n, avg, median, min, max.

    Everything is counted once per region, year and value; ``all`` adds up the years.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    long = _placed(df, region).select("_region", "year", F.inline(pairs)).where(F.col("value").isNotNull())
    finer, keys = ["_region", "year", "metric"], ["_region", "bucket", "metric"]
    years = long.groupBy(*finer).agg(F.sum("value").alias("_s"), F.count("*").alias("_c"), F.min("value").alias("min"), F.max("value").alias("max"))
    plain = _to_buckets(years).groupBy(*keys).agg((F.sum("_s") / F.sum("_c")).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"))
    mids = quantiles(long, keys, "value", {"median": Quantile(0.5)}, counted_by=finer, fan=_to_buckets)
    both = plain.join(mids.select(*keys, F.col("total_one").alias("n"), "median"), keys)
    return both.select(*[F.col("_region")[c].alias(c) for c in region], *[c for c in both.columns if c != "_region"])


def region_summary(trades: DataFrame, region: Sequence[str] = ("sido", "gu", "dong")) -> DataFrame:
    """Count and avg/median/min/max of the three price metrics per region and bucket."""
    return metric_summary(price_metrics(trades), region)


@dataclass(frozen=True)
class Attributes:
    """How observations of one type merge; every rule is a minimum or maximum of a state, so parts merge in any order.

    ``nearest`` maps a distance to the columns that the smallest one carries,
    ``largest`` an amount to those of the largest; ties go to the first row.
    ``smallest`` are distances alone.  ``first_known`` are taken from the first
    row that has them, empty text being unknown.  ``order`` says what is first.
    """

    order: Sequence[str] = ("date", "price", "floor")
    nearest: Mapping[str, Sequence[str]] = field(default_factory=dict)
    largest: Mapping[str, Sequence[str]] = field(default_factory=dict)
    smallest: Sequence[str] = ()
    any_true: Sequence[str] = ()
    first_known: Sequence[str] = ("built",)

    def states(self, kinds: Mapping[str, str]) -> dict[str, Column]:
        """Aggregates over rows."""
        position = F.struct(*self.order)
        known = lambda c: F.col(c).isNotNull() & ((F.trim(c) != "") if kinds[c] == "string" else F.lit(True))
        held = lambda cols: F.struct(*[F.col(c) for c in cols]) if cols else F.lit(0)
        out = {}
        for c, carried in self.nearest.items():
            out[f"_near_{c}"] = F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), position.alias("p"), held(carried).alias("c"))))
        for c, carried in self.largest.items():
            out[f"_most_{c}"] = F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("v"), position.alias("p"), held(carried).alias("c"))))
        out |= {f"_least_{c}": F.min(c) for c in self.smallest}
        out |= {f"_any_{c}": F.max(F.col(c)) for c in self.any_true}
        out |= {f"_first_{c}": F.min(F.when(known(c), F.struct(position.alias("p"), F.col(c).alias("v")))) for c in self.first_known}
        return out

    def columns(self) -> set[str]:
        """All columns that the rules read."""
        carried = [c for cols in (*self.nearest.values(), *self.largest.values()) for c in cols]
        return {*self.order, *self.nearest, *self.largest, *self.smallest, *self.any_true, *self.first_known, *carried}

    def merged(self) -> dict[str, Column]:
        """The same aggregates over states."""
        low = [*[f"_near_{c}" for c in self.nearest], *[f"_most_{c}" for c in self.largest], *[f"_least_{c}" for c in self.smallest], *[f"_first_{c}" for c in self.first_known]]
        return {c: F.min(c) for c in low} | {f"_any_{c}": F.max(f"_any_{c}") for c in self.any_true}

    def values(self) -> dict[str, Column]:
        """The attributes that states stand for."""
        out = {}
        for c, carried in self.nearest.items():
            out |= {c: F.col(f"_near_{c}")["v"]} | {x: F.col(f"_near_{c}")["c"][x] for x in carried}
        for c, carried in self.largest.items():
            out |= {c: -F.col(f"_most_{c}")["v"]} | {x: F.col(f"_most_{c}")["c"][x] for x in carried}
        out |= {c: F.col(f"_least_{c}") for c in self.smallest} | {c: F.col(f"_any_{c}") for c in self.any_true}
        return out | {c: F.col(f"_first_{c}")["v"] for c in self.first_known}


def merge_attributes(rows: DataFrame, keys: Sequence[str], rules: Attributes) -> DataFrame:
    """Attribute merge over duplicate observations of one type."""
    states = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in rules.states(dict(rows.dtypes)).items()])
    return states.select(*keys, *[c.alias(n) for n, c in rules.values().items()])


def type_summary(trades: DataFrame, region: Sequence[str] = ("gu", "dong"), attributes: Attributes = Attributes()) -> DataFrame:
    """One row per region, bucket and type: counts, price and floor statistics, merged attributes.

    Counts and attribute states are kept per year and merged into ``all``.  Rows are stored once and move to their type before states
    are made of them, as states are several times as wide; years and buckets of a type then meet where they are.
    """
    finer, keys = ["_region", "year", "key"], ["_region", "bucket", "key"]
    read = {"year", "key", "complex", "floor", "price", *attributes.columns()}
    trades = stored(_placed(trades, region).select("_region", *[c for c in trades.columns if c in read]))
    states = attributes.states(dict(trades.dtypes))
    crowd = crowded(trades, ["_region", "key"])

    def to_types(rows: DataFrame) -> DataFrame:
        return rows.repartition("_region", "key")

    # Rows of a crowded type stay where they are until their states are made.
    parts = [to_types(trades)] if crowd is None else [to_types(trades.join(crowd, crowd.columns, "left_anti")), trades.join(crowd, crowd.columns, "left_semi")]
    aggregates = [
        F.min("complex").alias("complex"),
        F.count("*").alias("n"),
        F.count("floor").alias("floor_n"),
        F.min("floor").alias("floor_min"),
        F.max("floor").alias("floor_max"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        *[c.alias(n) for n, c in states.items()],
    ]
    add = {"n": F.sum, "floor_n": F.sum, "complex": F.min, "floor_min": F.min, "floor_max": F.max, "price_min": F.min, "price_max": F.max}

    def summed(rows: DataFrame) -> DataFrame:
        years = rows.groupBy(*finer).agg(*aggregates)
        return _to_buckets(years).groupBy(*keys).agg(*[f(c).alias(c) for c, f in add.items()], *[c.alias(n) for n, c in attributes.merged().items()])

    merged = reduce(DataFrame.unionByName, map(summed, parts))
    merged = merged.select(*keys, *add, *[c.alias(n) for n, c in attributes.values().items()])
    pairs = F.array(
        F.struct(F.lit("price").alias("what"), F.col("price").alias("value")),
        F.struct(F.lit("floor").alias("what"), F.col("floor").alias("value")),
    )
    long = [rows.select(*finer, F.inline(pairs)) for rows in (part.select(*finer, "price", "floor") for part in parts)]
    # Values of an unknown year are in no median, not of ``all`` either.
    medians = quantiles_of(_to_buckets(long[0].where(F.col("year").isNotNull())), [*keys, "what"], "value", {"m": Quantile(0.5)})
    if crowd is not None:
        medians = medians.unionByName(quantiles(long[1], [*keys, "what"], "value", {"m": Quantile(0.5)}, counted_by=[*finer, "what"], fan=_to_buckets))
    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("m"))).alias(f"{what}_median")
    # A type without any known price or floor keeps its row.
    both = merged.join(medians.groupBy(*keys).agg(pick("price"), pick("floor")), keys, "left")
    return both.select(*[F.col("_region")[c].alias(c) for c in region], *[c for c in both.columns if c != "_region"])


def recent(trades: DataFrame, n: int, region: Sequence[str] = ("gu", "dong"), tie: Sequence[str] = ()) -> DataFrame:
    """The latest ``n`` contracts per region and bucket.

    A row-number filter lets Spark cut each task's rows to ``n`` per group
    before the shuffle, so a hot region never travels whole.
    """
    order = [F.col("date").desc(), *[F.col(c).desc() for c in tie]]
    w = Window.partitionBy(*region, "bucket").orderBy(*order)
    return with_buckets(trades).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def fill_from_complex(types: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Give a type the attributes its complex is known to have.

    Missing built year comes from the first sibling (by key) that has one;
    missing school, subway and bus values from the nearest sibling, missing
    education facilities from the sibling with the most.
    """
    near = lambda cols, distance: F.min(
        F.when(F.col(distance).isNotNull(), F.struct(F.col(distance), F.col("key"), *[F.col(c) for c in cols]))
    )
    best = types.groupBy(*scope).agg(
        F.min(F.when(F.col("built").isNotNull(), F.struct("key", "built"))).alias("_built"),
        near(["school_name", "school_500m"], "school_m").alias("_school"),
        near(["subway_station"], "subway_m").alias("_subway"),
        F.min("bus_m").alias("_bus"),
        F.min(
            F.when(
                F.col("education_n").isNotNull(),
                F.struct((-F.col("education_n")).alias("less"), F.col("key"), F.col("education_n"), F.col("education")),
            )
        ).alias("_education"),
    )
    no_school, no_subway = F.col("school_m").isNull(), F.col("subway_m").isNull()
    no_education = F.col("education_n").isNull()
    take = lambda missing, source, field: F.when(missing, F.col(source)[field]).otherwise(F.col(field))
    return (
        types.join(best, list(scope), "left")
        .withColumns(
            {
                "built": F.coalesce("built", F.col("_built")["built"]),
                "school_name": take(no_school, "_school", "school_name"),
                "school_500m": take(no_school, "_school", "school_500m"),
                "school_m": take(no_school, "_school", "school_m"),
                "subway_station": take(no_subway, "_subway", "subway_station"),
                "subway_m": take(no_subway, "_subway", "subway_m"),
                "bus_m": F.coalesce("bus_m", "_bus"),
                "education": take(no_education, "_education", "education"),
                "education_n": take(no_education, "_education", "education_n"),
            }
        )
        .drop("_built", "_school", "_subway", "_bus", "_education")
    )


def metric_by_region(types: DataFrame, region: Sequence[str], metric: str) -> DataFrame:
    """Dashboard value per region: rates and scores average plainly, counts add up, the rest is trade-weighted."""
    if metric == "count":
        value = F.sum("n")
    elif metric in ("yoy_rate", "score"):
        value = F.avg(metric)
    else:
        weight = F.when(F.col(metric).isNotNull(), F.greatest(F.col("n"), F.lit(1)))
        value = F.try_divide(F.sum(F.col(metric) * weight), F.sum(weight))
    return types.groupBy(*region).agg(value.alias("value"))


def market_context(index: DataFrame, months: Sequence[int] = (1, 3, 6, 12)) -> DataFrame:
    """Percent change of the latest period of each region and kind against n months before.

    ``period`` is the first day of a month.  A missing comparison month raises.
    """
    latest = index.agg(F.max("period").alias("latest"))
    wanted = F.explode(F.array(*[F.lit(m) for m in months])).alias("months")
    now = index.join(latest, F.col("period") == F.col("latest")).select(
        "gu", "kind", "period", F.col("value").alias("now"), wanted
    )
    then = index.select("gu", "kind", F.col("period").alias("_then"), F.col("value").alias("before"))
    pairs = now.withColumn("_then", F.add_months("period", -F.col("months"))).join(then, ["gu", "kind", "_then"], "left")
    checked = F.when(F.col("before").isNull(), F.raise_error(F.lit("missing comparison month"))).otherwise(
        (F.col("now") / F.col("before") - 1) * 100
    )
    return pairs.select("gu", "kind", F.date_format("period", "yyyy-MM").alias("period"), "months", checked.alias("change_pct"))
