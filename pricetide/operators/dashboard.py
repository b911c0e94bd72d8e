"""The dashboard's query surface: facets, rankings, lists, paging and comparison sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.parsing import present
from pricetide.operators import summary
from pricetide.operators.stats import Quantile, order_statistics, quantiles, ranked
from pricetide.session import stored


@dataclass(frozen=True)
class Facets:
    """One dashboard filter state.  Empty choices and None bounds do not restrict."""

    sido: Sequence[str] = ()
    gu: Sequence[str] = ()
    dong: Sequence[str] = ()
    area: Sequence[str] = ()
    age: Sequence[str] = ()
    min_price: float | None = None
    max_price: float | None = None
    min_households: int | None = None
    min_trades: int | None = None
    min_score: float | None = None
    elementary_only: bool = False
    subway_lines: Sequence[str] = ()
    subway_minutes: int | None = None
    columns: Mapping[str, str] = field(default_factory=dict)


def facet_filter(types: DataFrame, f: Facets) -> DataFrame:
    """OR inside a facet, AND across facets.  An unknown value fails an active bound and passes an inactive one."""
    c = lambda name: F.col(f.columns.get(name, name))
    keep = F.lit(True)
    for name, chosen in (("sido", f.sido), ("gu", f.gu), ("dong", f.dong), ("area_category", f.area), ("age_category", f.age)):
        if chosen:
            keep = keep & F.coalesce(c(name).isin(*chosen), F.lit(False))
    bounds = (
        ("price", f.min_price, ">="), ("price", f.max_price, "<="), ("households", f.min_households, ">="),
        ("n", f.min_trades, ">="), ("score", f.min_score, ">="),
        ("subway_m", None if f.subway_minutes is None else f.subway_minutes * 80, "<="),
    )
    for name, bound, op in bounds:
        if bound is not None:
            test = c(name) >= bound if op == ">=" else c(name) <= bound
            keep = keep & F.coalesce(test, F.lit(False))
    if f.elementary_only:
        keep = keep & F.coalesce(c("elementary_500m"), F.lit(False))
    if f.subway_lines:
        keep = keep & F.coalesce(F.arrays_overlap(c("subway_lines"), F.array(*[F.lit(x) for x in f.subway_lines])), F.lit(False))
    return types.where(keep)


def search(types: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring over the concatenated columns; an empty query keeps everything."""
    q = text.strip().lower()
    return types if not q else types.where(F.lower(F.concat_ws(" ", *columns)).contains(q))


def distribution(regions: DataFrame, value: str = "value", fixed: tuple[float, float, float] | None = None) -> DataFrame:
    """Minimum, median and maximum of the regions' values; a score uses its fixed scale instead."""
    if fixed is not None:
        return regions.agg(*[F.lit(v).alias(n) for v, n in zip(fixed, ("min", "mid", "max"))])
    keyed = regions.where(F.col(value).isNotNull()).withColumn("_g", F.lit(0))
    mids = quantiles(keyed, ["_g"], value, {"mid": Quantile(0.5)}).select("_g", "mid")
    return keyed.groupBy("_g").agg(F.min(value).alias("min"), F.max(value).alias("max")).join(mids, "_g").drop("_g")


def complex_groups(types: DataFrame, metric: str, scope: Sequence[str] = ("dong", "complex"), area: str = "area_pyeong") -> DataFrame:
    """Types grouped to complexes: type and trade counts, value (sum, best score or weighted mean), latest known built year."""
    if metric == "count":
        value = F.sum("n")
    elif metric == "score":
        value = F.max("score")
    else:
        weight = F.when(F.col(metric).isNotNull(), F.greatest(F.col("n"), F.lit(1)))
        value = F.try_divide(F.sum(F.col(metric) * weight), F.sum(weight))
    # The largest type with a known year speaks for the complex.
    built = F.max_by("built", F.when(F.col("built").isNotNull(), F.struct(F.coalesce(F.col(area), F.lit(-1.0)), F.col("key"))))
    return types.groupBy(*scope).agg(
        F.count("*").alias("type_count"), F.sum("n").alias("n"), value.cast("double").alias("value"), built.alias("latest_built_year")
    )


def ordered(df: DataFrame, keys: Sequence[tuple[str, str]], tie: Sequence[str]) -> DataFrame:
    """Multi-key order; unknown values come last in either direction and ``tie`` makes it total."""
    columns = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in keys]
    return df.orderBy(*columns, *[F.col(t).asc_nulls_last() for t in tie])


def numbered(df: DataFrame, keys: Sequence[tuple[str, str]], tie: Sequence[str], out: str = "position") -> DataFrame:
    """The position each row takes under :func:`ordered`."""
    columns = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in keys]
    return ranked(df, [*columns, *[F.col(t).asc_nulls_last() for t in tie]], out, "total")


# Rows that are ordered as they are, without narrowing them down first.
SMALL = 10_000


def _place(rows: DataFrame, column: str, direction: str, place: int) -> tuple[DataFrame, int]:
    """Rows that share ``column``'s value at a place of its order, and the place among them.

    Numbers and dates are found by histograms, text character by character; unknown values come last.
    """
    kind = dict(rows.dtypes)[column]
    value = F.col(column)
    if kind in ("float", "double"):
        value = F.when(~F.isnan(column), value)
    known = rows.where(value.isNotNull())
    n = known.count()
    if place > n:
        return rows.where(value.isNull()), place - n
    sign = -1 if direction == "desc" else 1
    if kind == "string":
        prefix = ""
        while True:
            step = F.substring(value, len(prefix) + 1, 1)
            heads = known.groupBy(step.alias("c")).agg(F.count("*").alias("n")).collect()  # one row per character
            for c, size in sorted(((r["c"], r["n"]) for r in heads), reverse=sign < 0):
                if place <= size:
                    break
                place -= size
            known = known.where(step == c)
            prefix += c
            if c == "" or size <= SMALL:
                return known, place
    number = (F.unix_date(value) if kind == "date" else F.unix_micros(value) if kind.startswith("timestamp") else value.cast("int") if kind == "boolean" else value) * sign
    found = order_statistics(known.withColumn("_g", F.lit(0)), ["_g"], number, {"v": ("one", lambda total: F.lit(place))}).first()["v"]
    before = known.where(number.cast("double") < found).count()
    return known.where(number.cast("double") == found), place - before


def paginate(df: DataFrame, keys: Sequence[tuple[str, str]], tie: Sequence[str], page: int = 1, size: int = 50) -> DataFrame:
    """Rows of one page with position, page, page_count and total; the page number is clamped into range.

    The page's first row is selected key by key: histograms tell which value
    stands at its place, and only rows with that value are looked at for the
    next key.  The page is then the ``size`` smallest rows from there on, which
    needs no order of the table and no row numbers.  ``tie`` makes the order total.
    """
    order = [*keys, *[(t, "asc") for t in tie]]
    # Every step below reads the rows again.
    df = stored(df)
    total = df.count()
    count = max(1, -(-total // size))
    page = max(1, min(count, page))
    first = (page - 1) * size + 1
    columns = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in order]
    beyond = F.lit(True)
    if first > 1:
        rows, place, left = df, first, total
        for c, d in order:
            if left <= SMALL:
                break
            rows, place = _place(rows, c, d, place)
            left = rows.count()
        # At most SMALL rows, or rows that are all equal, from here on.
        w = Window.partitionBy(F.lit(0)).orderBy(*columns)
        start = rows.select(*[c for c, _ in order]).orderBy(*columns).limit(place).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == place).first()
        for c, d in reversed(order):
            value = start[c]
            if value is None:  # Unknown values are last: nothing comes after them.
                after, same = F.lit(False), F.col(c).isNull()
            else:
                after = (F.col(c) < F.lit(value)) if d == "desc" else (F.col(c) > F.lit(value))
                after, same = F.coalesce(after, F.lit(True)), F.coalesce(F.col(c) == F.lit(value), F.lit(False))
            beyond = after | (same & beyond)
    rows = df.where(beyond).orderBy(*columns).limit(size)
    # One page of rows is numbered.
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*columns)) + (first - 1)
    return rows.withColumns({"position": at.cast("long"), "total": F.lit(total).cast("long"), "page_count": F.lit(count).cast("long"), "page": F.lit(page).cast("long")})


def page_after(df: DataFrame, after: int, limit: int, budget_bytes: int | None = None, row_no: str = "row_no",
               payload: str = "payload") -> DataFrame:
    """The next rows after a row number, at most ``limit``, cut where the payload budget is used up (never below one row)."""
    rows = df.where(F.col(row_no) > after).orderBy(row_no).limit(limit)
    if budget_bytes is None:
        return rows
    # At most ``limit`` rows reach this running sum.
    w = Window.partitionBy(F.lit(0)).orderBy(row_no).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.octet_length(payload)).over(w)
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(row_no))
    return rows.withColumns({"_used": used, "_first": first}).where((F.col("_used") <= budget_bytes) | (F.col("_first") == 1)).drop("_used", "_first")


def hot_cold(groups: DataFrame, value: str, tie: str, share: float = 0.3) -> DataFrame:
    """First and last ⌈30 %⌉ of the groups with a value, marked hot and cold (a row can be both)."""
    rows = ranked(groups.where(F.col(value).isNotNull()), [F.col(value).desc(), F.col(tie).asc()], "rank", "_n")
    cut = F.greatest(F.lit(1), F.ceil(F.col("_n") * share))
    marks = present(F.when(F.col("rank") <= cut, "hot"), F.when(F.col("rank") > F.col("_n") - cut, "cold"))
    return rows.withColumn("list", F.explode(marks)).drop("_n")


def best_type(types: DataFrame, scope: Sequence[str] = ("dong", "complex"), score: str = "score", carried: Sequence[str] = ()) -> DataFrame:
    """One row per complex: its best-scored type (ties: smaller key; unknown scores last) and all matching areas."""
    rank = F.struct((-F.coalesce(F.col(score), F.lit(-1.0))).alias("s"), F.col("key"))
    return types.groupBy(*scope).agg(
        F.min_by(F.struct("key", score, *carried), rank).alias("_b"), F.array_sort(F.collect_set("area")).alias("areas")
    ).select(*scope, "_b.*", "areas")


# Name that enters the hash (fixed value).
HASH_CHOICE = "random_hold_v1"


def hash_choice(df: DataFrame, scope: Sequence[str], seed: int, date: Column, key: str) -> DataFrame:
    """Reproducible random pick per scope: the smallest hash of (seed, date, id).  Scores never influence it."""
    digest = F.sha2(F.concat_ws("|", F.lit(HASH_CHOICE), F.lit(str(seed)), date.cast("string"), F.col(key).cast("string")), 256)
    return df.groupBy(*scope).agg(F.min(F.struct(digest.alias("h"), F.col(key))).alias("_c")).select(*scope, F.col("_c")[key].alias(key))


def type_yoy(history: DataFrame, completed_before: int, min_trades: int = 3) -> DataFrame:
    """Percent change of a type against the year listed before, both with 3 trades, only for completed years.

    ``history``: region columns gu, dong, key, year, n, price_per_pyeong.
    """
    years = history.select("year").distinct()
    # The list of years is as long as the history, a few dozen rows at most.
    listed = years.withColumn("previous", F.lag("year").over(Window.partitionBy(F.lit(0)).orderBy("year")))
    now = history.where(F.col("year") < completed_before).join(listed, "year")
    before = history.select(
        "dong", "key", F.col("year").alias("previous"), F.col("n").alias("_n"), F.col("price_per_pyeong").alias("_p")
    )
    joined = now.join(before, ["dong", "key", "previous"])
    enough = (F.col("n") >= min_trades) & (F.col("_n") >= min_trades)
    rate = (F.col("price_per_pyeong") - F.col("_p")) / F.col("_p") * 100
    return joined.where(enough).withColumn("rate", rate).drop("_n", "_p")


def full_period_rate(history: DataFrame, completed_before: int, min_trades: int = 3) -> DataFrame:
    """Percent change of a type from the first to the last completed year, both with 3 trades."""
    done = history.where(F.col("year") < completed_before)
    edge = done.agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
    side = lambda y, suffix: done.where((F.col("year") == y) & (F.col("n") >= min_trades)).select(
        "sido", "gu", "dong", "key", F.col("price_per_pyeong").alias(suffix)
    )
    both = side(edge["a"], "_a").join(side(edge["b"], "_b"), ["sido", "gu", "dong", "key"])
    return both.withColumn("rate", (F.col("_b") - F.col("_a")) / F.col("_a") * 100).drop("_a", "_b")


LEVELS = {"sido": ("sido",), "gu": ("sido", "gu"), "dong": ("sido", "gu", "dong")}


def level_ranking(rates: DataFrame, value: str, scope: Sequence[str] = (), min_value: float | None = None, name: str = "") -> DataFrame:
    """Average per region (dong), then per level: every region weighs the same inside its level.

    One grouping-sets pass produces all three levels.
    """
    regions = rates.groupBy(*scope, "sido", "gu", "dong").agg(F.avg(value).alias("_v")).where(F.col("_v").isNotNull())
    rows = regions.select(
        *scope,
        F.col("_v"),
        F.inline(
            F.array(*[F.struct(F.lit(level).alias("level"), F.concat_ws(" ", *columns).alias("name")) for level, columns in LEVELS.items()])
        ),
    )
    out = rows.groupBy(*scope, "level", "name").agg(F.avg("_v").alias("value"), F.count("*").alias("regions"))
    if min_value is not None:
        out = out.where(F.col("value") >= min_value)
    return search(out, name, ["name"])


def potential_list(rows: DataFrame, districts: Sequence[str] = (), min_price: float | None = None, max_price: float | None = None,
                   area: Sequence[str] = (), top: float = 100, trades: int = 3, stable_only: bool = False, sort: str = "rank") -> DataFrame:
    """Candidate list filter; ``sort`` is rank, price or trades, always ending in the rank."""
    size = F.when(F.col("area") <= 60, "small").when(F.col("area") <= 85, "medium").otherwise("large")
    keep = (F.col("top_percent") <= top) & (F.col("entry_n") >= trades)
    if districts:
        keep = keep & F.col("gu").isin(*districts)
    if min_price is not None:
        keep = keep & (F.col("entry_reference_oku") >= min_price)
    if max_price is not None:
        keep = keep & (F.col("entry_reference_oku") <= max_price)
    if area:
        keep = keep & size.isin(*area)
    if stable_only:
        keep = keep & F.coalesce(F.col("both_top_decile"), F.lit(False))
    first = {"rank": F.col("research_rank").asc(), "price": F.col("entry_reference_oku").asc(), "trades": F.col("entry_n").desc()}[sort]
    return rows.where(keep).withColumn("area_class", size).orderBy(first, F.col("research_rank").asc())


def comparison_sheet(types: DataFrame, year: int, scope: Sequence[str] = ("dong", "complex")) -> DataFrame:
    """One sheet row per complex: attributes and prices of its best-scored type, age, parking per household, areas."""
    carried = ["households", "built", "parking", "price", "p10", "p50", "p90"]
    best = best_type(types, scope, "score", carried)
    return best.withColumns(
        {
            "building_age": F.when(F.col("built").isNotNull(), F.greatest(F.lit(0), F.lit(year) - F.col("built"))),
            "parking_per_household": F.try_divide(F.col("parking").cast("double"), F.col("households")),
        }
    )


PURPOSES = ("station", "school", "bus_stop")


def route_class(df: DataFrame) -> Column:
    """estimate, needs_review or disconnected; only estimates are compared."""
    return (
        F.when(F.col("status") == "disconnected", "disconnected")
        .when(F.col("route_review_status") == "needs_review", "needs_review")
        .otherwise("estimate")
    )


def route_review(routes: DataFrame) -> DataFrame:
    """Per complex: status class and comparable metres of each purpose; stations merge exits of one station name."""
    cls = routes.withColumn("class", route_class(routes))
    metres = F.when(F.col("class") == "estimate", F.col("total_m"))
    rank = F.struct("id")
    aggs = []
    for p in PURPOSES:
        here = F.col("purpose") == p
        aggs += [
            F.max_by("class", F.when(here, rank)).alias(f"{p}_class"),
            F.max_by(metres, F.when(here, rank)).alias(f"{p}_m"),
            F.count_distinct(F.when(here, F.col("destination"))).alias(f"{p}_destinations"),
        ]
    return cls.groupBy("complex_id").agg(*aggs)


def route_counts(routes: DataFrame) -> DataFrame:
    review, broken = F.col("route_review_status") == "needs_review", F.col("status") == "disconnected"
    per = routes.groupBy("complex_id").agg(
        F.count("*").alias("_n"), F.count_if(~broken).alias("_e"), F.count_if(broken).alias("_d"), F.count_if(review).alias("_r"),
        F.count_if(review & ~broken).alias("_re"), F.count_if(~review & ~broken).alias("_c"),
    )
    return per.agg(
        F.count("*").alias("complexes"), F.sum("_n").alias("routes"), F.sum("_e").alias("estimated"), F.sum("_d").alias("disconnected"),
        F.sum("_r").alias("route_review"), F.sum("_re").alias("review_estimated"), F.sum("_c").alias("comparison_estimated"),
    )


def summary_counts(types: DataFrame, scope: Sequence[str] = ("dong", "complex")) -> DataFrame:
    return types.groupBy(*scope).agg(F.sum("n").alias("_n")).agg(F.sum("_n").alias("trades_used"), F.count("*").alias("complexes"))


def eligible_candidates(observations: DataFrame, total_cost: Column, price_cap: int, budget: int, reserve: int, strategy: str = "score") -> DataFrame:
    """Candidates whose price is under the cap and whose cost plus reserve fits the budget, best first per decision date."""
    rows = observations.withColumn("total_krw", total_cost).where(
        (F.col("price_krw") <= price_cap) & (F.col("total_krw") + F.lit(reserve) <= F.lit(budget))
    )
    order = {"score": F.struct((-F.col("score")).alias("a"), F.col("asset_id")), "cheapest": F.struct(F.col("price_krw").alias("a"), F.col("asset_id"))}[strategy]
    return rows.groupBy("decision_date").agg(
        F.count("*").alias("eligible_count"), F.min_by(F.struct("asset_id", "observation_id", "price_krw", "total_krw", "score"), order).alias("_c")
    ).select("decision_date", "eligible_count", "_c.*")


region_metric = summary.metric_by_region
