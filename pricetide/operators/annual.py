"""The annual reference: calendar-year panel, prior-only anchors, calibrated review rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.parsing import present
from pricetide.operators.stats import crowded, median_of, order_statistics
from pricetide.session import stored

MAX_GAP = 3


def annual_panel(types: DataFrame) -> DataFrame:
    """Input (sido, gu, dong, key, complex, built, area, year, price, n) → one row per (dong, key, year).

    Duplicate type rows are resolved by the larger count (then price).  Prior
    values come from exactly one and two years before.
    """
    best = types.groupBy("dong", "key", "year").agg(
        F.max_by(F.struct("sido", "gu", "complex", "built", "area", "price", "n"), F.struct("n", "price")).alias("_b")
    )
    base = best.select("dong", "key", "year", "_b.*").where((F.col("price") > 0) & (F.col("area") > 0))
    # One row per type and year: small against the trades, and read five times below.
    base = stored(base)
    peers = median_of(base, ["dong", "year"], "price", "_peer", crowded(base, ["dong"])).drop("n")
    volume = base.groupBy("dong", "year").agg(F.sum("n").alias("_peer_n"))
    around = peers.join(volume, ["dong", "year"]).select(
        "dong", (F.col("year") + 1).alias("year"), F.ln("_peer").alias("prior_peer"), F.col("_peer_n").alias("peer_count")
    )
    back = lambda k, price, n: base.select(
        "dong", "key", (F.col("year") + k).alias("year"), F.col("price").alias(price), F.col("n").alias(n)
    )
    joined = (
        base.join(back(1, "_p1", "prior_count"), ["dong", "key", "year"], "left")
        .join(back(2, "_p2", "_n2"), ["dong", "key", "year"], "left")
        .join(around, ["dong", "year"], "left")
    )
    return joined.withColumns(
        {
            "prior_price": F.ln("_p1"),
            "momentum": F.ln(F.col("_p1") / F.col("_p2")),
            "target": F.ln("price"),
            "age": F.when(F.col("built") <= F.col("year"), F.col("year") - F.col("built")),
            "area_band": F.floor(F.col("area") / 5),
        }
    ).drop("_p1", "_p2", "_n2")


def last_price_asof(panel: DataFrame) -> DataFrame:
    """The type's last earlier year, at most three years back, and the gap.

    One row per year and type, so the ordered pass per type is as long as the
    history has years.
    """
    w = Window.partitionBy("dong", "key").orderBy("year")
    before = F.lag(F.struct("year", "target")).over(w)
    gap = F.col("year") - F.col("_b.year")
    return (
        panel.withColumn("_b", before)
        .withColumn("history_gap", F.when(gap <= MAX_GAP, gap))
        .withColumn("last_price", F.when(gap <= MAX_GAP, F.col("_b.target")))
        .drop("_b")
    )


# Geography level and the smallest pool that may speak for it (fixed values).
PEER_LEVELS = (("dong", 5), ("gu", 10), ("sido", 20))


def matched_peer(panel: DataFrame) -> DataFrame:
    """Previous year's median of similar areas: dong from 5, else gu from 10, else sido from 20 types."""
    out = panel
    values, counts = [], []
    # Pools read these columns only, once for every level.
    slim = stored(panel.select(*[level for level, _ in PEER_LEVELS], "area_band", "year", "target"))
    for level, minimum in PEER_LEVELS:
        groups = [level, "area_band", "year"]
        pool = median_of(slim, groups, "target", "_m", crowded(slim, groups)).where(F.col("n") >= minimum)
        pool = pool.select(
            level, "area_band", (F.col("year") + 1).alias("year"), F.col("_m").alias(f"_{level}_m"), F.col("n").alias(f"_{level}_n")
        )
        out = out.join(pool, [level, "area_band", "year"], "left")
        values.append(f"_{level}_m")
        counts.append(f"_{level}_n")
    return out.withColumn("matched_peer", F.coalesce(*values)).withColumn("matched_peer_count", F.coalesce(*counts)).drop(*values, *counts)


def sibling_anchor(panel: DataFrame) -> DataFrame:
    """Qualified earlier price of another type of the same complex and built year.

    Eligible: the sibling's latest year with 3 trades, 1–3 years back, area
    ratio within 1.5.  Newest year first, then nearest log area, larger count,
    smaller key.  For each of the three years the nearest smaller and larger
    areas are found in one ordered pass; types are never paired with each other.
    """
    known = panel.where(F.col("age").isNotNull()).withColumn("_built", F.round(F.col("year") - F.col("age")).cast("int"))
    identity = ["dong", "complex", "_built"]
    qualified = known.where(F.col("n") >= 3)
    per_type = Window.partitionBy(*identity, "key").orderBy("year")
    # A type speaks with its latest qualified year until the next one replaces it.
    until = F.least(F.col("year") + MAX_GAP, F.coalesce(F.lead("year").over(per_type), F.col("year") + MAX_GAP))
    offers = qualified.withColumn("_until", until).select(
        *identity,
        F.explode(F.sequence(F.col("year") + 1, F.col("_until"))).alias("_at"),
        F.col("year").alias("_from"),
        F.struct("area", "key", "target", "n").alias("_offer"),
    )
    # Several types can share an exact area only across complexes; keep the strongest per area.
    offers = offers.groupBy(*identity, "_at", "_from", F.col("_offer.area").alias("area")).agg(
        F.min_by("_offer", F.struct((-F.col("_offer.n")).alias("n"), F.col("_offer.key"))).alias("_offer")
    )
    asks = known.select(*identity, F.col("year").alias("_at"), "key", "area").withColumn(
        "_from", F.explode(F.array(*[F.col("_at") - k for k in range(1, MAX_GAP + 1)]))
    )
    kind = offers.schema["_offer"].dataType
    stream = offers.select(*identity, "_at", "_from", "area", F.lit(None).cast("string").alias("key"), "_offer").unionByName(
        asks.select(*identity, "_at", "_from", "area", "key", F.lit(None).cast(kind).alias("_offer"))
    )
    scope = Window.partitionBy(*identity, "_at", "_from")
    # Range frames leave out the row's own area: a sibling has a different one.
    micro = F.round(F.col("area") * 1000000).cast("long")
    smaller = F.last("_offer", ignorenulls=True).over(scope.orderBy(micro).rangeBetween(Window.unboundedPreceding, -1))
    larger = F.last("_offer", ignorenulls=True).over(scope.orderBy(micro.desc()).rangeBetween(Window.unboundedPreceding, -1))
    looked = stream.withColumns({"_smaller": smaller, "_larger": larger}).where(F.col("key").isNotNull())
    options = looked.select(
        *identity, "_at", "_from", "key", "area", F.explode(F.array_compact(F.array("_smaller", "_larger"))).alias("_s")
    )
    ratio = F.col("area") / F.col("_s.area")
    options = options.where(ratio.between(1 / 1.5, 1.5)).withColumn(
        "_order",
        F.struct(
            (-F.col("_from")).alias("a"), F.abs(F.ln(ratio)).alias("b"), (-F.col("_s.n")).alias("c"), F.col("_s.key").alias("d")
        ),
    )
    chosen = options.groupBy(*identity, F.col("_at").alias("year"), "key").agg(
        F.min_by(F.struct("_s", "_from"), "_order").alias("_c")
    )
    joined = known.join(chosen, [*identity, "year", "key"], "left")
    out = joined.select(
        "dong", "key", "year",
        F.col("_c._s.target").alias("sibling_price"),
        (F.col("area") / F.col("_c._s.area")).alias("sibling_area_ratio"),
        F.col("_c._s.n").alias("sibling_count"),
        (F.col("year") - F.col("_c._from")).alias("sibling_gap"),
    )
    return panel.join(out, ["dong", "key", "year"], "left")


def reference_anchor(panel: DataFrame, fallback: float | Column | None = None) -> DataFrame:
    """First known of prior price, last price, sibling, matched peer, prior peer, training median."""
    chain = ["prior_price", "last_price", "sibling_price", "matched_peer", "prior_peer"]
    steps = [F.col(c) for c in chain if c in panel.columns]
    if fallback is not None:
        steps.append(F.lit(fallback) if isinstance(fallback, (int, float)) else fallback)
    return panel.withColumn("reference_anchor", F.coalesce(*steps))


def reference_frame(types: DataFrame) -> DataFrame:
    """Panel with every prior-only anchor candidate and the coalesced anchor."""
    panel = stored(last_price_asof(annual_panel(types)))
    return reference_anchor(sibling_anchor(stored(matched_peer(panel))))


def sample_scale(n: Column) -> Column:
    return F.sqrt(1 + 2 / F.greatest(n.cast("double"), F.lit(1.0)))


def conformal_radius(df: DataFrame, error: Column, levels: Mapping[str, Sequence[str]], coverage: float = 0.8,
                     min_rows: int = 100) -> DataFrame:
    """Finite-sample order statistic ``⌈(n+1)·coverage⌉`` of the errors per level, long form (level, group, n, radius).

    ``levels`` maps a level name to its grouping columns; () is the whole
    table.  Groups below ``min_rows`` are left to their parent level.
    """
    parts = []
    for level, columns in levels.items():
        name = F.concat_ws("|", *[F.col(c).cast("string") for c in columns]) if columns else F.lit("")
        parts.append(F.struct(F.lit(level).alias("level"), name.alias("group")))
    rows = df.select(error.alias("_e"), F.inline(F.array(*parts)))
    rank = lambda n: F.least(n, F.ceil((n + 1) * coverage))
    stats = order_statistics(rows, ["level", "group"], "_e", {"radius": ("one", rank)})
    top = [k for k, v in levels.items() if not v]
    return stats.where((F.col("total_one") >= min_rows) | F.col("level").isin(*top)).select(
        "level", "group", F.col("total_one").cast("long").alias("n"), "radius"
    )


def with_radius(df: DataFrame, radii: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Radius of the finest level that has one; ``levels`` ordered fine to coarse."""
    out, found = df, []
    for level, columns in levels.items():
        table = radii.where(F.col("level") == level).select(F.col("group").alias("_g"), F.col("radius").alias(f"_r_{level}"))
        name = F.concat_ws("|", *[F.col(c).cast("string") for c in columns]) if columns else F.lit("")
        out = out.withColumn("_g", name).join(table, "_g", "left").drop("_g")
        found.append(f"_r_{level}")
    return out.withColumn("radius", F.coalesce(*found)).drop(*found)


def hash_parity(group: Column) -> Column:
    """Deterministic half split of groups: parity of the first 32 bits of their SHA-256."""
    return F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("long") % 2


def hash_split(df: DataFrame, group: str, out: str = "tuning") -> DataFrame:
    return df.withColumn(out, hash_parity(F.col(group)) == 0)


def annual_review(df: DataFrame) -> DataFrame:
    """Review row: reference band, sample-shrunk score, flags and the basis of the anchor.

    Input: fair (price per 평), price, n, radius and the anchor columns of
    :func:`reference_frame`.
    """
    n = F.col("n").cast("double")
    confidence = n / (n + 5)
    width = F.col("radius") * sample_scale(n)
    gap = F.ln(F.col("fair") / F.col("price"))
    score = 50 + 40 * F.tanh(gap / F.greatest(F.col("radius"), F.lit(0.05))) * confidence
    flags = present(
        F.when(F.col("n") < 3, "fewer_than_3_trades"),
        F.when(F.col("prior_price").isNull(), "no_prior_year_of_type"),
        F.when(F.abs(gap) > 2 * F.col("radius"), "large_price_gap"),
    )
    basis = (
        F.when(F.col("prior_price").isNotNull(), "exact_prior")
        .when(F.col("last_price").isNotNull(), "exact_history")
        .when(F.col("sibling_price").isNotNull(), "same_complex_area")
        .when(F.col("reference_anchor").isNotNull(), "external_peer")
        .otherwise("training_median")
    )
    return df.withColumns(
        {
            "reference_low": F.col("fair") * F.exp(-width),
            "reference_high": F.col("fair") * F.exp(width),
            "score_error_scale": F.greatest(F.col("radius"), F.lit(0.05)),
            "house_match_score": score,
            "sample_confidence": confidence,
            "undervalue_pct": (F.col("fair") / F.col("price") - 1) * 100,
            "quality_flags": flags,
            "reference_basis": basis,
        }
    )
