"""Model fitting on Spark ML: residual trees, quantile forests, calibration, walk-forward and blocked evaluation.

The driver only loops over years, origins, blocks or candidates, several fits
at a time; every fit, transform and metric runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array  # noqa: F401  (for readers of the input vector)
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import calendar as cal
from pricetide.operators import evaluation, forest, history
from pricetide.operators.annual import conformal_radius, hash_parity, sample_scale
from pricetide.operators.stats import Quantile, median, quantiles, ranked
from pricetide.session import durable

LEVELS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
SEED = 20260907
# Fits that run at the same time; Spark shares its executors among them.
AT_ONCE = 4


def at_once(work: Callable, items: Iterable) -> list:
    """work(item) of every item, a few at a time, in order."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(work, items))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_inputs(df: DataFrame, cols: Sequence[str], out: str = "_x") -> DataFrame:
    """Feature vector of ``cols``; an unknown value becomes 0 plus a 1 in its missing flag."""
    values = {f"_v_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    flags = {f"_m_{c}": F.col(c).isNull().cast("double") for c in cols}
    wide = df.withColumns({**values, **flags})
    return VectorAssembler(inputCols=[*values, *flags], outputCol=out).transform(wide).drop(*values, *flags)


@dataclass
class ResidualModel:
    """prediction = base + f(inputs), trained on |actual − base − f|."""

    model: object
    cols: Sequence[str]
    base: str | None

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        scored = self.model.transform(with_inputs(df, self.cols)).drop("_x")
        base = F.col(self.base) if self.base else F.lit(0.0)
        return scored.withColumn("_f", base + F.col("_f")).withColumnRenamed("_f", out)


def fit_residual(train: DataFrame, cols: Sequence[str], target: str = "actual", base: str | None = "anchor", weight: str | None = None,
                 trees: int = 220, depth: int = 4, min_rows: int = 45) -> ResidualModel:
    """Gradient-boosted trees on absolute error of the residual over ``base``; inputs may be null."""
    y = F.col(target) - (F.col(base) if base else F.lit(0.0))
    rows = with_inputs(train, cols).withColumn("_y", y).where(F.col("_y").isNotNull())
    keep = ["_x", "_y"] + ([weight] if weight else [])
    gbt = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_f", lossType="absolute", maxIter=trees, maxDepth=depth,
                       stepSize=0.1, minInstancesPerNode=min_rows, seed=SEED)
    if weight:
        gbt = gbt.setWeightCol(weight)
    # Boosting reads its input once per tree; keep the reduced columns at hand.
    rows = rows.select(*keep).persist()
    try:
        return ResidualModel(gbt.fit(rows), list(cols), base)
    finally:
        rows.unpersist()


@dataclass
class QuantileModel:
    """Forest quantiles of the residual, shifted by offsets and rearranged so that they never cross."""

    forest: forest.QuantileForest
    cols: Sequence[str]
    base: str | None
    levels: Mapping[str, float]
    offsets: Mapping[str, float] | None = None

    def raw(self, df: DataFrame) -> DataFrame:
        scored = self.forest.transform(with_inputs(df, self.cols), self.levels).drop("_x")
        base = F.col(self.base) if self.base else F.lit(0.0)
        shift = self.offsets or {}
        return scored.withColumns({n: base + F.col(f"_q_{n}") + F.lit(float(shift.get(n, 0.0))) for n in self.levels}).drop(
            *[f"_q_{n}" for n in self.levels]
        )

    def transform(self, df: DataFrame) -> DataFrame:
        names = list(self.levels)
        rows = self.raw(df).withColumn("_sorted", F.array_sort(F.array(*names)))
        return rows.withColumns({n: F.col("_sorted")[i] for i, n in enumerate(names)}).drop("_sorted")


def fit_quantiles(train: DataFrame, cols: Sequence[str], levels: Mapping[str, float] = LEVELS, target: str = "actual",
                  base: str | None = "anchor", trees: int = 120, depth: int = 5, min_rows: int = 100) -> QuantileModel:
    """A quantile forest of the residual over ``base``."""
    y = F.col(target) - (F.col(base) if base else F.lit(0.0))
    rows = with_inputs(train, cols).select("_x", y.alias("_y"))
    return QuantileModel(forest.fit(rows, trees, depth, min_rows), list(cols), base, levels)


def residual_offsets(rows: DataFrame, levels: Mapping[str, float], target: str = "actual") -> DataFrame:
    """(level, n, offset): the quantile of target − level's column at the level's own share."""
    errors = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("level"), (F.col(target) - F.col(n)).alias("_e")) for n in levels])))
    found = quantiles(errors, ["level"], "_e", {f"_{n}": Quantile(q) for n, q in levels.items()})
    own = F.coalesce(*[F.when(F.col("level") == n, F.col(f"_{n}")) for n in levels])
    return found.select("level", F.col("total_one").alias("n"), own.alias("offset"))


def calibrate(model: QuantileModel, calibration: DataFrame, target: str = "actual") -> QuantileModel:
    """Out-of-time offsets: the residual quantile of every level on later rows.  One number a level reaches the driver."""
    raw = durable(model.raw(calibration).where(F.col(target).isNotNull()).select(target, *model.levels))
    offsets = {r["level"]: r["offset"] for r in residual_offsets(raw, model.levels, target).collect()}
    return QuantileModel(model.forest, model.cols, model.base, model.levels, offsets)


def retain_median(quantile_rows: DataFrame, median_column: str, lower: str = "p10", middle: str = "p50", upper: str = "p90") -> DataFrame:
    """Keep a separately fitted median; tails are clamped to its sides."""
    m = F.col(median_column)
    return quantile_rows.withColumns({middle: m, lower: F.least(F.col(lower), m), upper: F.greatest(F.col(upper), m)})


@dataclass
class RadiusModel:
    quantile: QuantileModel
    offsets: DataFrame
    floor: float = 0.01

    def transform(self, df: DataFrame) -> DataFrame:
        rows = self.quantile.transform(df).join(self.offsets, "region", "left")
        return rows.withColumn("radius", F.greatest(F.lit(self.floor), F.col("q80") + F.coalesce("_offset", F.lit(0.0)))).drop("q80", "_offset")


def fit_radius(train: DataFrame, calibration: DataFrame, cols: Sequence[str], actual: str = "actual", prediction: str = "prediction",
               trees: int = 120) -> RadiusModel:
    """80 % quantile of |error| by a forest, plus a complex-balanced conformal offset per region."""
    error = F.abs(F.col(actual) - F.col(prediction))
    model = fit_quantiles(train.withColumn("_err", error), cols, {"q80": 0.8}, "_err", None, trees)
    scored = model.transform(calibration.withColumn("_err", error)).withColumn("_score", F.col("_err") - F.col("q80"))
    weighted = evaluation.complex_weights(scored)
    offsets = evaluation.weighted_quantile(weighted, ["region"], "_score", F.col("weight"), 0.8, "_offset")
    return RadiusModel(model, durable(offsets))


def earlier_rows(df: DataFrame) -> DataFrame:
    """Per year the rows of all earlier years; one row per year is left before the ordered sum."""
    w = Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = df.groupBy("year").agg(F.count("*").alias("n"))
    return years.select("year", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("training_rows"))


def walk_forward(df: DataFrame, years: Sequence[int], candidates: Mapping[str, Sequence[str]], target: str = "actual", base: str = "anchor",
                 min_train: int = 100, trees: int = 220) -> DataFrame:
    """Each year predicted by models of the earlier years only; one column per candidate.

    All (year, candidate) fits are independent and run a few at a time.
    """
    sizes = {r["year"]: r["training_rows"] for r in earlier_rows(df).collect()}
    used = [y for y in years if sizes.get(y, 0) >= min_train]
    if not used:
        raise ValueError("no year has enough earlier rows")
    cells = [(y, name) for y in used for name in candidates]
    fitted = dict(zip(cells, at_once(lambda c: fit_residual(df.where(F.col("year") < c[0]), candidates[c[1]], target, base, trees=trees), cells), strict=True))
    parts = []
    for year in used:
        test = df.where(F.col("year") == year)
        for name in candidates:
            test = fitted[year, name].transform(test, name)
        parts.append(test)
    return union(parts)


WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)


def halves(rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(tuning, calibration): disjoint groups by hash."""
    even = hash_parity(F.col(group)) == 0
    return rows.where(even), rows.where(~even)


def blend(base: str, weight: Column, prediction: str = "prediction") -> Column:
    return F.col(base) + weight * (F.col(prediction) - F.col(base))


def blend_errors(tuning: DataFrame, target: str = "target", base: str = "reference_anchor") -> DataFrame:
    """Mean absolute error of each blend weight of ``prediction`` over ``base``, the best one selected."""
    blended = tuning.withColumn("blend", F.explode(F.array(*[F.lit(w) for w in WEIGHTS])))
    error = F.abs(F.exp(F.col(target)) - F.exp(blend(base, F.col("blend"))))
    scored = blended.groupBy("blend").agg(F.avg(error).alias("mae"), F.count("*").alias("rows"))
    # Five rows from here on.
    first = Window.partitionBy(F.lit(0)).orderBy("mae", "blend")
    return scored.withColumn("selected", F.row_number().over(first) == 1)


def split_conformal(calibration: DataFrame, weight: float | Column, levels: Mapping[str, Sequence[str]], target: str = "target",
                    base: str = "reference_anchor", n: str = "n", min_rows: int = 100) -> DataFrame:
    """Radii of the scaled errors of the half that had no part in the choice: finite-sample order statistics per level."""
    weight = F.lit(weight) if isinstance(weight, (int, float)) else weight
    error = F.abs(F.col(target) - blend(base, weight)) / sample_scale(F.col(n))
    return conformal_radius(calibration, error, levels, min_rows=min_rows)


def tune(df: DataFrame, year: int, cols: Sequence[str], group: str, levels: Mapping[str, Sequence[str]], target: str = "target",
         base: str = "reference_anchor", trees: int = 220, min_half: int = 20) -> tuple[DataFrame, DataFrame]:
    """(error of each blend weight on one hash half of ``year``'s groups, radii of the chosen blend on the other half).

    The model is fitted on earlier years.
    """
    model = fit_residual(df.where(F.col("year") < year), cols, target, base, trees=trees)
    rows = durable(model.transform(df.where(F.col("year") == year)))
    tuning, calibration = halves(rows, group)
    sizes = rows.agg(F.count_if(hash_parity(F.col(group)) == 0).alias("t"), F.count_if(hash_parity(F.col(group)) == 1).alias("c")).first()
    if min(sizes) < min_half:
        raise ValueError("too few groups in a half")
    errors = durable(blend_errors(tuning, target, base))
    chosen = errors.where("selected").first()["blend"]
    return errors, split_conformal(calibration, chosen, levels, target, base)


def growth_split(panel: DataFrame, origin: str, minimum: int = 100, target: str = "target") -> DataFrame:
    """Mature rows at ``origin`` marked learn or calibration.

    Calibration takes the latest mature origins until they hold ``minimum``
    labels; learning rows must have been mature at the earliest of those.
    """
    at = cal.as_date(origin)
    mature = panel.where((F.col("label_available") <= at) & F.col(target).isNotNull())
    # One row per origin: a handful per year of history.
    sizes = mature.groupBy("origin").agg(F.count("*").alias("_n"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.col("origin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    boundary = sizes.withColumn("_c", F.sum("_n").over(later)).where(F.col("_c") >= minimum).agg(F.max("origin").alias("b")).first()["b"]
    if boundary is None:
        raise ValueError("not enough mature labels for calibration")
    b = F.lit(boundary)
    part = F.when(F.col("origin") >= b, "calibration").when(F.col("label_available") <= b, "learn")
    return mature.withColumn("part", part).where(F.col("part").isNotNull())


# Inputs of the relative-growth models (fixed values).
GROWTH_COLUMNS = "area age n90 n180 n365 momentum relative_level peer_momentum relative_momentum activity last_age".split()


def fit_growth(panel: DataFrame, origin: str, cols: Sequence[str] = GROWTH_COLUMNS, min_rows: int = 500, min_origins: int = 3,
               trees: int = 120) -> tuple[QuantileModel, DataFrame]:
    """(calibrated growth quantiles, support counts) from labels of one horizon that were public at ``origin``."""
    split = durable(growth_split(panel, origin))
    support = growth_support(split)
    learn = {r["part"]: r for r in support.collect()}.get("learn")
    if learn is None or learn["rows"] < min_rows or learn["origins"] < min_origins:
        raise ValueError("not enough mature learning rows")
    model = fit_quantiles(split.where("part = 'learn'"), cols, target="target", base=None, trees=trees)
    return calibrate(model, split.where("part = 'calibration'"), "target"), support


def growth_support(split: DataFrame) -> DataFrame:
    """Rows and origins of each part."""
    return split.groupBy("part").agg(F.count("*").alias("rows"), F.count_distinct("origin").alias("origins"))


# Why a cell of the evaluation grid is not fitted (fixed values).
NOT_MATURE, TOO_FEW = "outcome_not_mature", "too_few_mature_rows_or_origins"


def evaluation_grid(panel: DataFrame, as_of: str, apart: DataFrame | None = None, block: str = "gu", min_rows: int = 500,
                    min_origins: int = 3) -> DataFrame:
    """Support of every (origin, horizon, block): tested and training rows, training origins, and the reason to skip it.

    A block is tested by models of other blocks: ``apart`` (block, other) names
    the blocks whose rows must stay out of its training besides its own, such
    as its neighbours.  Without ``apart`` there is one block, tested by the
    past of all.  Rows are counted per (origin, horizon, block) first; what
    meets in the join is calendar × calendar × blocks × blocks.
    """
    inside = F.col(block) if apart is not None else F.lit("all")
    known = panel.groupBy("origin", "horizon_months", inside.alias("block")).agg(
        F.count("*").alias("rows"), F.max("label_available").alias("mature"), F.count("target").alias("labels"),
    )
    labels = panel.where(F.col("target").isNotNull()).groupBy("horizon_months", inside.alias("other"), F.col("origin").alias("past"), "label_available").agg(F.count("*").alias("n"))
    known, labels = durable(known), durable(labels)
    visible = known.select("origin", "horizon_months", "block").join(labels, "horizon_months").where(F.col("label_available") <= F.col("origin"))
    if apart is not None:
        kept_out = apart.select("block", "other").unionByName(known.select("block", F.col("block").alias("other")).distinct()).distinct()
        visible = visible.join(kept_out, ["block", "other"], "left_anti")
    support = visible.groupBy("origin", "horizon_months", "block").agg(F.sum("n").alias("training_rows"), F.count_distinct("past").alias("training_origins"))
    grid = known.join(support, ["origin", "horizon_months", "block"], "left").fillna(0, subset=["training_rows", "training_origins"])
    few = (F.col("training_rows") < min_rows) | (F.col("training_origins") < min_origins)
    reason = F.when(F.col("mature") > cal.as_date(as_of), NOT_MATURE).when(few, TOO_FEW)
    return grid.select("origin", "horizon_months", "block", "rows", "labels", "training_rows", "training_origins", reason.alias("skipped"))


def evaluate_origins(panel: DataFrame, as_of: str, apart: DataFrame | None = None, block: str = "gu", cols: Sequence[str] = GROWTH_COLUMNS,
                     min_rows: int = 500, min_origins: int = 3, trees: int = 120) -> tuple[DataFrame | None, DataFrame]:
    """(measured results of the model in each cell of the grid, the grid with support and skip reasons).

    Training is strictly on labels that were public at the origin and, with
    ``apart``, on blocks apart from the tested one.  Cells are fitted a few at
    a time.
    """
    panel = panel.withColumn("block", F.col(block) if apart is not None else F.lit("all"))
    if apart is not None:
        twice = panel.groupBy("complex").agg(F.count_distinct("block").alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise ValueError("a complex lies in two blocks: its outcomes would reach the test")
    grid = durable(evaluation_grid(panel, as_of, apart, "block", min_rows, min_origins))
    # Origins, horizons and blocks are short lists; only these reach the driver.
    cells = grid.where("skipped IS NULL").orderBy("origin", "horizon_months", "block").collect()
    near: dict[str, set[str]] = {}
    for r in apart.select("block", "other").collect() if apart is not None else []:
        near.setdefault(r["block"], set()).add(r["other"])

    def fitted(cell) -> DataFrame:
        here, at = (F.col("horizon_months") == cell["horizon_months"]), F.lit(cell["origin"])
        train = panel.where(here & (F.col("label_available") <= at) & F.col("target").isNotNull())
        if apart is not None:
            train = train.where(~F.col("block").isin(sorted(near.get(cell["block"], set()) | {cell["block"]})))
        model = fit_residual(train, cols, "target", None, trees=trees, depth=3, min_rows=100)
        return durable(model.transform(panel.where(here & (F.col("origin") == at) & (F.col("block") == cell["block"])), "signal"))

    if not cells:
        return None, grid
    scope = ["origin", "horizon_months", "block"]
    measured = evaluation.measure(union(at_once(fitted, cells)), scope, "signal")
    return measured.join(grid.select(*scope, "training_rows", "training_origins"), scope), grid


def permutation_importance(score: Callable[[DataFrame], DataFrame], test: DataFrame, groups: Mapping[str, Sequence[str]], order: Sequence[str],
                           error: Column, repeats: int = 3) -> DataFrame:
    """Mean increase of ``error`` when a group of inputs is shuffled together over the holdout rows.

    The shuffle joins every row to the row of the same number in a hash order,
    so no task sees the whole table.
    """
    numbered = durable(ranked(test, [F.col(c).asc() for c in order], "_row"))
    base = score(numbered).agg(F.avg(error).alias("e")).first()["e"]
    parts = []
    for name, cols in groups.items():
        for r in range(repeats):
            mixed = ranked(
                numbered.select(*cols, F.md5(F.concat_ws("|", F.lit(SEED + r), F.col("_row"))).alias("_h"), F.col("_row").alias("_from")), [F.col("_h").asc(), F.col("_from").asc()], "_row"
            ).select("_row", *cols)
            changed = numbered.drop(*cols).join(mixed, "_row")
            parts.append(score(changed).agg(F.avg(error).alias("e")).select(F.lit(name).alias("name"), (F.col("e") - F.lit(base)).alias("_d")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name").agg(F.avg("_d").alias("error_increase"), F.stddev_pop("_d").alias("repeat_std"))


def current_templates(trades: DataFrame, keys: DataFrame, month: str, lag_days: int = 31) -> DataFrame:
    """One unpriced row per wanted key at the month's start, with its median floor of the visible last year.

    A key never traded before the month raises.
    """
    origin = cal.as_date(f"{month}-01")
    base = trades.where(F.col("date") < origin)
    cutoff = F.date_sub(origin, lag_days)
    latest = base.groupBy("key").agg(F.max_by(F.struct("complex", "peer", "gu", "area", "built"), F.struct("date", "price", "floor")).alias("_t"))
    floors = median(
        base.where((F.col("date") <= cutoff) & (F.col("date") > F.date_sub(cutoff, 365))), ["key"], "floor", "floor"
    ).drop("n")
    known = keys.select("key").distinct().join(latest, "key", "left").join(floors, "key", "left")
    exists = F.when(F.col("_t").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.lit("no known property identity before the prediction origin")).cast("boolean")
    )
    return known.where(exists).select("key", "_t.*", "floor", origin.alias("date"))


def predict_current(trades: DataFrame, keys: DataFrame, model: ResidualModel, month: str, lag_days: int = 31) -> DataFrame:
    """Conditional valuation at the representative floor; the same lag-safe inputs as in validation."""
    templates = current_templates(trades, keys, month, lag_days)
    base = trades.where(F.col("date") < cal.as_date(f"{month}-01"))
    rows = base.select("key", "complex", "peer", "gu", "area", "built", "floor", "date", "log_price", "price_oku")
    blank = templates.withColumns({"log_price": F.lit(None).cast("double"), "price_oku": F.lit(None).cast("double")})
    synthetic = rows.unionByName(blank.select(*rows.columns))
    synthetic = synthetic.withColumns({"day": F.unix_date("date"), "year": F.year("date")})
    features = history.monthly_features(synthetic, history.Lag(uniform=lag_days), f"{month}-01", f"{month}-01")
    out = model.transform(features)
    return out.withColumn("estimated_price_oku", F.exp("prediction") * F.col("area") / 10000)


STRENGTHS = (0.0, 0.25, 0.5, 1.0)


def correction_grid(df: DataFrame, base: str, corrections: Mapping[str, str]) -> DataFrame:
    """Selection score of each correction at strengths 0–1: mean ratio of MAE and complex-balanced MAPE to the uncorrected base."""
    choices = F.array(
        *[F.struct(F.lit(m).alias("method"), F.lit(s).alias("strength"), (F.col(base) + s * F.col(c)).alias("_p")) for m, c in corrections.items() for s in STRENGTHS]
    )
    rows = df.select("*", F.inline(choices))
    scored = evaluation.metric(rows, "_p", ["method", "strength"])
    plain = scored.where(F.col("strength") == 0).select("method", F.col("mae_oku").alias("_m"), F.col("complex_balanced_mape_pct").alias("_c"))
    # A dozen rows: methods × strengths.
    out = scored.join(plain, "method").withColumn(
        "selection_score", (F.col("mae_oku") / F.col("_m") + F.col("complex_balanced_mape_pct") / F.col("_c")) / 2
    ).drop("_m", "_c")
    w = Window.partitionBy("method").orderBy("selection_score", "strength")
    return out.withColumn("selected", F.row_number().over(w) == 1)
