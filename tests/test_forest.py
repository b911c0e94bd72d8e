import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pricetide.operators import forest, models

LEVELS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (3000, 2))
    y = 3 * x[:, 0] + rng.normal(0, 0.2 + x[:, 1], 3000)
    data = [(k, float(a), float(b), float(c), f"c{k % 60}", 0.0) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, a double, b double, actual double, complex string, anchor double").repartition(4).cache()


def test_quantiles_are_weighted_order_statistics_over_shared_leaves(rows):
    """Against the weights spelled out in numpy: 1 / (trees × rows of the leaf) for each shared leaf."""
    inputs = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(rows).withColumn("_y", F.col("actual"))
    model = forest.fit(inputs, trees=15, depth=4, min_rows=40, cells=400)
    got = model.transform(inputs, LEVELS).select("id", "_y", *[f"_q_{n}" for n in LEVELS]).toPandas().sort_values("id")
    leaves = model.forest.transform(inputs).select("id", vector_to_array("_leaf").alias("l")).toPandas().sort_values("id")
    leaf, y = np.stack(leaves["l"]).astype(int), got["_y"].to_numpy()
    order, width = np.argsort(y), np.diff(model.edges).max()
    for k in range(0, 3000, 150):
        same = leaf == leaf[k]
        weight = (same / same.sum(0)).mean(1)
        at = np.cumsum(weight[order])
        for name, q in LEVELS.items():
            low, high = y[order][np.searchsorted(at, q - 0.02)], y[order][min(np.searchsorted(at, q + 0.02), 2999)]
            assert low - width <= got[f"_q_{name}"].iloc[k] <= high + width
    assert ((got["_q_p10"] <= got["_q_p50"]) & (got["_q_p50"] <= got["_q_p90"])).all()


def test_held_out_coverage_after_calibration(rows):
    train, calibration, test = (rows.where(F.col("id") % 3 == k) for k in range(3))
    model = models.calibrate(models.fit_quantiles(train, ["a", "b"], trees=20, min_rows=40), calibration)
    out = model.transform(test)
    r = out.agg(F.avg(((F.col("actual") >= F.col("p10")) & (F.col("actual") <= F.col("p90"))).cast("double")).alias("c"), F.avg((F.col("p10") <= F.col("p90")).cast("double")).alias("o")).first()
    assert abs(r["c"] - 0.8) < 0.03 and r["o"] == 1.0
    # The tails follow the spread, which one residual quantile for all cannot.
    wide = out.select((F.col("b") > 0.7).alias("w"), (F.col("p90") - F.col("p10")).alias("d")).groupBy("w").agg(F.avg("d").alias("d")).orderBy("w").collect()
    assert wide[1]["d"] > 1.1 * wide[0]["d"]


def test_equal_targets_and_few_rows(spark):
    df = spark.createDataFrame([(float(k), 2.0) for k in range(30)], "a double, actual double").withColumn("anchor", F.lit(0.5))
    got = models.fit_quantiles(df, ["a"], trees=3, min_rows=5).transform(df).select(*LEVELS).distinct().collect()
    assert all(abs(v - 2.0) < 1e-9 for r in got for v in r)


def test_blocks_are_tested_by_rows_apart_from_them(spark):
    rows = [(f"2000-0{o}-01", 12, f"b{b}", f"c{b}-{k}", f"2000-0{o + 2}-01", None if k == 0 else 0.1 * k) for o in range(1, 6) for b in range(3) for k in range(4)]
    panel = spark.createDataFrame(rows, "origin string, horizon_months int, gu string, complex string, label_available string, target double")
    panel = panel.withColumns({c: F.to_date(c) for c in ("origin", "label_available")})
    apart = spark.createDataFrame([("b0", "b1"), ("b1", "b0")], "block string, other string")
    grid = {(str(r["origin"]), r["block"]): r for r in models.evaluation_grid(panel, "2000-06-30", apart, min_rows=6, min_origins=2).collect()}
    # At 1 April labels of January and February are public: three in each block.
    assert [grid["2000-04-01", b]["training_rows"] for b in ("b0", "b1", "b2")] == [6, 6, 12]
    assert grid["2000-04-01", "b0"]["skipped"] is None and grid["2000-03-01", "b0"]["skipped"] == models.TOO_FEW
    assert grid["2000-05-01", "b2"]["skipped"] == models.NOT_MATURE and grid["2000-01-01", "b0"]["rows"] == 4
    both = panel.unionByName(panel.limit(1).withColumn("gu", F.lit("b2")).withColumn("complex", F.lit("c1-1")))
    with pytest.raises(ValueError, match="two blocks"):
        models.evaluate_origins(both, "2000-06-30", apart)


def test_halves_hold_whole_groups_and_radii_come_from_the_other(rows):
    scored = rows.withColumns({"target": F.col("actual"), "reference_anchor": F.col("anchor"), "prediction": F.col("a") * 3, "n": F.lit(5)})
    tuning, calibration = models.halves(scored, "complex")
    assert tuning.join(calibration, "complex").isEmpty() and tuning.count() + calibration.count() == 3000
    chosen = models.blend_errors(tuning).where("selected").first()
    assert chosen["blend"] > 0.5
    radius = models.split_conformal(calibration, 1.0, {"all": ()}).first()
    errors = np.sort([abs(r["target"] - r["prediction"]) / np.sqrt(1 + 2 / 5) for r in calibration.collect()])
    n = len(errors)
    assert radius["n"] == n and abs(radius["radius"] - errors[int(np.ceil((n + 1) * 0.8)) - 1]) < 1e-9


def test_rows_are_scored_without_the_shares_beside_them(rows):
    """Trees × leaves × cells numbers once joined every scored row."""
    inputs = VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(rows).withColumn("_y", F.col("actual"))
    out = forest.fit(inputs, trees=3, depth=3, min_rows=40).transform(inputs, LEVELS)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
