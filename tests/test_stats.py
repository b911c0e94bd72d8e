import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricetide.operators import stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_quantiles_match_numpy_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", round(rng.lognormvariate(1, 2), 2)) for _ in range(4000)] + [("copies", 5.0)] * 3000
    rows += [(f"g{i % 7}", rng.uniform(-50, 50)) for i in range(300)] + [("one", 3.25), ("none", None)]
    df = frame(spark, rows, "g string, v double")
    wanted = {"p10": stats.Quantile(0.1), "m": stats.Quantile(0.5), "p90": stats.Quantile(0.9)}
    got = {r["g"]: r for r in stats.quantiles(df, ["g"], "v", wanted).collect()}
    for g in {r[0] for r in rows if r[1] is not None}:
        values = [v for k, v in rows if k == g]
        for name, spec in wanted.items():
            assert abs(got[g][name] - np.quantile(values, spec.q)) < 1e-9, (g, name)
        assert got[g]["total_one"] == len(values)
    assert "none" not in got


def weighted(values, weights, q):
    order = np.argsort(values, kind="stable")
    v, w = np.asarray(values)[order], np.asarray(weights)[order]
    return v[np.searchsorted(np.cumsum(w), q * w.sum())]


def test_weighted_quantile_is_order_invariant_and_ignores_zero_weight(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 3), float(rng.randint(0, 5))) for _ in range(500)]
    expected = weighted([r[1] for r in rows if r[2] > 0], [r[2] for r in rows if r[2] > 0], 0.5)
    for _ in range(2):
        rng.shuffle(rows)
        df = frame(spark, rows + [("a", -99.0, 0.0), ("a", 99.0, None)], "g string, v double, w double")
        got = stats.quantiles(df, ["g"], "v", {"m": stats.Quantile(0.5, "w", linear=False)}, {"w": F.col("w")}).first()
        assert got["m"] == expected


def test_min_weight_suppresses_thin_groups(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 9.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in stats.quantiles(df, ["g"], "v", {"m": stats.Quantile(0.5, min_weight=3)}).collect()}
    assert got == {"a": None, "b": 2.0}


def test_leave_one_out_median_equals_brute_force(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for size in (1, 2, 5, 6, 7, 12):
        for i in range(size):
            n += 1
            rows.append((f"p{size}", f"c{n}", None if rng.random() < 0.2 else float(rng.randint(0, 4))))
    df = frame(spark, rows, "peer string, c string, v double")
    got = {r["c"]: r["m"] for r in stats.leave_one_out_median(df, ["peer"], "v", "m", 5).collect()}
    for peer, c, _ in rows:
        others = [v for p, o, v in rows if p == peer and o != c and v is not None]
        assert got[c] == (float(np.median(others)) if len(others) >= 5 else None), (peer, c)


def test_ranked_numbers_rows_without_gaps_even_when_signals_tie(spark):
    rows = [(1.0, f"k{i:04d}") for i in range(700)] + [(float(i), f"z{i}") for i in range(2, 300)]
    df = frame(spark, rows, "s double, k string").repartition(6)
    out = stats.ranked(df, [F.col("s").desc(), F.col("k").asc()], "r", "n").collect()
    expected = {k: i for i, (s, k) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1)}
    assert {r["k"]: r["r"] for r in out} == expected
    assert {r["n"] for r in out} == {len(rows)}


def test_ranked_within_and_average_rank(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None)], "g string, v double")
    ranks = stats.average_rank(df, ["g"], "v", "r").where("v IS NOT NULL").collect()
    assert sorted((r["g"], r["v"], r["r"], r["r_n"]) for r in ranks) == [("a", 1.0, 1.5, 3), ("a", 1.0, 1.5, 3), ("a", 3.0, 3.0, 3), ("b", 2.0, 1.0, 1)]
    within = stats.ranked_within(df, ["g"], [F.col("v").asc_nulls_last()], "r", "n").collect()
    assert sorted((r["g"], r["r"], r["n"]) for r in within) == [("a", 1, 3), ("a", 2, 3), ("a", 3, 3), ("b", 1, 2), ("b", 2, 2)]


def test_bins_keep_order_over_the_whole_double_range(spark):
    values = sorted([0.0, -1e18, 1e18, 1e-9, -1e-9] + [random.Random(4).gauss(0, 10 ** e) for e in range(-6, 13) for _ in range(20)])
    df = frame(spark, [(float(v),) for v in values], "v double")
    bins = [r["b"] for r in df.select("v", stats.value_bin(F.col("v")).alias("b")).orderBy("v").collect()]
    assert bins == sorted(bins)
    assert max(bins) - min(bins) < 27000


def test_hot_bin_is_cut_into_small_parts(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("all").alias("g"), (F.lit(7.0) + F.col("id") / n * 0.07).alias("v"))
    at = df.withColumn("b", stats.value_bin(F.col("v")))
    edges = at.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("in_bin"))
    assert edges.agg(F.max("in_bin")).first()[0] > n / 10
    parts = at.join(edges, "b").groupBy("b", stats.value_part(F.col("v"), F.col("lo"), F.col("hi")).alias("p")).count()
    assert parts.agg(F.max("count")).first()[0] < n / 1000
    got = stats.quantiles(df, ["g"], "v", {"m": stats.Quantile(0.5), "p": stats.Quantile(0.9, linear=False)}).first()
    assert abs(got["m"] - (7.0 + (n - 1) / 2 / n * 0.07)) < 1e-12 and got["p"] == 7.0 + (n * 0.9 - 1) / n * 0.07
    ranks = stats.average_rank(df, ["g"], "v", "r").select("r", F.row_number().over(Window.orderBy("v")).alias("k"))
    assert ranks.where("r <> k").count() == 0


def test_complex_weights_are_exact_for_huge_groups(spark):
    """Counted rows stand for many: ten complexes, one of 3e9 rows, one of three; the target falls on a complex's end."""
    from pricetide.operators import evaluation

    sizes = [3_000_000_000, 3, 7, 11, 13, 17, 19, 23, 29, 10_000_000]
    rows = [("g", c, float(2 * c + h), n) for c, size in enumerate(sizes) for h, n in enumerate((size // 3, size - size // 3))]
    df = frame(spark, rows, "g string, c int, v double, n long")
    size = df.groupBy("c").agg(F.sum("n").alias("size"))
    weight = (F.lit(1).cast(stats.WEIGHT) / F.col("size").cast("decimal(19,0)")).cast(stats.WEIGHT) * F.col("n").cast("decimal(12,0)")
    weighed = df.join(size, "c").withColumn("w", weight)
    for q, want in ((0.8, 15.0), (0.1, 1.0), (0.5, 9.0), (0.85, 17.0), (0.03, 0.0), (1.0, 19.0)):
        assert stats.quantiles(weighed, ["g"], "v", {"m": stats.Quantile(q, "w", linear=False)}, {"w": F.col("w")}).first()["m"] == want, q
        assert stats.quantiles_of(weighed, ["g"], "v", {"m": stats.Quantile(q, "w", linear=False)}, {"w": F.col("w")}).first()["m"] == want, q
    full = frame(spark, [("g", 1.0, 4_999_999), ("g", 2.0, 1), ("g", 3.0, 5_000_000)], "g string, v double, n long")
    assert stats.quantiles(full, ["g"], "v", {"m": stats.Quantile(0.5, "n", linear=False)}, {"n": F.col("n")}).first()["m"] == 2.0
    small = evaluation.complex_weights(frame(spark, [("r", "c", 1.0)] * 3, "region string, complex string, v double"))
    assert small.dtypes[-1][1] == stats.WEIGHT and abs(float(small.first()["weight"]) - 1 / 3) < 1e-15


def test_crowded_groups_and_the_others_give_the_same(spark):
    rng = random.Random(8)
    rows = [(f"g{i % 5 if i % 3 else 0}", rng.choice([rng.gauss(0, 9), 1.5]), rng.randint(0, 3)) for i in range(3000)] + [("none", None, 1), (None, 1.0, 1)]
    df = frame(spark, rows, "g string, v double, w int")
    wanted = {"m": stats.Quantile(0.5), "p": stats.Quantile(0.9, "w"), "d": stats.Quantile(0.3, "w", linear=False)}
    crowd = stats.crowded(df.where("g IS NOT NULL"), ["g"], 900)
    assert [r["g"] for r in crowd.collect()] == ["g0"] and stats.crowded(df, ["g"], 5000) is None
    want = sorted(map(tuple, stats.quantiles(df, ["g"], "v", wanted, {"w": F.col("w")}).collect()))
    for c in (None, crowd):
        assert sorted(map(tuple, stats.quantiles_of(df, ["g"], "v", wanted, {"w": F.col("w")}, c).collect())) == want
    also = [F.sum("x").alias("x"), F.count_distinct("x").alias("d2")]
    got = [sorted(map(tuple, stats.quantiles_with(df.withColumn("x", F.col("w") + 1), ["g"], "v", wanted, {"w": F.col("w")}, also, ["x"], c).collect())) for c in (None, crowd)]
    assert got[0] == got[1] and len(got[0]) == 5
