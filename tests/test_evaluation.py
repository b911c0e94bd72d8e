import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.operators import dashboard, evaluation, joins, models, quality, sets


def test_recent_window_is_inclusive_and_empty_keys_stay_absent(spark):
    end = dt.date(2024, 3, 20)
    rows = [("a", end, 5.0), ("a", end - dt.timedelta(days=89), 7.0), ("a", end - dt.timedelta(days=90), 99.0), ("b", end - dt.timedelta(days=200), 1.0)]
    out = evaluation.recent_comparison(spark.createDataFrame(rows, "key string, date date, price_oku double"), "2024-03").collect()
    assert [(r["key"], r["trade_count"], r["median_price_billion"]) for r in out] == [("a", 2, 6.0)]


def test_weighted_band_counts_complexes_equally(spark):
    rows = [("r", "big", 0.1)] * 100 + [("r", "x", 0.3), ("r", "y", 0.5)]
    df = evaluation.complex_weights(spark.createDataFrame(rows, "region string, complex string, v double"))
    got = evaluation.weighted_quantile(df, ["region"], "v", F.round(F.col("weight") * 1e9), 0.6).first()["quantile"]
    assert got == 0.3


def test_measure_keeps_missing_outcomes_in_the_denominator(spark):
    rows = [("o", f"k{i:02d}", f"c{i}", None if i % 2 else float(i), 0.0 if i % 3 else None, float(i) if i < 28 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "origin string, key string, complex string, target double, growth double, signal double")
    r = evaluation.measure(df, ["origin"], "signal").first()
    assert (r["cohort"], r["selected"], r["missing_signal_imputed"]) == (30, 3, 2)
    # Top three by signal: k27, k26, k25; only k26 has an outcome.
    assert (r["observed"], r["missing_outcomes"]) == (1, 2)
    assert abs(r["observation_rate_pct"] - 100 / 3) < 1e-9


def test_detection_bounds(spark):
    rows = [("a", 24, 0.2), ("b", 24, 0.0), ("b", 36, 0.0), ("c", 24, None), ("c", 36, 0.3), ("d", 24, 0.0), ("d", 36, None)]
    df = spark.createDataFrame([("o", *r) for r in rows], "origin string, key string, horizon_months int, target double")
    r = evaluation.detection(df, ["origin"], (24, 36)).first()
    assert (r["selected"], r["observed_hit"], r["observed_no_hit"], r["unresolved"], r["first_hit_with_prior_missing"]) == (4, 2, 1, 1, 1)
    assert (r["hit_rate_lower_pct"], r["hit_rate_upper_pct"]) == (50.0, 75.0)


def results(spark, rows):
    return spark.createDataFrame(rows, "origin string, method string, selected int, observed int, observed_complexes int, complex_median_excess_pct double")


def test_common_origins_exclude_thin_and_missing_methods(spark):
    full = [("2020", m, 100, 60, 30, v) for m, v in zip(evaluation.METHODS, (3.0, 1.0, 0.5, -1.0))]
    thin = [("2021", m, 100, 40 if m == "laggard" else 80, 30, 9.0) for m in evaluation.METHODS]
    short = [("2022", "learned_price", 100, 90, 30, 9.0)]
    per, pairs, excluded = evaluation.compare_common_origins(results(spark, full + thin + short))
    assert {r["method"]: r["same_origins"] for r in per.collect()} == {m: 1 for m in evaluation.METHODS}
    assert pairs.first()["difference_pp"] == 2.0
    assert sorted((r["origin"], r["reason"]) for r in excluded.collect()) == [("2021", "insufficient_observation_rate")] + [("2022", "missing_method")] * 3
    with pytest.raises(Exception, match="duplicate origin"):
        evaluation.compare_common_origins(results(spark, full + full[:1]))[0].collect()


def test_mean_signal_refuses_missing_checkpoints(spark):
    rows = [("o", "k", h, 1.0) for h in (24, 36, 48)]
    df = spark.createDataFrame(rows, "origin string, key string, horizon_months int, prediction double")
    with pytest.raises(Exception, match="all fixed predictions"):
        evaluation.mean_signal(df, (24, 36, 48, 60)).collect()


def test_bootstrap_is_reproducible_and_brackets_the_mean(spark):
    rng = random.Random(9)
    rows = [(f"c{i % 40}", 0.0, rng.gauss(0, 0.1), rng.gauss(0, 0.05), 5.0) for i in range(800)]
    df = spark.createDataFrame(rows, "complex string, actual double, a double, b double, price_oku double")
    one, two = (evaluation.cluster_gain(d, "a", "b").first() for d in (df, df.repartition(5)))
    assert abs(one["low"] - two["low"]) < 1e-9 and one["low"] < one["mean_gain_oku"] < one["high"]
    expected = np.mean([(abs(math.expm1(r[2])) - abs(math.expm1(r[3]))) * 5 for r in rows])
    assert abs(one["mean_gain_oku"] - expected) < 1e-9


def test_facets_treat_unknown_as_failing_only_active_bounds(spark):
    df = spark.createDataFrame([("a", 10.0, None, 5), ("b", 10.0, 500, 5), ("c", None, 500, 5)], "key string, price double, households int, n int")
    keys = lambda f: sorted(r["key"] for r in dashboard.facet_filter(df, f).collect())
    assert keys(dashboard.Facets()) == ["a", "b", "c"]
    assert keys(dashboard.Facets(min_households=100)) == ["b", "c"]
    assert keys(dashboard.Facets(min_households=100, max_price=50)) == ["b"]


def test_paging_clamps_and_orders_nulls_last(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i)) for i in range(1, 26)], "id long, v double")
    last = dashboard.paginate(df, [("v", "desc")], ["id"], page=99, size=10).orderBy("position").collect()
    assert [r["page"] for r in last] == [3] * 5 and last[-1]["v"] is None and last[0]["total"] == 25


def test_multiset_join_pairs_copies_one_to_one(spark):
    a = spark.createDataFrame([("k", None, 1), ("k", None, 2), ("k", "x", 3)], "key string, f string, a int")
    b = spark.createDataFrame([("k", None, 9), ("k", "x", 7), ("k", "x", 8)], "key string, f string, b int")
    out = joins.multiset_join(a, b, ["key", "f"], [F.col("a")], [F.col("b")])
    assert sorted((r["a"], r["b"]) for r in out.collect()) == [(1, 9), (3, 7)]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(10)
    points = [(i, round(37 + rng.random() / 10, 4), round(127 + rng.random() / 10, 4)) for i in range(60)]
    targets = [(f"t{i}", round(37 + rng.random() / 10, 4), round(127 + rng.random() / 10, 4)) for i in range(40)]
    out = joins.nearest(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(targets, "name string, lat double, lon double"))
    cell = lambda v: math.floor(v / 0.01)
    for r in out.collect():
        near = []
        for name, lat, lon in targets:
            if abs(cell(lat) - cell(r["lat"])) <= 2 and abs(cell(lon) - cell(r["lon"])) <= 2:
                a, b = math.radians(r["lat"]), math.radians(lat)
                h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon - r["lon"]) / 2) ** 2
                near.append((6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), name))
        assert r["nearest_name"] == (min(near)[1] if near else None)


def test_guards_raise(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="not unique"):
        joins.join_snapshot(df, df, ["k"]).collect()
    dated = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2021, 1, 1),)], "date date")
    with pytest.raises(ValueError):
        sets.union_disjoint(dated, dated)
    with pytest.raises(ValueError):
        sets.assert_disjoint(df, df, ["k"])
    docs = spark.createDataFrame([("a", "x")], "k string, p string")
    with pytest.raises(Exception, match="document is gone"):
        sets.document_delta(docs, docs.limit(0), "k", "p").collect()


def test_overlaps_are_found_in_one_pass(spark):
    rows = [("s1", "2020-01-01", "2020-12-31", "h1"), ("s2", "2020-02-01", "2020-02-10", "h2"), ("s3", "2020-06-01", "2020-07-01", "h3"), ("s4", "2021-01-01", "2021-02-01", "h3")]
    df = spark.createDataFrame([("sale", "x", *r) for r in rows], "kind string, sido string, source_id string, start string, end string, sha256 string")
    df = df.withColumns({"start": F.col("start").cast("date"), "end": F.col("end").cast("date")})
    got = {r["source_id"]: (r["overlaps_with"], r["repeated_file"]) for r in quality.overlapping_sources(df).collect()}
    assert got == {"s2": ("s1", False), "s3": ("s1", True), "s4": (None, True)}


def test_quantile_model_never_crosses_and_calibrates(spark):
    rng = random.Random(11)
    rows = [(rng.random(), rng.choice([None, 1.0, 2.0]), 7.0) for _ in range(1500)]
    rows = [(x, z, a, a + x + rng.gauss(0, 0.1 + (z or 0) * 0.1), "r", f"c{i % 30}", 80.0) for i, (x, z, a) in enumerate(rows)]
    df = spark.createDataFrame(rows, "x double, z double, anchor double, actual double, region string, complex string, area double")
    train, test = df.where("x < 0.7"), df.where("x >= 0.7")
    model = models.calibrate(models.fit_quantiles(train, ["x", "z"]), test)
    out = model.transform(test)
    assert out.where("p10 > p50 OR p50 > p90").count() == 0
    coverage = evaluation.quantile_metrics(out, {"all": F.lit("all")}).first()["coverage80_pct"]
    assert 74 < coverage < 86
    point = models.fit_residual(train, ["x", "z"], trees=3).transform(test, "point")
    kept = models.retain_median(model.transform(point), "point")
    assert kept.where("p50 <> point OR p10 > p50 OR p50 > p90").count() == 0


def test_pages_are_selected_key_by_key(spark, monkeypatch):
    import random

    from pricetide.operators import dashboard

    monkeypatch.setattr(dashboard, "SMALL", 7)
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.5, 1.5, -2.0, 7.0, float("nan")]), rng.choice([None, "", "가나", "가", "b" * rng.randint(1, 4)]), k) for k in range(230)]
    df = spark.createDataFrame(rows, "v double, s string, id int")
    keys = [("v", "desc"), ("s", "asc")]
    want = [r["id"] for r in dashboard.ordered(df.where("v IS NULL OR NOT isnan(v)"), keys, ["id"]).collect()]
    clean = df.where("v IS NULL OR NOT isnan(v)")
    pages = -(-len(want) // 20)
    for page in (0, 1, 2, pages // 2, pages - 1, pages, 99):
        got = dashboard.paginate(clean, keys, ["id"], page, 20).orderBy("position").collect()
        at = max(1, min(pages, page))
        assert [r["id"] for r in got] == want[(at - 1) * 20 : at * 20], page
        assert {(r["page"], r["page_count"], r["total"]) for r in got} == {(at, pages, len(want))} and got[0]["position"] == (at - 1) * 20 + 1
    assert dashboard.paginate(clean.limit(0), keys, ["id"]).count() == 0


def test_case_benchmark_leaves_the_whole_complex_out(spark):
    import random
    import statistics

    from pricetide.operators import snapshot

    rng = random.Random(5)
    rows = []
    for c in range(9):
        for area in (31, 35, 41):  # two types of one complex share an area band
            for k in range(8):
                day = dt.date(1997, 8, 1) + dt.timedelta(days=rng.randint(0, 100)) if k < 4 else dt.date(1998, 8, 1) + dt.timedelta(days=rng.randint(0, 120))
                rows.append((f"{c}|{area}", f"c{c}", "g", float(area), day, rng.randint(1, 9) * 1.0, 5.0, rng.choice([0.1, 0.2, rng.random()])))
    df = spark.createDataFrame(rows, "key string, complex string, gu string, area double, date date, price double, floor double, log_price double")
    cases = F.col("complex").isin("c0", "c4")
    got = snapshot.case_horizons(df, cases, ["1998-01-01"]).collect()
    every = {(r["key"], r["lo"]): r for r in snapshot.case_horizons(df, F.lit(True), ["1998-01-01"]).collect()}
    assert got
    for r in got:
        others = [o["growth"] for o in every.values() if (o["lo"], o["peer"]) == (r["lo"], r["peer"]) and o["complex"] != r["complex"] and o["growth"] is not None]
        assert r["benchmark"] is None if not others else abs(r["benchmark"] - statistics.median(others)) < 1e-12
        assert r["peer_complexes"] == len({o["complex"] for o in every.values() if (o["lo"], o["peer"]) == (r["lo"], r["peer"]) and o["complex"] != r["complex"] and o["growth"] is not None})


def test_attributes_merge_in_any_order_and_over_years(spark):
    from pricetide.operators import summary

    rows = [
        ("k", "c", 1999, "1999-01-02", 5.0, 3.0, None, "far", None, False, "", 2), ("k", "c", 1999, "1999-01-01", 5.0, 3.0, 700, "near", 4, None, None, None),
        ("k", "c", 2000, "2000-01-01", 6.0, None, 700, "later", 9, True, "line 2", 7), ("k", "c", 2000, "2000-01-03", 6.0, 1.0, 900, "x", 9, False, "line 3", None),
        ("l", "c", 2000, "2000-01-03", None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "key string, complex string, year int, date string, price double, floor double, m int, name string, edu int, near boolean, line string, built int")
    df = df.withColumns({"gu": F.lit("g"), "dong": F.lit("d")})
    rules = summary.Attributes(nearest={"m": ["name"]}, largest={"edu": []}, any_true=["near"], first_known=["line", "built"])
    for shuffled in (df, df.orderBy(F.desc("date")).repartition(3)):
        got = {(r["key"], r["bucket"]): r for r in summary.type_summary(shuffled, attributes=rules).collect()}
        assert len(got) == 5
        al = got["k", "all"]
        assert (al["m"], al["name"], al["edu"], al["near"], al["line"], al["built"], al["floor_n"], al["price_median"], al["n"]) == (700, "near", 9, True, "line 2", 2, 3, 5.5, 4)
        assert (got["k", "1999"]["name"], got["k", "2000"]["name"], got["k", "1999"]["line"], got["k", "2000"]["built"]) == ("near", "later", None, 7)
        assert got["l", "all"]["n"] == 1 and got["l", "all"]["price_median"] is None and got["l", "2000"]["name"] is None
    # An unknown region is a region of its own.
    nowhere = df.withColumn("dong", F.lit(None).cast("string"))
    assert summary.type_summary(nowhere, attributes=rules).count() == 5
    regions = {(r["dong"], r["bucket"], r["metric"]): r["n"] for r in summary.region_summary(nowhere.withColumns({"sido": F.lit("s"), "area": F.lit(10.0)})).collect()}
    assert regions[None, "all", "price_billion"] == 4 and regions[None, "1999", "area_pyeong"] == 2
    merged = summary.merge_attributes(df.where("key = 'k'"), ["key"], rules).first()
    assert (merged["name"], merged["edu"], merged["line"]) == ("near", 9, "line 2")
