import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.operators import annual, history, leases, snapshot, stats
from pricetide.operators.stats import median_of

SCHEMA = "key string, complex string, peer string, gu string, area double, built int, floor double, date date, price double"


def trades(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns(
        {"day": F.unix_date("date"), "year": F.year("date"), "month": F.date_format("date", "yyyy-MM"),
         "log_price": F.ln(F.col("price") / F.col("area")), "price_oku": F.col("price") / 10000}
    )


def make(rng, n, start=dt.date(2021, 1, 1), days=900):
    rows = []
    for _ in range(n):
        c = rng.randint(1, 4)
        a = rng.choice([59.5, 84.9])
        rows.append((f"c{c}|{a}", f"c{c}", f"g:{int(a // 15)}", "g", a, 2000 + c, float(rng.randint(1, 30)),
                     start + dt.timedelta(days=rng.randint(0, days)), round(rng.uniform(30000, 90000), 0)))
    return rows


def reference_history(rows, key, origin, lag):
    """Plain restatement of the window rules for one type and origin."""
    hist = sorted((r[7], math.log(r[8] / r[4])) for r in rows if r[0] == key and (origin - r[7]).days >= lag)
    age = lambda d: (origin - d).days
    out = {}
    for n in (30, 90, 180, 365):
        v = [p for d, p in hist if age(d) <= lag + n]
        out[f"n{n}"], out[f"median{n}"] = len(v), (float(np.median(v)) if v else None)
    recent = [(p, 2 ** (-age(d) / 90)) for d, p in hist if age(d) <= lag + 365]
    if recent:
        recent.sort()
        w = np.cumsum([x[1] for x in recent])
        out["ew90"] = recent[int(np.searchsorted(w, w[-1] / 2))][0]
    out["last_day"] = hist[-1][0] if hist else None
    return out


def test_features_equal_a_plain_restatement(spark):
    rows = make(random.Random(5), 400)
    got = history.monthly_features(trades(spark, rows), history.Lag(uniform=31), "2022-03-01", "2022-12-01").collect()
    assert got
    for r in random.Random(6).sample(got, 25):
        origin = dt.date.fromisoformat(r["month"] + "-01")
        e = reference_history(rows, r["key"], origin, 31)
        for n in (30, 90, 180, 365):
            assert r[f"n{n}"] == e[f"n{n}"]
        if e["median365"] is not None:
            assert abs(r["median365"] - e["median365"]) < 1e-12
            assert abs(r["ew90"] - e["ew90"]) < 1e-12
        if e["last_day"]:
            assert r["last_age"] == (origin - e["last_day"]).days


def test_later_and_unpublished_rows_change_nothing(spark):
    rows = make(random.Random(7), 300, days=500)
    target = [("c1|84.9", "c1", "g:5", "g", 84.9, 2001, 5.0, dt.date(2022, 4, 20), 50000.0)]
    # The cut-off of April 2022 under 31 days is 1 March.
    late = [("c1|84.9", "c1", "g:5", "g", 84.9, 2001, 9.0, dt.date(2022, 3, 2), 999999.0), ("c1|84.9", "c1", "g:5", "g", 84.9, 2001, 9.0, dt.date(2022, 4, 2), 1.0)]
    rows = [r for r in rows if r[7] <= dt.date(2022, 3, 1)]
    run = lambda data: history.monthly_features(trades(spark, data), history.Lag(uniform=31), "2022-04-01", "2022-04-01").where("contract_date = '2022-04-20'").collect()
    before, after = run(rows + target), run(rows + target + late)
    assert before == after and len(before) == 1


def test_policy_lag_keeps_old_law_rows_back(spark):
    law = "2020-02-21"
    rows = [("k", "c", "p", "g", 60.0, 2000, 1.0, dt.date(2020, 2, 20), 100.0), ("k", "c", "p", "g", 60.0, 2000, 1.0, dt.date(2020, 2, 21), 100.0)]
    served = history.history_join(trades(spark, rows), history.Lag(law_change=law), "2020-03-01", "2020-06-01")
    got = sorted((str(r["date"]), str(r["origin"])) for r in served.collect())
    assert [g[1] for g in got if g[0] == "2020-02-20"] == ["2020-05-01", "2020-06-01"]
    assert [g[1] for g in got if g[0] == "2020-02-21"] == ["2020-04-01", "2020-05-01", "2020-06-01"]


def test_snapshot_needs_three_trades_and_path_window_is_half_open(spark):
    base = lambda d, p=60000.0, k="k1": (k, "c1", "x", "g", 60.0, 2000, 5.0, d, p)
    rows = [base(dt.date(2010, 4, d)) for d in (1, 2, 3)] + [base(dt.date(2010, 4, 1), k="k2")] * 2
    rows += [base(dt.date(2011, 1, 1)), base(dt.date(2011, 1, 2)), base(dt.date(2012, 1, 1)), base(dt.date(2011, 6, 1))]
    t = trades(spark, rows)
    snap = snapshot.price_snapshot(t, None, "2010-07-01", "2010-07-01")
    assert [r["key"] for r in snap.collect()] == ["k1"]
    labelled = snapshot.exits(t, [18], 12, False, "2010-07-01", "2010-07-01").collect()
    assert sorted(str(r["date"]) for r in labelled) == ["2011-01-02", "2011-06-01", "2012-01-01"]


def test_benchmark_excludes_the_own_complex_and_needs_five_others(spark):
    rows = [("o", 12, "p", f"c{i}", float(i)) for i in range(7)] + [("o", 12, "p", "c0", 100.0), ("o", 12, "q", "z", 1.0), ("o", 12, "p", "c9", None)]
    df = spark.createDataFrame(rows, "origin string, horizon_months int, peer string, complex string, growth double")
    got = {(r["peer"], r["complex"]): r["benchmark"] for r in snapshot.loo_benchmark(df).collect()}
    medians = {f"c{i}": float(i) for i in range(7)} | {"c0": 50.0}
    for c in [f"c{i}" for i in range(7)] + ["c9"]:
        assert got[("p", c)] == float(np.median([v for k, v in medians.items() if k != c]))
    assert got[("q", "z")] is None


def test_index_change_never_skips_a_month(spark):
    rows = [("11", "sale", dt.date(2020, m, 1), float(m * 10)) for m in (1, 2, 4)]
    df = spark.createDataFrame(rows, "gu string, kind string, period date, value double")
    got = {str(r["period"]): r["change_1m"] for r in history.observed_index(df, ["sale"], [1]).collect()}
    assert abs(got["2020-02-01"] - math.log(2)) < 1e-12
    assert got["2020-03-01"] is None and got["2020-04-01"] is None


def test_leases_respect_receipt_year_and_signatures(spark):
    row = lambda d, kind="신규", receipt=2021, dep=300.0: ("k", d, 3.0, dep, 0.0, kind, receipt, math.log(dep / 60))
    rows = [row(dt.date(2021, 5, 1))] * 3 + [row(dt.date(2021, 5, 2), dep=400.0), row(dt.date(2021, 5, 3), dep=500.0), row(dt.date(2021, 5, 4), receipt=2022), row(dt.date(2021, 5, 5), "갱신")]
    df = spark.createDataFrame(rows, "key string, date date, floor double, deposit double, monthly_rent double, contract_type string, receipt_year int, log_rent double")
    once = leases.lease_snapshot(df, "2021-07-01").first()
    assert (once["lease_new_n180"], once["lease_renewal_n180"]) == (3, 1)
    assert abs(once["lease_log180"] - math.log(400 / 60)) < 1e-12
    assert leases.lease_snapshot(df, "2021-07-01", unique=False).first()["lease_new_n180"] == 5


def test_missing_availability_raises(spark):
    df = spark.createDataFrame([("s", None, 1.0)], "series_id string, available_at timestamp, value double")
    with pytest.raises(Exception, match="when it became public"):
        leases.observable(df, "2024-01-01").collect()


def test_sibling_anchor_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for c in ("x", "y"):
        for area in (40.0, 50.0, 55.0, 60.0, 90.0):
            for year in range(2015, 2021):
                if rng.random() < 0.6:
                    rows.append(("s", "g", "d", f"{c}|{area}", c, 2000, area, year, rng.uniform(900, 2000), rng.randint(1, 6)))
    df = spark.createDataFrame(rows, "sido string, gu string, dong string, key string, complex string, built int, area double, year int, price double, n long")
    got = {(r["key"], r["year"]): r["sibling_price"] for r in annual.sibling_anchor(annual.annual_panel(df)).collect()}
    for me in rows:
        best = None
        for key in {r[3] for r in rows if r[4] == me[4] and r[3] != me[3]}:
            past = [r for r in rows if r[3] == key and r[9] >= 3 and r[7] < me[7]]
            if past:
                s = max(past, key=lambda r: r[7])
                if me[7] - s[7] <= 3 and 1 / 1.5 <= me[6] / s[6] <= 1.5:
                    rank = (-s[7], abs(math.log(me[6] / s[6])), -s[9], s[3])
                    best = min(best, (rank, math.log(s[8]))) if best else (rank, math.log(s[8]))
        expected = best[1] if best else None
        value = got[(me[3], me[7])]
        assert (value is None) == (expected is None) and (value is None or abs(value - expected) < 1e-12)


def test_newest_values_that_are_no_levels_may_be_zero(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("s", "1", at, 5.0, 1), ("s", "1", at, 0.0, 2), ("s", "1", at, None, 3), ("s", "2", at, None, 4), ("s", "2", dt.datetime(2024, 3, 1), 7.0, 5)]
    df = spark.createDataFrame(rows, "series_id string, period string, available_at timestamp, value double, event_id long")
    got = {r["period"]: r["value"] for r in leases.latest_vintage(df, "2024-01-20", tie=("event_id",), levels=False).collect()}
    assert got == {"1": 0.0, "2": None}
    with pytest.raises(Exception, match="must be positive"):
        leases.latest_vintage(df, "2024-01-20", tie=("event_id",)).collect()


def test_small_groups_take_one_shuffle(spark):
    """Levels of the snapshot and outcomes of its types: nothing is counted by value and joined again."""
    days = [dt.date(2010, 1, 5) + dt.timedelta(d) for d in range(0, 300, 7)]
    rows = [(f"c{k}|60", f"c{k}", "g", 60.0, 2000.0, d, 100.0 + k, 5.0, 4.0 + 0.01 * k + 0.001 * i) for k in range(4) for i, d in enumerate(days)]
    t = spark.createDataFrame(rows, "key string, complex string, gu string, area double, built double, date date, price double, floor double, log_price double")
    exits = snapshot.exits(t, (12,), 6, True, "2009-01-01", "2010-01-01")
    plan = median_of(exits, ["origin", "horizon_months", "key"], "log_price", "exit", None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    hot = spark.createDataFrame([("c0|60",)], "key string")
    both = [sorted(map(tuple, median_of(exits, ["origin", "horizon_months", "key"], "log_price", "exit", crowd).collect())) for crowd in (None, hot)]
    assert both[0] == both[1] and len(both[0]) > 0


def test_crowded_keys_and_pools_give_the_same_features(spark, monkeypatch):
    """Also: the history of ordinary keys moves before it is copied to origins, so no plan deals rows out by origin and key to order them."""
    t = trades(spark, make(random.Random(9), 300, days=500))
    lag, span = history.Lag(uniform=31), ("2022-02-01", "2022-05-01")
    plain = lambda df: df.select(*[F.round(c, 9).alias(c) if kind == "double" else c for c, kind in sorted(df.dtypes)])
    key = lambda df: sorted(map(str, plain(df).collect()))
    pools = key(history.pools_of(t, lag, *span))
    assert pools == key(history.pools(history.history_join(t, lag, *span)))
    features = key(history.monthly_features(t, lag, *span))
    wanted = t.select(F.lit(dt.date(2022, 3, 1)).alias("origin"), "key").distinct()
    own = history.own_stats(history.served_of(t, wanted, lag, *span), None, None, "log_price", {"m": history.Quantile(0.5)})
    assert "Exchange hashpartitioning(origin" not in own._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(history, "crowded", lambda df, by: stats.crowded(df, by, 5))
    assert pools == key(history.pools_of(t, lag, *span))
    assert features == key(history.monthly_features(t, lag, *span))


def test_histories_in_batches_equal_the_plain_way(spark, monkeypatch):
    """Odd rows, a law change and groups over several batches; before, every trade was copied to its origins and ordered there."""
    from pricetide.operators import traces

    rng = random.Random(11)
    rows = make(rng, 500, days=700)
    rows += [(*r[:6], None if k % 3 == 0 else r[6], None if k % 4 == 0 else r[7], None if k % 5 == 0 else -1.0 if k % 7 == 0 else r[8]) for k, r in enumerate(make(rng, 200, days=700))]
    rows += [("alone", "c9", "g:1", "g", 60.0, 2000, None, dt.date(2022, 4, 3), 5.0), ("undated", "c9", "g:1", "g", 60.0, 2000, 1.0, None, 7.0),
             ("undated", "c9", "g:1", "g", 60.0, 2000, 1.0, dt.date(2022, 4, 3), 9.0), (None, None, None, "g", 60.0, 2000, 1.0, dt.date(2022, 4, 3), 9.0)] + rows[:60]
    t = trades(spark, rows)
    lag = history.Lag(law_change="2021-10-15")
    span = ("2021-11-01", "2022-11-01")
    features = history.monthly_features(t, lag, *span)
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
    told = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())
    plain = told(features)
    assert len(plan) and any("undated" in r for r in plain)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(traces, "PAIRS", 50)
    try:
        assert told(history.monthly_features(t, lag, *span)) == plain
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    monkeypatch.setattr(history, "crowded", lambda df, by: stats.crowded(df, by, 0))
    assert told(history.monthly_features(t, lag, *span)) == plain
    assert told(history.pools_of(t, lag, *span)) == told(history.pools(history.history_join(t.where("complex IS NOT NULL"), lag, *span)))
    monkeypatch.setattr(history, "crowded", lambda df, by: None if "_bin" in by else stats.crowded(df, by, 0))
    assert told(history.pools_of(t, lag, *span)) == told(history.pools(history.history_join(t.where("complex IS NOT NULL"), lag, *span)))


def test_cadence_and_prediction_read_their_trades_once(spark, monkeypatch):
    """Before, each use of the joined trades computed them again."""
    from pricetide.plans import history as history_plans
    from pricetide.plans import models as model_plans

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = trades(spark, make(random.Random(12), 300, start=dt.date(1999, 1, 1), days=800))
    for module in (history_plans, model_plans):
        monkeypatch.setattr(module, "clean", lambda spark, sf_dir: df.mapInArrow(count, df.schema))
    both = history_plans.cadence(spark, "").collect()
    assert seen.value == 300 and {r["year"] for r in both} >= {2000}
    priced = model_plans.predict_current(spark, "").collect()
    assert seen.value == 600 and priced and all(r["estimated_price_oku"] > 0 for r in priced)
