import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pricetide.session import scratch_path
from pricetide.streaming import ledger, refresh

SCHEMA = "partition string, observed_at timestamp, row string"
at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)


def polls(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def replay(rows):
    """Plain restatement of the ledger for small poll lists."""
    changes, last = [], {}
    for p, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: x[1]):
        now = Counter(r[2] for r in rows if (r[0], r[1]) == (p, t) and r[2] is not None)
        for row in set(now) | {k for q, k in last if q == p}:
            if last.get((p, row), 0) != now.get(row, 0):
                changes.append((p, row, t, now.get(row, 0)))
                last[(p, row)] = now.get(row, 0)
    return sorted(changes)


def changes_of(book):
    return sorted((r["partition"], r["row"], r["observed_at"], r["count"]) for r in book.changes().collect())


def random_polls(seed, days):
    rng = random.Random(seed)
    rows = []
    for d in days:
        for p in ("a", "b"):
            content = [f"r{rng.randint(0, 4)}" for _ in range(rng.randint(0, 6))]
            rows += [(p, at(d), c) for c in content] or [(p, at(d), None)]
    return rows


def test_stream_in_many_batches_equals_one_batch_and_plain_replay(spark):
    rows = random_polls(1, range(1, 8))
    root = scratch_path(spark, "test-ledger")
    book = ledger.Ledger(spark, f"{root}/ledger")
    for d in range(1, 8):
        ledger.write_polls(polls(spark, [r for r in rows if r[1] == at(d)]), f"{root}/polls")
        if d in (3, 4, 7):
            book.run(ledger.read_polls(spark, f"{root}/polls"), f"{root}/cp")
    assert changes_of(book) == replay(rows)
    assert book.rejected().count() == 0
    for d in (2, 5):
        seen = ledger.rows_as_observed(book.changes(), book.polls(), str(at(d, 12))).collect()
        assert Counter((r["partition"], r["row"]) for r in seen) == Counter((p, r) for p, t, r in rows if t == at(d) and r is not None)


def test_retried_batch_rewrites_the_same_rows(spark):
    rows = random_polls(2, (1, 2))
    book = ledger.Ledger(spark, scratch_path(spark, "test-retry"))

    def records(d):
        df = polls(spark, [r for r in rows if r[1] == at(d)])
        n = df.groupBy("partition", "observed_at").agg(F.count("row").alias("poll_rows"))
        return df.join(n, ["partition", "observed_at"]).select("partition", "observed_at", "poll_rows", "row")
    book.apply(records(1), 0)
    book.apply(records(2), 1)
    first = changes_of(book)
    book.apply(records(2), 1)
    assert changes_of(book) == first == replay(rows)


def test_late_polls_are_set_aside(spark):
    root = scratch_path(spark, "test-late")
    book = ledger.Ledger(spark, f"{root}/ledger")
    ledger.write_polls(polls(spark, [("a", at(5), "x")]), f"{root}/polls")
    book.run(ledger.read_polls(spark, f"{root}/polls"), f"{root}/cp")
    ledger.write_polls(polls(spark, [("a", at(4), "y"), ("a", at(5), "y"), ("a", at(6), "y")]), f"{root}/polls")
    book.run(ledger.read_polls(spark, f"{root}/polls"), f"{root}/cp")
    assert sorted((r["observed_at"], r["reason"]) for r in book.rejected().collect()) == [(at(4), "older_than_latest"), (at(5), "repeated_instant")]
    assert changes_of(book) == [("a", "x", at(5), 1), ("a", "x", at(6), 0), ("a", "y", at(6), 1)]


def test_incomplete_poll_and_unknown_past_raise(spark):
    df = spark.createDataFrame([("a", at(1), 2, "x")], "partition string, observed_at timestamp, poll_rows long, row string")
    book = ledger.Ledger(spark, scratch_path(spark, "test-incomplete"))
    with pytest.raises(Exception, match="incomplete polls"):
        book.apply(df, 0)
    book = ledger.Ledger(spark, scratch_path(spark, "test-past"))
    book.apply(df.withColumn("poll_rows", F.lit(1).cast("long")), 0)
    with pytest.raises(Exception, match="nothing had been observed"):
        ledger.rows_as_observed(book.changes(), book.polls(), "2023-12-31").collect()


def test_versions_are_idempotent_and_paging_is_pinned(spark):
    store = refresh.VersionedStore(spark, scratch_path(spark, "test-store"))
    rows = spark.range(1, 201).select(F.col("id").alias("row_no"), F.lit("e").alias("entity_key"), F.lit("2024-01-01").alias("observed_day"), F.lit("r").alias("region_code"), F.col("id").cast("string").alias("payload"))
    first = store.publish(rows, "d")
    again = store.publish(rows.repartition(7), "d")
    assert first["changed"] and not again["changed"] and again["version"] == first["version"]
    second = store.publish(rows.where("row_no <= 50"), "d")
    assert second["version"] != first["version"]
    page = [r["row_no"] for r in store.query("d", first["version"], after=60, limit=5).collect()]
    assert page == [61, 62, 63, 64, 65]
    assert store.query("d", after=60).count() == 0
    back = store.publish(rows, "d")
    assert back["changed"] and back["version"] == first["version"]
    with pytest.raises(ValueError):
        store.publish(rows.limit(0), "d")


def test_refresh_replaces_only_its_partitions(spark):
    path = scratch_path(spark, "test-refresh")
    df = spark.createDataFrame([("m1", "a", 1), ("m1", "b", 2), ("m2", "a", 3)], "month string, region string, v int")
    refresh.write_partitions(df, path, ["month", "region"])
    out = refresh.apply_refresh(spark, path, df.where("month = 'm1' AND region = 'a'").withColumn("v", F.lit(9)), ["month", "region"])
    assert out.first()["matches"]
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2, 3, 9]


def test_refresh_plan_merges_adjacent_months(spark):
    scopes = spark.createDataFrame([("s", dt.date(2023, 1, 5), dt.date(2024, 2, 10))], "scope string, start date, cutoff date")
    spans = sorted((str(r["first_day"]), str(r["last_day"]), r["months"]) for r in refresh.refresh_plan(scopes).collect())
    assert ("2024-01-01", "2024-02-10", 2) in spans
    assert sum(s[2] for s in spans) == 4


def test_repeated_poll_with_the_same_rows_is_no_fault(spark):
    root = scratch_path(spark, "test-again")
    book = ledger.Ledger(spark, f"{root}/ledger")
    for rows in ([("a", at(5), "x"), ("b", at(5), "x")], [("a", at(5), "x"), ("b", at(5), "x"), ("b", at(5), "x")], [("a", at(6), "z")]):
        ledger.write_polls(polls(spark, rows), f"{root}/polls")
        book.run(ledger.read_polls(spark, f"{root}/polls"), f"{root}/cp")
    assert [(r["partition"], r["reason"]) for r in book.rejected().collect()] == [("b", "repeated_instant")]
    assert changes_of(book) == [("a", "x", at(5), 1), ("a", "x", at(6), 0), ("a", "z", at(6), 1), ("b", "x", at(5), 1)]


def test_refresh_that_does_not_reconcile_leaves_the_table(spark):
    path = scratch_path(spark, "test-reconcile")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    refresh.write_partitions(df, path, ["k"])
    rows = lambda: sorted((r["k"] or "", r["v"]) for r in spark.read.schema("v int, k string").parquet(path).collect())
    before = rows()
    new = spark.createDataFrame([("a", 9), (None, 8)], "k string, v int")
    told = spark.createDataFrame([("a", 2), (None, 1)], "k string, delivered_rows long")
    report = refresh.apply_refresh(spark, path, new, ["k"], told)
    assert {r["k"]: r["matches"] for r in report.collect()} == {"a": False, None: True}
    assert rows() == before
    assert all(r["matches"] for r in refresh.apply_refresh(spark, path, new, ["k"]).collect())
    spark.catalog.clearCache()
    assert rows() == [("", 8), ("a", 9), ("b", 3)]


def recorded(spark, rows, day):
    df = polls(spark, [r for r in rows if r[1] == at(day)])
    n = df.groupBy("partition", "observed_at").agg(F.count("row").alias("poll_rows"))
    return df.join(n, ["partition", "observed_at"]).select("partition", "observed_at", "poll_rows", "row")


def batches_of(df, name):
    return {int(f.split(f"/{name}/batch_id=")[1].split("/")[0]) for f in df.inputFiles() if f"/{name}/" in f}


def test_a_batch_reads_nothing_older_than_the_last_generation(spark):
    rows = random_polls(5, range(1, 11))
    rows += [("c", at(2), "once"), ("c", at(9), "once"), ("c", at(9), "twice")]
    book = ledger.Ledger(spark, scratch_path(spark, "test-generations"), compact_every=3)
    for batch, d in enumerate(range(1, 11)):
        book.apply(recorded(spark, rows, d), batch)
        last = max(book.generations(batch + 1), default=-1)
        known, touched = book.state(batch + 1), spark.createDataFrame([("a",)], "partition string")
        if last >= 0:
            assert last == (batch + 1) // 3 * 3 - 1
            assert batches_of(known, "changes") <= set(range(last + 1, batch + 1))
            assert batches_of(book.heads(batch + 1), "polls") <= set(range(last + 1, batch + 1))
            # One partition's counts are in one bucket of one generation.
            assert len({f.split("/counts/")[1].rsplit("/", 1)[0] for f in book.state(batch + 1, touched).inputFiles() if "/counts/" in f}) == 1
    assert changes_of(book) == replay(rows)
    # "c" was not polled between the second and the third generation: its bucket stayed where it was.
    assert set(book._manifest(8).values()) == {8} and set(book._manifest(5).values()) == {2, 5}
    for d in (2, 4, 6, 7, 9, 10):
        seen = book.rows_as_observed(str(at(d, 12))).collect()
        latest = {p: max(t for q, t, _ in rows if q == p and t <= at(d)) for p in "abc"}
        assert Counter((r["partition"], r["row"]) for r in seen) == Counter((p, r) for p, t, r in rows if t == latest[p] and r is not None)
    changes, _ = book.known_at(str(at(8, 12)))
    assert batches_of(changes, "changes") == {6, 7, 8, 9}
    with pytest.raises(ValueError, match="nothing had been observed"):
        book.rows_as_observed(str(at(1, 12)))


def test_a_retried_batch_after_its_generation_changes_nothing(spark):
    rows = random_polls(6, range(1, 6))
    book = ledger.Ledger(spark, scratch_path(spark, "test-retry-generation"), compact_every=2)
    for batch, d in enumerate(range(1, 5)):
        book.apply(recorded(spark, rows, d), batch)
    before = book.state(4).drop("observed_at").collect()
    book.apply(recorded(spark, rows, 4), 3)
    assert sorted(map(str, book.state(4).drop("observed_at").collect())) == sorted(map(str, before))
    book.apply(recorded(spark, rows, 5), 4)
    assert changes_of(book) == replay(rows)


def test_polls_of_one_batch_are_judged_in_the_order_of_delivery(spark):
    schema = "partition string, observed_at timestamp, row string, delivered_at timestamp"
    rows = [("a", at(3), "x", at(3)), ("a", at(5), "y", at(5)), ("a", at(4), "z", at(6)), ("a", at(5), "y", at(7)), ("a", at(5), "other", at(8)), ("a", at(6), "w", at(9)), ("b", at(4), "z", at(6))]
    root = scratch_path(spark, "test-delivery")
    book = ledger.Ledger(spark, f"{root}/ledger")
    ledger.write_polls(spark.createDataFrame(rows, schema), f"{root}/polls")
    book.run(ledger.read_polls(spark, f"{root}/polls"), f"{root}/cp")
    assert sorted((r["observed_at"], r["reason"]) for r in book.rejected().collect()) == [(at(4), "older_than_latest"), (at(5), "repeated_instant")]
    assert changes_of(book) == [("a", "w", at(6), 1), ("a", "x", at(3), 1), ("a", "x", at(5), 0), ("a", "y", at(5), 1), ("a", "y", at(6), 0), ("b", "z", at(4), 1)]


def test_closed_partitions_leave_the_state(spark):
    book = ledger.Ledger(spark, scratch_path(spark, "test-closed"), compact_every=1, close_after=dt.timedelta(days=5))
    for batch, rows in enumerate([[("a", at(1), "x"), ("b", at(1), "x")], [("b", at(9), "y")], [("a", at(10), "z"), ("b", at(10), "y")]]):
        book.apply(recorded(spark, rows, rows[0][1].day), batch)
    assert [(r["partition"], r["observed_at"], r["reason"]) for r in book.rejected().collect()] == [("a", at(10), "partition_closed")]
    assert {r["partition"] for r in book.state(3).collect()} == {"b"}
    assert Counter((r["partition"], r["row"]) for r in book.rows_as_observed(str(at(1, 12))).collect()) == Counter([("a", "x"), ("b", "x")])
