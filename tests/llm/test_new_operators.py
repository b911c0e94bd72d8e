"""Whitening, hard negatives and token-id files against brute force and the tokenizer's library."""

import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricetide.llm import idblocks, lemp, whitening
from pricetide.llm.queries import BYTES
from pricetide.session import scratch_path

RNG = np.random.default_rng(11)
VECTORS = "vec_id long, embedding array<double>, label int, x string"


def table(spark, vectors, labels=None, ids=None):
    labels = [0] * len(vectors) if labels is None else labels
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], b, "-") for i, v, b in zip(ids, vectors, labels, strict=True)], VECTORS)


def test_planes_count_cross_products():
    y = RNG.integers(0, 1 << 9, (150, 5))
    into = np.zeros((17, 5, 5), np.int64)
    whitening.crossed(whitening.planes(y, 9), into)
    assert (np.triu((into << np.arange(17)[:, None, None]).sum(0)) == np.triu(y.T @ y)).all()


def test_whitening_equals_brute_force(spark):
    v = RNG.normal(0, 1, (200, 20)) @ RNG.normal(0, 1, (20, 20))
    rows = [*v, v[3], v[3], None, [None] * 20, [float("nan")] * 20, [float("inf")] * 20, [0] * 20, [1e300] * 20, [], [1.0]]
    got = whitening.whiten(table(spark, rows)).collect()
    kept = np.array([*v, v[3], v[3], [0] * 20])
    x = np.floor(64 * kept).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    cov = np.array([[float(Fraction(int(n * (fit[:, i] * fit[:, j]).sum() - s[i] * s[j]), n * n)) for i in range(20)] for j in range(20)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    names = [*range(202), 206]
    assert sorted(r["vec_id"] for r in got) == names
    for r in got:
        d = n * x[names.index(r["vec_id"])] - s
        assert r["n"] == n and int(r["deviation"]) == int((d.astype(object) ** 2).sum())
        np.testing.assert_allclose(np.abs(r["whitened"]), np.abs(d / n @ u / np.sqrt(e)), rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(r["explained"], e / np.trace(cov), rtol=1e-9)
        assert r["identity_error"] < 1e-8


def test_whitening_of_large_entries_and_without_variance(spark):
    v = RNG.normal(0, 1e12, (70, 3))
    got = whitening.whiten(table(spark, v), components=2).orderBy("vec_id").collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in row] for row in v]
    total = [sum(c) for c in zip(*x, strict=True)]
    assert [int(r["deviation"]) for r in got] == [sum((70 * c - t) ** 2 for c, t in zip(row, total, strict=True)) for row in x]
    assert all(r["identity_error"] < 1e-6 and len(r["whitened"]) == 2 for r in got)
    same = whitening.whiten(table(spark, [[1, 2]] * 3)).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"]) for r in same] == [(1, 0, [])] * 3
    flat = whitening.whiten(table(spark, [[k, 5.0] for k in range(9)])).collect()
    assert {len(r["whitened"]) for r in flat} == {1}
    assert whitening.whiten(table(spark, [])).collect() == []


def hard(vectors, labels, ids, asks):
    """Brute force in Python's integers."""
    rows = [(i, b, [int(np.floor(256 * c)) for c in v], k) for k, (v, b, i) in enumerate(zip(vectors, labels, ids, strict=True)) if v is not None and b is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    last = float("inf")
    out = []
    for i, b, x, k in rows:
        if i is None or not asks(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), last if j is None else j, m, c) for j, c, y, m in rows if m != k)
        for s, p, _, _ in [r for r in scored if r[3] == b][:5]:
            chosen = [r for r in scored if r[3] != b and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(i, None if p == last else p, n + 1, None if r[1] == last else r[1], -s, -r[0]) for n, r in enumerate(chosen)]
    return sorted(out, key=str)


def mined(df):
    return sorted((tuple(r) for r in lemp.mine(df, F.col("vec_id") % 10 == 0).collect()), key=str)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    centre = RNG.normal(0, 1, (6, 12))
    v = [*(centre[RNG.integers(0, 6, 300)] + RNG.normal(0, 0.5, (300, 12))) * RNG.choice([0.3, 1, 4], (300, 1))]
    v += [v[0]] * 40 + [[0] * 12] * 3 + [None, [None] * 12, [float("nan")] * 12]
    labels = [*map(int, RNG.integers(0, 4, 340)), 0, 1, 2, 1, 1, 1]
    labels[5] = None
    ids = [*range(len(v))]
    ids[7] = ids[8] = None
    ids[31] = 30
    df = table(spark, v, labels, ids)
    want = hard(v, labels, ids, lambda i: i % 10 == 0)
    assert want and mined(df) == want
    # One row a block, or all in one bucket and block.
    monkeypatch.setattr(lemp, "NUMBERS", 12 * 5)
    assert mined(df) == want
    assert lemp.mine(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert lemp.mine(table(spark, v[:9], labels[:9]), F.lit(False)).collect() == []
    # Alone of its label, and with negative scores only.
    assert lemp.mine(table(spark, [[1, 0], [1, 0], [-1, 0]], [0, 1, 0]), F.lit(True)).collect() == []


def test_candidates_hold_all_rows_that_reach_a_score():
    x = RNG.integers(-300, 300, (500, 16))
    x[:20] = 0
    lists = lemp.Lists(x, np.arange(500), np.arange(500))
    for _ in range(40):
        q = RNG.integers(-300, 300, 16) + x[RNG.integers(0, 500)]
        scores, size = x @ q, float(np.sqrt((q.astype(float) ** 2).sum()))
        for least in (0.9 * scores.max(), 0.5 * scores.max(), float(scores.max()), scores.max() + 1.0):
            got, found = lists.scored(q, size, least)
            assert set(np.flatnonzero(scores >= least)) <= set(got) and (found == scores[got]).all()


def test_frames_round_trip():
    for ids in (RNG.integers(0, 50_257, 3000), np.r_[np.full(700, 9), 50_000, np.arange(400)], np.zeros(5), np.array([2**32 - 1, 0, 7]), np.zeros(0), RNG.integers(0, 2**32, 256)):
        ids = ids.astype(np.uint32)
        f = idblocks.File(idblocks.file_of(1, 2, [4, None], [ids[:3], ids[3:]]))
        assert (f.part, f.number, f.documents, f.size) == (1, 2, 2, len(ids))
        assert (f.ids(0, f.size) == ids).all()
        for _ in range(20):
            a, b = sorted(RNG.integers(0, len(ids) + 1, 2))
            assert (f.ids(int(a), int(b)) == ids[a:b]).all()
    narrow = np.tile(np.arange(8), 500).astype(np.uint32)
    narrow[::50] = 60_000
    f = idblocks.File(idblocks.file_of(0, 0, [0], [narrow]))
    assert set(f.width) == {3} and f.count.sum() == 80 and len(f.data) < 2 * len(narrow)
    with pytest.raises(ValueError):
        idblocks.File(b"x" * struct.calcsize(idblocks.HEAD))


@pytest.mark.parametrize("specials", [[], ["<|endoftext|>"]])
def test_token_files_equal_the_library(spark, monkeypatch, specials):
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    letters = [*"ab  't\t\n\r1.é中×&#", "\u00a0", "\u2028", "\u3000", "\u0085", "\x1f", "\x1c", "𝄞", "'ll", "don't ", "  ", " word", "\nÉt", "\n\n", *specials]
    texts = [None, "", " ", "  \n ", "x" * 5000, "long " * 30_000, *("".join(RNG.choice(letters, RNG.integers(1, 200))) for _ in range(300))]
    rows = [(k if k != 8 else None, t, "-") for k, t in enumerate(texts)] + [(9, texts[9], "-"), (9, "other", "-"), (None, None, "-")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = scratch_path(spark, "ids")
    idblocks.write_ids(df.repartition(3), BYTES, path, most=2000)
    got = idblocks.read_ids(spark, path).orderBy("start").collect()
    assert [r["name"] for r in got] == sorted((r[0] for r in rows), key=lambda k: -1 if k is None else k)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    want = sorted((str(k), np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for k, t, _ in rows)
    assert sorted((str(r["name"]), bytes(r["ids"])) for r in got) == want
    assert spark.read.format("binaryFile").load(path).count() > 10
    digest = {(r["name"], r["c"]) for r in idblocks.read_ids(spark, path).select("name", F.crc32("ids").alias("c")).collect()}
    assert digest == {(r["name"], zlib.crc32(r["ids"])) for r in got}
    empty = scratch_path(spark, "ids")
    idblocks.write_ids(df.limit(0), BYTES, empty)
    assert idblocks.read_ids(spark, empty).count() == 0


def test_many_copies_of_a_row_spread_over_ranges(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text of many").alias("text"))
    path = scratch_path(spark, "ids")
    idblocks.write_ids(df, BYTES, path)
    parts = idblocks.read_ids(spark, path)
    assert parts.count() == 4000 and parts.agg(F.max("start")).first()[0] == 3999 * 5
