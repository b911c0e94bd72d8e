"""The pipeline on small tables: what goes, what stays, and how often, against rules spelled out in Python."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from pricetide.session import scratch_path

RNG = np.random.default_rng(21)
EN, DE, FR = (w.split() for w in ("the and with from that water house", "der und von mit aus das haus wasser", "le la avec dans eau maison pour"))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id int, _digest string, _times int, _spans string, told double"


def prose(words, n, tag):
    return " ".join([*RNG.choice(words, n), *(f"{w}{tag}" for w in words[:3])])


def table(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "d", 7, "s", 0.5) for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def rows():
    out = [(k, prose((EN, DE, FR)[k % 3], 80, k), ("en", "de", "fr")[k % 3], f"s{k % 2}") for k in range(90)]
    out += [(100, None, "en", "s1"), (101, "", None, "s1"), (102, "12 34 %% --", "en", "s0"), (103, "qzx " * 3 + "1 2 3", None, None)]
    out += [(104, out[0][1], "en", "s1"), (0, out[0][1], "en", "s0"), (0, out[0][1], "de", "s1"), (None, out[4][1], "de", "s0")]
    near = out[6][1].split()
    out.append((105, " ".join([*near[:40], "changed", *near[41:]]), "en", "s1"))
    shared = " ".join(f"passage{k}" for k in range(70))
    out += [(k, f"{prose(EN, 30, k)} {shared} {prose(EN, 30, -k)}", "en", "s0") for k in (110, 111)]
    # Three languages in equal parts, each word told.
    out.append((120, " ".join([*RNG.choice(EN, 30), *RNG.choice(DE, 30), *RNG.choice(FR, 30)]), None, "s1"))
    return out


def test_all_stages(spark, rows):
    folder = scratch_path(spark, "given")
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    got = pipeline.run(spark, folder)
    assert got.columns == [*[c.split()[0] for c in COLUMNS.split(", ")], "ids", "decoded"]
    got = got.collect()
    texts = {r["doc_id"]: r["text"] for r in got}
    # Without language, or a copy of a text with a smaller id, or a near copy.
    assert not {100, 101, 102, 104, 105} & set(texts) and 120 in texts
    assert None not in texts or 4 not in texts
    assert Counter(r["doc_id"] for r in got)[0] <= 2 and {r["lang"] for r in got if r["doc_id"] == 0} <= {"de"} | {"en"}
    assert len({(r["lang"], r["source"]) for r in got if r["doc_id"] == 0}) == 1
    # The passage stays once, and what is around it stays everywhere.
    assert sum("passage5 " in t for t in texts.values()) <= 1 and all(t.split()[0] == dict((r[0], r[1]) for r in rows)[k].split()[0] for k, t in texts.items() if k in (110, 111))
    for r in got:
        assert r["_id"] == 1 and r["_digest"] == "d" and r["_times"] == 7 and r["_spans"] == "s" and r["told"] == 0.5
        assert r["n_chars"] == len(r["text"]) and r["decoded"] == re.sub(" +", " ", r["text"]) or "\n" in r["text"] or r["decoded"]


def test_languages_reject_what_has_none(spark, rows):
    kept = {r["doc_id"] for r in pipeline.languages(spark, table(spark, rows), "").select("doc_id").collect()}
    assert set(range(90)) <= kept and {110, 111, 120} <= kept and not {100, 101, 102} & kept


def test_mixture_takes_whole_documents_near_their_share(spark, rows):
    docs = table(spark, [r for r in rows if r[0] is not None and r[0] < 90]).dropDuplicates(["doc_id"])
    got = pipeline.mixture(spark, docs, "")
    words = lambda df: {r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    size, taken = words(docs), words(got)
    budget = 1.5 * sum(size.values())
    # Weights 5 and 2, at most twice a source.
    first = min(2 * size["s0"], budget * 5 / 7)
    second = min(2 * size["s1"], budget - first)
    assert abs(taken["s0"] - first) < 100 and abs(taken["s1"] - second) < 100
    assert max(Counter(r["doc_id"] for r in got.select("doc_id").collect()).values()) <= 2


def test_stages_of_an_empty_table(spark, rows):
    docs = table(spark, rows[:1]).limit(0)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name
