"""Near-duplicate texts by BagMinHash: weighted-Jaccard signatures, bands, and exact multiset overlap.

A text is the bag of its runs of five words; the weight of a run is how often it occurs.  For each run, and each interval (0, 1], (1, 2], (2, 4],
(4, 8] ... of weights that its weight reaches into, a Poisson process seeded by the run and the interval puts points into interval x time, each for
one of the signature's components.  Points above the run's weight don't count.  A component's value is its first point's time over all runs, so
two texts agree in a component with the probability of their weighted Jaccard similarity.  Points are made in order of time and only up to the time
at which all components of the text are filled, so a text costs its runs plus m log m points, however many components there are.

Exact copies collapse first.  Signatures go into bands; texts of a bucket are compared with one of them, and by the triangle inequality of the
Jaccard distance only those that may still link with a text of another class are compared further: after two such rounds, with the texts
that share one of their rarest runs.  All comparisons are exact, on the bags.  A text of one to four words is one run; texts without words (also null) link with nothing, not even each other.
Repeated rows are copies; null ids are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.components import components
from pricetide.llm.tables import discard, settled
from pricetide.llm.words import U, mix, positions, runs, signed, slices, text_words

GOLD = U(0x9E3779B97F4A7C15)
#: Rounds in which the texts of a bucket are compared with one of them.
STARS = 2


def bags(text: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of k words of each text: number of the text, hash of the run, how often; ordered by text and hash."""
    words, first = text_words(text)
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(len(words))
    code = runs(words, k)
    few = np.flatnonzero((size > 0) & (size < k))
    if few.size:
        whole = size[few].astype(np.uint64)
        for j in range(k - 1):
            has = size[few] > j
            whole[has] = mix(whole[has] * GOLD + words[first[few[has]] + j])
        code[first[few]] = whole
    keep = left >= k
    keep[first[few]] = True
    owner, code = positions(first)[keep], code[keep]
    order = np.lexsort((code, owner)) if len(size) > 4096 else np.argsort((owner.astype(np.uint64) << U(52)) | (code >> U(12)), kind="stable")
    owner, code = owner[order], code[order] >> U(12)
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])]) if len(code) else np.zeros(0, np.int64)
    return owner[new], code[new], np.diff(np.r_[new, len(code)])


def signatures(owner: np.ndarray, code: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """texts x m first times; infinite for a text without runs."""
    # One process for each run and interval of weights.
    level = np.zeros(len(code), np.int64)
    parts = [np.stack([np.arange(len(code)), level])]
    low = 1
    while (over := np.flatnonzero(weight > low)).size:
        parts.append(np.stack([over, np.full(len(over), int(low).bit_length())]))
        low *= 2
    run, level = np.concatenate(parts, 1) if len(code) else (np.zeros(0, int), level)
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    below = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    seed = mix(code[run] + level.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    whose, most = owner[run], weight[run]
    out = np.full(texts * m, np.inf)
    total = np.bincount(owner, weight, texts)
    open_ = total > 0
    limit = np.where(open_, (np.log(m) + 2) / np.maximum(total, 1), 0)
    count = np.zeros(len(run), np.uint64)

    def gap(at: np.ndarray, h: np.ndarray) -> np.ndarray:
        return -np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width[at])

    drawn = mix(seed)
    time = gap(np.arange(len(run)), drawn)
    at = np.flatnonzero(time <= limit[whose])
    while open_.any():
        while at.size:
            g = mix(drawn[at] ^ U(0xA0761D6478BD642F))
            slot = below[at] + np.floor((g & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width[at])
            ok = slot < most[at]
            part = (((g >> U(32)) * U(m)) >> U(32)).astype(np.int64)
            np.minimum.at(out, (whose[at] * m + part)[ok], time[at][ok])
            count[at] += U(1)
            drawn[at] = mix(seed[at] + count[at] * GOLD)
            time[at] += gap(at, drawn[at])
            at = at[time[at] <= limit[whose[at]]]
        open_ = np.isinf(out.reshape(texts, m)).any(1) & (total > 0)
        limit = np.where(open_, limit * 1.5, 0)
        at = np.flatnonzero(time <= limit[whose])
    return out.reshape(texts, m)


def banded(values: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each band of components."""
    bits = values.view(np.uint64).reshape(len(values), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2])
    for j in range(bits.shape[2]):
        out = mix(out * GOLD + bits[:, :, j])
    return out


def _signed(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """df (doc_id, digest, text) -> doc_id, digest, weight, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 22):
            n = part.num_rows
            owner, code, weight = bags(part.column("text"), words)
            got = signed(banded(signatures(owner, code, weight, n, bands * rows), bands).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(got))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(np.bincount(owner, weight, n).astype(np.int64)), lists], names=["doc_id", "digest", "weight", "bands"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, digest binary, weight long, bands array<long>")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """df (node, text) -> node, items: the bag as a sorted set, in which a run's copies are told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            owner, code, weight = bags(part.column("text"), words)
            copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
            items = mix(np.repeat(code, weight) * GOLD + copy.astype(np.uint64))
            off = np.r_[0, np.cumsum(np.bincount(owner, weight, part.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(off), pa.array(signed(mix(items))))], names=["node", "items"])

    return df.mapInArrow(run, "node long, items array<long>")


def _overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact similarity of each pair (a, b)."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.join(a, "a").select("a", "b", "x").join(b, "b").select("a", "b", shared.alias("n"), (F.size("x") + F.size("y")).alias("all"))
    return both.select("a", "b", (F.col("n") / (F.col("all") - F.col("n"))).alias("similarity"))


def _with_class(nodes: DataFrame, label: DataFrame) -> DataFrame:
    return nodes.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _fresh(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """Distinct pairs between classes, smaller node first, without those compared before."""
    pairs = pairs.filter("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs of nodes that can reach the similarity: such bags share one of their (1 - similarity) * size + 1 rarest items, so a passage that
    many of them hold makes no pairs."""
    items = settled(nodes.join(sets, "node").select("node", "weight", "c", F.explode("items").alias("e")))
    often = settled(items.groupBy("e").agg(F.count("*").alias("n")).filter("n > 1"))
    ranked = items.join(often, "e", "left").withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "e")))
    rare = settled(ranked.filter((F.col("n") > 1) & (F.col("k") <= F.col("weight") - F.ceil(similarity * F.col("weight") - 1e-9) + 1)).select("e", "node", "weight", "c", "k"))
    left = rare.select("e", F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("c").alias("ca"), (F.col("weight") - F.col("k")).alias("ra"))
    right = rare.select("e", F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("c").alias("cb"), (F.col("weight") - F.col("k")).alias("rb"))
    # From the first item that two bags share, no more than what remains of either can be shared.
    enough = F.least("ra", "rb") + 1 >= similarity / (1 + similarity) * (F.col("wa") + F.col("wb")) - 1e-9
    return left.join(right, "e").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & enough)


def near_duplicates(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 5) -> DataFrame:
    """docs: doc_id, text.  One row per row of docs: doc_id, digest (of the text), class_id (smallest id among exact copies), component_id (smallest id among all
    texts reached by links of at least `similarity`), kept (one row of each component).  A pair at exactly the limit shares no band with
    probability (1 - similarity ** rows) ** bands, 3e-6 as given, and less above it."""
    docs = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    base = settled(_signed(docs, words, bands, rows))
    of_text = base.filter("weight > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands"))
    texts = settled(of_text.withColumn("node", F.monotonically_increasing_id()))
    buckets = texts.select("node", "weight", F.explode("bands").alias("bucket"))
    shared = settled(buckets.groupBy("bucket").count().filter("count > 1"))
    active = settled(buckets.join(shared.select("bucket"), "bucket").select("bucket", "node", "weight"))
    wanted = texts.join(active.select("node").distinct(), "node").select("node", "digest", F.col("doc_id").alias("own"))
    found = docs.join(wanted, (docs["digest"] == wanted["digest"]) & docs["doc_id"].eqNullSafe(wanted["own"])).select("node", "text")
    sets = settled(_sets(found, words).dropDuplicates(["node"]))
    none = active.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    compared, label = none.withColumn("similarity", F.lit(0.0)), active.select("node", F.col("node").alias("component")).limit(0)
    ratio = F.least("wa", "wb") / F.greatest("wa", "wb")
    for turn in range(STARS):
        here = _with_class(active, label)
        lead = here.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"), F.col("weight"), F.col("c"))).alias("lead"))
        lead = settled(lead.select("bucket", F.col("lead.node").alias("a"), F.col("lead.weight").alias("wa"), F.col("lead.c").alias("ca")))
        star = here.select("bucket", F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("c").alias("cb")).join(lead, "bucket").filter("a <> b")
        new = settled(_overlap(_fresh(star.filter(ratio >= similarity), compared), sets))
        compared = new if turn == 0 else settled(compared.unionAll(new))
        links = new.filter(F.col("similarity") >= similarity).select("a", "b")
        label = components(label.selectExpr("node AS a", "component AS b").unionAll(links))
        # What is left of each bucket: texts outside the class of the one they were compared with, and those of its class that the
        # triangle inequality doesn't keep from linking with them.
        pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        known = star.select("bucket", F.col("a").alias("lead"), F.col("b").alias("node"), "wa", "wb", *pair).join(compared, ["a", "b"], "left")
        known = known.join(label, "node", "left").withColumnRenamed("component", "kb").join(label.select(F.col("node").alias("lead"), F.col("component").alias("ka")), "lead", "left")
        least_far, most_far = F.coalesce(1 - F.col("similarity"), 1 - ratio), F.coalesce(1 - F.col("similarity"), F.lit(1.0))
        known = settled(known.select("bucket", "node", F.col("wb").alias("weight"), least_far.alias("least_far"), most_far.alias("far"), (F.coalesce("kb", "node") != F.coalesce("ka", "lead")).alias("other")))
        least = settled(known.filter("other").groupBy("bucket").agg(F.min("least_far").alias("least")))
        active = settled(known.join(least, "bucket").filter(F.col("other") | (F.col("far") >= F.col("least") - (1 - similarity) - 1e-9)).select("bucket", "node", "weight"))
    rest = _fresh(_prefix_pairs(_with_class(active.select("node", "weight").distinct(), label), sets, similarity), compared)
    links = settled(_overlap(rest, sets)).filter(F.col("similarity") >= similarity).select("a", "b")
    label = components(label.selectExpr("node AS a", "component AS b").unionAll(links))
    named = texts.select("digest", "node", F.col("doc_id").alias("class_id")).join(label, "node", "left").withColumn("c", F.coalesce("component", "node"))
    named = settled(named.select("digest", "class_id", "c"))
    discard(sets, compared, label, active, shared, texts)
    least = named.groupBy("c").agg(F.min("class_id").alias("component_id"))
    named = settled(named.join(least, "c").select("digest", "class_id", "component_id"))
    out = base.select("doc_id", "digest", "weight").join(named, "digest", "left")
    alone = F.col("class_id").isNull() & (F.col("weight") == 0)
    out = out.select("doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
