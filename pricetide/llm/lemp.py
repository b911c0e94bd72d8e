"""Hard negatives by inner product, with candidates pruned by length and by coordinates.

Vectors become integers, floor(scale * component).  Rows are dealt to blocks: a bucket of like lengths (powers of `ratio`), cut into parts of a bounded
size.  In a block every dimension of the unit vectors has a sorted list.  For an anchor and a least score, no row of a block whose longest vector is too
short can reach it; for the others the score bounds the angle, and the angle bounds each coordinate: an anchor's focus coordinates, its largest, give
ranges in the sorted lists.  Rows in all ranges are candidates, and their scores are computed exactly.  The least score starts high and is lowered until the
block has given as many rows as are wanted, or all that satisfy the window; so what a block returns is exact, and so is the best of all blocks.

Two rounds: the anchors' best rows of the same label, then the rows of other labels in the windows that these set.  Anchors travel to the blocks, in
batches past one block at a time, so a task holds a block and a batch; a block returns a bounded number of rows an anchor.  Which anchors go to which
bucket in the second round is cut by length beforehand.

Defined results: rows with a null label or a vector that is null, empty or holds null or non-finite components take no part, nor do those whose length isn't
the most frequent one (the shorter of equals).  Null ids are never anchors; they come last among equal scores.  Repeated rows are rows of their own: a
copy of an anchor may be its positive.  A zero vector scores 0 with all.  A negative positive score leaves an empty window.  Components so large that a
vector's product with itself passes a long raise an error.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.tables import discard, settled
from pricetide.llm.vectors import matrix

FOCUS = 5
#: Numbers a block holds, so its rows times dimensions; tables up to PARTS such blocks are dealt to PARTS all the same.
NUMBERS, PARTS = 1 << 22, 32
_FOUND = "anchor long, row long, name long, score long"


class Lists:
    """Rows of a block, in the order of their names, with sorted coordinate lists that are made when a coordinate is first in focus."""

    def __init__(self, x: np.ndarray, names: np.ndarray, rows: np.ndarray):
        self.x, self.names, self.rows = x, names, rows
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        self.longest = float(length.max(initial=0))
        self.unit = x / np.where(length > 0, length, 1)[:, None]
        # Whole numbers below 2^53 are exact as doubles; |score| is at most the product of lengths.
        self.kind = np.float64 if self.longest < 2.0**26 else np.int64
        self.values = np.ascontiguousarray(x, self.kind)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f]).astype(np.int32)
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, size: float, least: float) -> np.ndarray | None:
        """Every row that may score `least` or more, and others; None: all rows."""
        if least <= 0 or size == 0:
            return None
        cos = least / (size * self.longest) * (1 - 1e-9) if self.longest else 2.0
        if cos > 1:
            return np.zeros(0, np.int32)
        focus = np.argsort(-np.abs(q))[:FOCUS]
        u = np.clip(q[focus] / size, -1, 1)
        mine, turn = np.arccos(u), np.arccos(cos)
        low, high = np.cos(np.minimum(np.pi, mine + turn)) - 1e-9, np.cos(np.maximum(0, mine - turn)) + 1e-9
        best = None
        for f, a, b in zip(focus, low, high, strict=True):
            order, value = self.sorted(int(f))
            i, j = np.searchsorted(value, a), np.searchsorted(value, b, side="right")
            if best is None or j - i < best[2] - best[1]:
                best = order, i, j
        got = best[0][best[1] : best[2]]
        if len(got) > len(self.rows) // 2:
            return None
        for f, a, b in zip(focus, low, high, strict=True):
            value = self.unit[got, f]
            got = got[(value >= a) & (value <= b)]
        return np.sort(got)

    def scored(self, q: np.ndarray, size: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Candidates for a least score (as places) and their exact scores."""
        q = q.astype(self.kind if size * self.longest < 2.0**53 else np.int64)
        got = self.candidates(q, size, least)
        if got is None:
            return np.arange(len(self.rows)), (self.values @ q).astype(np.int64)
        return got, (self.values[got] @ q).astype(np.int64)


def first(places: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Which of ascending places are the n of highest score, ties to the smaller place."""
    if len(scores) > n:
        bound = np.partition(scores, len(scores) - n)[len(scores) - n]
        over, equal = np.flatnonzero(scores > bound), np.flatnonzero(scores == bound)
        keep = np.r_[over, equal[: n - len(over)]]
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((places[keep], -scores[keep]))]


class Block:
    def __init__(self, part: pa.Table):
        names = part.column("name").combine_chunks()
        self.names = np.where(names.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, names.fill_null(0).to_numpy())
        rows, labels = part.column("row").to_numpy(), part.column("label").to_numpy()
        order = np.lexsort((rows, self.names))
        x = matrix(part.column("x").combine_chunks(), np.int64)[order]
        self.names, self.labels = self.names[order], labels[order]
        self.all = Lists(x, self.names, rows[order])
        self.of_label: dict[int, Lists] = {}

    def same(self, label: int) -> Lists:
        if label not in self.of_label:
            at = np.flatnonzero(self.labels == label)
            self.of_label[label] = Lists(self.all.x[at], self.names[at], self.all.rows[at])
        return self.of_label[label]


def positives(block: Block, row: int, label: int, q: np.ndarray, size: float, n: int) -> tuple[np.ndarray, np.ndarray, Lists]:
    """Places and scores of the block's n best rows of the anchor's label."""
    rows = block.same(label)
    top = size * rows.longest
    for least in (0.8 * top, 0.5 * top, 0.25 * top, -np.inf):
        got, scores = rows.scored(q, size, least)
        keep = (scores >= least) & (rows.rows[got] != row)
        if keep.sum() >= n or least == -np.inf:
            got, scores = got[keep], scores[keep]
            best = first(got, scores, n)
            return got[best], scores[best], rows
    raise AssertionError


def negatives(block: Block, row: int, label: int, q: np.ndarray, size: float, n: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, Lists]:
    """Places and scores of the rows of other labels that are among the block's n best in a window low to high."""
    rows = block.all
    least_high, lowest = int(high.min()), int(low.min())
    for share in (0.1, 0.35, 1.0):
        least = least_high - share * (least_high - lowest) if share < 1 else float(lowest)
        got, scores = rows.scored(q, size, least)
        keep = (scores >= least) & (block.labels[got] != label)
        got, scores = got[keep], scores[keep]
        inside = [np.flatnonzero((scores >= a) & (scores <= b)) for a, b in zip(low, high, strict=True)]
        # A window that starts above the least score has been searched to its end.
        if share == 1 or all(len(i) >= n or a >= least for i, a in zip(inside, low, strict=True)):
            break
    chosen = np.unique(np.concatenate([i[first(got[i], scores[i], n)] for i in inside]))
    return got[chosen], scores[chosen], rows


def _searched(find: Callable, n: int) -> Callable:
    """Runs over (block, kind)-sorted batches: a block's rows (kind 0), then the anchors that visit it (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            ids, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
                if a == b:
                    continue
                if ids[a] != at:
                    at, held, block = ids[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if block is None and not held:
                    continue  # The hash dealt no row to this part.
                if block is None:
                    block, held = Block(pa.Table.from_batches(held)), []
                yield _answers(find, block, part, n)

    return run


def _answers(find: Callable, block: Block, part: pa.RecordBatch, n: int) -> pa.RecordBatch:
    out: list[tuple[np.ndarray, ...]] = []
    x = matrix(part.column(part.schema.get_field_index("x")), np.int64)
    sizes = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    windows = part.column(part.schema.get_field_index("low")).to_pylist(), part.column(part.schema.get_field_index("high")).to_pylist()
    rows, labels = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("row", "label"))
    for k, (row, label) in enumerate(zip(rows, labels, strict=True)):
        bounds = [np.array(w[k]) for w in windows if w[k] is not None]
        got, scores, lists = find(block, row, label, x[k], float(sizes[k]), n, *bounds)
        out.append((np.full(len(got), row), lists.rows[got], lists.names[got], scores))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
    none = columns[2] == np.iinfo(np.int64).max
    return pa.RecordBatch.from_arrays([pa.array(c, mask=none if k == 2 else None) for k, c in enumerate(columns)], names=["anchor", "row", "name", "score"])


def _search(rows: DataFrame, visits: DataFrame, find: Callable, n: int) -> DataFrame:
    both = rows.select("block", F.lit(0).alias("kind"), "row", "name", "label", "x", F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"))
    both = both.unionAll(visits.select("block", F.lit(1), "row", "name", "label", "x", "low", "high"))
    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_searched(find, n), _FOUND)


def mine(
    df: DataFrame, anchors: Column, name: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, ratio: float = 1.25,
) -> DataFrame:
    """For each row where `anchors` holds and each of its n_positives best rows of the same label: the n_negatives best rows of other labels whose score
    is low to high per cent of the positive's.  anchor_id, positive_id, rank int, negative_id, positive_score, negative_score (long)."""
    entry = F.col(vector)
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    given = F.col(label) if isinstance(label, str) else label
    good = df.filter(entry.isNotNull() & (F.size(entry) > 0) & ~bad & given.isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(name).cast("long").alias("name"), given.cast("long").alias("label"),
        F.transform(entry, lambda c: F.floor(c.cast("double") * scale)).alias("x"), F.coalesce(anchors, F.lit(False)).alias("asks"),
    )
    square = F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c * c)
    length = F.sqrt(square.cast("double"))
    bucket = F.when(length > 0, F.floor(F.log(length) / float(np.log(ratio)))).otherwise(-1).cast("long")
    good = settled(good.withColumn("length", length).withColumn("bucket", bucket))
    size = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = size["d"] if size else 1
    good = good.filter(F.size("x") == d)

    # Buckets: at most one a power of `ratio` that a long's root allows, so about a hundred.
    found = good.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("bucket").collect()
    total = sum(r["n"] for r in found)
    most = max(1, min(NUMBERS // d, -(-total // PARTS)))
    parts = {r["bucket"]: -(-r["n"] // most) for r in found}
    if not found:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    of_bucket = F.create_map(*(F.lit(v).cast("long") for kv in parts.items() for v in kv))
    block = lambda bucket, part: (bucket + 1) * (1 << 40) + part
    rows = good.withColumn("block", block(F.col("bucket"), F.pmod(F.xxhash64("row"), of_bucket[F.col("bucket")])))

    def visiting(asking: DataFrame, reach: Column) -> DataFrame:
        to = F.filter(F.array(*(F.struct(F.lit(r["bucket"]).cast("long").alias("b"), F.lit(parts[r["bucket"]]).cast("long").alias("parts"), F.lit(float(r["longest"])).alias("longest")) for r in found)), lambda s: s["longest"] * F.col("length") * (1 + 1e-9) >= reach)
        sent = asking.withColumn("to", F.explode(to)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to.parts") - 1)))
        return sent.withColumn("block", block(F.col("to.b"), F.col("part")))

    null = F.lit(None).cast("array<long>")
    asking = good.filter("asks").withColumn("low", null).withColumn("high", null)
    near = _search(rows, visiting(asking, F.lit(float("-inf"))), positives, n_positives)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("name").asc_nulls_last(), "row")
    near = settled(near.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= n_positives))

    # Windows of whole scores; those of negative positives are empty.
    window = near.filter("score >= 0").withColumn("lo", F.expr(f"({low} * score + 99) div 100")).withColumn("hi", F.expr(f"{high} * score div 100")).filter("lo <= hi")
    window = window.groupBy("anchor").agg(F.collect_set(F.struct("lo", "hi")).alias("w"))  # at most n_positives of them
    asking = good.filter("asks").join(window, F.col("row") == F.col("anchor")).drop("anchor").withColumn("low", F.col("w.lo")).withColumn("high", F.col("w.hi"))
    far = _search(rows, visiting(asking, F.array_min("low").cast("double")), negatives, n_negatives)
    pairs = near.select("anchor", F.col("row").alias("positive"), F.col("name").alias("positive_id"), F.col("score").alias("positive_score"))
    far = far.select("anchor", "row", F.col("name").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, "anchor")
    far = far.filter((low * F.col("positive_score") <= 100 * F.col("negative_score")) & (100 * F.col("negative_score") <= high * F.col("positive_score")))
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "row")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    names = good.filter("asks").select(F.col("row").alias("anchor"), F.col("name").alias("anchor_id"))
    out = settled(far.join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    discard(near)
    return out
