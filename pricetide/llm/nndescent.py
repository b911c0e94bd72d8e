"""Approximate nearest neighbours by NN-descent and greedy graph search.

A first graph comes from random partitions: signs of random projections cut the vectors into small blocks (blocks that are still large, such as
copies, are dealt out at random), and each vector takes its nearest in each block.  Then neighbours of neighbours are compared: the vectors
around a node, its neighbours and a bounded number of those that name it, are brought together by joins, and those that are nearer than what a
vector has become its neighbours.  Each round costs the same for every node; none sees more than a fixed number of vectors.

A search starts from a query's own neighbours and some entry points.  Each round the nearest nodes of its pool that weren't followed yet are
followed through the graph in both directions, by joins over all queries at once; the nodes that are new are measured.  The pool's best are
the result, by exact distances in double precision.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or differ from the others in length take no part; with
fewer candidates than asked for all are returned; ties go to the smaller id; repeated rows are candidates of their own, but for the query's.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.tables import discard, settled
from pricetide.llm.vectors import lists, matrix, usable


def _best(owner: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each owner, each id once; ordered by owner and nearness."""
    order = np.lexsort((d, ids, owner))
    o, i = owner[order], ids[order]
    order = order[np.r_[True, (o[1:] != o[:-1]) | (i[1:] != i[:-1])]] if len(o) else order
    order = order[np.lexsort((ids[order], d[order], owner[order]))]
    o = owner[order]
    start = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, int)
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    return order[rank < k]


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances between rows, none to themselves."""
    s = (x * x).sum(1)
    d = np.maximum(s[:, None] + s[None] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    return d


def _blocks(points: DataFrame, n: int, dimension: int, trees: int, leaf: int, keep: int) -> DataFrame:
    """points (node, v) -> a, b, d: nearest neighbours inside random blocks."""
    bits = max(0, ceil(log2(max(1, n / leaf))))
    planes = np.random.default_rng(11).normal(size=(trees, dimension, max(bits, 1)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = matrix(part.column("v"))
            codes = np.zeros((len(x), trees), np.int64)
            for t in range(trees if len(x) else 0):
                codes[:, t] = ((x @ planes[t][:, :bits]) >= 0) @ (1 << np.arange(bits)) if bits else 0
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("v"), lists(codes.ravel(), np.arange(1, len(x) + 1) * trees, pa.int64())], names=["node", "v", "codes"])

    coded = points.mapInArrow(code, "node long, v array<float>, codes array<long>")
    dealt = coded.select("node", "v", F.posexplode("codes").alias("tree", "block"))
    sizes = settled(coded.select(F.posexplode("codes").alias("tree", "block")).groupBy("tree", "block").count())
    parts = F.ceil(F.col("count") / (2 * leaf)).cast("int")
    salted = dealt.join(sizes, ["tree", "block"]).select("node", "v", "tree", "block", F.pmod(F.xxhash64("node", "tree"), parts).alias("part"))

    def near(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        ids, x = group["node"].to_numpy(), np.stack(group["v"].to_numpy()).astype(np.float32)
        d, m = _distances(x), min(keep, len(ids) - 1)
        at = np.argpartition(d, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(ids), 0), int)
        return pd.DataFrame({"a": np.repeat(ids, m), "b": ids[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel()})

    return salted.groupBy("tree", "block", "part").applyInPandas(near, "a long, b long, d float")


def _merged(edges: DataFrame, k: int) -> DataFrame:
    """a, b, d -> node, near, d: the k nearest of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = part.column("got")
            owner = np.repeat(np.arange(len(got)), np.diff(got.offsets.to_numpy()))
            ids, d = (got.flatten().field(f).to_numpy() for f in ("b", "d"))
            at = _best(owner, ids, d, k)
            ends = np.searchsorted(owner[at], np.arange(len(got)), side="right")
            yield pa.RecordBatch.from_arrays([part.column("a"), lists(ids[at], ends, pa.int64()), lists(d[at], ends, pa.float32())], names=["node", "near", "d"])

    gathered = edges.groupBy("a").agg(F.collect_list(F.struct("b", "d")).alias("got"))
    return gathered.mapInArrow(run, "node long, near array<long>, d array<float>")


def _both_ways(graph: DataFrame, back: int) -> DataFrame:
    """m, x: each node's neighbours, and up to `back` of the nodes that name it (chosen by hash)."""
    out = graph.select(F.col("node").alias("m"), F.explode("near").alias("x"))
    by = Window.partitionBy("m").orderBy(F.xxhash64("x", "m"), "x")
    into = out.select(F.col("x").alias("m"), F.col("m").alias("x")).withColumn("k", F.row_number().over(by)).filter(F.col("k") <= back).drop("k")
    return out.unionAll(into).distinct()


def _around(graph: DataFrame, points: DataFrame, back: int, keep: int) -> DataFrame:
    """Pairs a, b around a common node that are nearer than a's farthest neighbour."""
    small = points.join(graph.select("node", F.array_max("d").alias("worst")), "node").select(F.col("node").alias("x"), "worst", "v")
    members = _both_ways(graph, back).join(small, "x").groupBy("m").agg(F.collect_list(F.struct("x", "worst", "v")).alias("got"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            got = part.column("got")
            ends, flat = got.offsets.to_numpy(), got.flatten()
            ids, worst, x = flat.field("x").to_numpy(), flat.field("worst").to_numpy(), matrix(flat.field("v"), np.float32)
            ends = ends - ends[0]
            out = []
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                m = min(keep, e - s - 1)
                if m > 0:
                    d = _distances(x[s:e])
                    at = np.argpartition(d, m - 1, axis=1)[:, :m]
                    near = np.take_along_axis(d, at, 1)
                    row, column = np.nonzero(near < worst[s:e, None])
                    out.append((ids[s:e][row], ids[s:e][at[row, column]], near[row, column]))
            a, b, d = (np.concatenate(z) if out else np.zeros(0) for z in (zip(*out, strict=True) if out else ((), (), ())))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(d.astype(np.float32))], names=["a", "b", "d"])

    return members.mapInArrow(run, "a long, b long, d float")


def build(points: DataFrame, *, k: int = 20, trees: int = 8, leaf: int = 128, rounds: int = 3, back: int = 16, keep: int = 5) -> DataFrame:
    """points: node, v (stored).  Returns node, near, d: k approximate neighbours of every node."""
    n = points.count()
    dimension = points.select(F.size("v")).first()
    if n < 2:
        return points.select("node", F.array().cast("array<long>").alias("near"), F.array().cast("array<float>").alias("d"))
    graph = settled(_merged(_blocks(points, n, dimension[0], trees, leaf, min(k, 10)), k))
    for _ in range(rounds):
        now = graph.select(F.col("node").alias("a"), F.inline(F.arrays_zip(F.col("near").alias("b"), "d")))
        new = settled(_merged(now.unionAll(_around(graph, points, back, keep)), k))
        discard(graph)
        graph = new
    return graph


def search(points: DataFrame, graph: DataFrame, queries: DataFrame, *, k: int = 10, pool: int = 256, follow: int = 112, rounds: int = 10, back: int = 40, entries: int = 32) -> DataFrame:
    """queries: query (long), node (its own, left out), v.  Returns query, rank, node, score."""
    ways = settled(_both_ways(graph, back).groupBy("m").agg(F.collect_list("x").alias("ways")))
    start = [r[0] for r in points.select("node", F.xxhash64("node").alias("h")).orderBy("h", "node").limit(entries).collect()]
    own = queries.join(graph.select("node", "near"), "node", "left")
    blank = "CAST(array() AS array<long>)"
    state = own.select("query", "node", F.col("v").alias("q"), F.concat(F.coalesce("near", F.expr(blank)), F.array(*[F.lit(x).cast("long") for x in start])).alias("todo"), F.expr(f"{blank} AS seen"), F.expr(f"{blank} AS pool"), F.expr("CAST(array() AS array<double>) AS d"), F.expr(f"{blank} AS followed"))
    state = settled(state.withColumn("todo", F.array_except(F.array_distinct("todo"), F.array("node"))))
    schema = "query long, node long, q array<float>, seen array<long>, pool array<long>, d array<double>, followed array<long>, next array<long>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                cell = {c: batch.column(c)[at] for c in ("q", "todo", "seen", "pool", "d", "followed", "got")}
                q = cell["q"].values.to_numpy().astype(np.float64)
                got = cell["got"].values
                ids = got.field("u").to_numpy() if got is not None else np.zeros(0, np.int64)
                x = matrix(got.field("v")) if len(ids) else np.zeros((0, len(q)))
                d = np.sqrt(((x - q) ** 2).sum(1))
                ids, d = np.r_[cell["pool"].values.to_numpy(), ids], np.r_[cell["d"].values.to_numpy(), d]
                best = np.lexsort((ids, d))[:pool]
                ids, d = ids[best], d[best]
                done = cell["followed"].values.to_numpy()
                ahead = ids[~np.isin(ids, done)][:follow]
                rows.append((np.union1d(cell["seen"].values.to_numpy(), cell["todo"].values.to_numpy()), ids, d, np.r_[done, ahead], ahead))
            columns = [lists(np.concatenate([r[k] for r in rows]) if rows else np.zeros(0), np.cumsum([len(r[k]) for r in rows]).astype(int), pa.float64() if k == 2 else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), batch.column("q"), *columns], names=["query", "node", "q", "seen", "pool", "d", "followed", "next"])

    for turn in range(rounds):
        wanted = state.select("query", F.explode("todo").alias("u")).join(points.select(F.col("node").alias("u"), "v"), "u")
        got = wanted.groupBy("query").agg(F.collect_list(F.struct("u", "v")).alias("got"))
        new = settled(state.join(got, "query", "left").mapInArrow(measure, schema))
        discard(state)
        state = new
        if turn + 1 < rounds:
            reach = state.select("query", F.explode("next").alias("m")).join(ways, "m").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("ways"))).alias("reach"))
            fresh = F.array_except(F.coalesce("reach", F.expr(blank)), F.concat("seen", F.array("node")))
            new = settled(state.join(reach, "query", "left").withColumn("todo", fresh).drop("next", "reach"))
            discard(state)
            state = new
    discard(ways)
    found = state.select("query", F.posexplode(F.slice(F.arrays_zip(F.col("pool").alias("node"), F.col("d").alias("score")), 1, k)).alias("rank", "hit"))
    return found.select("query", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.node").alias("node"), F.col("hit.score").alias("score"))


def nearest(vectors: DataFrame, asks: Column, *, vector: str = "embedding", name: str = "vec_id", k: int = 10) -> DataFrame:
    """The k nearest of every row for which `asks` holds, among all other rows: query_id, rank, name, score."""
    good = usable(vectors.select(F.col(name).cast("long").alias("name"), F.col(vector).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")), "v")
    # Nodes are numbered in the order of names, so that ties between nodes are ties between names.
    points = settled(good.select("name", "asks", F.transform("v", lambda x: x.cast("float")).alias("v")).withColumn("node", F.struct(F.col("name"), F.monotonically_increasing_id().alias("row"))))
    unique = points.select("name").distinct().count() == points.count()
    table = settled(points.withColumn("node", F.col("name") if unique else F.col("node.row")))
    graph = build(table.select("node", "v"))
    found = search(table.select("node", "v"), graph, table.filter("asks").select(F.col("node").alias("query"), "node", "v"), k=k)
    names = table.select("node", "name")
    out = found.join(names, "node").withColumnRenamed("name", name).join(names.select(F.col("node").alias("query"), F.col("name").alias("query_id")), "query")
    return out.select("query_id", "rank", name, "score")
