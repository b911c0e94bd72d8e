"""Near-duplicate vectors by iterative quantisation and multi-index hashing.

Rotations are learned (on a bounded sample) so that the signs of the rotated vectors are balanced bits that lose little: each round takes the signs
and then the rotation that brings the vectors nearest to them.  Codes are cut into substrings of about log2(rows) bits; vectors meet if a
substring of theirs differs in at most one bit, which needs one key for each bit left out.  The longer the substrings, the more of them there are:
pairs at the linking cosine are planted around the sample, and rotations are added until no more than the share `miss` of them goes unmet.  What
meets is compared by Hamming distance, then by the cosine of the original vectors, in double precision.

Groups of near copies don't make pairs: vectors within half the linking angle of a leader form a ball, in which by the triangle inequality all are
linked, and balls meet as one.  Two balls are linked throughout, or not at all, if the leaders' angle and the radii say so; only what is left
open is compared member by member.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or differ from the others in length link with nothing;
repeated rows are vectors of their own, linked to each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.components import components
from pricetide.llm.tables import discard, settled
from pricetide.llm.vectors import dot, lists, matrix, usable
from pricetide.llm.words import mix

BITS = 64


def rotation(sample: np.ndarray, bits: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are the code."""
    mean = sample.mean(0)
    centred = sample - mean
    _, _, basis = np.linalg.svd(centred, full_matrices=False)
    basis = basis[: min(bits, len(basis))].T
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0][: basis.shape[1]]
    low = centred @ basis
    for _ in range(rounds):
        signs = np.where(low @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ low, full_matrices=False)
        turn = (u @ v).T
    return mean, basis @ turn


def _coded(df: DataFrame, models: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """df (node, unit) -> with codes: a long of 64 bits for each rotation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        for part in batches:
            x = matrix(part.column("unit"))
            codes = np.zeros((len(x), len(models)), np.uint64)
            for k, (mean, turn) in enumerate(models if len(x) else []):
                codes[:, k] = (_signs(x, (mean, turn)) * place[: turn.shape[1]]).sum(1, dtype=np.uint64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(models), pa.int32()), pa.array(codes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, flat], names=[*part.schema.names, "codes"])

    return df.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, codes array<long>")


def _signs(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - model[0]) @ model[1] >= 0


def planted(sample: np.ndarray, cosine: float, pairs: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the cosine: one is of the sample, the other lies off it, half of them towards a vector of the sample and half anywhere."""
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(0, len(sample), pairs)]
    off = rng.normal(size=x.shape)
    off[::2] = sample[rng.integers(0, len(sample), len(off[::2]))] * rng.choice([-1, 1], (len(off[::2]), 1))
    off -= (off * x).sum(1, keepdims=True) * x
    off += rng.normal(size=x.shape) * 1e-6  # for a vector drawn with itself
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
    return x, cosine * x + (1 - cosine * cosine) ** 0.5 * off


def unmet(differ: np.ndarray, bits: int) -> np.ndarray:
    """Share of the pairs (rows: which bits differ) that meet in none of the first 1, 2, 3 ... substrings."""
    tables = differ.shape[1] // bits
    met = differ[:, : tables * bits].reshape(len(differ), tables, bits).sum(2) <= 1
    return 1 - np.logical_or.accumulate(met, axis=1).mean(0)


def learned(sample: np.ndarray, bits: int, cosine: float, least: int, rounds: int, miss: float, most: int = 32, pairs: int = 8000) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int, int]:
    """Rotations (at least `least`), bits of a substring, how many substrings leave at most the share `miss` of planted pairs unmet, and in how many bits of
    the first `least` codes the pairs differ, but for a tenth of `miss`.  If `most` rotations don't do, substrings get shorter, which costs pairs, not links."""
    x, y = planted(sample, cosine, pairs)
    models, differ = [], np.zeros((len(x), 0), bool)
    while True:
        if len(models) >= least and len(enough := np.flatnonzero(unmet(differ, bits) <= miss)):
            return models, bits, int(enough[0]) + 1, int(np.quantile(differ[:, : least * BITS].sum(1), 1 - miss / 10))
        if len(models) < most:
            models.append(rotation(sample, BITS, rounds, len(models)))
            differ = np.concatenate([differ, _signs(x, models[-1]) != _signs(y, models[-1])], 1)
        else:
            bits -= 1


def _keyed(df: DataFrame, bits: int, tables: int, rotations: int) -> DataFrame:
    """A row for each table and bit left out: df's columns, with the codes of the first rotations, and key."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = np.uint64((1 << bits) - 1)
        left = ones & ~(np.uint64(1) << np.arange(bits, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n = part.num_rows
                codes = part.column("codes").flatten().to_numpy().view(np.uint64).reshape(n, -1)
                keys = np.empty((n, tables, bits), np.uint64)
                for t in range(tables):
                    word, shift = divmod(t * bits, BITS)
                    code = codes[:, word] >> np.uint64(shift)
                    if shift + bits > BITS:  # the substring goes on in the next code
                        code = code | codes[:, word + 1] << np.uint64(BITS - shift)
                    keys[:, t] = mix(code[:, None] & left ^ mix(np.arange(t * bits + 1, (t + 1) * bits + 1, dtype=np.uint64)))
                short = lists(codes[:, :rotations].ravel().view(np.int64), np.arange(1, n + 1) * rotations, pa.int64())
                columns = [short if c == "codes" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, lists(keys.ravel().view(np.int64), np.arange(1, n + 1) * tables * bits, pa.int64())], names=[*names, "keys"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, keys array<long>"
    return df.mapInArrow(run, schema).select(*names, F.explode("keys").alias("key"))


def _apart(x: str, y: str, rotations: int):
    return sum((F.bit_count(F.col(x)[r].bitwiseXOR(F.col(y)[r])) for r in range(rotations)), F.lit(0))


def links(vectors: DataFrame, *, vector: str = "embedding", name: str = "vec_id", cosine: float = 0.9, rotations: int = 2, sample: int = 20_000, rounds: int = 40, hamming: float = 0.32, miss: float = 0.01, bits: int | None = None) -> DataFrame:
    """One row per vector: name, n_links, component_id (smallest name reachable by links), kept.

    sample bounds the vectors that rotations are learned from; pairs whose first `rotations` codes differ in more than the share `hamming` of bits, and in
    more than planted links do, are not compared (links at the limit differ in 0.14 of them, unrelated vectors in 0.5).  At most the share `miss` of
    planted pairs at the cosine shares no key, whatever the number of rows; above it fewer.  bits: of a substring, log2(rows) if not given."""
    angle = acos(cosine)
    rows = settled(vectors.select(F.col(name).alias("name"), F.col(vector).alias("v")).withColumn("node", F.monotonically_increasing_id()))
    good = usable(rows, "v")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = good.select("node", F.transform("v", lambda x: x.cast("double")).alias("v"), length.alias("l")).select("node", F.expr("transform(v, x -> x / l)").alias("unit"))
    unit = settled(unit)
    n = unit.count()
    none = rows.select("name", F.lit(0).cast("long").alias("n"), F.col("name").alias("component_id"))
    if n < 2:
        return none.select(F.col("name").alias(name), F.col("n").alias("n_links"), "component_id", F.lit(True).alias("kept"))
    # About `sample` vectors, by hash; fewer rows are all used.
    picked = unit.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)) + 1).select("unit").toArrow()
    picked = matrix(picked.column(0).combine_chunks()) if picked.num_rows > 1 else matrix(unit.limit(2).select("unit").toArrow().column(0).combine_chunks())
    models, bits, tables, far = learned(picked, bits or min(BITS, max(8, ceil(log2(n)))), cosine, rotations, rounds, miss)
    coded = settled(_coded(unit, models))
    limit = max(int(hamming * BITS * rotations), far)
    turned = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot("x", "y"))))
    half = angle / 2 - 1e-6

    # Balls: first by equal codes, then around the smallest vectors that share a key.
    lead = coded.groupBy(F.col("codes")[0].alias("c")).agg(F.min(F.struct(F.col("node"), F.col("unit"))).alias("lead"))
    lead = settled(lead.select("c", F.col("lead.node").alias("leader"), F.col("lead.unit").alias("y")))
    near = coded.join(lead, F.col("codes")[0] == F.col("c")).select("node", "codes", F.col("unit").alias("x"), "leader", "y").withColumn("r", turned)
    ball = settled(near.select("node", "codes", F.col("x").alias("unit"), F.when(F.col("r") <= half, F.col("leader")).otherwise(F.col("node")).alias("leader")))
    heads = settled(ball.filter("node = leader").select("node", "codes", "unit"))
    keyed = settled(_keyed(heads.select("node", "codes"), bits, tables, rotations))
    least = settled(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("node"), F.col("codes"))).alias("m")).filter("n > 1").select("key", F.col("m.node").alias("to"), F.col("m.codes").alias("toc")))
    tries = keyed.join(least, "key").filter((F.col("to") < F.col("node")) & (_apart("codes", "toc", rotations) <= limit)).select("node", "to").distinct()
    tries = settled(tries)
    ends = tries.join(heads.select("node", F.col("unit").alias("x")), "node").join(heads.select(F.col("node").alias("to"), F.col("unit").alias("y")), "to").filter(turned <= half).groupBy("node").agg(F.min("to").alias("to"))
    ends = settled(ends)
    joined = settled(ends.join(ends.select(F.col("node").alias("to")), "to", "left_anti").withColumnsRenamed({"node": "leader", "to": "head"}))
    moved = ball.join(joined, "leader", "left").join(heads.select(F.col("node").alias("head"), F.col("unit").alias("y")), "head", "left").withColumnRenamed("unit", "x")
    moved = moved.withColumn("in", F.col("head").isNotNull() & (turned <= half))
    # A vector whose leader has moved and that the new one doesn't reach stays alone.
    ball = settled(moved.select("node", "codes", F.col("x").alias("unit"), F.when(F.col("in"), F.col("head")).when(F.col("head").isNull(), F.col("leader")).otherwise(F.col("node")).alias("leader")))
    heads = ball.filter("node = leader").select(F.col("node").alias("leader"), F.col("unit").alias("y"))
    sized = ball.join(heads, "leader").withColumnRenamed("unit", "x").groupBy("leader").agg(F.count("*").alias("size"), F.max(turned).alias("radius"))
    balls = settled(sized.join(heads, "leader"))

    # Balls that meet in a key.
    met = _keyed(ball.select("leader", "codes"), bits, tables, rotations).groupBy("key", "leader").agg(F.min("codes").alias("codes"))
    met = settled(met)
    a, b = met.select("key", F.col("leader").alias("a"), F.col("codes").alias("ca")), met.select("key", F.col("leader").alias("b"), F.col("codes").alias("cb"))
    pairs = settled(a.join(b, "key").filter((F.col("a") < F.col("b")) & (_apart("ca", "cb", rotations) <= limit)).select("a", "b").distinct())
    of_a = balls.select(F.col("leader").alias("a"), F.col("y").alias("x"), F.col("radius").alias("ra"), F.col("size").alias("na"))
    of_b = balls.select(F.col("leader").alias("b"), "y", F.col("radius").alias("rb"), F.col("size").alias("nb"))
    known = settled(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "na", "nb", turned.alias("d"), dot("x", "y").alias("cos"), (F.col("ra") + F.col("rb")).alias("r")))
    alone = (F.col("na") == 1) & (F.col("nb") == 1)
    whole = (alone & (F.col("cos") >= cosine)) | (~alone & (F.col("d") + F.col("r") <= angle - 1e-6))
    open_ = ~alone & (F.col("d") + F.col("r") > angle - 1e-6) & (F.col("d") - F.col("r") <= angle + 1e-6)
    inside = ball.select("leader", "node", "unit")
    one = known.filter(open_).select("a", "b").join(inside.select(F.col("leader").alias("a"), F.col("node").alias("p"), F.col("unit").alias("x")), "a")
    both = one.join(inside.select(F.col("leader").alias("b"), F.col("node").alias("q"), F.col("unit").alias("y")), "b").filter(dot("x", "y") >= cosine)
    both = settled(both.select("p", "q"))
    full = settled(known.filter(whole).select("a", "b", "na", "nb"))
    more = full.selectExpr("a AS leader", "nb AS n").unionAll(full.selectExpr("b AS leader", "na AS n")).groupBy("leader").agg(F.sum("n").alias("more"))
    single = both.selectExpr("p AS node").unionAll(both.selectExpr("q AS node")).groupBy("node").agg(F.count("*").alias("single"))
    count = ball.select("node", "leader").join(balls.select("leader", "size"), "leader").join(more, "leader", "left").join(single, "node", "left")
    count = settled(count.select("node", (F.col("size") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("single", F.lit(0))).alias("n")))
    edges = ball.selectExpr("leader AS a", "node AS b").unionAll(full.select("a", "b")).unionAll(both.selectExpr("p AS a", "q AS b"))
    label = components(edges)
    named = settled(rows.select("name", "node").join(count, "node", "left").join(label, "node", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "node").alias("c")))
    smallest = named.groupBy("c").agg(F.min("name").alias("component_id"))
    out = named.join(smallest, "c")
    discard(coded, lead, keyed, least, tries, ends, joined, met, pairs, known, both, full, unit, label)
    return out.select(F.col("name").alias(name), F.col("n").cast("long").alias("n_links"), "component_id", F.col("name").eqNullSafe(F.col("component_id")).alias("kept"))
