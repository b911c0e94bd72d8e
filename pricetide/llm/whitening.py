"""Whitening of vectors from exact integer cross-products, counted on bit slices.

Each entry c becomes the integer x = floor(scale * c) + shift.  The fit list holds every distinct x vector once.  Its cross-products are counted on
bit planes: entries less the dimension's smallest are cut into planes of one bit, the bits of 64 rows are packed into a word, and the cross-product of
two dimensions is the sum over pairs of planes of popcount(words AND words), weighted by the planes' powers of two.  Tasks count their own rows;
Spark adds the d * (d + 1) / 2 sums.  The driver sees these sums only, centres them as integers, n * sum(x y) - sum(x) sum(y), and takes eigenvectors.

Defined results: rows whose vector is null, empty or holds null or non-finite entries, or entries whose scale * c is 2^53 or more, where a double
no longer tells neighbouring integers apart, are left out, and so are those whose length isn't the most frequent one (the shorter of equals).  Repeated
rows each get a result; they count once in the fit list.  Directions without variance, to a double's precision, are no components: the table may have
fewer than asked for, or none (a single vector).  An empty table gives an empty one.  A component's sign makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.llm.tables import discard, settled
from pricetide.llm.vectors import matrix

_SUMS = "i int, j int, s decimal(38,0)"
_CONTEXT = Context(prec=60)


@dataclass
class Whitening:
    """What the fit list gave: n vectors with sums `total`, `axes` (d x k) already over the roots of the eigenvalues."""

    n: int
    low: np.ndarray
    total: list[int]
    axes: np.ndarray
    explained: list[float]


def integers(df: DataFrame, name: str, vector: str, scale: int, shift: int) -> DataFrame:
    """Columns name and x: the usable rows' vectors as integers."""
    entry = F.col(vector)
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * scale) >= float(1 << 53)))
    good = df.filter(entry.isNotNull() & (F.size(entry) > 0) & ~bad).select(
        F.col(name).alias("name"), F.transform(entry, lambda c: F.floor(c.cast("double") * scale) + shift).alias("x")
    )
    good = settled(good)
    size = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = good.filter(F.size("x") == (size["d"] if size else 0))
    out._settled_at = good._settled_at
    return out


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return matrix(batch.column(batch.schema.get_field_index("x")), np.int64)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = high = None
    for x in map(_rows, batches):
        if len(x):
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], names=["i", "low", "high"])


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of non-negative entries, packed down the rows: (bits, dimensions, words of 64 rows)."""
    rows = -(-len(y) // 64) * 64
    out = np.zeros((bits, y.shape[1], rows // 8), np.uint8)
    for b in range(bits):
        out[b, :, : -(-len(y) // 8)] = np.packbits(((y >> b) & 1).astype(np.uint8), axis=0).T
    return out.view(np.uint64)


def crossed(words: np.ndarray, into: np.ndarray) -> None:
    """Add to into[s, i, j] the AND-popcounts of plane a of dimension i with plane b of dimension j >= i, a + b = s."""
    bits, d, _ = words.shape
    for a in range(bits):
        for i in range(d):
            into[a : a + bits, i, i:] += np.bitwise_count(words[:, i:] & words[a, i]).sum(-1, dtype=np.int64)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def scatter(low: np.ndarray, bits: int):
    """A task's sums (i, j, s): cross-products of the shifted entries; j = -1: their sums; i = j = -1: the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n = len(low), 0
        counts, total = np.zeros((2 * bits - 1, d, d), np.int64), [0] * d
        for x in map(_rows, batches):
            if len(x):
                y = x - low
                n += len(y)
                weights = np.bitwise_count(words := planes(y, bits)).sum(-1, dtype=np.int64)
                total = [t + sum(int(w) << b for b, w in enumerate(weights[:, k])) for k, t in enumerate(total)]
                crossed(words, counts)
        if n:
            i, j = np.triu_indices(d)
            product = sum((counts[s].astype(object) << s for s in range(1, 2 * bits - 1)), counts[0].astype(object))[i, j]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[i, np.arange(d), -1], pa.int32()), pa.array(np.r_[j, np.full(d + 1, -1)], pa.int32()), _decimals([*product, *total, n])], names=["i", "j", "s"]
            )

    return run


def _eigen(n: int, sums: dict[tuple[int, int], int], d: int, components: int) -> tuple[np.ndarray, list[float]]:
    centred = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            # Whole numbers up to here: the one rounding is this division.
            centred[i, j] = centred[j, i] = (n * sums[i, j] - sums[i, -1] * sums[j, -1]) / (n * n)
    value, axis = np.linalg.eigh(centred)
    value, axis = value[::-1], axis[:, ::-1]
    keep = int(np.sum(value[:components] > max(value[0], 0) * d * 2.0**-50)) if value[0] > 0 else 0
    axis = axis[:, :keep] * np.sign(axis[np.abs(axis).argmax(0), np.arange(d)])[:keep]
    trace = sum(n * sums[i, i] - sums[i, -1] ** 2 for i in range(d)) / (n * n)
    return axis / np.sqrt(value[:keep]), [float(v / trace) for v in value[:keep]]


def fit(x: DataFrame, components: int) -> Whitening | None:
    """Components of the rows of x (each counted: pass distinct ones); None without rows."""
    ranges = x.mapInArrow(_ranges, "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    if not ranges:
        return None
    low = np.array([r["low"] for r in ranges], np.int64)
    bits = max(1, *(int(r["high"] - r["low"]).bit_length() for r in ranges))
    found = x.mapInArrow(scatter(low, bits), _SUMS).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    sums = {(r["i"], r["j"]): int(r["s"]) for r in found}
    n, d = sums[-1, -1], len(low)
    axes, explained = _eigen(n, sums, d, components)
    return Whitening(n, low, [sums[k, -1] for k in range(d)], axes, explained)


def centred(model: Whitening, x: np.ndarray) -> np.ndarray:
    """n * x - S exactly; as Python's integers where a long could be too short."""
    y = x - model.low
    if model.n * (int(y.max(initial=0)) + 1) + max(map(abs, model.total)) < 1 << 62:
        return model.n * y - np.array(model.total, np.int64)
    return model.n * y.astype(object) - np.array(model.total, object)


def _whitened(model: Whitening, d: np.ndarray) -> np.ndarray:
    return (d / model.n).astype(np.float64) @ model.axes


def _spread(model: Whitening):
    """A task's sums of whitened entries and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.axes.shape[1]
        product, total = np.zeros((k, k)), np.zeros(k)
        for x in map(_rows, batches):
            z = _whitened(model, centred(model, x)) if len(x) else np.zeros((0, k))
            product += z.T @ z
            total += z.sum(0)
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i.ravel(), np.arange(k)], pa.int32()), pa.array(np.r_[j.ravel(), np.full(k, -1)], pa.int32()), pa.array(np.r_[product.ravel(), total])], names=["i", "j", "s"]
        )

    return run


def identity_error(model: Whitening, x: DataFrame) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured over the rows."""
    k = model.axes.shape[1]
    if not k:
        return 0.0
    cov, mean = np.zeros((k, k)), np.zeros(k)
    for r in x.mapInArrow(_spread(model), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        if r["j"] < 0:
            mean[r["i"]] = r["s"] / model.n
        else:
            cov[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, name: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Per usable row: its name, n, deviation decimal(38,0) (sum over dimensions of (n x - S)^2), whitened and explained (arrays by component) and
    identity_error.  Other columns aren't returned, so their names may be any."""
    rows = integers(df, name, vector, scale, shift)
    distinct = settled(rows.select("x").distinct())
    model = fit(distinct, components)
    schema = f"name {df.schema[name].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("name", name)
    error = identity_error(model, distinct)
    discard(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, d = batch.num_rows, centred(model, _rows(batch))
            z = _whitened(model, d)
            small = d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63
            squares = ((d if small else d.astype(object)) ** 2).sum(1)
            ends = pa.array(np.arange(m + 1) * z.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("name")), pa.array(np.full(m, model.n), pa.int64()), _decimals(squares),
                    pa.ListArray.from_arrays(ends, pa.array(z.ravel())), pa.ListArray.from_arrays(ends, pa.array(np.tile(model.explained, m))),
                    pa.array(np.full(m, error)),
                ],
                names=["name", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("name", name)
