"""Passages that repeat across texts, found with sparse suffix arrays.

Of every `length` words in a row, the run of `gram` words with the smallest hash is a minimiser; equal passages have equal minimisers, so only the
suffixes that start at minimisers are kept.  Those whose run occurs once are dropped; the others are sorted by what follows, and neighbours
are compared: no two suffixes share more than neighbours do, so this bounds how far any match extends to the right.  Matches are then extended to
the left: for every window of `length` words that the bound allows, the words left and right of the minimiser together must be the same
elsewhere.  Each window belongs to one minimiser, so it's looked at once.  The words of a text in windows that occur in an earlier text, or
earlier in the same one, form its spans; the first occurrence stays.

Earlier is by the smallest id among exact copies (null last).  Exact copies collapse first: each copy but those with the smallest id is one span if it
has `length` words.  Texts with fewer words, null and empty texts have no spans; repeated rows (same id and text) get the same spans.
Words are compared by 32-bit hashes in place, windows by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.tables import discard, settled, unused
from pricetide.llm.words import U, flat, mix, positions, runs, signed, slices, spans, text_words

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
_FACTOR = 0x9E3779B97F4A7C15


def minimisers(words: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the minimisers among all words, hashes of their runs, and the first and last window start that each belongs to."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    code = runs(words, gram)
    width, best, size = length - gram + 1, np.arange(len(words)), 1
    while size * 2 <= width:
        other = np.r_[best[size:], np.full(min(size, len(best)), max(len(best) - 1, 0))]
        best = np.where(code[other] < code[best], other, best)
        size *= 2
    if (gap := width - size) and len(best):
        other = np.r_[best[gap:], np.full(min(gap, len(best)), len(best) - 1)]
        best = np.where(code[other] < code[best], other, best)
    start = np.flatnonzero(left >= length)
    best = best[start]
    new = np.flatnonzero(np.r_[True, best[1:] != best[:-1]]) if len(best) else np.zeros(0, np.int64)
    return best[new], code[best[new]], start[new], start[np.r_[new[1:], len(best)] - 1] if len(new) else new


def _anchors(df: DataFrame, length: int, gram: int) -> DataFrame:
    """df (doc_id, digest, text) -> doc_id, digest, words, keys, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, first = text_words(part.column("text"))
            at, key, _, _ = minimisers(words, first, length, gram)
            off = pa.array(np.searchsorted(at, first), pa.int32())
            place = at - first[positions(first)[at]] if len(at) else at
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(np.diff(first)), pa.ListArray.from_arrays(off, pa.array(signed(key))), pa.ListArray.from_arrays(off, pa.array(place, pa.int32()))], names=["doc_id", "digest", "words", "keys", "places"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, digest binary, words long, keys array<long>, places array<int>")


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of words as binary that sorts like the words."""
    data = np.ascontiguousarray(rows.astype(">u4"))
    off = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(data)])


def _suffixes(df: DataFrame, length: int, gram: int) -> DataFrame:
    """df (node, places, text) -> the suffixes at these places, with what stands left of them."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            words, first = text_words(part.column("text"))
            at, key, low, high = minimisers(words, first, length, gram)
            text = positions(first)[at] if len(at) else at
            lists = part.column("places")
            wanted = first[:-1][np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))] + lists.flatten().to_numpy()
            keep = np.isin(at, wanted)
            at, key, low, high, text = at[keep], key[keep], low[keep], high[keep], text[keep]
            small = np.r_[np.zeros(before, np.uint32), np.maximum(words >> U(32), U(1)).astype(np.uint32), np.zeros(length, np.uint32)]
            span = np.arange(-before, length)
            around = small[at[:, None] + before + span] if len(at) else np.zeros((0, before + length), np.uint32)
            inside = (at[:, None] + span >= first[text][:, None]) & (at[:, None] + span < first[text + 1][:, None])
            around = around * inside
            begin = first[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(key)), part.column("node").take(pa.array(text)), pa.array(at - begin, pa.int32()), pa.array(low - begin, pa.int32()), pa.array(high - begin, pa.int32()), _binary(around[:, before:]), _binary(around[:, :before])],
                names=["key", "node", "place", "low", "high", "right", "left"],
            )

    return df.mapInArrow(run, "key long, node long, place int, low int, high int, right binary, left binary")


def _windows(df: DataFrame, length: int, gram: int) -> DataFrame:
    """Sorted suffixes -> node, start, window: the windows that may occur elsewhere."""
    before = length - gram
    up = np.cumprod(np.r_[U(1), np.full(before + length - 1, _FACTOR, np.uint64)], dtype=np.uint64)
    down = np.cumprod(np.r_[U(1), np.full(before + length - 1, pow(_FACTOR, -1, 1 << 64), np.uint64)], dtype=np.uint64)

    def rows(column: pa.Array, width: int) -> np.ndarray:
        return np.frombuffer(column.buffers()[2], ">u4", len(column) * width, int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])).reshape(-1, width).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            key = part.column("key").to_numpy()
            node, place, low, high = (part.column(c).to_numpy() for c in ("node", "place", "low", "high"))
            right, left = rows(part.column("right"), length), rows(part.column("left"), before)
            same = np.c_[right[1:] == right[:-1], np.zeros(len(key) - 1, bool)]
            common = np.where(key[1:] == key[:-1], np.argmin(same, 1), 0)
            # The first and last suffix of a batch have neighbours elsewhere; nothing is ruled out for them.
            most = np.maximum(np.r_[length, common], np.r_[common, length])
            low = np.maximum(low, place - before)
            high = np.minimum(high, place - (length - most))
            size = np.maximum(high - low + 1, 0)
            which = np.repeat(np.arange(len(key)), size)
            start = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            total = np.c_[np.zeros(len(key), np.uint64), np.cumsum(np.c_[left, right] * up, axis=1, dtype=np.uint64)]
            at = before - (place[which] - start)
            code = mix((total[which, at + length] - total[which, at]) * down[at])
            yield pa.RecordBatch.from_arrays([pa.array(node[which]), pa.array(start, pa.int32()), pa.array(signed(code))], names=["node", "start", "window"])

    return df.mapInArrow(run, "node long, start int, window long")


def _joined(df: DataFrame, length: int) -> DataFrame:
    """df (node, starts) -> node, spans: overlapping and touching windows joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for starts in part.column("starts"):
                s = np.unique(starts.values.to_numpy())
                cut = np.flatnonzero(np.diff(s) > length)
                out.append([{"start": int(a), "end": int(b) + length} for a, b in zip(s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]], strict=True)])
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(out, pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)])))], names=["node", "spans"])

    return df.mapInArrow(run, T.StructType([T.StructField("node", T.LongType()), T.StructField("spans", SPANS)]))


def repeated_spans(docs: DataFrame, *, length: int = 50, gram: int = 16) -> DataFrame:
    """docs: doc_id, text.  One row per row: doc_id, digest (of the text), words, spans (start and end in words, to be removed)."""
    docs = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), "text")
    base = settled(_anchors(docs, length, gram))
    of_text = base.filter(f"words >= {length}").groupBy("digest").agg(F.min("doc_id").alias("own"), F.any_value("keys").alias("keys"), F.any_value("places").alias("places"))
    texts = settled(of_text.withColumn("node", F.monotonically_increasing_id()))
    anchors = texts.select("node", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"))))
    shared = settled(anchors.groupBy("key").count().filter("count > 1").select("key"))
    wanted = settled(anchors.join(shared, "key").groupBy("node").agg(F.collect_list("place").alias("places")).join(texts.select("node", "digest", "own"), "node"))
    found = docs.join(wanted.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("own"))).select("node", "places", "text")
    suffixes = settled(_suffixes(found, length, gram))
    order = ["key", "right", "node", "place"]
    windows = settled(_windows(suffixes.repartitionByRange(*order).sortWithinPartitions(*order), length, gram).distinct())
    owned = windows.join(texts.select("node", "own"), "node")
    seen = owned.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct(F.col("own").isNull().alias("none"), F.col("own"), F.col("node"), F.col("start"))).alias("one"))
    seen = settled(seen.filter("n > 1").select("window", F.col("one.node").alias("first_node"), F.col("one.start").alias("first_start")))
    again = windows.join(seen, "window").filter("node <> first_node OR start <> first_start").groupBy("node").agg(F.collect_list("start").alias("starts"))
    joined = settled(_joined(again, length))
    named = texts.select("digest", "own", "node").join(joined, "node", "left").select("digest", "own", "spans")
    named = settled(named)
    discard(texts, shared, wanted, suffixes, windows, seen, joined)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("words").cast("int").alias("end")))
    empty = F.array().cast(SPANS.simpleString())
    out = base.select("doc_id", "digest", "words").join(named, "digest", "left")
    spans_ = F.when(F.col("words") < length, empty).when(~F.col("doc_id").eqNullSafe(F.col("own")), whole).otherwise(F.coalesce("spans", empty))
    return out.select("doc_id", "digest", "words", spans_.alias("spans"))


def without_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, text, any more) with the words of found's spans cut out of the texts; the white space after them goes too."""
    columns = docs.columns
    own, of, cuts = (unused(columns, n) for n in ("_id", "_digest", "_spans"))
    found = found.dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias(own), F.col("digest").alias(of), F.col("spans").alias(cuts))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    both = docs.join(found.filter(F.size(cuts) > 0), (digest == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(own)), "left").drop(own, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            lists = part.column(cuts).to_pylist()
            data, off = flat(part.column("text"))
            start, end, first = spans(data, off)
            for k, cut in enumerate(lists):
                if cut:
                    raw, keep, at = data[off[k] : off[k + 1]].tobytes(), [], 0
                    begins = np.r_[start[first[k] : first[k + 1]] - off[k], len(raw)]
                    for s in cut:
                        keep.append(raw[at : begins[s["start"]]])
                        at = begins[s["end"]]
                    texts[k] = b"".join([*keep, raw[at:]]).decode()
            arrays = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return both.mapInArrow(run, docs.schema)
