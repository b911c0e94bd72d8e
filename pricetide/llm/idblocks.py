"""Token ids in files of patched frame-of-reference blocks.

Documents are ordered by id (nulls first, then by a hash of the text, then by place) by a range sort; each range partition encodes its texts with the
tokenizer and writes them to files of whole documents, about `most` ids each.  A file, all numbers little-endian:

    b"PFORIDS1", then as 64-bit integers: partition, number in it, documents, ids, blocks, bytes of block data
    per document: id (64 bits), 1 if the id is null (8 bits), ids (64 bits)
    per block: start in the data (64 bits, one more than blocks), least id (32 bits), width (8 bits), exceptions (16 bits)
    data per block: 256 offsets of `width` bits from the least id, then the exceptions' places (8 bits) and upper parts (32 bits)
    a line feed

A block's width is the smallest that holds `percentile` of its offsets; what doesn't fit is an exception: its lower bits stay in the frame, the rest
is patched in.  The block starts give any run of ids by reading its blocks alone.

Spark writes the files, so any store that Spark reaches will do, and a lost task's files are never seen.  Encoding remembers, per task, the ids of
runs such as a space and the word after it, cut where neither the pre-tokenizer's pattern nor special strings ever reach across, so each run is encoded
alone, by the library.  Runs of at most 64 bytes are told apart by 64-bit hashes; longer ones are encoded each time.

Defined results: a null or empty text is the end id alone; null ids come first; repeated rows are written each; an empty table has no files, which read
as no rows.  Very long texts are one document of one file, however long.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.llm.tables import settled
from pricetide.llm.words import SPACES, flat, hashes, slices

MAGIC = b"PFORIDS1"
HEAD = "<8s6q"
BLOCK = 256
# Longer runs are encoded as they come, without being remembered.
REMEMBERED = 64


def _cell(width: int) -> str:
    return "<u2" if width <= 16 else "<u4"


def _wide(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers as bytes, `width` bits each."""
    kind = np.dtype(_cell(width))
    bits = np.unpackbits(values.astype(kind).view(np.uint8), axis=1, bitorder="little").reshape(len(values), BLOCK, 8 * kind.itemsize)
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _narrow(rows: np.ndarray, width: int) -> np.ndarray:
    kind = np.dtype(_cell(width))
    bits = np.zeros((len(rows), BLOCK, 8 * kind.itemsize), np.uint8)
    bits[:, :, :width] = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little").view(kind)


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of the next."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)


def pack(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray, bytes]:
    """Block headers, block starts and block data of ids."""
    blocks = -(-len(ids) // BLOCK)
    x = np.zeros(blocks * BLOCK, np.uint32)
    x[: len(ids)] = ids
    if len(ids):
        x[len(ids) :] = ids[-1]
    x = x.reshape(blocks, BLOCK)
    least = x.min(1, initial=np.uint32(0xFFFFFFFF)) if blocks else np.zeros(0, np.uint32)
    off = x - least[:, None]
    need = np.frexp(off.astype(np.float64))[1].astype(np.uint8)
    width = np.sort(need, axis=1)[:, int(np.ceil(percentile * BLOCK)) - 1] if blocks else np.zeros(0, np.uint8)
    over = need > width[:, None]
    count = over.sum(1)
    frame = width.astype(np.int64) * (BLOCK // 8)
    start = np.r_[0, np.cumsum(frame + 5 * count)].astype(np.int64)
    data = np.zeros(start[-1], np.uint8)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        data[start[of][:, None] + np.arange(int(w) * (BLOCK // 8))] = _wide(off[of] & np.uint32((1 << int(w)) - 1), int(w))
    row, place = np.nonzero(over)
    data[_places(start[:-1] + frame, count)] = place.astype(np.uint8)
    upper = (off[row, place] >> width[row].astype(np.uint32)).astype("<u4")
    data[_places(start[:-1] + frame + count, 4 * count)] = upper.view(np.uint8)
    return least.astype("<u4").tobytes() + width.astype(np.uint8).tobytes() + count.astype("<u2").tobytes(), start, data.tobytes()


def unpack(data: np.ndarray, start: np.ndarray, least: np.ndarray, width: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All ids of blocks (whole ones: the last may hold more than was packed)."""
    off = np.zeros((len(least), BLOCK), np.uint32)
    frame = width.astype(np.int64) * (BLOCK // 8)
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        off[of] = _narrow(data[start[of][:, None] + np.arange(int(w) * (BLOCK // 8))], int(w))
    row = np.repeat(np.arange(len(least)), count)
    upper = np.ascontiguousarray(data[_places(start + frame + count, 4 * count.astype(np.int64))]).view("<u4")
    place = data[_places(start + frame, count.astype(np.int64))]
    off[row, place] |= upper << width[row].astype(np.uint32)
    return (off + least[:, None]).ravel()


class File:
    """One file's content: its documents, and any run of its ids."""

    def __init__(self, content: bytes):
        magic, self.part, self.number, self.documents, self.size, blocks, nbytes = struct.unpack_from(HEAD, content)
        if magic != MAGIC:
            raise ValueError("not a file of token-id blocks")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        self.names, self.nameless, self.lengths = take("<i8", self.documents), take("u1", self.documents).astype(bool), take("<i8", self.documents)
        self.start, self.least, self.width, self.count = take("<i8", blocks + 1), take("<u4", blocks), take("u1", blocks), take("<u2", blocks)
        self.data = take("u1", nbytes)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file, from the blocks that hold them alone."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, -(-b // BLOCK)
        got = unpack(self.data, self.start[first:last], self.least[first:last], self.width[first:last], self.count[first:last])
        return got[a - first * BLOCK : b - first * BLOCK]


def file_of(part: int, number: int, names: list[int | None], runs: list[np.ndarray], percentile: float = 0.9) -> bytes:
    """The content of a file of documents."""
    ids = np.concatenate([*runs, np.zeros(0, np.uint32)])
    head, start, data = pack(ids, percentile)
    return b"".join([
        struct.pack(HEAD, MAGIC, part, number, len(names), len(ids), len(start) - 1, len(data)),
        np.array([n or 0 for n in names], "<i8").tobytes(), np.array([n is None for n in names], "u1").tobytes(),
        np.array([len(r) for r in runs], "<i8").tobytes(), start.astype("<i8").tobytes(), head, data,
    ])


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


SPECIAL = b"<|endoftext|>"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, bool)  # ASCII that is no space, letter, digit, control or apostrophe
_SIGN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True


def runs_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs that the pre-tokenizer never joins, and the number of the first of each text (with the end).

    A run starts at each text, and
    - at an ASCII space after a byte that ends a word for certain: one that is no space, no control, and can't be the end of a space beyond ASCII;
    - after a single line feed or tab that such a run starts with, before an ASCII byte or a Latin letter;
    - at a sign after a letter or digit, unless a special string is about (it mixes both).
    """
    head = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        space = SPACES[data]
        b1, b2 = data[:-1], np.r_[np.uint8(0), data[:-2]]
        b3 = np.r_[np.uint8(0), np.uint8(0), data[:-3]][: len(b1)]
        far = (b1 >= 0x80) & (((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 == 0xE1) & (b2 == 0x9A)) | ((b3 == 0xE2) & (b2 <= 0x81)) | ((b3 == 0xE3) & (b2 == 0x80)))
        opens = space[1:] & ~space[:-1] & (b1 > 0x20) & (b1 != 0x7F) & ~far
        head[1:-1] = opens
        plain = (data > 0x20) & (data < 0x7F) | (data == 0xC3)
        head[2:-1] |= opens[:-1] & (data[1:-1] != 0x20) & plain[2:]
        if data.tobytes().find(SPECIAL) < 0:
            latin = (b2 == 0xC3) & (b1 >= 0x80) & (b1 != 0x97) & (b1 != 0xB7)
            head[1:-1] |= _SIGN[data[1:]] & (_LETTER[b1] | ((b1 >= 0x30) & (b1 <= 0x39)) | latin)
    head[off] = True
    head[-1] = False
    start = np.flatnonzero(head)
    return start, np.searchsorted(start, off)


class Encoder:
    """Encodes texts, remembering a bounded number of runs by their hashes: when there are too many, those met again since the last time stay."""

    def __init__(self, path: str, remember: int = 400_000):
        self.t, self.most = _tokenizer(path), remember
        self.known, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.at, self.size, self.again = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)

    def _forget(self) -> None:
        keep = self.again if 2 * self.again.sum() <= self.most else np.zeros(len(self.known), bool)
        at, size = self.at[keep], self.size[keep]
        self.known, self.size, self.again = self.known[keep], size, np.zeros(len(size), bool)
        self.ids = self.ids[_places(at, size)]
        self.at = np.cumsum(size, dtype=np.int64) - size

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for k in range(0, len(texts), 4096) for x in self.t.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]

    def _learn(self, new: np.ndarray, texts: list[str]) -> None:
        got = self._encode(texts)
        size = np.fromiter(map(len, got), np.int32, len(got))
        at = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))])
        place = np.searchsorted(self.known, new)
        self.known, self.at, self.size = np.insert(self.known, place, new), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.again = np.insert(self.again, place, False)

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's ids stop."""
        data, off = flat(column)
        start, first = runs_of(data, off)
        end = np.r_[start[1:], len(data)][: len(start)]
        raw = data.tobytes()
        short = end - start <= REMEMBERED
        if len(self.known) > self.most:
            self._forget()
        key = hashes(data, start, end)
        here, where = np.unique(key[short], return_index=True)
        place = np.minimum(np.searchsorted(self.known, here), max(len(self.known) - 1, 0))
        met = self.known[place] == here if len(self.known) else np.zeros(len(here), bool)
        self.again[place[met]] = True
        new = here[~met]
        if len(new):
            where = np.flatnonzero(short)[where[np.searchsorted(here, new)]]
            self._learn(new, [raw[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
        place = np.minimum(np.searchsorted(self.known, key), max(len(self.known) - 1, 0))
        at, size = (self.at[place], self.size[place].astype(np.int64)) if len(self.known) else (np.zeros(len(key), np.int64), np.zeros(len(key), np.int64))
        ids = self.ids
        if not short.all():
            long = np.flatnonzero(~short)
            got = self._encode([raw[a:b].decode() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
            size[long] = [len(g) for g in got]
            at[long] = len(ids) + np.cumsum(size[long]) - size[long]
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(got), np.uint32, int(size[long].sum()))])
        stops = np.r_[0, np.cumsum(size)]
        return ids[_places(at, size)], stops[first][1:]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks that a worker process runs one after another: what is remembered never changes a result."""
    return Encoder(path)


def write_ids(df: DataFrame, tokenizer_path: str, path: str, name: str = "doc_id", text: str = "text", end: int = 0, most: int = 1 << 20, percentile: float = 0.9) -> None:
    """Write the ids of every text, each followed by the end id, to files below a new path, in the order of name.  Other columns aren't written."""
    # The place tells repeated rows apart, so that a group of any size spreads over ranges.
    rows = df.select(F.col(name).cast("long").alias("name"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(F.col("name").asc_nulls_first(), "hash", "place").sortWithinPartitions(F.col("name").asc_nulls_first(), "hash", "place").select("name", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        runs: list[np.ndarray] = []

        def content() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file_of(part, number, names, runs, percentile)], pa.binary())], names=["content"])

        held = 0
        for batch in slices(batches, "text", 1 << 20):
            ids, stops = encoder.batch(batch.column(batch.schema.get_field_index("text")))
            for key, a, b in zip(batch.column(0).to_pylist(), np.r_[0, stops[:-1]].tolist(), stops.tolist(), strict=True):
                names.append(key)
                runs.append(np.append(ids[a:b], np.uint32(end)))
                held += b - a + 1
                if held >= most:
                    yield content()
                    names, runs, held, number = [], [], 0, number + 1
        if names:
            yield content()

    # One record is one file: the text writer puts a record's bytes as they are, and a line feed.
    ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all files below path: name long, start long (ids of all documents before it), n_tokens long, ids binary (unsigned 32-bit
    little-endian integers, the end id with them)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [struct.unpack_from(HEAD, c.as_buffer()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 4))], names=["path", "part", "number", "size"])

    sized = settled(files.mapInArrow(heads, "path string, part long, number long, size long"))
    # Starts: sums within a partition's files, then over partitions, of which there are as many as the writing job had tasks.
    of_parts = sized.groupBy("part").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sized.select("path", "part", inside.alias("inside")).join(of_parts.select("part", before.alias("before")), "part")
    starts = settled(starts.select("path", (F.col("inside") + F.col("before")).cast("long").alias("start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column(batch.schema.get_field_index("content")), batch.column(batch.schema.get_field_index("start")), strict=True):
                f = File(content.as_py())
                raw, stops = f.ids(0, f.size).astype("<u4").tobytes(), np.r_[0, np.cumsum(f.lengths)]
                for a in range(0, f.documents, 4096):
                    b = min(a + 4096, f.documents)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(f.names[a:b], mask=f.nameless[a:b]), pa.array(start.as_py() + stops[a:b], pa.int64()), pa.array(f.lengths[a:b], pa.int64()),
                            pa.array([raw[4 * i : 4 * j] for i, j in zip(stops[a:b].tolist(), stops[a + 1 : b + 1].tolist(), strict=True)], pa.binary()),
                        ],
                        names=["name", "start", "n_tokens", "ids"],
                    )

    return files.join(starts, "path").mapInArrow(run, "name long, start long, n_tokens long, ids binary")
