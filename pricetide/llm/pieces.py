"""SentencePiece encoding and decoding by vectorised merge rounds (byte-pair models with byte fallback).

A text gets a word mark in front, spaces become word marks, and the result is cut into segments that no piece of the model can cross.
All new segments of a slice are encoded together in flat numpy arrays: in each round every segment finds its lowest-ranked adjacent pair
(the leftmost of equals) with a segmented minimum, all segments merge theirs at once, and the arrays are compacted, until no pair remains.
One merge a segment and round is exactly the order in which the library merges.  Segments of many symbols use a heap instead, which gives the
same merges in n log n steps.

Defined results: null and empty texts encode to the end id alone and decode to the empty text; repeated rows are encoded each; other columns pass through.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pricetide.llm.words import slices

MARK = "▁"
NONE = np.int64(1) << 62
LONG = 256


class Merges:
    """The model's tables: ranks and results of pairs, ids of characters and bytes, and the text of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end = model.eos_id()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.size = size
        text = [b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in self.bytes.items():
            text[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(text), np.uint8)
        self.raw_size = np.array([len(x) for x in text], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.id_of = np.arange(size + 1, size + 1 + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.id_of[ord(p)] = i
        scores = np.array([model.get_score(i) for i in range(size)])
        rank = np.unique(-scores, return_inverse=True)[1]
        left, right, whole, joined = [], [], [], set()
        for p, i in self.ids.items():
            if len(p) > 1:
                if any(c not in self.ids for c in p):
                    raise ValueError(f"a character of {p!r} is no piece")
                joined.update(p)
                if MARK in p.lstrip(MARK):
                    raise ValueError("pieces cross word marks")
                for k in range(1, len(p)):
                    if p[:k] in self.ids and p[k:] in self.ids:
                        left.append(self.ids[p[:k]])
                        right.append(self.ids[p[k:]])
                        whole.append(i)
        keys = np.array(left, np.int64) * (size + 1) + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.whole = keys[order], np.array(whole, np.int64)[order]
        self.rank = rank[self.whole].astype(np.int64)
        self.pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.whole.tolist(), strict=True), strict=True))
        #: Line feeds join with nothing in such models; then they end a segment, which keeps the segments few.
        stop = "" if "\n" in joined else "\n"
        self.cut = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + "|\n" * bool(stop))

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such piece) and id of each joined pair."""
        key = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a < self.size) & (b < self.size)
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.whole[at], 0)

    def symbols(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters as ids, flat (one that is no piece counts size + 1 + its code point), and each segment's number of them."""
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        return self.id_of[points].astype(np.int64), np.fromiter(map(len, segments), np.int64, len(segments))

    def final(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and owners, with the byte ids of characters that are no pieces."""
        if (odd := np.flatnonzero(sym > self.size)).size:
            chars, which = np.unique(sym[odd], return_inverse=True)
            coded = [np.array([self.bytes[b] for b in chr(c - self.size - 1).encode()]) for c in chars.tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = np.array([len(c) for c in coded])[which]
            at = np.cumsum(times) - times
            sym, owner = np.repeat(sym, times), np.repeat(owner, times)
            for k, ids in enumerate(coded):
                here = at[odd[which == k]]
                for j, i in enumerate(ids):
                    sym[here + j] = i
        return sym, owner

    def rounds(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over all segments at once; the ids, flat, and the segment of each."""
        sym, size = self.symbols(segments)
        owner = np.repeat(np.arange(len(segments)), size)
        done = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        rank, whole = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same], whole[same] = self.look(sym[same], sym[same + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.where(rank == NONE, NONE, (rank << 32) + np.arange(len(sym))), starts)
            if (over := best == NONE).any():
                sizes = np.diff(np.r_[starts, len(sym)])
                keep = np.repeat(~over, sizes)
                done.append((sym[~keep], owner[~keep]))
                best = best[~over] - np.cumsum(sizes * over)[~over]
                sym, owner, rank, whole = sym[keep], owner[keep], rank[keep], whole[keep]
                if not len(sym):
                    break
            at = best & np.int64(0xFFFFFFFF)
            sym[at] = whole[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, owner, rank, whole = sym[keep], owner[keep], rank[keep], whole[keep]
            for p in (at - 1, at):  # the pairs left and right of what was merged
                p = p[p >= 0]
                inner = np.zeros(len(p), bool)
                ok = p + 1 < len(sym)
                inner[ok] = owner[p[ok]] == owner[p[ok] + 1]
                rank[p[~inner]] = NONE
                p = p[inner]
                rank[p], whole[p] = self.look(sym[p], sym[p + 1])
        sym, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return self.final(sym[order], owner[order])

    def heap(self, segment: str) -> np.ndarray:
        """The same merges for one long segment."""
        sym = self.symbols([segment])[0].tolist()
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        todo: list[tuple[int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] < self.size and sym[j] < self.size and (hit := self.pairs.get(sym[i] * (self.size + 1) + sym[j])):
                heapq.heappush(todo, (hit[0], i, sym[i], sym[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while todo:
            _, i, a, b = heapq.heappop(todo)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = self.pairs[a * (self.size + 1) + b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        left = np.array([s for s in sym if s >= 0], np.int64)
        return self.final(left, left)[0]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of runs of ids: pieces with marks as spaces, byte ids as bytes, special ids as nothing; the mark put in front goes."""
        size = self.raw_size[ids]
        run = np.cumsum(size)
        data = self.raw[np.repeat(self.raw_start[ids] - (run - size), size) + np.arange(size.sum())].tobytes()
        stop = np.r_[0, run][np.r_[0, ends]].tolist()
        return [data[a:b].decode(errors="replace")[1:] for a, b in zip(stop[:-1], stop[1:], strict=True)]


@lru_cache(maxsize=4)
def _merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Encodes texts with a bounded memory of segments met before."""

    def __init__(self, path: str, remember: int = 150_000):
        self.m, self.most = _merges(path), remember
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.size: list[np.ndarray] = [np.zeros(0, np.int64)]

    def learn(self, segments: list[str]) -> None:
        short, long = [s for s in segments if len(s) <= LONG], [s for s in segments if len(s) > LONG]
        ids, owner = self.m.rounds(short)
        more = [self.m.heap(s) for s in long]
        self.flat = [np.concatenate([*self.flat, ids, *more]).astype(np.int32)]
        self.size = [np.concatenate([*self.size, np.bincount(owner, minlength=len(short)), [len(x) for x in more]]).astype(np.int64)]
        self.number.update(zip([*short, *long], range(len(self.number), len(self.number) + len(segments)), strict=True))

    def batch(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """Ids (with the end id) and decoded text of each text."""
        if len(self.number) > self.most:
            self.forget()
        cut = [self.m.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if new := set().union(*cut) - self.number.keys():
            self.learn(list(new))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        seg = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        flat, sizes = self.flat[0], self.size[0]
        size = sizes[seg]
        run = np.cumsum(size)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[seg] - (run - size), size) + np.arange(size.sum())]
        ends = np.r_[0, run][np.cumsum(counts)]
        decoded = self.m.decode(ids, ends)
        ids = np.insert(ids, ends, self.m.end)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends + np.arange(1, len(ends) + 1)], pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of each text (an end id last) and the text that they decode to; a column of either name is replaced."""
    df = df.drop(ids, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_path)
        for part in slices(batches, text):
            got = encoder.batch(part.column(part.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, *got], names=[*part.schema.names, ids, decoded])

    return df.mapInArrow(run, schema)
