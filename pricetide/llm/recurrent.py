"""Scores of whole texts under a gated recurrent language model, beside a unigram score.

Words are lower-cased (A to Z) and followed by one end token.  Word counts come from all training texts, by one shuffle of sums.  The most frequent
words have vectors and outputs of their own; the output is factored: first a class of words of like frequency, then the word in it.  All other
words are one more class, inside which a word has its share of the counts, add-one smoothed, with one place for words never seen.

The network starts at the counts' unigram distribution and is trained in rounds: in each, every task runs truncated backpropagation over its part
of that round's share of the training texts, and the weights are averaged, weighted by tokens.  The rounds share out all training texts, each to one
round, by a hash of id and text.  Scoring runs over all texts of a slice in step and carries each text's state from window to window, so the
log-likelihood is that of the whole text.  Counts of words too many for a task's table are joined by hash.

Defined results: null and empty texts are the end token alone; repeated rows are scored each; with no training texts every token has count 0 and the
score is the unigram score.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.tables import discard, settled
from pricetide.llm.vectors import lists
from pricetide.llm.words import flat, hashes, positions, signed, slices, spans

END = np.int64(-0x61C8864680B583EB)
LN10 = np.log(10.0)


@dataclass
class Vocabulary:
    """Counts of the training tokens; the most frequent are held here, in the order of their hashes."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    model: np.ndarray  # hashes of the words with vectors, most frequent first
    model_counts: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.model, kind="stable")
        self.model_sorted, self.model_rank = self.model[order], order
        # The number of each held word's vector, so that one look-up tells count and number; all modelled words are held.
        self.numbers = self.number(self.hashes)
        self.rare_tokens = self.tokens - int(self.model_counts.sum())
        self.rare_distinct = self.distinct - len(self.model)

    def known(self, h: np.ndarray) -> np.ndarray:
        """Count of each word, -1 if it isn't held."""
        return _look(self.hashes, self.counts, h)

    def both(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """known and number."""
        if not len(self.hashes):
            return np.full(len(h), -1), np.full(len(h), len(self.model))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, self.counts[at], -1), np.where(hit, self.numbers[at], len(self.model))

    def number(self, h: np.ndarray) -> np.ndarray:
        """Number of each word's vector; len(model) for all others."""
        got = _look(self.model_sorted, self.model_rank, h)
        return np.where(got < 0, len(self.model), got)


def _look(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], -1)


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with the end tokens, and where each text starts (with the end)."""
    data, off = flat(text)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, first = spans(data, off)
    return np.insert(signed(hashes(data, start, end)), first[1:], END), first + np.arange(len(first))


def _counted(docs: DataFrame) -> DataFrame:
    """word, n: sums of the tokens of each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            word, n = np.unique(tokens(part.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long")


def vocabulary(counts: DataFrame, held: int, modelled: int) -> Vocabulary:
    """counts: word, c (stored).  At most `held` of the most frequent words reach the driver."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The least count that still fits is read off the number of words of each count.
    often = counts.groupBy("c").count().orderBy(F.desc("c")).limit(held).collect()
    n, least = 0, None
    for r in often:
        if n + r["count"] > held:
            break
        n, least = n + r["count"], r["c"]
    got = counts.filter(F.col("c") >= least).toArrow() if least is not None else None
    word = got.column("word").to_numpy() if got is not None else np.zeros(0, np.int64)
    c = got.column("c").to_numpy() if got is not None else np.zeros(0, np.int64)
    order = np.argsort(word)
    word, c = word[order], c[order]
    top = np.argsort(-c, kind="stable")[:modelled]
    return Vocabulary(word, c, int(total[0]), int(total[1]), word[top], c[top])


class Network:
    """Gated recurrent units of size `hidden`; classes of `width` words by frequency, and one class for all rare words."""

    def __init__(self, v: Vocabulary, hidden: int, width: int, seed: int = 5):
        words = len(v.model)
        self.words, self.hidden, self.width = words, hidden, width
        self.classes = -(-words // width)
        rng = np.random.default_rng(seed)
        padded = np.r_[v.model_counts, np.zeros(self.classes * width - words)].reshape(self.classes, width) if words else np.zeros((0, width))
        mass = np.r_[padded.sum(1), v.rare_tokens + 1.0]
        self.p = {
            "x": rng.normal(0, 0.3, (words + 1, 3 * hidden)), "u": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), "b": np.zeros(3 * hidden),
            "cw": np.zeros((hidden, self.classes + 1)), "cb": np.log(mass / mass.sum()),
            "ww": np.zeros((self.classes, hidden, width)), "wb": np.where(padded > 0, np.log(np.maximum(padded, 1e-9)), -40.0),
        }
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}

    def step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """a: the inputs' vectors, with the bias."""
        n = self.hidden
        g = h @ self.p["u"]
        gates = a[:, : 2 * n] + g[:, : 2 * n]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :n], gates[:, n:]
        c = r * g[:, 2 * n :]
        c += a[:, 2 * n :]
        np.tanh(c, out=c)
        return c + z * (h - c), z, r, c, g[:, 2 * n :]

    def _small(self) -> bool:
        """Whether no output can be large: states lie between -1 and 1, so a logit is at most its bias and the sum of its weights."""
        classes = np.abs(self.p["cb"]) + np.abs(self.p["cw"]).sum(0)
        words = np.abs(self.p["wb"]) + np.abs(self.p["ww"]).sum(1)
        return max(float(classes.max(initial=0)), float(words.max(initial=0))) < 60

    def output(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the next tokens (of the rare class for rare words), and the gradient with respect to h."""
        cls = np.where(y < self.words, y // self.width, self.classes)
        small = self._small()
        logit = h @ self.p["cw"]
        logit += self.p["cb"]
        if not small:
            logit -= logit.max(1, keepdims=True)
        rows = np.arange(len(y))
        own = logit[rows, cls]
        e = np.exp(logit, out=logit)
        s = e.sum(1)
        out = (own - np.log(s)).astype(np.float64)
        dh = None
        if grads is not None:
            e /= -s[:, None]
            e[rows, cls] += 1
            grads["cw"] = h.T @ e
            grads["cb"] = e.sum(0)
            dh = e @ self.p["cw"].T
        # Words of a class lie together: one product a class, all else in one go.
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cut = np.searchsorted(cls[order], np.arange(self.classes + 1))
        order = order[: cut[-1]]
        near, mine, word = h[order], cls[order], y[order] - cls[order] * self.width
        logit = np.empty((len(order), self.width), np.float32)
        used = np.flatnonzero(np.diff(cut)).tolist()
        for k in used:
            np.matmul(near[cut[k] : cut[k + 1]], self.p["ww"][k], out=logit[cut[k] : cut[k + 1]])
        logit += self.p["wb"][mine]
        if not small:
            logit -= logit.max(1, keepdims=True)
        rows = np.arange(len(order))
        own = logit[rows, word]
        e = np.exp(logit, out=logit)
        s = e.sum(1)
        out[order] += own - np.log(s)
        if grads is not None:
            e /= -s[:, None]
            e[rows, word] += 1
            back = np.empty_like(near)
            for k in used:
                at = slice(cut[k], cut[k + 1])
                grads["ww"][k] = near[at].T @ e[at]
                grads["wb"][k] = e[at].sum(0) * (self.p["wb"][k] > -39)
                np.matmul(e[at], self.p["ww"][k].T, out=back[at])
            dh[order] += back
        return out, dh

    def train(self, stream: np.ndarray, end: int, lanes: int = 512, window: int = 24, steps: int = 100, rate: float = 0.02) -> None:
        """Truncated backpropagation with Adam over a stream of token numbers, cut into lanes; the state carries over windows and is
        empty after an end token.  There are as many lanes as leave `steps` windows, up to `lanes`."""
        lanes = max(1, min(lanes, len(stream) // (window * steps)))
        size = len(stream) // lanes
        if size < 2:
            return
        data = stream[: lanes * size].reshape(lanes, size).T
        n, one = self.hidden, np.float32(1)
        h = np.zeros((lanes, n), np.float32)
        first = {k: np.zeros_like(a) for k, a in self.p.items()}
        second = {k: np.zeros_like(a) for k, a in self.p.items()}
        for t, at in enumerate(range(0, size - 1, window), 1):
            x, y = data[at : min(at + window, size - 1)], data[at + 1 : at + 1 + min(window, size - 1 - at)]
            going = (x != end).astype(np.float32)[:, :, None]
            memory, states = [], np.empty((len(x), lanes, n), np.float32)
            given = self.p["x"][x] + self.p["b"]
            for k in range(len(x)):
                h = h * going[k]
                new, *gates = self.step(given[k], h)
                memory.append((h, *gates))
                h = states[k] = new
            grads = {k: np.zeros_like(a) for k, a in self.p.items() if k != "x"}
            _, dh_all = self.output(states.reshape(-1, n), y.ravel(), grads)
            dh_all = dh_all.reshape(len(x), lanes, n)
            back = np.zeros_like(h)
            da, dg = np.empty((len(x), lanes, 3 * n), np.float32), np.empty((len(x), lanes, n), np.float32)
            turned = np.ascontiguousarray(self.p["u"].T)
            for k in range(len(x) - 1, -1, -1):
                prev, z, r, c, g = memory[k]
                dh = dh_all[k] + back
                dc = dh * (one - z) * (one - c * c)
                da[k, :, :n] = dh * (prev - c) * z * (one - z)
                da[k, :, n : 2 * n] = dc * g * r * (one - r)
                da[k, :, 2 * n :] = dc
                np.multiply(dc, r, out=dg[k])
                back = (da[k, :, : 2 * n] @ turned[: 2 * n] + dg[k] @ turned[2 * n :] + dh * z) * going[k]
            flat_da, before = da.reshape(-1, 3 * n), np.concatenate([m[0] for m in memory]).T
            grads["u"] = np.concatenate([before @ flat_da[:, : 2 * n], before @ dg.reshape(-1, n)], axis=1)
            grads["b"] = flat_da.sum(0)
            # Only the vectors of words in the window have gradients: their sums, by one sort.
            rows = x.ravel().astype(np.int16 if self.words < 1 << 15 else np.int32)
            order = np.argsort(rows, kind="stable")
            sorted_rows = rows[order]
            starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
            touched = sorted_rows[starts].astype(np.int64)
            self._adam("x", touched, np.add.reduceat(flat_da[order], starts, axis=0) / y.size, first, second, t, rate)
            for k, g in grads.items():
                self._adam(k, slice(None), g / y.size, first, second, t, rate)

    def _adam(self, name: str, at, g: np.ndarray, first: dict, second: dict, t: int, rate: float) -> None:
        g = g.astype(np.float32, copy=False)
        m = first[name][at] * np.float32(0.9) + np.float32(0.1) * g
        v = second[name][at] * np.float32(0.99) + np.float32(0.01) * g * g
        first[name][at], second[name][at] = m, v
        self.p[name][at] += np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(v / np.float32(1 - 0.99**t)) + np.float32(1e-6))

    def score(self, numbers: np.ndarray, first: np.ndarray, end: int, together: int = 16_384) -> np.ndarray:
        """Natural log-probability of every token, all texts in step; outputs are computed for about `together` tokens at a time."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        out = np.zeros(len(numbers))
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(steps), side="left")
        h = np.zeros((len(size), self.hidden), np.float32)
        x = np.full(len(size), end)
        vectors = self.p["x"] + self.p["b"]
        at = 0
        while at < steps:
            upto = min(steps, at + max(8, min(512, together // int(live[at]))))
            states, places = [], []
            for t in range(at, upto):
                m = live[t]
                place = start[:m] + t
                h = self.step(vectors[x[:m]], h[:m])[0]
                states.append(h)
                places.append(place)
                x = numbers[place]
            place = np.concatenate(places)
            out[place] = self.output(np.concatenate(states), numbers[place])[0]
            at = upto
        return out


#: Weight vectors that one task adds up.
FAN_IN = 32


def _trained(docs: DataFrame, v: Vocabulary, net: Network, pick: Column) -> Network:
    """One round: every task trains on its picked texts; weights are averaged by tokens, in a tree whose groups hold FAN_IN of them."""
    shared = docs.sparkSession.sparkContext.broadcast((v, net))
    names = list(net.p)
    schema = "part int, n long, weights binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = shared.value
        end = int(v.number(np.array([END]))[0])
        parts = [v.number(tokens(part.column("text"))[0]).astype(np.int32) for part in slices(batches, "text")]
        stream = np.concatenate([np.zeros(0, np.int32), *parts])
        if len(stream) > 1:
            own = Network.__new__(Network)
            own.__dict__.update(net.__dict__, p={k: a.copy() for k, a in net.p.items()})
            own.train(stream, end)
            flat_ = np.concatenate([own.p[k].ravel() for k in names])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(stream)]), pa.array([flat_.tobytes()], pa.binary())], names=["part", "n", "weights"])

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].to_numpy()
        mean = sum(np.frombuffer(w, np.float32).astype(np.float64) * (k / n.sum()) for w, k in zip(group["weights"], n, strict=True))
        return pd.DataFrame({"part": [int(key[0])], "n": [int(n.sum())], "weights": [mean.astype(np.float32).tobytes()]})

    rows = settled(docs.filter(pick).select("text").mapInArrow(run, schema))
    tasks = rows.agg(F.max("part")).first()[0]
    while tasks is not None and tasks > 0:
        merged = settled(rows.groupBy(F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).applyInPandas(add, schema))
        discard(rows)
        rows, tasks = merged, tasks // FAN_IN
    got = rows.collect()  # one row, or none
    discard(rows)
    if got:
        mean = np.frombuffer(got[0]["weights"], np.float32)
        at = 0
        for k in names:
            net.p[k] = mean[at : at + net.p[k].size].reshape(net.p[k].shape).copy()
            at += net.p[k].size
    return net


def _by_length(batches: Iterator[pa.RecordBatch], long: int = 2048, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with their tokens and where each text starts.  Texts of more than `long` tokens wait until there are `most` tokens of them,
    as few texts in step cost as many steps as many do."""
    rows: list[pa.RecordBatch] = []
    waiting: list[np.ndarray] = []

    def long_ones() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        return table, np.concatenate(waiting), np.r_[0, np.cumsum([len(w) for w in waiting])]

    for part in slices(batches, "text", 6 << 20):
        word, first = tokens(part.column("text"))
        part = part.drop_columns(["text"])
        over = np.diff(first) > long
        if not over.any():
            yield part, word, first
            continue
        keep = np.repeat(~over, np.diff(first))
        if not over.all():
            yield part.filter(pa.array(~over)), word[keep], np.r_[0, np.cumsum(np.diff(first)[~over])]
        for k in np.flatnonzero(over).tolist():
            rows.append(part.slice(k, 1))
            waiting.append(word[first[k] : first[k + 1]].copy())
            if sum(map(len, waiting)) >= most:
                yield long_ones()
                rows, waiting = [], []
    if rows:
        yield long_ones()


def score(docs: DataFrame, held_out: Column, *, held: int = 1 << 18, modelled: int = 2048, width: int = 32, hidden: int = 24, rounds: int = 3, share: float | None = None) -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    share: of the training texts in each round; all texts are in one of the rounds if it isn't given."""
    share = 1 / rounds if share is None else share
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = docs.filter("NOT held_out")
    counts = settled(_counted(train).groupBy("word").agg(F.sum("n").alias("c")))
    v = vocabulary(counts, held, modelled)
    net = Network(v, hidden, width)
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    for k in range(rounds if v.tokens else 0):
        net = _trained(train, v, net, (place >= k * share) & (place < (k + 1) * share))
    shared = docs.sparkSession.sparkContext.broadcast((v, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = shared.value
        end = int(v.number(np.array([END]))[0])
        for part, word, first in _by_length(batches):
            n = part.num_rows
            owner, (c, number) = positions(first), v.both(word)
            total = lambda x: np.bincount(owner, x, n)
            log_c = np.log10(np.maximum(c, 0) + 1.0)
            rare, tail = number == len(v.model), c < 0
            model = net.score(number, first, end) / LN10
            at = np.flatnonzero(tail)
            columns = [pa.array(np.diff(first)), pa.array(total(c > 0).astype(np.int64)), pa.array(total(log_c)), pa.array(total(model + rare * log_c)), pa.array(total(rare).astype(np.int64)), lists(word[at], np.searchsorted(at, first[1:]), pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("held_out"), *columns], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "n_rare", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, n_rare long, tail array<long>")
    rows = settled(rows)
    found = rows.select("row", F.explode("tail").alias("word")).join(counts, "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    both = settled(rows.drop("tail").join(found, "row", "left"))
    discard(rows, counts)
    logs = F.coalesce("logs", F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * float(np.log10(v.tokens + v.distinct + 1))
    model = F.col("model") + logs - F.col("n_rare") * float(np.log10(v.rare_tokens + v.rare_distinct + 1))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (model if v.tokens else base).alias("score"),
    )
