"""Language of each word by a linear-chain conditional random field, and of each text by its words.

Words are cut at white space and lower-cased.  A word's score for a language is the sum of learned weights of its character n-grams (with the
word's edges), its affixes, and the word itself if it is in the lexicon; transitions between the languages of neighbouring words are learned too.
Marginals by forward-backward over the whole text label every word, also where languages are mixed inside a text; the text gets the language with
the largest sum of marginals over words that have a letter, and the mean of these as its score.

The model is fitted by gradient ascent on the conditional log-likelihood over a bounded, documented sample of labelled texts: the `per_language`
texts of at most `most_chars` characters with the smallest hash of id and text, in each language.  Their pieces are put one after another, so that
transitions are seen.  Only text and label are used.

Defined results: a null text, or one without any letter, is `und` with score 0; with nothing to learn from, every text is; equal texts get equal
results; extra columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricetide.llm.words import U, flat, hashes, positions, slices, spans

#: Size of the table that n-grams and affixes are hashed into.
TABLE = 1 << 16
SLICE = 3 << 19


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # TABLE x languages
    lexicon: np.ndarray  # sorted word hashes
    lexical: np.ndarray  # lexicon x languages
    moves: np.ndarray  # from x to


def held_out(doc_id: Column, of: int) -> Column:
    """Whether the CRC of the id's text is divisible by `of`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == 0


@dataclass
class Words:
    """All words of some texts: feature numbers of their bytes and affixes, hashes, and which have a letter."""

    grams: np.ndarray  # 3 x bytes with edges
    at: np.ndarray  # where each word's bytes start, with the end
    affixes: np.ndarray  # 2 x words
    hash: np.ndarray
    letters: np.ndarray
    first: np.ndarray  # first word of each text, with the end

    def take(self, pick: np.ndarray) -> Words:
        size = self.at[pick + 1] - self.at[pick]
        at = np.r_[0, np.cumsum(size)]
        return Words(self.grams[:, np.repeat(self.at[pick] - at[:-1], size) + np.arange(at[-1])], at, self.affixes[:, pick], self.hash[pick], self.letters[pick], self.first[:0])


def _number(code: np.ndarray, salt: int) -> np.ndarray:
    return (((code + U(salt)) * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.int32)


def features(text: pa.Array) -> Words:
    data, off = flat(pc.utf8_lower(text.cast(pa.large_string())))
    start, end, first = spans(data, off)
    words, size = hashes(data, start, end), end - start
    # Words laid out with an edge byte on either side.
    at = np.r_[0, np.cumsum(size + 2)]
    n = int(at[-1])
    padded = np.zeros(n + 4, np.uint64)
    step = np.cumsum(size) - size
    place = np.arange(int(size.sum()))
    padded[np.repeat(at[:-1] + 1 - step, size) + place] = data[np.repeat(start - step, size) + place]
    left = np.repeat(at[1:], size + 2) - np.arange(n)  # bytes up to the word's end
    # Letters: a to z, and all beyond ASCII but the signs of the first 64 places, of which three are letters.
    after = np.r_[0, data[:-1]][: len(data)] == 0xC2
    total = np.r_[0, np.cumsum(((data >= 97) & (data <= 122)) | (data >= 0xC3) | (after & ((data == 0xAA) | (data == 0xB5) | (data == 0xBA))))]
    grams = np.empty((3, n), np.int32)
    code = padded[:n]
    for k in (2, 3, 4):
        code = code * U(257) + padded[k - 1 : n + k - 1]
        grams[k - 2] = _number(code, k << 40)
        grams[k - 2][left < k] = TABLE  # runs over the word's end
    # Affixes of three bytes are told apart from inner n-grams.
    affixes = np.empty((2, len(size)), np.int32)
    for k, pick in enumerate((at[:-1] + 1, np.maximum(at[1:] - 4, at[:-1]))):
        affixes[k] = _number((padded[pick] * U(257) + padded[pick + 1]) * U(257) + padded[pick + 2], (1 << 50) + (k << 51))
    return Words(grams, at, affixes, words, total[end] > total[start], first)


def emissions(m: Model, w: Words) -> np.ndarray:
    if not len(w.hash):
        return np.zeros((0, len(m.languages)))
    table = np.vstack([m.grams, np.zeros((1, m.grams.shape[1]), np.float32)])
    score = table[w.grams[0]]
    for k in (1, 2):
        score += table[w.grams[k]]
    score = np.add.reduceat(score, w.at[:-1], axis=0) + table[w.affixes[0]] + table[w.affixes[1]]
    if len(m.lexicon):
        found = np.minimum(np.searchsorted(m.lexicon, w.hash), len(m.lexicon) - 1)
        hit = m.lexicon[found] == w.hash
        score[hit] += m.lexical[found[hit]]
    score[~w.letters] = 0
    return score


def marginals(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of the words' labels."""
    return forward_backward(emit, first, moves)[0]


def forward_backward(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, forward and backward messages of all texts at once, in step; texts that are over fall out of the arrays.  A message is
    scaled to sum 1; the forward one holds its own word's emission, the backward one doesn't."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], first[:-1][order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # texts longer than t
    power = np.exp(emit - emit.max(1, keepdims=True)) if len(emit) else emit
    trans = np.exp(moves)
    ahead = np.empty_like(emit)
    state = None
    for t in range(steps):
        at = start[: live[t]] + t
        state = power[at] if state is None else (state[: live[t]] @ trans) * power[at]
        state /= state.sum(1, keepdims=True)
        ahead[at] = state
    back = np.ones((0, emit.shape[1]))
    out, behind = np.empty_like(emit), np.empty_like(emit)
    for t in range(steps - 1, -1, -1):
        at = start[: live[t]] + t
        if len(back) < live[t]:
            back = np.vstack([back, np.ones((live[t] - len(back), emit.shape[1]))])
        behind[at] = back
        both = ahead[at] * back
        out[at] = both / both.sum(1, keepdims=True)
        back = (back * power[at]) @ trans.T
        back /= back.sum(1, keepdims=True)
    return out, ahead, behind


def pair_marginals(emit: np.ndarray, ahead: np.ndarray, behind: np.ndarray, moves: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Marginals of the labels of the words before `inner` and at it: (words, label before, label)."""
    here = np.exp(emit[inner] - emit[inner].max(1, keepdims=True)) * behind[inner]
    pair = ahead[inner - 1][:, :, None] * np.exp(moves)[None] * here[:, None, :]
    return pair / pair.sum((1, 2), keepdims=True)


def train(texts: list[str], labels: list[str], *, lexicon: int = 20_000, epochs: int = 4, piece: int = 12, chain: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Model:
    """AdaGrad on the log-likelihood of chains made of pieces of `piece` words, `chain` pieces each, drawn in random order."""
    languages = sorted(set(labels))
    n = len(languages)
    known = features(pa.array(texts, pa.string()))
    words, first = known.hash, known.first
    label = np.repeat([languages.index(x) for x in labels], np.diff(first)) if texts else np.zeros(0, int)
    seen, inverse, count = np.unique(words, return_inverse=True, return_counts=True)
    top = np.sort(np.argsort(-count, kind="stable")[:lexicon][count[np.argsort(-count, kind="stable")[:lexicon]] > 1])
    m = Model(languages, np.zeros((TABLE, n), np.float32), seen[top], np.zeros((len(top), n), np.float32), np.zeros((n, n)))
    lexical = np.full(len(seen), -1)
    lexical[top] = np.arange(len(top))
    lexical = lexical[inverse]
    pieces = [(a, min(a + piece, e)) for s, e in zip(first[:-1], first[1:], strict=True) for a in range(s, e, piece)]
    rng = np.random.default_rng(seed)
    sums = [np.full_like(x, 1e-3) for x in (m.grams, m.lexical, m.moves)]
    for _ in range(epochs if n > 1 else 0):
        # Each language takes an equal share of the pieces.
        by = [np.flatnonzero([label[a] == k for a, _ in pieces]) for k in range(n)]
        most = max(map(len, by))
        draw = rng.permutation(np.concatenate([rng.choice(b, most) for b in by]))
        for batch in np.array_split(draw, max(1, len(draw) // (chain * 64))):
            use = [np.arange(*pieces[k]) for k in batch]
            pick = np.concatenate(use)
            cut = np.cumsum([0, *[sum(map(len, use[k : k + chain])) for k in range(0, len(use), chain)]])
            own = known.take(pick)
            emit = emissions(m, own)
            p, ahead, behind = forward_backward(emit, cut, m.moves)
            gold = np.eye(n)[label[pick]]
            g = (gold - p) * own.letters[:, None]
            per = np.repeat(np.arange(len(pick)), np.diff(own.at))
            places = [*((c, per) for c in own.grams), *((c, np.arange(len(pick))) for c in own.affixes)]
            g_grams = np.stack([sum(np.bincount(c, g[i, k], TABLE + 1) for c, i in places) for k in range(n)], 1)
            g_lex = np.zeros_like(m.lexical, dtype=np.float64)
            listed = lexical[pick] >= 0
            np.add.at(g_lex, lexical[pick][listed], g[listed])
            inner = np.setdiff1d(np.arange(1, len(pick)), cut)
            g_move = gold[inner - 1].T @ gold[inner] - pair_marginals(emit, ahead, behind, m.moves, inner).sum(0)
            for w, s, grad in ((m.grams, sums[0], g_grams[:TABLE]), (m.lexical, sums[1], g_lex), (m.moves, sums[2], g_move / 10)):
                grad = grad / len(batch) - decay * w
                s += grad * grad
                w += rate * grad / np.sqrt(s)
    return m


def sample(labelled: DataFrame, per_language: int, most_chars: int) -> tuple[list[str], list[str]]:
    """Texts and labels to learn from: of each language the `per_language` smallest hashes of id and text.

    Two passes, whatever the number of languages: one estimates how many different rows each has, one takes the rows below the hash that so many
    lie under with a margin.  About 1.2 * per_language + 60 texts of each language reach the driver, of a longer text most_chars characters from a
    place that its hash names.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    over = F.greatest(F.length("text") - most_chars, F.lit(0)) + 1
    cut = F.substring(F.col("text"), (F.pmod("h", over) + 1).cast("int"), F.lit(most_chars))
    wanted = F.lit(False)
    for lang, n in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect():
        share = (1.2 * per_language + 60) / max(n, 1)
        wanted |= (F.col("lang") == lang) & (F.lit(True) if share >= 1 else F.col("h") < int(share * 2**64) - 2**63)
    # Repeated rows collapse before they are sent.
    got = sorted(known.filter(wanted).select("lang", "h", cut.alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["lang"], r["h"]))
    kept = [r for k, r in enumerate(got) if k < per_language or got[k - per_language]["lang"] != r["lang"]]
    return [r["text"] for r in kept], [r["lang"] for r in kept]


def fit(labelled: DataFrame, *, per_language: int = 250, most_chars: int = 4000, **options) -> Model:
    """labelled: doc_id, text, lang."""
    return train(*sample(labelled, per_language, most_chars), **options)


def label_words(m: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all words, the first word of each text, and which words have a letter."""
    w = features(text)
    return marginals(emissions(m, w), w.first, m.moves.astype(np.float32)), w.first, w.letters


def identify(df: DataFrame, m: Model, *, text: str = "text", lang: str = "lang_pred", score: str = "score", told: str = "told") -> DataFrame:
    """df with the language of each text, its score (the language's mean share of the words), and how well its words are told apart
    (the mean of each word's own largest share, high for text in several languages too)."""
    df = df.drop(lang, score, told)
    schema = T.StructType([*df.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(told, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for part in slices(batches, text, SLICE):
            column = part.column(part.schema.get_field_index(text))
            known = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, value, apart = np.full(part.num_rows, -1), np.zeros(part.num_rows), np.zeros(part.num_rows)
            if m.languages:
                p, first, letters = label_words(m, column)
                which = positions(first)[letters]
                total = np.stack([np.bincount(which, p[letters, k], part.num_rows) for k in range(len(m.languages))], 1)
                words = np.bincount(which, minlength=part.num_rows)
                known &= words > 0
                best[known] = total[known].argmax(1)
                value[known] = np.minimum(total[known].max(1) / words[known], 1)
                apart[known] = np.minimum(np.bincount(which, p[letters].max(1), part.num_rows)[known] / words[known], 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(value), pa.array(apart)], names=[*part.schema.names, lang, score, told])

    return df.mapInArrow(run, schema)
