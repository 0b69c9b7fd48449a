"""Operator 3: a quality classifier on learned subword embeddings.

Features of a text are its words, the character n-grams of each word with its edges marked, and a sign
for each word that repeats the one before. A feature is hashed to a row of an embedding table; a
document's vector is the mean of its features' rows, weighted by their counts; a softmax layer gives the
class probabilities. Table and layer are trained together by stochastic gradient descent in numpy, on
at most ``most`` labels: those with the least hashes of id and label, a bounded sample that doesn't depend
on partitions; of ids that several rows have, at most as many rows are read as labels. Averaging and the layer's first product are linear, so a scorer remembers each
word's summed logits instead of its rows.

Scoring covers whole texts. A null or empty text has no features and gets the layer's bias alone, a
score between 0 and 1; repeated rows get the same score; an empty table gives an empty result; without
labelled rows every score is 0.5. Labels with null ids or null quality are not used; with several labels
for one id each is a training row. Nothing but the text enters a score.
"""

from __future__ import annotations

import operator
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfield.llm.words import Words, slabs, text_of, words_of
from sigfield.runtime import ship

BUCKETS, DIM = 1 << 16, 8
SIZES = (2, 3, 4)  # of character n-grams
REPEAT = 0  # the bucket of "same word as before"
WORDS = 400_000  # whose logits a Python worker remembers
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_features(word: str) -> list[int]:
    """Buckets of a word and its distinct character n-grams."""
    marked = f"<{word}>".encode()
    grams = {marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1)}
    return [1 + zlib.crc32(marked) % (BUCKETS - 1), *(1 + zlib.crc32(g, 77) % (BUCKETS - 1) for g in grams)]


def repeats(words: list[str]) -> int:
    return sum(map(operator.eq, words, words[1:]))


def text_counts(text: str) -> Counter:
    """How often a text has each bucket."""
    words, total = WORD.findall(text), Counter()
    for w, n in Counter(words).items():
        for f in word_features(w):
            total[f] += n
    if r := repeats(words):
        total[REPEAT] += r * 10  # about as much as the n-grams of a word
    return total


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    total = text_counts(text)
    keys = np.fromiter(total.keys(), np.int64, len(total))
    values = np.fromiter(total.values(), np.float64, len(total))
    return keys, values / max(1.0, values.sum())


@dataclass
class Model:
    """logit[b]: what bucket b's embedding adds to the logit of class 1 over class 0; bias."""

    logit: np.ndarray
    bias: float

    def equals(self, other: Model) -> bool:
        return self.bias == other.bias and np.array_equal(self.logit, other.logit)

    def score(self, text: str) -> float:
        keys, shares = text_features(text)
        return float(1 / (1 + np.exp(-(self.bias + shares @ self.logit[keys]))))


@cache
def _crc_table() -> np.ndarray:
    """The steps of zlib's CRC-32 for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def summed_features(logit: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of logits and number of the features (see ``word_features``) of each word data[start:end], all at once."""
    size = end - start + 2
    last = np.cumsum(size)
    begin, word = last - size, np.repeat(np.arange(len(size)), size)
    at = np.arange(last[-1])
    inner = at - begin[word] - 1
    marked = data[np.clip(start[word] + inner, 0, len(data) - 1)]
    marked[begin], marked[last - 1] = ord("<"), ord(">")
    keys = []
    for n in SIZES:
        here = at[at + n <= last[word]]
        code = sum(marked[here + k].astype(np.int64) << (8 * k) for k in range(n))
        keys.append((word[here] << 34) | ((n - 2) << 32) | code)
    grams = np.sort(np.concatenate(keys))
    grams = grams[np.concatenate([[True], grams[1:] != grams[:-1]])]  # a word has each one once
    owner, long, code = grams >> 34, ((grams >> 32) & 3) + 2, (grams & 0xFFFFFFFF).astype(np.uint32)
    table, crc = _crc_table(), np.full(len(grams), 77 ^ 0xFFFFFFFF, np.uint32)
    for k in range(max(SIZES)):
        step = table[(crc ^ (code >> np.uint32(8 * k))) & 255] ^ (crc >> np.uint32(8))
        crc = np.where(long > k, step, crc)
    bucket = 1 + (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % (BUCKETS - 1)
    raw = marked.tobytes()
    whole = 1 + np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), last.tolist())), np.int64, len(size)) % (BUCKETS - 1)
    total = np.bincount(owner, weights=logit[bucket], minlength=len(size)) + logit[whole]
    return total, np.bincount(owner, minlength=len(size)).astype(np.int64) + 1


class Scorer:
    """Logits of whole Arrow arrays: words are told apart by their hashes, and each distinct word of a slab is looked up
    once, or worked out if the worker has not met it."""

    def __init__(self, model: Model):
        self.model, self.place, self.total, self.size = model, {}, array("d"), array("q")

    def _look_up(self, hashes: np.ndarray, words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of logits and number of features of distinct words; ``first`` is where each one occurs."""
        if len(self.place) + len(hashes) > WORDS:
            self.place, self.total, self.size = {}, array("d"), array("q")
        keys = hashes.tolist()
        fresh = np.fromiter((k not in self.place for k in keys), bool, len(keys))
        if fresh.any():
            self.place |= zip(hashes[fresh].tolist(), range(len(self.total), len(self.total) + int(fresh.sum())))
            total, size = summed_features(self.model.logit, words.data, words.start[first[fresh]], words.end[first[fresh]])
            self.total.frombytes(total.tobytes())
            self.size.frombytes(size.tobytes())
        at = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))
        return np.array(self.total)[at], np.array(self.size)[at]

    def logits(self, texts: pa.Array) -> np.ndarray:
        w = words_of(texts)
        z = np.full(len(texts), self.model.bias)
        if not len(w.hash):
            return z
        hashes, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        total, size = self._look_up(hashes, w, first)
        same = np.zeros(len(w.hash), bool)  # whether the next word of the text is the same
        same[:-1] = w.hash[1:] == w.hash[:-1]
        some = w.counts() > 0
        same[w.first[1:][some] - 1] = False
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[w.first])
        again = 10 * sums(same.astype(np.int64))
        n = sums(size[inverse]) + again
        z[some] += (sums(total[inverse])[some] + again[some] * self.model.logit[REPEAT]) / n[some]
        return z


_SCORERS: list[tuple[Model, Scorer]] = []


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of the model, kept from task to task."""
    if not _SCORERS or _SCORERS[0][0] is not model and not _SCORERS[0][0].equals(model):
        _SCORERS[:] = [(model, Scorer(model))]
    return _SCORERS[0][1]


def train(rows: list[tuple[str, int]], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit embeddings and softmax layer by SGD, one document at a time in a shuffled order. The rows' buckets and counts lie
    one after another in two arrays of 2 and 4 bytes an entry."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    buckets, counts, ends = array("H"), array("I"), [0]
    for t, _ in rows:
        total = text_counts(t)
        buckets.extend(total.keys())
        counts.extend(total.values())
        ends.append(len(buckets))
    buckets, counts = np.array(buckets, np.uint16), np.array(counts, np.uint32)
    if rows:
        share = min(max(np.mean([y for _, y in rows]), 0.01), 0.99)
        bias[1] = np.log(share / (1 - share))
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            keys, values, y = buckets[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]].astype(np.float64), rows[i][1]
            shares = values / max(1.0, values.sum())
            lr = rate * (1 - step / steps)
            step += 1
            mean = shares @ table[keys]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= 0.05 * lr * p
            table[keys] -= lr * len(keys) ** 0.5 * np.outer(shares, back)
    return Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, most: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on at most ``most`` of the labelled rows for which ``use``, a condition on the id, holds."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if use is not None:
        marks = marks.where(use)
    marks = marks.withColumn("h", F.xxhash64("id", "y")).orderBy("h", "id", "y").limit(most)
    found = texts.join(F.broadcast(marks), "id").select("h", "y", "text").orderBy("h", "y", F.xxhash64("text")).limit(most)  # at most ``most`` marks are broadcast
    rows = found.select("text", "y").collect()
    return train(sorted((r.text, r.y) for r in rows))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the id column, those named in ``keep``, and ``score``, the probability of class 1."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # of fixed size
    columns = list(dict.fromkeys([id_col, *(keep or [])]))
    name = "text_to_score"
    while name in columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for b in batches:
            for t in slabs(b, name):
                scores = 1 / (1 + np.exp(-scorer.logits(text_of(t, name))))
                yield pa.RecordBatch.from_arrays([text_of(t, c) for c in columns] + [pa.array(scores)], [*columns, "score"])

    kept = docs.select(*columns, F.col(text_col).cast("string").alias(name))
    fields = [kept.schema[c] for c in columns]
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))
