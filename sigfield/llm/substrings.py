"""Operator 4: removal of repeated word windows behind a count-min prefilter.

Documents are dealt into blocks of about ``block_bytes`` of text by a hash of their id. For the first
pass each block sends, to each of 2**s shards of the hash space, the sorted distinct 32-bit keys of its
windows, delta coded: a sparse partition sketch of about two bytes a window. A shard merges what the
blocks sent into one count-min sketch (two rows of counters that saturate at two) and answers each
block with one bit a key: whether the estimate is two or more. Counters are never less than the true
count, so no repeated window is lost; the number of shards follows the input, so a sketch's load doesn't
grow with it. In the second pass blocks send only windows so marked, as 104-bit fingerprints with the
least id that has them; shards group them exactly and answer one bit: whether a smaller id has it
elsewhere. No window leaves its block otherwise, and a window that very many documents share
costs one entry a block.

Words are runs of characters other than 0x20 and 0x09-0x0D, unchanged. Null and empty texts have no
words. Documents with fewer words than a window lose none. A null id counts as larger than any other.
Repeated ids don't make each other's words repeat. Empty tables give empty results; other columns are
not read; texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigfield.llm.packs import pack, pack_sorted, unpack, unpack_sorted
from sigfield.llm.words import U, slabs, text_of, words_of
from sigfield.runtime import ship

WIDTH = 1 << 24  # counters in each of a shard's two sketch rows
LAST = np.iinfo(np.int64).max


class Block:
    """The windows of a block's documents, in the order of its rows."""

    def __init__(self, table: pa.Table, k: int, bits: int, second: bool = True):
        self.table, self.k, self.bits = table, k, bits
        h0, h1, doc = [], [], []
        ids = np.asarray(table["id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False), np.int64)
        at = 0
        for t in slabs(table):
            w = words_of(text_of(t))
            x, bounds = w.windows(k)
            h0.append(x)
            if second:
                h1.append(w.windows(k, 1)[0] >> U(24))
            doc.append(np.repeat(ids[at : at + t.num_rows], np.diff(bounds)))
            at += t.num_rows
        self.h0, self.doc = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((h0, U), (doc, np.int64)))
        self.h1 = np.concatenate(h1) if h1 else np.zeros(0, U)
        self.keys, self.of_key, self.n = np.unique(self.h0 >> U(32 - bits), return_inverse=True, return_counts=True)
        self.cuts = np.searchsorted(self.keys, np.arange((1 << bits) + 1, dtype=U) << U(32)) if bits < 32 else None

    def first_requests(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(shard, keys, which of them occur twice here)."""
        for shard in np.flatnonzero(np.diff(self.cuts)):
            a, b = self.cuts[shard], self.cuts[shard + 1]
            yield int(shard), pack_sorted((self.keys[a:b] & U(0xFFFFFFFF)).astype(np.uint32)), np.packbits(self.n[a:b] > 1).tobytes()

    def mark(self, answers: dict[int, bytes]) -> None:
        """Keep the windows whose keys the sketches estimate repeated; group them by fingerprint."""
        good = np.zeros(len(self.keys), bool)
        for shard, bits in answers.items():
            a, b = self.cuts[shard], self.cuts[shard + 1]
            good[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        self.at = np.flatnonzero(good[self.of_key])
        x, y, d = self.h0[self.at], self.h1[self.at], self.doc[self.at]
        order = np.lexsort((d, y, x))
        x, y, d = x[order], y[order], d[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        self.x, self.y, self.least = x[new], y[new], d[new]
        self.group = np.empty(len(x), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.cuts2 = np.searchsorted(self.x, np.arange(1, 1 << self.bits, dtype=U) << U(64 - self.bits)) if self.bits else np.zeros(0, np.int64)
        self.cuts2 = np.concatenate([[0], self.cuts2, [len(self.x)]])

    def second_requests(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(shard, fingerprints, least ids)."""
        for shard in np.flatnonzero(np.diff(self.cuts2)):
            a, b = self.cuts2[shard], self.cuts2[shard + 1]
            tail = np.ascontiguousarray(self.y[a:b].view(np.uint8).reshape(-1, 8)[:, :5])
            yield int(shard), pack_sorted(self.x[a:b]) + tail.tobytes(), pack(self.least[a:b])

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Per window whether its sequence starts in a document with a smaller id."""
        smaller = np.zeros(len(self.x), bool)
        for shard, bits in answers.items():
            a, b = self.cuts2[shard], self.cuts2[shard + 1]
            smaller[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        out = np.zeros(len(self.h0), bool)
        out[self.at] = smaller[self.group] | (self.doc[self.at] > self.least[self.group])
        return out

    def kept(self, removed: np.ndarray) -> pa.Table:
        """Rows of the block with the words that no removed window covers."""
        n_words, n_removed, kept, at = [], [], [], 0
        for t in slabs(self.table):
            texts = text_of(t)
            w = words_of(texts)
            counts = w.counts()
            inside = np.maximum(counts - (self.k - 1), 0)
            total = int(inside.sum())
            gone = np.flatnonzero(removed[at : at + total])
            at += total
            step = np.zeros(len(w.hash) + 1, np.int32)
            if len(gone):
                skipped = w.first[:-1] - (np.cumsum(inside) - inside)  # from a window's place to its first word's
                start = gone + np.repeat(skipped, inside)[gone]
                np.add.at(step, start, 1)
                np.add.at(step, start + self.k, -1)
            keep = np.cumsum(step[:-1]) == 0
            lost = np.concatenate([[0], np.cumsum(~keep)])
            for i, text in enumerate(texts.to_pylist()):
                a, b = w.first[i], w.first[i + 1]
                words = (text or "").encode().split()
                kept.append((b" ".join(compress(words, keep[a:b].tolist())) if lost[b] > lost[a] else b" ".join(words)).decode())
                n_removed.append(int(lost[b] - lost[a]))
            n_words += counts.tolist()
        return pa.table({"id": self.table["id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})


def merge_sketches(table: pa.Table) -> pa.Table:
    """One shard's count-min sketch from all blocks' keys, and its answer to each block."""
    rows = (np.zeros(WIDTH, np.uint8), np.zeros(WIDTH, np.uint8))

    def cells(payload: bytes) -> tuple[np.ndarray, ...]:
        key = unpack_sorted(payload, np.uint32)
        return tuple(((key * np.uint32(odd)) >> np.uint32(8)) for odd in (2654435761, 2246822519))

    for payload, twice in zip(table["a"], table["b"]):
        at = cells(payload.as_buffer())
        often = np.unpackbits(np.frombuffer(twice.as_buffer(), np.uint8), count=len(at[0])).astype(bool)
        for row, cell in zip(rows, at):
            row[cell] = np.minimum(row[cell] + 1, 2)  # keys of one block that share a cell count once: each is there once
            row[cell[often]] = 2
    bits = [np.packbits((rows[0][(at := cells(p.as_buffer()))[0]] > 1) & (rows[1][at[1]] > 1)).tobytes() for p in table["a"]]
    return pa.table({"block": table["block"], "stage": pa.array([1] * len(bits), pa.int32()), "shard": table["shard"], "bits": pa.array(bits, pa.binary())})


def group_exactly(table: pa.Table) -> pa.Table:
    """One shard's fingerprints from all blocks; each block learns which have a smaller id elsewhere."""
    xs, ys, ds = [], [], []
    for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist()):
        d = unpack(b, np.int64)
        tail = np.zeros((len(d), 8), np.uint8)
        tail[:, :5] = np.frombuffer(a, np.uint8)[len(a) - 5 * len(d) :].reshape(-1, 5)
        xs.append(unpack_sorted(a[: len(a) - 5 * len(d)], U))
        ys.append(tail.view(U).ravel())
        ds.append(d)
    x, y, d = map(np.concatenate, (xs, ys, ds))
    order = np.lexsort((d, y, x))
    x, y, s = x[order], y[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    least = s[np.flatnonzero(new)][np.cumsum(new) - 1]
    smaller = np.empty(len(x), bool)
    smaller[order] = least < s
    ends = np.cumsum([len(v) for v in ds])
    bits = [np.packbits(v).tobytes() for v in np.split(smaller, ends[:-1])]
    return pa.table({"block": table["block"], "stage": pa.array([2] * len(bits), pa.int32()), "shard": table["shard"], "bits": pa.array(bits, pa.binary())})


REQUEST = "block int, shard int, a binary, b binary"
ANSWER = "block int, stage int, shard int, bits binary"


def remove_repeats(docs: DataFrame, k: int = 13, block_bytes: int = 6 << 20, shard_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, ``n_words``, ``n_removed`` and ``kept``, the kept words joined by spaces."""
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, bits = math.ceil((size + 1) / block_bytes), max(0, math.ceil(math.log2((size + 1) / shard_bytes)))
    # an id keeps its block; a null one is dealt by its text
    block = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(blocks)).cast("int")
    rows = kept.withColumn("block", block).repartition(blocks, "block")

    def sort(t: pa.Table) -> pa.Table:
        return t.sort_by([("id", "ascending"), ("text", "ascending")])

    def requests(block: int, made: Iterator[tuple[int, bytes, bytes]]) -> pa.Table:
        made = list(made)
        return pa.table({"block": pa.array([block] * len(made), pa.int32()), "shard": pa.array([m[0] for m in made], pa.int32()), "a": pa.array([m[1] for m in made], pa.binary()), "b": pa.array([m[2] for m in made], pa.binary())})

    def answers(t: pa.Table, stage: int) -> dict[int, bytes]:
        return {s: b for g, s, b in zip(t["stage"].to_pylist(), t["shard"].to_pylist(), t["bits"].to_pylist()) if g == stage}

    def first(t: pa.Table) -> pa.Table:
        return requests(t["block"][0].as_py(), Block(sort(t), k, bits, second=False).first_requests())

    def second(t: pa.Table, said: pa.Table) -> pa.Table:
        b = Block(sort(t), k, bits)
        b.mark(answers(said, 1))
        return requests(t["block"][0].as_py() if t.num_rows else 0, b.second_requests())

    def last(t: pa.Table, said: pa.Table) -> pa.Table:
        b = Block(sort(t), k, bits)
        b.mark(answers(said, 1))
        return b.kept(b.removed(answers(said, 2)))

    one = rows.groupBy("block").applyInArrow(first, REQUEST).groupBy("shard").applyInArrow(merge_sketches, ANSWER)
    two = rows.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(second, REQUEST).groupBy("shard").applyInArrow(group_exactly, ANSWER)
    out = rows.groupBy("block").cogroup(one.union(two).groupBy("block")).applyInArrow(last, "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept")
