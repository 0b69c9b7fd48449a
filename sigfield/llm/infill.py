"""Operator 12: fill-in-the-middle transformation with rank and select over boundary bitvectors.

A text is cut into units: a run of white space (0x20, 0x09-0x0D) with the run of other characters after it,
or white space at the end of the text. The last byte of each unit is a 1 in a packed bitvector over the bytes
of many texts; a directory holds the number of ones before each block of 512 bits. The total popcount of a
text is its number of units n, and the byte after the one of rank r is found by a search of the directory and
of one block's words, so neither cut reads the text again.

Two hashes of the row's id give the ranks of the cuts, two more the form: ``plain`` (the text itself), ``psm``
(prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part behind its marker. A text that holds a
marker stays plain, so that every output can be undone exactly by ``restore``.

A null text counts as empty; an empty text is plain with n = 0. A null id is hashed as the empty string.
Repeated rows are transformed each; an empty table gives an empty result; other columns are not read. Texts of
any length are cut whole, one slab of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfield.llm.words import slabs, text_of
from sigfield.runtime import ship

MARKERS = ("<P>", "<S>", "<M>")
BLOCK = 8  # 64-bit words of a directory block

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class BitVector:
    """A packed bitvector with the number of ones before each block."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = -(-max(self.size, 1) // (64 * BLOCK)) * 64 * BLOCK
        packed = np.zeros(padded // 8, np.uint8)
        packed[: -(-self.size // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words.reshape(-1, BLOCK)).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        at = np.asarray(at, np.int64)
        word = np.minimum(at >> 6, len(self.words) - 1)
        block = word // BLOCK
        lanes = block[:, None] * BLOCK + np.arange(BLOCK)
        whole = np.where(lanes < word[:, None], np.bitwise_count(self.words[lanes]), 0).sum(axis=1, dtype=np.int64)
        below = at - (word << 6)
        mask = np.where(below >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(below, 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(self.words[word] & mask)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Positions of the ones with the given ranks, counted from 0."""
        ranks = np.asarray(ranks, np.int64)
        if not len(ranks):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.before, ranks, side="right") - 1
        left = ranks - self.before[block]
        lanes = self.words.reshape(-1, BLOCK)[block]
        sums = np.cumsum(np.bitwise_count(lanes), axis=1, dtype=np.int64)
        lane = (sums <= left[:, None]).sum(axis=1)
        rows = np.arange(len(ranks))
        left -= np.where(lane > 0, sums[rows, lane - 1], 0)
        word = lanes[rows, lane]
        at = np.zeros(len(ranks), np.int64)
        for wide in (32, 16, 8, 4, 2, 1):  # halve the word: skip the low half where it holds too few ones
            low = (word >> at.astype(np.uint64)) & np.uint64((1 << wide) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            skip = n <= left
            left -= np.where(skip, n, 0)
            at += np.where(skip, wide, 0)
        return ((block * BLOCK + lane) << 6) + at


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True at the last byte of each unit; ``offsets`` delimit the texts in ``data``."""
    if not len(data):
        return np.zeros(0, bool)
    solid = ~_SPACE[data]
    last = np.zeros(len(data), bool)
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = True
    out = last.copy()
    out[:-1] |= solid[:-1] & ~solid[1:]
    return out


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def _points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    return BitVector((data & 0xC0) != 0x80).rank(at)


def _digits(seed: int, id_col: str, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain) and
    ``output``. ``percent`` of the rows are cut, ``spm_percent`` of these in the form spm."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | text.contains(m)
    hashed = docs.select(F.col(id_col).alias("id"), text.alias("text"), (marked | (F.length(text) == 0)).alias("whole"), *(_digits(seed, id_col, k).alias(f"h{k + 1}") for k in range(4)))
    form = F.when(F.col("whole") | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = hashed.select("id", "text", form.alias("form"), "h1", "h2")
    p, s, m = (x.encode() for x in MARKERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slabs(batch):
                data, offs = _bytes_of(text_of(t))
                bits = BitVector(boundaries(data, offs))
                ranks = bits.rank(offs)
                first, n = ranks[:-1], np.diff(ranks)
                forms = np.array(text_of(t, "form").to_pylist())
                cut = np.sort(np.stack([np.asarray(text_of(t, h)) % (n + 1) for h in ("h1", "h2")]), axis=0)
                ends = [offs[:-1].copy() for _ in cut]
                for k, c in enumerate(cut):
                    some = c > 0
                    ends[k][some] = bits.select(first[some] + c[some] - 1) + 1
                chars = [_points(data, x) for x in (offs[:-1], *ends)]
                raw = data.tobytes()
                output = []
                for f, a, b, c, d in zip(forms, offs[:-1], ends[0], ends[1], offs[1:]):
                    if f == "plain":
                        output.append(raw[a:d])
                    elif f == "psm":
                        output.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                    else:
                        output.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                plain = forms == "plain"
                yield pa.RecordBatch.from_arrays(
                    [text_of(t, "id"), pa.array(n, pa.int64()), pa.array(forms.tolist(), pa.string()), pa.array(chars[1] - chars[0], pa.int64(), mask=plain), pa.array(chars[2] - chars[1], pa.int64(), mask=plain), pa.array(output, pa.binary()).cast(pa.string())],
                    [id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = T.StructField(id_col, docs.schema[id_col].dataType)
    longs = [T.StructField(x, T.LongType()) for x in ("n", "prefix_chars", "middle_chars")]
    return rows.mapInArrow(run, T.StructType([kind, longs[0], T.StructField("form", T.StringType()), *longs[1:], T.StructField("output", T.StringType())]))


def restore(output: Column, form: Column) -> Column:
    """The text from which ``fill_in_middle`` made the output."""
    parts = F.split(output, "|".join(MARKERS), -1)  # an empty string, then the parts in the form's order
    get = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(get(1), get(3), get(2))).otherwise(F.concat(get(2), get(3), get(1)))
