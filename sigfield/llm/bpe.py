"""Operator 2: BPE encoding and decoding with a contiguous rank array.

``Bpe`` reads a tokenizer file of the word-end kind (byte alphabet, ``</w>`` on the last symbol of a
pre-token, lower-cased NFC text). Latin pieces are lower-cased and cut here; any others are normalised and
cut as the file says by the tokenizers library, whose Unicode tables may be newer. A short pre-token is held as one list of part ids and one list of
the ranks of neighbouring parts: the least rank is found by a scan, its boundary is deleted and the
ranks on either side are refreshed. Long pre-tokens take a heap, whose result is the same, so that no
text makes the work quadratic.

Nulls, empty and long texts, repeated rows: a null text counts as empty and gives no ids; each row
is encoded by itself, so repeated rows repeat; an empty table gives an empty result; columns other
than the id and the text are never read.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sigfield.runtime import ship

SHORT = 96  # symbols up to which the rank array is scanned
NONE = sys.maxsize
CACHE = 250_000  # pieces that a Python worker remembers

# fixed values: the pre-token pattern that the tokenizer file names
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


class Memo(dict):
    """Remembers a function of short texts; emptied when it holds CACHE of them."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key: str):
        out = self.function(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[key] = out
        return out


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        alphabet = byte_alphabet()
        self.inner = [vocab[alphabet[b]] for b in range(256)]
        self.final = [vocab[alphabet[b] + suffix] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.made.append(vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.vocab, self.suffix, self.alphabet = vocab, suffix, alphabet
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._pattern = regex.compile(PATTERN, regex.V0)
        self._latin = re.compile("[\x00-\u024f]*")  # code points that no composition and no new table touches
        self._byte = {c: b for b, c in alphabet.items()}
        self._path = path
        self._odd = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer doesn't
        self.cache = Memo(self.piece)

    @cached_property
    def _library(self) -> Tokenizer:
        return Tokenizer.from_file(self._path)  # only workers that meet such a piece hold it

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to one pre-token's symbols."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, made = self.rank.get, self.made
        parts = ids
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], NONE)
        return parts

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank, part = self.rank.get, list(ids)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := rank(a << 20 | b, NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := rank(part[x] << 20 | part[y], NONE)) != NONE:
                    heapq.heappush(heap, (s, x, part[x], part[y]))
        return [x for x in part if x >= 0]

    def pre_tokens(self, piece: str) -> list[str]:
        """Normalised pre-tokens of text without special strings."""
        if self._latin.fullmatch(piece):
            return self._pattern.findall(piece.lower())
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(piece))
        return [bytes(map(self._byte.__getitem__, t)).decode() for t, _ in found]

    def symbols(self, token: str) -> list[int]:
        raw = token.encode()
        out = [self.inner[b] for b in raw]
        out[-1] = self.final[raw[-1]]
        return out

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a text without outer white space, unremembered."""
        out: list[int] = []
        for k, part in enumerate(self._special.split(piece) if "<|" in piece else (piece,)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                for t in self.pre_tokens(part):
                    out += self.merge(self.symbols(t))
        return tuple(out)

    def pieces(self, text: str) -> list[str]:
        """Parts of the text that encode independently: no pre-token, special string or composition
        reaches across white space."""
        return [text] if self._odd.search(text) else text.split()

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.cache.__getitem__, self.pieces(text))))

    def decode(self, ids) -> str:
        """Token strings joined by spaces: the tokenizer file names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids])


_LOADED: dict[tuple, object] = {}


def loaded(kind, path: str):
    """``kind(path)``, once per Python worker."""
    key = (kind.__name__, path)
    if key not in _LOADED:
        _LOADED[key] = kind(path)
    return _LOADED[key]


def list_array(rows: list[array]) -> pa.ListArray:
    """An Arrow list<int32> column from int arrays."""
    flat, offsets = array("i"), array("i", [0])
    for r in rows:
        flat.extend(r)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that lists of ids stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, ``ids`` array<int> and ``decoded`` string, over whole texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(Bpe, path)
        for b in small_batches(batches):
            rows = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(rows), pa.array([bpe.decode(r) for r in rows], pa.string())], [id_col, "ids", "decoded"])

    kept = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([kept.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return kept.mapInArrow(run, schema)
