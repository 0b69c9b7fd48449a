"""Operator 1: token ids in Parquet files.

Documents are dealt by ranges of their id, sorted, encoded and written one file to a range, so file
order is id order. A row holds the id, the number of tokens, the file's number (``shard``), the tokens
of the file before this document (``shard_start``) and the ids. Ids keep a dictionary (a vocabulary
fits one dictionary page, so an id takes its bit width); the growing columns are delta encoded; row
groups and pages have a set size and page indexes, so metadata is read without the ids and a range of
documents without the rest of its file. A document's place in the whole corpus is ``shard_start`` plus
the totals of the files before, one row to a file.

A null text counts as empty and gets the end id alone; a null id sorts first; rows with the same id are
ordered by their text, repeated rows are all written; an empty table gives no rows; other columns are
not read. A text of any length is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfield.llm.bpe import loaded, small_batches
from sigfield.llm.words import slabs, text_of
from sigfield.runtime import ship

FRESH = 2048  # texts given to the library at once, whose results are larger than their ids
TOGETHER = 32  # words of one pre-token each that are given as one text
SLAB = 16 << 20  # bytes of text whose pieces are encoded together
# Latin letters, whose lower-case forms are plain, and marks after them: a pre-token each
SIMPLE = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:;=?@\[-`{}~]*)$"


class Encoder:
    """The tokenizers library, asked once in a slab of texts for each distinct piece.

    Pieces lie between ASCII white space: normalisation, special strings and pre-tokens of the word-end
    tokenizer never reach across it, so a text's ids are those of its pieces in order. Of a simple piece
    the letters, in lower case, and the marks are asked for apart; since the last token of a pre-token,
    and no other, bears the word-end mark, words can be asked for many to a text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        special = {i: x.content for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        if not suffix or any(re.fullmatch(SIMPLE, x) for x in special.values()):
            raise ValueError(f"not a word-end tokenizer: {path}")
        self.last = np.zeros(max([*vocab.values(), *special]) + 1, bool)
        self.last[[i for x, i in vocab.items() if x.endswith(suffix) and i not in special]] = True

    def _ask(self, texts: list[str]) -> Iterator[array]:
        for at in range(0, len(texts), FRESH):
            for x in self.tokenizer.encode_batch_fast(texts[at : at + FRESH], add_special_tokens=False):
                yield array("i", x.ids)

    def ask(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, each by itself, and how many each has."""
        rows = list(self._ask(texts.to_pylist()))
        return np.frombuffer(b"".join(rows), np.int32), np.fromiter(map(len, rows), np.int64, len(rows))

    def ask_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are one pre-token each."""
        offsets = np.append(np.arange(0, len(words), TOGETHER), len(words)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ")
        ids = np.frombuffer(b"".join(self._ask(lines.to_pylist())), np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word of letters is not one pre-token of this tokenizer")
        return ids, np.diff(ends, prepend=0)

    def pieces(self, pieces: pa.Array) -> pa.ListArray:
        """Ids of each piece."""
        parts = pc.extract_regex(pieces, SIMPLE)
        simple = parts.is_valid()
        word, marks = (pc.struct_field(parts.filter(simple), name) for name in ("word", "marks"))
        word, marks = pc.utf8_lower(word).dictionary_encode(), marks.dictionary_encode()
        odd = pieces.filter(pc.invert(simple))
        asked = [self.ask_words(word.dictionary), self.ask(marks.dictionary), self.ask(odd)]
        known = _lists(np.concatenate([x for x, _ in asked]), np.concatenate([n for _, n in asked] + [np.zeros(1, np.int64)]))
        good, first = simple.to_numpy(zero_copy_only=False), len(word.dictionary)
        take = np.full((len(pieces), 2), len(known) - 1, np.int64)  # the last has no ids
        take[good, 0], take[good, 1] = word.indices.to_numpy(), marks.indices.to_numpy() + first
        take[~good, 0] = np.arange(len(odd)) + first + len(marks.dictionary)
        both = known.take(pa.array(take.ravel()))
        return pa.ListArray.from_arrays(both.offsets[::2], both.values)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, pa.ListArray]:
        """Per text the number of its ids with ``end``, and these; null texts count as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.any(pc.match_substring_regex(texts, r"[\x1c-\x1f]")).as_py()  # white space for Arrow, not for the tokenizer
        words = pc.split_pattern_regex(texts, r"[\x20\x09-\x0D]") if odd else pc.ascii_split_whitespace(texts)
        coded, offsets = words.values.dictionary_encode(), words.offsets.to_numpy()
        pieces = self.pieces(coded.dictionary)
        known = pa.concat_arrays([pieces, pa.array([[end]], pieces.type)])
        ids = known.take(pa.array(np.insert(coded.indices.to_numpy(), offsets[1:], len(pieces))))
        bounds = ids.offsets.to_numpy()[offsets + np.arange(len(offsets))]
        return np.diff(bounds).astype(np.int64), pa.ListArray.from_arrays(pa.array(bounds), ids.values)


def write_tokens(docs: DataFrame, target: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group: int = 32 << 20, page: int = 128 << 10) -> None:
    """Encode every text, append ``end_id`` and write the token files to ``target``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = loaded(Encoder, tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            for t in slabs(b, most=SLAB):
                n, ids = encoder.encode(text_of(t), end_id)
                at = start + np.cumsum(n) - n
                start += int(n.sum())
                made = [text_of(t, id_col), pa.array(n), pa.array(np.full(len(n), shard, np.int32)), pa.array(at), ids]
                yield from small_batches([pa.RecordBatch.from_arrays(made, [id_col, "n_tokens", "shard", "shard_start", "tokens"])])

    kept = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    ordered = kept.repartitionByRange(id_col).sortWithinPartitions(id_col, "text")
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": 4096}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in (id_col, "n_tokens", "shard_start")}
    ordered.mapInArrow(run, token_schema(kept.schema[0])).write.options(**options).parquet(target)


def _lists(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """An Arrow list<int32> column from rows of n integers each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))


def token_schema(id_field: T.StructField) -> T.StructType:
    return T.StructType([id_field, T.StructField("n_tokens", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("shard_start", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])


def read_tokens(spark: SparkSession, path: str, id_field: T.StructField, tokens: bool = True) -> DataFrame:
    """The rows of token files with ``start``, the ids of all documents before; without ``tokens``
    only the metadata columns are read."""
    files = spark.read.schema(token_schema(id_field)).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row to a file
    rows = files.join(F.broadcast(offsets), "shard").withColumn("start", F.col("before") + F.col("shard_start"))
    return rows.select(id_field.name, "start", "n_tokens", *["tokens"] * tokens)


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``tokens`` by ``ids_crc32``: of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            offsets, data = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], [*b.schema.names[:-1], "ids_crc32"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids_crc32", T.LongType())])
    return rows.mapInArrow(run, schema)
