"""Operator 10: token counts with the whole-token shortcut.

Before counting, the driver proves which vocabulary strings are pre-tokens that encode alone as one
token, by running the merges on each. While counting, such pre-tokens count one; only the others are
merged. The proven set has at most one entry for each vocabulary entry, so its broadcast is bounded.

A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives an
empty result; other columns are never read. A text of any length is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfield.llm.bpe import Bpe, Memo, loaded
from sigfield.llm.words import slabs, text_of
from sigfield.runtime import ship


def whole_tokens(path: str) -> frozenset[str]:
    """The normalised pre-tokens that the tokenizer turns into exactly one token."""
    bpe = loaded(Bpe, path)
    byte = {c: b for b, c in bpe.alphabet.items()}
    out = set()
    for string, i in bpe.vocab.items():
        if not string.endswith(bpe.suffix) or string == bpe.suffix:
            continue
        try:
            text = bytes(byte[c] for c in string.removesuffix(bpe.suffix)).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if bpe.pre_tokens(text) == [text] and bpe.merge(bpe.symbols(text)) == [i]:
            out.add(text)
    return frozenset(out)


def counter(bpe: Bpe, whole: frozenset[str]) -> Memo:
    """Token counts of pieces, remembered."""

    def count(piece: str) -> int:
        n = 0
        for k, part in enumerate(bpe._special.split(piece) if "<|" in piece else (piece,)):
            if k % 2:
                n += 1
            elif part:
                for t in bpe.pre_tokens(part):
                    n += 1 if t in whole else len(bpe.merge(bpe.symbols(t)))
        return n

    return Memo(count)


_COUNTERS: dict[str, Memo] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    spark = docs.sparkSession
    ship(spark)
    proven = spark.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(Bpe, path)
        if path not in _COUNTERS:
            _COUNTERS[path] = counter(bpe, proven.value)
        get = _COUNTERS[path].__getitem__
        for b in batches:
            for t in slabs(b):
                texts = text_of(t)
                n = [sum(map(get, bpe.pieces(x))) if x else 0 for x in texts.to_pylist()]
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([text_of(t, id_col), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([kept.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return kept.mapInArrow(run, schema)
