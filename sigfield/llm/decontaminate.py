"""Operator 9: benchmark decontamination by SimHash windows, in DataFrame expressions only.

Texts are lower-cased and cut into words of letters and digits; five consecutive words make a shingle.
Around every shingle that a document shares with an item of n words lies one n-word window, aligned with
the item; a window without a shared shingle has similarity 0, so none is missed. A window's SimHash (64
signs of its shingles' hash bits) is looked up in an index of the items of its size, cut into radius + 1
blocks: fingerprints within the radius agree in at least one block. Pairs within the radius are verified
by weighted-shingle similarity, shingles weighing their occurrences: the sum of the smaller counts over
the sum of the larger ones. At a similarity of 0.8 the SimHash distance is 9.7 bits on average, with a
deviation of 2.9; the default radius, 29, leaves out fewer than one such pair in a hundred million, and of
closer ones fewer.

All of this happens where a document is read; only matches are shuffled. The shared shingles are
broadcast in blocks of at most ``ANCHORS`` rows, whatever the benchmark's size, with one pass over the
documents for each block.

Items of fewer than five words, or null, match nothing; documents likewise. Repeated items match each,
repeated documents match each; pairs of equal ids count once, with their highest similarity. Null ids
match like others. Empty tables give empty results; other columns are not read; texts of any length are
read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfield.runtime import cut

SHINGLE, BITS = 5, 64
ANCHORS = 1_000_000


def shingled(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``sh``, the hashes of a text's shingles in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    hashes = df.withColumn("wh", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("wh")
    places = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return hashes.withColumn("sh", F.transform(places, lambda i: F.xxhash64(*(F.get("wh", i + j) for j in range(SHINGLE))))).drop("wh")


def simhash(sh: Column) -> Column:
    """Bit b tells whether more than half of the hashes have bit b."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def with_bit(code: Column, b: Column) -> Column:
        having = F.size(F.filter(sh, lambda h: F.call_function("shiftright", h, b).bitwiseAND(one) == 1))
        return code.bitwiseOR(F.when(having * 2 > F.size(sh), F.call_function("shiftleft", one, b)).otherwise(zero))

    # never null, so that no condition on it is moved to where documents are taken apart
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), zero, with_bit), zero)


def _edges(n: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of the n blocks of a fingerprint."""
    at = [round(k * BITS / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def blocks(code: Column, n: int) -> Column:
    """Array of (number, value) of the n blocks of a fingerprint."""
    part = lambda a, w: F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
    return F.array(*(F.struct(F.lit(k).alias("number"), part(*e).alias("value")) for k, e in enumerate(_edges(n))))


def first_equal(a: Column, b: Column, n: int) -> Column:
    """The number of the first block in which two fingerprints agree."""
    differ = lambda at, w: F.shiftrightunsigned(a.bitwiseXOR(b), at).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
    return F.coalesce(*(F.when(differ(*e) == 0, k) for k, e in enumerate(_edges(n))))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags of hashes."""
    count = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    both = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 29, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (id, item, similarity) of documents and the items they contain: per pair the highest
    similarity of a window, where that reaches ``threshold``."""
    items = shingled(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")), "t").drop("t").where(F.size("sh") > 0)
    # ids may be null or repeat: rows stand for items until the end
    items = cut(items.select(F.monotonically_increasing_id().alias("row"), "item", "sh", F.size("sh").alias("m"), simhash(F.col("sh")).alias("code")), "items")
    placed = items.select("sh", "m", F.posexplode("sh").alias("j", "h"))
    anchors = placed.select("h", "m", "j", F.when(F.col("j") > 0, F.get("sh", F.col("j") - 1)).alias("prior")).distinct()
    parts = max(1, math.ceil(anchors.count() / ANCHORS))
    index_rows = items.count() * (radius + 1)
    index = items.select("row", "m", F.col("code").alias("item_code"), F.explode(blocks(F.col("code"), radius + 1)).alias("x")).select("row", "m", "item_code", "x.number", "x.value")

    texts = shingled(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")), "t").drop("t")
    at = texts.select("doc", "sh", F.posexplode_outer("sh").alias("i", "h"))
    windows = None
    for p in range(parts):
        part = anchors if parts == 1 else anchors.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == p)
        near = at.join(F.broadcast(part), "h")  # at most about ANCHORS rows
        # of consecutive shared shingles that lie alike in item and document, only the first asks for the window
        near = near.where("i = 0 or prior is null or get(sh, i - 1) <> prior")
        start = F.greatest(F.lit(0), F.least(F.col("i") - F.col("j"), F.size("sh") - F.col("m")))
        some = near.select("doc", "m", F.slice("sh", start + 1, F.col("m")).alias("window"))
        windows = some if windows is None else windows.union(some)
    coded = windows.withColumn("code", simhash(F.col("window")))
    keyed = coded.select("doc", "m", "window", "code", F.explode(blocks(F.col("code"), radius + 1)).alias("x")).select("doc", "m", "window", "code", "x.number", "x.value")
    side = F.broadcast(index) if index_rows <= ANCHORS else index
    close = keyed.join(side, ["m", "number", "value"]).where(F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))) <= radius)
    # the first block in which the two agree speaks for the pair
    close = close.where(F.col("number") == first_equal(F.col("code"), F.col("item_code"), radius + 1)).select("doc", "row", "window")
    bags = items.select("row", "item", F.col("sh").alias("item_sh"))
    full = close.join(F.broadcast(bags) if index_rows <= ANCHORS // 8 else bags, "row").withColumn("similarity", similarity(F.col("window"), F.col("item_sh")))
    best = full.where(F.col("similarity") >= threshold).groupBy("doc", "item").agg(F.max("similarity").alias("similarity"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "similarity")
