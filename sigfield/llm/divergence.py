"""Operator 13: an audit of how the sources of a language differ in their words, in plain relational steps.

Terms are the matches of a pattern in texts whose A-Z are lower-cased. A language keeps the terms that are in
at least ``least_docs`` of its documents. Every (lang, source) group and every language then has a count for
each kept term (zeros included), smoothed into parts per billion p, and two groups or a group and its language
differ at a term by f = (p - q)^2 / (p + q), rounded down. Part ``pair`` ranks, for each group, the other sources
of its language by the sum of f over all kept terms; part ``term`` ranks the terms that a group uses more than its
language does.

How the work is dealt: occurrences are counted before the shuffle, by group and term; groups meet the vocabulary
by language and a share of the terms, so that one language's terms are spread over ``shares`` tasks; the self-join
runs by language and term and makes each unordered pair once; sums are taken before the shuffle. The dense table has
(groups of a language) x (its kept terms) rows and the pairs are those of the result, as the method asks: both grow
with the vocabulary and the number of sources, not with the text.

Null text, lang and source count as ''. A group without terms takes part with zeros; a language without kept terms
gives pairs of value 0. Repeated rows are documents of their own (ids are not read); an empty table gives an empty
result; other columns are not read. Products are taken in decimals, so that counts of any size stay exact. Texts
of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfield.runtime import cut

PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exactly."""
    return F.call_function("div", F.expr("1000000000BD") * n.cast("decimal(20,0)") + F.expr("2000000000BD"), total.cast("decimal(20,0)") + terms.cast("decimal(20,0)") * F.expr("2BD")) + F.lit(1)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, least_docs: int = 10, most_terms: int = 10, shares: int = 64, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows of (lang, source, part, item, value, rank)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text"))
    groups = cut(read.select("lang", "source").distinct(), "groups")

    # occurrences first, then each document's distinct terms once more
    terms = read.select("lang", "source", F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(PATTERN), F.lit(0)).alias("terms"))
    each = terms.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    counts = cut(each.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("size")).alias("n"), F.count_if(F.col("at") >= F.col("size")).alias("docs")), "counts")

    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    vocabulary = cut(vocabulary.select("lang", "term", "in_lang", F.pmod(F.xxhash64("term"), F.lit(shares)).cast("int").alias("share")), "vocabulary")
    kept = counts.join(vocabulary.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = groups.join(sizes, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])

    spread = known.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dense = vocabulary.join(spread, ["lang", "share"]).join(kept, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    q = _share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    dense = cut(dense.select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), q.alias("q")), "dense")

    a = dense.select("lang", "term", F.col("source").alias("a"), "p")
    b = dense.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"))
    gaps = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(_gap(F.col("p"), F.col("q"))).alias("value"))
    left = groups.select("lang", F.col("source").alias("a"), F.pmod(F.xxhash64("source"), F.lit(shares)).cast("int").alias("share"))
    right = groups.select("lang", F.col("source").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    bare = left.join(groups.join(sizes, "lang", "left_anti").select("lang").distinct(), "lang", "left_semi").join(right, ["lang", "share"]).where("a < b")
    pairs = gaps.union(bare.select("lang", "a", "b", F.lit(0).cast("long")))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    row = lambda part: ("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    used = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    return both.select("lang", "x.source", "x.item", "value").select(*row("pair")).union(used.select(*row("term")).where(F.col("rank") <= most_terms))
