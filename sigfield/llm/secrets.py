"""Operator 8: secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Candidates are assignments to secret-sounding names, access keys, long hexadecimal runs (the base), and
tokens of well-known formats. A candidate's value is hashed; hashes are counted by distinct owners and
repositories over the whole corpus, aggregated map-side first. Texts with equal sets of 5-word shingles
are copies of one text and count once, under the first of their owners; a text of fewer than five words
has no shingle and counts by itself. A value that more than ``most_owners`` owners and more than
``most_repos`` repositories have is a widely copied example; others look live. All spans stay, marked as
live or copied.

Positions come from the pieces between matches: the same leftmost scan splits a text and extracts its
matches, so a match starts after all pieces and matches before it. Offsets count code points.

A null or empty text has no candidates; a null owner or repository counts as one owner or repository;
repeated rows stay separate rows; empty tables give empty results; other columns are not read; texts of
any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfield.runtime import cut

KINDS = ("assign", "access", "hex", "format")

# fixed values: the patterns of the four kinds; of an assignment, group 1 is the value
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "format": r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
LEAST = {"assign": 8, "access": 16, "hex": 32, "format": 14}


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, rank, start, end, value) of one kind, tests applied."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        a = state["at"] + x["gap"]
        b = a + F.length(x["m"])
        return F.struct(b.alias("at"), F.concat(state["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["m"].alias("text")))).alias("out"))

    zipped = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    placed = F.aggregate(zipped, start, step, lambda s: s["out"])
    value = (lambda m: F.regexp_extract(m, PATTERNS[kind], 1)) if kind == "assign" else (lambda m: m)
    rows = F.transform(placed, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), value(x["text"]).alias("value")))
    empty = F.array().cast("array<struct<kind:string,rank:int,start:int,end:int,value:string>>")
    return F.when(text.rlike(PATTERNS[kind]), F.filter(rows, lambda x: F.length(x["value"]) >= LEAST[kind])).otherwise(empty)


def _copied_text(text: Column) -> Column:
    """A hash of the set of a text's 5-word shingles, A-Z lower-cased; null for fewer words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.array_remove(F.split(F.translate(text, upper, upper.lower()), r"[\x20\x09-\x0D]+"), "")
    one = F.array(F.struct(F.transform(words, lambda w: F.xxhash64(w)).alias("h")))  # so that words are hashed once
    shingles = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(5))))
    return F.transform(one, lambda x: F.when(F.size(x["h"]) >= 5, F.xxhash64(F.array_sort(F.array_distinct(shingles(x["h"]))))))[0]


def scan_secrets(docs: DataFrame, most_owners: int = 3, most_repos: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Per row: the id column, those named in ``keep``, and ``secrets``: an array of (start, rank, end,
    kind, base, n_owners, n_repos, live), ordered by start, then kind."""
    columns = list(dict.fromkeys([id_col, *(keep or [])]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*columns).alias("kept"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), text.alias("text"))
    rows = rows.withColumn("found", F.concat(*(_matches(F.col("text"), k) for k in KINDS)))
    hashed = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), F.substring(F.unhex(F.sha2(x["value"], 256)), 1, 16).alias("hash")))
    copied = F.when(F.size("found") > 0, _copied_text(F.col("text")))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "kept", "owner", "repo", copied.alias("copied"), hashed.alias("found")), "candidates")

    # matches carry their row's number, not its columns
    each = rows.where(F.size("found") > 0).select("row", "owner", "repo", "copied", F.explode("found").alias("x"))
    own = F.when(F.col("copied").isNull(), F.col("row"))
    first = each.groupBy(F.col("x.hash").alias("hash"), "copied", own.alias("own")).agg(F.min(F.struct("owner", "repo")).alias("first"))
    seen = first.select("hash", "first.owner", "first.repo").distinct()
    by_owner = seen.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    frequency = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))
    marked = each.withColumn("hash", F.col("x.hash")).join(frequency, "hash")
    live = (F.col("n_owners") <= most_owners) | (F.col("n_repos") <= most_repos)
    span = F.struct(F.col("x.start").alias("start"), F.col("x.rank").alias("rank"), F.col("x.end").alias("end"), F.col("x.kind").alias("kind"), (F.col("x.kind") != "format").alias("base"), "n_owners", "n_repos", live.alias("live"))
    found = marked.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("secrets"))
    spans = rows.where(F.size("found") > 0).select("row", "kept").join(found, "row").select("kept", "secrets")
    none = rows.where(F.size("found") == 0).select("kept", F.array().cast(spans.schema["secrets"].dataType).alias("secrets"))
    return spans.union(none).select("kept.*", "secrets")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with a mark for each span, or for each run of overlapping ones; spans in order."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fresh = x["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
