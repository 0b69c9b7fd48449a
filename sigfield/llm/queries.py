"""The operators' queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    from sigfield.llm.tokenfiles import read_tokens, with_crc32, write_tokens
    from sigfield.runtime import shared_dir

    docs, target = _table(spark, sf_dir, "documents"), shared_dir(spark, "tokens")
    write_tokens(docs, target, _tokenizer(), 2)
    return with_crc32(read_tokens(spark, target, docs.schema["doc_id"]))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    from sigfield.llm.bpe import encode_decode

    rows = encode_decode(_table(spark, sf_dir, "documents"), _tokenizer())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents."""
    from sigfield.llm.counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; only rows outside the held-out fifth are learned from. Rows without an id are not
    learned from either and count as held out."""
    from sigfield.llm.quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    fifth = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    model = fit(docs, _table(spark, sf_dir, "labels"), fifth("id") != 0)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fifth("doc_id") == 0, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 13-word windows, as digests."""
    from sigfield.llm.substrings import remove_repeats

    rows = remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component that links of 85 % shared shingles put them in."""
    from sigfield.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the whole text of every document whose id is divisible by 20."""
    from sigfield.llm.search import search

    docs = _table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: counts of base spans, their digest, and all spans."""
    from sigfield.llm.pii import KINDS, find_personal_data

    rows, s = find_personal_data(_table(spark, sf_dir, "documents")), F.col("spans")
    base = F.filter(s, lambda x: x["base"])
    return rows.select("doc_id", *(_count(s, k) for k in KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(s).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts of base spans, their digest, all spans, and how many of the
    base spans look live or are copied by several sources."""
    from sigfield.llm.secrets import scan_secrets

    rows, s = scan_secrets(_table(spark, sf_dir, "documents")), F.col("secrets")
    base = F.filter(s, lambda x: x["base"])
    n = lambda live: F.size(F.filter(base, lambda x: x["live"] == live)).cast("long")
    return rows.select("doc_id", *(_count(s, k) for k in ("assign", "access", "hex")), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(s).alias("spans"), n(True).alias("n_live"), n(False).alias("n_copied"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, with the items and similarities."""
    from sigfield.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted, written and read back."""
    from sigfield.llm.chat import as_parts, format_chat, read_chat
    from sigfield.runtime import cut

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    messages = rows.union(planted).select("conv_id", "turn", "role", as_parts(F.col("text")).alias("parts"))
    return read_chat(cut(format_chat(messages), "chat"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut for infilling, as digests of the outputs and of the texts rebuilt from them."""
    from sigfield.llm.infill import fill_in_middle, restore

    rows = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their words."""
    from sigfield.llm.divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_bm25_search": op6_bm25_search,
    "op7_personal_data": op7_personal_data,
    "op8_secrets": op8_secrets,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_chat_format": op11_chat_format,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_divergence": op13_source_divergence,
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: SQL for the operators whose whole result SQL can express
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w)-11, 1)), lambda i: array_to_string(w[i:i+12], ' '))) AS key, generate_subscripts(list_transform(range(1, greatest(len(w)-11, 1)), lambda i: i), 1) AS i FROM d),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS least FROM k), gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM g, range(13) t(j) WHERE least < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d), y AS (SELECT x.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY x.pos) FILTER (gone.pos IS NULL) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.pos = x.pos GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)""",
    "op5_near_duplicates": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w)-3), lambda i: array_to_string(w[i:i+4], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100*shared >= 85*(na+nb-shared)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op11_chat_format": r"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 24 AS shown FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(shown) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS attached_tokens FROM e GROUP BY conv_id""",
    "op12_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || h[8*k+1:8*k+8] AS BIGINT) FOR k IN range(4)] AS x FROM d),
c AS (SELECT *, least(x[1] % (n+1), x[2] % (n+1)) AS a, greatest(x[1] % (n+1), x[2] % (n+1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a+1:b], ''), '') AS mid, coalesce(array_to_string(u[b+1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), x AS (SELECT id, lang, source, unnest(w) AS term FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM x GROUP BY ALL),
v AS (SELECT lang, term, count(*) AS in_lang FROM x GROUP BY ALL HAVING count(DISTINCT id) >= 10), s AS (SELECT lang, count(*) AS v, sum(in_lang) AS total FROM v GROUP BY lang),
z AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.in_lang, s.v, s.total FROM g JOIN v USING (lang) JOIN s USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p, 1 + (1000000000::HUGEINT * (in_lang + 2)) // (total + 2 * v) AS q FROM z),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10""",
}
