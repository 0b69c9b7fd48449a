"""A training-data pipeline over the documents table, stage by stage.

Each stage reads what the one before kept, written as Parquet in the shared folder:

1. quality: rows that the quality classifier scores below 0.3 go;
2. near_duplicates: of each component of near copies (5-word shingles, similarity 0.8 or more) the row
   with the smallest id stays, null ids last; of rows that repeat id and text, one;
3. decontamination: rows that contain a benchmark item go;
4. secrets: live-looking secrets are replaced in the text, whose n_chars follows; examples that are
   widely copied stay as they are;
5. bpe: the texts become token ids, with a digest of what they decode to.

Rows with null or empty texts are scored like others and pass stages 2 to 4 unchanged. An empty table
passes through empty. Other columns of documents are kept up to stage 4. Ids may be null or repeat: stages
2 and 3 decide by id and text together, on which alone their decisions rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigfield.llm.bpe import encode_decode
from sigfield.llm.decontaminate import find_leaks
from sigfield.llm.neardup import near_duplicates
from sigfield.llm.quality import fit, score
from sigfield.llm.secrets import redact, scan_secrets
from sigfield.runtime import cut


def _packed(docs: DataFrame) -> DataFrame:
    """What the operators read, and all columns in one, so that no column's name meets theirs."""
    return docs.select("doc_id", "text", *(c for c in docs.columns if c == "source"), F.struct(*docs.columns).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    packed = _packed(docs)
    model = fit(packed, labels, F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    return score(packed, model, keep=["row"]).where("score >= 0.3").select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """Add ``key``: never null, ordered by id, equal for rows that repeat id and text only."""
    none = F.lit(0).cast(docs.schema["doc_id"].dataType)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", none).alias("id"), F.xxhash64("text").alias("text"), F.col("text").isNull().alias("no_text"))
    return _packed(docs).select(key.alias("key"), "text", "row")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    kept = near_duplicates(keyed, num=80, id_col="key").where("kept").select("key").distinct()
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    leaks = find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return keyed.join(leaks.select("key").distinct(), "key", "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = scan_secrets(_packed(docs), keep=["row"])
    live, row = F.filter("secrets", lambda x: x["live"]), F.col("row")
    changed = {
        "text": F.when(F.size(live) > 0, redact(row["text"], live)).otherwise(row["text"]),
        "n_chars": F.when(F.size(live) > 0, F.length("text").cast("long")).otherwise(row["n_chars"]),
    }
    redacted = found.withColumn("text", changed["text"])
    return redacted.select(*(changed["n_chars"].alias(c) if c == "n_chars" else F.col("text") if c == "text" else row[c].alias(c) for c in docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_copies),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("bpe", bpe),
]

#: SQL can't express the learned scores of stage 1 nor the merges of stage 5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
