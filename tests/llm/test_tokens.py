"""Operators 1, 2 and 10 against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigfield.llm import queries
from sigfield.llm.bpe import Bpe, encode_decode
from sigfield.llm.counts import count_tokens
from sigfield.llm.tokenfiles import Encoder, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_files(spark, sf, texts, library):
    got = {r.doc_id: r for r in queries.op1_token_files(spark, sf).collect()}
    start = 0
    assert sorted(got) == sorted(texts)
    for i in sorted(texts):
        ids = [*ids_of(library, texts[i]), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_file_format(spark, tmp_path, docs):
    """Several files in id order; growing columns delta coded, ids by dictionary, page indexes everywhere."""
    import glob

    import pyarrow.parquet as pq

    ids = docs.select((F.col("doc_id") * 3).alias("doc_id"), "text")
    target = f"{tmp_path}/tokens"
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows become one file
    try:
        write_tokens(ids, f"file://{target}", PATH, 2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    files = sorted(glob.glob(f"{target}/*.parquet"))
    assert len(files) >= 3
    bounds = []
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
        for name in ("doc_id", "n_tokens", "shard_start"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings
        assert "RLE_DICTIONARY" in columns["tokens"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        bounds.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max))
    bounds.sort()
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    rows = read_tokens(spark, f"file://{target}", ids.schema["doc_id"], tokens=False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and ",tokens:array" not in plan
    some = read_tokens(spark, f"file://{target}", ids.schema["doc_id"]).where("doc_id between 30 and 60")
    assert "GreaterThanOrEqual(doc_id,30)" in some._jdf.queryExecution().executedPlan().toString()
    start = 0
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        assert r.start == start
        start += r.n_tokens


def test_bpe(spark, sf, texts, library):
    for r in queries.op2_bpe(spark, sf).collect():
        ids = ids_of(library, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts(spark, sf, texts, library):
    for r in queries.op10_token_counts(spark, sf).collect():
        n = len(ids_of(library, texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_awkward(spark, awkward, library, tmp_path):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in awkward.collect()))
    for r, (_, i, text) in zip(sorted(encode_decode(awkward, PATH).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, len(r.ids))), sorted(rows, key=lambda x: (*x[:2], len(ids_of(library, x[2]))))):
        assert (r.doc_id or 0) == i
        assert list(r.ids) == ids_of(library, text)
        assert r.decoded == library.decode(ids_of(library, text), skip_special_tokens=False)
    counted = sorted((r.doc_id or 0, r.n_tokens) for r in count_tokens(awkward, PATH).collect())
    assert counted == sorted((i, len(ids_of(library, t))) for _, i, t in rows)
    write_tokens(awkward, f"file://{tmp_path}/tokens", PATH, 2)
    back = read_tokens(spark, f"file://{tmp_path}/tokens", awkward.schema["doc_id"]).collect()
    back.sort(key=lambda r: r.start)
    assert [list(r.tokens) for r in back] == [[*ids_of(library, t), 2] for *_, t in rows]


def test_empty(spark, empty, tmp_path):
    assert encode_decode(empty, PATH).count() == 0
    assert count_tokens(empty, PATH).count() == 0
    write_tokens(empty, f"file://{tmp_path}/none", PATH, 2)
    assert read_tokens(spark, f"file://{tmp_path}/none", empty.schema["doc_id"]).count() == 0


# any code points but surrogates; the second strategy is dense in special cases
ANY = st.text(st.characters(exclude_categories=["Cs"]), max_size=60)
SPECIAL = st.text("aAbé\u0301İΣσς <|endoftext>'tsll1\x1c\x85\u3000ﬁ", max_size=60)


@settings(max_examples=300, deadline=None)
@given(ANY | SPECIAL)
def test_any_text(text):
    t = test_any_text.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    bpe = test_any_text.__dict__.setdefault("bpe", Bpe(PATH))
    assert list(bpe.encode(text)) == t.encode(text, add_special_tokens=False).ids
    assert bpe.decode(bpe.encode(text)) == t.decode(t.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | ANY | SPECIAL, max_size=4))
def test_any_texts_for_files(rows):
    t = test_any_text.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    encoder = test_any_text.__dict__.setdefault("encoder", Encoder(PATH))
    n, got = encoder.encode(pa.array(rows, pa.string()), 2)
    want = [[*ids_of(t, x), 2] for x in rows]
    assert got.to_pylist() == want
    assert n.tolist() == [len(x) for x in want]


@settings(max_examples=50, deadline=None)
@given(st.text("abcdefg", min_size=97, max_size=300))
def test_long_words_take_the_same_merges(word):
    bpe = test_long_words_take_the_same_merges.__dict__.setdefault("bpe", Bpe(PATH))
    short = list(bpe.symbols(word))
    import sigfield.llm.bpe as module

    module.SHORT, kept = 10**9, module.SHORT
    try:
        assert bpe.merge(list(short)) == bpe._merge_long(list(short))
    finally:
        module.SHORT = kept


def test_every_code_point(library):
    """Each code point but surrogates, inside words and marks, also with a combining mark after it."""
    bpe = Bpe(PATH)
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 64):
        some = [chr(c) for c in codes[at : at + 64]]
        for text in (" ".join(f"a{c}.{c}" for c in some), " ".join(f"{c}\u0301" for c in some)):
            assert list(bpe.encode(text)) == ids_of(library, text)
