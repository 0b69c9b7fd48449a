"""Fill-in-the-middle against a plain reading of the contract, and its bitvectors against counting."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigfield.llm.infill import BitVector, fill_in_middle, restore

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
@pytest.mark.parametrize("size", [0, 1, 63, 64, 511, 512, 513, 5000])
def test_bitvector(size, share):
    bits = np.random.default_rng(size).random(size) < share
    v = BitVector(bits)
    ones = np.flatnonzero(bits)
    assert v.total == len(ones)
    assert v.select(np.arange(len(ones))).tolist() == ones.tolist()
    assert v.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(bits).tolist()]


def _plain(i, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = [int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _check(table):
    rows = fill_in_middle(table).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=repr)
    source = table.select("doc_id", "text").collect()
    assert got == sorted(((r.doc_id, *_plain(r.doc_id, r.text)) for r in source), key=repr)
    assert sorted((repr(r.doc_id), r.back) for r in rows) == sorted((repr(r.doc_id), r.text or "") for r in source)


def test_documents(docs):
    _check(docs)


def test_awkward(awkward, empty, spark):
    _check(awkward)
    assert fill_in_middle(empty).count() == 0
    texts = ["<", "P> <P", "a <S", "<M> x", " a\t", "\n\n", "é 😀\x0b\x0c漢 字 ", "x " * 20000, "<<<", "S>M>P>", " <  > "]
    _check(spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string").repartition(4))
