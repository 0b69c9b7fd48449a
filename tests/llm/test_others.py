"""Operators 3, 6 and 9, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigfield.llm import queries
from sigfield.llm.decontaminate import find_leaks
from sigfield.llm.quality import fit, score
from sigfield.llm.search import Shard, search

SPACE = r"[^\x20\x09-\x0D]+"


def auc(rows):
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_quality_held_out(spark):
    where = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op3_quality(spark, where).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{where}/documents.parquet").count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [(got[i].score, y) for i, y in marks.items() if y is not None and i in got and got[i].held_out]
    assert auc(held) > 0.85


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (9, None), (None, 1), (99, 1), (4, 0)], "doc_id long, quality int")
    model = fit(awkward, labels)
    rows = score(awkward, model, keep=awkward.columns[:3]).collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 6}) == 1
    for r in rows:
        assert math.isclose(r.score, model.score(r.text or ""), rel_tol=1e-9)
    assert score(empty, model).count() == 0
    bare = fit(awkward, labels.where("false"))
    assert {r.score for r in score(awkward, bare).collect()} == {0.5}


def ranked(texts, asked, k=10, k1=1.2, b=0.75):
    bags = {i: Counter(w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(SPACE, t)) for i, t in texts.items()}
    df = Counter(w for x in bags.values() for w in x)
    n, mean = len(bags), sum(sum(x.values()) for x in bags.values()) / len(bags)
    out = {}
    for q in asked:
        scores = {}
        for i, x in bags.items():
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * (k1 + 1) / (x[w] + k1 * (1 - b + b * sum(x.values()) / mean)) for w, c in bags[q].items() if w in x)
            if s > 0:
                scores[i] = s
        out[q] = sorted(scores.values(), reverse=True)[:k], scores
    return out


def test_search(spark, sf, texts):
    got = defaultdict(list)
    for r in queries.op6_bm25_search(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    asked = [i for i, t in texts.items() if i % 20 == 0 and t.split()]
    want = ranked(texts, asked)
    assert sorted(got) == sorted(asked)
    for q, (best, scores) in want.items():
        assert [r.rank for r in got[q]] == list(range(1, len(best) + 1))
        for r, s in zip(got[q], best):
            assert math.isclose(r.score, s, rel_tol=1e-9)
            assert math.isclose(scores[r.doc_id], s, rel_tol=1e-9)
    shards = search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), shard_bytes=60_000)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in shards.collect()) == sorted((r.query_id, r.rank, r.doc_id) for rows in got.values() for r in rows)


def test_search_awkward(spark, awkward, empty):
    asked = awkward.withColumnRenamed("doc_id", "query_id").where("query_id in (5, 9, 2, 1)")
    got = search(awkward, asked).collect()
    assert {r.query_id for r in got} == {5, 9}
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 5][:3] == [5, 6, 6]
    assert search(empty, asked).count() == 0
    assert search(awkward, asked.where("false")).count() == 0
    assert search(awkward, spark.createDataFrame([(1, "nowhere-to-be-found")], "query_id long, text string")).count() == 0


def test_search_null_and_repeated_ids(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(None, "red fox"), (big, "red fox"), (3, "red fox"), (4, "blue"), (4, "blue")], "doc_id long, text string")
    asked = spark.createDataFrame([(None, "red"), (7, "fox"), (7, "blue"), (8, None)], "query_id long, text string")
    got = defaultdict(list)
    for r in search(docs, asked).orderBy("query_id", "rank", F.asc_nulls_last("doc_id")).collect():
        got[r.query_id].append((r["rank"], r.doc_id))
    assert got[None] == [(1, 3), (2, big), (3, None)]
    assert sorted(got[7], key=str) == sorted([(1, 3), (2, big), (3, None), (1, 4), (2, 4)], key=str)  # each query row has its own ranks
    assert set(got) == {None, 7}


def test_search_skips():
    """Documents in common lists alone, blocks and whole lists are skipped, and results stay exact."""
    rng = random.Random(3)
    terms, counts, lengths = [], [], []
    for i in range(6000):
        words = Counter(rng.choices(range(10), k=20)) + Counter(rng.choices(range(10, 5000), k=5))
        if i < 40:
            words += Counter([-1] * (i % 7 + 1))
        found = sorted(words.items())
        terms.append(np.array([t for t, _ in found], np.int64))
        counts.append(np.array([c for _, c in found], np.int64))
        lengths.append(sum(words.values()))
    lengths = np.array(lengths)
    shard = Shard(terms, counts, lengths, lengths.mean(), 1.2, 0.75)
    at = shard.learn(shard.vocab, np.log(1 + (6000 - shard.df + 0.5) / (shard.df + 0.5)))
    for asked in ([-1, 0], [-1, 0, 1, 2], [11, 12, 0], [0, 1], [4, 17, 18, 19, 3]):
        places = at[np.searchsorted(shard.vocab, np.array(sorted(asked)))]
        place, score = shard.search(places, np.ones(len(places), np.int64), 10)
        shard.weight[shard.number[places]] = shard.idf[places]
        every = shard.full(np.arange(shard.n))
        shard.weight[:] = 0
        best = np.lexsort((shard.order, -every))[:10]
        assert place.tolist() == shard.order[best].tolist()
        assert score.tolist() == every[best].tolist()
    assert shard.seen["skipped_by_pivot"] > 5000
    assert shard.seen["lists_not_read"] > 0 and shard.seen["skipped_blocks"] > 0


def bag(words):
    return Counter(tuple(words[a : a + 5]) for a in range(len(words) - 4))


def leaks(texts, items, threshold=0.8):
    out = {}
    letters = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    words = {i: letters(t) for i, t in texts.items()}
    grams = {i: set(bag(w)) for i, w in words.items()}
    for item, text in items:
        want = letters(text)
        if len(want) < 5:
            continue
        b = bag(want)
        for i, w in words.items():
            if len(grams[i] & b.keys()) < len(b) // 2:  # too few for the threshold
                continue
            best = 0.0
            for a in range(max(1, len(w) - len(want) + 1)):
                x = bag(w[a : a + len(want)])
                both = sum((x & b).values())
                if both:
                    best = max(best, both / (sum(x.values()) + sum(b.values()) - both))
            if best >= threshold:
                out[i, item] = best
    return out


def test_leaks(spark, sf, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op9_decontamination(spark, sf).collect()}
    want = leaks(texts, items)
    assert set(got) == set(want)
    assert want
    for k, s in got.items():
        assert s == pytest.approx(want[k])


def test_leaks_awkward(spark, awkward, empty):
    items = [(1, None), (2, ""), (3, "four words are few"), (4, "one two three four five six seven eight nine ten"), (4, "one two three four five six seven eight nine ten"), (None, "a b c d e f g h i j k l m")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id or 0) for r in find_leaks(awkward, bench).collect()))
    assert got == [(5, 0), (5, 4), (6, 0), (6, 4), (10, 4)]
    assert find_leaks(empty, bench).count() == 0
    assert find_leaks(awkward, bench.where("false")).count() == 0


def test_pipeline(spark, sf, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    sizes = [x.count() for x in seen]
    assert sizes == sorted(sizes, reverse=True)
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5]
    kept = {r.doc_id: r.text for r in seen[4].collect()}
    assert not leaks(kept, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert {r.doc_id for r in seen[5].collect()} == set(kept)


def test_pipeline_awkward(spark, awkward, sf):
    import corpus_pipeline

    # with columns that bear names of the operators' own
    docs = awkward.withColumns({c: F.lit("z") for c in ("lang", "secrets", "text_hash_", "key", "label", "kept", "text_to_score")})
    assert {"score", "id", "row", "hash"} <= set(docs.columns)
    for x in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            x = stage(spark, x, sf)
            x.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert x.columns == docs.columns
                assert not x.where("coalesce(secrets, '') <> 'z' or coalesce(score, '') <> 'z'").count()


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null and repeated ids: each row is kept or dropped for its own text."""
    import corpus_pipeline

    item = "a benchmark item of more than five words that some documents contain"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    p, q, r = (" ".join(f"{c}{i}" for i in range(60)) for c in "pqr")
    rows = [(None, f"x {item} y"), (None, p), (None, f"{p} more"), (None, q), (7, f"v {item} z"), (7, r), (7, f"{r} more"), (8, q), (9, None), (9, None), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = [(x.doc_id, x.text) for x in kept.collect()]
    assert len({t for _, t in found if t in (p, f"{p} more")}) == 1
    assert len({t for _, t in found if t in (r, f"{r} more")}) == 1
    assert [i for i, t in found if t == q] == [8]
    rest = [(i, t) for i, t in found if not t or item in t]
    assert sorted(map(str, rest)) == sorted(map(str, [(None, f"x {item} y"), (7, f"v {item} z"), (9, None), (9, ""), (None, None)]))
    assert len(found) == 8
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, ((x.doc_id, x.text) for x in left))) == sorted(str(x) for x in rows if item not in (x[1] or ""))


def test_quality_features_at_once():
    """Slab-wise scores equal those of single texts, for awkward words, repeats and words met before."""
    import numpy as np
    import pyarrow as pa

    from sigfield.llm.quality import BUCKETS, Model, Scorer, summed_features, word_features

    model = Model(np.random.default_rng(3).normal(size=BUCKETS), 0.3)
    texts = ["a", "aaaa aaaa", "é 漢字 😀", " x\ty\n", None, "", "word " * 50, "nbsp joined", "x" * 3000, "the the cat the", "\x00 \x1c"] * 2
    scorer = Scorer(model)
    want = [model.score(t or "") for t in texts]
    for _ in range(2):
        got = 1 / (1 + np.exp(-scorer.logits(pa.array(texts, pa.string()))))
        assert np.allclose(got, want, atol=1e-12)
    assert not len(scorer.logits(pa.array([], pa.string())))
    raw = np.frombuffer("abab naïve b".encode(), np.uint8)
    total, size = summed_features(model.logit, raw, np.array([0, 5, 12]), np.array([4, 11, 13]))
    for t, n, w in zip(total, size, ("abab", "naïve", "b")):
        f = word_features(w)
        assert n == len(f) and abs(t - model.logit[f].sum()) < 1e-9
