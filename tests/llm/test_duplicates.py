"""Operators 4 and 5 against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest

from sigfield.llm import queries
from sigfield.llm.neardup import near_duplicates
from sigfield.llm.substrings import remove_repeats

SPACE = r"[^\x20\x09-\x0D]+"


def windows_removed(rows, k=13):
    least = {}
    words = [(i, re.findall(SPACE, t or "")) for i, t in rows]
    far = 1 << 62
    for i, w in words:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            least[key] = min(least.get(key, far + 1), far if i is None else i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if least[tuple(w[a : a + k])] < (far if i is None else i):
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def components(rows, num=85, k=5):
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    of = defaultdict(list)
    for r, s in enumerate(sets):
        for x in s:
            of[x].append(r)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for o in of[x]:
                if o < r:
                    both[o] += 1
        for o, n in both.items():
            if 100 * n >= num * (len(s) + len(sets[o]) - n):
                root[find(r)] = find(o)
    group = defaultdict(list)
    for r in range(len(rows)):
        group[find(r)].append(r)
    out = []
    for members in group.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        out += [(rows[m][0], len(sets[m]), min(ids, default=None)) for m in members]
    return out


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_windows(spark, scale):
    where = f"/root/testdata/{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    want = sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in windows_removed(rows))
    assert sorted(map(tuple, queries.op4_substring_dedup(spark, where).collect())) == want
    assert any(x[2] for x in want)


def test_windows_awkward(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = remove_repeats(awkward, block_bytes=4000, shard_bytes=2000).collect()
    assert sorted(map(tuple, got), key=key) == sorted(windows_removed(rows), key=key)
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_components(spark, scale):
    where = f"/root/testdata/{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op5_near_duplicates(spark, where).collect())
    assert got == sorted(components(rows))


def test_components_awkward(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(awkward).collect()]
    assert sorted(got, key=key) == sorted(components(rows), key=key)
    assert near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    """Neighbours are linked, ends are not; a hub text is shared by many that are not alike."""
    base = [f"w{i}" for i in range(400)]
    chain = [(100 + s, " ".join(base[s * 10 : s * 10 + 200])) for s in range(20)]
    hub = [(500 + s, " ".join([*base[:60], *(f"u{s}x{j}" for j in range(8))])) for s in range(60)]
    rows = chain + hub + [(900, chain[3][1]), (901, chain[3][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()]
    assert sorted(got) == sorted(components(rows))


def test_components_of_a_bucket_whose_largest_changes(spark):
    """Sliding windows of 400 words are linked at distances up to 32. Three dense groups share buckets; the
    last two become the largest component together after a first round that puts the link at 0 and 32 off."""
    without = lambda *gone: [x for x in range(14) if x not in gone]
    first = [0, -25, -50, *(-70 - x for x in without(2, 3, 5))]
    second = [32, *(33 + x for x in without(2, 7, 8, 12))]
    third = [68, *(88 + x for x in without(1, 7, 10))]
    words = [f"l80x{i}" for i in range(1200)]
    rows = [(i, " ".join(words[400 + p : 800 + p])) for i, p in enumerate(first + second + third)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df, k=1).collect()]
    assert sorted(got) == sorted(components(rows, k=1)) == [(i, 400, 0) for i in range(len(rows))]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    """Operators whose whole result SQL can express, against DuckDB."""
    import duckdb

    where = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{where}/documents.parquet'")
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, where)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(found.fetchall())
