"""The source audit against a plain reading of the contract."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sigfield.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(rows, least=10, most=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        all_ = Counter()
        for s in sources:
            all_.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(all_)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(x, sum(gap(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, upto in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:upto]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def _check(table, **args):
    got = sorted(tuple(r) for r in source_divergence(table, **args).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == _plain([tuple(r) for r in table.select("lang", "source", "text").collect()], args.get("least_docs", 10), args.get("most_terms", 10))
    return got


def test_documents(docs):
    assert {r[2] for r in _check(docs)} == {"pair", "term"}
    _check(docs, least_docs=2, most_terms=3, shares=3)


def test_awkward_rows(spark):
    texts = ["The the THE cat", "the dog", None, "", "123 <>", "Ünïcode ünïcode É é 漢字 a_b", "cat " * 5000, "the\x00end"]
    rows = [(["en", "de", None][k % 3], [None, "a", "B", "é", "\U0001f600", "￿"][k % 6 if k % 3 else k % 5], texts[k * 7 % 8], "clash") for k in range(400)]
    rows += [("xx", s, "lone words", "clash") for s in ("a", "b", "c")] + [("yy", "only", "one", "clash")]
    table = spark.createDataFrame(rows, "lang string, source string, text string, share string").withColumns({"term": F.lit(1), "n": F.lit(2), "value": F.lit("v")}).repartition(4)
    got = _check(table)
    assert [r for r in got if r[0] == "xx"] == [("xx", s, "pair", o, 0, k + 1) for s in "abc" for k, o in enumerate(x for x in "abc" if x != s)]
    assert source_divergence(table.where("false")).count() == 0


def test_large_counts_stay_exact(spark):
    from sigfield.llm.divergence import _share

    n, total, terms = 3 * 10**13, 10**15 + 7, 10**6
    got = spark.range(1).select(_share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)
