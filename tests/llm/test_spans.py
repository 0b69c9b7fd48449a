"""Operators 7 and 8 against plain scans."""

import hashlib
import re

import pytest

from sigfield.llm import queries
from sigfield.llm.pii import find_personal_data, spans
from sigfield.llm.secrets import scan_secrets

# fixed values: the base patterns of the contract
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    if kind == "ip":
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1])))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return {"email": True, "assign": len(m[2]) >= 8 if kind == "assign" else 0, "access": len(m[0]) >= 16, "hex": len(m[0]) >= 32}[kind]


def plain(text, patterns):
    found = [(m.start(), list(patterns).index(k), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if passes(k, m)]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


@pytest.mark.parametrize(("query", "patterns"), [("op7_personal_data", PERSONAL), ("op8_secrets", SECRET)])
@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_base(spark, scale, query, patterns):
    where = f"/root/testdata/{scale}"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    got = queries.QUERIES[query](spark, where).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        found = plain(texts[r.doc_id], patterns)
        assert r.base_sha256 == digest(found)
        for k in patterns:
            assert r[f"n_{k}"] == sum(f[0] == k for f in found)
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= set(r.spans.split(","))


DISGUISED = [
    ("write to bob [at] example [dot] org now", "email", "bob [at] example [dot] org"),
    ("write to bob (at) mail (dot) example (dot) com.", "email", "bob (at) mail (dot) example (dot) com"),
    ("see jane at example dot com today", "email", "jane at example dot com"),
    ("mаil: аlice@exаmple.org!", "email", "аlice@exаmple.org"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("card ４１１１１１１１１１１１１１１１ ok", "card", "４１１１１１１１１１１１１１１１"),
    ("😀 ip １０.0.0.1 end", "ip", "１０.0.0.1"),
]


@pytest.mark.parametrize(("text", "kind", "part"), DISGUISED)
def test_disguises(text, kind, part):
    found = [(s["kind"], text[s["start"] : s["end"]]) for s in spans(text) if not s["base"]]
    assert (kind, part) in found


@pytest.mark.parametrize("text", ["", "meet me at noon. com is a word", "one two three four words", "look at example of this", "x" * 100_000, "1 " * 50_000, "a@" * 50_000, "at dot " * 20_000])
def test_clean(text):
    assert [s for s in spans(text) if not s["base"]] == []


def test_awkward(awkward, empty):
    texts = sorted(((r.doc_id or 0), r.text or "") for r in awkward.collect())
    got = sorted(((r.doc_id or 0), [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in find_personal_data(awkward).collect())
    assert got == sorted((i, plain(t, PERSONAL)) for i, t in texts)
    got = sorted(((r.doc_id or 0), [(s.kind, s.start, s.end) for s in r.secrets if s.base]) for r in scan_secrets(awkward).collect())
    assert got == sorted((i, plain(t, SECRET)) for i, t in texts)
    assert find_personal_data(empty).count() == 0
    assert scan_secrets(empty).count() == 0


def test_ownership(spark):
    """A value that several owners have is an example; one owner's stays live, however often it repeats."""
    rows = [(i, f"token = copiedexample{'x' * 8}", f"s{i}") for i in range(4)] + [(10 + i, "password: hunter2hunter2", "own") for i in range(3)]
    rows += [(20, "key ghp_" + "Q7" * 18, "s1"), (21, None, None), (22, "", "s2")]
    out = {r.doc_id: r.secrets for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [(s.live, s.n_owners, s.n_repos) for s in out[2]] == [(False, 4, 4)]
    assert [(s.live, s.n_owners, s.n_repos) for s in out[11]] == [(True, 1, 3)]
    assert [s.kind for s in out[20]] == ["format"]
    assert out[21] == out[22] == []


def test_repositories_decide(spark):
    """Enough owners, but too few repositories: the value stays live until one more repository has it."""
    text = "token = sharedvalue99"
    rows = [(i, text, f"owner{i % 4}", f"repo{i % 5}") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    live = lambda t: {(s.live, s.n_owners, s.n_repos) for r in scan_secrets(t, most_owners=3, most_repos=20, repo_col="repo").collect() for s in r.secrets}
    assert live(table) == {(True, 4, 20)}
    more = table.unionByName(spark.createDataFrame([(99, text, "owner0", "another")], table.schema))
    assert live(more) == {(False, 4, 21)}


@pytest.mark.parametrize(("text", "whole", "tail"), [
    ("to j\u043ehn@example.org now", "j\u043ehn@example.org", "hn@example.org"),
    ("to jo\u200bhn@example.org now", "jo\u200bhn@example.org", "hn@example.org"),
])
def test_disguised_local_part(text, whole, tail):
    """The plain tail stays a base span; the whole identifier is found too."""
    found = [(s["kind"], text[s["start"] : s["end"]], s["base"]) for s in spans(text)]
    assert found == [("email", whole, False), ("email", tail, True)]


def test_removed_inside_only():
    text = "card 4111\u200b1111\u200b1111\u200b1111 ok, a@b.org\u200b"
    found = [(s["kind"], text[s["start"] : s["end"]], s["base"]) for s in spans(text)]
    assert found == [("card", "4111\u200b1111\u200b1111\u200b1111", False), ("email", "a@b.org", True)]


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("write to anna at firma dot de please", "email", "anna at firma dot de"),
    ("write to anna at mail dot firma [dot] fr.", "email", "anna at mail dot firma [dot] fr"),
    ("Ruf plus vier neun drei null eins zwei drei vier fünf sechs sieben an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben"),
    ("appelez plus trois trois un deux trois quatre cinq six sept huit neuf", "phone", "plus trois trois un deux trois quatre cinq six sept huit neuf"),
    ("llame al más tres cuatro nueve uno dos tres cuatro cinco seis siete ocho", "phone", "más tres cuatro nueve uno dos tres cuatro cinco seis siete ocho"),
    ("call plus one ſeven ſix five one two three four five ſix seven", "phone", "plus one ſeven ſix five one two three four five ſix seven"),
])
def test_disguised_in_other_languages(text, kind, part):
    assert (kind, part) in [(s["kind"], text[s["start"] : s["end"]]) for s in spans(text) if not s["base"]]


@pytest.mark.parametrize("text", ["look at firma.de for more", "meet at 3 dot 5 today", "a at " * 20_000 + "b.c dot d", "un deux trois soleil"])
def test_clean_in_other_languages(text):
    assert [s for s in spans(text) if not s["base"]] == []


def test_copied_widely(spark):
    """Two or three owners don't make an example, nor do copies of one text; a copied format token stays a span."""
    text = "Deploy notes of the team say: use token = {} and then restart the service"
    rows = [(i, text.format("twoowners99"), f"s{i}") for i in range(2)]  # copies of one text
    rows += [(10 + i, f"case {i} " + text.format("threeowners99"), f"s{i}") for i in range(3)]
    rows += [(20 + i, text.format("manycopies99").upper().lower() + " " * i, f"s{i}") for i in range(9)]
    rows += [(30 + i, f"page {i} shows ghp_" + "Q7" * 18 + " as what a token looks like", f"s{i}") for i in range(5)]
    rows += [(40 + i, f"page {i} of one owner says token = oneowner99", "s1") for i in range(9)]
    out = {r.doc_id: [(s.kind, s.live, s.n_owners, s.n_repos) for s in r.secrets] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] == out[1] == [("assign", True, 1, 1)]
    assert out[10] == [("assign", True, 3, 3)]
    assert out[25] == [("assign", True, 1, 1)]
    assert out[31] == [("format", False, 5, 5)]
    assert out[44] == [("assign", True, 1, 9)]


def planted():
    """(text, kind, identifier as disguised) for names, hosts and numbers under each disguise."""
    look = str.maketrans({"a": "а", "e": "е", "o": "о", "p": "р", "c": "с"})
    said = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))
    out = []
    for local, host, end in (("anna.b", "example", "org"), ("john99", "firma", "de"), ("maria_p", "correo", "com"), ("kontakt", "bureau", "fr")):
        plain = f"{local}@{host}.{end}"
        forms = [plain.translate(look), f"{local} [at] {host} [dot] {end}", f"{local} (at) {host} (dot) {end}", f"{local} at {host} dot {end}", f"{local}@{host} dot {end}", f"{local}\u200b@{host}.{end}", f"{local}@{host}.{end}".replace("@", "\uff20")]
        out += [("email", f) for f in forms]
    for digits in ("4915123456789", "34911234567"):
        out += [("phone", "plus " + " ".join(said[c] for c in digits)), ("phone", "+" + digits[:2] + " " + "".join(chr(0xFF10 + int(c)) for c in digits[2:]))]
    for ip in ("10.20.30.40", "192.168.1.9"):
        out += [("ip", ip.replace(".", "\u2024")), ("ip", ip.replace(".", " [dot] ")), ("ip", "".join(chr(0x1D7CE + int(c)) if c.isdigit() else c for c in ip))]
    card = "4111111111111111"
    out += [("card", "".join(chr(0x0660 + int(c)) for c in card)), ("card", " ".join(said[c] for c in card))]
    return [(f"Bitte, der Text davor; {form} und danach mehr.", kind, form) for kind, form in out]


CLEAN = (
    "I was at google.com yesterday", "meet at noon at example.com", "look at this. one two many", "un dos tres, dijo", "he arrived at 10.30 and left at 11.45", "prices: one, two or three euro",
    "the dot on the map is at home", "version 1.2.3 was better than 1.2", "une des deux maisons", "Er kam um acht, nicht um neun", "call me at five", "α + β = γ in 2020", "see [at] the end", "a – b – c", "naïve café at the corner",
    "room 4.2 at example.com", "version 2 at google.com is out", "open at 9.30 at cafe.com", "write it down at example.com", "contact us at example.com", "reach me at example.com", "we met. Mail arrived late at example.com",
    "the address is here at example.com", "schreib uns at example.com", "chapter 12 at books.org", "a mail from the shop at example.com", "1.5 at stats.net or 20% at shop.com",
)


def test_planted_disguises_recall_and_precision():
    cases = planted()
    hits = 0
    for text, kind, form in cases:
        at = text.index(form)
        hits += any(s["kind"] == kind and s["start"] <= at and s["end"] >= at + len(form) for s in spans(text))
    assert hits >= 0.9 * len(cases), (hits, len(cases))
    wrong = [t for t in CLEAN if any(not s["base"] for s in spans(t))]
    assert not wrong
