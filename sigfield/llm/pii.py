"""Operator 7: personal data, with offset-preserving deobfuscation.

``base_spans`` finds plainly written identifiers. ``normalise`` runs transducers over a text that shows
a sign of disguise: look-alike characters become ASCII, invisible ones go, spelled digits become digits,
and written-out or bracketed at and dot become ``@`` and ``.``. Every normalised character keeps the span
of source characters it stands for, so an identifier found in the normalised text maps back to the source.
Such a span is added where its source reads otherwise and no base span of its kind holds it; the base span
of a part of it stays.

Offsets count code points, ends are exclusive. A null or empty text has no spans; repeated rows are
searched each; an empty table gives an empty result; other columns are never read. All scans are linear
in the text, however long its runs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfield.llm.words import slabs, text_of
from sigfield.runtime import ship

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}|[0-9]++")  # a run of digits that starts none is passed as a whole
_DOTTED = re.compile(r"\.[0-9]+\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits' Luhn sum is divisible by 10."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind that pass their test, by start, then kind."""
    out = [("email", *x) for x in _emails(text)]
    for m in _IP.finditer(text) if _DOTTED.search(text) else ():
        if "." in m[0] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# fixed values: letters of other scripts that look like ASCII letters, and characters without width
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "∙": "."}
INVISIBLE = "­​‌‍⁠﻿"
# fixed values: the words for 0 to 9 in English, German, French and Spanish, with and without accents
DIGITS = (
    "zero|oh|null|zéro|cero", "one|eins|un|une|uno|una", "two|zwei|zwo|deux|dos", "three|drei|trois|tres", "four|vier|quatre|cuatro",
    "five|fünf|fuenf|cinq|cinco", "six|sechs|seis", "seven|sieben|sept|siete", "eight|acht|huit|ocho", "nine|neun|neuf|nueve",
)
# fixed values: words about mail in the four languages, what may stand between them and a mailbox, and words that are none
_CUE = re.compile(r"\b(?:e-?mails?|mail|mailto|contact|write|reach|address|kontakt|schreib\w*|adresse|courriel|écri\w*|correo|escrib\w*|contacto)\b[^\w.!?]*(?:(?:to|me|us|is|for|an|unter|ist|à|est|a|en|es)\b[^\w.!?]+){0,2}$", re.I)
NO_MAILBOX = frozenset("me us him her them it you one here there now back down up in out again directly mich uns ihn sie ihm dir euch hier dort nous moi lui leur ici là nos ella ellos aquí to is".split())
ENDINGS = "com|org|net|edu|gov|io|co|info"


@cache
def _glyphs() -> dict[str, str]:
    """What each disguised character stands for: compatibility forms of ASCII characters by rule."""
    out = dict.fromkeys(INVISIBLE, "") | LOOKALIKES
    for lo, hi in ((0x0660, 0x066A), (0x06F0, 0x06FA), (0x2070, 0x208F), (0x2460, 0x249C), (0x24B6, 0x24EA), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for c in map(chr, range(lo, hi)):
            plain = unicodedata.normalize("NFKC", c)
            if plain == c and (d := unicodedata.digit(c, None)) is not None:
                plain = str(d)
            if len(plain) == 1 and plain.isascii() and c not in out:
                out[c] = plain
    return out


@cache
def _patterns() -> dict[str, re.Pattern]:
    digit = "(?:" + "|".join(DIGITS) + r")\b"
    label, gap = "[A-Za-z0-9-]", r"[\x20\t]"
    at = rf"{gap}*[\[({{<]{gap}*(?:at|arroba|@){gap}*[\])}}>]{gap}*"
    dot = rf"{gap}*[\[({{<]{gap}*(?:dot|punto|punkt|point|\.){gap}*[\])}}>]{gap}*"
    return {
        "bracketed": re.compile(rf"[\[({{<]{gap}*(?:at|arroba|@|dot|punto|punkt|point|\.){gap}*[\])}}>]", re.I),
        "at_host": re.compile(rf"{gap}at{gap}+[a-z0-9.-]{{1,80}}\.(?:{ENDINGS})\b", re.I),
        "digits": re.compile(rf"(?:\b(?:plus|más|mas)[\x20-]+)?\b{digit}(?:[\x20,-]{{1,2}}{digit}){{2,}}", re.I),
        "digit": re.compile(r"\b(?:" + "|".join(f"({words})" for words in DIGITS) + r")\b", re.I),
        "at": re.compile(at, re.I),
        "dot": re.compile(dot, re.I),
        "bare_dot": re.compile(rf"(?<=[A-Za-z0-9]){gap}+dot{gap}+(?=[A-Za-z0-9])", re.I),
        "bare_at": re.compile(rf"(?<=[A-Za-z0-9]){gap}+at{gap}+(?={label}{{1,63}}(?:\.{label}{{1,63}}){{0,4}}\.(?:{ENDINGS})(?![A-Za-z0-9]))", re.I),
        "said_at": re.compile(rf"(?<=[A-Za-z0-9]){gap}+at{gap}+(?={label})", re.I),
    }


class Mapped:
    """A text whose characters know their source: character i stands for source[lo[i]:hi[i]]."""

    def __init__(self, text: str):
        self.text, self.lo, self.hi, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Put each string for its span; edits come in order and don't overlap."""
        text, lo, hi, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text += self.text[at:a], new
            lo += self.lo[at:a]
            hi += self.hi[at:a]
            changed += self.changed[at:a]
            if b > a:
                lo += [self.lo[a]] * len(new)
                hi += [self.hi[b - 1]] * len(new)
                changed += b"\1" * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.lo, self.hi, self.changed = lo + self.lo[at:], hi + self.hi[at:], changed + self.changed[at:]


_WORD = re.compile(r"\w+")


def _signs(text: str) -> bool:
    """Whether a text shows a sign of disguise other than look-alikes; cheap tests come first."""
    p, low = _patterns(), text.lower()
    if any(c in text for c in "[({<") and p["bracketed"].search(text):
        return True
    if "dot" in low and re.search(r"[\x20\t]dot[\x20\t]", low):
        return True
    if "at" in low and "." in low and p["at_host"].search(text):
        return True
    words = _WORD.findall(low)
    digits = _digit_words()
    return not digits.isdisjoint(words) and any(a in digits and b in digits for a, b in zip(words, words[1:]))


@cache
def _digit_words() -> frozenset[str]:
    return frozenset("|".join(DIGITS).split("|"))


def normalise(text: str) -> Mapped | None:
    """The text without disguises, or None if it shows no sign of any."""
    p, glyphs = _patterns(), _glyphs()
    odd = not text.isascii() and not glyphs.keys().isdisjoint(text)
    if not odd and not _signs(text):
        return None
    m = Mapped(text)
    if odd:
        m.replace([(i, i + 1, glyphs[c]) for i, c in enumerate(text) if c in glyphs])
    said = lambda s: ("+" if s[0] in "PpMm" else "") + "".join(str(d.lastindex - 1) for d in p["digit"].finditer(s))
    m.replace([(x.start(), x.end(), said(x[0])) for x in p["digits"].finditer(m.text)])
    for step, sign in (("at", "@"), ("dot", "."), ("bare_dot", ".")):
        m.replace([(x.start(), x.end(), sign) for x in p[step].finditer(m.text)])
    m.replace([(x.start(), x.end(), "@") for x in p["bare_at"].finditer(m.text) if _named(m.text, x.start())])
    m.replace([(x.start(), x.end(), "@") for x in p["said_at"].finditer(m.text) if _said(m, x.end())])
    return m


def _named(text: str, at: int) -> bool:
    """Whether the word before a bare "at" reads as a mailbox although the host is plain: it has letters, and a digit or
    mark inside too; or a word about mail comes right before it, but for small words, and it is no pronoun or adverb."""
    start = at
    while start > 0 and text[start - 1] in _LOCAL:
        start -= 1
    local = text[start:at]
    if not any(c.isalpha() for c in local):
        return False
    if re.search(r"[A-Za-z][0-9._%+]|[0-9._%+][A-Za-z]", local):
        return True
    return local.lower() not in NO_MAILBOX and bool(_CUE.search(text[max(0, start - 60) : start]))


def _said(m: Mapped, at: int) -> bool:
    """Whether the host that starts there ends in letters and has a dot that was written otherwise."""
    host = _DOMAIN.match(m.text, at)
    last = host and host[0].rsplit(".", 1)[1]
    return bool(last) and len(last) > 1 and last.isalpha() and any(m.text[i] == "." and m.changed[i] for i in range(at, host.end()))


def spans(text: str) -> list[dict]:
    """All spans of a text by start, then kind; base tells which the plain patterns found."""
    found = base_spans(text)
    out = [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in found]
    if (m := normalise(text)) is not None:
        taken = {k: [(a, b) for kind, a, b in found if kind == k] for k in KINDS}
        for k, x, y in base_spans(m.text):
            a, b = m.lo[x], m.hi[y - 1]
            undone = b - a != y - x or any(m.changed[x:y])  # what is removed leaves no changed character
            if undone and not any(c <= a and b <= d for c, d in taken[k]):
                out.append({"kind": k, "start": a, "end": b, "base": False})
        out.sort(key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column and ``spans``, an array of (kind, start, end, base)."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slabs(b):
                rows = [spans(x) if x else [] for x in text_of(t).to_pylist()]
                yield pa.RecordBatch.from_arrays([text_of(t, id_col), pa.array(rows, kind)], [id_col, "spans"])

    kept = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, T.StructType([kept.schema[0], T.StructField("spans", T.ArrayType(SPAN))]))
