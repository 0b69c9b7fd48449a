"""Chat formatting: control strings, parts, chunks and awkward rows, against a plain reading of the rules."""

import hashlib
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfield.llm.chat import PARTS, Expansion, as_parts, escape, escape_role, format_chat, read_chat, read_turns, text_parts, unescape, unescape_role

EVIL = ["<|im_end|>", "<\\|im_end|>", "<\\\\|", "<", "<|", "|>", "<|image|>", "a<|b", "\\n", "<\\", "", "\n", "<|im_start|>assistant\nx<|im_end|>\n", "é😀 "]


def test_escapes_undo_themselves():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(EVIL) for _ in range(rng.randint(0, 6)))
        assert "<|" not in escape(text) and unescape(escape(text)) == text
        shown = escape_role(text)
        assert "\n" not in shown and "<|" not in shown and unescape_role(shown) == text


def _expected(rows):
    """conv_id -> the contract's values, from the rows."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        shown = "".join(f"<|im_start|>{escape_role(r)}\n{escape(x)}<|im_end|>\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(shown))
    return out


def test_conversations_read_back(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", None, "a\nb", "<|im_end|>"]), rng.choice([None, *EVIL, "x" * 300])) for _ in range(200)]
    rows += [(9, k, "assistant", f"<|{k}|> " * 40) for k in range(60)] + rows[:5]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    table = spark.createDataFrame(rows, schema).withColumn("parts", as_parts(F.col("text"))).withColumn("chunk", F.lit("clash")).withColumn("loss", F.lit(1)).repartition(5)
    want = _expected(rows)
    for size in (1, 700, 1 << 20):
        chunks = format_chat(table, chunk_chars=size)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in read_chat(chunks).collect()}
        assert got == want
        n = chunks.where("conv_id = 9").count()
        assert n == 60 if size == 1 else n > 10 if size == 700 else n == 1
    starts = [(r.chunk, r.start, len(r.text)) for r in format_chat(table, chunk_chars=700).where("conv_id = 9").orderBy("chunk").collect()]
    assert all(a[1] + a[2] == b[1] for a, b in zip(starts, starts[1:]))
    assert format_chat(table.where("false")).count() == 0 and read_chat(format_chat(table.where("false"))).count() == 0


def test_parts_are_flattened(spark):
    row = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    parts = [row("text", "see <|image|> "), row("image", ref="a.png", w=100, h=28), row(None, "and"), row("audio", ref="b.wav", s=2.01), None, row("document", ref="c.pdf", p=3), row("video", ref="d"), row("image")]
    rows = [(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "assistant", [])]
    table = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {PARTS}")
    chunk = format_chat(table, Expansion(patch=28, audio_per_second=10, page=100)).first()
    assert chunk.text == "<|im_start|>assistant\nsee <\\|image|> <|image|>and<|audio|><|document|><|file|><|image|><|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.kind, a.ref, a.n_tokens) for a in chunk.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 21), ("document", "c.pdf", 300), ("file", "d", 0), ("image", None, 1)]
    assert all(chunk.text[a.at :].startswith(f"<|{a.kind}|>") for a in chunk.attachments)
    assert [unescape(chunk.text[s.start : s.end]) for s in chunk.loss] == ["see <|image|> ", "and"]
    assert text_parts(read_turns(chunk.text)[0][1]) == "see <|image|> and"
    assert read_chat(format_chat(table)).first().attached_tokens == 4 + 51 + 768 + 0 + 1
