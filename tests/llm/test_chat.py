import hashlib
import json
import random

import pytest

from tessera.llm.chat import escape, format_conversations, parse, read_back, unescape

HARD = ["\\", "#", "##", "###", "### Assistant:", "</turn>", "<", "/", "|", "<|image:1|>", "\n", "é", "\\#", "a", ":"]


def test_escaping_is_reversible_and_hides_markers():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(HARD) for _ in range(rng.randrange(0, 9)))
        coded = escape(text)
        assert unescape(coded) == text and "##" not in coded and "</" not in coded and "<|" not in coded


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out.append((conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_table(spark, chunk):
    rng = random.Random(chunk)
    text = lambda: "".join(rng.choice(HARD) for _ in range(rng.randrange(0, 12)))
    rows = [(rng.randrange(40), rng.randrange(6), rng.choice(["user", "assistant", "system", "System", "a:b\n", ""]), text()) for _ in range(400)]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (None, None, None, None), (50, 1, "assistant", None), (51, 0, "assistant", "z " * 100_000), rows[0], rows[0]]
    rows += [(60, i, "assistant", f"turn {i}") for i in range(500)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, loss int")
    formatted = format_conversations(table, chunk)
    assert sorted((tuple(r)[:5] for r in read_back(formatted).collect()), key=repr) == plain(rows)
    assert (formatted.filter("conv_id = 60").count() > 1) == (chunk == 40)
    assert read_back(format_conversations(table.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see <|image:9|> "}, {"type": "image", "ref": "s3://a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": "done"}]
    rows = [(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", json.dumps([{"type": "text", "text": "ok"}, {"type": "image", "ref": "d"}]))]
    (row,) = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, parts string"), parts="parts").collect()
    assert [(a.number, a.type, a.ref, a.tokens) for a in row.attachments] == [(1, "image", "s3://a.png", 3), (2, "audio", "b.wav", 38), (3, "document", "c.pdf", 1536), (4, "image", "d", 1)]
    assert all(row.text[a["at"] :].startswith(f"<|{a.type}:{a.number}|>") for a in row.attachments)
    assert parse(row.text)[0] == ("user", [("text", "see <|image:9|> "), ("image", 1), ("audio", 2), ("document", 3), ("text", "done")])
    assert [row.text[s.start : s.end] for s in row.loss] == ["ok"]


def test_random_parts_are_read_back(spark):
    rng = random.Random(2)
    rows, want = [], []
    for conv in range(300):
        parts, plain, attached = [], [], 0
        for _ in range(rng.randrange(0, 7)):
            if rng.random() < 0.7:
                text = "".join(rng.choice(HARD) for _ in range(rng.randrange(0, 4)))
                parts.append(rng.choice([{"type": "text", "text": text}, {"type": None, "text": text}, {"text": text}, text]))
                if plain and plain[-1][0] == "text":
                    plain[-1] = ("text", plain[-1][1] + text)
                else:
                    plain.append(("text", text))
            else:
                kind, attached = rng.choice(["image", "audio", "document", "video"]), attached + 1
                parts.append({"type": kind, "ref": "r", "width": rng.choice([None, "x", 5, float("nan")])})
                plain.append(("other" if kind == "video" else kind, attached))
        rows.append((conv, 0, "assistant", "not this", json.dumps(parts)))
        want.append([p for p in plain if p != ("text", "")])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, p string")
    formatted = {r.conv_id: r for r in format_conversations(table, parts="p").collect()}
    for conv, parts in enumerate(want):
        assert parse(formatted[conv].text) == [("assistant", parts)], rows[conv]
        learnt = "".join(unescape(formatted[conv].text[s.start : s.end]) for s in formatted[conv].loss)
        assert learnt == "".join(t for kind, t in parts if kind == "text")
    back = {r.conv_id: r for r in read_back(format_conversations(table, parts="p")).collect()}
    assert all(back[c].loss_chars == sum(len(t) for k, t in p if k == "text") for c, p in enumerate(want))


def test_parts_that_are_none(spark):
    rows = [(1, "{broken"), (2, '{"type": "image"}'), (3, '["a<", null, 5, "/turn>"]'), (4, None), (5, ""), (6, '["\\ud800é"]')]
    table = spark.createDataFrame([(c, 0, "user", "plain", p) for c, p in rows], "conv_id long, turn long, role string, text string, p string")
    got = {r.conv_id: parse(r.text)[0][1] for r in format_conversations(table, parts="p").collect()}
    assert got == {1: [("text", "{broken")], 2: [("text", '{"type": "image"}')], 3: [("text", "a<5/turn>")], 4: [("text", "plain")], 5: [], 6: [("text", "?é")]}
    numbers = table.withColumn("parts", table["turn"])  # a column of that name that is not asked for
    assert {r.n_turns for r in format_conversations(numbers).collect()} == {1}
