import random
import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet
import pytest

from tessera.llm.pii import KINDS, SURE, base_spans, candidates, fit, personal_data, traits, votes


def plain(text):
    """The base patterns as they are written down."""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x-y", ".", "com", " ", "é", "1", "25", "255", "256", ".7", "+1", "(017)", " 555", "-7713", "4111111111111111", "4111 1111 1111 1111", "-", "0", "%+"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        assert base_spans(text)[0] == plain(text), text


def test_long_runs_stay_cheap():
    assert base_spans("a" * 2_000_000) == ([], []) and len(base_spans("1." * 300_000)[0]) == 75_000
    assert candidates("@" * 100_000 + "A" * 100_000)[0] == []


def test_em_finds_reliable_labelers():
    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        truth = rng.random() < 0.5
        vote = lambda p: (1 if truth else -1) if rng.random() < p else (-1 if truth else 1)
        rows.append(([vote(0.95), vote(0.9), vote(0.6), rng.choice([-1, 1]), 0], [3, 2, 3 if truth else 1, 1, 1, 1, 0, 0, 0], 1))
    model = fit(rows)
    share = lambda k: model.reliability[k, 1, 2]
    assert share(0) > 0.9 > share(2) and abs(share(3) - 0.5) < 0.1
    good, bad = model.probability([[3, 2, 3, 1, 1, 1, 0, 0, 0], [3, 2, 1, 1, 1, 1, 0, 0, 0]])
    assert good > 0.85 and bad < 0.15


def test_table(spark):
    rows = [(1, "é mail a.b@c.org and +1 (017) 555-7713."), (2, None), (None, ""), (3, "x " * 90_000 + "4111 1111 1111 1111"), (1, "é mail a.b@c.org and +1 (017) 555-7713."), (4, "from 10.0.0.256 or 10.0.0.25")]
    rows += [(100 + i, f"please call phone (017) 555-{1000 + 7 * i} or write james{i}@mail.com, Mary Smith") for i in range(30)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, found int")
    out = personal_data(docs).collect()
    assert len(out) == len(rows)
    assert sorted((repr(r.doc_id), [tuple(s) for s in r.base]) for r in out) == sorted((repr(d), plain(t or "")) for d, t in rows)
    for r in out:
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
        assert [KINDS.index(s.kind) for s in r.spans] == sorted(KINDS.index(s.kind) for s in r.spans)
    assert any(len(r.spans) > len(r.base) for r in out)
    assert personal_data(docs.limit(0)).count() == 0


def test_candidates_are_not_gated_by_the_whole_text():
    found = lambda text: [(k, text[a:b]) for k, a, b in candidates(text)[1]]
    assert found("call (212) 555 1234 now") == [("phone", "(212) 555 1234")]
    assert found("to joe [At] mail (dOT) com") == [("email", "joe [At] mail (dOT) com")] and found("to joe(aT)mail.com") == [("email", "joe(aT)mail.com")]
    assert found("said Zelda Smith and then Contact James Brown") == [("name", "James Brown")]


#: Lines written by hand and the kinds of personal data in them.
LINES = [
    ("write to bob.miller [at] mail (dot) org today", ["email"]),
    ("Contact: anna(at)host.example.net", ["email"]),
    ("SSN 219-09-9999 on file", ["ssn"]),
    ("his social security number is 078-05-1120.", ["ssn"]),
    ("IBAN DE89 3704 0044 0532 0130 00 please", ["iban"]),
    ("pay to GB29NWBK60161331926819 now", ["iban"]),
    ("call (212) 555 0187 after six", ["phone"]),
    ("tel. 030 1234567 or mail", ["phone"]),
    ("phone: 555-867-5309", ["phone"]),
    ("Mary Johnson lives here", ["name"]),
    ("Dear John Smith, thanks", ["name"]),
    ("signed, Peter Brown, phone 555-123-4567", ["name", "phone"]),
    ("account FR7630006000011234567890189", ["iban"]),
    ("meet me [at] noon (the usual place)", []),
    ("version 2019-09-9999 shipped", []),
    ("New York is far", []),
    ("The Big Sleep is a film", []),
    ("order 123-45-678901", []),
    ("ISBN 978-3-16-148410-0", []),
    ("see rows 100-200-3000 of it", []),
    ("GB12ABCD is a part number", []),
    ("Open Source Software", []),
    ("range 555-1234", []),
    ("Visual Studio Code", []),
    ("DE99 0000 0000 0000 0000 00 is not one", []),
    ("Machine Learning Models", []),
    ("1999 2000 2001 2002", []),
    ("build 212 555 0187 files", []),
]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no corpus to estimate the labelers on")
def test_added_spans_on_lines_written_by_hand():
    corpus = pyarrow.parquet.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    patterns = Counter()
    for text in [*corpus, *(t for t, _ in LINES)]:
        for base, spans in zip((True, False), candidates(text or "")):
            patterns.update((tuple(votes(text, *s, base)), tuple(traits(text, *s))) for s in spans)
    assert len(patterns) < 500
    model = fit(sorted((list(v), list(x), n) for (v, x), n in patterns.items()))
    right = wrong = missed = 0
    for text, kinds in LINES:
        base, loose = candidates(text)
        found = Counter([k for k, *_ in base] + [s[0] for s in loose if model.probability([traits(text, *s)])[0] >= SURE])
        want = Counter(kinds)
        right += sum((found & want).values())
        wrong += sum((found - want).values())
        missed += sum((want - found).values())
    assert right / (right + wrong) >= 0.75 and right / (right + missed) >= 0.8, (right, wrong, missed)
