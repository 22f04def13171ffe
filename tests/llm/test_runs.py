import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm.queries import queries
from tessera.llm.runs import Ends, collapsed, periodic_runs, run_digests, runs, stretches


def brute(words):
    """All runs straight from the definition."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            smaller = any(all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def random_words(rng):
    words = []
    while len(words) < rng.randrange(1, 90):
        root = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 9))]
        words += (root * rng.randrange(1, 8))[: rng.randrange(1, 40)]
    return words


def test_runs_against_brute_force():
    rng = random.Random(1)
    total = 0
    for _ in range(1500):
        words = random_words(rng)
        got = runs(words)
        assert got == brute(words), words
        total += len(got)
        gone = {i for s, length, q in got for i in range(s + q, s + length)}
        assert collapsed(words, got) == [w for i, w in enumerate(words) if i not in gone]
    assert total > 1000


def test_every_short_binary_word():
    for n in range(6, 14):
        for bits in range(1 << n):
            words = [bits >> i & 1 for i in range(n)]
            assert runs(words) == brute(words)


def test_prose_is_left_out_and_long_runs_are_quick():
    rng = random.Random(2)
    prose = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    assert stretches(np.unique(prose, return_inverse=True)[1]) == []
    assert runs(["a"] * 60_000) == [(0, 60_000, 1)]
    root = [f"w{i}" for i in range(700)]
    assert runs([*prose[:50], *root * 30, *root[:9]]) == [(50, 700 * 30 + 9, 700)]


def test_ordered_sets():
    rng = random.Random(3)
    numbers, own = rng.sample(range(100_000), 5000), Ends()
    seen = []
    for x in numbers:
        before, after = own.add(x)
        assert before == max((y for y in seen[-200:] if y < x), default=None) or before in seen
        seen.append(x)
        assert (before is None or before < x) and (after is None or after > x)
    assert list(own) == sorted(numbers) and own.size == 5000


def test_rows(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "é é é é é é x", "x " * 5000, "A a " * 6, "\x0b".join("abab" * 3)]
    texts += [" ".join(random_words(rng)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "b b b b b b b")]
    docs = spark.createDataFrame([(t, i, "extra", 3) for i, t in rows], "text string, doc_id long, n_runs string, runs int").repartition(3)
    plain = lambda i, t: brute_row(None, t)[1:]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, run_digests(docs).collect()), key=key) == sorted(((i, *plain(i, t)) for i, t in rows), key=key)
    for r in periodic_runs(docs).collect():
        text = dict(rows)[r.doc_id]
        assert r.n_words == len((text or "").split()) and [tuple(x) for x in r.runs] == brute((text or "").split())
    assert run_digests(docs.limit(0)).count() == 0 and periodic_runs(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(random_words(rng)) if i % 3 else " \n".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 120)))) for i in range(400)]
    rows += [(401, None), (402, ""), (None, "z z z z z z z z"), (5, rows[5][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["op13_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, out.collect()), key=key)
    assert got == sorted((brute_row(i, t) for i, t in rows), key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and r[1] for i, r in ((r[0], r) for r in got if r[0] is not None))


@pytest.mark.parametrize("words", [list("abcabcabcabc"), list("aabaabaabaabaab")])
def test_ends_of_runs(words):
    assert runs(["x", *words, "y"]) == [(s + 1, length, q) for s, length, q in brute(words)]
