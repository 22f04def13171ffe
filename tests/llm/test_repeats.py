import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats
from tessera.llm.common import heavy_join
from tessera.llm.queries import queries
from tessera.llm.repeats import anchors, common_prefix, repeated_bytes, repeated_starts, smallest, two_stage


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[a : a + length] for _, t in data for a in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.diff(np.concatenate([[0], gone.astype(int), [0]])).clip(0).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def as_rows(found):
    return [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in found.collect()]


def key(r):
    return tuple((x is None, x) for x in r)


def random_bytes(rng, n, letters=b"ab"):
    return bytes(rng.choice(letters) for _ in range(n))


def test_two_stage_is_a_suffix_array():
    rng = random.Random(1)
    for letters in (b"a", b"ab", b"abc", bytes(range(256))):
        for n in (0, 1, 2, 3, 10, 100, 400):
            data = random_bytes(rng, n, letters)
            got = two_stage(np.frombuffer(data, np.uint8), np.ones(n, bool), n + 1).tolist()
            assert got == sorted(range(n), key=lambda i: data[i:])


def test_only_smaller_suffixes_are_sorted_directly(monkeypatch):
    """The larger ones come from bucket scans: with no depth at all for the direct sort, a falling text is still right."""
    data = bytes(range(200, 100, -1)) * 1
    assert two_stage(np.frombuffer(data, np.uint8), np.ones(len(data), bool), 0).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("length", [8, 13, 40])
def test_starts_of_pieces(length):
    rng = random.Random(length)
    for _ in range(60):
        base = random_bytes(rng, 300, b"abcd")
        pieces = []
        for _ in range(rng.randrange(1, 8)):
            a = rng.randrange(0, 200)
            piece = bytearray(base[a : a + rng.randrange(length, 100 + length)].ljust(length, b"x"))
            piece[rng.randrange(len(piece))] = rng.choice(b"abcdz")
            pieces.append(bytes(piece))
        seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [[seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in pieces]
        assert [m.tolist() for m in repeated_starts(pieces, length)] == want


def test_common_prefix():
    data = np.frombuffer(b"abcdefghijklmnopabcdefghijkl0000abcdefghijklmnop", np.uint8)
    assert common_prefix(data, np.array([0, 0, 1]), np.array([16, 32, 17]), 13).tolist() == [8, 13, 8]


def test_equal_strings_have_equal_anchors():
    rng = random.Random(4)
    shared = random_bytes(rng, 60, b"abcdefgh")
    for length in (16, 40):
        texts = [random_bytes(rng, rng.randrange(0, 300), b"abcdefgh") + shared + random_bytes(rng, rng.randrange(0, 300), b"abcdefgh") for _ in range(8)]
        of = {}
        for t in [*texts, b"a" * 5000, b"", b"x" * (length - 1), b"x" * length]:
            keys, starts = anchors(t, length)
            assert starts[0] == 0 and len(starts) == len(keys) + 1 and (np.diff(starts) > 0).all() and np.diff(starts).max(initial=0) <= repeats.STARTS
            assert not len(keys) or starts[-1] == len(t) - length + 1
            for k, a, b in zip(keys.tolist(), starts[:-1].tolist(), starts[1:].tolist()):
                for at in range(a, b):
                    assert of.setdefault(t[at : at + length], k) == k


def test_long_texts_are_hashed_in_slabs(monkeypatch):
    rng = random.Random(5)
    text = random_bytes(rng, 9000, b"abcdef")
    whole = anchors(text, 40)
    monkeypatch.setattr(repeats, "SLAB", 1000)
    cut = anchors(text, 40)
    spread = lambda found: np.repeat(found[0], np.diff(found[1]))
    assert (spread(whole) == spread(cut)).all()


def test_smallest():
    values = np.random.default_rng(6).integers(0, 1000, 300)
    for width in (1, 2, 3, 7, 64, 201):
        assert smallest(values, width).tolist() == [values[i : i + width].min() for i in range(300 - width + 1)]


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(30) for _ in range(6)]
    rows = []
    for i in range(120):
        text = prose(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            text += rng.choice(passages)[rng.randrange(0, 20) :] + prose(rng.randrange(0, 20))
        rows.append((i, text))
    near = list(rows[10][1] + prose(60))
    for i in range(200, 212):
        near[rng.randrange(len(near))] = "#"
        rows.append((i, "".join(near)))
    rows += [(300 + i, rows[20][1]) for i in range(30)] + [(5, rows[5][1]), (None, rows[6][1]), (None, None), (400, None), (401, ""), (402, "z" * 700), (403, "q" * 3000), (404, "pq" * 300)]
    return rows


@pytest.mark.parametrize("crowd", [1000, 1])
def test_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = corpus(random.Random(7))
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, n string, digest int").repartition(3)
    got = sorted(as_rows(repeated_bytes(docs, length=40)), key=key)
    want = sorted(brute(rows, 40), key=key)
    assert got == want
    assert sum(0 < r[2] < r[1] for r in want) > 30


def test_empty_table_and_spans(spark):
    docs = spark.createDataFrame([(1, "é" + "0123456789" * 2 + "x"), (2, "0123456789" * 2)], "doc_id long, text string")
    assert repeated_bytes(docs.limit(0), length=20).count() == 0
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in repeated_bytes(docs, length=20).collect()}
    assert found == {1: [(2, 22)], 2: [(0, 20)]}


def test_query(spark, tmp_path):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(120))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200))) + (passage[i * 7 :] if i % 3 == 0 else "")) for i in range(40)]
    rows += [(50, rows[3][1]), (51, None), (52, "a" * 401), (53, "b" * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries()["op11_suffix_arrays"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows, 400))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_join(spark, how):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(k, 0) for k in range(2, 30)] + [(None, 7)], "k int, v int")
    right = left.filter("k < 20").groupBy("k").count().withColumnRenamed("count", "n").withColumn("w", left.k * 2)
    got = heavy_join(left, right, "k", how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right.drop("n"), "k", how).collect()))
