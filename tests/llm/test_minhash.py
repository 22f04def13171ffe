import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.minhash import SKETCH, _possible, band_keys, drop_near_copies, near_copy_groups, shingles, sketch


def brute(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def edited():
    """Texts of 150 words and copies with 0 to 6 changed places, some of them under an index of 0.8; chains too."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(500)}"
    texts = []
    for _ in range(40):
        body = [word() for _ in range(150)]
        texts.append(" ".join(body))
        for changes in rng.sample(range(7), 3):
            for at in rng.sample(range(150), changes):
                body = [*body[:at], word(), *body[at + 1 :]]
            texts.append(" ".join(body))
    return [*texts, None, "", "  ", "one two", "One  two", texts[0]]


def large_group():
    """Copies of one text with edits of their own, most pairs of which stay under an index of 0.8, and another group."""
    rng = random.Random(9)
    texts = []
    for size, copies in ((120, 220), (90, 60)):
        body = [f"v{rng.randrange(900)}" for _ in range(size)]
        for _ in range(copies):
            own = [*body]
            for at in rng.sample(range(size), rng.randrange(1, 4)):
                own[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("texts,crowd", [(edited(), 50), (large_group(), 50), (large_group(), 2)])
def test_groups_against_brute_force(spark, monkeypatch, texts, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    sets = [brute(t) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in range(len(texts)) if near(sets[i], sets[j])) for i in range(len(texts))]
        if new == label:
            break
        label = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copy_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == label and 1 < len(set(label)) < 140
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == sorted(set(label))


def test_pipeline_stage_drops_edited_copies(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    body = [f"w{rng.randrange(500)}" for _ in range(200)]
    copy = [*body]
    for at in (10, 60, 110, 160):
        copy[at] = "changed"
    docs = spark.createDataFrame([(1, " ".join(body), "x"), (2, " ".join(copy), "y"), (3, "another text of some words here", "z"), (None, "another text of some words here", "z")], "doc_id long, text string, node string")
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3]


def test_keys_of_long_texts_in_blocks():
    own = shingles(" ".join(str(i) for i in range(10_000)).encode())
    assert len(own) == 9_996 and len(set(band_keys(own).tolist())) == 20


def test_sketches_never_rule_out_a_pair_within_the_index(spark):
    texts = [*edited(), *large_group()]
    sets = [shingles((t or "").encode()) for t in texts]
    rows = [(i, (len(s), *map(int, sketch(s)))) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, f"i int, d struct<n:long,{','.join(f's{k}:long' for k in range(SKETCH))}>")
    other = table.selectExpr("i as j", "d as e")
    got = {(r.i, r.j) for r in table.crossJoin(other).filter("i < j").filter(_possible(F.col("d"), F.col("e"), 0.8)).select("i", "j").collect()}
    near = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(set(a.tolist()) & set(sets[j].tolist()))
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                near.add((i, j))
    assert near <= got and len(got) < 2 * len(near) and len(near) > 300


def test_long_texts_of_one_template_are_not_held_against_each_other(spark, monkeypatch):
    """Texts of 1,500 words that share 89 % in one piece: every pair has an index just under 0.8, and hardly one is verified."""
    verified = []

    def counting(pairs, sets, least, plain=minhash._verified):
        verified.append(pairs.count())
        return plain(pairs, sets, least)

    monkeypatch.setattr(minhash, "_verified", counting)
    rng = random.Random(11)
    template = [f"t{rng.randrange(3000)}" for _ in range(1320)]
    texts = [" ".join([*template, *(f"x{rng.randrange(10**6)}" for _ in range(180))]) for _ in range(300)]
    sets = [brute(t) for t in texts[:2]]
    assert 0.76 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8
    texts += [" ".join([*texts[i].split()[:-3], "some", "other", "end"]) for i in range(0, 300, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copy_groups(docs).collect()}
    assert got == {i: i for i in range(300)} | {300 + k: 30 * k for k in range(10)}
    assert sum(verified) < 310 * 309 / 2 / 10
