import random

import pytest
import xxhash

from tessera.llm import common
from tessera.llm.simhash import drop_near_duplicates, fingerprint, fingerprints, simhash_groups
from tessera.llm.simhash import close_pairs


def brute(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < k else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rng.choice(["Ab", "b\tc", "É", "d\x0be", "zz\n"]) for _ in range(n))
        assert fingerprint(text.encode()) == brute(text)


def test_long_text_in_blocks():
    text = " ".join(str(i % 977) for i in range(150_000))
    assert fingerprint(text.encode()) == brute(text)


def test_pairs_are_exact(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(150)]
    values = set(base)
    for v in base:
        for flips in (1, 2, 3):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), flips)))
    values |= {0, 1, 3, 2**64 - 1, 2**63}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    for bits in (1, 2, 3, 4):
        got = {tuple(sorted(r)) for r in close_pairs(spark.createDataFrame([(v,) for v in signed], "bits long"), bits).collect()}
        mask = (1 << 64) - 1
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= bits}
        assert got == want


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        body = [rng.choice(words) for _ in range(200)]
        texts.append(" ".join(body))
        for _ in range(rng.randrange(4)):
            other = list(body)
            other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    texts += [None, "", "  ", texts[0], texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [brute(t) for t in texts]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2) for i in range(len(rows))]
        if new == label:
            break
        label = new
    assert [got[i].component_id for i in range(len(rows))] == label
    assert [got[i].bits & ((1 << 64) - 1) for i in range(len(rows))] == prints


def test_edges_of_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, bits string")
    assert simhash_groups(empty).count() == 0
    assert drop_near_duplicates(empty).columns == ["doc_id", "text", "bits"]
    rows = [(5, "a b c", "x"), (5, "a b c", "x"), (None, "a b c", "y"), (3, "a b c", None), (9, "q r s t", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    assert sorted(r.component_id for r in simhash_groups(docs).collect()) == [3, 3, 3, 3, 9]
    assert sorted(drop_near_duplicates(docs).toPandas().doc_id.fillna(-1)) == [-1, 3, 9]
    assert fingerprints(docs).columns == ["doc_id", "bits"]


def test_one_id_with_several_texts(spark):
    rows = [(3, "a b c d"), (5, "a b c d"), (5, "q r s t u"), (7, "v w x y"), (7, "f g h i j"), (8, "v w x y")]
    docs = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, m map<string,int>")
    kept = [(r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()]
    # A row of 5 copies 3; both rows of 7 are the first of their groups, and one of them stays; 8 copies a row of 7.
    assert sorted(d for d, _ in kept) == [3, 7] and (kept[0] in rows) and (kept[1] in rows)


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    groups = simhash_groups(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x y")], "doc_id long, text string"))
    assert sorted(r.component_id for r in groups.collect()) == [1, 1, 3]
    assert [len(list(run.iterdir())) for run in tmp_path.iterdir()] == [1]


def test_the_shared_folder(spark):
    class Bare:  # a session without the setting
        def __init__(self, master):
            self.conf, self.sparkContext, self.master, self.applicationId = self, self, master, "a-1"

        def get(self, *_):
            return None

        def getConf(self):
            return self

    assert common.shared_dir(Bare("local[4]")) == common.shared_dir(Bare("local")) and common.shared_dir(Bare("local[*]")).startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Bare("spark://host:7077"))
