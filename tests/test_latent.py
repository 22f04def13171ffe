import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.latent import LatentModel, slots_of
from tessera.plans.engine import LATENT, Engine

WORDS = [f"w{i}" for i in range(60)]


def texts(n=150, seed=4):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS[12 * (i % 5) : 12 * (i % 5) + 12]) if rng.random() < 0.85 else rng.choice(WORDS) for _ in range(rng.randrange(3, 40))) for i in range(n)]
    return out + [out[0], out[0], "", None, "!? ..."]


def plain(rows, slots):
    """The weighted matrix as a whole."""
    counts = [Counter(r) for r in rows]
    df = Counter(s for c in counts for s in c)
    idf = [math.log((1 + len(rows)) / (1 + df[s])) + 1 for s in range(slots)]
    x = np.array([[(1 + math.log(c[s])) * idf[s] if s in c else 0.0 for s in range(slots)] for c in counts])
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id long, text string").repartition(3)
    return df, LatentModel.fit(df, directions=4, slots=700, rounds=8)


def test_against_numpy(fitted):
    df, model = fitted
    rows = df.select("id", slots_of(F.col("text"), 700).alias("s")).orderBy("id").collect()
    x = plain([r.s for r in rows], 700)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.singular, s[:4], rtol=1e-4)
    assert np.allclose(model.basis.T @ model.basis, np.eye(4), atol=1e-9)
    assert np.linalg.norm(model.basis @ model.basis.T - vt[:4].T @ vt[:4], 2) < 0.02
    y = x @ model.basis
    length = np.sqrt((y * y).sum(1, keepdims=True))
    got = np.array([r.v for r in df.select("id", model.vectors(F.col("text")).alias("v")).orderBy("id").collect()])
    assert np.allclose(got, y / np.where(length > 1e-12, length, np.inf), atol=1e-9)
    assert not got[-3:].any()
    topic = np.arange(150) % 5
    near = got[:150] @ got[:150].T - 2 * np.eye(150)
    assert (topic[near.argmax(1)] == topic).mean() > 0.8


def test_saved_model_gives_the_same_vectors(spark, fitted, tmp_path):
    df, model = fitted
    model.save(spark, f"{tmp_path}/m")
    other = LatentModel.load(spark, f"{tmp_path}/m")
    assert (other.basis == model.basis).all() and (other.singular == model.singular).all()
    new = spark.createDataFrame([("w1 w2 unseen",)], "text string")
    assert new.select(model.vectors(F.col("text")).alias("v")).first().v == new.select(other.vectors(F.col("text")).alias("v")).first().v


def test_few_texts_and_none(spark):
    one = spark.createDataFrame([("a b",), ("a b",)], "text string")
    model = LatentModel.fit(one, directions=3, slots=50)
    assert np.allclose(model.singular, [math.sqrt(2), 0, 0], atol=1e-6) and not model.basis[:, 1:].any()
    none = LatentModel.fit(one.limit(0), directions=2, slots=20)
    assert not none.singular.any() and one.select(none.vectors(F.col("text")).alias("v")).first().v == [0.0, 0.0]
    with pytest.raises(ValueError):
        LatentModel.fit(one, directions=9, slots=5)


def test_hybrid_search_without_an_outside_encoder(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    topics = {"shop": "cart checkout price order basket", "net": "socket packet retry timeout connect", "img": "pixel colour blur resize crop"}
    for name, words in topics.items():
        for k in range(4):
            own = words.split()
            (root / f"{name}{k}.md").write_text(" ".join(own[(k + j) % 5] for j in range(4)) + "\n")
    engine = Engine(spark, str(root), str(tmp_path / "s"), encoder=LATENT)
    engine.index_codebase()
    got = engine.search_codebase("basket", 12).collect()
    near = sorted((r.distance, r.source) for r in got if r.distance is not None)
    assert {s[:4] for _, s in near[:4]} == {"shop"} and near[3][0] < 0.2 < near[4][0]  # one of the four lacks the word
    assert got[0].source.startswith("shop")
    (root / "late.md").write_text("basket price order\n")
    engine.index_changed_files()
    assert "late.md" in {r.source for r in engine.search_codebase("order basket", 6).collect()}
    assert Engine(spark, str(root), str(tmp_path / "s"), encoder=LATENT).search_codebase("pixel crop", 3).first().source.startswith("img")
    with pytest.raises(ValueError):
        Engine(spark, str(root), str(tmp_path / "other"), encoder=LATENT).index_changed_files()


def test_words_are_counted_once_for_all_passes(spark, monkeypatch):
    """What is stored is a slot a text and its count, not every word again."""
    from tessera.operators import latent

    kept, plain = [], latent.stored

    def counted(df, name):
        out = plain(df, name)
        kept.extend((list(r.slots), list(r.counts)) for r in out.collect())
        return out

    monkeypatch.setattr(latent, "stored", counted)
    df = spark.createDataFrame([("a b a a",), ("",), (None,), ("b",)], "text string").coalesce(1)
    LatentModel.fit(df, directions=2, slots=50)
    own = sorted((sum(c), len(s)) for s, c in kept)
    assert own == [(0, 0), (0, 0), (1, 1), (4, 2)] and all(s == sorted(set(s)) for s, _ in kept)
