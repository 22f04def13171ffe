import random
import zlib

import numpy as np

from tessera.llm.quality import DIAGONAL, POOL, STATISTICS, Discriminant, _discriminant, fit, keep_good, quality_scores, statistics


def corpus(n=300):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(20, 200))]
        good = i % 3 != 0
        text = " ".join(words) + "." if good else " | ".join(words) if i % 2 else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    out = quality_scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = dict(labels)
    held = [r for r in out if r.held_out]
    assert len(out) == len(docs) and held
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_scores_are_the_density_ratio():
    rng = np.random.default_rng(0)
    d = len(STATISTICS)
    x = rng.normal(size=(50, d))
    counts, sums, products = np.array([20.0, 30.0]), np.array([x[:20].sum(0), x[20:].sum(0)]), np.array([x[:20].T @ x[:20], x[20:].T @ x[20:]])
    model = _discriminant(counts, sums, products, 0.3, 0.2)
    logs = []
    for k in (0, 1):
        c = np.linalg.inv(model.whiten[k].T @ model.whiten[k])
        logs.append([-0.5 * (v - model.means[k]) @ np.linalg.solve(c, v - model.means[k]) - 0.5 * np.linalg.slogdet(c)[1] + model.log_prior[k] for v in x])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.array(logs[0]) - np.array(logs[1]))))
    assert isinstance(model, Discriminant)


def test_edges_of_input(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a", "s"), (2, None, None), (None, "", "s"), (1, "a", "s"), (9, "x" * 300_000, "s")], "doc_id long, text string, stats string")
    out = quality_scores(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality_scores(docs.limit(0), labels.limit(0)).count() == 0
    assert keep_good(docs, labels).columns == docs.columns
    assert all(np.isfinite(statistics(t)).all() for t in (b"", b" ", b"!!!", b"A" * 99, "é|".encode() * 50))


def test_fit_counts_repeated_labels_and_takes_a_bounded_sample(spark):
    docs, labels = corpus(200)
    more = [*labels, labels[0], labels[0], (2, 1 - dict(labels)[2])]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(more, "doc_id long, quality int")
    x = {i: np.array(statistics(t.encode())) for i, t in docs}
    own = [np.array([x[i] for i, q in more if q == k and zlib.crc32(str(i).encode()) % 3 != 1]) for k in (0, 1)]
    want = _discriminant(np.array([float(len(o)) for o in own]), np.array([o.sum(0) for o in own]), np.array([o.T @ o for o in own]), POOL, DIAGONAL)
    got = fit(*tables)
    assert np.allclose(got.means, want.means) and np.allclose(got.whiten, want.whiten) and np.allclose(got.log_prior, want.log_prior)
    few = fit(*tables, rows=40)
    assert not np.allclose(few.means, want.means)
