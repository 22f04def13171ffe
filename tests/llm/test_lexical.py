import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import lexical
from tessera.llm.lexical import ranked_search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    words = [(i, plain_terms(t)) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, terms in asked.items():
        found = []
        for key, w in words:
            m, tf = 10 + 90 * len(w) * n_docs // total, Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            if score > 0:
                found.append((-score, key is None, key, score))
        out += [(item, r + 1, key, score) for r, (_, _, key, score) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def corpus(rng, n):
    words = [f"W{i}" for i in range(60)] + ["é", "Ünd", "the", "of", "ça", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "\n", "-", "_", ", "]).join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(25)]
    return docs, items


def key(r):
    return tuple((x is None, x) for x in r)


def test_terms():
    text = "Ab_c É9ü-Z a\x00b@C[d`e{f\x7fg"
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)
    every = "".join(map(chr, range(0x250)))
    assert [t.decode() for t in terms_of(every.encode())] == plain_terms(every)


@pytest.mark.parametrize("head,k,block", [(1, 3, 1000), (1, 1, 40), (20, 10, 1000)])
def test_against_brute_force(spark, head, k, block):
    rng = random.Random(head * 10 + k)
    docs, items = corpus(rng, 300)
    docs += [(7, docs[7][1]), (500, docs[8][1]), (None, "W1 W2 W3"), (None, docs[9][1]), (600, None), (601, " -- "), (602, "the " * 3000)]
    items += [(3, "W59 ça"), (None, "the W5"), (90, None), (91, "nowhere to be found")]
    d = spark.createDataFrame([(t, i, "x", 1) for i, t in docs], "text string, doc_id long, term string, row int").repartition(3)
    out = ranked_search(d, spark.createDataFrame(items, "item_id int, text string"), k=k, head=head, block=block)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute(docs, items, k), key=key)


def test_candidates_are_shuffled_where_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SENT", 3)
    docs, items = corpus(random.Random(5), 120)
    out = ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), k=4, head=1)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((str(r[0]), *r[1:]) for r in brute(docs, items, 4)), key=key)


def test_empty_tables_and_ties(spark):
    docs = spark.createDataFrame([(i, "same words") for i in (5, 3, 9, 1)] + [(20 + i, "other text") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert [(r.rank, r.doc_id) for r in ranked_search(docs, items, k=3).orderBy("rank").collect()] == [(1, 1), (2, 3), (3, 5)]
    assert ranked_search(docs.limit(0), items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_thresholds_leave_entries_out(spark):
    """A few documents hold all terms of an item, so the frequent terms' lists are not fetched as a whole."""
    docs = [(i, "often rare1 rare2 rare3" if i < 5 else f"often f{i % 7}" + " f" * (i % 50)) for i in range(400)]
    pairs = [(0, t) for t in range(4)]
    made = lexical._Lists(pairs, 1, 4, {0: 40})
    assert made.least_of_terms() == [(t, 10) for t in range(4)]
    out = ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "often rare1 rare2 rare3")], "item_id long, text string"), k=5)
    assert [r.doc_id for r in out.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
