import random

import numpy as np
import pytest

from tessera.operators.batching import FIELDS, batch_numbers, composed, slab_pieces


def plain(sizes, limit, used=0, number=0):
    out = []
    for i, size in enumerate(sizes):
        if used > 0 and used + size > limit:
            used, number = 0, number + 1
        used += size
        out.append((used, number))
    return out


def applied(pieces, u):
    (hit,) = [p for p in pieces[FIELDS].itertuples(index=False) if p.lo < u <= p.hi]
    return hit.held + (u if hit.shift else 0), hit.more


@pytest.mark.parametrize("limit", [0, 1, 7, 20, 100])
def test_functions_of_slabs(limit):
    rng = random.Random(limit)
    for _ in range(8):
        some = [np.array([rng.choice([0, 0, 1, 2, 5, 9, 30]) for _ in range(rng.randrange(1, 12))]) for _ in range(3)]
        one, two, three = (slab_pieces(s, limit) for s in some)
        both, other = composed(composed(one, two), three), composed(one, composed(two, three))
        for u in {0, 1, 2, *range(3, 110, 4), limit, limit + 1, limit + 30}:
            assert applied(one, u) == plain(some[0], limit, u)[-1]
            assert applied(both, u) == plain(np.concatenate(some), limit, u)[-1]
            assert applied(other, u) == applied(both, u)


@pytest.mark.parametrize("slabs,limit", [(None, 50), (13, 0), (13, 50), (13, 4000), (40, 300)])
def test_large_parts_against_a_plain_loop(spark, slabs, limit):
    """One part holds most rows, others a few or one; sizes of nothing, too large ones, nulls."""
    rng = random.Random(slabs)
    rows = [(rng.choice(["big"] * 8 + ["a", "b", None, f"p{i % 40}"]), i, rng.choice([0, 0, None, 3, 10, 20, 49, 51, 700])) for i in range(900)]
    table = spark.createDataFrame(rows, "part string, seq long, size long").repartition(5)
    want = {}
    for part in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == part), key=lambda r: r[1])
        want |= {r[1]: n for r, (_, n) in zip(own, plain([r[2] or 0 for r in own], limit))}
    got = batch_numbers(table, "size", limit, slabs=slabs).collect()
    assert len(got) == 900 and {r.seq: r.batch_no for r in got} == want


def test_one_part_and_clashing_names(spark):
    rows = [(i % 7, i, 5, 9, "x") for i in range(400)]
    table = spark.createDataFrame(rows, "_slab int, seq long, size int, _first int, _used string").selectExpr("*", "1.5D AS part", "map('k', seq) AS m")
    got = batch_numbers(table, "size", 12, slabs=9)
    assert got.columns == [*table.columns, "batch_no"]
    assert {r.seq: (r.batch_no, r._slab, r._used, r.m["k"]) for r in got.collect()} == {i: (i // 2, i % 7, "x", i) for i in range(400)}
    same = spark.createDataFrame([("p", None, 4)] * 50, "part string, seq long, size long")
    assert sorted(r.batch_no for r in batch_numbers(same, "size", 8, slabs=6).collect()) == [i // 2 for i in range(50)]
    nan = spark.createDataFrame([(float("nan"), i, 4) for i in range(60)], "part double, seq long, size long")
    assert {r.seq: r.batch_no for r in batch_numbers(nan, "size", 8, slabs=6).collect()} == {i: i // 2 for i in range(60)}
    assert batch_numbers(same.limit(0), "size", 8, slabs=6).count() == 0
