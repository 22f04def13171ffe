import random

import pytest

from tessera.operators import graph


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("e", "d")], "src string, dst string")


def starts(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def test_reach(spark, edges):
    down = {(r.node, r.depth) for r in graph.reach(edges, starts(spark, "a"), 2).collect()}
    assert down == {("b", 1), ("c", 1), ("d", 2)}
    assert {r.node for r in graph.reach(edges, starts(spark, "d"), 1, "upstream").collect()} == {"b", "c", "e"}
    assert {r.node for r in graph.reach(edges, starts(spark, "d"), None, "upstream").collect()} == {"a", "b", "c", "e"}
    with pytest.raises(ValueError):
        graph.reach(edges, starts(spark, "a"), 1, "sideways")


@pytest.mark.parametrize("a,b,depth,path", [("e", "c", 10, ["e", "d", "a", "c"]), ("e", "c", 2, None), ("a", "f", 10, None), ("a", "a", 10, ["a"]), ("a", "d", 10, ["a", "b", "d"])])
def test_paths(edges, a, b, depth, path):
    found = graph.shortest_path(edges, a, b, depth).collect()
    assert (found[0].path if found else None) == path


def test_impact(spark, edges):
    r = graph.change_impact(edges, starts(spark, "d", "f")).orderBy("node").collect()
    assert (r[0].direct, r[0].total, r[0].level) == (3, 4, "MEDIUM") and (r[1].total, r[1].level) == (0, "MINIMAL")


def test_clusters(spark, edges):
    got = {r.other: r.similarity for r in graph.clusters(edges, 0.3, starts(spark, "b")).collect()}
    assert got == {"c": 1.0, "e": 0.5}


def test_related_tests(spark):
    files = spark.createDataFrame([("tests/test_app.py",), ("src/app.py",), ("web/App.spec.ts",)], "path string")
    got = graph.related_tests(spark.createDataFrame([("app",)], "name string"), files)
    assert sorted(r.path for r in got.collect()) == ["tests/test_app.py", "web/App.spec.ts"]


def test_clusters_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(100, i) for i in range(60)] + [(200, 201), (None, 1), (1, None), (7, 7)]
    near = {}
    for a, b in pairs:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    df = spark.createDataFrame(pairs, "src long, dst long")
    for least in (0.0, 0.2, 0.3, 0.5, 1.0):
        want = {(a, b): round(len(near[a] & near[b]) / len(near[a] | near[b]), 6) for a in near for b in near if a != b and near[a] & near[b]}
        assert {(r.node, r.other): r.similarity for r in graph.clusters(df, least).collect()} == {k: v for k, v in want.items() if v >= least}
    some = spark.createDataFrame([(5,), (5,), (None,)], "node long")
    assert {r.node for r in graph.clusters(df, 0.2, some).collect()} <= {5} and graph.clusters(df.limit(0), 0.3).count() == 0


def test_related_tests_on_odd_rows(spark):
    files = spark.createDataFrame([("a/test_x.py", 1), ("a/test_x.py", 2), (None, 3), ("test", 4)], "path string, name int")
    names = spark.createDataFrame([("X",), ("x",), (None,), ("",), ("_x.",)], "name string")
    assert sorted(map(tuple, graph.related_tests(names, files).collect())) == [("_x.", "a/test_x.py"), ("_x.", "a/test_x.py"), ("x", "a/test_x.py"), ("x", "a/test_x.py")]


def _plain_impact(pairs):
    pairs = {(a, b) for a, b in pairs if a is not None and b is not None and a != b}
    into = {}
    for a, b in pairs:
        into.setdefault(b, set()).add(a)
    out = {}
    for n in {x for p in pairs for x in p}:
        seen, front = {n}, [n]
        while front:
            new = {m for f in front for m in into.get(f, ())} - seen
            seen |= new
            front = list(new)
        out[n] = (len(into.get(n, ())), len(seen) - 1, seen)
    return out


@pytest.mark.parametrize("seed", [1])
def test_impact_of_all_against_single_searches(spark, seed):
    rng = random.Random(seed)
    cycles = [(10 * c + i, 10 * c + (i + 1) % 5) for c in range(12) for i in range(5)]
    down = [(rng.randrange(0, 60), rng.randrange(60, 120)) for _ in range(60)] + [(rng.randrange(0, 120), rng.randrange(0, 120)) for _ in range(12)]
    pairs = cycles + down + [(200 + i, 201 + i) for i in range(8)] + [(None, 1), (1, None), (3, 3), (0, 1), (0, 1)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    want = _plain_impact(pairs)
    got = {r.node: (r.direct, r.total) for r in graph.impact_of_all(df).collect()}
    assert got == {n: (d, t) for n, (d, t, _) in want.items()}
    single = {r.node: (r.direct, r.total, r.level) for r in graph.change_impact(df, starts(spark, "7", "62", "205").selectExpr("cast(node as long) node")).collect()}
    assert all(got.get(n, (0, 0)) == v[:2] for n, v in single.items())
    component = {r.node: r.component for r in graph.strong_components(df).collect()}
    assert component.keys() == want.keys()
    for x in want:
        both = {y for y in want[x][2] if x in want[y][2]}
        assert component[x] == max(both)


def test_impact_of_all_by_sketches(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(0, 1500), 1500 + rng.randrange(0, 40)) for _ in range(4000)] + [(1500 + i, 1600 + i % 4) for i in range(40)] + [(1600, 1601), (1601, 1600)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    want = _plain_impact(pairs)
    got = {r.node: (r.direct, r.total) for r in graph.impact_of_all(df, exact=False).collect()}
    assert got.keys() == want.keys()
    for n, (direct, total, _) in want.items():
        assert got[n][0] == direct and abs(got[n][1] - total) <= 0.07 * total


def test_impact_of_all_without_edges(spark):
    none = spark.createDataFrame([(None, 1), (2, 2)], "src long, dst long")
    for exact in (True, False):
        assert graph.impact_of_all(none, exact).count() == 0
    assert graph.strong_components(none).count() == 0


def test_impact_of_all_gathers_no_pairs_across_a_cycle(spark, monkeypatch):
    """150 nodes above a cycle and 150 below it, twice, with ways past the cycles: pairs from above to below stay a number."""
    rng = random.Random(7)
    pairs = []
    for at in (0, 1000):
        pairs += [(at + 500 + i, at + 500 + (i + 1) % 5) for i in range(5)]
        pairs += [(at + i, at + 500) for i in range(150)] + [(at + 501, at + 600 + i) for i in range(150)]
        pairs += [(at + rng.randrange(0, 150), at + 600 + rng.randrange(0, 150)) for _ in range(20)]
        pairs += [(at + 800 + i, at + 600 + 3 * i) for i in range(20)] + [(at + 3 * i, at + 850 + i) for i in range(20)] + [(at + 850, at + 801), (at + 900, at + 850)]
    want = _plain_impact(pairs)
    gathered, plain = [], graph.reach

    def counted(*args, **kwargs):
        out = plain(*args, **kwargs)
        gathered.append(out.count())
        return out

    monkeypatch.setattr(graph, "reach", counted)
    got = {r.node: (r.direct, r.total) for r in graph.impact_of_all(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: (d, t) for n, (d, t, _) in want.items()}
    assert sum(gathered) < 2000  # of 2 x 150 x 150


def test_neighbours(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (4, 4), (4, 5), (5, 1), (6, 7), (None, 1), (1, None)], "src long, dst long")
    at = lambda *n: spark.createDataFrame([(x,) for x in n], "node long")
    found = lambda *n: sorted(r.node for r in graph.neighbours(df, at(*n)).collect())
    assert found(1) == [2, 3, 5] and found(1, 4) == [2, 3, 5] and found(4, 4, None) == [5] and found(9) == []


def test_search_with_neighbours_searches_once(spark, monkeypatch):
    """The hits are a table of their own, and no table of all edges is made."""
    from tessera.plans import catalogue

    kept, plain = [], catalogue.stored

    def counted(df, name):
        out = plain(df, name)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(catalogue, "stored", counted)
    line = spark.createDataFrame([(o, n, p, 1, "1995-01-01", "R") for o in range(200) for n, p in enumerate((o % 50, o % 50 + 100, o % 50 + 200))], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_shipdate string, l_returnflag string")
    monkeypatch.setattr(catalogue, "_t", lambda s, d, name: line)
    monkeypatch.setattr(catalogue, "_hits", lambda s, d, n: s.createDataFrame([(7,), (120,)], "id long"))
    assert [r.node for r in catalogue.search_with_neighbours(spark, "").collect()] == [20, 107, 220]
    assert kept == [("best", 2), ("orders", 8)]


def test_impact_of_many_starts_keeps_a_row_for_each_node(spark, monkeypatch):
    """150 starts, more than one row has bits for: a node that reaches them all is a row for each part, not for each start."""
    monkeypatch.setattr(graph, "ORIGINS", 60)
    rng = random.Random(9)
    pairs = [(i, (i + 1) % 200) for i in range(200)] + [(rng.randrange(0, 300), rng.randrange(0, 300)) for _ in range(400)] + [(None, 1), (1, None), (5, 5)]
    want = _plain_impact(pairs)
    largest, plain = [0], graph.cut_lineage

    def counted(df):
        out = plain(df)
        largest[0] = max(largest[0], out.count())
        return out

    monkeypatch.setattr(graph, "cut_lineage", counted)
    asked = [*range(150), 5, 999, None]
    got = graph.change_impact(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(x,) for x in asked], "node long")).collect()
    assert sorted((r.node is None, r.node, r.direct, r.total) for r in got if r.node is not None) == sorted((False, n, *want.get(n, (0, 0))[:2]) for n in set(asked) - {None})
    assert [(r.direct, r.total) for r in got if r.node is None] == [(0, 0)]
    assert largest[0] <= 300 * 7  # not 150 x 300


def _plain_components(pairs):
    reached = _plain_impact(pairs)
    return {x: max(y for y in reached[x][2] if x in reached[y][2]) for x in reached}


@pytest.mark.parametrize("hubs,kind", [(1, "long"), (3, "string")])
def test_strong_components_by_any_hubs(spark, monkeypatch, hubs, kind):
    """Cycles above and below one another, with more edges or fewer, whichever nodes are hubs."""
    monkeypatch.setattr(graph, "HUBS", hubs)
    rng = random.Random(11)
    pairs = [(10 * c + i, 10 * c + (i + 1) % n) for c, n in enumerate([2, 3, 9, 5, 2, 7]) for i in range(n)]
    pairs += [(10 * c + rng.randrange(2), 10 * (c + 1) + rng.randrange(2)) for c in range(5) for _ in range(3)] + [(100 + i, 10 * rng.randrange(6)) for i in range(6)]
    pairs += [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(90)] + [(None, 200), (200, None), (200, 200), (0, 1), (0, 1)]
    typed = [tuple(None if x is None else str(x) if kind == "string" else x for x in p) for p in pairs]
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(typed, f"src {kind}, dst {kind}")).collect()}
    assert got == _plain_components(typed)


def test_great_cycles_are_not_coloured_node_by_node(spark, monkeypatch):
    """Two graphs that cycles hold for the most part, as copies do: what is left for colours is a small part of the edges."""
    rng = random.Random(12)
    pairs = [(at + rng.randrange(900), at + rng.randrange(900)) for at in (0, 5000) for _ in range(2700)]
    coloured, plain = [0], graph._greatest
    monkeypatch.setattr(graph, "_greatest", lambda edges, colours: coloured.append(edges.count()) or plain(edges, colours))
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == _plain_components(pairs) and sum(coloured) < len(pairs) / 10
