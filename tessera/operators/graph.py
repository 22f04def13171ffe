"""Analytics on a directed graph ``edges(src, dst)``: bounded reach, shortest paths, impact, Jaccard clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.contain import held_strings
from tessera.sources.shared import cut_lineage


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct()


def _dealt(edges: DataFrame, by: str) -> DataFrame:
    """A table of ``edges`` that is dealt by ``by`` once: the joins of all rounds on that column don't move it again."""
    return cut_lineage(edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), by))


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = 2, direction: str = "downstream") -> DataFrame:
    """``origin, node, depth``: least number of steps from each origin (``starts(node)``), origins left out.

    One join a level with what was new, minus what is known; each level is a table of its own in the shared folder, so
    what is known is a union of as many small scans as there were levels. ``depth`` None goes on until nothing is new.
    An edge with a null end leads nowhere.
    """
    if direction not in ("downstream", "upstream"):
        raise ValueError("direction must be downstream or upstream")
    a, b = ("src", "dst") if direction == "downstream" else ("dst", "src")
    step = _dealt(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).dropna().distinct(), "node")
    front = cut_lineage(starts.select(F.col("node").alias("origin"), "node").distinct().withColumn("depth", F.lit(0)))
    known, level = front, 0
    while depth is None or level < depth:
        level += 1
        new = front.join(step, "node").select("origin", F.col("next").alias("node")).distinct()
        front = cut_lineage(new.join(known.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known.filter("depth > 0")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``: what is one step up or down from any of ``nodes(node)``, these left out, by one pass over ``edges``."""
    ways = lambda a, b: F.struct(F.col(a).alias("at"), F.col(b).alias("node"))
    both = edges.select(F.explode(F.array(ways("src", "dst"), ways("dst", "src"))).alias("way")).select("way.at", "way.node").dropna()
    own = nodes.select(F.col("node").alias("at"))
    return both.join(own, "at", "left_semi").select("node").distinct().join(nodes, "node", "left_anti")


def shortest_path(edges: DataFrame, start, end, max_depth: int = 10) -> DataFrame:
    """One row ``path, length``: a shortest path of at most ``max_depth`` edges; of equal ones the smallest by nodes; no row if there is none."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    seed = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("path"))
    if start == end:
        return seed.select("path", F.lit(0).alias("length"))
    step = cut_lineage(edges.select("src", "dst").distinct())
    front, known = cut_lineage(seed), seed.select("node")
    for level in range(1, max_depth + 1):
        new = front.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        front = cut_lineage(new.join(known, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        hit = front.filter(F.col("node") == F.lit(end).cast(kind))
        if not hit.isEmpty():
            return hit.select("path", F.lit(level).alias("length"))
        if front.isEmpty():
            break
        known = known.unionByName(front.select("node"))
    return seed.select("path", F.lit(0).alias("length")).limit(0)


def clusters(edges: DataFrame, threshold: float = 0.3, of: DataFrame | None = None) -> DataFrame:
    """``node, other, similarity`` of pairs whose undirected neighbour sets have a Jaccard index of ``threshold`` or more.

    Neighbours are ordered by how many share them, rarest first: two sets as alike as that share one of their first
    n - ceil(threshold * n) + 1 members. So pairs are proposed by the rare neighbours alone, those of too different
    sizes are left out, and only the rest are counted on whole sets; a hub makes no pairs of all that point at it.
    ``of(node)`` limits one side. A threshold of 0 takes all pairs that share a neighbour.
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("via")).union(edges.select("dst", "src")).filter("node is not null and via is not null").distinct()
    both = cut_lineage(both)
    size = both.groupBy("node").agg(F.count("*").alias("size"))
    least = max(0.0, threshold - 1e-6)  # the index is rounded to six digits
    shared_by = both.groupBy("via").agg(F.count("*").alias("shared_by"))
    order = Window.partitionBy("node").orderBy("shared_by", "via")
    ranked = both.join(shared_by, "via").join(size, "node").withColumn("r", F.row_number().over(order))
    first = cut_lineage(ranked.filter(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select("node", "via", "size"))
    left = first if of is None else first.join(of.select("node").distinct(), "node", "left_semi")
    right = first.select(F.col("node").alias("other"), "via", F.col("size").alias("other_size"))
    close = (F.col("node") != F.col("other")) & (F.least("size", "other_size") >= F.greatest("size", "other_size") * least)
    pairs = cut_lineage(left.join(right, "via").filter(close).select("node", "other", "size", "other_size").distinct())
    met = pairs.join(both, "node").join(both.select(F.col("node").alias("other"), "via"), ["other", "via"])
    shared = met.groupBy("node", "other", "size", "other_size").agg(F.count("*").alias("shared"))
    jaccard = F.round(F.col("shared") / (F.col("size") + F.col("other_size") - F.col("shared")), 6)
    return shared.select("node", "other", jaccard.alias("similarity")).filter(F.col("similarity") >= threshold)


def imported_by(edges: DataFrame) -> DataFrame:
    """``node, importers``: how many others point at each node."""
    return edges.filter("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("importers"))


def relation_level(count: Column) -> Column:
    """HIGH from 5 importers, MEDIUM from 2, LOW from 1."""
    return F.when(count >= 5, "HIGH").when(count >= 2, "MEDIUM").when(count >= 1, "LOW").otherwise("MINIMAL")


def impact_level(count: Column) -> Column:
    """CRITICAL from 10 affected, HIGH from 5, MEDIUM from 2, LOW from 1."""
    return F.when(count >= 10, "CRITICAL").when(count >= 5, "HIGH").when(count >= 2, "MEDIUM").when(count >= 1, "LOW").otherwise("MINIMAL")


#: Origins that share a row for each node they are reached from, a bit each.
ORIGINS = 63


def _counted_above(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``origin, total``: how many other nodes reach each of ``starts(node)``.

    Origins are dealt to parts by hash and have a bit each there. What is known is a row for each part and node, with the
    bits of the origins it reaches, and only bits that are new go on, so nodes that reach many origins cost little more.
    """
    parts = -(-max(1, starts.count()) // (ORIGINS // 2))
    dealt = starts.select("node", F.pmod(F.xxhash64("node"), F.lit(parts)).alias("bucket"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("node")) - 1)
    bit = F.expr(f"shiftleft(1L, r % {ORIGINS})").alias("mask")
    origins = cut_lineage(ranked.select("node", F.struct("bucket", F.floor(F.col("r") / ORIGINS).alias("more")).alias("part"), bit))
    step = cut_lineage(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    known = front = origins.select("part", "node", "mask")
    mask, sent = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("mask", "sent"))
    while not front.isEmpty():
        came = front.join(step, "node").groupBy("part", F.col("next").alias("node")).agg(F.bit_or("mask").alias("sent"))
        merged = known.join(came, ["part", "node"], "full").select("part", "node", mask.bitwiseOR(sent).alias("mask"), sent.bitwiseAND(F.bitwise_not(mask)).alias("new"))
        merged = cut_lineage(merged)
        known, front = merged.select("part", "node", "mask"), merged.filter("new <> 0").select("part", "node", F.col("new").alias("mask"))
    alike = known.groupBy("part", "mask").agg(F.count("*").alias("n"))
    own = origins.select("part", F.col("node").alias("origin"), F.col("mask").alias("own"))
    return alike.join(own, "part").filter("mask & own <> 0").groupBy("origin").agg((F.sum("n") - 1).alias("total"))


def change_impact(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``node, direct, total, level``: direct and transitive dependents of each start, itself left out."""
    edges, starts = cut_lineage(distinct_edges(edges)), cut_lineage(starts.select("node").distinct())
    total = _counted_above(edges, starts.dropna())
    direct = edges.join(starts, F.col("dst") == F.col("node"), "left_semi").groupBy("dst").agg(F.count("*").alias("direct"))
    out = starts.join(total, F.col("node") == F.col("origin"), "left").join(direct, F.col("node") == F.col("dst"), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("node", count("direct"), count("total")).withColumn("level", impact_level(F.col("total")))


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` between nodes that are both reached and left by others, again and again while that takes a tenth or more."""
    left = edges.count()
    while left:
        ends = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut_lineage(edges.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst"))
        before, left = left, edges.count()
        if left > 0.9 * before:
            break
    return edges


def _greatest(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """``node, colour`` of all nodes that a colour reaches along ``edges(src, dst)``: the greatest of these, its own among them."""
    step = _dealt(edges.select("src", "dst"), "src")
    colour = front = cut_lineage(colours)
    while not front.isEmpty():
        sent = front.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
        merged = colour.join(sent, "node", "full").select("node", F.greatest("colour", "sent").alias("colour"), F.coalesce(F.col("sent") > F.col("colour"), F.col("colour").isNull()).alias("new"))
        merged = cut_lineage(merged.select("node", "colour", F.coalesce("new", F.lit(False)).alias("new")))
        colour, front = merged.select("node", "colour"), merged.filter("new").select("node", "colour")
    return colour


#: One node in so many, of those with edges in and out, is a hub from which great cycles are searched.
HUBS = 256


def _great_cycles(edges: DataFrame) -> DataFrame:
    """``node, component`` of the strong components in which one hub outranks all hubs that reach them or are reached.

    Each node takes the greatest hub above it and the greatest below it, both in the same rounds; where they are the same
    hub, the node lies on a cycle with it, and so do all of its component. Hubs rank by edges in times edges out. The
    edges and the nodes stay where they are dealt, so a round moves only what the nodes that changed send.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, by: df.repartition(parts, by).sortWithinPartitions(by)
    way = lambda at, to, down: F.struct(F.col(at).alias("at"), F.col(to).alias("to"), F.lit(down).alias("down"))
    step = dealt(edges.select(F.explode(F.array(way("src", "dst", True), way("dst", "src", False))).alias("way")).select("way.*"), "at").persist()
    rank = step.groupBy(F.col("at").alias("node")).agg((F.count_if("down") * F.count_if(~F.col("down"))).alias("rank"))
    hash_of = F.xxhash64("node")
    colour = F.shiftleft(F.least("rank", F.lit((1 << 20) - 1)), 43).bitwiseOR(F.shiftrightunsigned(hash_of, 21))
    nodes = cut_lineage(rank.select("node", F.when((F.col("rank") > 0) & (F.pmod(hash_of, F.lit(HUBS)) == 0), colour).alias("hub")))
    alone = nodes.dropna().groupBy("hub").agg(F.count("*").alias("n")).filter("n = 1").select("hub")
    hubs = nodes.dropna().join(alone, "hub").select("node", "hub")
    state = dealt(nodes.select("node"), "node").join(hubs, "node", "left").select("node", F.col("hub").alias("above"), F.col("hub").alias("below"), F.col("hub").alias("new_above"), F.col("hub").alias("new_below"))
    state = cut_lineage(state)
    newer = lambda c, old: F.when(F.col(c) > F.coalesce(old, F.lit(-1)), F.col(c))
    while not (front := state.filter("new_above is not null or new_below is not null")).isEmpty():
        sent = front.join(step, F.col("node") == F.col("at")).select(F.col("to").alias("node"), F.expr("if(down, new_above, null)").alias("a"), F.expr("if(down, null, new_below)").alias("b"))
        sent = sent.filter("a is not null or b is not null").groupBy("node").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        state = cut_lineage(state.join(sent, "node", "left").select("node", F.greatest("above", "a").alias("above"), F.greatest("below", "b").alias("below"), newer("a", "above").alias("new_above"), newer("b", "below").alias("new_below")))
    step.unpersist()
    met = state.filter("above = below").select("node", "above")
    return met.join(met.groupBy("above").agg(F.max("node").alias("component")), "above").select("node", "component")


def _without(edges: DataFrame, found: DataFrame) -> DataFrame:
    """``edges`` between nodes that are not among ``found(node)``, trimmed."""
    src, dst = found.select(F.col("node").alias("src")), found.select(F.col("node").alias("dst"))
    return _trimmed(cut_lineage(edges.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select("src", "dst")))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component``: nodes that reach each other share the greatest node among them; all others are their own.

    Great cycles are found from hubs first. In the rest, every node takes the greatest node that reaches it as its colour,
    round by round; what the node of a colour's own name is reached from within the colour is a component, and the search
    goes on in the rest. Nodes without edges in or out are taken off first. The rounds follow the longest shortest path
    from or to a hub and within what cycles hold, not the table.
    """
    edges = cut_lineage(distinct_edges(edges))
    found = cut_lineage(_great_cycles(edges))
    left = _without(edges, found)
    while not left.isEmpty():
        colour = _greatest(left, left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
        a, b = colour.toDF("src", "a"), colour.toDF("dst", "b")
        within = left.join(a, "src").join(b, "dst").filter("a = b").select("src", "dst")
        roots = colour.filter("node = colour").select("node")
        own = cut_lineage(reach(within, roots, None, "upstream").select("node", F.col("origin").alias("component")).union(roots.select("node", "node")))
        found = found.union(own)
        left = _without(left, own)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Registers of a sketch as a power of two: a standard error of some 1.6 %.
SKETCH_BITS = 12


def _sketched(between: DataFrame, member: DataFrame) -> DataFrame:
    """``component, reached``: about how many nodes depend on each component, its own among them.

    One sketch of node names for each component, made when all those that point at it have theirs: as many rounds as
    the longest chain. Each edge carries a sketch once; what waits is a row with a counter and a sketch.
    """
    merge = lambda c: F.hll_union_agg(c).alias(c)
    waits = between.groupBy(F.col("dst").alias("component")).agg(F.count("*").alias("missing"))
    start = member.groupBy("component").agg(F.hll_sketch_agg(F.col("node").cast("string"), SKETCH_BITS).alias("sketch"))
    waiting = cut_lineage(start.join(waits, "component", "left").select("component", F.coalesce("missing", F.lit(0)).alias("missing"), "sketch"))
    done = None
    while not waiting.isEmpty():
        ready = waiting.filter("missing = 0")
        counted = cut_lineage(ready.select("component", F.hll_sketch_estimate("sketch").alias("reached")))
        done = counted if done is None else done.union(counted)
        sent = ready.join(between, F.col("component") == F.col("src")).groupBy(F.col("dst").alias("component")).agg(F.count("*").alias("came"), merge("sketch"))
        rest = waiting.filter("missing > 0").select("component", "missing", "sketch")
        rest = rest.unionByName(sent.select("component", (-F.col("came")).alias("missing"), "sketch"))
        waiting = cut_lineage(rest.groupBy("component").agg(F.sum("missing").alias("missing"), merge("sketch")))
    return member.select("component").distinct().withColumn("reached", F.lit(1)) if done is None else done


def _above(between: DataFrame, size: DataFrame) -> DataFrame:
    """``component, above``: nodes in all components that reach each one along ``between(src, dst)``, which has no cycles.

    In every weakly connected part the greatest cycle is its hub, if there is one. What the hub reaches has all that
    reaches the hub above it, which is counted once, as a number; its other ancestors are gathered where the hub and
    what is above it are taken out. What the hub doesn't reach has no ancestors among what it reaches, and those are taken out.
    So no pair is gathered of one component above a hub and another below it.
    """
    rank = F.struct("size", "component")
    seeds = size.filter("size > 1").select(F.col("component").alias("node"), rank.alias("colour"))
    ways = between.select("src", "dst")
    part = _greatest(ways.union(ways.select("dst", "src")), seeds)
    hubs = cut_lineage(part.filter("node = colour.component").select("node"))
    tagged = lambda tag, c: F.struct(F.lit(tag).alias("side"), F.col(c).alias("node"))
    side = lambda df, tag: df.select(tagged(tag, "src").alias("src"), tagged(tag, "dst").alias("dst"))
    both = side(ways, 0).union(side(ways.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 1))
    starts = hubs.select(tagged(0, "node").alias("node")).union(hubs.select(tagged(1, "node").alias("node")))
    around = cut_lineage(reach(both, starts, None, "upstream").select("node.side", F.col("origin.node").alias("hub"), F.col("node.node").alias("component")))
    up, down = around.filter("side = 0").select("hub", "component"), around.filter("side = 1").select("hub", "component")
    over = cut_lineage(up.join(size, "component").groupBy("hub").agg(F.sum("size").alias("over")))

    names = lambda df, c: df.select(F.col("component").alias(c))
    without = lambda df, gone: df.join(names(gone, "src"), "src", "left_anti").join(names(gone, "dst"), "dst", "left_anti")
    hub = hubs.select(F.col("node").alias("component"))
    rest = side(without(ways, names(down, "component").union(hub)), 0).union(side(without(ways, names(up, "component").union(hub)), 1))
    rest = cut_lineage(rest)
    origins = rest.select(F.col("dst").alias("node")).distinct()
    below = names(down, "component").withColumn("below", F.lit(1))
    origins = origins.join(below, F.col("node.node") == F.col("component"), "left").filter("node.side = coalesce(below, 0)").select("node")
    near = reach(rest, origins, None, "upstream").select(F.col("origin.node").alias("component"), F.col("node.node").alias("other"))
    near = near.join(size.select(F.col("component").alias("other"), "size"), "other").groupBy("component").agg(F.sum("size").alias("near"))
    whole = size.select(F.col("component").alias("hub"), "size").join(hubs.select(F.col("node").alias("hub")), "hub").join(over, "hub", "left")
    whole = whole.select("hub", F.coalesce("over", F.lit(0)).alias("over"), (F.coalesce("over", F.lit(0)) + F.col("size")).alias("with_hub"))
    far = down.join(whole, "hub").select("component", F.col("with_hub").alias("far")).union(whole.select("hub", "over"))
    out = size.select("component").join(near, "component", "left").join(far, "component", "left")
    return out.select("component", (F.coalesce("near", F.lit(0)) + F.coalesce("far", F.lit(0))).alias("above"))


def impact_of_all(edges: DataFrame, exact: bool = True) -> DataFrame:
    """``node, direct, total, level`` of every node of ``edges``: ``change_impact`` of them all at once.

    Nodes of a cycle have the same dependents, so strong components are found first; what lies above the greatest cycle
    of a part counts once for all that lies below it, and only the other pairs of components between which there is a
    way are gathered. These can still grow with the square of what no such cycle divides; with ``exact`` False a sketch
    for each component takes their place, and totals are off by some 1.6 % (standard error). Null ends and edges of a
    node to itself don't count; no edges, no rows.
    """
    edges = cut_lineage(distinct_edges(edges))
    member = cut_lineage(strong_components(edges))
    a, b = member.toDF("src", "a"), member.toDF("dst", "b")
    between = cut_lineage(edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    size = cut_lineage(member.groupBy("component").agg(F.count("*").alias("size")))
    if exact:
        reached = size.join(_above(between, size), "component").select("component", (F.col("above") + F.col("size")).alias("reached"))
    else:
        reached = _sketched(between, member)
    direct = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("direct"))
    out = member.join(reached, "component").join(direct, "node", "left")
    out = out.select("node", F.coalesce("direct", F.lit(0)).cast("long").alias("direct"), F.greatest(F.col("reached") - 1, F.coalesce("direct", F.lit(0))).cast("long").alias("total"))
    return out.withColumn("level", impact_level(F.col("total")))


def related_tests(names: DataFrame, files: DataFrame) -> DataFrame:
    """``name, path``: files whose base name holds the name (``names(name)``, whatever the case) and test or spec.

    The names may be many (all that depend on a file); one pass over the names of tests looks for all of them.
    """
    low = F.lower(F.element_at(F.split("path", "/"), -1))
    tests = files.select("path", low.alias("low")).filter(low.contains("test") | low.contains("spec"))
    return held_strings(tests, "path", F.col("low"), names.select(F.lower("name"))).select(F.col("string").alias("name"), "path")
