"""Connected components by repeated contraction, as joins and minimum aggregates over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns ``node, root`` for every node that has an edge to another node.

    Each round hooks every node to its smallest neighbour, follows those parents two steps, and renames the ends
    of all edges; edges inside a merged node vanish. The round count is logarithmic in practice, no node's
    neighbours are ever gathered (minimum aggregates combine before the shuffle), and each round is cut by a table
    in the shared folder. Self-loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    pair = lambda a, b: (F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    live = edges.filter("src <> dst").select(*pair(F.col("src"), F.col("dst"))).distinct()
    live = scratch.keep(live, "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionAll(live.select("dst", "src"))
        hooked = both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root"))
        hooked = scratch.keep(hooked, "hooked")
        step = hooked.select(F.col("node").alias("via"), F.col("root").alias("next"))
        jumped = hooked
        for _ in range(2):
            jumped = jumped.join(step, F.col("root") == F.col("via")).select("node", F.col("next").alias("root"))
        jumped = scratch.keep(jumped, "jumped")
        maps.append(jumped)
        a = jumped.select(F.col("node").alias("src"), F.col("root").alias("a"))
        b = jumped.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        live = live.join(a, "src").join(b, "dst").filter("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct()
        live = scratch.keep(live, "edges")
    if not maps:
        return live.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    found = maps[0]
    for later in maps[1:]:
        moved = later.select(F.col("node").alias("via"), F.col("root").alias("next"))
        found = found.join(moved, F.col("root") == F.col("via"), "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
