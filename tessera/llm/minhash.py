"""Near copies by the Jaccard index of word shingles: fingerprints and MinHash bands propose pairs, the shingles decide.

A text is the set of its ``shingle``-word hashes; equal sets are one node. SimHash fingerprints within two bits
(``simhash.close_pairs``) find the copies with the smallest edits, but an index of 0.8 means ten differing bits on
average, which no segments of 64 bits can index. So a node also has BANDS keys of ROWS minima each; two texts with an
index of 0.8 share a key with a probability of 1 - (1 - 0.8^5)^20 = 0.9996. Every pair that shares a key is either
verified on the whole sets, or already in one component by other verified pairs, or ruled out by sketches: all members
of a key are first held against its smallest and its largest node; while many pairs are left, members outside the
commonest component of their key are held against a few members of that; what still is apart is held against each
other, inside a join that lets only pairs through that their sketches allow. Keys with more than CROWD members are left out
of that join. Members of these meet on rare shingles: with the shingles of every set in order of how many sets have them,
rarest first, two sets within the index share one of the first tenth of the smaller (the first n - 8/9 n + 1 of n for an index of
0.8) and the first fifth of the larger. Sets that agree in a template alone have more shingles of their own than that, so
they never meet, however many and however long they are.

A sketch has a bit for each of 512 cells, set where an odd number of the set's hashes fall. The bits in which two
sketches differ are at most as many as the hashes that only one of the sets has, so a pair that is ruled out by them
is never within the index. Sets of up to some 1,000 shingles are told apart well; larger ones are more often verified.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, heavy_join, utf8_rows
from tessera.llm.components import connected_components
from tessera.llm.packed import each_group, pack, unpack
from tessera.llm.simhash import SEED, close_pairs, first_of_groups, majority

BANDS, ROWS = 20, 5
BLOCK = 1 << 12
#: Members of the commonest component that a key's other members are held against in a round.
PIVOTS = 4
#: Members of a key that are held against each other by their sketches alone.
CROWD = 50
#: 64-bit numbers of a sketch.
SKETCH = 8
_SKETCH = [f"s{i}" for i in range(SKETCH)]
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def hashes(text: bytes, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words (of all words where there are fewer), A-Z in lower case; none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    span = min(size, len(words))
    return np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[span:])] if span else [], dtype="<u8")


def as_set(found: np.ndarray) -> np.ndarray:
    """Sorted different hashes; the set of a text without words holds a zero."""
    return np.unique(found) if len(found) else np.zeros(1, "<u8")


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    return as_set(hashes(text, size))


def node_of(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), SEED)


def band_keys(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), BLOCK):
        least = np.minimum(least, (own[at : at + BLOCK, None] * _FACTORS + _SHIFTS).min(0))
    mixed = np.zeros(BANDS, np.uint64)
    for k, part in enumerate(least.reshape(BANDS, ROWS).T):
        mixed = (mixed ^ (part >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
        mixed ^= mixed >> np.uint64(29)
    return mixed + np.arange(BANDS, dtype=np.uint64)


def sketch(own: np.ndarray) -> np.ndarray:
    cells = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=64 * SKETCH) & 1).astype(np.uint8), bitorder="little").view("<i8")


def _possible(a: Column, b: Column, least: float) -> Column:
    """Whether two structs ``n, s0, ...`` can belong to sets with an index of ``least``."""
    differ = reduce(Column.__add__, [F.bit_count(a[s].bitwiseXOR(b[s])) for s in _SKETCH])
    sizes = F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * least
    return sizes & (differ <= (a["n"] + b["n"]) * ((1 - least) / (1 + least)) + 1e-9)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def in_slices(batches, rows: int = 512):
    """The batches in pieces, so that the hashes of few texts are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, node, bits, keys, n`` and the sketch for every row."""
    names = ["doc_id", "node", "bits", "keys", "n", *_SKETCH]

    def run(batches):
        for batch in in_slices(batches):
            found = [hashes(t, size) for t in utf8_rows(batch.column(1))]
            sets = [as_set(x) for x in found]
            nodes, bits = (np.array(x, np.uint64).view(np.int64) for x in ([node_of(s) for s in sets], [majority(x) for x in found]))
            keys = np.array([band_keys(s) for s in sets], np.uint64).reshape(-1).view(np.int64)
            drawn = np.array([sketch(s) for s in sets], "<i8").reshape(-1, SKETCH)
            columns = [batch.column(0), pa.array(nodes), pa.array(bits), pack(keys, np.arange(len(sets) + 1) * BANDS), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c) for c in drawn.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _texts(docs).mapInArrow(run, "doc_id long, node long, bits long, keys binary, n long, " + ", ".join(f"{c} long" for c in _SKETCH))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in in_slices(batches):
            sets = [shingles(t, size) for t in utf8_rows(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "own"])

    return docs.select("text").mapInArrow(run, "node long, own binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets have an index of ``least`` or more."""

    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (a, b))
                both = 0 if min(len(x), len(y)) < least * max(len(x), len(y)) else len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("node").alias("src"), F.col("own").alias("a")), sets.select(F.col("node").alias("dst"), F.col("own").alias("b"))
    return pairs.join(left, "src").join(right, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def _by_rare_shingles(crowd: DataFrame, sets: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """``src, dst``: pairs of ``crowd`` (``drawn, root``) of different roots that may be within the index; none within it is missed."""

    def split(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [np.frombuffer(x.as_buffer(), "<i8") for x in part.column(1)]
                sizes = [len(x) for x in found]
                nodes = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(np.array(sizes, np.int64), sizes)), pa.array(np.concatenate([*found, np.zeros(0, "<i8")]))], names=["node", "size", "shingle"])

    rows = sets.join(crowd.select("drawn.node"), "node", "left_semi").mapInArrow(split, "node long, size long, shingle long")
    rows = scratch.keep(rows, "shingles")
    common = scratch.keep(rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    held = heavy_join(rows, common, "shingle", keep_count=True)

    def prefixes(batches):
        for table in each_group(batches):  # the shared shingles of one set
            size = int(table.column(1)[0].as_py())
            alone = size - table.num_rows  # shingles that no other set has come first and meet nothing
            order = np.lexsort((table.column(2).to_numpy(), table.column(3).to_numpy()))
            probe = max(0, size - math.ceil(least * size - 1e-9) + 1 - alone)
            index = max(0, size - math.ceil(2 * least / (1 + least) * size - 1e-9) + 1 - alone)
            take = order[:probe]
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().take(pa.array(take)), table.column(2).combine_chunks().take(pa.array(take)), pa.array(np.arange(len(take)) < index)], names=["node", "shingle", "indexed"])

    first = held.select("node", "size", "shingle", "n").repartition("node").sortWithinPartitions("node").mapInArrow(prefixes, "node long, shingle long, indexed boolean")
    first = scratch.keep(first.join(crowd.select("drawn.node", "drawn", "root"), "node"), "prefixes")
    small = first.filter("indexed").select("shingle", F.col("drawn").alias("small"), F.col("root").alias("small_root"))
    order = F.struct("small.n", "small.node") < F.struct("drawn.n", "drawn.node")
    met = first.join(small, "shingle").filter(order & (F.col("root") != F.col("small_root")) & _possible(F.col("small"), F.col("drawn"), least))
    return met.select(F.least("small.node", "drawn.node").alias("src"), F.greatest("small.node", "drawn.node").alias("dst")).distinct()


def near_copy_groups(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs`` (``doc_id, text``): documents whose sets of ``size``-word
    shingles have a Jaccard index of ``least`` or more are linked; ``component_id`` is the smallest doc_id reachable.

    Null and empty texts are one node. Rows without a doc_id take no part; repeated rows repeat. Of a doc_id with
    different texts each row has the component of its own text.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.filter("doc_id is not null")
    rows = scratch.keep(signatures(docs, size), "signatures")

    def split(batches):
        for batch in batches:
            keys, starts = unpack(batch.column(1), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), np.diff(starts))), pa.array(keys)], names=["node", "key"])

    drawn = F.first(F.struct("node", "n", *_SKETCH)).alias("drawn")
    nodes = scratch.keep(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.min("bits").alias("bits"), F.first("keys").alias("keys"), drawn), "nodes")
    keyed = nodes.select("node", "keys").mapInArrow(split, "node long, key long")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    members = scratch.keep(keyed.join(shared, "key"), "members")
    pair = lambda a, b: (F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    prints = scratch.keep(nodes.groupBy("bits").agg(F.min("node").alias("named")), "prints")
    same = nodes.join(prints, "bits").select(*pair(F.col("node"), F.col("named")))
    near = close_pairs(prints.select("bits"), 2)
    for end in ("src", "dst"):
        near = near.join(prints.select(F.col("bits").alias(end), F.col("named").alias(f"{end}_node")), end)
    alike = [same, near.select(*pair(F.col("src_node"), F.col("dst_node"))), *(members.select(*pair(F.col("node"), F.col(c))) for c in ("low", "high"))]
    pairs = alike[0]
    for more in alike[1:]:
        pairs = pairs.unionAll(more)
    pairs = scratch.keep(pairs.filter("src <> dst").distinct(), "pairs")
    wanted = members.select("node").unionAll(pairs.select("src")).unionAll(pairs.select("dst")).distinct()
    wanted = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    sets = scratch.keep(_sets(_texts(docs).join(wanted.hint("shuffle_merge"), "doc_id", "left_semi"), size), "sets")
    links = scratch.keep(_verified(pairs, sets, least), "links")
    roots = scratch.keep(connected_components(links, scratch), "roots")
    def labels(roots):
        """Members of keys beside their components; keys of one component are done with."""
        out = members.select("node", "key").join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("root"))
        several = out.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
        return scratch.keep(out.join(several, "key", "left_semi").join(nodes.select("node", "drawn"), "node"), "labelled")

    labelled, turn, before = labels(roots), 0, None
    while True:
        total, apart = labelled.agg(F.count("*"), F.countDistinct("root")).first()
        # A round is worth its work while there are many more members than components, and while it joins some of these.
        if 2 * apart >= total or (before is not None and apart >= 0.98 * before):
            break
        before, turn = apart, turn + 1
        pivots = [F.min_by("drawn", F.xxhash64("node", F.lit(turn * PIVOTS + i))).alias(f"p{i}") for i in range(PIVOTS)]
        parts = labelled.groupBy("key", "root").agg(F.count("*").alias("n"), *pivots)
        main = parts.groupBy("key").agg(F.max_by(F.struct("root", *[f"p{i}" for i in range(PIVOTS)]), F.struct("n", "root")).alias("main"))
        other = labelled.join(main, "key").filter(F.col("root") != F.col("main.root"))
        near = F.filter(F.array(*[F.col(f"main.p{i}") for i in range(PIVOTS)]), lambda p: _possible(F.col("drawn"), p, least))
        asked = other.select("drawn", F.explode(near).alias("pivot"))
        found = scratch.keep(_verified(asked.select(*pair(F.col("drawn.node"), F.col("pivot.node"))).distinct(), sets, least), "links")
        links = links.unionAll(found)
        labelled = labels(scratch.keep(connected_components(links, scratch), "roots"))
    sizes = labelled.groupBy("key").agg(F.count("*").alias("members"))
    sized = scratch.keep(labelled.join(sizes, "key"), "sized")
    quiet = sized.filter(F.col("members") <= CROWD)
    other = quiet.select("key", F.col("root").alias("other_root"), F.col("drawn").alias("other"))
    rest = quiet.join(other, "key").filter((F.col("root") < F.col("other_root")) & _possible(F.col("drawn"), F.col("other"), least))
    rest = rest.select(*pair(F.col("drawn.node"), F.col("other.node"))).distinct()
    crowd = sized.filter(F.col("members") > CROWD).groupBy("drawn.node").agg(F.first("drawn").alias("drawn"), F.first("root").alias("root")).drop("node")
    if not crowd.isEmpty():
        rest = rest.unionAll(_by_rare_shingles(scratch.keep(crowd, "crowd"), sets, least, scratch)).distinct()
    roots = connected_components(links.unionAll(_verified(rest, sets, least)), scratch)
    linked = scratch.keep(nodes.select("node", "first_id").join(roots, "node").select("node", "root", "first_id"), "linked")
    named = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    merged = linked.join(named, "root").select("node", "least_id")
    classes = nodes.select("node", "first_id", "n").join(merged, "node", "left").select("node", F.coalesce("least_id", "first_id").alias("component_id"), "n")
    return scratch.finish(heavy_join(rows.select("doc_id", "node"), scratch.keep(classes, "classes"), "node").select("doc_id", "component_id"), "groups")


def drop_near_copies(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays, columns as given.

    Rows without a doc_id can't be told apart and stay. Of repeated rows with one doc_id one stays.
    """
    return first_of_groups(docs, near_copy_groups(docs, size, least))
