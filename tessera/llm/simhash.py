"""SimHash near-duplicate groups by one-wildcard segment variants.

A fingerprint has 64 bits. Two fingerprints within ``max_bits`` differing bits, cut into ``max_bits // 2 + 1``
segments, agree in at least one segment up to a single bit. So each segment is indexed exactly and, where needed,
once for each bit position left out (the wildcard); equal keys are joined and the pairs verified. A pair with no
equal segment has at least one differing bit in each, hence at most ``max_bits - segments`` segments with two or
more: wildcards in the first ``max_bits - segments + 1`` segments find it.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, heavy_join, utf8_rows
from tessera.llm.components import connected_components

SEED = 42
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned fingerprint of a UTF-8 text: A-Z in lower case, words between ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    span = min(shingle, len(words))
    n = len(words) - span + 1
    blocks = (zip(starts[at : min(n, at + BLOCK)], starts[at + span : min(n, at + BLOCK) + span]) for at in range(0, n, BLOCK))
    return _majority(np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in block], dtype="<u8") for block in blocks)


def _majority(blocks) -> int:
    total, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes; zero for none."""
    return _majority(hashes[at : at + BLOCK] for at in range(0, len(hashes), BLOCK))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, bits`` for every row; null and empty texts get zero. Other columns are not read."""

    def run(batches):
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in utf8_rows(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, bits long")


def _variants(max_bits: int) -> tuple[Column, Column]:
    """Keys of a fingerprint on the two sides of the join: exact segments on both, wildcards by the bit they hide."""
    segments = max(2, max_bits // 2 + 1)
    width = -(-64 // segments)
    left, right = [], []
    for s in range(segments):
        size = min(width, 64 - s * width)
        value = F.shiftrightunsigned("bits", s * width).bitwiseAND(F.lit((1 << size) - 1))
        key = lambda pos, masked, s=s: F.lit((s * 64 + pos) << 32).bitwiseOR(masked)
        left.append(key(63, value))
        right.append(key(63, value))
        if s <= max_bits - segments:
            for pos in range(size):
                bare = key(pos, value.bitwiseAND(F.lit(~(1 << pos))))
                is_set = value.bitwiseAND(F.lit(1 << pos)) != 0
                left.append(F.when(~is_set, bare))
                right.append(F.when(is_set, bare))
    return F.array_compact(F.array(*left)), F.array_compact(F.array(*right))


def close_pairs(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """``src, dst`` for all pairs of different ``bits`` within ``max_bits``; a pair may come more than once.

    A fingerprint has at most sum(C(64, i)) such partners (2,080 for two bits), whatever the size of the table, and
    rows that only share a key are dropped inside the join.
    """
    on_left, on_right = _variants(max_bits)
    left = distinct.select(F.col("bits").alias("src"), F.explode(on_left).alias("key"))
    right = distinct.select(F.col("bits").alias("dst"), F.explode(on_right).alias("key"))
    exact = F.shiftright("key", 32).bitwiseAND(F.lit(63)) == 63
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits
    return left.join(right, "key").filter(near & (~exact | (F.col("src") < F.col("dst")))).select("src", "dst")


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id, bits, component_id`` for each row of ``docs`` (columns ``doc_id, text``; others are ignored).

    Documents of one fingerprint count as one node, so copies never multiply. ``component_id`` is the smallest
    doc_id reachable. Null and empty texts share fingerprint zero and are linked like others; a null doc_id takes
    part but never names a component; repeated rows stay repeated; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, shingle), "fingerprints")
    nodes = scratch.keep(rows.groupBy("bits").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "nodes")
    roots = connected_components(close_pairs(nodes.select("bits"), max_bits), scratch)
    linked = scratch.keep(nodes.join(roots, F.col("bits") == F.col("node")).select("bits", "root", "first_id"), "linked")
    named = scratch.keep(linked.groupBy("root").agg(F.min("first_id").alias("least_id")), "named")
    merged = linked.join(named, "root").select("bits", "least_id")
    classes = nodes.join(merged, "bits", "left").select("bits", F.coalesce("least_id", "first_id").alias("component_id"), "n")
    return scratch.finish(heavy_join(rows, scratch.keep(classes, "classes"), "bits").select("doc_id", "bits", "component_id"), "groups")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays, columns as given.

    Rows without a doc_id can't be told apart and stay. Of several rows with one doc_id, whose texts may differ, one
    stays, if any of them names its group: the one with the smallest hash of its text.
    """
    return first_of_groups(docs, simhash_groups(docs.filter("doc_id is not null"), shingle, max_bits))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their group (``doc_id, component_id``), and those without a doc_id.

    A doc_id with several rows may be in several groups. It stays, once, only if it names all of them: a row of it that
    copies an earlier document makes it a copy.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    named = groups.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n")).filter("doc_id = least")
    kept = scratch.keep(named.select("doc_id", "n"), "kept")
    # The ids grow with the corpus: always by a shuffle, never by a broadcast that only small inputs allow.
    out = docs.join(kept.select("doc_id").hint("shuffle_merge"), "doc_id", "left_semi").select(*docs.columns)
    if not kept.filter("n > 1").isEmpty():
        hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
        first = F.min_by(F.struct(*out.columns), F.struct(F.xxhash64("text"), F.xxhash64(*hashed))).alias("row")
        out = out.groupBy("doc_id").agg(first).select("row.*")
    return out.unionByName(docs.filter("doc_id is null"))
