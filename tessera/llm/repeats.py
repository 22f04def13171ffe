"""Repeated strings of a fixed length in a corpus, by suffix arrays of the places that may hold them.

A string of ``length`` bytes has an anchor: the smallest hash of the grams of half its length inside it. Equal strings have
equal anchors, so a string can only be repeated where its anchor is one of several places. The starts that share an
anchor make a piece of a text (their bytes to the end of the last string); pieces meet by their anchors. Equal pieces are
counted first and kept once, copies of whole texts before that. The different pieces of some anchors are one buffer, whose
suffixes are sorted in two stages: those that are smaller than their successors directly, all others by one scan of the
buckets; then neighbours in that order with a common prefix of ``length`` are repeated strings.

An anchor with more than CROWD different pieces (a passage just shorter than ``length`` in very many texts) is no buffer:
its strings meet by their 128-bit hashes, one row for each start and piece, so its work is spread over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, heavy_join, utf8_rows
from tessera.llm.packed import each_group, pack, unpack

LENGTH = 400
#: Different pieces of an anchor that go into one buffer, and bytes of a buffer at which it is sorted.
CROWD, BUFFER = 1000, 1 << 19
#: Starts of a piece, and bytes of texts that are hashed at a time.
STARTS, SLAB = 1024, 1 << 20
#: Bytes of pieces that are handed on at a time.
HANDED = 8 << 20

_RNG = np.random.default_rng(400)
_LETTERS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_PLACE = np.uint64((1 << 21) - 1)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the power of 64."""
    if not _POWERS:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(SLAB + 2 * STARTS, b & ((1 << 64) - 1), np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps))
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram of ``gram`` bytes, all at once by prefix sums of a polynomial."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
    out = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a text's strings, in order, and the start from which each holds (one more at the end).

    A range of starts with one anchor is cut after STARTS. Where the anchor stands at several places of it, so that a
    string may be repeated inside the range, it is cut in two at least: the anchor is there twice. A text that is
    shorter than a string has none.
    """
    gram = length // 2
    total = len(text) - length + 1
    keys, starts = [], []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, total), SLAB - length):
        hashes = gram_hashes(data[at : min(len(text), at + SLAB - 1)], gram)
        # The last bits hold the position, so the minimum is also the first place of the smallest hash.
        placed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = smallest(placed, length - gram + 1) & _PLACE
        own = hashes[place.astype(np.int64)]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ends = np.append(first[1:], len(own))
        for k in np.flatnonzero((place[first] != place[ends - 1]) | (ends - first > STARTS))[::-1].tolist():
            step = min(STARTS, -(-int(ends[k] - first[k]) // 2))
            first = np.insert(first, k + 1, np.arange(first[k] + step, ends[k], step))
        keys.append(own[first])
        starts.append(first + at)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(keys), np.append(np.concatenate(starts), total).astype(np.int64)


def two_stage(data: np.ndarray, alive: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``alive`` (a mask) in order of their suffixes, which are told apart by ``depth`` bytes at least.

    A suffix that is smaller than its successor is sorted directly. Any other follows from its successor's place: the
    buckets of first bytes are scanned in order, and each suffix found puts its predecessor, where that is larger,
    behind those already in the predecessor's bucket. The successors of such positions have to be alive too.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # Smaller than the successor: the next different byte is larger; behind the last byte all is smaller.
    turns = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    rises = np.append(data[turns[:-1]] < data[turns[:-1] + 1], False)
    small = np.repeat(rises, np.diff(np.concatenate([[-1], turns])))
    raw = data.tobytes()
    direct = np.flatnonzero(alive & small).tolist()
    direct.sort(key=lambda i: raw[i : i + depth])
    direct = np.array(direct, np.int64)
    n_large, n_small = np.bincount(data[alive & ~small], minlength=256), np.bincount(data[direct], minlength=256)
    ends = np.cumsum(n_large + n_small)
    begins = ends - n_large - n_small
    order = np.empty(int(ends[-1]), np.int64)
    inside = np.arange(len(direct)) - np.repeat(np.cumsum(n_small) - n_small, n_small)
    order[np.repeat(begins + n_large, n_small) + inside] = direct
    filled = begins.copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[alive[before] & ~small[before]]
        if not len(before):
            return
        first = data[before]
        by = np.argsort(first, kind="stable")
        before, counts = before[by], np.bincount(first, minlength=256)
        at = np.arange(len(before)) - np.repeat(np.cumsum(counts) - counts, counts)
        order[np.repeat(filled, counts) + at] = before
        filled[:] += counts

    induce(np.array([n], np.int64))
    for c in np.flatnonzero(n_large + n_small).tolist():
        at = int(begins[c])
        while at < filled[c]:  # suffixes of equal first bytes induce each other
            upto = int(filled[c])
            induce(order[at:upto])
            at = upto
        induce(order[begins[c] + n_large[c] : ends[c]])
    return order


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` have in common, by steps of eight and up to ``most`` (eight at least)."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    words = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,))  # the eight bytes at each position
    left = np.arange(len(a))
    for at in [*range(0, most - 7, 8), *([most - 8] if most % 8 else [])]:
        left = left[words[a[left] + at] == words[b[left] + at]]
        out[left] = at + 8
        if not len(left):
            break
    return out


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each piece a mask of the starts whose string is also at another start of any of the pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum(sizes) - sizes
    starts = np.zeros(len(data), bool)
    for at, size in zip(begins.tolist(), sizes.tolist()):
        starts[at : at + size - length + 1] = True
    # A start's suffix may follow from its successors, up to the next one that is sorted directly.
    rest = data[:-1] < data[1:]
    rises = np.append(np.flatnonzero(rest), len(data) - 1)
    lasts = begins + sizes - length
    upto = rises[np.searchsorted(rises, lasts)]
    alive = starts.copy()
    for a, b in zip(lasts.tolist(), upto.tolist()):
        alive[a : b + 1] = True
    order = two_stage(data, alive, length)
    order = order[starts[order]]
    same = common_prefix(data, order[:-1], order[1:], length) >= length
    found = np.zeros(len(data), bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return [found[at : at + size - length + 1] for at, size in zip(begins.tolist(), sizes.tolist())]


def _ranges(mask: np.ndarray) -> np.ndarray:
    """Begin and end (exclusive) of each row of true values, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5("text")))


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """``digest, doc_id, n, sha, keys, starts`` of each row: the digest of its text, its bytes, its anchors."""

    def run(batches):
        for batch in batches:
            texts = utf8_rows(batch.column(2))
            found = [anchors(t, length) for t in texts]
            keys, starts = ([f[i] for f in found] for i in (0, 1))
            packed = [pack(np.concatenate([*x, np.zeros(0, t)]), np.cumsum([0, *map(len, x)])) for x, t in ((keys, np.uint64), (starts, np.int64))]
            sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), sha, *packed], names=["digest", "doc_id", "n", "sha", "keys", "starts"])

    return _texts(docs).select("digest", "doc_id", "text").mapInArrow(_small(run), "digest binary, doc_id long, n long, sha string, keys binary, starts binary")


def _small(run, rows: int = 512):
    return lambda batches: run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _places(nodes: DataFrame) -> DataFrame:
    """``key, digest, begin, end``: the ranges of starts of each anchor, end exclusive."""

    def run(batches):
        for batch in batches:
            keys, cuts = unpack(batch.column(1), "<i8")
            starts, _ = unpack(batch.column(2), "<i8")  # one more for each row
            owner = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
            at = np.arange(len(keys)) + owner
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(owner)), pa.array(starts[at]), pa.array(starts[at + 1])], names=["key", "digest", "begin", "end"])

    return nodes.select("digest", "keys", "starts").mapInArrow(_small(run, 4096), "key long, digest binary, begin long, end long")


def _cut(wanted: DataFrame, length: int) -> DataFrame:
    """``key, piece, digest, begin, bytes``: the pieces of texts (``digest, text, ranges``), ``piece`` a hash of the bytes."""
    from xxhash import xxh3_128_digest

    kinds = pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "piece", "digest", "begin", "bytes"])

    def run(batches):
        out, size = [], 0
        for batch in batches:
            for digest, text, ranges in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), batch.column(2).to_pylist()):
                for r in ranges:
                    piece = text[r["begin"] : r["end"] - 1 + length]
                    out.append((r["key"], xxh3_128_digest(piece), digest, r["begin"], piece))
                    size += len(piece)
                    if size >= HANDED:
                        yield made(out)
                        out, size = [], 0
        if out:
            yield made(out)

    return wanted.select("digest", "text", "ranges").mapInArrow(_small(run, 64), "key long, piece binary, digest binary, begin long, bytes binary")


_FOUND = "piece binary, first long, upto long"


def _sorted_buffers(pieces: DataFrame, length: int) -> DataFrame:
    """``piece, first, upto``: ranges of repeated starts inside each piece; all pieces of an anchor are in one buffer."""

    def flush(held):
        found = [_ranges(m) for m in repeated_starts([b for _, b in held], length)]
        names = [p for (p, _), f in zip(held, found) for _ in range(len(f) // 2)]
        both = np.concatenate([*found, np.zeros(0, np.int64)]).reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["piece", "first", "upto"])

    def run(batches):
        held, size = [], 0
        for group in each_group(batches):
            for piece, data in zip(group.column(1).to_pylist(), group.column(2).to_pylist()):
                held.append((piece, data))
                size += len(data)
            if size >= BUFFER:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return pieces.select("key", "piece", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def _met_by_hash(pieces: DataFrame, length: int) -> DataFrame:
    """``piece, first, upto`` for the pieces of crowded anchors, a single start a row."""
    from xxhash import xxh3_128_digest

    def run(batches):
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(data) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([piece] * n, pa.binary()), pa.array(np.arange(n)), pa.array([xxh3_128_digest(data[i : i + length]) for i in range(n)], pa.binary())], names=["piece", "first", "own"])

    rows = pieces.select("piece", "bytes").mapInArrow(run, "piece binary, first long, own binary")
    several = rows.groupBy("own").agg(F.count("*").alias("n")).filter("n > 1")
    return heavy_join(rows, several, "own").select("piece", "first", (F.col("first") + 1).alias("upto"))


def _kept(texts: DataFrame, length: int) -> DataFrame:
    """``digest, spans, kept_sha``: what goes of each text with ``found``, its ranges of repeated starts."""

    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for text, found in zip(utf8_rows(batch.column(1)), batch.column(2).to_pylist()):
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, [f["first"] for f in found], 1)
                np.add.at(depth, [f["upto"] - 1 + length for f in found], -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans.append([{"start": a, "end": b} for a, b in _ranges(gone).reshape(-1, 2).tolist()])
                kept.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], names=["digest", "spans", "kept_sha"])

    return texts.select("digest", "text", "found").mapInArrow(_small(run, 64), "digest binary, spans array<struct<start:long,end:long>>, kept_sha string")


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, spans, kept_sha256`` for each row of ``docs`` (``doc_id, text``; other columns are not read).

    A byte is removed where a string of ``length`` bytes that also starts anywhere else, in the same text or another,
    covers it; strings never cross texts. ``spans`` are the maximal removed stretches (``start, end``, in bytes of the
    UTF-8 text), ``kept_sha256`` is of what is left. Each row is a text of its own, so a repeated row of ``length`` bytes
    or more is removed whole wherever it stands; null and empty texts, and shorter ones, lose nothing; a null doc_id
    stays null; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = scratch.keep(_anchored(docs, length), "rows")
    long = rows.filter(F.col("n") >= length)
    nodes = scratch.keep(long.groupBy("digest").agg(F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("starts").alias("starts")), "nodes")
    places = scratch.keep(_places(nodes), "places")
    shared = scratch.keep(places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    ranges = F.collect_list(F.struct("key", "begin", "end")).alias("ranges")
    wanted = scratch.keep(heavy_join(places, shared, "key").groupBy("digest").agg(ranges), "wanted")
    # One text of each digest, by partial aggregates first; only texts that may hold a repeated string are kept.
    texts = _texts(docs).filter(F.octet_length("text") >= length).groupBy("digest").agg(F.first("text").alias("text"))
    texts = scratch.keep(texts.join(wanted.hint("shuffle_merge"), "digest"), "texts")
    pieces = scratch.keep(_cut(texts, length), "pieces")
    distinct = scratch.keep(pieces.groupBy("piece").agg(F.first("key").alias("key"), F.count("*").alias("n"), F.first("bytes").alias("bytes")), "distinct")
    kinds = scratch.keep(distinct.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "kinds")
    several = heavy_join(distinct.select("key", "piece", "bytes"), kinds, "key", keep_count=True)
    buffers, crowded = several.filter(F.col("n") <= CROWD), several.filter(F.col("n") > CROWD)
    found = scratch.keep(_sorted_buffers(buffers, length).unionAll(_met_by_hash(crowded, length)), "found")
    # A piece that is there several times is repeated from its first to its last start.
    at = pieces.select("piece", "digest", "begin", (F.octet_length("bytes") - length + 1).cast("long").alias("starts"))
    counts = distinct.select("piece", "n")
    whole = heavy_join(at, counts.filter("n > 1"), "piece").select("digest", F.col("begin").alias("first"), (F.col("begin") + F.col("starts")).alias("upto"))
    some = heavy_join(at, found.join(counts, "piece"), "piece").select("digest", (F.col("begin") + F.col("first")).alias("first"), (F.col("begin") + F.col("upto")).alias("upto"))
    listed = whole.unionAll(some).groupBy("digest").agg(F.collect_list(F.struct("first", "upto")).alias("found"))
    cut = scratch.keep(_kept(texts.select("digest", "text").join(listed.hint("shuffle_merge"), "digest"), length), "cut")
    return scratch.finish(_results(rows.select("digest", "doc_id", "n", "sha"), nodes.select("digest", "n"), cut, length), "result")


def _results(rows: DataFrame, nodes: DataFrame, cut: DataFrame, length: int) -> DataFrame:
    copies = nodes.filter("n > 1").withColumn("copied", F.lit(True))
    flagged = heavy_join(rows.withColumnRenamed("n", "n_bytes"), copies, "digest", "left")
    # Copies lose everything and need nothing from the join; a key by doc_id deals them out.
    by = F.when(F.col("copied"), F.unhex(F.hex(F.xxhash64("doc_id")))).otherwise(F.col("digest"))
    out = flagged.withColumn("by", by).join(cut.withColumnRenamed("digest", "by").hint("shuffle_merge"), "by", "left")
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    all_of_it = F.array(span(F.lit(0), F.col("n_bytes")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.when(F.col("copied"), all_of_it).otherwise(F.coalesce("spans", none))
    sha = F.when(F.col("copied"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha"))
    return out.select("doc_id", "n_bytes", spans.alias("spans"), sha.alias("kept_sha256"))
