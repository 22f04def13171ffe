"""Token ids on disk: one concatenated id array per shard, with Elias-Fano encoded document boundaries.

Shards follow the order of doc_id. A shard is one file:

    ids (2 or 4 bytes each, little-endian), then four parts padded to eight bytes each:
    of the boundaries and again of the doc_ids (less the first one) the low halves (l bits each, packed) and the high
    halves (unary bit vector); last ten little-endian 64-bit numbers: documents n, ids m, bytes per id, the first doc_id,
    the low bits of both sequences, the lengths of the four parts, and the magic ``TESSEF02``. Ids come first, so a writer never holds them all.

Boundary i is where document i ends. ``select1(i) - i`` of the high bits is its high half, so an offset costs
``2 + log2(m / n)`` bits instead of 64; a sample of every 256th byte's rank makes select local. A reader goes through
the documents by ranges: one select, then the bits that follow it. Neither offsets nor doc_ids are a table of
64-bit numbers when reading; a writer holds 12 bytes a document until its shard is written.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.files import make_dirs, open_read, open_write

MAGIC = b"TESSEF02"
SAMPLE = 256
#: Pieces of text in each half of a worker's memory (about 130 MB a half).
REMEMBER = 700_000


class EliasFano:
    """A non-decreasing sequence below ``universe`` in near-minimal space, with random access by select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        counts = np.bitwise_count(high)
        self.ranks = np.concatenate([[0], np.cumsum(counts[: len(counts) // SAMPLE * SAMPLE].reshape(-1, SAMPLE).sum(1, dtype=np.int64))]) if len(counts) else np.zeros(1, np.int64)

    @classmethod
    def encode(cls, blocks: Iterable[np.ndarray], n: int, universe: int) -> EliasFano:
        """From the values in blocks, ``n`` in all."""
        low_bits = min(62, max(0, (universe // n).bit_length() - 1)) if n and universe > n else 0
        high, low, first = np.zeros(-(-(n + (universe >> low_bits) + 1) // 8), np.uint8), [], 0
        carry = np.zeros(0, np.uint8)
        for values in blocks:
            values = values.astype(np.uint64)
            ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(first, first + len(values))
            np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            bits = np.concatenate([carry, bits.ravel()])
            whole = len(bits) // 8 * 8
            low.append(np.packbits(bits[:whole], bitorder="little"))
            carry = bits[whole:]
            first += len(values)
        low.append(np.packbits(carry, bitorder="little"))
        return cls(n, low_bits, np.concatenate(low), high)

    def _ones(self, first: int, last: int) -> np.ndarray:
        """Places of the set bits ``first`` .. ``last`` - 1: the block by the samples, then bits from there on."""
        block = int(np.searchsorted(self.ranks, first, side="right")) - 1
        at, skip, found, lacking = block * SAMPLE, first - int(self.ranks[block]), [], last - first
        while lacking > 0:
            size = max(SAMPLE, -(-lacking // 4))
            bits = np.flatnonzero(np.unpackbits(self.high[at : at + size], bitorder="little"))
            found.append(bits[skip : skip + lacking] + at * 8)
            lacking -= len(found[-1])
            skip = max(0, skip - len(bits))
            at += size
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def values(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` .. ``last`` - 1 by one select and the bits after it."""
        which = np.arange(first, last)
        high = (self._ones(first, last) - which).astype(np.uint64) << np.uint64(self.low_bits)
        return high | self._low(which)

    def select(self, i: int) -> int:
        return int(self.values(i, i + 1)[0])

    def _low(self, which: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(which), np.uint64)
        at = which[:, None].astype(np.int64) * self.low_bits + np.arange(self.low_bits)
        bit = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bit.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def write_bounds(out, doc_ids: array, lengths: array, id_bytes: int, block: int = 1 << 16) -> None:
    """What follows the ids in a shard: ``doc_ids`` in ascending order and the number of ids of each document."""
    n, total = len(doc_ids), sum(lengths)
    first, universe = (doc_ids[0], doc_ids[-1] - doc_ids[0] + 1) if n else (0, 1)

    def ends():
        upto = 0
        for a in range(0, n, block):
            found = upto + np.cumsum(np.array(lengths[a : a + block], np.int64))
            upto = int(found[-1])
            yield found

    ids = (np.array(doc_ids[a : a + block], np.int64).view(np.uint64) - np.array(first, np.int64).view(np.uint64) for a in range(0, n, block))
    bounds, names = EliasFano.encode(ends(), n, total + 1), EliasFano.encode(ids, n, universe)
    parts = [_padded(x.tobytes()) for x in (bounds.low, bounds.high, names.low, names.high)]
    for part in parts:
        out.write(part)
    out.write(struct.pack("<3Qq6Q", n, total, id_bytes, first, bounds.low_bits, names.low_bits, *map(len, parts)) + MAGIC)


TAIL = 10 * 8 + len(MAGIC)


class Shard:
    """An open shard: boundaries and doc_ids in their encoded form in memory, ids read by range."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        size = source.tell() if size is None else size
        if size < TAIL:
            raise ValueError("not a token shard")
        source.seek(size - TAIL)
        tail = source.read(TAIL)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.total, self.id_bytes, self.first, low_bits, name_bits, *sizes = struct.unpack("<3Qq6Q", tail[: -len(MAGIC)])
        if size != TAIL + sum(sizes) + self.total * self.id_bytes:
            raise ValueError("token shard is inconsistent")
        source.seek(self.total * self.id_bytes)
        parts = [np.frombuffer(source.read(x), np.uint8) for x in sizes]
        self.bounds, self.names = EliasFano(self.n, low_bits, *parts[:2]), EliasFano(self.n, name_bits, *parts[2:])

    def doc_ids(self, first: int, last: int) -> np.ndarray:
        return (self.names.values(first, last) + np.array(self.first, np.int64).view(np.uint64)).view(np.int64)

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last-1 of the shard as 32-bit numbers."""
        self.source.seek(first * self.id_bytes)
        raw = self.source.read((last - first) * self.id_bytes)
        if len(raw) != (last - first) * self.id_bytes:
            raise ValueError("token shard is cut short")
        return np.frombuffer(raw, f"<u{self.id_bytes}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, by two selects."""
        return self.read(self.bounds.select(i - 1) if i else 0, self.bounds.select(i))


class TextEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each distinct piece between spaces.

    The pre-tokenizer of the byte-level vocabularies never joins what stands before a single space to that space, so
    a text may be cut there wherever the space follows a character that is not white space. Other texts, and other
    tokenizers, are encoded whole.
    """

    def __init__(self, file: str, id_bytes: int, remember: int = REMEMBER):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        added = kind.get("added_tokens") or []
        self.by_piece = (
            kind.get("normalizer") is None and kind.get("post_processor") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        self.kind = f"<u{id_bytes}"
        vocabulary = self.tokenizer.get_vocab()
        self.added = [t["content"] for t in added]
        self.with_space = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.with_space[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True  # how byte-level vocabularies write a space
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.remember = remember

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32).astype(self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece:
            return self._whole(text)
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self._whole(text)
        last = rest.pop() if not rest[-1] or rest[-1][-1].isspace() else None
        found = list(map(self.known.get, rest))
        if None in found:
            lacking = [i for i, x in enumerate(found) if x is None]
            known = self._learn([rest[i] for i in lacking])
            if known is None:
                return self._whole(text)
            for i in lacking:
                found[i] = known[rest[i]]
        head = self.heads.get(first)
        if head is None:
            if len(self.heads) > self.remember:
                self.heads.clear()
            head = self.heads[first] = self._whole(first)
        return head + b"".join(found) + (b"" if last is None else self._whole(" " + last))

    def _learn(self, pieces: list[str]) -> dict[str, bytes] | None:
        """Put pieces into the memory, which is returned; None if one is empty or ends in white space, so that a space
        follows white space. The memory has two halves: when the new one is full, it becomes the old one."""
        if len(self.known) > self.remember:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        pieces = list(dict.fromkeys(pieces))
        ids = list(map(old.get, pieces))
        new = [c for c, x in zip(pieces, ids) if x is None]
        if any(not c or c[-1].isspace() for c in new):
            return None
        known.update((c, x) for c, x in zip(pieces, ids) if x is not None)
        # As one text, in which only the first ids of pieces start with a space, unless it holds an added token.
        text = " " + " ".join(new)
        if new and not any(t in text for t in self.added):
            raw = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
            starts = np.flatnonzero(self.with_space[raw])
            if len(starts) == len(new):
                size, packed = raw.itemsize, raw.tobytes()
                cuts = (starts * size).tolist()
                known.update(zip(new, map(packed.__getitem__, map(slice, cuts, [*cuts[1:], len(packed)]))))
                return known
        for c in new:
            known[c] = self._whole(" " + c)
        return known


@lru_cache(maxsize=2)
def _encoder(file: str, id_bytes: int) -> TextEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextEncoder(file, id_bytes)


#: Bytes of text that a shard is made of, on average, however many partitions shuffles have.
SHARD_BYTES = 1 << 30


def shard_count(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """As many shards as shuffles have partitions, more where ``text`` would be over ``shard_bytes`` in one."""
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_bytes: int = 2, shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (``doc_id, text``) and write shards below ``folder`` in ascending order of doc_id.

    Returns the manifest, one row per shard, in order: ``shard, path, n_docs, n_ids``. The texts are dealt by ranges
    of (doc_id, hash of the text), so one doc_id with many rows is split too. A task that runs twice writes twice,
    under different names; the manifest names one of them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.filter("doc_id is not null").withColumn("tie", F.xxhash64("text"))
    n = shards or shard_count(rows)
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", "tie", F.spark_partition_id().alias("shard"))
    end = np.array([end_id], f"<u{id_bytes}").tobytes()

    def run(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = first.column(3)[0].as_py()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        coder = _encoder(tokenizer_file, id_bytes)
        ids, lengths, total = array("q"), array("I"), 0
        with open_write(path) as out:
            for batch in chain([first], batches):
                ids.frombytes(batch.column(0).to_numpy().tobytes())
                for text in batch.column(1).to_pylist():
                    raw = coder.encode(text)
                    out.write(raw)
                    out.write(end)
                    lengths.append(len(raw) // id_bytes + 1)
                    total += lengths[-1]
            write_bounds(out, ids, lengths, id_bytes)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(ids)], "n_ids": [total]})

    make_dirs(docs.sparkSession, folder)
    return ordered.mapInArrow(run, "shard int, path string, n_docs long, n_ids long")


def read_tokens(spark, manifest: list, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document, from the shards a manifest lists.

    ``start`` counts the ids of all documents before. The manifest is one small row per shard.
    """
    base, listed = 0, []
    for row in sorted(manifest, key=lambda r: r.shard):
        listed.append((row.path, base))
        base += row.n_ids

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_read(path) as source:
                    shard, upto = Shard(source), 0
                    for a in range(0, shard.n, 256):
                        b = min(shard.n, a + 256)
                        cuts = np.concatenate([[upto], shard.bounds.values(a, b).astype(np.int64)])
                        ids = shard.read(upto, int(cuts[-1]))
                        own = [ids[x:y] for x, y in zip(cuts[:-1] - upto, cuts[1:] - upto)]
                        columns = [pa.array(shard.doc_ids(a, b)), pa.array(cuts[:-1] + base), pa.array(np.diff(cuts)), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                        upto = int(cuts[-1])
                        if with_ids:
                            columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    rows = spark.createDataFrame(listed, "path string, base long").repartition(max(1, len(listed)))
    return rows.mapInArrow(run, kind)


def token_store(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write all of ``docs`` as shards in the shared folder, read them back, and return one row per document:
    ``doc_id, start, n_tokens, ids_crc32`` (see ``read_tokens``).

    Null and empty texts have the end id alone; rows of one doc_id follow each other in the order of their texts'
    hashes; rows without a doc_id have no place in the order and are left out; an empty table gives no rows. The
    shards are deleted once read.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    id_bytes = 2 if max(end_id, Tokenizer.from_file(tokenizer_file).get_vocab_size() - 1) < 1 << 16 else 4
    scratch = Scratch(spark, "tokens")
    manifest = scratch.keep(write_tokens(docs, scratch.path("shards"), tokenizer_file, end_id, id_bytes), "manifest").collect()  # a row per shard
    out = scratch.keep(read_tokens(spark, manifest), "documents")
    scratch.drop(scratch.path("shards"))
    return out
