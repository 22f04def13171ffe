"""Text vectors without an outside encoder: weighted word counts projected on their leading singular directions.

Words are hashed to a fixed number of slots, so no vocabulary is kept and every word counts. The rows of the matrix are
texts: (1 + ln of the count) times the slot's inverse document frequency, scaled to length one. Its leading right singular
vectors are found by randomised power iteration: each round is one pass over all texts in which tasks add up their part
of X'(XV) for a block of directions V, the parts are summed by blocks of slots, and the directions are made orthogonal
again. What the driver and the tasks hold is slots times directions, whatever the number of texts. New texts are folded in
by the same projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import dropped, stored

SLOTS, DIRECTIONS, ROUNDS = 1 << 15, 64, 4
#: Directions beyond those asked for, which make the last of these settle sooner; slots that are summed together.
SPARE, BLOCK = 8, 512
#: Entries (a slot of a text) that are multiplied at a time.
ENTRIES = 50_000
_PART = "block int, part binary"


def slots_of(text: Column, slots: int = SLOTS) -> Column:
    """The slot of each word (letters, digits and underscores, lower-cased), repeats included; none for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda x: x != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(slots)).cast("int"))


def _entries(flat: np.ndarray, sizes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and count of what rows hold, by row and slot."""
    key, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * slots + flat, return_counts=True)
    return key // slots, key % slots, count


def _weighted(row: np.ndarray, slot: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    weight = (1 + np.log(count)) * idf[slot]
    length = np.sqrt(np.bincount(row, weight * weight, minlength=n))
    return weight / np.where(length > 0, length, 1)[row]


def _projected(row, slot, weight, basis: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, basis.shape[1]))
    for a in range(0, len(row), ENTRIES):
        own = row[a : a + ENTRIES]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(basis[slot[a : a + ENTRIES]] * weight[a : a + ENTRIES, None], first, axis=0)
    return out


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(texts: DataFrame, text: Column, slots: int) -> DataFrame:
    """``slots, counts``: the slots of each text in order and how often each is there, found once for all passes."""

    def run(batches):
        for batch in batches:
            flat, sizes = _lists(batch.column(0))
            row, slot, count = _entries(flat, sizes, slots)
            cuts = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            both = (pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (slot, count))
            yield pa.RecordBatch.from_arrays([*both], names=["slots", "counts"])

    return texts.select(slots_of(text, slots)).mapInArrow(run, "slots array<int>, counts array<int>")


def _summed(rows: DataFrame, per_batch, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all batches of a matrix of a row for each slot; tasks add theirs up, blocks of slots are summed by key."""

    def part(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                slot, sizes = _lists(batch.column(0))
                per_batch(np.repeat(np.arange(len(sizes)), sizes), slot, _lists(batch.column(1))[0], len(sizes), total)
        found = [k for k in range(0, shape[0], BLOCK) if total[k : k + BLOCK].any()]
        for k in found:
            yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK], pa.int32()), "part": [total[k : k + BLOCK].tobytes()]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw).reshape(-1, shape[1])
                sums[block] = sums[block] + own if block in sums else own
        for block, own in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "part": [own.tobytes()]})

    out = np.zeros(shape)
    for r in rows.mapInArrow(part, _PART).repartition("block").mapInArrow(add, _PART).collect():  # SLOTS / BLOCK rows
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.part).reshape(-1, shape[1])
    return out


@dataclass
class LatentModel:
    """``idf`` by slot, ``basis`` (slots x directions, orthonormal) and the singular values, largest first."""

    idf: np.ndarray
    basis: np.ndarray
    singular: np.ndarray
    _shared: object = field(default=None, init=False, repr=False, compare=False)

    @classmethod
    def fit(cls, texts: DataFrame, text_col: str = "text", directions: int = DIRECTIONS, slots: int = SLOTS, rounds: int = ROUNDS, seed: int = 7) -> LatentModel:
        """Fit on all rows of ``texts``; null and empty texts count as texts without words.

        A word of all texts weighs little, ln((1 + n) / (1 + df)) + 1, and never nothing. Directions the texts don't
        have (fewer texts than directions, or an empty table) have the singular value 0 and are zero.
        """
        if slots < 1 or not 1 <= directions <= slots or rounds < 1:
            raise ValueError("slots, directions and rounds must be positive, and directions no more than slots")
        hashed = stored(_counted(texts, F.col(text_col), slots), "slots")

        def frequencies(row, slot, count, n, total):
            total[:, 0] += np.bincount(slot, minlength=slots)

        n = hashed.count()
        df = _summed(hashed, frequencies, (slots, 1))[:, 0]
        idf = np.log((1 + n) / (1 + df)) + 1
        width = min(slots, directions + SPARE)
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((slots, width)) * (df > 0)[:, None])[0]
        context = texts.sparkSession.sparkContext
        for k in range(rounds + 1):
            sent = context.broadcast((idf, basis))

            def gram(row, slot, count, n, total, sent=sent):
                idf, basis = sent.value
                weight = _weighted(row, slot, count, idf, n)
                across = _projected(row, slot, weight, basis, n)
                order = np.argsort(slot, kind="stable")
                total += _projected(slot[order], row[order], weight[order], across, slots)

            product = _summed(hashed, gram, basis.shape)
            sent.destroy()
            if k < rounds:
                basis = np.linalg.qr(product)[0]
        values, turn = np.linalg.eigh(basis.T @ product)
        values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
        keep = values[:directions] > 1e-9 * max(values[0], 1e-300)
        basis = (basis @ turn)[:, :directions] * keep
        basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(directions)] < 0, -1, 1)  # the largest component is positive
        dropped(hashed)
        return cls(idf, basis, np.sqrt(values[:directions] * keep))

    def vectors(self, text: Column) -> Column:
        """The vector of each text, of length one; zeros for a text without known directions."""
        spark = SparkSession.getActiveSession()
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast((self.idf, self.basis))
        sent, slots = self._shared, len(self.idf)

        def encode(rows: pd.Series) -> pd.Series:
            idf, basis = sent.value
            out = []
            for a in range(0, len(rows), 256):
                own = rows.iloc[a : a + 256]
                sizes = own.map(len).to_numpy(np.int64)
                flat = np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64)
                row, slot, count = _entries(flat, sizes, slots)
                x = _projected(row, slot, _weighted(row, slot, count, idf, len(own)), basis, len(own))
                length = np.sqrt((x * x).sum(1, keepdims=True))
                out.extend(x / np.where(length > 1e-12, length, np.inf))
            return pd.Series(out, index=rows.index, dtype=object)

        return F.pandas_udf(encode, "array<double>")(slots_of(text, slots))

    def save(self, spark: SparkSession, at: str) -> None:
        row = (len(self.idf), self.idf.tobytes(), self.basis.tobytes(), self.singular.tolist())
        spark.createDataFrame([row], "slots int, idf binary, basis binary, singular array<double>").coalesce(1).write.mode("overwrite").parquet(at)

    @classmethod
    def load(cls, spark: SparkSession, at: str) -> LatentModel:
        r = spark.read.parquet(at).first()  # one row of fixed size
        return cls(np.frombuffer(r.idf), np.frombuffer(r.basis).reshape(r.slots, -1), np.array(r.singular))
