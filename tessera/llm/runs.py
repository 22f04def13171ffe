"""Runs (maximal stretches of a smallest period) in sequences of words, by a suffix automaton.

The end positions of a state of the automaton are the union of those of the states linked to it. Smaller sets are merged
into larger ones, kept in order; where a position comes beside another one, ``d`` words away, in a state of length
``l >= d``, the ``l`` words before both are equal, so ``l + d`` words up to the later one have the period ``d``. The state
in which two positions first meet has the length of their longest common suffix, so such a seed reaches as far to the
left as its period does, and the one at which the period ends on the right is the whole run: each run has exactly one.

Only stretches that can hold a run of at least FOLD periods go into an automaton. In such a run every triple of words, but
those of the first period, stands at most a period behind an equal one; so a row of triples that repeat at a distance of
at most Q, of about 1.5 Q triples or more, is looked for at each power of two Q. Other stretches can't hold one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import utf8_rows

#: A run has at least LEAST words and FOLD periods.
LEAST, FOLD = 6, 4
GRAM = 3
#: Positions of a piece of an ordered set; a longer piece is cut in two.
PIECE = 512


class Ends:
    """An ordered set of positions in pieces of bounded length."""

    __slots__ = ("pieces", "tops", "size")

    def __init__(self, first: int | None = None):
        self.pieces: list[list[int]] = [] if first is None else [[first]]
        self.tops: list[int] = [] if first is None else [first]
        self.size = 0 if first is None else 1

    def __iter__(self):
        for piece in self.pieces:
            yield from piece

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert a position that is not there yet; the ones before and after it."""
        self.size += 1
        if not self.pieces:
            self.pieces, self.tops = [[x]], [x]
            return None, None
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        piece = self.pieces[k]
        at = bisect_left(piece, x)
        before = piece[at - 1] if at else (self.pieces[k - 1][-1] if k else None)
        after = piece[at] if at < len(piece) else None  # a position after the last piece has none
        piece.insert(at, x)
        self.tops[k] = piece[-1]
        if len(piece) > PIECE:
            half = len(piece) // 2
            self.pieces[k : k + 1] = [piece[:half], piece[half:]]
            self.tops[k : k + 1] = [piece[half - 1], piece[-1]]
        return before, after


def automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state of the suffix automaton: its length, its link, and the position it was made for (-1 for clones)."""
    length, link, made, moves = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(codes):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        made.append(at)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                made.append(-1)
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, made


def seeds(codes: list[int], least: int = LEAST, fold: int = FOLD):
    """``start, end, period`` of squares that are long enough to be runs, ends inclusive; each run is among them."""
    length, link, made = automaton(codes)
    # A seed has l + d >= max(least, fold * d) words, so no state shorter than this makes one.
    shortest = min(max(least - d, (fold - 1) * d) for d in range(1, least + 1))
    sets: dict[int, Ends] = {}
    for v in np.argsort(-np.array(length), kind="stable").tolist():
        own = sets.pop(v, None)
        if made[v] >= 0:
            if own is None:
                own = Ends(made[v])
            else:
                yield from _joined(own, (made[v],), length[v], least, fold)
        parent = link[v]
        if own is None or parent < 0 or length[parent] < shortest:
            continue
        other = sets.get(parent)
        if other is None:
            sets[parent] = own
            continue
        small, large = (own, other) if own.size <= other.size else (other, own)
        sets[parent] = large
        yield from _joined(large, small, length[parent], least, fold)


def _joined(large: Ends, small, l: int, least: int, fold: int):
    for x in small:
        before, after = large.add(x)
        for low, high in ((before, x), (x, after)):
            if low is not None and high is not None:
                d = high - low
                if l + d >= max(least, fold * d):
                    yield low - l + 1, high, d


def stretches(codes: np.ndarray, fold: int = FOLD) -> list[tuple[int, int]]:
    """Ranges of positions (end exclusive) outside of which no run of ``fold`` periods or more can lie."""
    n = len(codes)
    if n < LEAST:
        return []
    mixed = codes[: n - 2].astype(np.uint64)
    for k in (1, 2):
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ codes[k : n - 2 + k].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order[1:]] == mixed[order[:-1]]
    back = np.full(n - 2, n, np.int64)
    back[order[1:][equal]] = (order[1:] - order[:-1])[equal]
    near = np.flatnonzero(back <= n // fold)
    found, q = [], 1
    while len(near) and q <= 2 * (n // fold):
        own = near[back[near] <= q]
        # Periods above q / 2 leave (fold - 1) * (q // 2 + 1) - 2 such triples at least; a period of one leaves three.
        need = LEAST - 3 if q == 1 else (fold - 1) * (q // 2 + 1) - GRAM + 1
        if len(own) >= need:
            cuts = np.flatnonzero(np.diff(own) != 1)
            for a, b in zip(own[np.concatenate([[0], cuts + 1])].tolist(), own[np.concatenate([cuts, [len(own) - 1]])].tolist()):
                if b - a + 1 >= need:
                    found.append((max(0, a - q), b + GRAM))
        q *= 2
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def runs(words: list) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run of at least LEAST words and FOLD periods, by start, then period."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = set()
    for a, b in stretches(codes):
        for start, end, d in seeds(codes[a:b].tolist()):
            start, end = start + a, end + a
            # Whole runs only: no word on either side goes on with the period.
            if (start == 0 or codes[start - 1] != codes[start - 1 + d]) and (end == len(codes) - 1 or codes[end + 1] != codes[end + 1 - d]):
                found.add((start, end - start + 1, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that stay if of each run only the first period does."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


_RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _mapped(docs: DataFrame, of_row, schema: str) -> DataFrame:
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(key, *of_row(text.split())) for key, text in zip(part.column(0).to_pylist(), utf8_rows(part.column(1)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), made)], schema=made)

    return _rows(docs).mapInArrow(run, schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs`` (``doc_id, text``; other columns are not read).

    Words stand between ASCII white space. ``runs`` has ``start, length, period`` of all runs by start, then period;
    ``collapsed`` is the text with the words of each run after its first period taken out, a space between words. Each
    row is worked on by itself, so nothing is shuffled; null and empty texts have no words; a null doc_id stays null;
    repeated rows repeat; an empty table gives no rows.
    """

    def of_row(words):
        found = runs(words)
        return len(words), [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(collapsed(words, found)).decode("utf-8", "replace")

    return _mapped(docs, of_row, _RESULT)


def run_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the run of the greatest exponent (nulls for none), and digests of all runs and of the collapsed text."""

    def of_row(words):
        found = runs(words)
        best = (None, None, None, None)
        if found:
            start, length, period = found[0]
            for r in found[1:]:  # by start, then period: only a greater exponent goes before
                if r[1] * period > length * r[2]:
                    start, length, period = r
            best = start, length, period, 1000 * length // period
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        return len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()

    return _mapped(docs, of_row, _DIGEST)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the planted repetitions of the registered query: in a tenth of the documents, by the crc32
    ``h`` of their decimal doc_id, the words from ``a`` on become the first ``p`` of them over and over. Rows without a
    doc_id, and texts without words, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = _rows(docs).select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w").cast("long")
    out = out.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    out = out.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("long"))
    at = lambda i: F.get("w", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(i < F.col("a"), F.get("w", i.cast("int"))).otherwise(at(i))), " ")
    return out.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))
