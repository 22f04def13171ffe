"""Which strings of a set stand inside which texts, whole if they are short, else by their rarest grams.

Strings of up to WHOLE characters are met as they are: tasks hash the places of their texts that begin as some string does,
as long as strings are, and the pieces that a bitmap lets through are compared as strings, by a join.

Of each longer string one gram is chosen, the rarest by a sample of the texts. Tasks hash the grams of their texts and keep those
that a bitmap of the chosen ones lets through; these meet the strings by equality, and only the strings that share a
gram with a text are looked for in it. So there is one pass over the texts whatever the number of strings, and no string
or text is gathered anywhere. A few strings need no grams: an expression looks for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import stored

#: Lengths of grams: a string has grams of the greatest that it is as long as.
GRAMS = (1, 2, 3, 4, 8, 16)
#: Strings of up to so many characters are met whole; a place of a text has as many pieces at most as these have lengths.
WHOLE = 16
#: Characters that two strings share at most where a text is looked through for how strings begin.
HEAD = 4
#: Pieces that a task hands on at a time.
HANDED = 1 << 16
#: Strings that are looked for one by one, by an expression.
FEW = 64
#: Texts that frequencies of grams are taken from: they decide what is compared, not what is found.
SAMPLED = 200
#: Bits of the bitmap for each string, and the most it may have; beyond, more grams are shuffled.
BITS, MOST_BITS = 16, 1 << 27
#: Parts that the strings of a gram are dealt to, as a gram may stand in very many texts.
SALT = 16
#: Characters that are hashed at a time.
SLAB = 1 << 18

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each ``q`` characters in a row (along the last axis), marked with their number."""
    n = codes.shape[-1] - q + 1
    out = np.full((*codes.shape[:-1], max(0, n)), q, np.uint64)
    if n > 0:
        for k in range(q):
            out = (out ^ codes[..., k : n + k]) * _FACTOR
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def gram_hashes(text: str, q: int) -> np.ndarray:
    return _hashes(_codes(text), q)


def _size(length: int) -> int:
    return max(q for q in GRAMS if q <= length)


def _all_grams(batches):
    """``s, gram, at``: the grams of each string and where they stand; strings of one length are hashed together."""
    for batch in batches:
        by_length: dict[int, list[str]] = {}
        for s in batch.column(0).to_pylist():
            by_length.setdefault(len(s), []).append(s)
        names, grams, places = [], [], []
        for length, some in by_length.items():
            own = _hashes(_codes("".join(some)).reshape(len(some), length), _size(length))
            names.append(pa.array(some, pa.string()).take(pa.array(np.repeat(np.arange(len(some)), own.shape[1]))))
            grams.append(own.ravel())
            places.append(np.tile(np.arange(own.shape[1]), len(some)))
        both = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (grams, places)]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([*names, pa.array([], pa.string())]), *map(pa.array, both)], names=["s", "gram", "at"])


def _slabs(text: str, q: int):
    """The grams of a text, part by part."""
    for at in range(0, max(1, len(text) - q + 1), SLAB):
        yield at, gram_hashes(text[at : at + SLAB + q - 1], q)


def _met(bitmap, lengths: list[int]):
    """``text_hash, gram`` of the grams of texts that the bitmap lets through."""

    def run(batches):
        words = bitmap.value
        mask = np.uint64(len(words) * 64 - 1)
        for batch in batches:
            hashes, grams = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for q in lengths:
                    for _, own in _slabs(text, q):
                        bit = own.view(np.uint64) & mask
                        own = np.unique(own[(words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)])
                        hashes.append(np.full(len(own), key, np.int64))
                        grams.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)])) for x in (hashes, grams)], names=["text_hash", "gram"])

    return run


def _second(hashes: np.ndarray) -> np.ndarray:
    """Another hash of the same."""
    out = (hashes.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) * _FACTOR
    return out ^ (out >> np.uint64(32))


def _bits(hashes: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a bitmap."""
    return hashes.view(np.uint64) & mask, _second(hashes) & mask


def _has(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = _bits(hashes, np.uint64(len(words) * 64 - 1))
    at = lambda bit: words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)
    return (at(one) & at(two)).astype(bool)


def _whole_bits(mask: int):
    """``word, mask`` of the bits of strings and of how they begin: a task's own, each word once a batch."""

    def run(batches):
        for batch in batches:
            by_length: dict[int, list[str]] = {}
            for s in batch.column(0).to_pylist():
                by_length.setdefault(len(s), []).append(s)
            bits = [np.zeros(0, np.uint64)]
            for length, some in by_length.items():
                codes = _codes("".join(some)).reshape(len(some), length)
                bits += [*_bits(_hashes(codes, length)[:, 0], np.uint64(mask)), *_bits(_hashes(codes[:, :HEAD], min(HEAD, length))[:, 0] ^ np.int64(1), np.uint64(mask))]
            bits = np.unique(np.concatenate(bits))
            word, first = np.unique(bits >> np.uint64(6), return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), first) if len(bits) else bits
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(values.view(np.int64))], names=["word", "mask"])

    return run


def _pieces(text: str, words: np.ndarray, lengths: list[int]):
    """The different pieces of a text that the bitmap lets through, part by part."""
    seen, size = set(), min(SLAB, HANDED)
    for at in range(0, len(text), size):
        part = text[at : at + size + max(lengths) - 1]
        codes, found = _codes(part), set()
        for head in {min(HEAD, n) for n in lengths}:
            begins = np.flatnonzero(_has(words, _hashes(codes, head)[:size] ^ np.int64(1)))
            for n in lengths if len(begins) else ():
                if min(HEAD, n) == head:
                    places = begins[begins + n <= len(part)]
                    whole = _hashes(codes[places[:, None] + np.arange(n)], n)[:, 0]
                    found.update(part[p : p + n] for p in places[_has(words, whole)].tolist())
        yield found - seen
        seen |= found


def _met_whole(bitmap, lengths: list[int]):
    """``key, string`` of the pieces of texts that may be strings."""

    def run(batches):
        for batch in batches:
            rows, strings = [], []
            made = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(strings, pa.string())], names=["key", "string"])  # noqa: B023, E731
            for i, text in enumerate(batch.column(1).to_pylist()):
                for found in _pieces(text, bitmap.value, lengths):
                    rows += [i] * len(found)
                    strings += found
                    if len(strings) > HANDED:
                        yield made()
                        rows, strings = [], []
            yield made()

    return run


def _bitmap(words: DataFrame, bits: int) -> np.ndarray:
    found = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # MOST_BITS / 64 rows at most
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[found["word"].to_numpy()] = found["mask"].to_numpy()
    return bitmap.view(np.uint64)


def _held_whole(rows: DataFrame, wanted: DataFrame, total: int, lengths: list[int], once: bool) -> DataFrame:
    """``key, string`` for strings of these lengths: each piece of a text that is one, once a text."""
    bits = min(MOST_BITS, 1 << max(6, (BITS * total - 1).bit_length()))
    sent = rows.sparkSession.sparkContext.broadcast(_bitmap(wanted.mapInArrow(_whole_bits(bits - 1), "word long, mask long"), bits))
    met = rows.select("key", "text").mapInArrow(_met_whole(sent, lengths), f"key {rows.schema['key'].dataType.simpleString()}, string string")
    return (met.distinct() if once else met).join(wanted.select(F.col("s").alias("string")), "string", "left_semi").select("key", "string")


def _found(text: str, candidates: list[dict]) -> list[str]:
    """The candidates (``s, gram, at``) that the text holds, looked for where their grams stand."""
    by_size: dict[int, dict[int, list]] = {}
    for c in candidates:
        by_size.setdefault(_size(len(c["s"])), {}).setdefault(c["gram"], []).append((c["s"], c["at"]))
    out = []
    for q, by_gram in by_size.items():
        wanted = np.array(sorted(by_gram), np.int64)
        left = {g: dict(x) for g, x in by_gram.items()}
        for first, own in _slabs(text, q):
            for place in np.flatnonzero(np.isin(own, wanted)).tolist():
                strings = left[int(own[place])]
                hit = [s for s, at in strings.items() if first + place >= at and text.startswith(s, first + place - at)]
                for s in hit:
                    del strings[s]
                out += hit
    return out


def held_strings(texts: DataFrame, key: str, text: Column, strings: DataFrame, once: bool = False) -> DataFrame:
    """``key, string``: for each row of ``texts`` the different strings (first column of ``strings``) that its text holds.

    Null keys stay; null texts hold nothing; null and empty strings are not looked for; equal rows give equal results,
    with ``once`` a single one. Characters are compared as they are, whatever their case.
    """
    rows = texts.select(F.col(key).alias("key"), text.cast("string").alias("text")).filter("text is not null").withColumn("text_hash", F.xxhash64("text"))
    wanted = stored(strings.select(F.col(strings.columns[0]).cast("string").alias("s")).filter("s <> ''").distinct(), "strings")
    few = [r.s for r in wanted.limit(FEW + 1).collect()]
    if 0 < len(few) <= FEW:
        held = F.filter(F.array(*map(F.lit, few)), lambda s: F.contains(F.col("text"), s))
        out = rows.select(F.col("key"), F.explode(held).alias("string")).withColumnRenamed("key", key)
        return out.distinct() if once else out
    size = F.char_length("s")
    short = wanted.filter(size <= WHOLE).groupBy(size.alias("length")).agg(F.count("*").alias("n")).collect()  # WHOLE rows at most
    out = rows.select("key", F.lit("").alias("string")).limit(0)
    if short:
        out = _held_whole(rows, wanted.filter(size <= WHOLE), sum(r.n for r in short), sorted(r.length for r in short), once)
    longer = _held_by_grams(rows, wanted.filter(size > WHOLE))
    if longer is not None:
        out = out.unionByName(longer.distinct() if once else longer)
    return out.withColumnRenamed("key", key)


def _held_by_grams(rows: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """``key, string`` for strings of any length; None if there are no strings."""
    kind = rows.schema["key"].dataType.simpleString()
    bounds = [F.count_if((F.char_length("s") >= q) & (F.char_length("s") < after)).alias(str(q)) for q, after in zip(GRAMS, (*GRAMS[1:], 1 << 31))]
    counts = wanted.agg(F.count("*").alias("total"), *bounds).first()
    lengths = [q for q in GRAMS if counts[str(q)]]
    if not lengths:
        return None

    # The rarest gram of each string, in a sample of the texts and among the strings.
    every = np.full(1, 2**64 - 1, np.uint64)
    sent = rows.sparkSession.sparkContext.broadcast(every)
    seen = rows.limit(SAMPLED).select("text_hash", "text").mapInArrow(_met(sent, lengths), "text_hash long, gram long").groupBy("gram").agg(F.count("*").alias("n"))
    grams = stored(wanted.mapInArrow(_all_grams, "s string, gram long, at long"), "all-grams")
    sharing = grams.groupBy("gram").agg(F.count("*").alias("sharing"))
    grams = grams.join(sharing, "gram").join(seen, "gram", "left")
    best = F.min_by(F.struct("gram", "at"), F.struct(F.coalesce("n", F.lit(0)) + F.col("sharing"), F.col("gram")))
    chosen = stored(grams.groupBy("s").agg(best.alias("x")).select("s", "x.gram", "x.at"), "grams")

    # A bitmap of the chosen grams, of bounded size.
    bits = min(MOST_BITS, 1 << max(6, (BITS * counts.total - 1).bit_length()))
    bit = F.col("gram").bitwiseAND(F.lit(bits - 1))
    words = chosen.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast((gram & {bits - 1}L) & 63L as int))").alias("mask"))
    sent = rows.sparkSession.sparkContext.broadcast(_bitmap(words, bits))
    met = rows.select("text_hash", "text").mapInArrow(_met(sent, lengths), "text_hash long, gram long").distinct()

    # Strings that share a gram with a text, and the text again.
    salted = met.withColumn("salt", F.pmod("text_hash", F.lit(SALT)))
    spread = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    asked = salted.join(spread, ["gram", "salt"]).groupBy("text_hash").agg(F.collect_list(F.struct("s", "gram", "at")).alias("candidates"))

    def look(batches):
        for batch in batches:
            found = [_found(t, c) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([s for x in found for s in x], pa.string())], names=["key", "string"])

    return rows.join(asked, "text_hash").select("key", "text", "candidates").mapInArrow(look, f"key {kind}, string string")
