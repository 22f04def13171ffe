"""Batch numbers under a memory bound, however large a part is.

A batch ends where the next row would pass the bound, so a row's number depends on all rows of its part before it. Rows are
sorted into slabs (ranges of the order). What a slab does to the batch that is open at its start is a function of the bytes in
that batch, made of few pieces: only where the first break falls matters, and it falls within the first ``limit`` bytes. These
functions are composed over slabs at distances 1, 2, 4, ...; then each slab is numbered on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.names import spare
from tessera.sources.shared import dropped, stored

# A piece holds for bytes in (lo, hi]: the open batch then has ``held`` bytes (plus those it had before, for a shift), ``more`` batches
# later. ``final`` says that the numbers count from the start of the part: whatever lies before doesn't matter.
PIECE = "slab int, lo long, hi long, shift boolean, held long, more long, final boolean"
FIELDS = ["lo", "hi", "shift", "held", "more", "final"]
TYPES = {"lo": "int64", "hi": "int64", "shift": "bool", "held": "int64", "more": "int64"}
MOST = 1 << 62


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _merged(pieces: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring pieces of one outcome as one."""
    pieces = pieces.sort_values("lo", kind="stable").reset_index(drop=True)
    outcome = pieces[["shift", "held", "more"]]
    group = (outcome != outcome.shift()).any(axis=1).cumsum()
    return pieces.groupby(group, sort=False).agg(lo=("lo", "first"), hi=("hi", "last"), shift=("shift", "first"), held=("held", "first"), more=("more", "first"))


def slab_pieces(sizes: np.ndarray, limit: int) -> pd.DataFrame:
    """The function of one slab, all of one part: open bytes before it to open bytes and further batches after it."""
    upto = np.cumsum(sizes)
    before, n, total = upto - sizes, len(sizes), int(upto[-1])
    following = np.searchsorted(upto, before + limit, side="right")
    # A first row that is too large by itself (after rows without bytes) stays; the batch ends behind it.
    alone = (following < n) & (before[np.minimum(following, n - 1)] == before)
    following = following + alone
    own = np.arange(n)
    last, more = np.where(following < n, following, own), (following < n).astype(np.int64)
    while True:
        further = last[last]
        if (further == last).all():
            break
        last, more = further, more + more[last]
    held = total - before[last]
    at = np.flatnonzero((sizes > 0) & (before < limit))
    out = pd.DataFrame({"lo": np.maximum(limit - upto[at], 0), "hi": limit - before[at], "shift": False, "held": held[at], "more": more[at] + 1})
    # With more than the bound in the open batch the first row breaks, whatever its size.
    out = pd.concat([out, pd.DataFrame({"lo": [limit], "hi": [MOST], "shift": [False], "held": held[:1], "more": more[:1] + 1})])
    if total < limit:
        out = pd.concat([out, pd.DataFrame({"lo": [0], "hi": [limit - total], "shift": [True], "held": [total], "more": [0]})])
    # Nothing in the open batch: as if it began with this slab.
    out = pd.concat([out[out["hi"] > out["lo"]], pd.DataFrame({"lo": [-1], "hi": [0], "shift": [False], "held": held[:1], "more": more[:1]})])
    return _merged(out.astype(TYPES)).assign(final=False)[FIELDS]


def composed(first: pd.DataFrame, then: pd.DataFrame) -> pd.DataFrame:
    """``then`` after ``first``."""
    if then["final"].iloc[0]:
        return then
    then = then.sort_values("lo")
    fixed = first[~first["shift"]]
    at = np.searchsorted(then["hi"].to_numpy(), fixed["held"].to_numpy(), side="left")
    hit = then.iloc[at]
    out = [pd.DataFrame({"lo": fixed["lo"].to_numpy(), "hi": fixed["hi"].to_numpy(), "shift": False, "held": hit["held"].to_numpy() + np.where(hit["shift"], fixed["held"], 0), "more": fixed["more"].to_numpy() + hit["more"].to_numpy()})]
    for lo, hi, add, more in first.loc[first["shift"], ["lo", "hi", "held", "more"]].itertuples(index=False):
        cut = then[(then["hi"] > lo + add) & (then["lo"] < hi + add)]
        out.append(pd.DataFrame({"lo": np.maximum(cut["lo"] - add, lo), "hi": np.minimum(cut["hi"] - add, hi), "shift": cut["shift"], "held": cut["held"] + np.where(cut["shift"], add, 0), "more": cut["more"] + more}))
    return _merged(pd.concat(out).astype(TYPES)).assign(final=bool(first["final"].iloc[0]))[FIELDS]


def _numbered(sizes: list, fresh: list, limit: int, used: int, number: int) -> tuple[list, list]:
    """Bytes of the open batch and its number after each row; a new part starts where ``fresh`` says so."""
    useds, numbers = [], []
    for size, new in zip(sizes, fresh):
        if new:
            used, number = 0, 0
        elif used > 0 and used + size > limit:
            used, number = 0, number + 1
        used += size
        useds.append(used)
        numbers.append(number)
    return useds, numbers


def batch_numbers(rows: DataFrame, size: str, limit: int, key: str = "part", order: str = "seq", slabs: int | None = None) -> DataFrame:
    """``rows`` with ``batch_no``: within a part, in order, a new batch starts where the next row would pass ``limit`` bytes.

    The sum starts anew with each batch; ties of order go by size, then by a hash of the row. Every row stays, with a null key
    (one part), a null or negative size (no bytes) or equal rows; a column ``batch_no`` that is there already is replaced.
    Parts may be of any size: the rows are sorted into ``slabs`` ranges (by default as many as a shuffle has partitions),
    written once to the shared folder, and only slabs that begin inside a part are numbered a second time.
    """
    rows, limit = rows.drop("batch_no"), max(limit, 0)
    spark = rows.sparkSession
    tie, slab, pos, used, first, bytes_ = (spare(n, rows) for n in ("_tie", "_slab", "_pos", "_used", "_first", "_bytes"))
    hashed = [f.name for f in rows.schema.fields if not any(w in f.dataType.simpleString() for w in ("map<", "variant"))]
    by = [key, order, size, tie]
    marked = rows.withColumn(tie, F.xxhash64(*[rows[c] for c in hashed])).withColumn(bytes_, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))
    ordered = (marked.repartitionByRange(slabs, *by) if slabs else marked.repartitionByRange(*by)).sortWithinPartitions(*by).drop(tie)
    at_key, at_bytes, names = ordered.columns.index(key), ordered.columns.index(bytes_), ordered.columns
    extra = [("batch_no", T.IntegerType()), (slab, T.IntegerType()), (pos, T.LongType()), (used, T.LongType()), (first, T.BooleanType())]

    def begin(batches):
        number_of, part, begun, held, number, count, opening = TaskContext.get().partitionId(), None, False, 0, 0, 0, True
        for batch in batches:
            fresh = []
            firsts = []
            for own in batch.column(at_key).to_pylist():
                new = not begun or not _same(own, part)
                opening = opening and not (new and begun)
                begun, part = True, own
                fresh.append(new)
                firsts.append(opening)
            useds, numbers = _numbered(batch.column(at_bytes).to_pylist(), fresh, limit, held, number)
            n = len(fresh)
            if n:
                held, number = useds[-1], numbers[-1]
            columns = [pa.array(numbers, pa.int32()), pa.array([number_of] * n, pa.int32()), pa.array(range(count, count + n), pa.int64()), pa.array(useds, pa.int64()), pa.array(firsts, pa.bool_())]
            count += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, "batch_no", slab, pos, used, first])

    table = stored(ordered.mapInArrow(begin, T.StructType([*ordered.schema.fields, *[T.StructField(*e) for e in extra]])), "batches")
    carried = _carried(table, key, limit, slab, pos, used, first, bytes_)
    wanted = [*rows.columns, "batch_no"]
    if carried is None:
        return table.select(*wanted)
    held_, number_ = spare("_held", table), spare("_number", table)
    carries = spark.createDataFrame(carried, f"{slab} int, {held_} long, {number_} int")
    again = table.filter(first).join(F.broadcast(carries), slab).repartition(slab).sortWithinPartitions(slab, pos)
    place, own_columns = {c: k for k, c in enumerate(again.columns)}, rows.columns

    def go_on(batches):
        at, held, number = None, 0, 0
        for batch in batches:
            numbers = []
            for own, size_, h, k in zip(*(batch.column(place[c]).to_pylist() for c in (slab, bytes_, held_, number_))):
                if own != at:
                    at, held, number = own, h, k
                (held,), (number,) = _numbered([size_], [False], limit, held, number)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*(batch.column(place[c]) for c in own_columns), pa.array(numbers, pa.int32())], names=wanted)

    kept = table.join(F.broadcast(carries.select(slab).withColumn(first, F.lit(True))), [slab, first], "left_anti")
    return kept.select(*wanted).union(again.mapInArrow(go_on, T.StructType([*rows.schema.fields, T.StructField("batch_no", T.IntegerType())])))


def _carried(table: DataFrame, key: str, limit: int, slab: str, pos: str, used: str, first: str, bytes_: str) -> list[tuple[int, int, int]] | None:
    """(slab, open bytes, number of the open batch) at the start of slabs that begin inside a part; the driver sees a row for each slab."""
    spark = table.sparkSession
    ends = table.groupBy(F.col(slab).alias("slab")).agg(F.min_by(key, pos).alias("a"), F.max_by(key, pos).alias("b"), F.max_by(used, pos).alias("held"), F.max_by("batch_no", pos).alias("number"))
    ends = sorted(ends.collect(), key=lambda r: r.slab)
    goes_on = [k > 0 and _same(r.a, ends[k - 1].b) for k, r in enumerate(ends)]
    if not any(goes_on):
        return None
    through = [on and _same(r.a, r.b) for on, r in zip(goes_on, ends)]
    # A slab in which its last part begins has one outcome; a run of others is composed.
    state = {k: (r.held, r.number) for k, r in enumerate(ends) if not through[k]}
    longest = run = 0
    for on in through:
        run = run + 1 if on else 0
        longest = max(longest, run)
    if longest:
        ranks = spark.createDataFrame([(r.slab, k) for k, r in enumerate(ends) if through[k]], f"{slab} int, rank int")
        inside = table.join(F.broadcast(ranks), slab).select("rank", F.col(pos).alias("pos"), F.col(bytes_).alias("size"))

        def of_slab(group: pd.DataFrame) -> pd.DataFrame:
            out = slab_pieces(group.sort_values("pos")["size"].to_numpy(), limit)
            return out.assign(slab=np.int32(group["rank"].iloc[0]))[["slab", *FIELDS]]

        def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return left[["slab", *FIELDS]]
            return composed(right[FIELDS], left[FIELDS]).assign(slab=left["slab"].iloc[0])[["slab", *FIELDS]]

        known = spark.createDataFrame([(k, -1, MOST, False, int(h), int(n), True) for k, (h, n) in state.items()], PIECE)
        pieces, distance = stored(inside.groupBy("rank").applyInPandas(of_slab, PIECE).union(known), "pieces"), 1
        while distance <= longest:
            shifted = pieces.withColumn("slab", F.col("slab") + distance)
            fresh = stored(pieces.groupBy("slab").cogroup(shifted.groupBy("slab")).applyInPandas(step, PIECE), "pieces")
            dropped(pieces)
            pieces, distance = fresh, distance * 2
        # From the first slab of its part on every outcome is the only one left.
        state = {r.slab: (r.held, r.more) for r in pieces.filter(F.col("hi") == MOST).select("slab", "held", "more").collect()}
        dropped(pieces)
    return [(ends[k].slab, int(state[k - 1][0]), int(state[k - 1][1])) for k, on in enumerate(goes_on) if on]
