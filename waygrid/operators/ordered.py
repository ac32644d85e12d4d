"""Ordered work per key as segmented prefixes, so that one key may own most of the rows.

A plain ``partitionBy(device)`` window puts a whole device into one task. Here rows are dealt into range partitions by
key and order. Each partition reduces the rows of a key to one element (a sum, the last or first value), the elements of
a key are scanned, one row per partition it touches, and partitions add what they are carried. No group that meets in
one task is larger than a range partition, whatever the keys are, and the steps are the same at every size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written

PART = "_part"  # number of the range partition; ascends with key and order
PART_ROWS = 1_000_000  # rows of a range partition of ``fold_arrays``: what a task sorts
OUT_ROWS = 20_000


def placed(df: DataFrame, keys: Sequence[str], order: Sequence, parts: int | None = None) -> DataFrame:
    """``df`` in range partitions by key and order, written out, with the partition's number in ``PART``.

    Written, because the borders come from a sample: both readings of the rows must see the same ones. Rows that tie in
    ``order`` stay together. A frame that has been placed may go through several of the functions below with the same keys
    and order, also after rows were left out. ``parts`` is for tests; Spark sizes partitions by itself.
    """
    if PART in df.columns:
        return df
    by = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    ranged = (df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)) if by else df.coalesce(1)
    return written(ranged.withColumn(PART, F.spark_partition_id()), "placed")


def _with(rows: DataFrame, small: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Join a row per (key, partition) to the rows; null keys are keys like others."""
    renamed = small.select(*[F.col(k).alias(f"_on_{k}") for k in (*keys, PART)], *names)
    on = F.lit(True)
    for k in (*keys, PART):
        on = on & rows[k].eqNullSafe(renamed[f"_on_{k}"])
    return rows.join(renamed, on).drop(*[f"_on_{k}" for k in (*keys, PART)])


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None,
    lasts: dict[str, tuple[Column, Column]] | None = None, nexts: dict[str, tuple[Column, Column]] | None = None,
    prevs: Sequence[str] = (), parts: int | None = None,
) -> DataFrame:
    """Add columns per key in order.

    ``sums``: name -> number, running total with the current row. ``lasts``: name -> (value, condition), the value at the
    last row, current one included, where the condition holds. ``nexts``: the same, looking ahead. ``prevs``: columns c of
    the previous row, as ``prev_c``.
    """
    sums, lasts, nexts, given = sums or {}, dict(lasts or {}), nexts or {}, PART in df.columns
    if prevs:
        lasts["_prev"] = F.struct(*prevs), F.lit(True)
    src = placed(df, keys, order, parts)
    place = F.struct(*[F.col(c) for c in order])
    # wrapped, so that a null at a matching row is still the last value
    wrap = {n: F.when(cond, F.struct(v.alias("v"))) for n, (v, cond) in {**lasts, **nexts}.items()}
    src = src.withColumns({**{f"_in_{n}": e for n, e in sums.items()}, **{f"_in_{n}": e for n, e in wrap.items()}})
    w = Window.partitionBy(*keys, PART).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead is looking back in the opposite order: a frame that ends behind the last row is gone through again for every row
    onward = Window.partitionBy(*keys, PART).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    local = {n: F.coalesce(F.sum(f"_in_{n}").over(upto), F.lit(0)) for n in sums}
    local |= {n: F.last(f"_in_{n}", True).over(earlier if n == "_prev" else upto) for n in lasts}
    local |= {n: F.last(f"_in_{n}", True).over(onward) for n in nexts}
    held = lambda n, pick: pick(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), place)).alias(f"_t_{n}")
    totals = src.groupBy(*keys, PART).agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
                                          *[held(n, F.max_by) for n in lasts], *[held(n, F.min_by) for n in nexts])
    across = Window.partitionBy(*keys).orderBy(PART)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, PART, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", True).over(before).alias(f"_c_{n}") for n in lasts], *[F.last(f"_t_{n}", True).over(after).alias(f"_c_{n}") for n in nexts])
    names = [f"_c_{n}" for n in (*sums, *lasts, *nexts)]
    out = _with(src.withColumns({f"_l_{n}": e for n, e in local.items()}), carried, keys, names)
    out = out.withColumns({**{n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in sums},
                           **{n: F.coalesce(f"_l_{n}", f"_c_{n}")["v"] for n in (*lasts, *nexts)}})
    out = out.drop(*[f"_{x}_{n}" for n in (*sums, *lasts, *nexts) for x in ("in", "l", "c")])
    if prevs:
        out = out.withColumns({f"prev_{c}": F.col("_prev")[c] for c in prevs}).drop("_prev")
    return out if given else out.drop(PART)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, name: str, parts: int | None = None) -> DataFrame:
    """``row_number`` per key, or overall without keys: partitions number their rows behind those of earlier ones."""
    given = PART in df.columns
    src = placed(df, keys, order, parts)
    held = src.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inner = Window.partitionBy(*keys, PART).orderBy(*order)
    out = _with(src.withColumn(name, F.row_number().over(inner)), held, keys, ["_before"])
    out = out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before")
    return out if given else out.drop(PART)


def ewma(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], keep: float,
    start: dict[str, Column] | None = None, parts: int | None = None,
) -> DataFrame:
    """Exponential averages ``a = keep * a + (1 - keep) * value`` per key, in order, for every name -> value.

    Before the first row the average is ``start`` (a constant), or, without one, the first value. The step is an affine map,
    and maps compose: rows are dealt into blocks by their number, each block sums its values with falling weights, and what
    it is carried fades by ``keep`` to the power of its length. Blocks are as long as it takes that to fall below the last
    bit of a double, so the two blocks before decide, and no task holds more of a key than a block. Values must not be null.
    """
    length = 1
    while keep ** length > 2.0 ** -64:
        length += 1
    given = PART in df.columns
    out = numbered(placed(df, keys, order, parts), keys, order, "_no", parts)
    out = out.withColumns({"_block": F.floor((F.col("_no") - 1) / length), "_at": (F.col("_no") - 1) % length})
    inner = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rise = F.pow(F.lit(keep), -F.col("_at").cast("double"))
    first = F.when(F.col("_no") == 1, F.lit(1.0)).otherwise(F.lit(1.0 - keep))  # without a start the first value counts whole
    weigh = {n: v * (first if start is None else F.lit(1.0 - keep)) * rise for n, v in values.items()}
    out = out.withColumns({f"_v_{n}": e for n, e in weigh.items()})
    out = out.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inner) for n in values})
    end = F.pow(F.lit(keep), F.lit(length - 1.0))
    ends = out.groupBy(*keys, "_block").agg(*[(F.sum(f"_v_{n}") * end).alias(f"_e_{n}") for n in values])
    back = Window.partitionBy(*keys).orderBy("_block")
    fade = keep ** length
    from_start = lambda n: F.lit(0.0) if start is None else start[n]
    carry = lambda n: F.when(F.col("_block") == 0, from_start(n)).otherwise(F.lag(f"_e_{n}").over(back) + fade * F.coalesce(F.lag(f"_e_{n}", 2).over(back), from_start(n)))
    ends = ends.select(*keys, F.col("_block").alias("_b"), *[carry(n).alias(f"_c_{n}") for n in values])
    renamed = ends.select(*[F.col(k).alias(f"_on_{k}") for k in keys], "_b", *[f"_c_{n}" for n in values])
    on = F.col("_block") == F.col("_b")
    for k in keys:
        on = on & out[k].eqNullSafe(renamed[f"_on_{k}"])
    out = out.join(renamed, on)
    at = F.col("_at").cast("double")
    out = out.withColumns({n: F.pow(F.lit(keep), at) * (F.col(f"_s_{n}") + keep * F.col(f"_c_{n}")) for n in values})
    out = out.drop("_no", "_block", "_at", "_b", *[f"_on_{k}" for k in keys], *[f"_{x}_{n}" for n in values for x in ("v", "s", "c")])
    return out if given else out.drop(PART)


# ------------------------------------------------------------------ sequential folds
Step = Callable[[dict, dict], "dict | list[dict] | None"]


def _plain(v):
    """Arrow and numpy values as JSON-friendly Python ones, NaN as None."""
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
        return [_plain(e) for e in v]
    if isinstance(v, dict):
        return {k: _plain(e) for k, e in v.items()}
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v != v:
        return None
    return v


def fold_ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str,
    start: Callable[[], dict] = dict, parts: int | None = None,
) -> DataFrame:
    """Run a small state machine over the rows of each key, in order.

    ``step(state, row)`` changes ``state`` (JSON-friendly dict) and returns output rows. Rows stream through a task in Arrow
    batches: only the state of one key is held. All range partitions run at once, each key from the start state. Then the
    (key, partition) pairs that should have started from another state, because the key began in an earlier partition,
    run again from the state that partition ended in, until no state changes. A key inside one partition runs once; one
    over many partitions runs again where the machine has not forgotten its past, at worst one partition after another.
    """
    out_type = T._parse_datatype_string(schema)
    names, keys, order = [f.name for f in out_type.fields], list(keys), list(order)
    src = placed(df, keys, order, parts)
    at = T.StructType([T.StructField(f"_key_{k}", src.schema[k].dataType) for k in keys] + [
        T.StructField(PART, T.IntegerType()), T.StructField("_exit", T.StringType())])
    wide = T.StructType(at.fields + out_type.fields)
    columns = [f.name for f in wide.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, acc = None, None, []

        def close():
            if current is not None:
                acc.append({**dict(zip(columns, current)), "_exit": json.dumps(state)})

        for batch in batches:
            cols = list(batch.columns)
            for values in batch.itertuples(index=False, name=None):
                row = {c: _plain(v) for c, v in zip(cols, values)}
                here = (*[row[k] for k in keys], row.pop(PART))
                entry = row.pop("_entry")
                if here != current:
                    close()
                    current, state = here, start() if entry is None else json.loads(entry)
                got = step(state, row)
                for g in [got] if isinstance(got, dict) else got or ():
                    acc.append({**dict(zip(columns, current)), **g})
            if len(acc) >= 20_000:
                yield pd.DataFrame(acc, columns=columns, dtype=object)
                acc = []
        close()
        yield pd.DataFrame(acc, columns=columns, dtype=object)

    def fold(rows: DataFrame) -> DataFrame:
        return written(rows.repartition(*keys, PART).sortWithinPartitions(*keys, PART, *order).mapInPandas(run, wide), "folded")

    ends = lambda done, n: done.where("_exit IS NOT NULL").select(*[F.col(f"_key_{k}").alias(k) for k in keys], PART, "_exit", F.lit(n).alias("_round"))
    entry = F.lag("_exit").over(Window.partitionBy(*keys).orderBy(PART))
    rounds = [fold(src.withColumn("_entry", F.lit(None).cast("string")))]
    state = written(ends(rounds[0], 0).withColumn("_used", F.lit(None).cast("string")), "states")
    while True:
        due = state.withColumn("_entry", entry)
        todo = due.where(~F.col("_entry").eqNullSafe(F.col("_used")))
        if todo.isEmpty():
            break
        rounds.append(fold(_with(src, todo, keys, ["_entry"])))
        new = ends(rounds[-1], len(rounds) - 1).withColumnsRenamed({"_exit": "_exit2", "_round": "_round2"})
        renamed = new.select(*[F.col(k).alias(f"_on_{k}") for k in (*keys, PART)], "_exit2", "_round2")
        on = F.lit(True)
        for k in (*keys, PART):
            on = on & due[k].eqNullSafe(renamed[f"_on_{k}"])
        ran = F.col("_round2").isNotNull()
        state = written(due.join(renamed, on, "left").select(
            *keys, PART, F.when(ran, F.col("_exit2")).otherwise(F.col("_exit")).alias("_exit"), F.coalesce("_round2", "_round").alias("_round"),
            F.when(ran, F.col("_entry")).otherwise(F.col("_used")).alias("_used")), "states")
    if len(rounds) == 1:
        return rounds[0].where("_exit IS NULL").select(*names)
    out = None
    for n, done in enumerate(rounds):
        rows = done.where("_exit IS NULL").withColumnsRenamed({f"_key_{k}": f"_row_{k}" for k in keys})
        last = state.where(F.col("_round") == n).select(*[F.col(k).alias(f"_on_{k}") for k in keys], F.col(PART).alias("_on_part"))
        on = rows[PART] == last["_on_part"]
        for k in keys:
            on = on & rows[f"_row_{k}"].eqNullSafe(last[f"_on_{k}"])
        mine = rows.join(last, on, "left_semi").select(*names)
        out = mine if out is None else out.unionByName(mine)
    return out


ArrayStep = Callable[[dict, "dict[str, np.ndarray]"], "dict[str, np.ndarray] | None"]


def _agree(a: str, b: str, fades: Sequence[str]) -> bool:
    """Equal states; the numbers named in ``fades`` up to rounding."""
    if a == b:
        return True
    one, two = json.loads(a), json.loads(b)
    flat = lambda v: v if isinstance(v, list) else [v]
    near = lambda x, y: x == y or (x != x and y != y) or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12))
    return one.keys() == two.keys() and all(
        one[k] == two[k] if k not in fades else len(flat(one[k])) == len(flat(two[k])) and all(map(near, flat(one[k]), flat(two[k]))) for k in one)


def fold_arrays(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: ArrayStep, schema: str,
    start: Callable[[], dict] = dict, fades: Sequence[str] = (), parts: int | None = None,
) -> DataFrame:
    """Run a state machine over the rows of each key, in order, many rows at a time: the keys and the columns of ``schema``.

    ``step(state, columns)`` gets the next rows of one key as arrays, changes ``state`` (JSON-friendly dict) and returns
    output columns. Rows are sorted into range partitions once and stream through; only outputs are written. A partition can
    have begun in the middle of its first key alone. Where it has, these rows are run again from the state in which the key
    was left, until the states agree: once more where the machine forgets its past, at worst one partition after another.
    Numbers in ``fades``, such as averages, agree up to rounding.
    """
    keys, order, fades = list(keys), list(order), tuple(fades)
    n = parts
    if not n:
        rows = df.count()
        n = max(math.ceil(rows / PART_ROWS), df.sparkSession.sparkContext.defaultParallelism if rows > PART_ROWS // 20 else 1)
    out_type = T._parse_datatype_string(schema)
    ends = [T.StructField(f"_{e}_{c}", df.schema[c].dataType) for e in ("first", "last") for c in order]
    wide = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + out_type.fields + [
        T.StructField("_seg", T.LongType()), *ends, T.StructField("_exit", T.StringType())])
    arrow = to_arrow_schema(wide)
    blank = json.dumps(start())

    def run(batches: Iterator[pa.RecordBatch], marks: Sequence[str]) -> Iterator[pa.RecordBatch]:
        part, seen, here, acc, held = TaskContext.get().partitionId(), -1, None, [], 0
        state, seg, head, last = {}, None, None, None

        def rows(count: int, given: dict) -> pa.RecordBatch:
            given = {**dict(zip(keys, key)), "_seg": seg, **given}
            fill = lambda f: given[f.name] if isinstance(given.get(f.name), np.ndarray) else [given.get(f.name)] * count
            return pa.RecordBatch.from_arrays([pa.array(fill(f), f.type) for f in arrow], schema=arrow)

        def close() -> pa.RecordBatch:
            return rows(1, {**head, **{f"_last_{c}": v for c, v in last.items()}, "_exit": json.dumps(state)})

        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(m).dictionary_encode(null_encoding="encode").indices.to_numpy() for m in marks]
            edge = np.zeros(b.num_rows - 1, bool)
            for c in codes:
                edge |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                at = b.slice(lo, hi - lo)
                now = tuple(at.column(m)[0].as_py() for m in marks)
                if now != here or seen < 0:
                    # of the keys of a partition the first may have begun before, and the last may go on
                    if seen >= 0 and (seg is not None or "_seg" in marks):
                        acc.append(close())
                    seen, here, key = seen + 1, now, tuple(at.column(k)[0].as_py() for k in keys)
                    if "_seg" in marks:
                        seg, state = now[0], json.loads(at.column("_entry")[0].as_py())
                    else:
                        seg, state = (None if seen else 2 * part), json.loads(blank)
                    head = {f"_first_{c}": at.column(c)[0].as_py() for c in order}
                last = {c: at.column(c)[-1].as_py() for c in order}
                got = step(state, {c: at.column(c).to_numpy(zero_copy_only=False) for c in at.schema.names if c not in ("_seg", "_entry", *keys)})
                count = len(next(iter(got.values()))) if got else 0
                if count:
                    acc.append(rows(count, got))
                    held += count
                if held >= OUT_ROWS or len(acc) >= 2000:
                    yield from pa.Table.from_batches(acc).combine_chunks().to_batches()
                    acc, held = [], 0
        if seen >= 0:
            if seg is None:
                seg = 2 * part + 1
            acc.append(close())
        if acc:
            yield from pa.Table.from_batches(acc).combine_chunks().to_batches()

    by = [*keys, *order]
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    done = written(dealt.mapInArrow(lambda batches: run(batches, keys), wide), "folded")
    names = [*keys, *[f.name for f in out_type.fields]]
    bare = lambda d: d.where("_exit IS NULL").select(*names)
    # at most two rows a partition
    left = done.where("_exit IS NOT NULL")
    prev = F.lag("_seg").over(Window.partitionBy(*keys).orderBy("_seg"))
    links, exits = {}, {}
    for r in left.select("_seg", prev.alias("prev"), "_exit").collect():
        exits[r["_seg"]] = r["_exit"]
        if r["prev"] is not None:
            links[r["_seg"]] = r["prev"]
    used = dict.fromkeys(links, blank)
    due = lambda: {s: exits[p] for s, p in links.items() if not _agree(used[s], exits[p], fades)}
    todo, heads, final = due(), None, {}
    if not todo:
        return bare(done)
    span = left.where(F.col("_seg").isin(list(links))).select(
        *[F.col(k).alias(f"_on_{k}") for k in keys], "_seg", *[F.struct(*[F.col(f"_{e}_{c}").alias(c) for c in order]).alias(f"_{e}") for e in ("first", "last")])
    on, place = F.lit(True), F.struct(*order)
    for k in keys:
        on = on & df[k].eqNullSafe(span[f"_on_{k}"])
    heads = written(df.join(span, on & (place >= F.col("_first")) & (place <= F.col("_last"))).drop("_first", "_last", *[f"_on_{k}" for k in keys]), "heads")
    rounds = []
    while todo:
        entry = df.sparkSession.createDataFrame(list(todo.items()), "_seg long, _entry string")
        again = heads.join(entry, "_seg").repartition("_seg").sortWithinPartitions("_seg", *order)
        rounds.append(written(again.mapInArrow(lambda batches: run(batches, ["_seg"]), wide), "folded"))
        used.update(todo)
        final.update(dict.fromkeys(todo, len(rounds) - 1))
        exits.update({r["_seg"]: r["_exit"] for r in rounds[-1].where("_exit IS NOT NULL").select("_seg", "_exit").collect()})
        todo = due()
    kept = lambda d, i: d.where(F.col("_seg").isin([s for s, r in final.items() if r == i]))
    out = bare(done.where(F.col("_seg").isNull() | ~F.col("_seg").isin(list(final))))
    for i, d in enumerate(rounds):
        out = out.unionByName(bare(kept(d, i)))
    return out
