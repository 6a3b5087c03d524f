"""Greedy packing of ordered rows at any size of a group.

Where a pack ends depends on where it began, so packing one group is a chain of next-start pointers from its first row. The chain is
followed without a task that holds a group: rows get positions by ranges, positions are cut into blocks of ``BLOCK`` rows, and

1. a block (with the first rows of the next one) finds for each of its rows where a pack that starts there ends, by range search in prefix sums;
2. for each row that a pointer from an earlier block leads to, a block finds where the chain leaves it again;
3. these shortcuts are doubled by joins until it is known which rows the chain enters blocks by: a table of a few rows a block;
4. a block marks the starts from its entry, and packs are numbered by the starts of the blocks before.

Groups within one block skip 2 and 3.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..staging import drop_staged, staged

BLOCK = 1 << 16


def placed(rows: DataFrame, group: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows``, written, with ``pos``: 0, 1, ... within each group (null is one, too) in the given order, which must be unique there.

    Rows are cut into ranges of (group, order), so a large group lies in many; a range counts its own, and only the group that goes on from the range
    before needs what lies there."""
    cut = rows.repartitionByRange(*([parts] if parts else []), group, *order).sortWithinPartitions(group, *order)

    def count(batches):
        part, now, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            keys, local = batch.column(batch.schema.get_field_index(group)).to_pylist(), []
            for k in keys:
                if k != now:
                    now, at = k, 0
                local.append(at)
                at += 1
            cols = [*batch.columns, pa.array([part] * len(keys), pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "part_", "local_"])

    held = staged(cut.mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part_ int, local_ long"), "placed")
    # the counts of groups that several ranges share: at most two rows a range
    ends = held.groupBy(F.col(group).alias("g_"), F.col("part_").alias("p_")).agg((F.max("local_") + 1).alias("n_"))
    ends = ends.withColumn("kinds_", F.count("*").over(W.partitionBy("g_"))).where("kinds_ > 1")
    before = F.coalesce(F.sum("n_").over(W.partitionBy("g_").orderBy("p_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = staged(ends.select("g_", "p_", before.alias("before_")).where("before_ > 0"), "range-offsets")
    out = held.join(F.broadcast(ends), F.col(group).eqNullSafe(F.col("g_")) & (F.col("part_") == F.col("p_")), "left")
    return out.select(*rows.columns, (F.col("local_") + F.coalesce("before_", F.lit(0))).alias("pos"))


def _runs(batches, least: int):
    """Tables of whole (group, block) runs, of about ``least`` rows or one run; the first two columns are the group and the block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        new = _changes(t)
        if len(new):
            yield t.slice(0, int(new[-1]))
            held = t.slice(int(new[-1])).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(t: pa.Table) -> np.ndarray:
    """Where a run begins, but for the first row."""
    codes = []
    for c in (0, 1):
        column = t.column(c).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        codes.append(column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False))
    return np.flatnonzero((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])) + 1


def _bounds(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each row the run's begin and end."""
    cuts = np.r_[0, _changes(t), t.num_rows]
    n = np.diff(cuts)
    return np.repeat(cuts[:-1], n), np.repeat(cuts[1:], n)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _dealt(rows: DataFrame, group: str, *more: str) -> DataFrame:
    return rows.repartition(group, "block").sortWithinPartitions(group, "block", "pos").select(group, "block", "pos", *more)


def _inside(t: pa.Table, block: int) -> np.ndarray:
    """Row numbers that next-start pointers lead to within their runs; a row's own where the chain leaves or ends."""
    pos, nxt, here = _numbers(t, "pos"), _numbers(t, "nxt"), np.arange(t.num_rows)
    stays = (nxt >= 0) & (nxt // block == pos // block) & (here + nxt - pos < _bounds(t)[1])
    return np.where(stays, here + nxt - pos, here)


def pointers(rows: DataFrame, group: str, size: str, most_items: int, most_chars: int, block: int) -> DataFrame:
    """(group, block, pos, nxt) of placed rows: where the pack that starts at a row ends, -1 if with the group."""
    own = rows.select(group, F.floor(F.col("pos") / block).alias("block"), "pos", F.col(size).cast("long").alias("size"), F.lit(True).alias("own"))
    halo = own.where((F.col("block") > 0) & (F.col("pos") % block < most_items)).withColumn("block", F.col("block") - 1).withColumn("own", F.lit(False))
    kind = rows.schema[group].dataType.simpleString()

    def run(batches):
        for t in _runs(batches, block):
            size, own = _numbers(t, "size"), _numbers(t, "own").astype(bool)
            _, end = _bounds(t)
            total = np.cumsum(size)
            here = np.arange(len(size))
            breach = np.searchsorted(total, total - size + most_chars, "right")
            nxt = np.minimum(np.maximum(here + 1, np.minimum(breach, here + most_items)), end)
            pos = _numbers(t, "pos")
            found = np.where(nxt < end, pos + (nxt - here), -1)
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(own)) for c in (0, 1)] + [pa.array(pos[own]), pa.array(found[own])], [group, "block", "pos", "nxt"])

    return _dealt(own.unionByName(halo), group, "size", "own").mapInArrow(run, f"`{group}` {kind}, block long, pos long, nxt long")


def _exits(rows: DataFrame, group: str, block: int) -> DataFrame:
    """(group, pos, nxt) of entry rows: where the chain from there leaves the block; without those where it ends."""
    kind = rows.schema[group].dataType.simpleString()

    def run(batches):
        for t in _runs(batches, block):
            jump = _inside(t, block)
            while not np.array_equal(new := jump[jump], jump):
                jump = new
            out = _numbers(t, "nxt")[jump]
            keep = _numbers(t, "entry").astype(bool) & (out >= 0)
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().filter(pa.array(keep)), pa.array(_numbers(t, "pos")[keep]), pa.array(out[keep])], [group, "pos", "nxt"])

    return _dealt(rows, group, "nxt", "entry").mapInArrow(run, f"`{group}` {kind}, pos long, nxt long")


def entered(rows: DataFrame, group: str, block: int) -> DataFrame:
    """(group, pos): by which rows, besides its first, a group's chain enters blocks."""
    into = staged(rows.where(F.col("nxt") >= (F.col("block") + 1) * block).select(F.col(group).alias("g_"), F.col("nxt").alias("pos")).distinct(), "entries")
    if not into.limit(1).count():
        return into
    large = staged(into.select("g_").distinct(), "large-groups")
    same = lambda a: F.col(a).eqNullSafe(F.col("g_"))
    mine = rows.join(large, same(group), "left_semi")
    marks = into.select("g_", F.col("pos").alias("p_"), F.lit(True).alias("entry_"))
    mine = mine.join(marks, same(group) & (F.col("pos") == F.col("p_")), "left").withColumn("entry", F.coalesce("entry_", F.col("pos") == 0)).drop("g_", "p_", "entry_")
    edges = staged(_exits(mine, group, block).select(F.col(group).alias("g_"), "pos", "nxt"), "shortcuts")
    reached = staged(large.withColumn("pos", F.lit(0).cast("long")), "reached")
    step = lambda a, b, left, right, out: a.alias("a").join(b.alias("b"), F.col("a.g_").eqNullSafe(F.col("b.g_")) & (F.col(f"a.{left}") == F.col(f"b.{right}"))).select("a.g_", *out)
    while True:
        new = staged(reached.union(step(reached, edges, "pos", "pos", [F.col("b.nxt").alias("pos")])).distinct(), "reached")
        if new.count() == reached.count():
            break
        longer = staged(step(edges, edges, "nxt", "pos", [F.col("a.pos"), F.col("b.nxt")]), "shortcuts")
        drop_staged(reached, edges)
        reached, edges = new, longer
    return new.where("pos > 0")


def gaps(rows: DataFrame, group: str, at: str, gap: int, block: int) -> DataFrame:
    """(group, block, pos, nxt) of placed rows: the first row ``gap`` or more after each by the numbers in ``at``, by which they are ordered; where there is
    none, it lies behind the group. Rows of a stretch of ``gap`` are looked at together with those of the next one."""
    own = rows.select(group, F.floor(F.col(at) / gap).alias("stretch"), "pos", F.col(at).alias("at"), F.lit(True).alias("own"))
    halo = own.withColumn("stretch", F.col("stretch") - 1).withColumn("own", F.lit(False))
    kind = rows.schema[group].dataType.simpleString()

    def run(batches):
        for t in _runs(batches, block):
            own = _numbers(t, "own").astype(bool)
            begin, end = _bounds(t)
            at, here = _numbers(t, "at"), np.arange(t.num_rows)
            # times of a run lie within two stretches, so runs can be searched together
            turn = np.searchsorted(np.unique(begin), begin) * (4 * gap) + (at - at[begin])
            nxt = np.minimum(np.searchsorted(turn, turn + gap, "left"), end)
            pos = _numbers(t, "pos")
            found = (pos + nxt - here)[own]
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().filter(pa.array(own)), pa.array(pos[own] // block), pa.array(pos[own]), pa.array(found)], [group, "block", "pos", "nxt"])

    both = own.unionByName(halo).repartition(group, "stretch").sortWithinPartitions(group, "stretch", "pos").select(group, "stretch", "pos", "at", "own")
    return both.mapInArrow(run, f"`{group}` {kind}, block long, pos long, nxt long")


def _on_chain(chain: DataFrame, group: str, block: int) -> DataFrame:
    """(group, block, pos, number, on) of pointers: whether the chain from the group's first row meets a row, and how many it met in the block so far."""
    into = entered(chain, group, block)
    marks = into.select("g_", F.col("pos").alias("p_"), F.lit(True).alias("entry_"))
    starts = chain.join(marks, F.col(group).eqNullSafe(F.col("g_")) & (F.col("pos") == F.col("p_")), "left").withColumn("entry", F.coalesce("entry_", F.col("pos") == 0))
    kind = chain.schema[group].dataType.simpleString()

    def run(batches):
        for t in _runs(batches, block):
            jump, on = _inside(t, block), _numbers(t, "entry").astype(bool)
            on = on.copy()
            while True:
                on[jump[on]] = True
                new = jump[jump]
                if (new == jump).all():
                    break
                jump = new
            begin, _ = _bounds(t)
            number = np.cumsum(on)
            number = number - (number - on)[begin]  # starts in the run so far
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in range(3)), pa.array(number), pa.array(on)], [group, "block", "pos", "number", "on"])

    return _dealt(starts, group, "nxt", "entry").mapInArrow(run, f"`{group}` {kind}, block long, pos long, number long, on boolean")


def spaced(rows: DataFrame, group: str, at: str, ties: list[str], gap: int, block: int | None = None) -> DataFrame:
    """Of each group the first row by ``at`` (whole numbers; nulls fall out) and ``ties``, then always the first that comes ``gap`` or more after the row kept last."""
    block = BLOCK if block is None else block
    slim = staged(placed(rows.where(F.col(at).isNotNull()), group, [at, *ties]), "positions")
    chain = staged(gaps(slim, group, at, gap, block), "pointers")
    kept = _on_chain(chain, group, block).where("on").select(F.col(group).alias("g_"), F.col("pos").alias("p_")).hint("merge")
    return slim.join(kept, F.col(group).eqNullSafe(F.col("g_")) & (F.col("pos") == F.col("p_")), "left_semi").select(*rows.columns)


def packed(rows: DataFrame, group: str, order: list[str], size: str, most_items: int, most_chars: int, block: int | None = None) -> DataFrame:
    """``rows`` with ``pack``, the number of each row's pack within its group (null groups are one): packs are filled in order and end before an
    item that would make them more than ``most_items`` or their sizes (0 or more; null counts as 0) more than ``most_chars``; a larger item is alone."""
    block = BLOCK if block is None else block
    if not 0 < most_items <= block:
        raise ValueError(f"most_items must be from 1 to {block}")
    slim = placed(rows.withColumn("size_", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))), group, order)
    slim = staged(slim, "positions")
    chain = staged(pointers(slim, group, "size_", most_items, most_chars, block), "pointers")
    numbered = staged(_on_chain(chain, group, block), "numbered")
    many = numbered.groupBy(F.col(group).alias("g_"), F.col("block").alias("b_")).agg(F.max("number").alias("many")).withColumn("last_", F.max("b_").over(W.partitionBy("g_"))).where("last_ > 0")
    before = F.coalesce(F.sum("many").over(W.partitionBy("g_").orderBy("b_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(many.select("g_", "b_", before.alias("before_")), "block-offsets")
    out = numbered.join(offsets, F.col(group).eqNullSafe(F.col("g_")) & (F.col("block") == F.col("b_")), "left")
    out = out.select(F.col(group).alias("g_"), F.col("pos").alias("p_"), (F.col("number") + F.coalesce("before_", F.lit(0)) - 1).alias("pack"))
    # both have a row for each row of the table; their files are small for what they hold, so neither is to be broadcast for its size on disk
    return slim.join(out.hint("merge"), F.col(group).eqNullSafe(F.col("g_")) & (F.col("pos") == F.col("p_"))).select(*rows.columns, "pack")
