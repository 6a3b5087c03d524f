"""Vector codes by product quantisation, the nearest entry found by annular norm pruning.

Vectors of integers are cut into ``PARTS`` parts; each part position has a codebook of ``ENTRIES`` entries that starts as that part of
the rows of the smallest ids and is refined by ``ROUNDS`` rounds of assignment and means (rounded down). Entries are sorted by norm. A
part's first guess is the entry of the nearest norm; as |e - x| >= ||e| - |x||, an entry can only be as near as the best so far
if its norm lies within that distance of the part's, an interval that binary search finds. Entries of the interval, its ends
included, are evaluated exactly, from the nearest norm outwards, and each improvement narrows it.

A round is one pass over the staged rows: a task adds up its own parts by (part, entry), and PARTS * ENTRIES rows of sums leave each task,
so what is shuffled follows the tasks and the driver sees the codebooks only.

Defined results: a vector that is null or holds null or non-finite components takes no part; nor does one of a squared length (scaled)
of 2**60 or more, as its errors fit no long. Shorter vectors are padded with zeros to the longest, and that to a multiple of ``PARTS``;
empty vectors are zeros. Ids may repeat: each row is coded, and rows of one id come by their vector where seeds are chosen; null
ids come last. Under ``ENTRIES`` rows the codebooks are as short. Errors of equal labels are added up, nulls together; a sum that fits
no long is null. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged
from .vectors import matrix, whole

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
MOST = 2.0**60
#: Bytes of label sums that are broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the index of the nearest row of ``entries`` (ties to the lower) and the squared distance, and how many distances
    were computed. Norms are compared as doubles with a margin above their rounding; distances are whole numbers."""
    square = np.einsum("ij,ij->i", entries, entries)
    order = np.argsort(square, kind="stable")
    ranked, norms = entries[order], np.sqrt(square[order].astype(float))
    n, own = len(norms), np.sqrt(np.einsum("ij,ij->i", x, x).astype(float))
    margin = 1e-6 * (1 + own + norms[-1])
    above = np.searchsorted(norms, own)
    below = above - 1
    start = np.where((above < n) & ((below < 0) | (norms[np.minimum(above, n - 1)] - own < own - norms[below])), above, below)
    delta = x - ranked[start]
    best, code = np.einsum("ij,ij->i", delta, delta), order[start]
    low, high, done = start - 1, start + 1, len(x)

    def interval():
        reach = np.sqrt(best.astype(float)) + margin
        return np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right") - 1

    first, last = interval()
    while True:
        moved = False
        for side in (low, high):
            live = np.flatnonzero((side >= first) & (side <= last))
            if len(live):
                moved, done = True, done + len(live)
                at = side[live]
                delta = x[live] - ranked[at]
                d, c = np.einsum("ij,ij->i", delta, delta), order[at]
                better = (d < best[live]) | ((d == best[live]) & (c < code[live]))
                best[live[better]], code[live[better]] = d[better], c[better]
        if not moved:
            return code, best, done
        low, high = low - 1, high + 1
        first, last = interval()


def _cut(column, width: int) -> np.ndarray:
    """(row, part, component)"""
    return matrix(column, PARTS * width).reshape(-1, PARTS, width)


def seeds(rows: DataFrame, width: int) -> list[np.ndarray]:
    """The first codebook of each part: of the rows of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow()
    cut = _cut(first.column(0), width)
    return [cut[:, p].copy() for p in range(PARTS)]


def refined(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums, many = np.zeros((PARTS, ENTRIES, width), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            cut = _cut(batch.column(0), width)
            for p, book in enumerate(held.value):
                x = cut[:, p]
                code, _, _ = nearest(x, book)
                order = np.argsort(code, kind="stable")
                found, first = np.unique(code[order], return_index=True)
                if len(found):
                    sums[p, found] += np.add.reduceat(x[order], first)
                    many[p] += np.bincount(code, minlength=ENTRIES)
        part, entry = np.nonzero(many)
        if len(part):
            each = np.repeat(np.arange(len(part)), width + 1)
            at = np.tile(np.arange(-1, width), len(part))  # -1: how many
            values = np.concatenate([many[part, entry][:, None], sums[part, entry]], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in ((part[each], np.int32), (entry[each], np.int32), (at, np.int32), (values, np.int64))], ["part", "entry", "at", "value"])

    added = rows.select("v").mapInArrow(run, "part int, entry int, at int, value long").groupBy("part", "entry", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total = {(p, e, i): int(x) for p, e, i, x in added.collect()}  # PARTS * ENTRIES * (width + 1) at most
    out = [b.copy() for b in books]
    for p, e, i in total:
        if i < 0:
            out[p][e] = [total[p, e, j] // total[p, e, -1] for j in range(width)]
    held.unpersist()
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of ``vectors`` (vec_id, label, a vector) that takes part."""
    rows = staged(whole(vectors, SCALE, MOST, vector), "code-rows")
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS) or 1
    books = seeds(rows, width)
    if len(books[0]):
        for _ in range(ROUNDS):
            books = refined(rows, books, width)
    held, name = rows.sparkSession.sparkContext.broadcast(books), digest(books)

    def run(batches):
        for batch in batches:
            cut = _cut(batch.column(2), width)
            found = [nearest(cut[:, p], book)[:2] for p, book in enumerate(held.value)]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    codes = staged(rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long"), "codes")
    sums = staged(codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    if sums.count() * 24 <= BROADCAST_BYTES:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
