"""Hard negatives by a pivot table.

The score is the inner product q.x of integer vectors. With M the largest squared length, every row becomes x' = (x, sqrt(M - |x|^2)) and
every anchor q' = (q, 0), so |q' - x'|^2 = |q|^2 + M - 2 q.x: high scores are short distances. The table stores each row's distances to
``PIVOTS`` augmented rows. For an anchor the triangle inequality over the pivots brackets the distance, and thus the score, of each
row; rows whose bracket misses what is asked for are dropped, and the scores of the others are computed exactly.

Pivots are chosen far apart from a sample of ``SAMPLE`` rows (by a hash of the id; a documented bound that only affects speed). Rows are
sorted by label, nearest pivot and the distance to it, and packed into blocks of ``BLOCK`` rows with the range of their pivot distances,
so that a whole block is passed over where its bracket misses for every anchor.

Anchors go in slices of at most ``SLICE_BYTES`` by broadcast; a slice is one pass over the blocks. A task keeps the best rows so far for
each anchor, which narrows the brackets that still matter, and hands on only those. The first pass gives an anchor its positives (rows of
its label, starting from what the sample holds), the second one the negatives in the band of each positive.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part; nor do rows without an id, and
those of a squared length (scaled) of 2**62 or more, whose scores fit no long. Shorter vectors are padded with zeros. Labels are whole
numbers. Ids may repeat: each row is one, an anchor row each gives its own results, and rows of the anchor's id are never its positives. Ties go to the
smaller id. An anchor without another row of its label has no rows; an empty table gives none. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import staged
from .vectors import matrix, whole

SCALE = 256
MOST = 2.0**62
PIVOTS, SAMPLE = 16, 2048
BLOCK = 2048
#: Bytes of anchors' vectors in a slice, which is broadcast, and anchors that meet a block at once.
SLICE_BYTES, TOGETHER = 8 << 20, 256
#: Bytes of rows that one partition of the table holds.
PARTITION_BYTES = 16 << 20
_NONE = np.iinfo(np.int64).min


def _square(x: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows of an integer matrix; exact, as they are below MOST."""
    return np.einsum("ij,ij->i", x, x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exactly: as doubles while all partial sums are exact in them."""
    if len(a) and len(b) and float(_square(a).max()) * float(_square(b).max()) < 2.0**104:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class Space:
    """The augmented space: pivots and M."""

    def __init__(self, sample: np.ndarray, most: int, pivots: int = PIVOTS):
        self.most = float(most)
        self.pivots, self.rests = sample[:0], np.zeros(0)
        self.take(sample[:1])
        if len(sample):
            near = self.distances(sample)[:, 0]
            while len(self.pivots) < min(pivots, len(sample)) and near.max() > 0:
                self.take(sample[[int(near.argmax())]])
                near = np.minimum(near, self.distances(sample)[:, -1])

    def take(self, rows: np.ndarray) -> None:
        self.pivots, self.rests = np.concatenate([self.pivots, rows]), np.r_[self.rests, self.rest(rows)]

    def rest(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - _square(x).astype(float), 0))

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """(row, pivot), of augmented rows or anchors."""
        a, b = x.astype(float), self.pivots.astype(float)
        flat = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        rest = np.zeros(len(x)) if anchors else self.rest(x)
        return np.sqrt(np.maximum(flat + (rest[:, None] - self.rests[None]) ** 2, 0))

    def brackets(self, square: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score (anchor, row) that anchors of squared length ``square`` and pivot distances ``own`` can have
        with rows whose pivot distances lie from ``low`` to ``high``."""
        near, far = np.zeros((len(own), len(low))), np.full((len(own), len(low)), np.inf)
        for k in range(own.shape[1]):
            q = own[:, k][:, None]
            np.maximum(near, np.maximum(q - high[:, k], low[:, k] - q), out=near)
            np.minimum(far, q + high[:, k], out=far)
        both = square.astype(float)[:, None] + self.most
        slack = 1e-6 * (both + 1)  # far above the rounding of the distances
        return (both - far * far) / 2 - slack, (both - near * near) / 2 + slack


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_BLOCK = "row binary, vec_id binary, label binary, v binary, distances binary"


def pivot_table(rows: DataFrame, space: Space, width: int, rows_there: int) -> DataFrame:
    """Blocks of rows (row, vec_id, label, v, distances as packed arrays) in the order of label, nearest pivot and the distance to it."""
    held = rows.sparkSession.sparkContext.broadcast(space)

    def measure(batches):
        for batch in batches:
            x = matrix(batch.column(3), width)
            d = held.value.distances(x)
            cell = d.argmin(1)
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array([_bytes(r) for r in x], pa.binary()), pa.array([_bytes(r) for r in d], pa.binary()), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])]
            yield pa.RecordBatch.from_arrays(cols, ["row", "vec_id", "label", "v", "distances", "cell", "near"])

    def pack(batches):
        rest: list[pa.Table] = []

        def block(t):
            ints = [np.array(t.column(i).to_pylist(), "<i8").tobytes() for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (*ints, b"".join(t.column(3).to_pylist()), b"".join(t.column(4).to_pylist()))], ["row", "vec_id", "label", "v", "distances"])

        for batch in batches:
            rest.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in rest) >= BLOCK:
                t = pa.concat_tables(rest)
                yield block(t.slice(0, BLOCK))
                rest = [t.slice(BLOCK)]
        t = pa.concat_tables(rest) if rest else None
        if t is not None and t.num_rows:
            yield block(t)

    parts = -(-rows_there * 8 * (width + PIVOTS + 4) // PARTITION_BYTES) or 1
    wide = rows.mapInArrow(measure, "row long, vec_id long, label long, v binary, distances binary, cell int, near double")
    keys = ["label", "cell", "near", "row"]
    return wide.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("row", "vec_id", "label", "v", "distances").mapInArrow(pack, _BLOCK)


class Anchors:
    """A slice of anchors: row, vec_id, label, vectors, and for each what it asks for: bands of scores (low, high), highest first, with the
    positives (id) they belong to. ``same``: rows of the anchor's label are asked for, else rows of others."""

    def __init__(self, space: Space, row, vec_id, label, v, low, high, positive, same: bool, best: int):
        self.space, self.row, self.vec_id, self.label, self.v, self.same, self.best = space, row, vec_id, label, v, same, best
        self.low, self.high, self.positive = low, high, positive  # (anchor, band)
        self.square, self.own = _square(v), space.distances(v, anchors=True)

    def found(self):
        """No rows yet: scores (none: _NONE) and ids by (anchor, band, rank)."""
        shape = (*self.low.shape, self.best)
        return np.full(shape, _NONE), np.zeros(shape, np.int64)

    def look(self, block: tuple[np.ndarray, ...], scores: np.ndarray, ids: np.ndarray) -> int:
        """Improve the found rows by those of a block; how many exact scores that took."""
        order = np.argsort(block[1], kind="stable")  # by id, so that the first of equal scores is the smallest
        _, vec_id, label, v, d = (x[order] for x in block)
        kinds, exact = np.unique(label), 0
        ends = d.min(0)[None], d.max(0)[None]
        if self.same:
            turns = [np.flatnonzero(self.label == k) for k in kinds.tolist()]
        else:
            turns = [np.flatnonzero(self.label != kinds[0]) if len(kinds) == 1 else np.arange(len(self.label))]
        for every in turns:
            for at in range(0, len(every), TOGETHER):
                a = every[at : at + TOGETHER]
                least = np.maximum(self.low[a], scores[a, :, -1])  # what a row must reach, by band
                low, high = self.space.brackets(self.square[a], self.own[a], *ends)
                asked = ((high >= least) & (low <= self.high[a])).any(1)
                a, least = a[asked], least[asked]
                if not len(a):
                    continue
                low, high = self.space.brackets(self.square[a], self.own[a], d, d)
                fit = (self.label[a][:, None] == label) == self.same
                if self.same:
                    fit &= self.vec_id[a][:, None] != vec_id
                wanted = np.zeros_like(fit)
                for b in range(self.low.shape[1]):
                    wanted |= fit & (high >= least[:, b][:, None]) & (low <= self.high[a, b][:, None])
                columns = np.flatnonzero(wanted.any(0))
                if not len(columns):
                    continue
                some = wanted.any(1)
                a, wanted = a[some], wanted[some][:, columns]
                exact += wanted.size
                score = products(self.v[a], v[columns])
                for b in range(self.low.shape[1]):
                    inside = np.where(wanted & (score >= self.low[a, b][:, None]) & (score <= self.high[a, b][:, None]), score, _NONE)
                    self.merge(a, b, inside, vec_id[columns], scores, ids)
        return exact

    def merge(self, a, b, inside, vec_id, scores, ids) -> None:
        new_scores, new_ids = np.full((len(a), self.best), _NONE), np.zeros((len(a), self.best), np.int64)
        each = np.arange(len(a))
        for r in range(self.best):
            first = inside.argmax(1)
            top = inside[each, first]
            if (top == _NONE).all():
                break
            new_scores[:, r], new_ids[:, r] = top, vec_id[first]
            inside[each, first] = _NONE
        both, of = np.concatenate([scores[a, b], new_scores], 1), np.concatenate([ids[a, b], new_ids], 1)
        order = np.lexsort((of, -np.maximum(both, _NONE + 1)), axis=1)[:, : self.best]
        scores[a, b], ids[a, b] = np.take_along_axis(both, order, 1), np.take_along_axis(of, order, 1)


def _blocks(batches, width: int, pivots: int):
    for batch in batches:
        for i in range(batch.num_rows):
            row, vec_id, label = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in range(3))
            yield row, vec_id, label, np.frombuffer(batch.column(3)[i].as_py(), "<i8").reshape(-1, width), np.frombuffer(batch.column(4)[i].as_py(), "<f8").reshape(-1, pivots)


_FOUND = "row long, anchor_id long, band int, positive_id long, id long, score long"


def searched(table: DataFrame, slice_: Anchors, width: int) -> DataFrame:
    """The best rows that each task found (_FOUND), for each anchor of a slice and each band."""
    held, pivots = table.sparkSession.sparkContext.broadcast(slice_), len(slice_.space.pivots)

    def run(batches):
        a = held.value
        scores, ids = a.found()
        for block in _blocks(batches, width, pivots):
            a.look(block, scores, ids)
        i, b, r = np.nonzero(scores != _NONE)
        cols = [a.row[i], a.vec_id[i], b.astype(np.int32), a.positive[i, b], ids[i, b, r], scores[i, b, r]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [f.split()[0] for f in _FOUND.split(", ")])

    return table.mapInArrow(run, _FOUND)


def _best(found: DataFrame, best: int) -> DataFrame:
    """The first rows of each anchor and band of all tasks, ranked."""
    rank = F.row_number().over(W.partitionBy("row", "band").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= best)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.array(table.column(n).to_pylist(), np.int64) for n in names]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hard_negatives(vectors: DataFrame, is_anchor: Column, vector: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a condition on vec_id) and each of its
    first ``positives`` rows of its label the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = vectors.sparkSession
    kept = whole(vectors, SCALE, MOST, vector, label).where("vec_id is not null and label is not null")
    rows = staged(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), "v"), "negative-rows")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    there, width, most, asked = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square), F.count(F.when(is_anchor, 1))).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not there or not asked:
        return empty
    width = width or 1
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit("sample")), "vec_id", "label", "v").limit(SAMPLE).select("row", "vec_id", "label", "v").toArrow()
    space = Space(matrix(sample.column("v"), width), most)
    probe = (*_columns(sample, "row", "vec_id", "label"), matrix(sample.column("v"), width))
    probe = (*probe, space.distances(probe[3]))
    table = staged(pivot_table(rows, space, width, there), "pivot-table")
    slices = -(-asked * 8 * (width + PIVOTS) // SLICE_BYTES)
    anchors = staged(rows.where(is_anchor).withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")), "anchors")

    found = []
    for s in range(slices):
        mine = anchors.where(F.col("slice") == s).toArrow()
        row, vec_id, of = _columns(mine, "row", "vec_id", "label")
        shape = (len(row), 1)
        a = Anchors(space, row, vec_id, of, matrix(mine.column("v"), width), np.full(shape, _NONE + 1), np.full(shape, np.iinfo(np.int64).max), np.zeros(shape, np.int64), True, positives)
        scores, ids = a.found()
        a.look(probe, scores, ids)  # a bound on what can still be among the first
        a.low[:, 0] = np.maximum(a.low[:, 0], scores[:, 0, -1])
        found.append(staged(searched(table, a, width), "positives"))
    best = _best(_union(found), positives)
    best = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))  # of at most ``positives`` rows
    pairs = staged(anchors.join(best, "row"), "anchors-with-positives")

    found = []
    for s in range(slices):
        mine = pairs.where(F.col("slice") == s).toArrow()
        row, vec_id, of = _columns(mine, "row", "vec_id", "label")
        bands = np.full((3, len(row), positives), 0, np.int64)
        bands[0], bands[1] = np.iinfo(np.int64).max, _NONE + 1  # no band
        for i, each in enumerate(mine.column("best").to_pylist()):
            for b, p in enumerate(each):
                # the whole numbers n with low * p <= 100 * n <= high * p
                bands[:, i, b] = -(-low * p["score"] // 100), high * p["score"] // 100, p["id"]
        a = Anchors(space, row, vec_id, of, matrix(mine.column("v"), width), *bands, False, negatives)
        found.append(staged(searched(table, a, width), "negatives"))
    best = _best(_union(found), negatives)
    positive = pairs.select("row", F.posexplode("best").alias("band", "p")).select("row", "band", F.col("p.score").alias("p_score"))
    return best.join(positive, ["row", "band"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))
