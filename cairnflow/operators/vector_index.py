"""Vector search and similarity joins below all pairs: lists of rows around centroids, searched in part, or joined with a bound.

Rows (id: long, embedding) are unit vectors here, so nearness by cosine is nearness in space. Centroids are fitted by k-means on a sample of
at most ``SAMPLE`` rows (by a hash of the id; a documented bound that affects speed and recall, not what is indexed). Every row is in the list
of its nearest centroid. A list is cut into blocks of ``BLOCK`` rows, so one that holds a third of all rows is a third of the blocks, in
as many tasks. Rows without an id, without components or with null ones are not indexed; a zero vector has cosine 0 with all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vector import cosine
from ..staging import staged

SAMPLE, ROUNDS, MOST_LISTS = 1 << 16, 8, 4096
BLOCK, QUERY_BLOCK = 4096, 512
#: Rows that a task deals to lists at once.
DEALT = 1 << 14
#: How far a product of matrices may be off before cosines summed in the order of ``cosine`` decide.
MARGIN = 1e-5


def _unit(column, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors (zeros stay)."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    n = np.sqrt((x * x).sum(1))
    return x / np.where(n > 0, n, 1)[:, None]


def usable(rows: DataFrame, width: int | None = None) -> DataFrame:
    """(id, embedding) of the rows that can be compared; of ``width`` components where that is given."""
    kept = rows.where("id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x))").select(F.col("id").cast("long").alias("id"), "embedding")
    return kept if width is None else kept.where(F.size("embedding") == width)


def centroids(rows: DataFrame, lists: int, width: int) -> np.ndarray:
    """Unit centroids, by k-means over the sample; as many as ``lists`` where the sample has so many distinct rows."""
    held = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    x = np.unique(_unit(held, width), axis=0)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.sqrt((sums * sums).sum(1))
        c = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1)[:, None], c)
    return c


@dataclass
class Index:
    """Centroids (broadcast; at most MOST_LISTS rows) and blocks: list, part, ids, vectors (unit, packed), staged; parts by list."""

    centroids: object
    width: int
    blocks: DataFrame
    parts: DataFrame
    rows: DataFrame


def _blocks(dealt: DataFrame, most: int, names: tuple[str, str] = ("ids", "vectors")) -> DataFrame:
    """Packed blocks (list, part, ids, vectors) of (list, id, v), v being packed: parts of about ``most`` rows, by a hash of the id."""
    dealt = staged(dealt, "dealt-vectors")
    parts = dealt.groupBy("list").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts"))  # at most MOST_LISTS rows

    def pack(batches):
        now, ids, vectors = None, [], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())], ["list", "part", *names])

        for batch in batches:
            for at, part, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (at, part) != now and ids:
                    yield row()
                    ids, vectors = [], []
                now = at, part
                ids.append(i)
                vectors.append(v)
        if ids:
            yield row()

    cut = dealt.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v")
    return staged(cut.repartition("list", "part").sortWithinPartitions("list", "part", "id").mapInArrow(pack, f"list int, part int, {names[0]} binary, {names[1]} binary"), "vector-blocks")


def _dealt(rows: DataFrame, centres, width: int, lists: int) -> DataFrame:
    """(list, id, v) of rows in the ``lists`` lists of the nearest centroids."""

    def run(batches):
        for batch in batches:
            step = max(1, DEALT // min(lists, len(centres.value)))  # a row goes to many lists, and a batch may have many rows
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _unit(part.column(1), width)
                score = x @ centres.value.T
                many = min(lists, score.shape[1])
                near = np.argpartition(-score, many - 1, axis=1)[:, :many].ravel()
                of = np.repeat(np.arange(len(x)), many)
                packed = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), part.column(0).take(pa.array(of)), pa.array([packed[i] for i in of.tolist()], pa.binary())], ["list", "id", "v"])

    return rows.select("id", "embedding").mapInArrow(run, "list int, id long, v binary")


def build(rows: DataFrame, lists: int | None = None) -> Index:
    """The index of (id, embedding) with about as many lists as the root of the rows; rows of the most frequent width."""
    sized = usable(rows).groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if sized is None:
        raise ValueError("no vectors to index")
    width = sized["width"]
    rows = usable(rows, width)
    found = centroids(rows, lists or int(np.clip(sized["count"] ** 0.5, 1, MOST_LISTS)), width)
    centres = rows.sparkSession.sparkContext.broadcast(found)
    blocks = _blocks(_dealt(rows, centres, width, 1), BLOCK)
    return Index(centres, width, blocks, staged(blocks.groupBy("list").agg(F.max("part").alias("last")), "list-parts"), rows)


def _scanned(pairs: DataFrame, width: int, k: int) -> DataFrame:
    """(qid, id, score): the best k rows of each pair of a query block and a block."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qids, ids = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in (0, 2))
                q, v = (np.frombuffer(batch.column(c)[i].as_py(), "<f8").reshape(-1, width) for c in (1, 3))
                score = q @ v.T
                many = min(k, len(ids))
                # rows that tie with the k-th go along, so that the smaller id can win
                least = -np.partition(-score, many - 1, axis=1)[:, many - 1]
                a, b = np.nonzero(score >= (least - 1e-9)[:, None])
                if len(a) > 4 * many * len(qids):  # many equal rows: of those the smallest ids
                    order = np.lexsort((ids[b], -np.round(score[a, b], 9), a))
                    a, b = a[order], b[order]
                    rank = np.arange(len(a)) - np.searchsorted(a, a)
                    a, b = a[rank < many], b[rank < many]
                yield pa.RecordBatch.from_arrays([pa.array(qids[a]), pa.array(ids[b]), pa.array(score[a, b])], ["qid", "id", "score"])

    return pairs.select("qids", "q", "ids", "vectors").mapInArrow(run, "qid long, id long, score double")


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Qid, id, cosine, rank of about the k nearest rows for each of ``queries`` (qid, q_embedding): those of the ``probes`` nearest lists, scored
    exactly. With as many probes as lists it is the exact search."""
    from .retrieval import top

    asked = queries.select(F.col("qid").cast("long").alias("id"), F.col("q_embedding").alias("embedding"))
    asked = staged(usable(asked, index.width), "asked")
    q = _blocks(_dealt(asked, index.centroids, index.width, probes), QUERY_BLOCK, ("qids", "q")).withColumnRenamed("part", "q_part")
    pairs = q.join(F.broadcast(index.parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), "last")))
    near = _scanned(pairs.join(index.blocks, ["list", "part"]), index.width, 2 * k)
    near = top(near.dropDuplicates(["qid", "id"]), ["qid"], [F.desc("score"), F.asc("id")], 2 * k).select("qid", "id")
    exact = near.join(index.rows, "id").join(asked.select(F.col("id").alias("qid"), F.col("embedding").alias("q_embedding")), "qid")
    return top(exact.select("qid", "id", cosine(F.col("embedding"), F.col("q_embedding")).alias("cosine")), ["qid"], [F.desc("cosine"), F.asc("id")], k)


def probes_for(index: Index, k: int = 10, target: float = 0.9, asked: int = 64) -> int:
    """The least number of lists to search for a recall of ``target`` at k, as measured on ``asked`` rows of the index against all of it: how far down
    a query's order of lists the lists of its true neighbours lie."""
    sample = index.rows.orderBy(F.xxhash64("id", F.lit("asked")), "id").limit(asked)
    everywhere = sample.select(F.col("id").alias("qid"), F.col("embedding").alias("q_embedding"))
    true = search(index, everywhere, k, len(index.centroids.value)).select("qid", "id")
    held = true.join(index.rows, "id").join(everywhere, "qid").select("embedding", "q_embedding").toArrow()  # asked * k rows
    found, q = (_unit(held.column(c).combine_chunks(), index.width) for c in (0, 1))
    c = index.centroids.value
    home, order = (found @ c.T).argmax(1), np.argsort(-(q @ c.T), axis=1, kind="stable")
    place = np.sort((order == home[:, None]).argmax(1))
    return int(place[max(0, int(np.ceil(target * len(place))) - 1)]) + 1 if len(place) else 1


# -- all rows against all queries -----------------------------------------------------

#: Most rows of a block whose partition is one task, rows of a block of the other side, and rows of a strip of scores.
STREAMED, HELD, STRIP = 16384, 512, 128
#: Bytes of the packed other side that are broadcast; beyond it every block of one side meets every one of the other in a task of its own.
HELD_BYTES = 64 << 20
NO_ID = -(1 << 63)


def _packed(rows: DataFrame, name: str, most: int) -> DataFrame:
    """Blocks (list, width, ids, vectors, factors) of at most ``most`` rows (list, id, embedding, factor) of one list and width, by partition. Null components make a zero vector,
    as its cosine is 0; a null vector has width -1."""
    e = F.col("embedding").cast("array<double>")
    e = F.when(e.isNull() | (F.size(e) == 0), F.array(F.lit(0.0))).when(F.exists(e, lambda x: x.isNull()), F.transform(e, lambda x: F.lit(0.0))).otherwise(e)
    rows = rows.select("list", F.coalesce(F.size("embedding"), F.lit(-1)).alias("width"), F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), e.alias("e"), F.col("factor").cast("double").alias("factor"))

    def pack(batches):
        held: dict[tuple[int, int], list] = {}

        def row(key):
            ids, vectors, factors = (np.concatenate(x) for x in zip(*held.pop(key)))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, factors)]], ["list", "width", "ids", "vectors", "factors"])

        for batch in batches:
            keys = np.c_[batch.column(0).to_numpy(), batch.column(1).to_numpy()]
            order = np.lexsort(keys.T[::-1])
            cuts = np.flatnonzero((np.diff(keys[order], axis=0) != 0).any(1)) + 1
            for rows_of in np.split(order, cuts) if len(order) else []:
                key, mine = tuple(keys[rows_of[0]].tolist()), batch.take(pa.array(rows_of))
                ids, factors = mine.column(2).to_numpy(), mine.column(4).to_numpy()
                x = mine.column(3).flatten().to_numpy().reshape(-1, max(1, key[1]))
                for at in range(0, len(ids), most):
                    held.setdefault(key, []).append((ids[at : at + most], x[at : at + most], factors[at : at + most]))
                    if sum(len(p[0]) for p in held[key]) >= most:
                        yield row(key)
        for key in list(held):
            yield row(key)

    names = ("list", "width", "ids", "vectors", "factors")
    return rows.mapInArrow(pack, "list long, width int, ids binary, vectors binary, factors binary").select(*[F.col(c).alias(f"{name}_{c}") for c in names])


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in the order of ``cosine``."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * y[:, k]
    return total


def _firsts(a, b, k: int, weight: float, others: bool = False):
    """Indexes x, y and cosine of the first ``k`` rows of block b for each of block a (``others``: those of another id), by the rounded cosine times weight and factor, then id. A
    product of matrices proposes all that rounding may bring into the first ``k``; those are computed in the order of ``cosine``."""
    (a_ids, a_raw, _), (b_ids, b_raw, factor) = a, b
    a_norm, b_norm = np.sqrt(_summed(a_raw, a_raw)), np.sqrt(_summed(b_raw, b_raw))
    unit = lambda m, n: np.where(np.isfinite(n)[:, None], m / np.where(n > 0, n, 1)[:, None], np.nan)
    u, v = unit(a_raw, a_norm), unit(b_raw, b_norm)
    slack, many = 4e-6 * abs(weight) * max(1.0, float(np.abs(factor).max())), min(k, len(b_ids))
    for at in range(0, len(a_ids), STRIP):
        score = (u[at : at + STRIP] @ v.T) * (weight * factor)
        score[np.isnan(score)] = np.inf
        if others:
            score[a_ids[at : at + STRIP, None] == b_ids] = -np.inf
        kth = np.partition(score, len(b_ids) - many, axis=1)[:, len(b_ids) - many]
        x, y = np.nonzero(score >= (kth - slack)[:, None])
        x += at
        if others:
            x, y = (z[a_ids[x] != b_ids[y]] for z in (x, y))
        ratio = np.zeros(len(x))
        for i in range(0, len(x), 1 << 16):
            p, q = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
            n = a_norm[p] * b_norm[q]
            with np.errstate(invalid="ignore", divide="ignore"):
                ratio[i : i + (1 << 16)] = np.where(n == 0, 0.0, _summed(a_raw[p], b_raw[q]) / n)
        order_by = np.round(np.round(ratio, 6) * weight * factor[y], 9)
        order = np.lexsort((b_ids[y], -np.where(np.isnan(order_by), np.inf, order_by), x))
        x, y, ratio = x[order], y[order], ratio[order]
        keep = np.arange(len(x)) - np.searchsorted(x, x) < many
        yield x[keep], y[keep], ratio[keep]


def nearest_rows(corpus: DataFrame, asked: DataFrame, k: int, weight: float = 1.0, stream_asked: bool = False) -> DataFrame:
    """(qid, id, ratio, factor): of each block of ``corpus`` (id, embedding, factor) the first ``k`` rows for each of ``asked`` (qid, q_embedding), vectors of one width being
    compared; the caller takes the first ``k`` of all. Exact, for every row and query: the products are as many as rows times queries, what leaves a task is
    ``k`` rows a query and block. The larger side is streamed in blocks, the other one meets each of them."""
    spark = corpus.sparkSession
    one = F.lit(0).cast("long").alias("list")
    corpus, asked = corpus.select(one, "id", "embedding", "factor"), asked.select(one, F.col("qid").alias("id"), F.col("q_embedding").alias("embedding"), F.lit(1.0).alias("factor"))
    streamed, held = ((x.where("embedding is not null") for x in ((asked, corpus) if stream_asked else (corpus, asked))))
    n = streamed.count()
    parts = max(1, min(-(-n // 1024), max(-(-n // STREAMED), 2 * spark.sparkContext.defaultParallelism)))
    names = ("a", "b") if stream_asked else ("b", "a")
    left = _packed(streamed.repartition(parts, F.xxhash64("id", "embedding")), names[0], STREAMED)
    return _scanned_blocks(_met(left, held, names[1], STREAMED if stream_asked else HELD), k, weight)


def nearest_of_owner(corpus: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(qid, id, ratio): as ``nearest_rows``, but a query (qid, owner, q_embedding) meets the rows of its own owner in ``corpus`` (id, owner, embedding), without those of its own id.
    All of them count: vectors of another width have cosine 0 with it, and a null one a null ratio. The products are as many as the rows of an owner times its queries.

    An owner's rows are cut into blocks by a hash, so that one who holds most rows is as many tasks as others together."""
    from .fulltext import small

    spark = corpus.sparkSession
    found = corpus.where("id is not null").groupBy("owner").agg(F.count("*").alias("n")).join(asked.select("owner").distinct(), "owner")
    owners = staged(found.select("owner", F.monotonically_increasing_id().alias("list"), "n", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("parts")), "owners")
    n, met = owners.agg(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).first()[0], small(owners.select("owner", "list", "parts"))
    dealt = corpus.where("id is not null").join(met, "owner").select("list", "id", "embedding", F.lit(1.0).alias("factor"), F.pmod(F.xxhash64("id", "embedding"), F.col("parts")).alias("part"))
    held = asked.where("qid is not null").join(met, "owner").select("list", F.col("qid").alias("id"), F.col("q_embedding").alias("embedding"), F.lit(1.0).alias("factor"))
    parts = max(1, min(-(-n // 1024), max(-(-n // STREAMED), 2 * spark.sparkContext.defaultParallelism)))
    left = _packed(dealt.repartition(parts, "list", "part"), "b", BLOCK)
    return _scanned_blocks(_met(left, held, "a", HELD), k, 1.0, others=True).select("qid", "id", "ratio")


def _met(left: DataFrame, held: DataFrame, side: str, most: int) -> DataFrame:
    """Pairs of blocks of one list: of ``left``, and of the rows ``held``, which are broadcast in blocks if they are small."""
    size = held.agg(F.coalesce(F.sum(F.coalesce(F.size("embedding"), F.lit(1)).cast("long") * 8 + 16), F.lit(0))).first()[0]
    small = size <= HELD_BYTES
    right = _packed(held.coalesce(1) if small else held.repartition(-(-size // HELD_BYTES), F.xxhash64("id")), side, most)
    if small:
        return left.join(F.broadcast(right), F.expr("a_list = b_list"))
    return left.join(staged(right, "held-blocks"), F.expr("a_list - b_list = 0"))  # no key of a shuffle, as one list may hold most blocks


def _scanned_blocks(pairs: DataFrame, k: int, weight: float, others: bool = False) -> DataFrame:
    """(qid, id, ratio, factor): the first ``k`` rows of block b for each of block a. ``others``: rows of other ids, and those of other widths, too."""

    def scan(batches):
        def block(batch, side, r, width):
            ids, vectors, factors = (batch.column(f"{side}_{c}")[r].as_buffer() for c in ("ids", "vectors", "factors"))
            return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, max(1, width)), np.frombuffer(factors, "<f8")

        for batch in batches:
            for r in range(batch.num_rows):
                widths = [batch.column(f"{side}_width")[r].as_py() for side in ("a", "b")]
                if widths[0] != widths[1] and not others:
                    continue
                a, b = (block(batch, side, r, width) for side, width in zip(("a", "b"), widths))
                if widths[0] != widths[1]:
                    a, b = ((ids, np.zeros((len(ids), 1)), factors) for ids, _, factors in (a, b))
                null = min(widths) < 0
                for x, y, ratio in _firsts(a, b, k, weight, others):
                    yield pa.RecordBatch.from_arrays([pa.array(a[0][x]), pa.array(b[0][y]), pa.nulls(len(x), pa.float64()) if null else pa.array(ratio), pa.array(b[2][y])], ["qid", "id", "ratio", "factor"])

    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return pairs.mapInArrow(scan, "qid long, id long, ratio double, factor double").select(named("qid"), named("id"), "ratio", "factor")


# -- joins ------------------------------------------------------------------------


def classes(rows: DataFrame) -> DataFrame:
    """(id, first): every row with the smallest id of its equal vectors."""
    same = F.xxhash64("embedding")
    held = rows.select("id", "embedding", same.alias("h"))
    least = held.groupBy("h", "embedding").agg(F.min("id").alias("first"))
    return held.join(least, ["h", "embedding"]).select("id", "first")


@dataclass
class Join:
    """Pairs of blocks that may hold a pair at ``least``, and how many pairs of rows they compare, of how many there are."""

    pairs: DataFrame
    compared: int
    all_pairs: int


def _radius(least: float) -> float:
    """How far apart unit vectors of a cosine of ``least`` are."""
    return float(np.sqrt(max(0.0, 2 - 2 * (least - MARGIN))))


def every_pair(rows: DataFrame) -> Join:
    """All pairs of blocks of ``rows`` (id, embedding; distinct vectors of one width): each row meets every block once, which is less than being a guest of most lists."""
    sized = rows.agg(F.count("*").alias("n"), F.first(F.size("embedding")).alias("width")).first()
    n, width = sized["n"], sized["width"] or 1
    number = max(1, -(-n // STREAMED))
    cut = rows.select(F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias("list"), "id", "embedding")

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT):
                part = batch.slice(at, DEALT)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.tobytes() for v in _unit(part.column(2), width)], pa.binary())], ["list", "id", "v"])

    blocks = _blocks(cut.mapInArrow(pack, "list int, id long, v binary"), 2 * STREAMED)
    of = lambda k: blocks.select(F.struct("list", "part").alias(f"{k}_key"), F.col("ids").alias(f"{k}_ids"), F.col("vectors").alias(f"{k}_vectors"))
    keys = blocks.select(F.struct("list", "part").alias("a_key"))
    meet = keys.crossJoin(F.broadcast(keys.withColumnRenamed("a_key", "b_key"))).where("a_key <= b_key")  # a row a pair of blocks
    tasks = max(1, number * (number + 1) // 2)
    pairs = meet.join(of("a"), "a_key").join(of("b"), "b_key").repartition(tasks, "a_key", "b_key")
    return Join(pairs.select(F.lit(width).alias("width"), (F.col("a_key") == F.col("b_key")).alias("same"), "a_ids", "a_vectors", "b_ids", "b_vectors"), n * (n - 1) // 2, n * (n - 1) // 2)


def candidates(rows: DataFrame, least: float, lists: int | None = None, spare: bool = False) -> Join:
    """Blocks of ``rows`` (id, embedding; distinct vectors of one width) that a join must compare. ``spare``: all blocks, where rows would be guests of so many lists that
    more would be moved than by ``every_pair``; which one it is is counted before rows are moved.

    A row is home in the list of its nearest centroid, and a guest of each earlier list that a row within the radius r of it may have as its home: for a
    centroid c and the own one h that needs d(x, c) <= d(x, h) + 2 r, (d(x, c)^2 - d(x, h)^2) / (2 |c - h|) <= r, and d(x, c) <= r + the
    greatest distance of a row that is home at c. Blocks of a list are cut in the order of the distance to its centroid, and two blocks meet
    only where these distances lie within r."""
    spark, r = rows.sparkSession, _radius(least)
    sized = rows.agg(F.count("*").alias("n"), F.first(F.size("embedding")).alias("width")).first()
    n, width = sized["n"], sized["width"] or 1
    found = centroids(rows, lists or int(np.clip(n**0.5 / 4, 1, MOST_LISTS)), width)
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(found @ found.T, -1, 1)))
    held = spark.sparkContext.broadcast((found, apart))

    def distances(x):
        c = held.value[0]
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T))

    def reach(batches):
        best: dict[int, float] = {}
        for batch in batches:
            d = distances(_unit(batch.column(1), width))
            for h, x in zip(d.argmin(1).tolist(), d.min(1).tolist()):
                best[h] = max(best.get(h, 0.0), x)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], ["list", "far"])

    far = np.full(len(found), -1.0)
    for row in rows.select("id", "embedding").mapInArrow(reach, "list int, far double").groupBy("list").agg(F.max("far").alias("far")).collect():  # a row a list
        far[row["list"]] = row["far"]

    def homes(batches):
        """Parts of batches: ids, unit vectors, distances, own lists, and the lists in which rows are at home or guests."""
        c_apart = held.value[1]
        step = max(1, DEALT // len(c_apart))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _unit(part.column(1), width)
                d = distances(x)
                h = d.argmin(1)
                own = d[np.arange(len(x)), h][:, None]
                gap = c_apart[h]
                near = (d <= own + 2 * r + 1e-9) & (d <= far + r + 1e-9) & (d**2 - own**2 <= 2 * r * gap + 1e-9) & (np.arange(d.shape[1]) < h[:, None])
                near[np.arange(len(x)), h] = True
                yield part.column(0), x, d, h, near

    def count(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(near.sum()) for *_, near in homes(batches))], pa.int64())], ["n"])

    def deal(batches):
        for ids, x, d, h, near in homes(batches):
            of, at = np.nonzero(near)
            packed = [v.tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(at != h[of]), pa.array(d[of, at]), ids.take(pa.array(of)), pa.array([packed[i] for i in of.tolist()], pa.binary())], ["list", "guest", "d", "id", "v"])

    if spare and n > BLOCK:
        # a guest is written, shuffled and goes on with its block to each block of the list
        moved = rows.select("id", "embedding").mapInArrow(count, "n long").agg(F.sum("n")).first()[0]
        if 3 * moved > n * (n // STREAMED + 2) and moved > 4 * n:
            return every_pair(rows)

    dealt = staged(rows.select("id", "embedding").mapInArrow(deal, "list int, guest boolean, d double, id long, v binary"), "join-rows")

    def pack(batches):
        now, ids, vectors, ds = None, [], [], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]]), pa.array([min(ds)]), pa.array([max(ds)]), pa.array([min(ids)], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())], ["list", "guest", "low", "high", "block", "many", "ids", "vectors"])

        for batch in batches:
            for at, guest, d, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and ((at, guest) != now or len(ids) >= BLOCK // 4):
                    yield row()
                    ids, vectors, ds = [], [], []
                now = at, guest
                ids.append(i)
                vectors.append(v)
                ds.append(d)
        if ids:
            yield row()

    keys = ["list", "guest", "d", "id"]  # an order that cuts large lists, too
    blocks = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pack, "list int, guest boolean, low double, high double, block long, many int, ids binary, vectors binary")
    blocks = staged(blocks, "join-blocks")
    left = blocks.where("not guest").select("list", *[F.col(c).alias(f"a_{c}") for c in ("low", "high", "block", "many")])
    right = blocks.select("list", "guest", *[F.col(c).alias(f"b_{c}") for c in ("low", "high", "block", "many")])
    meet = left.join(right, "list").where((F.col("b_low") <= F.col("a_high") + r) & (F.col("a_low") <= F.col("b_high") + r) & (F.col("guest") | (F.col("a_block") <= F.col("b_block"))))
    meet = staged(meet.select("list", "guest", "a_block", "b_block", "a_many", "b_many"), "block-pairs")
    compared = meet.agg(F.coalesce(F.sum(F.col("a_many").cast("long") * F.col("b_many")), F.lit(0))).first()[0]
    of = lambda k: blocks.select("list", *([F.col("guest")] if k == "b" else []), F.col("block").alias(f"{k}_block"), F.col("ids").alias(f"{k}_ids"), F.col("vectors").alias(f"{k}_vectors"), *([F.col("guest").alias("a_guest")] if k == "a" else []))
    pairs = meet.join(of("a").where("not a_guest"), ["list", "a_block"]).join(of("b"), ["list", "guest", "b_block"])
    same = (~F.col("guest")) & (F.col("a_block") == F.col("b_block"))
    return Join(pairs.select(F.lit(width).alias("width"), same.alias("same"), "a_ids", "a_vectors", "b_ids", "b_vectors"), int(compared), n * (n - 1) // 2)


def close_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """(i, j) with i < j of the pairs of rows in pairs of blocks whose cosine may reach ``least``, up to MARGIN."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                width, same = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                a, b = (np.frombuffer(batch.column(c)[n].as_py(), "<i8") for c in (2, 4))
                x, y = (np.frombuffer(batch.column(c)[n].as_py(), "<f8").reshape(-1, width) for c in (3, 5))
                for at in range(0, len(a), 2 * STRIP):
                    p, q = np.nonzero(x[at : at + 2 * STRIP] @ y.T >= least - MARGIN)
                    i, j = a[p + at], b[q]
                    keep = i < j if same else i != j
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)[keep]), pa.array(np.maximum(i, j)[keep])], ["i", "j"])

    return pairs.mapInArrow(run, "i long, j long")


def similarity_join(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(i, j, similarity) with i < j of all pairs of classes of equal vectors whose rounded cosine is ``least`` (above 0) or more, each class under
    its smallest id; and the classes (id, first) of all rows. Only rows of one width are compared with each other."""
    if least <= MARGIN:
        raise ValueError("least must be above 0")
    rows = staged(usable(rows).where("exists(embedding, x -> x <> 0)"), "join-input")
    member = staged(classes(rows), "classes")
    firsts = rows.join(member.where("id = first").select("id"), "id", "left_semi")
    firsts = staged(firsts.dropDuplicates(["id"]), "class-firsts")
    found = []
    for row in firsts.select(F.size("embedding").alias("width")).distinct().collect():  # a handful of widths
        mine = firsts.where(F.size("embedding") == row["width"])
        near = staged(close_pairs(candidates(mine, least, spare=True).pairs, least), "close-pairs")
        a, b = (mine.select(F.col("id").alias(k), F.col("embedding").alias(f"{k}_v")) for k in ("i", "j"))
        exact = near.join(a, "i").join(b, "j").select("i", "j", cosine(F.col("i_v"), F.col("j_v")).alias("similarity"))
        found.append(exact.where(F.col("similarity") >= least))
    out = rows.sparkSession.createDataFrame([], "i long, j long, similarity double")
    for f in found:
        out = out.unionByName(f)
    return out, member


def most_similar(rows: DataFrame, least: float, most: int) -> DataFrame:
    """The ``most`` most similar pairs i < j of rows at ``least``, by similarity, then ids; equal vectors are rows as any others.

    The pairs that blocks hold within themselves give a similarity that ``most`` pairs reach, and the join is made at that one. A class of equal
    vectors stands for its first ``most`` + 1 rows: no later row is in a first pair."""
    rows = staged(usable(rows), "similar-input")
    bound = least
    inside = rows.where("exists(embedding, x -> x <> 0)").groupBy(F.size("embedding").alias("width"), F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows.count() // (BLOCK // 4)))))).agg(F.collect_list(F.struct("id", "embedding")).alias("r"))

    def first(batches):
        for batch in batches:
            out = []
            for width, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array([v["embedding"] for v in r], float).reshape(-1, width)
                x /= np.sqrt((x * x).sum(1))[:, None]
                s = (x @ x.T)[np.triu_indices(len(x), 1)]
                out += np.sort(s)[::-1][:most].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["s"])

    best = inside.select("width", "r").mapInArrow(first, "s double").orderBy(F.desc("s")).limit(most).agg(F.min("s").alias("s"), F.count("*").alias("n")).first()
    if best["n"] == most:
        bound = max(least, round(best["s"], 6) - 2e-6)
    pairs, member = similarity_join(rows, bound)
    same = _few_members(member, most + 1)
    near = pairs.orderBy(F.desc("similarity"), "i", "j")
    # pairs of classes: of equal similarity all are kept, as any may hold the pair of the smallest ids
    edge = near.limit(most).agg(F.min("similarity").alias("s"), F.count("*").alias("n")).first()
    kept = pairs.where(F.col("similarity") >= edge["s"]) if edge["n"] == most else pairs
    a, b = (same.select(F.col("first").alias(k), F.col("ids").alias(f"{k}_ids")) for k in ("i", "j"))
    cross = kept.join(a, "i").join(b, "j").select(F.explode("i_ids").alias("x"), "j_ids", "similarity").select("x", F.explode("j_ids").alias("y"), "similarity")
    own = same.where(F.size("ids") > 1).select("ids", F.explode("ids").alias("x")).select("x", F.explode("ids").alias("y")).where("x < y")
    own = own.join(rows.select(F.col("id").alias("x"), "embedding"), "x").where("exists(embedding, x -> x <> 0)").select("x", "y", cosine(F.col("embedding"), F.col("embedding")).alias("similarity"))
    both = cross.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "similarity").unionByName(own.select(F.col("x").alias("i"), F.col("y").alias("j"), "similarity"))
    return both.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "i", "j").limit(most)


def _few_members(member: DataFrame, most: int) -> DataFrame:
    """(first, ids): the smallest ``most`` ids of each class; cut before they are gathered."""
    from .retrieval import top

    return top(member, ["first"], [F.asc("id")], most).groupBy("first").agg(F.sort_array(F.collect_list("id")).alias("ids"))
