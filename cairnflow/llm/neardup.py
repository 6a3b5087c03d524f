"""Near-duplicates by bottom-k sketches from one hash function.

A text's set is its distinct word shingles (hashes of two 64-bit lanes); its sketch is the ``SKETCH`` smallest of one lane. Equal sets
are one node, named by its smallest doc_id. Inverted lists of the ``LISTED`` smallest values propose pairs, union sketches estimate
them, and exact Jaccard similarity over both lanes of the whole sets confirms them. Links become components.

Pairs are never all emitted. First every list links its nodes to its smallest node (a star); what is confirmed joins
components, of which the turns need only a near picture (``graphs.nearby``). In lists of over ``SHORT`` nodes that several components share, the nodes outside the largest of them (strays) are then
linked to a random node of it, another in each list, up to ``TURNS`` times. After that only pairs across components are proposed:
directly in lists of at most ``SHORT`` nodes; nodes in longer lists are listed again under all values of their sketch, and short lists
among those propose the rest. Nodes most of whose sketch lies in long lists (``MOSTLY`` values or more) are compared by their whole sets
inside their long lists, but for those that hold too many shingles alone to be similar to any other (``_linkable``); lists around one component
are one where that makes fewer pairs, as their nodes are mostly the same (``_merged``). Blocks of the strays that are left meet blocks of all nodes, both
of bounded size, and only links that join components (fewer than the rows) leave a pair of blocks. What is compared there still grows with strays
times nodes of a list: of nodes that are neither similar nor told apart by shingles of their own, each pair has to be looked at.

Two sets of similarity 0.8 or more share none of the listed values with a chance of at most 0.2 ** 12 = 4e-9, and fail the
estimate (six standard deviations) with a chance of the order of 1e-8; sets of at most ``SKETCH`` shingles are compared exactly throughout.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; rows without a doc_id are
linked with nothing and kept (their component_id is null); rows that share a doc_id are one node and so linked; an empty table
gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graphs import extended, nearby
from .common import drop_staged, split_batch, staged, utf8
from .shingles import shared, shingle_sets

WIDTH = 5
PERCENT = 80
_U = np.uint64
SKETCH = 64
LISTED = 12
SHORT = 64
#: Values shared by two sketches of a pair of similarity 0.8, less six standard deviations: 0.8 k - 6 sqrt(0.16 k).
MOSTLY = 32
TURNS = 1
#: Nodes, and shingles of their sets, in a block of strays; a block of nodes may have four times as many.
BLOCK, BLOCK_SHINGLES = 128, 1 << 16
#: Bytes of sets that a task keeps while it confirms pairs, besides the pair at hand.
HELD_BYTES = 8 << 20
#: Bytes of node ids that are broadcast to pick texts for confirmation; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of sketches or texts that are broadcast to pairs. Only tables of a few thousand documents are so small: what is shuffled for pairs follows the input from there
#: on, and the driver never gathers more than this of either.
BROADCAST_SKETCHES, BROADCAST_TEXTS = 1 << 20, 1 << 20
#: Pairs that a task confirms where their texts are broadcast.
CONFIRMED = 512


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), set_key (digest of the set, null if empty), sketch (SKETCH smallest hashes, ascending)."""

    def run(batches):
        for big in batches:
            for batch in split_batch(big):
                sets = shingle_sets([utf8(t) for t in batch.column(1).to_pylist()], width)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s[0]) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([s[0][:SKETCH].tobytes() for s in sets], pa.binary())],
                    ["doc_id", "n", "set_key", "sketch"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n long, set_key binary, sketch binary")


def listed(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """value, node, n for the sketch values of rank ``first`` to ``last`` (exclusive) of each node."""

    def run(batches):
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = [np.frombuffer(x.as_py(), "<i8")[first:last] for x in batch.column(2)]
            times = np.fromiter(map(len, parts), np.int64, len(parts))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)), pa.array(np.repeat(node, times)), pa.array(np.repeat(n, times))], ["value", "node", "n"])

    return nodes.select("node", "n", "sketch").mapInArrow(run, "value long, node long, n long")


def passes(x: np.ndarray, nx: int, y: np.ndarray, ny: int, percent: int = PERCENT) -> bool:
    """Whether the union of two sketches lets the sets' similarity reach ``percent``."""
    whole = len(x) >= nx and len(y) >= ny
    if not whole:
        limit = min([s[-1] for s, n in ((x, nx), (y, ny)) if len(s) < n])
        x, y = x[: np.searchsorted(x, limit, "right")], y[: np.searchsorted(y, limit, "right")]
    shared = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - shared
    share = percent / 100
    return 100 * shared >= percent * union if whole else shared >= share * union - 6 * (share * (1 - share) * union) ** 0.5


def _similar_sizes(percent: int):
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _few(table: DataFrame, row_bytes: int = 16) -> DataFrame:
    """A staged table, broadcast in joins while it is small."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def _only(frame: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``frame`` whose key is in ``ids`` (one column of that name, staged)."""
    return frame.join(_few(ids), key, "left_semi")


def _ids(pairs: DataFrame, name: str) -> DataFrame:
    """The nodes of the pairs (a, b) of a staged table, repeated where they are few enough to be broadcast so."""
    both = pairs.select(F.col("a").alias(name)).union(pairs.select("b"))
    return both if pairs.count() * 32 <= BROADCAST_BYTES else staged(both.distinct(), "pair-ids")


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a staged table whose union sketch passes. Pairs meet the upper halves of the sketches' values: values that only
    become equal by that count as shared, so a pair may pass that whole values would stop, and not the other way round."""

    def halved(batches):
        for batch in batches:
            upper = [np.frombuffer(x.as_py(), "<u4")[1::2].tobytes() for x in batch.column(2)]
            yield batch.set_column(2, "sketch", pa.array(upper, pa.binary()))

    def run(batches):
        for batch in batches:
            keep = [
                passes(np.frombuffer(x, "<u4"), nx, np.frombuffer(y, "<u4"), ny, percent)
                for nx, x, ny, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    nodes = _only(nodes.select("node", "n", "sketch"), "node", _ids(pairs, "node"))
    few = nodes.count() * (4 * SKETCH + 48) <= BROADCAST_SKETCHES
    nodes = nodes.mapInArrow(halved, "node long, n long, sketch binary")
    nodes = F.broadcast(nodes) if few else nodes
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    return pairs.join(a, "a").join(b, "b").where(_similar_sizes(percent)).select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union. ``pairs`` is a staged table."""
    def pack(batches):
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        for big in batches:
            for batch in split_batch(big):
                yield batch.set_column(1, "text", pa.array([tool.compress(utf8(t)) for t in batch.column(1).to_pylist()], pa.binary()))

    texts = _only(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), "doc_id", _ids(pairs, "doc_id")).mapInArrow(pack, "doc_id long, text binary")
    texts = staged(texts, "confirm-texts")

    def compare(batches):
        import zstandard

        tool = zstandard.ZstdDecompressor()
        held: dict[bytes, np.ndarray] = {}

        size = 0

        def set_of(data: bytes) -> np.ndarray:
            nonlocal size
            if data not in held:
                found = shingle_sets([tool.decompress(data)], width)[0]
                size += found.nbytes
                while held and size > HELD_BYTES:
                    size -= held.pop(next(iter(held))).nbytes
                held[data] = found
            return held[data]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                y, x = set_of(y), set_of(x)
                n = shared(x, y)
                keep.append(n > 0 and 100 * n >= percent * (len(x[0]) + len(y[0]) - n))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    if (texts.agg(F.sum(F.octet_length("text") + 48)).first()[0] or 0) <= BROADCAST_TEXTS:
        texts, pairs = F.broadcast(texts), pairs.repartition(pairs.count() // CONFIRMED + 1)
    a, b = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("t_a")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "t_a", "t_b").mapInArrow(compare, "a long, b long")


def _whole(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """node, whole: 48 bits of every shingle hash of the documents in ``ids``."""

    def run(batches):
        for big in batches:
            for batch in split_batch(big):
                sets = shingle_sets([utf8(t) for t in batch.column(1).to_pylist()], width)
                data = [np.ascontiguousarray(x[0].view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["node", "whole"])

    texts = docs.selectExpr("cast(doc_id as long) node", "cast(text as string) text")
    return _only(texts, "node", ids).mapInArrow(run, "node long, whole binary")


def _linkable(whole: DataFrame, percent: int) -> DataFrame:
    """The nodes of ``whole`` (node, whole) that may be similar to another one: shingles that a node alone holds are in no intersection, so the others must
    make ``percent`` of its set."""

    def run(batches):
        for batch in batches:
            data = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 6) for x in batch.column(1)]
            wide = np.zeros((sum(map(len, data)), 8), np.uint8)
            wide[:, 2:] = np.concatenate([np.zeros((0, 6), np.uint8), *data])
            yield pa.RecordBatch.from_arrays([pa.array(wide.view("<i8").ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in data]))], ["shingle", "node"])

    held = whole.mapInArrow(run, "shingle long, node long").groupBy("shingle").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("node"))
    alone = held.where("many = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    size = F.octet_length("whole") / 6
    return whole.select("node", size.alias("n")).join(alone, "node", "left").where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n")).select("node")


def _merged(rows: DataFrame) -> DataFrame:
    """Rows (value, main, node, n, comp, stray) of long lists as (value, node, n, comp, stray): lists of one main component are one list, each node once, where
    that makes no more pairs of a stray and a node than the lists on their own. Nodes that share a list share one still."""
    counts = [F.count(F.when(F.col("stray"), 1)).alias("strays"), F.count(F.lit(1)).alias("nodes")]
    apart = rows.groupBy("main", "value").agg(*counts).groupBy("main").agg(F.sum(F.col("strays") * F.col("nodes")).alias("apart"))
    once = rows.select(F.col("main").alias("value"), "node", "n", "comp", "stray").distinct()
    together = once.groupBy(F.col("value").alias("main")).agg(*counts).select("main", (F.col("strays") * F.col("nodes")).alias("together"))
    fewer = _few(staged(apart.join(together, "main").where("together <= apart").select("main"), "merged-lists"))
    whole = once.join(fewer, F.col("value") == F.col("main"), "left_semi")
    return whole.unionByName(rows.join(fewer, "main", "left_anti").drop("main"))


def _blocked(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components within long lists: of rows (value, node, n, comp, stray, whole), each block of a list's strays
    meets each block of its nodes, and gives a spanning forest of their links. ``whole`` is added to both by the join after the dealing."""

    def run(table: pa.Table) -> pa.Table:
        stray, node, comp = (np.array(table.column(c).to_pylist()) for c in ("stray", "node", "comp"))
        sets = []
        for x in table.column("whole"):
            data = np.frombuffer(x.as_py(), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(data), 8), np.uint8)
            wide[:, 2:] = data
            sets.append(wide.view("<u8").ravel())
        sizes = np.array([len(x) for x in sets])
        of = np.flatnonzero(~stray)
        every, owner = np.concatenate([np.zeros(0, _U), *(sets[i] for i in of)]), np.repeat(of, sizes[of])
        by = np.argsort(every)
        every, owner = every[by], owner[by]
        parent = {c: c for c in comp.tolist()}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        for i in np.flatnonzero(stray).tolist():
            low, high = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
            many = high - low
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[i] + sizes - both)) & (comp != comp[i])).tolist():
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("value", "i", "j").applyInArrow(run, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """(value, i, j, stray, node, n, comp): rows (value, node, n, comp, stray) of long lists dealt to the pairs of a block of strays and a block of nodes."""
    sizes = rows.groupBy("value").agg(F.count(F.when(F.col("stray"), 1)).alias("strays"), F.sum(F.when(F.col("stray"), F.col("n"))).alias("stray_n"), F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("nodes_n"))
    blocks = lambda many, shingles, k: F.greatest(F.ceil(F.col(many) / (k * BLOCK)), F.ceil(F.col(shingles) / (k * BLOCK_SHINGLES))).cast("int")
    sizes = staged(sizes.where("strays > 0").select("value", blocks("strays", "stray_n", 1).alias("is"), blocks("nodes", "nodes_n", 4).alias("js")), "dense-sizes")
    rows = rows.join(_few(sizes), "value")
    own = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    nodes = rows.select("value", every("is").alias("i"), own("js").alias("j"), F.lit(False).alias("stray"), "node", "n", "comp")
    strays = rows.where("stray").select("value", own("is").alias("i"), every("js").alias("j"), F.lit(True).alias("stray"), "node", "n", "comp")
    return nodes.unionByName(strays)


def _across(lists: DataFrame, percent: int, apart: bool = False) -> DataFrame:
    """Pairs (a, b), which may repeat, across components in short lists (value, node, n, comp); ``apart``: not both of them c_busy."""
    more = ["c_busy"] if apart else []
    x = lists.select("value", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("c_a"), *[F.col(c).alias("x_busy") for c in more])
    y = lists.select("value", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("c_b"), *[F.col(c).alias("y_busy") for c in more])
    fit = (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _similar_sizes(percent)
    return x.join(y, "value").where(fit & ~(F.col("x_busy") & F.col("y_busy")) if apart else fit).select("a", "b")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The links among proposed pairs (a, b), staged."""
    proposed = staged(pairs, f"{name}-pairs")
    likely = staged(estimated(proposed, nodes, percent), f"{name}-estimates")
    found = staged(confirmed(likely, docs, width, percent), f"{name}-links")
    drop_staged(proposed, likely)
    return found


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches by row, nodes by set, components by node)."""
    if not PERCENT <= percent <= 100:
        raise ValueError(f"the lists and blocks are sized for similarities from {PERCENT} to 100 percent")
    wide = staged(sketched(docs, width), "sketches")
    sets = wide.where("doc_id is not null and set_key is not null")
    nodes = staged(sets.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    rows = staged(wide.drop("sketch"), "set-keys")
    drop_staged(wide)
    index = staged(listed(nodes, 0, LISTED), "lists")
    counted = index.groupBy("value").agg(F.count(F.lit(1)).alias("refs"), F.min("node").alias("hub"), F.min_by("n", "node").alias("hub_n")).where("refs > 1")
    counted = staged(counted, "list-sizes")
    # long lists are few and meet their sizes by broadcast, so that no task gets all rows of one
    long = _few(staged(counted.where(F.col("refs") > SHORT), "long-lists"), 32)
    hot = staged(index.join(long, "value"), "long-rows")
    cold = staged(index.join(long.select("value"), "value", "left_anti").join(_few(counted, 40), "value"), "short-rows")
    drop_staged(index, counted)
    stars = hot.unionByName(cold).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_n").alias("n_a"), F.col("n").alias("n_b"))
    found = _confirmed(stars.where(_similar_sizes(percent)).select("a", "b").distinct(), nodes, docs, width, percent, "star")

    # before the turns nodes that are near each other by stars count as one component; some that are connected may count as several
    comps = nearby(found)

    def with_comp(frame: DataFrame) -> DataFrame:
        known = _few(comps).select(F.col("node").alias("c_node"), F.col("component").alias("comp"))
        return frame.join(known, F.col("node") == F.col("c_node"), "left").withColumn("comp", F.coalesce("comp", "node")).drop("c_node")

    def mixed(lists: DataFrame) -> DataFrame:
        """The rows (value, node, n, comp) of lists that several components share, the largest of these (main), and whether they lie outside it (stray)."""
        sizes = lists.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("many"))
        main = staged(sizes.groupBy("value").agg(F.max_by("comp", F.struct("many", "comp")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds"), "main-components")
        return lists.join(_few(main, 24), "value").withColumn("stray", F.col("comp") != F.col("main"))

    for turn in range(TURNS):
        lists = staged(mixed(with_comp(hot.select("value", "node", "n"))), "mixed-long")
        if not lists.limit(1).count():
            break
        turned = F.xxhash64("value", "node", F.lit(turn))
        hubs = lists.where("not stray").groupBy("value").agg(F.min_by(F.struct("node", "n"), turned).alias("h")).select("value", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))
        pairs = lists.where("stray").join(_few(staged(hubs, "hubs"), 24), "value").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.col("n").alias("n_a"), F.col("hub_n").alias("n_b"))
        more = _confirmed(pairs.where(_similar_sizes(percent)).select("a", "b"), nodes, docs, width, percent, "turn")
        drop_staged(lists)
        if not more.limit(1).count():
            break
        found = found.unionByName(more)
        if turn + 1 < TURNS:
            comps = nearby(found)
    comps = staged(extended(comps, found), "star-components")
    pairs = _across(with_comp(cold.select("value", "node", "n")), percent)
    lists = staged(mixed(with_comp(hot.select("value", "node", "n"))), "mixed-long")
    dense = None
    if lists.limit(1).count():
        busy = staged(_only(nodes, "node", lists.select("node")), "busy-nodes")
        every = staged(listed(busy, 0, SKETCH), "busy-lists")
        sizes = staged(every.groupBy("value").agg(F.count(F.lit(1)).alias("refs")).where("refs > 1"), "busy-sizes")
        # every shared value with the length of its list, once for long and short ones; beyond what is broadcast a value of very many nodes is a skewed key of this join
        known = staged(every.join(_few(sizes), "value"), "busy-shared")
        drop_staged(every)
        crowded = known.where(F.col("refs") > SHORT)
        mostly = crowded.groupBy("node").agg(F.count(F.lit(1)).alias("crowd"), F.first("n").alias("m")).where(F.col("crowd") >= F.least(F.lit(MOSTLY), F.floor(F.col("m") / 2))).select("node")
        mostly = staged(mostly, "mostly-busy")
        # pairs among the mostly busy come from the blocks below
        few = mostly.select(F.col("node").alias("m_node"))
        loose = known.where(F.col("refs") <= SHORT).drop("refs")
        loose = with_comp(loose).join(few, F.col("node") == F.col("m_node"), "left").withColumn("c_busy", F.col("m_node").isNotNull())
        pairs = pairs.union(_across(loose, percent, apart=True))
        whole = staged(_whole(docs, mostly, width), "dense-sets")
        near = staged(_linkable(whole, percent), "dense-nodes")
        rest = staged(_merged(staged(mixed(_only(lists.select("value", "node", "n", "comp"), "node", near)), "dense-lists")), "dense-rows")
        dense = staged(_blocked(_dealt(rest).join(_only(whole, "node", near), "node"), percent).distinct(), "dense-links")
    pairs = staged(pairs.distinct(), "cross-pairs")
    pairs = staged(estimated(pairs, nodes, percent), "cross-estimates")
    if dense is not None:
        pairs = pairs.union(dense)
    more = staged(confirmed(pairs, docs, width, percent), "cross-links")
    return rows, nodes, staged(extended(comps, more), "components")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    rows, nodes, comps = links(docs, width, percent)
    names = nodes.join(comps, "node", "left").select(F.col("set_key").alias("k"), F.coalesce("component", "node").alias("component"))
    # rows under one doc_id are one node, whatever their sets
    return rows.join(names, F.col("set_key") == F.col("k"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.coalesce("component", "doc_id")).otherwise(True).alias("kept"),
    )
