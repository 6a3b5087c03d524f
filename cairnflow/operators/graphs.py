"""Connected components of an edge table by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..staging import drop_staged, staged


#: Bytes of rows (node, node) up to which what a round knows of the nodes is broadcast to the edges; beyond it edges and nodes are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (a, b: long), which may repeat and loop.

    Rounds end when the edges are stars; each costs two aggregations and two joins on the edges left. Nothing is collected. ``edges`` is read twice.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    alone = edges.where("a is null or b is null or a = b").select(F.coalesce("a", "b").alias("node")).where("node is not null")
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while True:
        few = now.count() * 16 <= BROADCAST_BYTES
        held = F.broadcast if few else lambda frame: frame
        # a round makes no more edges than it finds, so repeated ones only matter where they are many
        once = (lambda frame: frame) if few else lambda frame: frame.distinct()
        both = now.select("u", "v", F.col("v").alias("below")).union(now.select("v", "u", F.lit(None)))
        # below: smaller neighbours; a star has its centre below all its other nodes, and nothing else
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.first("u"), F.min("v")).alias("m"), (F.min("below") < F.max("v")).alias("open"))
        least = staged(least, "least")
        if not least.where("open").limit(1).count():
            break
        large = both.where("v > u").join(held(least), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = staged(once(large), "large-star")
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(held(low), F.col("u") == F.col("k")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = staged(once(small), "small-star")
        drop_staged(now, large, least)
        now = new
    return least.select(F.col("k").alias("node"), F.col("m").alias("component")).union(alone.select("node", "node")).groupBy("node").agg(F.min("component").alias("component"))


def nearby(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """``node, component`` for every node of a staged table of edges (a, b: long): a node that it is connected with, found by as many steps to the smallest neighbour
    as 2 ** ``jumps``. Nodes of one component may get several; equal ones are connected."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "nearby")
    for _ in range(jumps):
        on = now.select(F.col("node").alias("k"), F.col("component").alias("next"))
        on = F.broadcast(on) if now.count() * 16 <= BROADCAST_BYTES else on
        now = staged(now.join(on, F.col("component") == F.col("k")).select("node", F.col("next").alias("component")), "nearby")
    return now


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``known`` (staged: node, component, some connected node, the smallest one its own) and of a staged
    table of edges (a, b: long, none a loop). The edges are those by which ``known`` is connected, unless it holds whole components, and further ones: they are
    contracted first, so that rounds run on what they add."""
    small = known.count() * 16 <= BROADCAST_BYTES
    held = F.broadcast if small else lambda frame: frame
    of = lambda end: held(known.select(F.col("node").alias(f"k_{end}"), F.col("component").alias(f"c_{end}")))
    led = edges.join(of("a"), F.col("a") == F.col("k_a"), "left").join(of("b"), F.col("b") == F.col("k_b"), "left")
    led = staged(led.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b"), "contracted")
    joined = staged(connected_components(led), "joined")
    on = joined.select(F.col("node").alias("k"), F.col("component").alias("c"))
    on = F.broadcast(on) if joined.count() * 16 <= BROADCAST_BYTES else on
    old = known.join(on, F.col("component") == F.col("k"), "left").select("node", F.coalesce("c", "component").alias("component"))
    return old.union(joined.join(held(known.select("node")), "node", "left_anti"))
