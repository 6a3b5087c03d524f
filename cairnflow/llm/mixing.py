"""Mixing sources to target weights by Pareto order sampling.

A document's size is its number of words. Sources in code-point order (null last) weigh 5, 2, 1, repeating.
They share ``share`` (150 %) of all sizes by weight; no target passes ``most`` (2) times its source's size, and what
is cut is shared again by weight among the rest (in closed form: sources in the order of cap over weight).

Within a source the copies that a document is expected to have grow with the fourth root of its size, and are at most
``most``: longer documents repeat somewhat more often, short ones rather not. The factor, one for each source, is the one whose
expected words are the source's target; it is solved on the words by measure, of which a source has a few thousand.
The whole part of that number is taken for certain. Its fraction is the document's inclusion probability p, and a sample of
fixed size in words without replacement takes documents in the order of (u / (1 - u)) / (p / (1 - p)), u their random
number, as long as the middle of the next one lies below what is expected. Documents of ``LONG`` words or more are drawn
first, to the words their probabilities sum to, and shorter ones then to all that is missing, so that a source ends
within half a short document of its target where it has enough of them.

The order needs no sort of a source: a histogram of the odds ratio over (1 + ratio), of more bins the more
documents there are, tells the one bin in which the sample ends, and only the documents in that bin are sorted.

Defined results: a null text has size 0 and takes 0 words; an empty table gives an empty mix; equal rows have equal
random numbers, and any order among them gives the same set of results; u depends on the seed and doc_id alone (on the text where
doc_id is null), so reruns agree; other columns are not read. With a ``key`` (a column that tells rows apart) it comes with every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import staged, unit_hash

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words from which a document counts as long.
LONG = 256
#: Steps of the measure (the fourth root of a size), and of a copy in the numbers of copies expected; both are whole numbers, so that sums are exact.
MEASURE, COPY = 64, 65536
#: Documents for which the histogram has one more bin, and its least number of bins.
BIN_DOCS, BINS = 4096, 1024
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target for rows of (source, size). The windows run over one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (
        F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(share)
        - F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    water = F.max(F.when(~F.col("capped"), F.col("level"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(water * F.col("weight")).alias("target"))


def measure(size: Column) -> Column:
    return F.floor(F.sqrt(F.sqrt(size.cast("double"))) * MEASURE).cast("long")


def rates(sized: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """r_source, rate: expected copies by measure, of sources where not every document has ``most`` copies."""
    levels = sized.where("size > 0").groupBy("source", measure(F.col("size")).alias("m")).agg(F.sum("size").alias("words"))
    down = W.partitionBy("source").orderBy(F.desc("m"))
    capped = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("m")).over(down.rowsBetween(0, W.unboundedFollowing))
    levels = levels.withColumn("capped", capped).withColumn("rest", rest).withColumnRenamed("source", "r_source")
    levels = levels.join(goal.select("source", "target"), F.col("r_source").eqNullSafe(F.col("source")))
    levels = levels.withColumn("rate", (F.col("target") - F.lit(float(most)) * F.col("capped")) / F.col("rest"))
    return levels.where(F.col("rate") * F.col("m") <= most).groupBy("r_source").agg(F.max_by("rate", "m").alias("rate"))


def _drawn(rows: DataFrame, quota: DataFrame, key: list[str]) -> DataFrame:
    """Marks with ``drawn`` the rows (source, odds, bin, size, key) that fill each source's words of ``quota`` (q_source, quota)."""
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("before", before).join(quota, F.col("source").eqNullSafe(F.col("q_source")))
    ends = bins.where(F.col("before") + F.col("words") > F.col("quota")).groupBy("source").agg(F.min_by(F.struct("bin", "before", "quota"), "bin").alias("e"))
    ends = staged(ends.select(F.col("source").alias("e_source"), F.col("e.bin").alias("end"), F.col("e.before").alias("before"), F.col("e.quota").alias("quota")), "mix-ends")
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    inside = W.partitionBy("source").orderBy("odds", "size", "doc_id", *key).rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = rows.where("bin = end").withColumn("drawn", ahead + F.col("size") / 2.0 <= F.col("quota"))
    rest = rows.where("end is null or bin <> end").withColumn("drawn", F.col("end").isNull() | (F.col("bin") < F.col("end")))
    return rest.unionByName(last).drop("end", "before", "quota")


def mix(docs: DataFrame, seed: str = SEED, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and any ``key`` for every row of ``docs`` (doc_id, text, source, key)."""
    keys = [key] if key else []
    text = F.col("text").cast("string")
    said = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(text))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), unit_hash(said, seed=seed).alias("u"), *keys)
    sized = staged(sized, "mix-sizes")
    bins = max(BINS, -(-sized.count() // BIN_DOCS))
    goal = staged(targets(sized, share, most, weights), "mix-targets")
    goal = goal.join(rates(sized, goal, most), F.col("source").eqNullSafe(F.col("r_source")), "left").drop("r_source")
    goal = staged(goal.withColumnRenamed("source", "t_source"), "mix-rates")
    copies = F.least(F.lit(most * COPY), F.coalesce(F.floor(F.col("rate") * measure(F.col("size")) * COPY).cast("long"), F.lit(most * COPY)))
    rows = sized.join(goal, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("expected", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)))
    rows = rows.drop("t_source", "rate").withColumn("whole", F.floor(F.col("expected") / COPY).cast("long")).withColumn("part", F.col("expected") % COPY).drop("expected")
    p = F.col("part") / F.lit(float(COPY))
    open_ = rows.where("part > 0").withColumn("odds", F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(p, 1 - p))).drop("u", "part")
    open_ = open_.withColumn("bin", F.floor(F.col("odds") / (1 + F.col("odds")) * bins).cast("long"))
    closed = rows.where("part = 0").drop("u", "part").withColumn("drawn", F.lit(False))
    long_words = F.sum(F.when(F.col("size") >= LONG, F.col("part") * F.col("size")).otherwise(0)) / F.lit(float(COPY))
    quotas = rows.groupBy(F.col("source").alias("q_source")).agg(long_words.alias("long"), (F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("missing"))
    quotas = staged(quotas, "mix-quotas")
    long_drawn = _drawn(open_.where(F.col("size") >= LONG), quotas.select("q_source", F.col("long").alias("quota")), keys)
    taken = long_drawn.where("drawn").groupBy(F.col("source").alias("g_source")).agg(F.sum("size").alias("got"))
    left = quotas.join(taken, F.col("q_source").eqNullSafe(F.col("g_source")), "left").select("q_source", F.greatest(F.col("missing") - F.coalesce("got", F.lit(0)), F.lit(0.0)).alias("quota"))
    short_drawn = _drawn(open_.where(F.col("size") < LONG), staged(left, "mix-left"), keys)
    drawn = long_drawn.unionByName(short_drawn).drop("odds", "bin").unionByName(closed)
    copies = F.col("whole") + F.col("drawn").cast("long")
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *keys)
