"""Helpers that the training-data operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..staging import drop_staged, shared_dir, staged  # noqa: F401

#: Rows and bytes in one Arrow batch that an operator takes at a time, which bound a Python worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Settings of Python workers' allocators: large arrays go back to the system as soon as they are free, also in idle workers.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}


def settle(spark: SparkSession) -> None:
    """From now on the session hands Python at most BATCH_ROWS rows and about BATCH_BYTES bytes at once, as texts are long. The
    plans that operators return run after they return, so this holds for the session; smaller settings of its own stay. Shuffle files
    go with the query that made them, as staged tables are what later ones read."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)


@contextmanager
def short_plans(spark: SparkSession):
    """Meanwhile the texts of plans name no columns. The driver makes and keeps a plan's text at its start and after each of its exchanges; with a literal of
    megabytes these are most of what the driver's heap gets."""
    held = {name: spark.conf.get(name, None) for name in ("spark.sql.debug.maxToStringFields", "spark.sql.maxPlanStringLength")}
    for name, most in zip(held, ("0", str(1 << 16))):
        spark.conf.set(name, most)
    try:
        yield
    finally:
        for name, value in held.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder, in a settled session."""
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``text`` of the documents table, nothing else."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def utf8(text: str | None) -> bytes:
    """A text's UTF-8 bytes; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def unit_hash(*parts: str | Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the values alone: 52 bits of an MD5 digest."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4503599627370496.0)


def crc32_of_id(column: str) -> Column:
    """crc32 of the id written as decimal text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def split_batch(batch, rows: int = BATCH_ROWS):
    """Slices of an Arrow batch of at most ``rows`` rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
