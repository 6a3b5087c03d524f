"""Keyed tables on a file system whose renames are atomic (HDFS, shared disks): upserts, deletes and replacements that readers see whole or not at all.

Rows lie in ``buckets`` by a hash of their key. A change reads and writes only the buckets its rows fall in, into a new folder; then a manifest (where each
bucket's files lie, and the last batch of each stream) is renamed into place. A write that dies before leaves the old table, and a batch
that comes again changes nothing. Of two writers at once one fails, as the version it wants exists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..staging import drop_staged, staged


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    # -- files ------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self) -> list[int]:
        fs, folder = self._files(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last; of a table that was never written, one without buckets."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "batches": {}, "buckets": {}}
        held = self.spark.read.text(f"{self.path}/manifest/{versions[-1] if version is None else version}.json", wholetext=True).first()[0]
        return json.loads(held)

    def _commit(self, manifest: dict) -> None:
        fs = self._files()
        temporary, final = self._path(f"manifest/.{uuid.uuid4().hex}"), self._path(f"manifest/{manifest['version']}.json")
        out = fs.create(temporary, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {manifest['version']} was written by another writer")

    # -- rows -------------------------------------------------------------------

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def frame(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table, as of a version; of some buckets only."""
        held = self.manifest(version)["buckets"]
        folders = [f"{self.path}/{f}" for b, f in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def apply(self, change: Callable[[DataFrame, DataFrame], DataFrame], rows: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """The table after ``change`` (old rows, ``rows``) -> new rows, over the buckets that ``rows`` (with the keys' columns) fall in. ``batch`` numbers the
        changes of a stream: one that is not above the last is left out (False)."""
        now = self.manifest()
        if batch is not None and now["batches"].get(stream, -1) >= batch:
            return False
        rows = staged(rows, "table-rows")
        touched = {r[0] for r in rows.select(self.bucket()).distinct().collect()}  # at most ``buckets``
        buckets = dict(now["buckets"])
        if touched:
            folder = f"data/{now['version'] + 1}-{uuid.uuid4().hex}"
            new = change(self.frame(buckets=touched), rows).select(*self.schema.names).withColumn("bucket_", self.bucket())
            new.repartition(len(touched), "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
            fs = self._files()
            for b in touched:
                buckets.pop(str(b), None)
                if fs.exists(self._path(f"{folder}/bucket_={b}")):
                    buckets[str(b)] = f"{folder}/bucket_={b}"
        drop_staged(rows)
        batches = now["batches"] | ({} if batch is None else {stream: batch})
        self._commit({"version": now["version"] + 1, "batches": batches, "buckets": buckets})
        return True

    def sink(self, change: Callable[[DataFrame, DataFrame], DataFrame], stream: str):
        """For ``writeStream.foreachBatch``: each batch is one change, once."""
        return lambda rows, batch: self.apply(change, rows, stream, batch)

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests before the last ``keep`` and the folders that only they name; how many folders went."""
        versions, fs = self._versions(), self._files()
        live = {f.split("/")[1] for v in versions[-keep:] for f in self.manifest(v)["buckets"].values()}
        for v in versions[:-keep]:
            fs.delete(self._path(f"manifest/{v}.json"), False)
        folders = [s.getPath().getName() for s in fs.listStatus(self._path("data"))] if fs.exists(self._path("data")) else []
        last = versions[-1] if versions else 0
        gone = [f for f in folders if f not in live and int(f.split("-")[0]) <= last]  # later ones may be under way
        for f in gone:
            fs.delete(self._path(f"data/{f}"), True)
        return len(gone)


def removed(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """K5: a change that deletes the keys of its rows."""
    return lambda old, rows: old.join(rows.select(*keys).distinct(), keys, "left_anti")


def switched(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """K7: a change that adds the keys it lacks and deletes those it has; of a key that comes more than once, every time counts."""

    def change(old: DataFrame, rows: DataFrame) -> DataFrame:
        odd = rows.groupBy(*keys).agg(F.count("*").alias("times_"), *[F.first(c).alias(c) for c in old.columns if c not in keys]).where("times_ % 2 = 1").drop("times_")
        return old.join(odd.select(*keys), keys, "left_anti").unionByName(odd.join(old.select(*keys), keys, "left_anti").select(*old.columns))

    return change


def replaced(part: str, columns: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """K6: a change that replaces all rows of the parts (a column, which is the table's key) that its rows have."""
    return lambda old, rows: old.join(rows.select(part).distinct(), part, "left_anti").select(*columns).unionByName(rows.select(*columns))
