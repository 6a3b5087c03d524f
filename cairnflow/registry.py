"""Registration of queries: a name, a callable (spark, sf_dir) and, where SQL can express it, SQL over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes, read when they are first asked for: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, frame)
        return frame


def query(name: str, oracle: str | None = None):
    """Register a function of Tables under ``name``, with its SQL."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def plain(name: str, text: str) -> None:
    """Register a statement that reads the same in Spark and in DuckDB; ``{orders}`` names a table."""
    tables = set(re.findall(r"\{(\w+)\}", text))

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = Tables(spark, folder)
        return spark.sql(text, **{k: getattr(t, k) for k in tables})

    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", text)
