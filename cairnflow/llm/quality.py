"""Quality by compression: zstandard dictionaries built from good and bad labelled texts.

A text is compressed with either dictionary. The difference of the sizes over their sum, and the sizes per byte, go
through a logistic calibration that is fitted on labelled texts which the dictionaries have not seen; its output is
the score (the chance that ``labels.quality`` is 1).

The fit uses a bounded sample: at most ``PER_LABEL`` labelled documents of either label and ``TRAIN_BYTES`` of their
text, taken in the order of an MD5 number of doc_id, whole texts only. Half of it builds the dictionaries, half calibrates, and weights
restore the labels' shares among all labelled rows. Every text is scored whole, once per dictionary.

Defined results: null and empty texts get the score of an empty text; where a label is missing from the sample, every
score is the share of label 1 (1.0 without labels); labelled ids that occur twice count twice; equal texts have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import crc32_of_id, split_batch, unit_hash, utf8

PER_LABEL = 1500
TRAIN_BYTES = 32 << 20
DICTIONARY_BYTES = 32768
#: Bytes of the pieces that a dictionary is built from.
PIECE = 400
LEVEL = 3
THRESHOLD = 0.7
#: Bytes of a frame that hold no content.
FRAME = 10


@dataclass
class Model:
    """Two dictionaries and the calibration; pickled to executors, a few tens of KB."""

    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    constant: float | None = None

    def compressors(self):
        import zstandard

        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False) for d in (self.good, self.bad)]

    def features(self, texts: list[str | None], compressors=None) -> np.ndarray:
        good, bad = compressors or self.compressors()
        out = np.zeros((len(texts), 7))
        for i, text in enumerate(texts):
            data = utf8(text)
            n, a, b = len(data) + 1, len(good.compress(data)) - FRAME, len(bad.compress(data)) - FRAME
            d, r = (b - a) / (a + b + 2 * FRAME), a / n
            out[i] = d, r, r * r, d * min(1.0, n / 300), min(0.15, r), d * r, n**-0.5
        return out

    def scores(self, texts: list[str | None], compressors=None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = (self.features(texts, compressors) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge logistic regression with row weights."""
    a = np.c_[np.ones(len(x)), x]
    w, keep = np.zeros(a.shape[1]), np.r_[0.0, np.full(x.shape[1], ridge)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + np.diag(keep + 1e-9), a.T @ (share * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(texts: list[str]) -> bytes:
    import zstandard

    pieces = [data[i : i + PIECE] for data in map(utf8, texts) for i in range(0, len(data), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its end serves as the dictionary
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def fit_rows(rows: list[tuple[str | None, int]], share: dict[int, int]) -> Model:
    """A model from (text, label) rows; ``share``: labelled rows by label, which the calibration is weighted to."""
    good, bad = [t or "" for t, q in rows if q == 1], [t or "" for t, q in rows if q == 0]
    total = share.get(0, 0) + share.get(1, 0)
    if len(good) < 2 or len(bad) < 2:
        return Model(b"", b"", *(np.zeros(0),) * 3, constant=share.get(1, 0) / total if total else 1.0)
    model = Model(_dictionary(good[::2]), _dictionary(bad[::2]), *(np.zeros(0),) * 3)
    held = good[1::2] + bad[1::2]
    y = np.r_[np.ones(len(good[1::2])), np.zeros(len(bad[1::2]))]
    x = model.features(held)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, share[1] / len(good[1::2]), share[0] / len(bad[1::2]))
    model.weights = _logistic((x - model.mean) / model.scale, y, weight * len(y) / weight.sum())
    return model


def fit(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2) -> Model:
    """A model from the labelled rows whose crc32(doc_id) mod ``fold`` is not ``held``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_of_id("doc_id") % fold != held))
    known = known.withColumn("order", unit_hash("doc_id", seed="quality"))
    share = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    sample = known.where("quality = 0").orderBy("order", "doc_id").limit(PER_LABEL).unionByName(known.where("quality = 1").orderBy("order", "doc_id").limit(PER_LABEL))
    picked = sample.toArrow().to_pylist()  # at most 2 * PER_LABEL ids
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(r["doc_id"],) for r in {r["doc_id"]: r for r in picked}.values()], "doc_id long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(few, "doc_id", "left_semi")
    sizes = {r["doc_id"]: r["n"] for r in texts.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).collect()}
    chosen, room = [], {0: TRAIN_BYTES // 2, 1: TRAIN_BYTES // 2}
    for r in picked:
        n = sizes.get(r["doc_id"])
        if n is not None and n <= room[r["quality"]]:
            room[r["quality"]] -= n
            chosen.append(r)
    if not chosen:
        return fit_rows([], share)
    wanted = F.broadcast(spark.createDataFrame([(r["doc_id"],) for r in {r["doc_id"]: r for r in chosen}.values()], "doc_id long"))
    found: dict[int, list] = {}
    for r in texts.join(wanted, "doc_id", "left_semi").toArrow().to_pylist():
        found.setdefault(r["doc_id"], []).append(r["text"])
    return fit_rows([(t, r["quality"]) for r in chosen for t in sorted(found.get(r["doc_id"], []), key=lambda t: t or "")], share)


def scored(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with one more column: the score of the text. It replaces a column of that name."""
    docs = docs.drop(score_column)
    said = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = said.value
        tools = model.compressors() if model.constant is None else None
        for big in batches:
            for batch in split_batch(big):
                at = batch.schema.get_field_index(text_column)
                yield batch.append_column(score_column, pa.array(model.scores(batch.column(at).to_pylist(), tools), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_column, T.DoubleType())]))
