"""The engine's three flows as one lazy plan each: retrieve, ingest, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators.documents import changes, line_windows
from ..operators.retrieval import FLOOR, expanded, hybrid, reranked
from ..operators.scoring import probe_score, rank_match
from ..registry import query


def retrieve(vectors: DataFrame, texts: DataFrame, questions: DataFrame, k: int = 8) -> DataFrame:
    """Question to grounded passages: expand, rank both ways, fuse, take each passage's best, weed by cosine, rerank.

    ``questions`` has (qid, q_embedding, q_text); its variants run side by side as rows, not as round trips."""
    variants = questions.select("qid", "q_embedding", F.posexplode(expanded(F.col("q_text"))).alias("v", "q_text")).withColumn("qid", F.col("qid") * 4 + F.col("v"))
    found = hybrid(vectors, texts, variants.select("qid", "q_embedding", "q_text"), k)
    best = found.withColumn("qid", F.floor(F.col("qid") / 4)).groupBy("qid", "id").agg(F.max("rrf").alias("rrf"), F.max("cosine").alias("cosine"))
    held = best.where(F.col("cosine").isNull() | (F.col("cosine") >= FLOOR))
    return reranked(held.join(questions.select("qid", "q_text"), "qid").join(texts, "id"), k)


def ingest(files: DataFrame, store: DataFrame) -> DataFrame:
    """Files (path, text) to chunks (path, chunk_index, chunk, digest, file_class, doc_type, status) against the store (chunk_key, digest)."""
    chunks = line_windows(files).withColumn("digest", F.sha2("chunk", 256)).withColumn("chunk_key", F.concat_ws("#", "path", "chunk_index"))
    chunks = chunks.withColumn("file_class", X.file_class(F.col("path"))).withColumn("doc_type", X.doc_type(F.col("path"), F.col("chunk")))
    return chunks.drop("text").join(changes(chunks.select("chunk_key", "digest"), store, "chunk_key"), "chunk_key")


def evaluate(results: DataFrame, golden: DataFrame, k: int = 3) -> DataFrame:
    """Recall, reciprocal rank and score of results (qid, id, rank) against golden (qid, id), one row in all."""
    return probe_score(rank_match(results, golden).withColumn("all", F.lit(1)), ["all"], k).drop("all")


@query("F1_retrieve_flow")
def _(t):
    from ..operators.retrieval import corpora, probes

    return retrieve(*corpora(t), probes(t)).select("qid", "id", "rerank", "rank")


@query("F2_ingest_flow")
def _(t):
    files = t.documents.selectExpr("concat(source, '/', doc_id, '.md') path", "text")
    old = files.where("length(path) % 2 = 0").selectExpr("concat(path, '#0') chunk_key", "sha2(text, 256) digest")
    return ingest(files, old).select("path", "chunk_index", "digest", "file_class", "doc_type", "status")
