"""From raw documents to token ids: reject by quality, keep one of each near-duplicate group, mask personal data, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
docs; all but the last return the columns of documents. A stage works on every row that the one before it kept.

Defined results: an empty table passes every stage as one; further columns come through with their values, whatever their names, as a stage's
own columns take names that the table does not have (repeats by the mix repeat them too); a null text has the quality of an empty
one, is no near-duplicate, masks to null, has size 0 and encodes to no ids; rows without a doc_id are never near-duplicates, are mixed by their text, and
encode under a null doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairnflow.llm import bpe, mixing, neardup, pii, quality
from cairnflow.llm.common import drop_staged, load, staged

#: Documents of a lower score are rejected; clean ones lie well above it.
REJECT_BELOW = 0.5
#: Bytes of ids that are broadcast to drop documents; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name += "_"
    return name


def reject_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, fitted on labels of this corpus, is at least REJECT_BELOW."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    score = _free(docs, "quality_score_")
    return quality.scored(docs, model, score_column=score).where(F.col(score) >= REJECT_BELOW).drop(score)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each near-duplicate group (five words, similarity 0.8); of rows that share it, the
    first by text. Rows without a doc_id stay."""
    found = staged(neardup.near_duplicates(docs), "near-duplicates")
    dropped = staged(found.where("doc_id is not null and not kept").select("doc_id").distinct(), "dropped")
    repeated = staged(found.where("doc_id is not null and kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    drop_staged(found)
    kept = docs.join(_small(dropped), "doc_id", "left_anti")
    if repeated.limit(1).count():
        few = _small(repeated)
        rank = _free(docs, "rank_")
        first = kept.join(few, "doc_id", "left_semi").withColumn(rank, F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where(F.col(rank) == 1).drop(rank)
        kept = kept.join(few, "doc_id", "left_anti").unionByName(first)
    return kept.select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each confirmed span replaced by its kind; n_chars follows where the table has it."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, by a key written with the rows; a doc_id may be null or shared."""
    row, copies = _free(docs, "row_"), _free(docs, "copies_")
    copy = _free(docs, "copy_")
    keyed = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    mixed = mixing.mix(keyed.select(F.col(row).alias("row_key"), "doc_id", "text", "source"), key="row_key").select(F.col("row_key").alias(row), F.col("copies").cast("int").alias(copies))
    taken = keyed.join(mixed.where(F.col(copies) > 0), row)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded bytes."""
    return bpe.encode(docs)


STAGES = [
    ("quality", reject_by_quality),
    ("near duplicates", keep_one_of_each_group),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, all stages applied to the documents."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = staged(made, f"stage-{i}")
            drop_staged(docs)  # a stage's table; documents stay
        docs = made
    return docs
