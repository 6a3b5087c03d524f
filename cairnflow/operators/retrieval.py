"""Retrieval: vector and lexical rankings, fusion, weighting, neighbours, caches and context assembly.

A corpus has (id, embedding) and (id, text); queries are a table of their own (qid, embedding, text) of a stated, small
number of rows, so each corpus row is scored against all of them in one pass and only the best k per query move on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import escaped, tokens
from ..functions.vector import cosine
from ..registry import plain, query
from ..staging import staged
from . import fulltext as T, vector_index as VI

RRF_K = 60
FLOOR = 0.2
#: Rows of a query table that are broadcast; with more an operator stops, and the caller splits them.
MOST_QUERIES = 10_000


def few(table: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """A table of queries or names for broadcast, after its rows were counted up to the bound."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to hold at once: split them and run one part after the other")
    return F.broadcast(table)


def top(scored: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts to k before the shuffle (window group limit)."""
    w = W.partitionBy(*group).orderBy(*order) if group else W.orderBy(*order)
    if not group:
        scored = scored.orderBy(*order).limit(k)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def vector_rank(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """V2: qid, id, cosine, rank of the k nearest rows of ``corpus`` (id, embedding) for each of ``queries`` (qid, q_embedding)."""
    near = VI.nearest_rows(corpus.withColumn("factor", F.lit(1.0)), queries, k)
    return top(near.select("qid", "id", F.round("ratio", 6).alias("cosine")), ["qid"], [F.desc("cosine"), F.asc("id")], k)


def owner_rank(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Qid, id, cosine, rank of the k nearest other rows of ``corpus`` (id, owner, embedding) for each of ``queries`` (qid, owner, q_embedding) among those of its owner; null
    vectors come last."""
    near = VI.nearest_of_owner(corpus, queries, k)
    return top(near.select("qid", "id", F.round("ratio", 6).alias("cosine")), ["qid"], [F.desc("cosine"), F.asc("id")], k)


def lexical_rank(corpus: DataFrame, queries: DataFrame, k: int, any_: bool = False) -> DataFrame:
    """V3: rows of ``corpus`` (id, text) with all stems of the query (``any_``: one of them), by cover density.

    Words of the corpus are stemmed once each; only those whose stem is asked for are looked up in the texts. Queries of the same stems are one set; the task that reads a
    text scores it for all sets and sends on its ``k`` best of each. For many rounds of queries over one corpus, ``fulltext.index`` keeps the postings."""
    asked = queries.select(F.explode(tokens(F.col("q_text"))).alias("word"))
    terms = staged(T.query_terms(queries, T.forms(asked)), "query-terms")
    mine = staged(terms.groupBy("qid").agg(F.sort_array(F.collect_set("stem")).alias("stems")), "query-sets")
    words = staged(T.forms(T.vocabulary(corpus)).join(terms.select("stem").distinct(), "stem", "left_semi"), "word-forms")
    best = top(T.best(corpus, staged(mine.select("stems").distinct(), "stem-sets"), words, k, any_), ["stems"], [F.desc("lexical"), F.asc("id")], k)
    return mine.join(best, "stems").select("qid", "id", "lexical", "rank")


def fused(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """V4: reciprocal rank fusion of two rankings (qid, id, rank); a side that misses adds nothing."""
    a, b = left.withColumnRenamed("rank", "rank_a"), right.withColumnRenamed("rank", "rank_b")
    part = lambda r: F.coalesce(F.lit(1.0) / (RRF_K + F.col(r)), F.lit(0.0))
    both = a.join(b, ["qid", "id"], "full").withColumn("rrf", F.round(part("rank_a") + part("rank_b"), 9))
    return top(both, ["qid"], [F.desc("rrf"), F.asc("id")], k)


def hybrid(vectors: DataFrame, texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The two rankings over pools of min(4k, 50), fused; the reported cosine is the vector side's."""
    pool = min(4 * k, 50)
    return fused(vector_rank(vectors, queries, pool), lexical_rank(texts, queries, pool), k)


def neighbours(anchors: DataFrame, chunks: DataFrame, radius: int = 1, step: float = 0.001) -> DataFrame:
    """V8: chunks (file, position) within ``radius`` of scored anchors (file, position, score) that are no anchors themselves, at
    the score of the nearest anchor less ``step``."""
    near = anchors.select("file", "score", F.col("position").alias("anchor"), F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position"))
    near = near.groupBy("file", "position").agg(F.min_by("score", F.struct(F.abs(F.col("anchor") - F.col("position")), F.col("anchor"))).alias("score"))
    found = near.join(chunks.select("file", "position"), ["file", "position"]).join(anchors.select("file", "position"), ["file", "position"], "left_anti")
    return found.withColumn("score", F.round(F.col("score") - step, 6))


ROLE_WEIGHTS = {"en": 1.0, "de": 0.9, "fr": 0.85, "es": 0.8}


def role_weight(role: Column, weights: dict[str, float] = ROLE_WEIGHTS) -> Column:
    """V6: the multiplier of a role, 1 if it is not listed."""
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, role), F.lit(1.0))


def filtered_with_top_up(rows: DataFrame, hard: Column, soft: Column, order: list[Column], key: str, k: int) -> DataFrame:
    """Rows that pass both gates first; if they are fewer than k, rows that pass the hard one alone fill up, in pass order."""
    first = rows.where(hard & soft).orderBy(*order).limit(k).withColumn("pass", F.lit(1))
    more = rows.where(hard & ~F.coalesce(soft, F.lit(False))).orderBy(*order).limit(k).withColumn("pass", F.lit(2))
    return first.unionByName(more).withColumn("row_", F.row_number().over(W.orderBy("pass", *order))).where(F.col("row_") <= k).drop("row_")


def expanded(question: Column) -> Column:
    """The question and two deterministic variants: without question mark and opening phrase, and with a suffix."""
    bare = F.regexp_replace(F.regexp_replace(question, r"\?+$", ""), "(?i)^(?:what is|what are|how do i|how does|tell me about|the)\\s+", "")
    return F.array(question, bare, F.concat(bare, F.lit(" implementation details")))


#: The test tables' queries: every row whose id is divisible by this.
EVERY = 50


def probes(t) -> DataFrame:
    """Queries for the test tables: vectors and documents of the same ids, each EVERY-th, with the first short words of the document that are no stop
    words. Written once, as the two sides of a hybrid search both read it."""
    q = t.embeddings.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q_embedding"))
    b = t.documents.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("qid"), F.array_join(F.slice(F.filter(tokens(F.col("text")), lambda w: (F.length(w) <= 4) & ~w.isin(*T.STOP_WORDS)), 1, 3), " ").alias("q_text"))
    return staged(q.join(b, "qid"), "probes")


def corpora(t) -> tuple[DataFrame, DataFrame]:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), t.documents.select(F.col("doc_id").alias("id"), "text")


_VECTOR = "round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
_HYBRID = f"""
WITH vec AS (SELECT qid, id, cosine, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_VECTOR} AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_VECTOR} DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0 AND q.vec_id IN (SELECT doc_id FROM documents)) WHERE rank <= 40),
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents), forms AS MATERIALIZED ({T.stems_sql("words")}),
terms AS (SELECT DISTINCT qid, stem FROM (SELECT doc_id AS qid, unnest(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) <= 4 AND w NOT IN {tuple(T.STOP_WORDS)}), 1, 3)) AS word FROM documents WHERE doc_id % {EVERY} = 0 AND doc_id IN (SELECT vec_id FROM embeddings)) JOIN forms USING (word)),
wanted AS (SELECT qid, count(*) AS n_terms FROM terms GROUP BY qid),
placed AS (SELECT id, i AS pos, ts[i] AS word FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents), unnest(range(1, len(ts) + 1)) AS r(i)),
hits AS (SELECT qid, id, pos, stem, row_number() OVER (PARTITION BY qid, id ORDER BY pos) AS ord FROM placed JOIN forms USING (word) JOIN terms USING (stem) WHERE word NOT IN {tuple(T.STOP_WORDS)}),
full_ AS (SELECT qid, id FROM hits GROUP BY qid, id HAVING count(DISTINCT stem) = (SELECT n_terms FROM wanted w WHERE w.qid = hits.qid)),
lasts AS (SELECT h.qid, h.id, h.ord, h.pos, t.stem, max(CASE WHEN h.stem = t.stem THEN h.ord END) OVER (PARTITION BY h.qid, h.id, t.stem ORDER BY h.ord ROWS UNBOUNDED PRECEDING) AS last FROM hits h JOIN full_ f ON h.qid = f.qid AND h.id = f.id JOIN terms t ON t.qid = h.qid),
starts AS (SELECT qid, id, ord, any_value(pos) AS pos, min(last) AS first FROM lasts GROUP BY qid, id, ord HAVING count(last) = count(*)),
covers AS (SELECT s.*, h.pos AS first_pos FROM (SELECT *, lag(first) OVER (PARTITION BY qid, id ORDER BY ord) AS before FROM starts) s JOIN hits h ON h.qid = s.qid AND h.id = s.id AND h.ord = s.first WHERE before IS NULL OR first > before),
lex AS (SELECT qid, id, lexical, rank FROM (SELECT qid, id, lexical, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, id) AS rank FROM (SELECT qid, id, round(sum({T.WEIGHT}::DOUBLE / (1 + (pos - first_pos) - (ord - first)) ORDER BY ord), 6) AS lexical FROM covers GROUP BY qid, id)) WHERE rank <= 40),
fused AS (SELECT COALESCE(v.qid, l.qid) AS qid, COALESCE(v.id, l.id) AS id, v.cosine, l.lexical, v.rank AS rank_a, l.rank AS rank_b,
  round(COALESCE(1.0::DOUBLE / (60 + v.rank), 0) + COALESCE(1.0::DOUBLE / (60 + l.rank), 0), 9) AS rrf FROM vec v FULL JOIN lex l ON v.qid = l.qid AND v.id = l.id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, id) AS rank FROM fused) WHERE rank <= 10)
"""


@query("V1_cosine", f"SELECT e.vec_id, {_VECTOR} AS cosine FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id + 1")
def _(t):
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("q"))
    return t.embeddings.join(after, "vec_id").select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("cosine"))


@query("V2_vector_top_k", _HYBRID + "SELECT qid, id, cosine, rank FROM vec")
def _(t):
    return vector_rank(corpora(t)[0], probes(t), 40)


@query("T1_approximate_top_k")
def _(t):
    index = VI.build(corpora(t)[0])
    return VI.search(index, probes(t), 10, VI.probes_for(index, 10, 0.95))


@query("T1_every_list", _HYBRID + "SELECT qid, id, cosine, rank FROM vec WHERE rank <= 10")
def _(t):
    index = VI.build(corpora(t)[0])
    return VI.search(index, probes(t), 10, len(index.centroids.value))


@query("V3_lexical_rank", _HYBRID + "SELECT qid, id, lexical, rank FROM lex")
def _(t):
    return lexical_rank(corpora(t)[1], probes(t), 40)


@query(
    "V3_lexical_any",
    _HYBRID + ", some_ AS (SELECT qid, id, round(count(*) * 0.1::DOUBLE, 6) AS lexical FROM hits GROUP BY qid, id) SELECT qid, id, lexical, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, id) AS rank FROM some_) WHERE rank <= 40",
)
def _(t):
    return lexical_rank(corpora(t)[1], probes(t), 40, any_=True)


@query("V4_rrf_hybrid", _HYBRID + "SELECT qid, id, rrf, rank FROM best")
def _(t):
    return hybrid(*corpora(t), probes(t), 10).select("qid", "id", "rrf", "rank")


@query("V5_two_scores", _HYBRID + "SELECT qid, id, rank_a, rank_b, cosine, rrf FROM best")
def _(t):
    return hybrid(*corpora(t), probes(t), 10).select("qid", "id", "rank_a", "rank_b", "cosine", "rrf")


@query("V6_role_weight", "SELECT doc_id, n_chars * CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'de' THEN 0.9::DOUBLE WHEN 'fr' THEN 0.85::DOUBLE WHEN 'es' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS weighted FROM documents")
def _(t):
    return t.documents.select("doc_id", (F.col("n_chars") * role_weight(F.col("lang"))).alias("weighted"))


def profile_scores(profiles: DataFrame, queries: DataFrame, signals: Column, weight: float = 1.5, step: float = 0.1, k: int = 40) -> DataFrame:
    """V7: (qid, id, score, rank) of the ``k`` best profiles (id, embedding, and what ``signals`` counts) for each query: the cosine times the layer's weight and 1 +
    ``step`` for each signal."""
    near = VI.nearest_rows(profiles.withColumn("factor", 1 + step * signals), queries, k, weight)
    score = F.round(F.round("ratio", 6) * weight * F.col("factor"), 9)
    return top(near.select("qid", "id", score.alias("score")), ["qid"], [F.desc("score"), F.asc("id")], k)


_PROFILE = f"""p AS (SELECT q.vec_id AS qid, e.vec_id AS id, round({_VECTOR} * 1.5 * (1 + 0.1 * ((e.label % 2) + CASE WHEN e.vec_id % 3 = 0 THEN 1 ELSE 0 END)), 9) AS score FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0 AND q.vec_id IN (SELECT doc_id FROM documents) AND e.label < 5),
profile AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 40)"""


def profile_layer(t, asked: DataFrame) -> DataFrame:
    rows = t.embeddings.where("label < 5").select(F.col("vec_id").alias("id"), "embedding", "label")
    return profile_scores(rows, asked, (F.col("label") % 2) + F.when(F.col("id") % 3 == 0, 1).otherwise(0))


@query("V7_profile_layer", f"WITH {_PROFILE} SELECT qid, id, score, rank FROM profile")
def _(t):
    return profile_layer(t, probes(t))


@query(
    "V8_neighbours",
    """WITH a AS (SELECT conv_id AS file, turn AS position, round(length(text) / 1000.0::DOUBLE, 6) AS score FROM conversations WHERE turn % 3 = 1),
    n AS (SELECT c.conv_id AS file, c.turn AS position, a.score, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY abs(a.position - c.turn), a.position) AS rn FROM conversations c JOIN a ON c.conv_id = a.file AND c.turn BETWEEN a.position - 1 AND a.position + 1 WHERE c.turn % 3 <> 1)
    SELECT file, position, round(score - 0.001::DOUBLE, 6) AS score FROM n WHERE rn = 1""",
)
def _(t):
    chunks = t.conversations.select(F.col("conv_id").alias("file"), F.col("turn").alias("position"), F.round(F.length("text") / 1000.0, 6).alias("score"))
    return neighbours(chunks.where("position % 3 = 1"), chunks)


def merged_layers(layers: dict[str, DataFrame], k: int) -> DataFrame:
    """V9: (qid, layer, id, score, rank): the ``k`` best of all layers (qid, id, score) for each query; of equal scores the layer named first."""
    parts = [f.select("qid", F.lit(name).alias("layer"), F.lit(i).alias("place_"), "id", "score") for i, (name, f) in enumerate(layers.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top(both, ["qid"], [F.desc("score"), F.asc("place_"), F.asc("id")], k).drop("place_")


@query("V9_layer_merge", _HYBRID + f", {_PROFILE}, both_ AS (SELECT qid, 'chunk' AS layer, 0 AS place, id, cosine AS score FROM vec UNION ALL SELECT qid, 'profile', 1, id, score FROM profile) SELECT qid, layer, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place, id) AS rank FROM both_) WHERE rank <= 20")
def _(t):
    asked = probes(t)
    chunk = vector_rank(corpora(t)[0], asked, 40).select("qid", "id", F.col("cosine").alias("score"))
    return merged_layers({"chunk": chunk, "profile": profile_layer(t, asked)}, 20)


@query("V10_multi_query", _HYBRID + "SELECT id, score FROM (SELECT id, max(rrf) AS score FROM best GROUP BY id) ORDER BY score DESC, id LIMIT 8")
def _(t):
    best = hybrid(*corpora(t), probes(t), 10)
    return best.groupBy("id").agg(F.max("rrf").alias("score")).orderBy(F.desc("score"), "id").limit(8)


@query(
    "V11_query_expansion",
    "WITH b AS (SELECT item_id, text, regexp_replace(regexp_replace(text, '\\?+$', ''), '(?i)^(?:what is|what are|how do i|how does|tell me about|the)\\s+', '') AS bare FROM benchmark) SELECT item_id, text AS q1, bare AS q2, bare || ' implementation details' AS q3 FROM b",
)
def _(t):
    e = t.benchmark.select("item_id", expanded(F.col("text")).alias("q"))
    return e.select("item_id", *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])


@query(
    "V12_filter_with_top_up",
    """WITH r AS (SELECT doc_id, n_chars, lang, source FROM documents WHERE lang = 'de'), p AS (SELECT doc_id, n_chars, 1 AS pass FROM r WHERE source = 'src0' UNION ALL SELECT doc_id, n_chars, 2 FROM r WHERE source <> 'src0')
    SELECT doc_id, pass FROM p ORDER BY pass, n_chars DESC, doc_id LIMIT 25""",
)
def _(t):
    return filtered_with_top_up(t.documents, F.col("lang") == "de", F.col("source") == "src0", [F.desc("n_chars"), F.asc("doc_id")], "doc_id", 25).select("doc_id", "pass")


@query("V14_cosine_floor", _HYBRID + "SELECT qid, id, cosine FROM vec WHERE cosine >= 0.2")
def _(t):
    return vector_rank(corpora(t)[0], probes(t), 40).where(F.col("cosine") >= FLOOR).select("qid", "id", "cosine")


def reranked(candidates: DataFrame, k: int, question: str = "q_text", text: str = "text", score: Column | None = None) -> DataFrame:
    """The k best of each query by ``score`` (by default the share of the question's tokens in the first 4,000 characters), then by cosine."""
    q, d = F.array_distinct(tokens(F.col(question))), tokens(F.substring(text, 1, 4000))
    share = F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1))
    return top(candidates.withColumn("rerank", F.round(share if score is None else score, 6)), ["qid"], [F.desc("rerank"), F.desc_nulls_last("cosine"), F.asc("id")], k)


@query(
    "V15_rerank",
    _HYBRID
    + """, q AS (SELECT doc_id AS qid, list_distinct(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) <= 4 AND w NOT IN """ + str(tuple(T.STOP_WORDS)) + """), 1, 3)) AS w FROM documents WHERE doc_id % 50 = 0),
    s AS (SELECT b.qid, b.id, b.cosine, round(len(list_intersect(q.w, regexp_extract_all(lower(substr(d.text, 1, 4000)), '[a-z0-9]+'))) / greatest(len(q.w), 1), 6) AS rerank FROM best b JOIN q USING (qid) JOIN documents d ON d.doc_id = b.id)
    SELECT qid, id, rerank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, cosine DESC NULLS LAST, id) AS rn FROM s) WHERE rn <= 4""",
)
def _(t):
    p = probes(t)
    best = hybrid(*corpora(t), p, 10).select("qid", "id", "cosine").join(p.select("qid", "q_text"), "qid").join(corpora(t)[1], "id")
    return reranked(best, 4).select("qid", "id", "rerank")


def cache_lookup(cache: DataFrame, asked: DataFrame, now: Column, least: float = 0.95, days: int = 7) -> DataFrame:
    """For each of ``asked`` (qid, scope, q_embedding) the most similar live entry of ``cache`` (id, scope, created, embedding), a hit at ``least``."""
    live = cache.where(F.col("created") > now - F.expr(f"INTERVAL {days} DAYS"))
    scored = live.join(asked, "scope").select("qid", "id", cosine(F.col("embedding"), F.col("q_embedding")).alias("similarity"))
    return top(scored, ["qid"], [F.desc("similarity"), F.asc("id")], 1).select("qid", "id", "similarity", (F.col("similarity") >= least).alias("hit"))


_WARM = "list_transform(list_zip(f.embedding, e.embedding), lambda z: CASE WHEN e.vec_id % 4 = 0 THEN 4 ELSE 1 END * z[1]::DOUBLE + z[2]::DOUBLE)"


@query(
    "V16_semantic_cache",
    f"""WITH c AS (SELECT e.vec_id, e.label, {_WARM} AS embedding FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id - e.vec_id % {EVERY}),
    s AS (SELECT q.vec_id AS qid, e.vec_id AS id, {_VECTOR} AS similarity FROM c e JOIN embeddings q ON e.vec_id // {EVERY} = q.vec_id // {EVERY} WHERE q.vec_id % {EVERY} = 0 AND e.vec_id <> q.vec_id AND q.vec_id % 100 + e.vec_id % 4 > 0
      AND TIMESTAMP '2024-01-01 00:00:00' + (e.vec_id % 30) * INTERVAL 1 DAY > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY)
    SELECT qid, id, similarity, similarity >= 0.95 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rn FROM s) WHERE rn = 1""",
)
def _(t):
    """Cached questions that lie near an asked one, some nearer than others; every other asked one has only the latter in its scope."""
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(vec_id % 30 as int))")
    scope = F.floor(F.col("vec_id") / EVERY)
    first = t.embeddings.where(f"vec_id % {EVERY} = 0").select(scope.alias("scope"), F.col("vec_id").alias("qid"), F.col("embedding").alias("q_embedding"))
    near = F.zip_with("q_embedding", "embedding", lambda a, b: F.when(F.col("vec_id") % 4 == 0, 4).otherwise(1) * a.cast("double") + b.cast("double"))
    warm = t.embeddings.withColumn("scope", scope).join(first, "scope").where("vec_id <> qid and qid % 100 + vec_id % 4 > 0")
    cache = warm.select(F.col("vec_id").alias("id"), "scope", created.alias("created"), near.alias("embedding"))
    return cache_lookup(cache, first, F.expr("timestamp_ntz'2024-01-30 00:00:00'"))


@query("V17_exact_cache_key", "SELECT item_id, concat_ws(':', 'chat', 'public', 'kb7', sha256(lower(trim(text)))) AS cache_key FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.concat_ws(":", F.lit("chat"), F.lit("public"), F.lit("kb7"), F.sha2(F.lower(F.trim("text")), 256)).alias("cache_key"))


def nearest(rows: DataFrame, canon: DataFrame, least: float) -> DataFrame:
    """For each row (id, embedding) the most similar of a smaller table (name, c_embedding), null below ``least``."""
    entries = canon.select(F.col("name").alias("id"), F.col("c_embedding").alias("embedding"), F.lit(1.0).alias("factor"))
    near = VI.nearest_rows(entries, rows.select(F.col("id").alias("qid"), F.col("embedding").alias("q_embedding")), 1, stream_asked=True)
    scored = near.select(F.col("qid").alias("id"), F.col("id").alias("name"), F.round("ratio", 6).alias("similarity"))
    best = scored.groupBy("id").agg(F.max_by(F.struct("similarity", "name"), F.struct(F.col("similarity"), -F.col("name"))).alias("b"))
    return best.select("id", F.when(F.col("b.similarity") >= least, F.col("b.name")).alias("name"), F.col("b.similarity").alias("similarity"))


@query("V18_nearest_canonical", f"WITH s AS (SELECT e.vec_id AS id, q.vec_id AS name, {_VECTOR} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) SELECT id, CASE WHEN similarity >= 0.2 THEN name END AS name, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, name) AS rn FROM s) WHERE rn = 1")
def _(t):
    canon = t.embeddings.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("name"), F.col("embedding").alias("c_embedding"))
    return nearest(corpora(t)[0], canon, 0.2)


#: Vectors in one block of an all-pairs comparison, of which a task multiplies a strip at a time, and block pairs in one task.
PAIR_BLOCK, STRIP, PAIRS_A_TASK = 4096, 512, 4
#: How far a matrix product may be off before the cosine summed in the order of ``cosine`` decides.
MARGIN = 1e-5


def _close_blocks(least: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def summed(x, y):
            total = np.zeros(len(x))
            for k in range(x.shape[1]):
                total += x[:, k] * y[:, k]
            return total

        def read(vectors, size):
            m = vectors.values.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size)
            n = np.sqrt(summed(m, m))
            return m, n, m / np.where(n == 0, 1.0, n)[:, None]

        for batch in batches:
            for r in range(batch.num_rows):
                size, same = batch["size"][r].as_py(), batch["same"][r].as_py()
                a, b = (batch[k][r].values.to_numpy() for k in ("a_ids", "b_ids"))
                (m, m_norm, m_unit), (v, v_norm, v_unit) = (read(batch[k][r], size) for k in ("a_vectors", "b_vectors"))
                for at in range(0, len(a), STRIP):
                    x, y = np.nonzero(~(m_unit[at : at + STRIP] @ v_unit.T < least - MARGIN))
                    x += at
                    keep = (a[x] < b[y]) if same else (a[x] != b[y])
                    x, y = x[keep], y[keep]
                    ratio = summed(m[x], v[y]) / (m_norm[x] * v_norm[y])
                    yield pa.record_batch({"i": np.minimum(a[x], b[y]), "j": np.maximum(a[x], b[y]), "ratio": ratio})

    return run


def pairs_at_least(rows: DataFrame, least: float, by: str | None = None) -> DataFrame:
    """i < j, similarity of every pair of (id: long, embedding), ids being unique, whose cosine is at least ``least`` (above 0); only rows of equal
    ``by`` are compared where that is given. For low thresholds, at which most rows are near to many; ``vector_index.similarity_join`` prunes.

    Blocks of vectors are compared by matrix products; the cosine in its own order of sums decides on the pairs these propose."""
    if least <= MARGIN:
        raise ValueError("least must be above 0")
    rows = rows.where("id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)").select(F.col("id").cast("long").alias("id"), "embedding", (F.lit(0) if by is None else F.col(by)).alias("by"))
    number = max(1, -(-rows.count() // PAIR_BLOCK))
    held = rows.groupBy("by", F.size("embedding").alias("size"), F.pmod(F.xxhash64("id"), F.lit(number)).alias("block")).agg(F.collect_list(F.struct("id", "embedding")).alias("r"))
    held = staged(held.select("by", "size", "block", F.transform("r", lambda v: v["id"]).alias("ids"), F.flatten(F.transform("r", lambda v: v["embedding"])).alias("vectors")), "pair-blocks")
    named = lambda k: held.select("by", "size", F.col("block").alias(k), F.col("ids").alias(f"{k}_ids"), F.col("vectors").alias(f"{k}_vectors"))
    keys = held.select("by", "size", F.col("block").alias("a")).join(held.select("by", "size", F.col("block").alias("b")), ["by", "size"]).where("a <= b")
    tasks = max(1, number * (number + 1) // 2 // PAIRS_A_TASK)
    both = keys.join(named("a"), ["by", "size", "a"]).join(named("b"), ["by", "size", "b"]).withColumn("same", F.col("a") == F.col("b")).repartition(tasks, "a", "b")
    near = both.select("size", "same", "a_ids", "a_vectors", "b_ids", "b_vectors").mapInArrow(_close_blocks(least), "i long, j long, ratio double")
    return near.select("i", "j", F.round("ratio", 6).alias("similarity")).where(F.col("similarity") >= least)


@query("J9_cosine_pairs", f"SELECT q.vec_id AS i, e.vec_id AS j, {_VECTOR} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id < e.vec_id AND {_VECTOR} >= 0.2 ORDER BY similarity DESC, i, j LIMIT 32")
def _(t):
    return VI.most_similar(corpora(t)[0], 0.2, 32)


def holding_all(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """(key, id) of the documents (id, text) that hold all terms of a row (key, terms: distinct tokens). A row's terms are few and met in the task that reads the
    text, each of them once."""
    each = few(wanted.select("key", F.size("terms").alias("n"), F.explode("terms").alias("term")), 1_000_000)
    words = corpus.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return words.join(each, "term").groupBy("key", "id").agg(F.count("*").alias("m"), F.first("n").alias("n")).where("m = n").select("key", "id")


def gap_causes(gaps: DataFrame, corpus: DataFrame) -> DataFrame:
    """(key, cause) for each gap (key, terms): whether the corpus (id, text; without its noise) holds all its terms in one document, so that retrieval missed it."""
    present = holding_all(gaps, corpus).select("key").distinct().withColumn("present_", F.lit(True))
    return gaps.join(present, "key", "left").select("key", F.when(F.col("present_"), "kb_present_not_retrieved").otherwise("kb_no_evidence").alias("cause"))


def corrected(gaps: DataFrame, corpus: DataFrame, most_gaps: int = 5, most_passages: int = 5, promotes: int = 2) -> DataFrame:
    """(key, passages, promoted) of the ``most_gaps`` gravest gaps (key, terms, severity): each is asked again, at most ``most_passages`` passages by id count, and
    ``promotes`` of them promote it."""
    first = staged(gaps.orderBy(F.desc("severity"), "key").limit(most_gaps), "gravest-gaps")
    found = top(holding_all(first, corpus), ["key"], [F.asc("id")], most_passages).groupBy("key").agg(F.count("*").alias("c"))
    c = F.coalesce("c", F.lit(0))
    return first.join(found, "key", "left").select("key", c.alias("passages"), (c >= promotes).alias("promoted"))


@query(
    "V20_gap_cause",
    "WITH d AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE COALESCE(lang, '') <> 'es') SELECT item_id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE list_has_all(d.w, list_slice(regexp_extract_all(lower(b.text), '[a-z0-9]+'), 1, 3))) THEN 'kb_present_not_retrieved' ELSE 'kb_no_evidence' END AS cause FROM benchmark b",
)
def _(t):
    gaps = t.benchmark.select(F.col("item_id").alias("key"), F.array_distinct(F.slice(tokens(F.col("text")), 1, 3)).alias("terms"))
    corpus = t.documents.where(F.coalesce("lang", F.lit("")) != "es").select(F.col("doc_id").alias("id"), "text")
    return gap_causes(gaps, corpus).withColumnRenamed("key", "item_id")


@query(
    "V21_corrective_retrieval",
    """WITH g AS (SELECT item_id, list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 2) AS w, length(text) AS severity FROM benchmark ORDER BY severity DESC, item_id LIMIT 5),
    d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), m AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rn FROM g JOIN d ON list_has_all(d.w, g.w))
    SELECT g.item_id, count(m.doc_id) AS passages, count(m.doc_id) >= 2 AS promoted FROM g LEFT JOIN m ON g.item_id = m.item_id AND rn <= 5 GROUP BY g.item_id""",
)
def _(t):
    gaps = t.benchmark.select(F.col("item_id").alias("key"), F.array_distinct(F.slice(tokens(F.col("text")), 1, 2)).alias("terms"), F.length("text").alias("severity"))
    return corrected(gaps, corpora(t)[1]).withColumnRenamed("key", "item_id")


def assembled(passages: DataFrame, k: int = 3, budget: int = 6000, marker: str = " [truncated]") -> DataFrame:
    """(qid, rank, id, score, passage): the ``k`` best passages (qid, id, score, text) of each query, as long as there is room for ``budget`` characters in all: one
    that does not fit ends with a marker where the room ends, later ones fall out. Scores have two digits, texts are escaped for XML."""
    best = top(passages, ["qid"], [F.desc("score"), F.asc("id")], k)
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = best.withColumn("room_", (F.lit(budget) - before).cast("int")).where("room_ > 0")
    body = F.when(F.length("text") > F.col("room_"), F.concat(F.left("text", F.col("room_")), F.lit(marker))).otherwise(F.col("text"))
    return cut.select("qid", "rank", "id", F.format_string("%.2f", F.col("score").cast("double")).alias("score"), escaped(body).alias("passage"))


@query(
    "V22_context_assembly",
    """WITH p AS (SELECT source, doc_id, (doc_id % 89) / 4.0::DOUBLE AS score, text, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 89) DESC, doc_id) AS rank FROM documents WHERE source IS NOT NULL),
    r AS (SELECT *, 6000 - COALESCE(sum(length(text)) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p WHERE rank <= 3),
    c AS (SELECT *, CASE WHEN length(text) > room THEN substr(text, 1, CAST(room AS BIGINT)) || ' [truncated]' ELSE text END AS body FROM r WHERE room > 0)
    SELECT source AS qid, CAST(rank AS INTEGER) AS rank, doc_id AS id, printf('%.2f', score) AS score, replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'\'', '&apos;') AS passage FROM c""".replace("'\'\''", "chr(39)"),
)
def _(t):
    return assembled(t.documents.where("source is not null").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), (F.col("doc_id") % 89 / F.lit(4.0)).alias("score"), "text"))


def header_stats(passages: DataFrame, text: str, first: int = 5) -> DataFrame:
    """For each repository that headers ``[Source: repo/path, Cosine: c, Rerank: r]`` in a column name: passages, the highest, lowest and median cosine, how many were
    reranked, and its ``first`` best sources by cosine. Texts without a header fall out."""
    header = r"\[Source: ([^/\],]+)/([^\],]+), Cosine: ([0-9.]+)(?:, Rerank: ([0-9.]+))?\]"
    part = lambda i: F.regexp_extract(F.col(text), header, i)
    rows = passages.where(F.col(text).rlike(header)).select(part(1).alias("repo"), part(2).alias("path"), part(3).cast("double").alias("cosine"), (part(4) != "").alias("reranked"))
    stats = rows.groupBy("repo").agg(F.count("*").alias("n"), F.max("cosine").alias("most"), F.min("cosine").alias("least"), F.median("cosine").alias("mid"), F.count_if("reranked").alias("reranked"))
    best = top(rows, ["repo"], [F.desc("cosine"), F.asc("path")], first).groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), ",").alias("best"))
    return stats.join(best, "repo")


@query(
    "V23_header_stats",
    """WITH p AS (SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, (doc_id % 97) / 100.0::DOUBLE AS cosine, doc_id % 3 = 0 AS reranked FROM documents WHERE source IS NOT NULL AND doc_id % 5 <> 0),
    b AS (SELECT repo, string_agg(path, ',' ORDER BY rank) AS best FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY cosine DESC, path) AS rank FROM p) WHERE rank <= 5 GROUP BY repo)
    SELECT repo, count(*) AS n, max(cosine) AS most, min(cosine) AS least, median(cosine) AS mid, count(*) FILTER (WHERE reranked) AS reranked, any_value(best) AS best FROM p JOIN b USING (repo) GROUP BY repo""",
)
def _(t):
    rerank = F.when(F.col("doc_id") % 3 == 0, ", Rerank: 0.5").otherwise("")
    head = F.concat(F.lit("[Source: "), "source", F.lit("/"), "doc_id", F.lit(", Cosine: "), F.format_string("%.2f", F.col("doc_id") % 97 / F.lit(100.0)), rerank, F.lit("] "))
    said = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(head, F.substring("text", 1, 40)))
    return header_stats(t.documents.select(said.alias("said")), "said")


@query("V24_zero_result_event", "SELECT conv_id, turn, substr(sha256(text), 1, 16) AS prompt_hash FROM conversations WHERE role = 'user'")
def _(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.substring(F.sha2("text", 256), 1, 16).alias("prompt_hash"))


@query("V25_experience_top_k", f"SELECT qid, id, rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_VECTOR} DESC, e.vec_id) AS rank FROM embeddings e JOIN embeddings q ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0) WHERE rank <= 2")
def _(t):
    """The entries of a user (a label) that are nearest to each of its queries."""
    mine = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("owner"), "embedding")
    asked = mine.where(f"id % {EVERY} = 0").select(F.col("id").alias("qid"), "owner", F.col("embedding").alias("q_embedding"))
    return owner_rank(mine, asked, 2).select("qid", "id", "rank")
