"""Evidence operators: fuzzy coverage, grounding checks, corrective retrieval, echo and fidelity lint, per-line detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import stem, tokens
from ..registry import plain, query
from ..staging import drop_staged, staged
from . import chains as C, procedural as P
from .documents import line_windows

# -- joins and retrieval ----------------------------------------------------------


def first_cover(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """For each ``wanted`` (w, w_tokens) the first of ``held`` (h, h_tokens) whose tokens contain its tokens or lie within them.

    Rows of equal tokens are one set, a held one under its first row. Of two sets one of which lies within the other, the larger holds the rarest token of the smaller, so
    sets meet by that one token; sets without tokens cover nothing."""
    key = lambda c: F.array_sort(F.array_distinct(c)).alias("ts")
    a = staged(wanted.select("w", key("w_tokens")), "wanted-tokens")
    sets = staged(a.select("ts").distinct(), "wanted-sets")
    held_sets = staged(held.select("h", key("h_tokens")).groupBy("ts").agg(F.min("h").alias("h")), "held-sets")
    each, held_each = sets.select("ts", F.explode("ts").alias("t")), held_sets.select("ts", "h", F.explode("ts").alias("t"))
    often = staged(each.select("t").unionAll(held_each.select("t")).groupBy("t").agg(F.count("*").alias("n")), "token-counts")
    rarest = lambda rows: rows.join(often, "t").groupBy("ts").agg(F.min_by("t", F.struct("n", "t")).alias("t"))
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    up = rarest(each).withColumnRenamed("ts", "w_ts").join(held_each, "t").where(within("w_ts", "ts")).select(F.col("w_ts").alias("ts"), "h")
    down = rarest(held_each).withColumnRenamed("ts", "h_ts").join(each, "t").where(within("h_ts", "ts")).join(held_sets.withColumnRenamed("ts", "h_ts"), "h_ts").select("ts", "h")
    best = up.unionAll(down).groupBy("ts").agg(F.min("h").alias("h"))
    return a.join(best, "ts").groupBy("w").agg(F.min("h").alias("h"))


@query(
    "J15_fuzzy_cover",
    "WITH n AS (SELECT p_partkey AS k, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS ts FROM part WHERE p_size <= 3), m AS (SELECT p_partkey AS k, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS ts FROM part WHERE p_size >= 48) SELECT n.k AS w, min(m.k) AS h FROM n JOIN m ON list_has_all(m.ts, n.ts) OR list_has_all(n.ts, m.ts) GROUP BY n.k",
)
def _(t):
    n = t.part.where("p_size <= 3").select(F.col("p_partkey").alias("w"), F.array_distinct(tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("w_tokens"))
    m = t.part.where("p_size >= 48").select(F.col("p_partkey").alias("h"), F.array_distinct(tokens(F.col("p_name"))).alias("h_tokens"))
    return first_cover(n, m)


def prefilter_terms(skills: DataFrame, aliases: DataFrame, groups: DataFrame) -> DataFrame:
    """The terms to filter by: skills (term) under their canonical names (aliases: term, canonical) and the other members of their groups (kind, term)."""
    named = skills.join(aliases, "term", "left").select(F.coalesce("canonical", "term").alias("term")).distinct()
    kinds = named.join(groups, "term").select("kind").distinct()
    return named.union(groups.join(kinds, "kind").select("term")).distinct()


@query("V13_prefilter", "WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_type = 'PROMO'), s AS (SELECT DISTINCT CASE WHEN p_name IN (SELECT p_name FROM a) THEN 'promoted' ELSE p_name END AS term FROM part WHERE p_size = 50), g AS (SELECT p_name AS term, p_brand AS kind FROM part WHERE p_size > 40) SELECT term FROM s UNION SELECT g.term FROM g WHERE g.kind IN (SELECT kind FROM g JOIN s USING (term))")
def _(t):
    p = t.part.select(F.col("p_name").alias("term"), F.col("p_brand").alias("kind"), "p_size", "p_type")
    aliases = p.where("p_type = 'PROMO'").groupBy("term").agg(F.lit("promoted").alias("canonical"))
    return prefilter_terms(p.where("p_size = 50").select("term"), aliases, p.where("p_size > 40").select("term", "kind"))


def merged_pairs(pairs: DataFrame, curated: DataFrame, auto: float, floor: float) -> DataFrame:
    """(i, j, kept, other, verdict) of similar pairs (i, j, similarity), i < j, as if they were taken in order of i, then j: a pair takes part if neither
    was merged away before; at ``auto`` or more it merges, from ``floor`` on it is for review. Of a pair the curated one (``curated``: id) is kept,
    else the first. A first one that is merged into a curated one goes on to its next pairs, as it has begun.

    So only a j that is not kept is out of later pairs, and j falls to the first i that stands and is sure of it. Rounds decide all ids at once: one
    without an undecided predecessor stands, and what it is sure of falls. A round is two joins on the pairs left; there are as many as the
    longest chain of decisions that hang on each other, few where ids are in no order of likeness."""
    sure = lambda frame: frame.where("sure and not (j_cur and not i_cur)")
    mark = lambda k: curated.select(F.col(curated.columns[0]).alias(k), F.lit(True).alias(f"{k}_cur")).distinct()
    pairs = pairs.where(F.col("similarity") >= floor).select("i", "j", (F.col("similarity") >= auto).alias("sure"))
    pairs = pairs.join(mark("i"), "i", "left").join(mark("j"), "j", "left").na.fill(False, ["i_cur", "j_cur"])
    pairs = staged(pairs, "similar-pairs")
    kills = staged(sure(pairs).select("i", "j"), "sure-pairs")
    left, fallen = kills, []
    while left.limit(1).count():
        stands = staged(left.select("i").distinct().join(left.select(F.col("j").alias("i")).distinct(), "i", "left_anti"), "standing")
        falls = staged(left.join(stands, "i", "left_semi").select("j").distinct(), "falling")
        fallen.append(falls)
        new = staged(left.join(stands.union(falls), "i", "left_anti").join(falls, "j", "left_anti").select("i", "j"), "sure-pairs")
        drop_staged(stands, *([left] if left is not kills else []))
        left = new
    by = kills
    for falls in fallen:  # an id that never fell stands
        by = by.join(falls.withColumnRenamed("j", "i"), "i", "left_anti")
    felled = staged(by.groupBy("j").agg(F.min("i").alias("by")), "felled")
    out = pairs.join(felled.select(F.col("j").alias("i"), F.lit(True).alias("i_fell")), "i", "left").where("i_fell is null").join(felled, "j", "left")
    out = out.where("by is null or i < by or (i = by and sure)")
    swap = F.col("j_cur") & ~F.col("i_cur")
    return out.select("i", "j", F.when(swap, F.col("j")).otherwise(F.col("i")).alias("kept"), F.when(swap, F.col("i")).otherwise(F.col("j")).alias("other"), F.when(F.col("sure"), "merge").otherwise("review").alias("verdict"))


def deduplicated_vectors(rows: DataFrame, curated: DataFrame, auto: float, floor: float) -> DataFrame:
    """V19 over (id, embedding): (kept, other, verdict). Equal vectors are one entry, under a curated id of theirs or else the smallest; the others are
    copies of it, which are not paired any further."""
    from . import vector_index as VI

    pairs, member = VI.similarity_join(rows, floor)
    named = curated.select(F.col(curated.columns[0]).alias("id")).distinct().join(member, "id").groupBy("first").agg(F.min("id").alias("name"))
    named = staged(member.select("first").distinct().join(named, "first", "left").select("first", F.coalesce("name", "first").alias("name")), "entry-names")
    of = lambda k: named.select(F.col("first").alias(k), F.col("name").alias(f"{k}_name"))
    renamed = pairs.join(of("i"), "i").join(of("j"), "j").select(F.least("i_name", "j_name").alias("i"), F.greatest("i_name", "j_name").alias("j"), "similarity")
    copies = member.join(named, "first").where("id <> name").select(F.col("name").alias("kept"), F.col("id").alias("other"), F.lit("copy").alias("verdict"))
    return merged_pairs(renamed, curated, auto, floor).select("kept", "other", "verdict").unionByName(copies)


def families(t) -> DataFrame:
    """Names of the test tables for V19: vectors in families of five whose members lie near the first one, some nearer than others, and each eleventh a
    copy of its family's first."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    first = e.where("id % 5 = 0").select((F.col("id") / 5).cast("long").alias("family"), F.col("embedding").alias("first"))
    near = F.zip_with("first", "embedding", lambda a, b: F.when((F.col("id") % 11 == 0) | (F.col("id") % 5 == 0), a).otherwise(a * (2 + F.col("id") % 3) + b).cast("double"))
    return e.join(first, F.floor(F.col("id") / 5) == F.col("family")).select("id", near.alias("embedding"))


@query("V19_greedy_merge")
def _(t):
    return deduplicated_vectors(families(t), t.embeddings.where("vec_id % 7 = 0").select("vec_id"), 0.95, 0.88)


# -- chunks and detectors ----------------------------------------------------------


#: Chunkers in the order in which they are asked, by path.
CHUNKERS = (("markdown", r"(?i)\.mdx?$"), ("code", r"(?i)\.(?:ts|tsx|js|jsx|py|go|rs|java|kt|cs|c|cc|cpp|h|swift|scala|php)$"))


def chunker(path: Column) -> Column:
    """The first chunker that can handle a path; lines take the rest."""
    kind = F.lit("lines")
    for name, rule in reversed(CHUNKERS):
        kind = F.when(path.rlike(rule), name).otherwise(kind)
    return kind


def dispatched(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """(key, chunker, chunk) of files, each cut by its own chunker."""
    files = files.withColumn("chunker", chunker(F.col(path)))
    python = F.col(path).rlike(r"(?i)\.py$")
    parts = [
        P.per_text(files.where("chunker = 'markdown'"), key, text, "part int, heading string, chunk string", P.markdown_chunks).select(key, F.lit("markdown").alias("chunker"), "chunk"),
        *(
            P.per_text(files.where((F.col("chunker") == "code") & (python if py else ~python)), key, text, "n int, first int, last int, names array<string>", lambda x, py=py: [(i, a, b, names) for i, a, b, names, _ in P.code_chunks(x, py)]).select(key, F.lit("code").alias("chunker"), F.concat_ws("-", "first", "last").alias("chunk"))
            for py in (False, True)
        ),
    ]
    out = line_windows(files.where("chunker = 'lines'"), text).select(key, "chunker", "chunk")
    for p in parts:
        out = out.unionByName(p)
    return out


@query("C8_chunker_dispatch", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'markdown' WHEN doc_id % 5 < 3 THEN 'code' ELSE 'lines' END AS chunker FROM documents")
def _(t):
    path = F.element_at(F.array(*[F.lit(x) for x in ("a/b.MD", "src/x.ts", "y.py", "data.csv", "LICENSE")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", chunker(path).alias("chunker"))


def detected(files: DataFrame, key: str, text: str, detectors: list[tuple[str, str, float]]) -> DataFrame:
    """(key, line, topic, confidence) for each line that a detector (topic, pattern, confidence) matches; lines stay in their task."""
    lines = files.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "said"))
    hits = F.filter(F.array(*[F.when(F.col("said").rlike(rule), F.struct(F.lit(topic).alias("topic"), F.lit(sure).alias("confidence"))) for topic, rule, sure in detectors]), lambda h: h.isNotNull())
    return lines.select(key, (F.col("line") + 1).alias("line"), F.inline(hits))


DETECTORS = [("secret", r"(?i)token\s*=\s*", 0.9), ("address", r"[a-z0-9.]+@[a-z0-9.]+", 0.8), ("table", r"\|.*\|", 0.6)]


@query(
    "C34_line_detectors",
    "WITH l AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS said FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)), "
    + "d AS ("
    + " UNION ALL ".join(f"SELECT doc_id, CAST(line AS INTEGER) AS line, '{n}' AS topic, {c}::DOUBLE AS confidence FROM l WHERE regexp_matches(said, '{r}')" for n, r, c in DETECTORS)
    + ") SELECT * FROM d",
)
def _(t):
    return detected(t.documents, "doc_id", "text", DETECTORS)


@query("C15_file_groups", P.packs_sql("SELECT source AS g, doc_id AS o, COALESCE(n_chars, 0) + 4 AS size FROM documents", 20, 12_000) + " SELECT g AS source, o AS doc_id, size, pack FROM walk")
def _(t):
    return C.packed(t.documents.selectExpr("source", "doc_id", "coalesce(n_chars, 0) + 4 size"), "source", ["doc_id"], "size", 20, 12_000)


@query("C24_imports")
def _(t):
    return P.per_text(t.part.selectExpr("p_partkey", "concat('import ', split_part(p_name, ' ', 1), '\\nfrom ', split_part(p_name, ' ', 2), '.x import y') text"), "p_partkey", "text", "line int, language string, package string", P.imports)


@query("C30_infra_markers")
def _(t):
    return P.per_text(t.part.selectExpr("p_partkey", "concat('FROM hub/', replace(p_name, ' ', '/'), ':', p_size, '\\nresource \"aws_', lower(p_type), '\" \"x\" {') text"), "p_partkey", "text", "kind string, name string", P.infra_markers)


@query("C31_arns")
def _(t):
    return P.per_text(t.supplier.selectExpr("s_suppkey", "concat('see arn:aws:s3:::bucket-', s_suppkey, ' and arn:aws:sqs:eu-west-1:', lpad(s_suppkey + 7, 12, '1'), ':queue') text"), "s_suppkey", "text", "service string, arn string", P.arns)


# -- hygiene and matching ----------------------------------------------------------


@query("H9_number_provenance")
def _(t):
    return P.per_text(t.documents, "doc_id", "text", "kept string", lambda x: [(P.without_unknown_numbers(x, {"100"}),)])


@query("M2_near_phrase")
def _(t):
    return P.per_text(t.documents, "doc_id", "text", "term string", lambda x: [(term,) for term in ("the and", "und der", "token") if P.near_phrase(term, x)])


def attainable_split(rows: DataFrame, by: str, verified: Column, transferable: Column) -> DataFrame:
    """M9: verified requirements, and of the rest those that transfer, by group."""
    return rows.groupBy(by).agg(F.count_if(verified).alias("verified"), F.count_if(~F.coalesce(verified, F.lit(False)) & transferable).alias("transferable"))


@query("M9_attainable_split", "SELECT p_brand, count(*) FILTER (WHERE p_size > 40) AS verified, count(*) FILTER (WHERE p_size <= 40 AND p_type = 'PROMO') AS transferable FROM part GROUP BY p_brand")
def _(t):
    return attainable_split(t.part, "p_brand", F.col("p_size") > 40, F.col("p_type") == "PROMO")


def covered_days(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Islands and days that the intervals of each key cover together; reversed intervals and open ends must be resolved before."""
    before = F.max(end).over(W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("reach_", before)
    new = F.col("reach_").isNull() | (F.col(start) > F.col("reach_"))
    from_ = F.when(new, F.col(start)).otherwise(F.col("reach_"))
    return rows.groupBy(key).agg(F.count_if(new).alias("islands"), F.sum(F.greatest(F.datediff(end, from_), F.lit(0))).alias("days"))


def years_gap(days: Column, wanted: Column) -> Column:
    """Years that are missing to what is wanted, to one digit, never below 0."""
    return F.greatest(F.round(wanted - days / F.lit(365.25), 1), F.lit(0.0))


@query("M12_years_union", "WITH s AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 60 AS b FROM orders), d AS (SELECT DISTINCT k, unnest(generate_series(a, b - 1, INTERVAL 1 DAY)) AS day FROM s), m AS (SELECT k, a, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), i AS (SELECT k, count(*) AS islands FROM m WHERE reach IS NULL OR a > reach GROUP BY k), n AS (SELECT k, count(*) AS days FROM d GROUP BY k) SELECT k, islands, days, greatest(round(5.0::DOUBLE - days / 365.25::DOUBLE, 1), 0.0::DOUBLE) AS gap FROM i JOIN n USING (k)")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("a"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("b"))
    return covered_days(o, "k", "a", "b").withColumn("gap", years_gap(F.col("days"), F.lit(5.0)))


# -- ledgers and lint ----------------------------------------------------------


#: Directories and file stems of documents that describe a vendor's product without using it.
REFERENCE_DOCS = r"(?i)(?:^|/)(?:docs?|reference|vendor|research|comparisons?|notes)/|(?:^|/)(?:readme|overview|comparison|alternatives)\.[a-z]+$"


def misattributed(claims: DataFrame, groups: DataFrame) -> DataFrame:
    """Claims (skill, path) of skills that belong to a group (kind, skill) of two members or more and whose every file is a reference document."""
    many = groups.distinct().groupBy("kind").agg(F.count("*").alias("n_")).where("n_ >= 2").select("kind")
    named = groups.join(many, "kind", "left_semi").select("skill").distinct()
    only = claims.groupBy("skill").agg(F.bool_and(F.coalesce(F.col("path").rlike(REFERENCE_DOCS), F.lit(False))).alias("only_")).where("only_").select("skill")
    return only.join(named, "skill", "left_semi")


@query("D7_misattribution", "WITH g AS (SELECT DISTINCT p_brand AS kind, p_name AS skill FROM part WHERE p_type = 'PROMO'), n AS (SELECT skill FROM g WHERE kind IN (SELECT kind FROM g GROUP BY kind HAVING count(*) >= 2)) SELECT p_name AS skill FROM part WHERE p_size > 35 AND p_name IN (SELECT skill FROM n) GROUP BY p_name HAVING bool_and(p_size % 3 <> 2)")
def _(t):
    path = F.when(F.col("p_size") % 3 == 0, "docs/x.md").when(F.col("p_size") % 3 == 1, "infra/README.md").otherwise("src/x.ts")
    claims = t.part.where("p_size > 35").select(F.col("p_name").alias("skill"), path.alias("path"))
    return misattributed(claims, t.part.where("p_type = 'PROMO'").select(F.col("p_brand").alias("kind"), F.col("p_name").alias("skill")))


@query("D13_experience_stems", "SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: regexp_replace(w, '^([a-z]{4,})(?:ly|ing)$', '\\1')))), ',') AS stems FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.array_join(F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), stem))), ",").alias("stems"))


#: Retrieval depth by mode: queries, passages, neighbour radius.
DEPTHS = {"deep": (6, 12, 2), "standard": (4, 6, 1)}


def with_depth(rows: DataFrame, mode: Column, depths: dict[str, tuple[int, int, int]] = DEPTHS, default: str = "standard") -> DataFrame:
    """``rows`` with queries, passages and radius of their mode; an unknown one has those of the default."""
    out = rows.withColumn("mode_", F.when(mode.isin(*depths), mode).otherwise(F.lit(default)))
    for i, name in enumerate(("queries", "passages", "radius")):
        names = F.create_map(*[F.lit(x) for k, v in depths.items() for x in (k, v[i])])
        out = out.withColumn(name, F.element_at(names, F.col("mode_")))
    return out.drop("mode_")


@query("D18_depth_presets", "SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN 6 ELSE 4 END AS queries, CASE WHEN length(text) > 200 THEN 12 ELSE 6 END AS passages, CASE WHEN length(text) > 200 THEN 2 ELSE 1 END AS radius FROM conversations WHERE role = 'user'")
def _(t):
    mode = F.when(F.length("text") > 200, "deep").when(F.col("turn") % 2 == 0, "standard").otherwise("other")
    return with_depth(t.conversations.where("role = 'user'"), mode).select("conv_id", "turn", "queries", "passages", "radius")


def semantic_eval(baseline: DataFrame, candidate: DataFrame, near: DataFrame, key: str, id_: str) -> DataFrame:
    """By key the share of baseline items that a candidate of the key equals or is near to (near: i, j, either way), and of candidates likewise;
    1 where a side is empty."""
    both = near.select("i", "j").union(near.select("j", "i")).distinct()

    def share(mine: DataFrame, other: DataFrame, name: str) -> DataFrame:
        other = other.select(key, F.col(id_).alias("j"))
        same = mine.select(key, F.col(id_).alias("i"), F.col(id_).alias("j"))
        close = mine.select(key, F.col(id_).alias("i")).join(both, "i").select(key, "i", "j")
        hit = same.union(close).join(other, [key, "j"], "left_semi").select(key, F.col("i").alias(id_)).distinct().withColumn("hit_", F.lit(1.0))
        return mine.join(hit, [key, id_], "left").groupBy(key).agg(F.round(F.avg(F.coalesce("hit_", F.lit(0.0))), 6).alias(name))

    rates = share(baseline, candidate, "recall").join(share(candidate, baseline, "precision"), key, "full")
    return rates.select(key, *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("recall", "precision")])


@query(
    "E12_semantic_eval",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT * FROM e WHERE vec_id % 3 = 0), c AS (SELECT * FROM e WHERE vec_id % 3 = 1),
    h AS (SELECT b.label, b.vec_id AS i, c.vec_id AS j FROM b JOIN c ON b.label = c.label WHERE round(list_inner_product(b.v, c.v) / (sqrt(list_inner_product(b.v, b.v)) * sqrt(list_inner_product(c.v, c.v))), 6) >= 0.2),
    r AS (SELECT label, round(avg(CASE WHEN vec_id IN (SELECT i FROM h) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM b GROUP BY label),
    p AS (SELECT label, round(avg(CASE WHEN vec_id IN (SELECT j FROM h) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS precision FROM c GROUP BY label)
    SELECT label, COALESCE(recall, 1) AS recall, COALESCE(precision, 1) AS precision FROM r FULL JOIN p USING (label)""",
)
def _(t):
    from .retrieval import pairs_at_least

    e = t.embeddings.select("label", "vec_id")
    near = pairs_at_least(t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label"), 0.2, by="label")
    return semantic_eval(e.where("vec_id % 3 = 0"), e.where("vec_id % 3 = 1"), near, "label", "vec_id")


@query("N1_sections")
def _(t):
    text = t.documents.selectExpr("doc_id", "concat(text, '\\n## Part\\n', substring(text, 1, 50)) text")
    return P.per_text(text, "doc_id", "text", "heading string, first_line int, content string", P.sections)


def echoed(question: Column, answer: Column, facts: Column) -> Column:
    """Tokens of question and answer that the facts lack."""
    return F.array_except(F.array_intersect(question, answer), facts)


@query("N17_query_echo", "WITH x AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(substr(text, 20, 60)), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(substr(text, 1, CAST(10 + item_id * 7 % 90 AS INT))), '[a-z0-9]+')) AS f FROM benchmark) SELECT item_id, len(list_filter(list_intersect(q, a), lambda w: NOT list_contains(f, w))) >= 2 AS echo FROM x")
def _(t):
    bag = lambda c: F.array_distinct(tokens(c))
    return t.benchmark.select("item_id", (F.size(echoed(bag(F.substring("text", 20, 60)), bag(F.col("text")), bag(F.left("text", 10 + F.col("item_id") * 7 % 90)))) >= 2).alias("echo"))


def repo_recall(wanted: DataFrame, found: DataFrame, case: str) -> DataFrame:
    """For each case (case, wanted) the share of wanted repositories that occur in any found source (case, source), case-insensitively; 0 where
    nothing is wanted (a null). A source is cut into its pieces of the lengths that are wanted, which meet the wanted ones of their case as equal strings, so no source
    is compared with all that is wanted."""
    rows = wanted.withColumn("w_", F.lower("wanted"))
    names = rows.where("w_ is not null").select(case, "w_").distinct()
    lengths = names.groupBy(F.length("w_").alias("l")).agg(F.count("*").alias("n"))  # as many rows as there are lengths
    sources = found.where("source is not null").select(case, F.lower("source").alias("s")).distinct().join(F.broadcast(lengths.select("l")), F.length("s") >= F.col("l"))
    starts = F.sequence(F.lit(1), F.when(F.col("l") > 0, F.length("s") - F.col("l") + 1).otherwise(1))
    pieces = sources.select(case, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr(F.col("s"), i, F.col("l"))))).alias("w_"))
    hits = names.join(pieces, [case, "w_"], "left_semi").withColumn("hit_", F.lit(1.0))
    rows = rows.join(hits, [case, "w_"], "left").withColumn("hit_", F.when(F.col("wanted").isNotNull(), F.coalesce("hit_", F.lit(0.0))))
    return rows.groupBy(case).agg(F.round(F.coalesce(F.avg("hit_"), F.lit(0.0)), 6).alias("recall"))


def gate(recalls: DataFrame, kind: str, positive: float, negative: float) -> DataFrame:
    """Whether the worst positive case reaches ``positive`` and the best negative one stays within ``negative``."""
    low, high = F.min(F.when(F.col(kind) == "positive", F.col("recall"))), F.max(F.when(F.col(kind) == "negative", F.col("recall")))
    return recalls.agg((F.coalesce(low, F.lit(1.0)) >= positive).alias("positives"), (F.coalesce(high, F.lit(0.0)) <= negative).alias("negatives"))


@query("N13_repo_recall", "SELECT c_mktsegment, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall FROM customer WHERE c_nationkey < 12 GROUP BY c_mktsegment UNION ALL SELECT 'NONE', 0.0::DOUBLE")
def _(t):
    c = F.col
    wanted = t.customer.where("c_nationkey < 12").select("c_mktsegment", F.concat(F.lit("Repo/"), "c_custkey", F.lit("/")).alias("wanted"))
    empty = t.spark.createDataFrame([("NONE", None)], "c_mktsegment string, wanted string")
    found = t.customer.where("c_acctbal > 0").select("c_mktsegment", F.concat(F.lit("repo/"), "c_custkey", F.lit("/readme.md")).alias("source"))
    return repo_recall(wanted.unionByName(empty), found, "c_mktsegment")


def qa_accuracy(rows: DataFrame, dimension: str, score: Column, error: Column, expected: Column, least: int = 70) -> DataFrame:
    """The share of cases by dimension in which a flag (a score below ``least`` or an issue that is an error) is what was expected."""
    flagged = (score < least) | F.coalesce(error, F.lit(False))
    return rows.groupBy(dimension).agg(F.round(F.avg((flagged == expected).cast("double")), 6).alias("accuracy"))


@query("N14_qa_cases", "SELECT event_type, round(avg(CASE WHEN (value < 70 OR user_id % 9 = 0) = (event_id % 2 = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM events GROUP BY event_type")
def _(t):
    return qa_accuracy(t.events, "event_type", F.col("value"), F.col("user_id") % 9 == 0, F.col("event_id") % 2 == 0)


def underrepresented(all_: DataFrame, cited: DataFrame, repo: str) -> DataFrame:
    """Repositories that no evidence cites."""
    return all_.select(repo).distinct().join(cited.select(repo).distinct(), repo, "left_anti")


@query("N20_underrepresented", "SELECT source FROM documents WHERE source IS NOT NULL EXCEPT SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1")
def _(t):
    return underrepresented(t.documents.where("source is not null"), t.documents.join(t.labels.where("quality = 0 and toxic = 1"), "doc_id", "left_semi"), "source")


def class_groups(rows: DataFrame, kind: str, member: str, order: list[str]) -> DataFrame:
    """Members regrouped by class, in a fixed order of classes; other classes fall out."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(kind))
    return rows.where(place > 0).groupBy(kind).agg(F.first(place).alias("place"), F.count("*").alias("n"), F.min(member).alias("first_name")).orderBy("place")


@query("N26_class_groups", "SELECT p_type, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END::BIGINT AS place, count(*) AS n, min(p_name) AS first_name FROM part WHERE p_type IN ('PROMO', 'SMALL', 'LARGE') GROUP BY p_type")
def _(t):
    return class_groups(t.part, "p_type", "p_name", ["SMALL", "PROMO", "LARGE"])


def repo_profiles(repo: str, *sides: DataFrame) -> DataFrame:
    """One row for each repository that any side (one row a repository) knows, with the columns of all."""
    out = sides[0]
    for side in sides[1:]:
        out = out.join(side, repo, "full")
    return out


@query("N30_repo_profile", "SELECT a.source, a.langs, b.bad FROM (SELECT source, count(DISTINCT lang) AS langs FROM documents WHERE source IS NOT NULL GROUP BY source) a LEFT JOIN (SELECT source, count(*) AS bad FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source) b ON a.source = b.source")
def _(t):
    langs = t.documents.where("source is not null").groupBy("source").agg(F.countDistinct("lang").alias("langs"))
    bad = t.documents.join(t.labels.where("quality = 0"), "doc_id").where("source is not null").groupBy("source").agg(F.count("*").alias("bad"))
    return repo_profiles("source", langs, bad)


@query("N24_sbom_evidence", "SELECT p_partkey, 'pkg:npm/' || replace(p_name, ' ', '-') AS purl, regexp_extract('pkg:npm/' || replace(p_name, ' ', '-'), '^pkg:([a-z]+)/', 1) AS ecosystem FROM part WHERE p_size > 5")
def _(t):
    doc = F.to_json(F.struct(F.array(F.struct(F.when(F.col("p_size") > 5, F.concat(F.lit("pkg:npm/"), F.replace("p_name", F.lit(" "), F.lit("-")))).alias("purl"))).alias("components")))
    parsed = F.from_json(doc, "components array<struct<purl:string>>")
    c = t.part.select("p_partkey", F.explode(parsed["components"]).alias("c")).where(F.col("c.purl").isNotNull())
    return c.select("p_partkey", F.col("c.purl").alias("purl"), F.regexp_extract("c.purl", "^pkg:([a-z]+)/", 1).alias("ecosystem"))
