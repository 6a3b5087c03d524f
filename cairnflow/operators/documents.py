"""Document processing: chunking, classification, hygiene, matching and quality lint of texts, as column expressions and windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..registry import plain, query
from ..staging import staged
from .fulltext import small

# -- chunks -----------------------------------------------------------------


def line_windows(files: DataFrame, text: str = "text", size: int = 80, overlap: int = 10) -> DataFrame:
    """Windows of ``size`` lines that overlap; blank ones are dropped, a text without any other gives itself. No row leaves its task."""
    stride = size - overlap
    lines = F.split(F.col(text), "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(lines) - overlap) / F.lit(float(stride))).cast("int") - 1))
    made = F.filter(F.transform(starts, lambda i: F.trim(F.array_join(F.slice(lines, i * stride + 1, size), "\n"))), lambda c: F.length(c) > 0)
    made = F.when(F.size(made) == 0, F.array(F.col(text))).otherwise(made)
    return files.select("*", F.posexplode(made).alias("chunk_index", "chunk"))


@query(
    "C1_line_windows",
    """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    w AS (SELECT doc_id, i, trim(array_to_string(list_slice(ls, i * 70 + 1, i * 70 + 80), chr(10)), ' ') AS chunk FROM l, unnest(range(0, greatest(1, CAST(ceil((len(ls) - 10) / 70.0) AS BIGINT)))) AS r(i))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, length(chunk) AS n, md5(chunk) AS digest FROM w WHERE length(chunk) > 0""",
)
def _(t):
    return line_windows(t.documents).select("doc_id", "chunk_index", F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))


@query("C5_wikilinks", "SELECT doc_id, regexp_replace(regexp_replace('see [[notes/' || source || '|' || lang || ']] and [[a/b/' || doc_id || ']]', '\\[\\[[^\\]|]*\\|([^\\]]*)\\]\\]', '\\1', 'g'), '\\[\\[(?:[^\\]/]*/)*([^\\]/]*)\\]\\]', '\\1', 'g') AS bare FROM documents")
def _(t):
    said = F.concat(F.lit("see [[notes/"), "source", F.lit("|"), "lang", F.lit("]] and [[a/b/"), "doc_id", F.lit("]]"))
    return t.documents.select("doc_id", X.without_wikilinks(said).alias("bare"))


#: Paths given to documents for the path rules.
_EXTENSIONS = ["ts", "py", "md", "json", "tf", "css", "sql", "lock", "min.js", "go"]
_DIRS = ["src", "tests", "docs", "_build/dist", ".github/workflows", "helm", "adr"]
_NAMES = ["index", "README", "CHANGELOG", "user.test", "yarn", "Dockerfile"]


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _path() -> Column:
    i = F.col("doc_id")
    return F.concat("source", F.lit("/"), _pick(_DIRS, i), F.lit("/"), _pick(_NAMES, F.floor(i / 3)), F.lit("."), _pick(_EXTENSIONS, F.floor(i / 7)))


def _sql_list(values: list[str], n: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({n} % {len(values)} + 1 AS BIGINT))"


_PATH = f"source || '/' || {_sql_list(_DIRS, 'doc_id')} || '/' || {_sql_list(_NAMES, '(doc_id // 3)')} || '.' || {_sql_list(_EXTENSIONS, '(doc_id // 7)')}"


@query("C6_path_tags", f"SELECT doc_id, array_to_string(list_filter(list_slice(string_split({_PATH}, '/'), 1, -2), lambda p: p <> '.' AND p <> '' AND NOT starts_with(p, '_')), ',') AS tags FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.path_tags(_path()), ",").alias("tags"))


@query("C9_file_class", f"SELECT doc_id, CASE {' '.join(f'''WHEN regexp_matches(lower({_PATH}), '{r}') THEN '{n}' ''' for n, r in X.FILE_CLASSES)} ELSE 'other' END AS file_class FROM documents")
def _(t):
    return t.documents.select("doc_id", X.file_class(_path()).alias("file_class"))


@query("C10_doc_type", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches({f'lower({_PATH})' if w == 'path' else 'lower(substr(text, 1, 2000))'}, '{r}') THEN '{n}'" for n, w, r in X.DOC_TYPES) + " ELSE 'general' END AS doc_type FROM documents")
def _(t):
    return t.documents.select("doc_id", X.doc_type(_path(), F.col("text")).alias("doc_type"))


def commit_chunks(commits: DataFrame, key: str, sha: str, author: str, ts: str, message: str, most: int = 4000) -> DataFrame:
    """C11: one chunk per key, ISO week and ``most`` characters of messages, newest first: heading, part, commits, authors, times and text.

    Commits without a time fall out. A part starts at each multiple of ``most`` of the running length, so no week is held by one row before it is cut."""
    week = commits.where(F.col(ts).isNotNull()).withColumn("week", X.iso_week(F.col(ts)))
    before = F.coalesce(F.sum(F.length(message) + 1).over(W.partitionBy(key, "week").orderBy(F.desc(ts), sha).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = week.withColumn("part", F.floor(before / most).cast("long"))
    line = F.struct((-F.unix_micros(F.col(ts).cast("timestamp"))).alias("t"), F.col(sha).alias("s"), F.col(message).alias("m"))
    chunks = cut.groupBy(key, "week", "part").agg(
        F.count("*").alias("commits"), F.array_sort(F.collect_set(author)).alias("authors"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["m"]), "\n").alias("text"),
    )
    return chunks.withColumn("heading", F.concat(F.col("week"), F.when(F.col("part") > 0, " (continued)").otherwise("")))


@query("C11_commit_weeks", "WITH w AS (SELECT *, CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS wk FROM orders), p AS (SELECT *, CAST(floor(COALESCE(sum(length(o_orderpriority) + 1) OVER (PARTITION BY o_custkey, wk ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20) AS BIGINT) AS part FROM w) SELECT o_custkey, wk || CASE WHEN part > 0 THEN ' (continued)' ELSE '' END AS heading, part, count(*) AS commits, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS authors, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, string_agg(o_orderpriority, chr(10) ORDER BY o_orderdate DESC, o_orderkey) AS text FROM p GROUP BY o_custkey, wk, part")
def _(t):
    c = commit_chunks(t.orders, "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", most=20)
    return c.select("o_custkey", "heading", "part", "commits", F.array_join("authors", ",").alias("authors"), "first_at", "last_at", "text")


@query("C12_iso_week", "SELECT o_orderkey, CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS wk FROM orders")
def _(t):
    return t.orders.select("o_orderkey", X.iso_week(F.col("o_orderdate")).alias("wk"))


def changes(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """(key, status) of ``now`` (key, digest) against ``before``: missing, stale or unchanged."""
    old = before.select(key, F.col("digest").alias("old_digest"))
    status = F.when(F.col("old_digest").isNull(), "missing").when(F.col("old_digest") != F.col("digest"), "stale").otherwise("unchanged")
    return now.join(old, key, "left").select(key, status.alias("status"))


@query("C13_content_diff", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 AND sha256(text) <> sha256(text || 'x') THEN 'stale' ELSE 'unchanged' END AS status FROM documents")
def _(t):
    now = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    old = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("digest"))
    return changes(now, old, "doc_id")


@query("C14_embed_preamble", f"SELECT doc_id, '[Repository: ' || source || ' | File: ' || {_PATH} || ' | Section: ' || lang || ']' AS preamble FROM documents")
def _(t):
    return t.documents.select("doc_id", F.format_string("[Repository: %s | File: %s | Section: %s]", F.col("source"), _path(), F.col("lang")).alias("preamble"))


def assigned_skills(chunks: DataFrame, skills: DataFrame, file: str, text: str) -> DataFrame:
    """C17: of the skills of a chunk's file (file, skills) those whose surface form the chunk holds. A small table of skills goes to every task, so that chunks of a frequent
    file do not meet in one."""
    return chunks.join(small(staged(skills, "file-skills"), 1024), file, "left").withColumn("skills", F.filter("skills", lambda s: F.contains(F.lower(F.col(text)), F.lower(s))))


@query("C17_assign_skills", "SELECT doc_id, array_to_string(list_filter(['The', 'token', 'und', 'para', lang], lambda s: contains(lower(text), lower(s))), ',') AS skills FROM documents")
def _(t):
    skills = t.documents.select("lang").distinct().select("lang", F.array(*[F.lit(s) for s in ("The", "token", "und", "para")], F.col("lang")).alias("skills"))
    return assigned_skills(t.documents, skills, "lang", "text").select("doc_id", F.array_join("skills", ",").alias("skills"))


def mapped_skills(rows: DataFrame, tech: str, rules: DataFrame, *by: str) -> DataFrame:
    """Skills that rules (tech, skill) give for the technologies of rows, counted by ``by``."""
    return rows.join(rules.withColumnRenamed("tech", tech), tech).groupBy(*by, "skill").agg(F.count("*").alias("n"))


@query("C18_rule_map", "SELECT e.user_id, m.skill, count(*) AS n FROM events e JOIN (SELECT * FROM (VALUES ('click', 'navigation'), ('click', 'interaction'), ('purchase', 'commerce')) AS v(tech, skill)) m ON e.event_type = m.tech GROUP BY 1, 2")
def _(t):
    rules = t.spark.createDataFrame([("click", "navigation"), ("click", "interaction"), ("purchase", "commerce")], "tech string, skill string")
    return mapped_skills(t.events, "event_type", rules, "user_id")


@query("C19_strip_nul", "SELECT doc_id, md5(text || lang) AS clean FROM documents")
def _(t):
    nul = F.encode(F.lit("\x00"), "UTF-8").cast("string")
    return t.documents.select("doc_id", F.md5(X.without_nul(F.concat("text", nul, "lang", nul))).alias("clean"))


def quota_cut(rows: DataFrame, group: str, order: str, cap: int, deferred: int = 0, failed: Column | None = None) -> DataFrame:
    """C20: the status of each row: failed first, the first ``cap`` rows of a group enriched, ``deferred`` more pending, the rest skipped."""
    rn = F.row_number().over(W.partitionBy(group).orderBy(order))
    status = F.when(rn <= cap, "enriched").when(rn <= cap + deferred, "pending").otherwise("skipped_quota")
    return rows.withColumn("status", status if failed is None else F.when(failed, "failed").otherwise(status))


@query("C20_quota_cut", "SELECT conv_id, turn, CASE WHEN rn <= 3 THEN 'enriched' WHEN rn <= 5 THEN 'pending' ELSE 'skipped_quota' END AS status FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) x")
def _(t):
    return quota_cut(t.conversations.select("conv_id", "turn"), "conv_id", "turn", 3, 2)


@query("C21_lane_tally", f"SELECT CASE {' '.join(f'''WHEN regexp_matches(lower({_PATH}), '{r}') THEN '{n}' ''' for n, r in X.FILE_CLASSES)} ELSE 'other' END AS lane, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(X.file_class(_path()).alias("lane")).agg(F.count("*").alias("n"))


@query("C25_purl", "SELECT p_partkey, 'pkg:' || CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN lower(p_type) ELSE 'generic' END || '/' || replace(replace(p_name, ' ', '-'), '@', '%40') || '@' || p_size AS purl FROM part")
def _(t):
    kind = F.when(F.col("p_type").isin("PROMO", "SMALL", "LARGE"), F.lower("p_type")).otherwise("generic")
    return t.part.select("p_partkey", F.concat(F.lit("pkg:"), kind, F.lit("/"), F.replace(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@"), F.lit("%40")), F.lit("@"), "p_size").alias("purl"))


@query("C26_metric_sentences", "SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}', 'D', 'g'), '\\b(?:19|20)[0-9]{2}\\b', 'Y', 'g'), '. '), lambda s: regexp_matches(s, '[0-9]'))) AS n FROM documents")
def _(t):
    masked = F.regexp_replace(F.regexp_replace("text", "[0-9]{4}-[0-9]{2}-[0-9]{2}", "D"), r"\b(?:19|20)[0-9]{2}\b", "Y")
    return t.documents.select("doc_id", F.size(F.filter(F.split(masked, r"\. "), lambda s: s.rlike("[0-9]"))).cast("long").alias("n"))


@query("C28_word_budget", "SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: length(w) > 0)) AS n_words, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: length(w) > 0)) <= 400 AS within FROM documents")
def _(t):
    n = F.size(X.words(F.col("text"))).cast("long")
    return t.documents.select("doc_id", n.alias("n_words"), (n <= 400).alias("within"))


def distinct_components(components: DataFrame, purl: list[str], name: str, generic: Column, specific: Column) -> DataFrame:
    """Components once by package URL, without generic ones whose name has a specific one."""
    once = components.dropDuplicates(purl)
    named = once.where(specific).select(name).distinct().withColumn("named_", F.lit(True))
    return once.join(named, name, "left").where(~(generic & F.coalesce("named_", F.lit(False)))).drop("named_")


@query("C36_component_dedup", "SELECT p_name, p_type FROM (SELECT DISTINCT p_name, p_type FROM part) x WHERE NOT (p_type = 'STANDARD' AND EXISTS (SELECT 1 FROM part y WHERE y.p_name = x.p_name AND y.p_type = 'PROMO'))")
def _(t):
    return distinct_components(t.part.select("p_name", "p_type"), ["p_name", "p_type"], "p_name", F.col("p_type") == "STANDARD", F.col("p_type") == "PROMO")


# -- hygiene -----------------------------------------------------------------


@query("H1_pii_counts", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{r}')) AS n_{n.lower()}" for n, r in X.PII) + " FROM (SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN ' 078-05-' || (1000 + doc_id % 9000) ELSE '' END AS text FROM documents)")
def _(t):
    number = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" 078-05-"), (1000 + F.col("doc_id") % 9000).cast("string"))).otherwise("")
    return t.documents.select("doc_id", F.concat("text", number).alias("text")).select("doc_id", *X.pii_counts(F.col("text")))


def _nested(column: str, rules, mark: str = "[{}]") -> str:
    for name, rule in rules:
        column = f"regexp_replace({column}, '{rule}', '[{name}]', 'g')"
    return column


@query("H2_scrub", f"SELECT doc_id, md5({_nested('text', X.PII)}) AS scrubbed, {_nested('text', X.PII)} <> text AS changed FROM documents")
def _(t):
    s = X.scrubbed(F.col("text"))
    return t.documents.select("doc_id", F.md5(s).alias("scrubbed"), (s != F.col("text")).alias("changed"))


@query("H3_injection_guard", "SELECT doc_id, COALESCE(" + ", ".join(f"CASE WHEN regexp_matches(regexp_replace(trim(text), '\\s+', ' ', 'g'), '{r}') THEN '{n}' END" for n, r in X.INJECTIONS) + ") AS blocked FROM documents")
def _(t):
    return t.documents.select("doc_id", X.injection(F.col("text")).alias("blocked"))


@query("H4_warn_sanitise", "SELECT doc_id, length(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '(?i)\\b(password|token|secret)\\b', '[REDACTED]', 'g')) AS n, length(text) BETWEEN 10 AND 20000 AS in_bounds FROM documents")
def _(t):
    clean = F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r"(?i)\b(password|token|secret)\b", "[REDACTED]")
    return t.documents.select("doc_id", F.length(clean).cast("long").alias("n"), F.length("text").between(10, 20000).alias("in_bounds"))


@query("H5_field_truncate", "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || ' [truncated]' ELSE text END) AS field FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit(" [truncated]"))).otherwise(F.col("text"))).alias("field"))


def _output_sql(column: str) -> str:
    for rule, by in X.OUTPUT:
        column = f"regexp_replace({column}, '{rule}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return column


@query("H6_output_redaction", f"SELECT doc_id, md5({_output_sql('text')}) AS redacted, {_output_sql('text')} <> text AS was_redacted FROM documents")
def _(t):
    r = X.redacted(F.col("text"))
    return t.documents.select("doc_id", F.md5(r).alias("redacted"), (r != F.col("text")).alias("was_redacted"))


@query("H7_xml_escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.escaped(F.col("text"))).alias("escaped"))


def rubric(scores: DataFrame, key: str, dimension: str, points: Column, each: int = 10, most: int = 50, least: int = 35) -> DataFrame:
    """The total of a prose rubric, at most ``each`` for a dimension, and whether it passes."""
    by = scores.groupBy(key, dimension).agg(F.least(F.lit(each), points).alias("points"))
    return by.groupBy(key).agg(F.least(F.lit(most), F.sum("points")).alias("total")).withColumn("pass", F.col("total") >= least)


@query("H11_rubric", "SELECT user_id, least(50, sum(points)) AS total, least(50, sum(points)) >= 35 AS pass FROM (SELECT user_id, event_type, least(10, count(*)) AS points FROM events GROUP BY 1, 2) x GROUP BY user_id")
def _(t):
    return rubric(t.events, "user_id", "event_type", F.count("*"))


# -- matching -----------------------------------------------------------------


@query("M1_term_normal_form", "SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower('Advanced ' || p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 0 AND w NOT IN ('advanced', 'basic', 'experience', 'knowledge')), ' ') AS term FROM part")
def _(t):
    return t.part.select("p_partkey", X.term(F.concat(F.lit("Advanced "), "p_name", F.lit(" "), "p_brand")).alias("term"))


def overlapping(rows: DataFrame, key: str, term: str, least: int = 3) -> DataFrame:
    """M3: pairs i < j of rows whose terms overlap. In their normal form they share two tokens of ``least`` letters or more; or the smaller set (of equal ones
    that of i) is one token that the other holds. If that token's term had more words, the other term must contain it as a whole instead.

    Two sets that share two tokens share one that is not the most frequent of either, so pairs are made on the others only. A token that must occur as
    part of a phrase begins or ends a word there."""
    named = rows.select(F.col(key).alias("k"), X.term(F.col(term)).alias("phrase"))
    named = named.withColumn("bag", F.array_distinct(F.filter(F.split("phrase", " "), lambda w: F.length(w) >= least))).withColumn("n", F.size("bag")).where("n > 0")
    each = named.select("*", F.explode("bag").alias("w"))
    place = F.row_number().over(W.partitionBy("k").orderBy(F.desc("often"), "w"))
    rare = each.where("n > 1").join(each.groupBy("w").agg(F.count("*").alias("often")), "w").withColumn("place", place).where("place > 1")
    rare = rare.select("w", F.col("k").alias("i"), "bag")
    many = rare.join(rare.select("w", F.col("i").alias("j"), F.col("bag").alias("other")), "w").where("i < j").where(F.size(F.array_intersect("bag", "other")) > 1)
    single = each.where("n = 1").select("w", F.col("k").alias("small"), F.when(F.contains("phrase", F.lit(" ")), F.col("phrase")).alias("needs"))
    holds = each.select("w", F.col("k").alias("large"), "n")
    ends = lambda w: F.flatten(F.transform(F.sequence(F.lit(least), F.length(w)), lambda m: F.array(F.left(w, m), F.right(w, m))))
    within = named.select(F.col("k").alias("large"), "n", "phrase", F.explode(F.array_distinct(F.flatten(F.transform("bag", ends)))).alias("w"))
    smaller = "small <> large and (n > 1 or small < large)"
    one = single.where("needs is null").join(holds, "w").where(smaller)
    part = single.where("needs is not null").join(within, "w").where(smaller).where(F.contains("phrase", F.col("needs")))
    pair = lambda frame: frame.select(F.least("small", "large").alias("i"), F.greatest("small", "large").alias("j"))
    return many.select("i", "j").unionByName(pair(one)).unionByName(pair(part)).distinct()


@query(
    "M3_token_overlap",
    """WITH t AS (SELECT min(p_partkey) AS k, CASE min(p_partkey) % 4 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN 'x ' || split_part(p_name, ' ', 2) ELSE p_name END AS term FROM part GROUP BY p_name, p_brand),
    x AS (SELECT k, term AS phrase, list_distinct(list_filter(string_split(term, ' '), lambda w: length(w) >= 3)) AS bag FROM t),
    p AS (SELECT a.k AS i, b.k AS j, len(list_intersect(a.bag, b.bag)) AS shared, CASE WHEN len(a.bag) <= len(b.bag) THEN a.phrase ELSE b.phrase END AS small, CASE WHEN len(a.bag) <= len(b.bag) THEN b.phrase ELSE a.phrase END AS large,
      least(len(a.bag), len(b.bag)) AS fewest FROM x a JOIN x b ON a.k < b.k WHERE len(a.bag) > 0 AND len(b.bag) > 0)
    SELECT i, j FROM p WHERE CASE WHEN shared >= 2 THEN TRUE WHEN fewest = 1 AND contains(small, ' ') THEN contains(large, small) ELSE shared / fewest >= 0.6 END""",
)
def _(t):
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2))
    terms = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"))
    terms = terms.withColumn("term", F.when(F.col("k") % 4 == 0, first).when(F.col("k") % 4 == 1, F.concat(F.lit("x "), second)).otherwise(F.col("p_name")))
    return overlapping(terms, "k", "term")


def match_tiers(wanted: DataFrame, held: DataFrame, aliases: DataFrame, transfers: DataFrame, similar: DataFrame, least: float) -> DataFrame:
    """M4: (term, tier) of each wanted term: literal if it is held (term), normalized if its normal form is, ontology if its canonical name (aliases: term,
    canonical) is that of a held one, tech_transfer if a held term is in one of its classes (transfers: kind, term), embedding if one is
    similar (similar: term, similarity) at ``least``, else none."""
    flag = lambda frame, name: frame.distinct().withColumn(name, F.lit(True))
    held = held.select("term").distinct()
    norm = held.select(X.term(F.col("term")).alias("form"))
    names = lambda frame: frame.join(aliases, "term").select("term", "canonical")
    onto = names(wanted.select("term")).join(names(held).select("canonical").distinct(), "canonical").select("term")
    kinds = held.join(transfers, "term").select("kind").distinct()
    moved = transfers.join(kinds, "kind").select("term")
    out = wanted.select("term").distinct().withColumn("form", X.term(F.col("term")))
    out = out.join(flag(held, "l_"), "term", "left").join(flag(norm, "n_"), "form", "left").join(flag(onto, "o_"), "term", "left").join(flag(moved, "t_"), "term", "left")
    out = out.join(similar.groupBy("term").agg(F.max("similarity").alias("s_")), "term", "left")
    tier = F.when(F.col("l_"), "literal").when(F.col("n_"), "normalized").when(F.col("o_"), "ontology").when(F.col("t_"), "tech_transfer").when(F.col("s_") >= least, "embedding")
    return out.select("term", tier.otherwise("none").alias("tier"))


@query(
    "M4_tier_cascade",
    "WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' experience' ELSE '' END AS term, p_type || p_size % 7 AS canonical, p_brand || p_size AS kind, p_size, p_retailprice FROM part), f AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 0 AND w NOT IN ('advanced', 'basic', 'experience', 'knowledge')), ' ') AS form FROM p), h AS (SELECT * FROM f WHERE p_size >= 49) SELECT term, CASE WHEN term IN (SELECT term FROM h) THEN 'literal' WHEN form IN (SELECT form FROM h) THEN 'normalized' WHEN bool_or(canonical IN (SELECT a.canonical FROM f a WHERE a.p_partkey % 10 = 0 AND a.term IN (SELECT term FROM h)) AND p_partkey % 10 = 0) THEN 'ontology' WHEN bool_or(kind IN (SELECT a.kind FROM f a WHERE a.p_partkey % 4 = 0 AND a.term IN (SELECT term FROM h)) AND p_partkey % 4 = 0) THEN 'tech_transfer' WHEN max(p_retailprice / 1000) >= 0.95 THEN 'embedding' ELSE 'none' END AS tier FROM f GROUP BY term, form",
)
def _(t):
    name = F.concat("p_name", F.lit(" "), "p_brand", F.when(F.col("p_partkey") % 3 == 0, " experience").otherwise(""))
    p = t.part.select("p_partkey", name.alias("term"), F.concat("p_type", F.col("p_size") % 7).alias("canonical"), F.concat("p_brand", "p_size").alias("kind"), "p_size", (F.col("p_retailprice") / 1000).alias("similarity"))
    return match_tiers(p, p.where("p_size >= 49"), p.where("p_partkey % 10 = 0").select("term", "canonical"), p.where("p_partkey % 4 = 0").select("kind", "term"), p.select("term", "similarity"), 0.95)


def grounded_coverage(claims: DataFrame, held: DataFrame, by: str) -> DataFrame:
    """M5: (by, rate): the share of a group's claimed terms (by, term; a null term claims nothing) that are covered, by the normal form's words all being in one of the
    group's held rows (by, text); 1 for a group that claims nothing. Of the held rows' words only those that a claim of the group has go on, one row each; a claim is covered
    by a held row that has as many of its words as it has."""
    words = F.array_distinct(F.split(X.term(F.col("term")), " "))
    claims = staged(claims.select(by, "term").distinct(), "claims")
    each = staged(claims.where("term is not null").select(by, "term", F.size(words).alias("n"), F.explode(words).alias("w")), "claimed-words")
    bags = held.select(by, F.monotonically_increasing_id().alias("row_"), F.array_distinct(X.tokens(F.col("text"))).alias("bag"))
    met = bags.select(by, "row_", F.explode("bag").alias("w")).join(small(each), [by, "w"]).groupBy(by, "row_", "term").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    found = met.where("m = n").select(by, "term").distinct().withColumn("hit_", F.lit(1.0))
    rates = claims.join(found, [by, "term"], "left")
    return rates.groupBy(by).agg(F.round(F.coalesce(F.avg(F.when(F.col("term").isNotNull(), F.coalesce("hit_", F.lit(0.0)))), F.lit(1.0)), 6).alias("rate"))


@query(
    "M5_grounded_coverage",
    """WITH w(term, words) AS (VALUES ('Idiot trash', ['idiot', 'trash']), ('the-OF', ['the', 'of']), ('stupid knowledge', ['stupid']), ('no such thing', ['no', 'such', 'thing'])),
    d AS (SELECT lang, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS bag FROM documents WHERE doc_id % 3 = 0),
    c AS (SELECT DISTINCT lang, term, words FROM documents, w WHERE lang IS NOT NULL AND lang <> 'es')
    SELECT lang, round(avg(CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.lang = c.lang AND list_has_all(d.bag, c.words)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM c GROUP BY lang UNION ALL SELECT 'es', 1.0::DOUBLE""",
)
def _(t):
    langs = t.documents.where("lang is not null").select("lang").distinct()
    terms = F.explode(F.array(*[F.lit(x) for x in ("Idiot trash", "the-OF", "stupid knowledge", "no such thing")]))
    claims = langs.where("lang <> 'es'").select("lang", terms.alias("term")).unionByName(langs.where("lang = 'es'").select("lang", F.lit(None).cast("string").alias("term")))
    return grounded_coverage(claims, t.documents.where("doc_id % 3 = 0").select("lang", "text"), "lang")


def weighted_fit(must: Column, may: Column, a: float = 0.7, b: float = 0.3) -> Column:
    """M6: shares of two groups at weights a and b; a missing group leaves all weight to the other."""
    return F.when(must.isNull(), may).when(may.isNull(), must).otherwise(F.round(a * must + b * may, 6))


@query("M6_weighted_fit", "WITH x AS (SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END) / 10000.0::DOUBLE, 4) AS must, round(sum(CASE WHEN event_type = 'signup' THEN CAST(round(value * 100) AS BIGINT) END) / 10000.0::DOUBLE, 4) AS may FROM events GROUP BY user_id) SELECT user_id, CASE WHEN must IS NULL THEN may WHEN may IS NULL THEN must ELSE round(0.7::DOUBLE * must + 0.3::DOUBLE * may, 6) END AS fit FROM x")
def _(t):
    share = lambda kind: F.round(F.sum(F.when(F.col("event_type") == kind, F.round(F.col("value") * 100).cast("long"))) / F.lit(10000.0), 4)
    x = t.events.groupBy("user_id").agg(share("purchase").alias("must"), share("signup").alias("may"))
    return x.select("user_id", weighted_fit(F.col("must"), F.col("may")).alias("fit"))


def coverage_score(required: Column, rest: Column) -> Column:
    """M7: the share of required keywords at 0.7, of the rest at 0.3; a part without keywords counts as covered."""
    return F.round(F.lit(0.7) * F.coalesce(required, F.lit(1.0)) + F.lit(0.3) * F.coalesce(rest, F.lit(1.0)), 6)


@query("M7_coverage_score", "SELECT o_custkey, round(CAST(0.7 AS DOUBLE) * avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) + CAST(0.3 AS DOUBLE) * avg(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS score FROM orders GROUP BY o_custkey")
def _(t):
    share = lambda hit: F.avg(F.when(hit, 1.0).otherwise(0.0))
    x = t.orders.groupBy("o_custkey").agg(share(F.col("o_orderstatus") == "F").alias("a"), share(F.col("o_orderpriority") == "1-URGENT").alias("b"))
    return x.select("o_custkey", coverage_score(F.col("a"), F.col("b")).alias("score"))


@query("M8_structural_checks", "SELECT doc_id, concat_ws(',', CASE WHEN NOT regexp_matches(text, '@[a-z]') THEN 'no_email' END, CASE WHEN contains(text, chr(9)) THEN 'tabs' END, CASE WHEN length(text) > 6000 THEN 'too_long' END, CASE WHEN NOT contains(text, chr(10)) THEN 'one_block' END) AS issues FROM documents")
def _(t):
    issues = F.concat_ws(",", F.when(~F.col("text").rlike("@[a-z]"), "no_email"), F.when(F.contains("text", F.lit("\t")), "tabs"), F.when(F.length("text") > 6000, "too_long"), F.when(~F.contains("text", F.lit("\n")), "one_block"))
    return t.documents.select("doc_id", issues.alias("issues"))


LOCK_FILES = r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|go\.sum)$"


def top_evidence(rows: DataFrame, skill: str, order: list[Column], most: int = 3, path: str | None = None) -> DataFrame:
    """The first ``most`` rows of evidence of each skill with their rank; lock files are no evidence."""
    rows = rows if path is None else rows.where(~F.coalesce(F.col(path).rlike(LOCK_FILES), F.lit(False)))
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(skill).orderBy(*order))).where(F.col("rn") <= most)


@query("M10_evidence_top3", "SELECT l_partkey, l_orderkey, rn FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem WHERE l_returnflag <> 'R') x WHERE rn <= 3")
def _(t):
    path = F.when(F.col("l_returnflag") == "R", "app/yarn.lock").otherwise("src/index.ts")
    return top_evidence(t.lineitem.withColumn("path", path), "l_partkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], path="path").select("l_partkey", "l_orderkey", "rn")


def selected_doc_types(text: Column, weights: Column, keywords: dict[str, list[str]], dimensions: dict[str, list[str]], least: int = 25) -> Column:
    """Document types whose keywords (words or phrases, in any case) occur in a text between word boundaries, or one of whose dimensions weighs
    ``least`` or more (weights: a map); in the order of ``keywords``."""
    edge = "(?:^|[^a-z0-9_]){}(?:$|[^a-z0-9_])"

    def chosen(low: Column) -> Column:
        found = []
        for kind, words in keywords.items():
            hit = F.lit(False)
            for d in dimensions.get(kind, []):
                hit = hit | (F.coalesce(F.try_element_at(weights, F.lit(d)), F.lit(0)) >= least)
            for w in words:  # a plain search first, and the pattern only where it finds the word
                hit = hit | (F.contains(low, F.lit(w.lower())) & low.rlike(edge.format(re.escape(w.lower()))))
            found.append(F.when(hit, kind))
        return F.array_compact(F.array(*found))

    return F.get(F.transform(F.array(F.lower(text)), chosen), F.lit(0))


@query(
    "M11_doc_type_select",
    """WITH k(kind, place, word) AS (VALUES ('runbook', 1, 'trash'), ('runbook', 1, 'was with'), ('decision', 2, 'idiot'), ('decision', 2, 'of the'), ('history', 3, 'from')),
    w AS (SELECT doc_id, n_chars, ' ' || regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g') || ' ' AS padded, lower(text) AS low FROM documents),
    h AS (SELECT doc_id, kind, place FROM w JOIN k ON contains(padded, ' ' || word || ' ') AND contains(low, word) UNION SELECT doc_id, 'runbook', 1 FROM w WHERE n_chars % 40 >= 25)
    SELECT d.doc_id, COALESCE(string_agg(kind, ',' ORDER BY place), '') AS kinds FROM documents d LEFT JOIN (SELECT DISTINCT * FROM h) h ON d.doc_id = h.doc_id GROUP BY d.doc_id""",
)
def _(t):
    weights = F.create_map(F.lit("operations"), F.col("n_chars") % 40)
    keywords = {"runbook": ["trash", "was with"], "decision": ["idiot", "OF the"], "history": ["from"]}
    return t.documents.select("doc_id", F.array_join(selected_doc_types(F.col("text"), weights, keywords, {"runbook": ["operations"]}), ",").alias("kinds"))


# -- lint -----------------------------------------------------------------


@query("N2_html_text", "WITH x AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&amp;', '&', 'g'), '\\s+', ' ', 'g')) AS body FROM pages) SELECT page_id, length(body) AS n, md5(body) AS digest FROM x")
def _(t):
    body = X.html_text(F.col("html"))
    return t.pages.select("page_id", F.length(body).cast("long").alias("n"), F.md5(body).alias("digest"))


#: Words that make no phrase distinctive, and how many others an n-gram needs.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
DISTINCTIVE = 3
#: Bytes of text whose words are hashed together, and bytes of text whose n-grams are compared in one bucket.
GRAM_BYTES, BUCKET_BYTES = 1 << 22, 1 << 23


def _gram_hasher(n: int, least: int):
    """A function of texts (bytes, in lower case): (of, at, h, g) of their word n-grams, at least ``least`` of whose words are no stop words: the text's number, the number of the
    first word, and two hashes. Words (runs of a to z) are hashed at once, eight letters a step, each step one to one, so that texts of a regular structure do not meet."""
    import numpy as np

    def mixed(x, by):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
        return x ^ (x >> np.uint64(29))

    lanes = ((0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F))

    def hashed(data: bytes):
        """The hashes of the words, one array a lane, and where they begin."""
        raw = np.frombuffer(data + bytes(8), np.uint8)
        letter = (raw >= 97) & (raw <= 122)
        edge = np.flatnonzero(np.diff(np.r_[False, letter]))
        begin, size = edge[::2], edge[1::2] - edge[::2]
        out = [size.astype(np.uint64) * np.uint64(start) for start, *_ in lanes]
        left, done = np.arange(len(size)), 0
        while len(left):
            at, many = begin[left] + done, size[left] - done
            value = np.zeros(len(left), np.uint64)
            for i in range(8):
                value |= raw[at + i].astype(np.uint64) * (many > i) << np.uint64(8 * i)
            for h, (_, by, step) in zip(out, lanes):
                h[left] = mixed((h[left] ^ value) * np.uint64(step), by)
            left, done = left[many > 8], done + 8
        return out, begin

    stop = np.sort(hashed(" ".join(STOP_WORDS).encode())[0][0])

    def grams(texts):
        words, begin = hashed(b"\n".join([*texts, b""]))
        of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")
        many = max(0, len(begin) - n + 1)
        told = np.r_[0, np.cumsum(~np.isin(words[0], stop))]
        here = np.flatnonzero((of[:many] == of[n - 1 :]) & (told[n:] - told[:many] >= least)) if many else np.zeros(0, np.int64)
        found = []
        for word, (_, by, step) in zip(words, lanes):
            h = np.zeros(len(here), np.uint64)
            for i in range(n):
                h = mixed(h * np.uint64(step) + word[here + i], by)
            found.append(h)
        first = np.r_[0, np.flatnonzero(np.diff(of)) + 1] if len(of) else of
        place = np.zeros(len(texts), np.int64)
        place[of[first]] = first
        return of[here], here - place[of[here]], *found

    return grams


def _text_parts(batches):
    """Keys and texts (bytes) of Arrow batches (key, text), about GRAM_BYTES bytes at a time."""
    import pyarrow as pa

    keys, texts, size = [], [], 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for k, x in zip(*(c.to_pylist() for c in batch.columns)):
            keys.append(k)
            texts.append((x or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= GRAM_BYTES:
                yield pa.array(keys, kind), texts
                keys, texts, size = [], [], 0
    if texts:
        yield pa.array(keys, kind), texts


def _distinct_grams(n: int, least: int):
    """Arrow batches (section, text in lower case) to (section, h, at): the hashes of each section's distinctive word n-grams, each with the word it first begins with."""
    import numpy as np
    import pyarrow as pa

    grams = _gram_hasher(n, least)

    def run(batches):
        for keys, texts in _text_parts(batches):
            of, at, h, _ = grams(texts)
            # each hash once a section, where it first stands
            order = np.lexsort((at, h, of))
            order = order[np.r_[True, (np.diff(h[order]) != 0) | (np.diff(of[order]) != 0)][: len(order)]]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of[order])), pa.array(h[order].view(np.int64)), pa.array(at[order].astype(np.int32))], ["section", "h", "at"])

    return run


def _pressed(*columns) -> bytes:
    """Columns of unsigned numbers as bytes, those that are 0 throughout left out, lowest bytes first, compressed."""
    import numpy as np
    import pyarrow as pa

    wide = [max(1, (int(c.max()).bit_length() + 7) // 8) for c in columns]
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for c, w in zip(columns, wide)]
    return bytes(wide) + pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpressed(data: bytes, rows: int, number: int) -> list:
    """The ``number`` columns of ``rows`` numbers that ``_pressed`` was given."""
    import numpy as np
    import pyarrow as pa

    wide = list(data[:number])
    held, out, at = np.frombuffer(pa.decompress(data[number:], rows * sum(wide), "zstd"), np.uint8), [], 0
    for w in wide:
        column = np.zeros((rows, 8), np.uint8)
        column[:, :w] = held[at : at + rows * w].reshape(w, rows).T
        out.append(column.view("<u8").ravel())
        at += rows * w
    return out


def repeated_ngram_counts(sections: DataFrame, n: int = 6, key: str = "section", least: int = DISTINCTIVE) -> DataFrame:
    """(section, first_section, n): how many distinct n-grams as of ``repeated_ngrams`` a section shares with the first one that has them. ``key`` is of whole numbers.

    The hashes (96 bits, taken as the n-gram: among 10^10 ones two meet with a chance below 1e-8) and sections of some MB of text go to each bucket of hashes in one packed row, some 12 bytes an
    n-gram. A bucket knows the first section of each hash, and sends the pairs to the homes of the later ones, which count them. No gram is written out."""
    import numpy as np
    import pyarrow as pa

    kind = sections.schema[key].dataType
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be of whole numbers")
    lower = sections.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("section"), F.lower("text").alias("text"))
    number = max(1, -(-(sections.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    grams = _gram_hasher(n, least)

    def cells(to, columns):
        """A batch of packed rows (to, n, base, data) of columns in the order of ``to``, the first one as steps."""
        cut = np.flatnonzero(np.r_[True, np.diff(to) != 0])
        packed, bases = [], []
        for x, y in zip(cut, np.r_[cut[1:], len(to)]):
            lead, *rest = (c[x:y] for c in columns)
            bases.append(int(lead[0]))
            packed.append(_pressed(np.diff(lead, prepend=lead[:1]).view(np.uint64), *rest))
        return pa.RecordBatch.from_arrays([pa.array(to[cut].astype(np.int32)), pa.array(np.diff(np.r_[cut, len(to)]).astype(np.int32)), pa.array(bases, pa.int64()), pa.array(packed, pa.binary())], ["to", "n", "base", "data"])

    def opened(batches, number_of):
        """For each ``to`` of sorted rows, the columns of its cells."""
        now, held = None, []
        for batch in batches:
            for to, rows, base, data in zip(*(c.to_pylist() for c in batch.columns)):
                if to != now and held:
                    yield [np.concatenate(c) for c in zip(*held)]
                    held = []
                now = to
                lead, *rest = _unpressed(data, rows, number_of)
                held.append((np.cumsum(lead.view(np.int64)) + base, *rest))
        if held:
            yield [np.concatenate(c) for c in zip(*held)]

    def ask(batches):
        for keys, texts in _text_parts(batches):
            of, _, h, g = grams(texts)
            section = keys.to_numpy()
            low = section.min()
            # in the order of the hashes, of which buckets are ranges; each once a section
            order = np.lexsort((section[of], h))
            h, g, s = h[order], g[order] >> np.uint64(32), section[of[order]]
            new = np.r_[True, (np.diff(h) != 0) | (np.diff(g) != 0) | (np.diff(s) != 0)][: len(h)]
            h, g, s = h[new], g[new], s[new]
            if len(h):
                yield cells(((h >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)).astype(np.int64), [h.view(np.int64), g, (s - low).view(np.uint64), np.full(len(h), low).view(np.uint64)])

    def meet(batches):
        for h, g, s, low in opened(batches, 4):
            s = (s + low).view(np.int64)
            order = np.lexsort((s, g, h))
            h, g, s = h[order], g[order], s[order]
            start = np.r_[True, (np.diff(h) != 0) | (np.diff(g) != 0)]
            first = s[np.flatnonzero(start)][np.cumsum(start) - 1]
            later = ~start & (s != first) & np.r_[True, np.diff(s) != 0]
            yield from counted(s[later], first[later], np.ones(int(later.sum()), np.int64), cells_of)

    def counted(s, first, many, then):
        """Pairs with their counts added up, in the order of sections."""
        if len(s):
            order = np.lexsort((first, s))
            s, first, many = s[order], first[order], many[order]
            cut = np.flatnonzero(np.r_[True, (np.diff(s) != 0) | (np.diff(first) != 0)])
            yield then(s[cut], first[cut], np.add.reduceat(many, cut))

    def cells_of(s, first, many):
        """Pairs for the homes of their sections: neighbouring sections have one home."""
        x = (s >> 6).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        home = ((x >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        return cells(home[order], [s[order], first[order].view(np.uint64), many[order].view(np.uint64)])

    def add(batches):
        for s, first, many in opened(batches, 3):
            yield from counted(s, first.view(np.int64), many.view(np.int64), lambda *c: pa.RecordBatch.from_arrays([pa.array(x) for x in c], ["section", "first_section", "n"]))

    packed = "to int, n int, base long, data binary"
    dealt = lambda rows: rows.repartition(number, "to").sortWithinPartitions("to")
    found = dealt(dealt(lower.mapInArrow(ask, packed)).mapInArrow(meet, packed)).mapInArrow(add, "section long, first_section long, n long")
    return found.select(F.col("section").cast(kind).alias(key), F.col("first_section").cast(kind).alias("first_section"), "n")


def repeated_ngrams(sections: DataFrame, n: int = 6, key: str = "section", least: int = DISTINCTIVE) -> DataFrame:
    """(section, gram, first_section): word n-grams, at least ``least`` of whose words are no stop words, that an earlier section has; once per section. Written out in full;
    ``repeated_ngram_counts`` is for their numbers.

    Only hashes of grams are counted. Grams of hashes that two sections have are then written out and compared as text, so that
    two grams of one hash are told apart. ``key`` tells sections apart."""
    kind = sections.schema[key].dataType.simpleString()
    lower = sections.select(F.col(key).alias("section"), F.lower("text").alias("text"))
    hashes = staged(lower.mapInArrow(_distinct_grams(n, least), f"section {kind}, h long, at int"), "gram-hashes")  # read twice, made once
    held = hashes.groupBy("h").agg(F.count("*").alias("held")).where("held > 1").select("h")
    places = hashes.join(held, "h", "left_semi")
    words = sections.select(F.col(key).alias("section"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("ts"))
    grams = places.groupBy("section").agg(F.collect_list("at").alias("ats")).join(words, "section")
    grams = grams.select("section", F.explode(F.transform("ats", lambda at: F.array_join(F.slice("ts", at + 1, n), " "))).alias("gram"))
    first = grams.groupBy("gram").agg(F.min("section").alias("first_section"))
    return grams.join(first, "gram").where(F.col("section") != F.col("first_section")).select(F.col("section").alias(key), "gram", "first_section")


@query(
    "N3_repeated_ngrams",
    f"""WITH w AS (SELECT doc_id AS section, regexp_extract_all(lower(text), '[a-z]+') AS ts FROM documents), g AS (SELECT DISTINCT section, array_to_string(list_slice(ts, i, i + 5), ' ') AS gram FROM w, unnest(range(1, len(ts) - 4)) AS r(i)
    WHERE len(ts) >= 6 AND len(list_filter(list_slice(ts, i, i + 5), lambda x: x NOT IN {STOP_WORDS})) >= {DISTINCTIVE}),
    f AS (SELECT gram, min(section) AS first_section FROM g GROUP BY gram HAVING count(*) > 1) SELECT g.section, f.first_section, count(*) AS n FROM g JOIN f USING (gram) WHERE g.section <> f.first_section GROUP BY 1, 2""",
)
def _(t):
    return repeated_ngram_counts(t.documents.select(F.col("doc_id").alias("section"), "text"))


@query("N4_title_coverage", "WITH x AS (SELECT doc_id, lower(text) AS b, list_filter(list_distinct(regexp_extract_all(lower(split_part(text, '.', 1)), '[a-z]+')), lambda w: length(w) >= 4) AS ts FROM documents) SELECT doc_id, len(ts) AS n_terms, len(list_filter(ts, lambda w: (length(b) - length(replace(b, w, ''))) / length(w) >= 2)) AS n_covered FROM x")
def _(t):
    b = F.lower("text")
    ts = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.split_part("text", F.lit("."), F.lit(1))), F.lit("[a-z]+"), 0)), lambda w: F.length(w) >= 4)
    x = t.documents.select("doc_id", b.alias("b"), ts.alias("ts"))
    return x.select("doc_id", F.size("ts").cast("long").alias("n_terms"), F.size(F.filter("ts", lambda w: (F.length("b") - F.length(F.replace(F.col("b"), w, F.lit("")))) / F.length(w) >= 2)).cast("long").alias("n_covered"))


@query("N5_pattern_counts", "SELECT doc_id, len(regexp_extract_all(text, '[!]{2,}')) AS shouts, len(regexp_extract_all(text, '[|]')) > 5 AS too_many_bars FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[!]{2,}")).cast("long").alias("shouts"), (F.regexp_count("text", F.lit("[|]")) > 5).alias("too_many_bars"))


@query("N6_punctuation_density", "WITH x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: length(p) > 80) AS ps FROM documents) SELECT doc_id, len(ps) AS paragraphs, COALESCE(list_sum(list_transform(ps, lambda p: length(p) - length(replace(p, ',', '')))), 0)::BIGINT AS commas FROM x")
def _(t):
    ps = F.filter(F.split("text", "\n"), lambda p: F.length(p) > 80)
    commas = F.aggregate(ps, F.lit(0), lambda a, p: a + F.length(p) - F.length(F.replace(p, F.lit(","), F.lit(""))))
    return t.documents.select("doc_id", F.size(ps).cast("long").alias("paragraphs"), commas.cast("long").alias("commas"))


@query(
    "N7_readability",
    "WITH x AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS s FROM documents) SELECT doc_id, CASE WHEN len(w) >= 25 THEN round(206.835::DOUBLE - 1.015::DOUBLE * (len(w) / s) - 84.6::DOUBLE * (list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') THEN 1 ELSE 0 END))) / len(w)), 4) END AS ease FROM x",
)
def _(t):
    return t.documents.select("doc_id", X.reading_ease(F.col("text")).alias("ease"))


@query("N9_links", "WITH x AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS ls FROM pages) SELECT page_id, len(ls) AS links, len(ls) > 5 AS over_cap, len(list_filter(ls, lambda l: NOT contains(l, '#') AND len(string_split(l, '/')) < 3)) AS shallow FROM x")
def _(t):
    ls = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return t.pages.select("page_id", F.size(ls).cast("long").alias("links"), (F.size(ls) > 5).alias("over_cap"), F.size(F.filter(ls, lambda x: ~F.contains(x, F.lit("#")) & (F.size(F.split(x, "/")) < 3))).cast("long").alias("shallow"))


def spelling_hits(text: Column, variants: dict[str, str]) -> Column:
    """Distinct ``found->canonical`` of spelling variants (a pattern of a whole word: its canonical form) among a text's words, in order; pass
    ``prose_only`` of a text to leave code out."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0))

    def hits(rule: str, name: str) -> Column:
        return F.transform(F.filter(words, lambda w: w.rlike(f"^(?:{rule})$")), lambda w: F.concat(w, F.lit(f"->{name}")))

    return F.array_sort(F.array_distinct(F.concat(*(hits(*v) for v in variants.items()))))


#: Variants to look for and what they stand for.
VARIANTS = {"colou?red": "tinted", "stupid(?:ly)?": "unwise", "idiots?": "fool", "trash(?:ed)?": "rubbish", "worthless": "valueless"}


@query(
    "N10_spelling_variants",
    """WITH v(word, canon) AS (VALUES ('stupid', 'unwise'), ('stupidly', 'unwise'), ('idiot', 'fool'), ('idiots', 'fool'), ('trash', 'rubbish'), ('trashed', 'rubbish'), ('worthless', 'valueless'), ('colored', 'tinted'), ('coloured', 'tinted')),
    w AS (SELECT doc_id, unnest(list_distinct(string_split(regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), ' '))) AS word FROM documents)
    SELECT d.doc_id, COALESCE(string_agg(h.hit, ',' ORDER BY h.hit), '') AS variants FROM documents d LEFT JOIN (SELECT doc_id, word || '->' || canon AS hit FROM w JOIN v USING (word)) h ON d.doc_id = h.doc_id GROUP BY d.doc_id""",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(spelling_hits(F.col("text"), VARIANTS), ",").alias("variants"))


def outline_coverage(text: Column, headings: Column) -> Column:
    """The share of headings that the text contains in any case; 1 without headings."""
    held = F.size(F.filter(headings, lambda h: F.contains(F.lower(text), F.lower(h))))
    return F.when(F.size(headings) > 0, held / F.size(headings)).otherwise(F.lit(1.0))


@query("N11_outline_coverage", "WITH x AS (SELECT doc_id, lower(text) AS low, list_slice(['The', 'und', 'LES', 'que'], 1, doc_id % 5) AS hs FROM documents), y AS (SELECT doc_id, CASE WHEN len(hs) > 0 THEN len(list_filter(hs, lambda h: contains(low, lower(h)))) / len(hs) ELSE 1.0::DOUBLE END AS coverage FROM x) SELECT doc_id, coverage, coverage >= 0.8 AS pass FROM y")
def _(t):
    headings = F.slice(F.array(*[F.lit(h) for h in ("The", "und", "LES", "que")]), F.lit(1), (F.col("doc_id") % 5).cast("int"))
    x = t.documents.select("doc_id", outline_coverage(F.col("text"), headings).alias("coverage"))
    return x.withColumn("pass", F.col("coverage") >= 0.8)


@query("N12_reading_time", "WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w, 1 + n_chars // 1500 + CASE WHEN doc_id % 6 = 0 THEN 9 ELSE 0 END AS stated FROM documents) SELECT doc_id, w / 200.0::DOUBLE AS minutes, abs(w / 200.0 - stated) <= 0.6 * (w / 200.0) + 1 AS plausible FROM x")
def _(t):
    x = t.documents.select("doc_id", (F.regexp_count("text", F.lit("[^ \\t\\n\\r]+")) / F.lit(200.0)).alias("minutes"), (1 + F.floor(F.col("n_chars") / 1500) + F.when(F.col("doc_id") % 6 == 0, 9).otherwise(0)).alias("stated"))
    return x.select("doc_id", "minutes", (F.abs(F.col("minutes") - F.col("stated")) <= 0.6 * F.col("minutes") + 1).alias("plausible"))


def distinctive(text: Column, least: int = 5) -> Column:
    return F.array_distinct(F.filter(X.tokens(text), lambda w: F.length(w) >= least))


@query("N15_fact_overlap", "WITH d AS (SELECT doc_id, source, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 5)) AS w FROM documents), b AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 5)) AS w FROM benchmark) SELECT item_id, count(*) AS supported FROM b JOIN d ON len(list_intersect(b.w, d.w)) >= 2 GROUP BY item_id")
def _(t):
    d = t.documents.select("doc_id", F.explode(distinctive(F.col("text"))).alias("w"))
    b = t.benchmark.select("item_id", F.explode(distinctive(F.col("text"))).alias("w"))
    pairs = d.join(b, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).where("n >= 2")
    return pairs.groupBy("item_id").agg(F.count("*").alias("supported"))


@query("N16_pitch_alignment", "WITH x AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(lower(substr(text, 1, CAST(5 + item_id * 13 % 200 AS INT))), '[a-z]+'), lambda w: regexp_replace(w, '^([a-z]{4,})(?:ly|ing)$', '\\1'))) AS a, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: regexp_replace(w, '^([a-z]{4,})(?:ly|ing)$', '\\1'))) AS b FROM benchmark) SELECT item_id, len(list_intersect(a, b)) / greatest(len(b), 1) >= 0.3 AS aligned, len(a) AS n FROM x")
def _(t):
    stems = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0), X.stem))
    x = t.benchmark.select("item_id", stems(F.left("text", 5 + F.col("item_id") * 13 % 200)).alias("a"), stems(F.col("text")).alias("b"))
    return x.select("item_id", (F.size(F.array_intersect("a", "b")) / F.greatest(F.size("b"), F.lit(1)) >= 0.3).alias("aligned"), F.size("a").cast("long").alias("n"))


@query("N18_bigrams", "WITH x AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3) AS w FROM benchmark) SELECT item_id, len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS n FROM x")
def _(t):
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), lambda x: F.length(x) >= 3)
    x = t.benchmark.select("item_id", w.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
    return x.select("item_id", F.size(F.array_distinct(pairs)).cast("long").alias("n"))


@query("N19_ungrounded_numbers", "SELECT doc_id, len(list_filter(list_distinct(list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.])([0-9]{1,6})\\b', 1), lambda x: CAST(x AS DOUBLE))), lambda n: NOT (abs(n - 100) <= 0.5 OR abs(n - n_chars) <= 0.5))) AS n FROM documents")
def _(t):
    nums = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9_.])([0-9]{1,6})\b"), 1), lambda x: x.cast("double")))
    allowed = F.array(F.lit(100.0), F.col("n_chars").cast("double"))
    return t.documents.select("doc_id", F.size(F.filter(nums, lambda n: ~F.exists(allowed, lambda a: F.abs(n - a) <= 0.5))).cast("long").alias("n"))


@query("N21_percentage_bucket", "SELECT user_id, ('0x' || substr(sha256(user_id || '::beta'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 AS enabled FROM (SELECT DISTINCT user_id FROM events)")
def _(t):
    share = F.conv(F.substring(F.sha2(F.concat(F.col("user_id").cast("string"), F.lit("::beta")), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return t.events.select("user_id").distinct().select("user_id", (share < 0.3).alias("enabled"))


def accumulated(seen: DataFrame, key: str, example: str, noise: Column, store: DataFrame | None = None) -> DataFrame:
    """Candidates (key, n, example) after another batch: counts add up, the first example stays, noise names are dropped."""
    new = seen.where(~noise).groupBy(key).agg(F.count("*").alias("n"), F.min(example).alias("example"))
    if store is None:
        return new
    both = store.select(key, F.col("n").alias("n_"), F.col("example").alias("example_")).join(new, key, "full")
    return both.select(key, (F.coalesce("n_", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("example_", "example").alias("example"))


@query("N22_candidates", "SELECT p_brand, count(*) AS n, min(p_name) AS example FROM part WHERE p_name NOT LIKE 'small%' GROUP BY p_brand")
def _(t):
    return accumulated(t.part, "p_brand", "p_name", F.col("p_name").like("small%"))


def direct_only(packages: DataFrame, manifests: DataFrame, ecosystem: str, name: str) -> DataFrame:
    """Packages with ``direct``: named in a manifest of their ecosystem, or their ecosystem has no manifest at all."""
    named = manifests.select(ecosystem, name).distinct().withColumn("named_", F.lit(True))
    known = manifests.select(ecosystem).distinct().withColumn("known_", F.lit(True))
    found = packages.join(named, [ecosystem, name], "left").join(known, ecosystem, "left")
    return found.withColumn("direct", F.col("known_").isNull() | F.coalesce("named_", F.lit(False))).drop("named_", "known_")


@query("N23_direct_dependencies", "SELECT p_partkey, p_type NOT IN ('PROMO', 'SMALL') OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) AS direct FROM part")
def _(t):
    manifests = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct().join(t.part, "p_partkey").where("p_type in ('PROMO', 'SMALL')")
    return direct_only(t.part, manifests, "p_type", "p_partkey").select("p_partkey", "direct")


#: What evidence of each tier is worth.
TIER_WEIGHTS = {1: 3, 2: 2, 3: 1}


def themes(rows: DataFrame, theme: str, tier: Column, most: int = 4) -> DataFrame:
    """The themes of most weighted evidence, by score, then name; an unknown tier is worth nothing."""
    weight = F.lit(0)
    for k, w in TIER_WEIGHTS.items():
        weight = F.when(tier == k, w).otherwise(weight)
    return rows.groupBy(F.col(theme).alias("theme")).agg(F.sum(weight).alias("score")).orderBy(F.desc("score"), "theme").limit(most)


@query("N25_themes", "SELECT theme, score FROM (SELECT p_type AS theme, sum(CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 ELSE 1 END) AS score FROM part GROUP BY p_type) x ORDER BY score DESC, theme LIMIT 4")
def _(t):
    return themes(t.part, "p_type", F.when(F.col("p_size") >= 40, 1).when(F.col("p_size") >= 20, 2).otherwise(3))


@query("N27_recency_key", "WITH x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]{4}'), lambda y: CAST(y AS BIGINT)) AS ys FROM documents) SELECT doc_id, CASE WHEN len(ys) > 0 THEN list_max(ys) ELSE -1 END AS recency FROM x")
def _(t):
    ys = F.transform(F.regexp_extract_all("text", F.lit("[0-9]{4}"), 0), lambda y: y.cast("long"))
    return t.documents.select("doc_id", F.coalesce(F.array_max(ys), F.lit(-1)).cast("long").alias("recency"))


@query("N28_list_union", "SELECT user_id, string_agg(w, ',' ORDER BY pos) AS joined FROM (SELECT user_id, lower(event_type) AS w, min(event_id) AS pos FROM events GROUP BY 1, 2) GROUP BY user_id")
def _(t):
    first = t.events.groupBy("user_id", F.lower("event_type").alias("w")).agg(F.min("event_id").alias("pos"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]), ",").alias("joined"))


def degree_verdict(held: Column, wanted: Column, field: Column, required: Column) -> Column:
    """Verified with the level and field, partial with the level or one below it, else a gap, hard where the degree is required."""
    enough = F.coalesce(held >= wanted, F.lit(False))
    near = F.coalesce(held >= wanted - 1, F.lit(False))
    return F.when(enough & F.coalesce(field, F.lit(False)), "verified").when(enough | near, "partial").when(required, "gap_hard").otherwise("gap_soft")


@query("N29_degree_rules", "SELECT c_custkey, CASE WHEN floor(c_acctbal / 2500) >= 3 AND c_nationkey % 2 = 0 THEN 'verified' WHEN floor(c_acctbal / 2500) >= 2 THEN 'partial' WHEN c_mktsegment <> 'MACHINERY' THEN 'gap_hard' ELSE 'gap_soft' END AS verdict FROM customer")
def _(t):
    c = F.col
    held = F.floor(c("c_acctbal") / 2500)
    return t.customer.select("c_custkey", degree_verdict(held, F.lit(3), c("c_nationkey") % 2 == 0, c("c_mktsegment") != "MACHINERY").alias("verdict"))


def metric_checks(samples: DataFrame, key: str, order: list[str], value: str, least: float) -> DataFrame:
    """Each sample's difference from the one before, whether it is ``least`` or more, and whether the scrape repeats the one before."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    delta = F.col(value) - before
    return samples.withColumn("delta", delta).withColumn("moved", F.coalesce(F.col("delta") >= least, F.lit(False))).withColumn("repeated", F.coalesce(F.col("delta") == 0, F.lit(False)))


@query("N31_metric_deltas", "SELECT user_id, event_id, value - lag(value) OVER w AS delta, COALESCE(value - lag(value) OVER w >= 10, FALSE) AS moved FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    return metric_checks(t.events.where("event_type = 'purchase'"), "user_id", ["ts", "event_id"], "value", 10).select("user_id", "event_id", "delta", "moved")


def life_stage(rows: DataFrame, key: str, level: Column, override: Column | None = None) -> DataFrame:
    """The highest level of each key; an override of any row wins."""
    best = rows.groupBy(key).agg(F.max(level).alias("stage"), F.max(F.lit(None).cast("int") if override is None else override).alias("set_"))
    return best.select(key, F.coalesce("set_", "stage").alias("stage"))


@query("N32_life_stage", "SELECT c_nationkey, COALESCE(max(CASE WHEN c_custkey = 1 THEN 0 END), max(CASE WHEN c_acctbal > 9000 THEN 3 WHEN c_acctbal > 5000 THEN 2 ELSE 1 END)) AS stage FROM customer GROUP BY c_nationkey")
def _(t):
    level = F.when(F.col("c_acctbal") > 9000, 3).when(F.col("c_acctbal") > 5000, 2).otherwise(1)
    return life_stage(t.customer, "c_nationkey", level, F.when(F.col("c_custkey") == 1, 0))


