"""Quality and evaluation aggregates, ontology and graph operators, provenance ledgers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import tokens
from ..registry import plain, query
from .graphs import connected_components

# -- evaluation -----------------------------------------------------------------


def stratified_sample(rows: DataFrame, stratum: str, key: Column, k: int, seed: str) -> DataFrame:
    """K rows, round-robin over strata, each in the order of the first 8 hex digits of SHA-256 of seed and key."""
    order = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), 1, 8), 16, 10).cast("long")
    ranked = rows.withColumn("order_", order).withColumn("turn_", F.row_number().over(W.partitionBy(stratum).orderBy("order_", key))).where(F.col("turn_") <= k)
    return ranked.orderBy("turn_", stratum).limit(k).drop("order_", "turn_")


@query("E1_stratified_sample", "WITH o AS (SELECT doc_id, source, ('0x' || substr(sha256('s1:' || doc_id), 1, 8))::BIGINT AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, CAST(doc_id AS VARCHAR)) AS turn FROM o) SELECT doc_id FROM r ORDER BY turn, source LIMIT 45")
def _(t):
    return stratified_sample(t.documents.select("doc_id", "source"), "source", F.col("doc_id").cast("string"), 45, "s1").select("doc_id")


def rank_match(results: DataFrame, expected: DataFrame) -> DataFrame:
    """For each of ``expected`` (qid, id) the rank of its id among ``results`` (qid, id, rank), null if it is not there."""
    return expected.join(results.groupBy("qid", "id").agg(F.min("rank").alias("rank")), ["qid", "id"], "left")


def probe_score(ranks: DataFrame, group: list[str], k: int = 3) -> DataFrame:
    """recall@k, mean reciprocal rank and round2(0.6 recall + 0.4 mrr) over rows with a nullable ``rank``; 0 without rows."""
    hit = F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    mrr = F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)))
    return ranks.groupBy(*group).agg(F.round(F.coalesce(hit, F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(mrr, F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.lit(0.6) * hit + F.lit(0.4) * mrr, F.lit(0.0)), 2).alias("score"))


_RANKS = "WITH res AS (SELECT label AS qid, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings WHERE vec_id % 2 = 0), want AS (SELECT label AS qid, vec_id AS id FROM embeddings WHERE vec_id % 50 = 0), m AS (SELECT w.qid, w.id, r.rank FROM want w LEFT JOIN res r USING (qid, id)) "


def _matches(t) -> DataFrame:
    res = t.embeddings.where("vec_id % 2 = 0").select(F.col("label").alias("qid"), F.col("vec_id").alias("id"), F.row_number().over(W.partitionBy("label").orderBy("vec_id")).alias("rank"))
    return rank_match(res, t.embeddings.where("vec_id % 50 = 0").select(F.col("label").alias("qid"), F.col("vec_id").alias("id")))


@query("E2_rank_match", _RANKS + "SELECT qid, id, rank FROM m")
def _(t):
    return _matches(t)


@query("E3_probe_score", _RANKS + "SELECT qid, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall, round(avg(COALESCE(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(0.6::DOUBLE * avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 0.4::DOUBLE * avg(COALESCE(1.0::DOUBLE / rank, 0)), 2) AS score FROM m GROUP BY qid")
def _(t):
    return probe_score(_matches(t), ["qid"])


#: The six factors of a knowledge base's quality and their weights.
KB_WEIGHTS = {"chunks": 0.15, "length": 0.10, "readme": 0.20, "tags": 0.15, "weeks": 0.20, "skills": 0.20}


def kb_quality(factors: DataFrame, group: str) -> DataFrame:
    """Each factor (0 to 1) times its weight in percent is rounded to two digits, then the sum is."""
    parts = [F.round(F.col(k) * F.lit(100 * w), 2) for k, w in KB_WEIGHTS.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return factors.select(group, *[p.alias(k) for p, k in zip(parts, KB_WEIGHTS)], F.round(total, 2).alias("score"))


@query(
    "E4_kb_quality",
    """WITH f AS (SELECT source, least(1, count(*) / 100.0::DOUBLE) AS chunks, CASE WHEN avg(n_chars) < 200 THEN avg(n_chars) / 200 WHEN avg(n_chars) <= 2000 THEN 1.0::DOUBLE ELSE greatest(0, 1 - (avg(n_chars) - 2000) / 8000) END AS length,
    CASE WHEN bool_or(contains(lower(text), 'licen')) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS readme, least(1, count(DISTINCT lang) / 5.0::DOUBLE) AS tags, least(1, count(DISTINCT doc_id % 7) / 10.0::DOUBLE) AS weeks, least(1, count(DISTINCT n_chars % 40) / 30.0::DOUBLE) AS skills FROM documents GROUP BY source),
    p AS (SELECT source, round(chunks * 15.0::DOUBLE, 2) AS chunks, round(length * 10.0::DOUBLE, 2) AS length, round(readme * 20.0::DOUBLE, 2) AS readme, round(tags * 15.0::DOUBLE, 2) AS tags, round(weeks * 20.0::DOUBLE, 2) AS weeks, round(skills * 20.0::DOUBLE, 2) AS skills FROM f) SELECT *, round(chunks + length + readme + tags + weeks + skills, 2) AS score FROM p""",
)
def _(t):
    cap = lambda x, most: F.least(F.lit(1.0), x / F.lit(float(most)))
    mean = F.avg("n_chars")
    f = t.documents.groupBy("source").agg(
        cap(F.count("*"), 100).alias("chunks"),
        F.when(mean < 200, mean / 200).when(mean <= 2000, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (mean - 2000) / 8000)).alias("length"),
        F.when(F.bool_or(F.contains(F.lower("text"), F.lit("licen"))), 1.0).otherwise(0.0).alias("readme"),
        cap(F.countDistinct("lang"), 5).alias("tags"),
        cap(F.countDistinct(F.col("doc_id") % 7), 10).alias("weeks"),
        cap(F.countDistinct(F.col("n_chars") % 40), 30).alias("skills"),
    )
    return kb_quality(f, "source")


def suggestions(factors: DataFrame, key: str, rules: list[tuple[str, str, float]]) -> DataFrame:
    """E5: (key, hints): what would help, in the order of ``rules`` (hint, factor, below which value it is due); an unknown factor calls for nothing."""
    due = F.array_compact(F.array(*[F.when(F.col(factor) < least, hint) for hint, factor, least in rules]))
    return factors.select(key, F.array_join(due, ",").alias("hints"))


@query("E5_suggestions", "SELECT source, concat_ws(',', CASE WHEN count(*) < 51 THEN 'add_chunks' END, CASE WHEN avg(n_chars) > 2400 THEN 'shorten' END, CASE WHEN count(DISTINCT lang) < 4 THEN 'add_tags' END) AS hints FROM documents GROUP BY source")
def _(t):
    factors = t.documents.groupBy("source").agg(F.count("*").alias("chunks"), (-F.avg("n_chars")).alias("brevity"), F.countDistinct("lang").alias("tags"))
    return suggestions(factors, "source", [("add_chunks", "chunks", 51), ("shorten", "brevity", -2400), ("add_tags", "tags", 4)])


def shares(rows: DataFrame, by: str, kind: str, weight: Column) -> DataFrame:
    """(by, kind, repos, weight, share): rows and weight of each kind (a missing one is unknown) of a group, and its share of the group's weight in percent, 0 where there
    is none."""
    named = F.when(F.length(kind) > 0, F.col(kind)).otherwise("unknown")
    each = rows.groupBy(by, named.alias(kind)).agg(F.count("*").alias("repos"), F.sum(F.coalesce(weight, F.lit(0))).alias("weight"))
    total = F.sum("weight").over(W.partitionBy(by))
    return each.withColumn("share", F.when(total > 0, F.round(F.lit(100.0) * F.col("weight") / total, 2)).otherwise(F.lit(0.0)))


def counted(rows: DataFrame, by: str, kind: str, name: str) -> DataFrame:
    """(by, name): ``kind:n`` of the kinds that a group's rows have, most rows first, then by name."""
    n = rows.where(F.length(kind) > 0).groupBy(by, F.col(kind).alias("kind_")).agg(F.count("*").alias("n_"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n_")).alias("n"), F.col("kind_").alias("k"))))
    return n.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["k"], -x["n"])), ",").alias(name))


def profile_rollup(repos: DataFrame, user: str = "user") -> DataFrame:
    """A row for each user of (user, repo, language, commits, domain, complexity, role, techs, active, class, hidden, completed): over its finished, visible projects the languages by
    commits with their shares, domains and the dominant one, complexities, roles, technologies, first and last activity and the years (of 365.25 days) between them; over all rows the
    classes and how many are hidden. Each part is one aggregation, so a user's repositories are never in one list."""
    mine = repos.where("class = 'project' and not coalesce(hidden, false) and coalesce(completed, false)")
    langs = shares(mine, user, "language", F.col("commits"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("language").alias("k"), "share")))
    langs = langs.groupBy(user).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["k"], F.format_string("%.2f", x["share"]))), ",").alias("languages"))
    totals = mine.groupBy(user).agg(F.count("*").alias("projects"), F.sum(F.coalesce("commits", F.lit(0))).alias("commits"), F.min("active").alias("first_at"), F.max("active").alias("last_at"), F.count("active").alias("dated_"))
    years = F.when(F.col("dated_") > 1, F.round(F.datediff("last_at", "first_at") / F.lit(365.25), 1)).otherwise(F.lit(0.0))
    techs = mine.select(user, F.explode(F.array_distinct("techs")).alias("tech"))
    parts = [langs, *(counted(mine, user, c, n) for c, n in (("domain", "domains"), ("complexity", "complexities"), ("role", "roles"))), counted(techs, user, "tech", "technologies"), counted(repos, user, "class", "classes"), totals.withColumn("years", years).drop("dated_")]
    out = repos.groupBy(user).agg(F.count_if("hidden").alias("hidden"))
    for part in parts:
        out = out.join(part, user, "left")
    return out.withColumn("dominant", F.split_part("domains", F.lit(":"), F.lit(1))).na.fill(0, ["projects", "commits"])


_REPOS = """SELECT c_nationkey AS "user", c_custkey AS repo, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS language, n AS commits, CASE c_custkey % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'data' WHEN 2 THEN 'infra' WHEN 3 THEN '' END AS domain,
    CASE WHEN n > 12 THEN 'complex' WHEN n > 8 THEN 'moderate' ELSE 'simple' END AS complexity, CASE WHEN c_acctbal > 3000 THEN 'creator' ELSE 'contributor' END AS role, last AS active,
    CASE WHEN c_custkey % 6 = 0 THEN 'fork' ELSE 'project' END AS class, c_custkey % 7 = 0 AS hidden, c_custkey % 10 <> 3 AS completed FROM customer JOIN (SELECT o_custkey, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY 1) o ON o_custkey = c_custkey"""


def _counted_sql(rows: str, kind: str) -> str:
    return f"""(SELECT "user", string_agg(k || ':' || n, ',' ORDER BY n DESC, k) AS said FROM (SELECT "user", {kind} AS k, count(*) AS n FROM {rows} WHERE length({kind}) > 0 GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "E6_profile_rollup",
    f"""WITH r AS ({_REPOS}), m AS (SELECT * FROM r WHERE class = 'project' AND NOT hidden AND completed), t AS (SELECT DISTINCT "user", repo, unnest([complexity, role, 'sql']) AS tech FROM m),
    l AS (SELECT "user", COALESCE(language, 'unknown') AS k, sum(commits) AS w FROM m GROUP BY 1, 2), s AS (SELECT *, round(100.0::DOUBLE * w / sum(w) OVER (PARTITION BY "user"), 2) AS share FROM l),
    a AS (SELECT "user", count(*) AS projects, CAST(sum(commits) AS BIGINT) AS commits, min(active) AS first_at, max(active) AS last_at, CASE WHEN count(*) > 1 THEN round(date_diff('day', min(active), max(active)) / 365.25::DOUBLE, 1) ELSE 0.0 END AS years FROM m GROUP BY 1)
    SELECT u."user", u.hidden, g.said AS languages, d.said AS domains, x.said AS complexities, o.said AS roles, e.said AS technologies, c.said AS classes, a.projects, a.commits, a.first_at, a.last_at, a.years, split_part(d.said, ':', 1) AS dominant
    FROM (SELECT "user", count(*) FILTER (WHERE hidden) AS hidden FROM r GROUP BY 1) u LEFT JOIN a USING ("user") LEFT JOIN (SELECT "user", string_agg(k || ':' || printf('%.2f', share), ',' ORDER BY w DESC, k) AS said FROM s GROUP BY 1) g USING ("user")
    LEFT JOIN {_counted_sql("m", "domain")} d USING ("user") LEFT JOIN {_counted_sql("m", "complexity")} x USING ("user") LEFT JOIN {_counted_sql("m", "role")} o USING ("user") LEFT JOIN {_counted_sql("t", "tech")} e USING ("user") LEFT JOIN {_counted_sql("r", "class")} c USING ("user")""",
)
def _(t):
    repos = t.spark.sql(_REPOS.replace('"', "`").replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}"), customer=t.customer, orders=t.orders)
    return profile_rollup(repos.withColumn("techs", F.array("complexity", "role", F.lit("sql"))))


def points(*parts: tuple[Column, int]) -> Column:
    """What the parts that hold are worth together, 0 to 100."""
    total = F.lit(0)
    for holds, worth in parts:
        total = total + F.when(holds, worth).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), total))


def profile_depth(languages: Column, repos: Column, mirror: Column, reveals: Column) -> Column:
    """Up to 60 for three languages, 20 for ten repositories, 10 each for a mirror and reveals."""
    return F.least(F.lit(60), F.greatest(languages, F.lit(0)) * 20) + F.round(F.least(F.lit(10), F.greatest(repos, F.lit(0))) * 2).cast("int") + points((mirror, 10), (reveals, 10))


def rag_depth(high: Column, repos: Column, retrieval: Column) -> Column:
    """Up to 60 for the share of repositories of high quality, 40 for the retrieval score (null: none)."""
    share = F.coalesce(F.try_divide(high, repos), F.lit(0.0))
    return F.least(F.lit(60), F.round(share * 60)).cast("int") + F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(retrieval, F.lit(0.0)))) * 40).cast("int")


def alignment(resume: Column, unsupported: Column) -> Column:
    """0 without a resume, 50 before it was compared, else 10 less for each unsupported claim, 80 at most."""
    return F.when(~F.coalesce(resume, F.lit(False)), 0).when(unsupported.isNull(), 50).otherwise(100 - F.least(F.lit(80), unsupported * 10)).cast("int")


def whole_mean(value: Column) -> Column:
    """The mean of doubles, rounded down. Their decimal forms are added exactly, so the order of rows cannot push a mean that is a whole number below it; values that
    have none (infinite, not a number, over 10^28) are averaged as doubles."""
    exact = value.try_cast("decimal(38, 10)")
    mean = F.when(F.count(exact) == F.count(value), F.try_sum(exact)).otherwise(None) / F.count(value)
    return F.coalesce(F.floor(mean).cast("int"), F.floor(F.avg(value)).cast("int"))


def diagnostic(*components: Column) -> Column:
    """Five components of 0 to 100, each worth 20."""
    total = components[0]
    for c in components[1:]:
        total = total + c
    return F.round(total * 20 / F.lit(100.0)).cast("int")


def blockers(*rules: tuple[Column, str], most: int = 2) -> Column:
    """What holds a component back, the first ``most`` that apply."""
    return F.slice(F.array_compact(F.array(*[F.when(holds, F.lit(said)) for holds, said in rules])), 1, most)


@query("E7_diagnostic", "WITH x AS (SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n, CAST(floor(avg(value)) AS INT) AS v, count(*) FILTER (WHERE value > 60) AS high FROM events GROUP BY 1), p AS (SELECT user_id, kinds, n, least(60, greatest(kinds - 3, 0) * 20) + least(10, n % 12) * 2 + CASE WHEN n % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN v > 50 THEN 10 ELSE 0 END AS a, least(60, round(high / n * 60)) + round(least(1.0::DOUBLE, v / 100.0::DOUBLE) * 40) AS b, CASE WHEN n > 60 THEN 60 ELSE 0 END + CASE WHEN v % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN kinds >= 3 THEN 20 ELSE 0 END AS c, CASE WHEN n % 5 = 0 THEN 0 WHEN n % 3 = 0 THEN 50 ELSE 100 - least(80, n % 12 * 10) END AS d, CASE WHEN n >= 50 THEN 25 ELSE 0 END + CASE WHEN n >= 70 THEN 25 ELSE 0 END + CASE WHEN kinds >= 1 THEN 25 ELSE 0 END + CASE WHEN v >= 45 THEN 25 ELSE 0 END AS e FROM x) SELECT user_id, CAST(round((a + b + c + d + e) * 20 / 100.0::DOUBLE) AS INT) AS overall, array_to_string(list_slice(list_filter([CASE WHEN kinds < 5 THEN 'languages' END, CASE WHEN n % 12 < 3 THEN 'repos' END, CASE WHEN n % 2 <> 0 THEN 'mirror' END], lambda s: s IS NOT NULL), 1, 2), ',') AS blockers FROM p")
def _(t):
    n, v = F.count("*"), whole_mean(F.col("value"))
    x = t.events.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), n.alias("n"), v.alias("v"), F.count_if(F.col("value") > 60).alias("high"))
    c = F.col
    depth = profile_depth(c("kinds") - 3, c("n") % 12, c("n") % 2 == 0, c("v") > 50)
    rag = rag_depth(c("high"), c("n"), c("v") / 100.0)
    direction = points((c("n") > 60, 60), (c("v") % 2 == 0, 20), (c("kinds") >= 3, 20))
    aligned = alignment(c("n") % 5 != 0, F.when(c("n") % 3 != 0, c("n") % 12))
    resume = points((c("n") >= 50, 25), (c("n") >= 70, 25), (c("kinds") >= 1, 25), (c("v") >= 45, 25))
    why = blockers((c("kinds") < 5, "languages"), (c("n") % 12 < 3, "repos"), (c("n") % 2 != 0, "mirror"))
    return x.select("user_id", diagnostic(depth, rag, direction, aligned, resume).alias("overall"), F.array_join(why, ",").alias("blockers"))


#: What completes a profile, and how much each part is worth.
COMPLETENESS = {"readme": 0.25, "manifest": 0.20, "ci": 0.15, "changelog": 0.10, "tests": 0.10, "commits": 0.10, "confidence": 0.10}


def completeness(**parts: Column) -> Column:
    """The sum of the weights of the parts that hold; a part that is not given or null does not."""
    unknown = set(parts) - set(COMPLETENESS)
    if unknown:
        raise ValueError(f"no such parts: {sorted(unknown)}")
    total = F.lit(0.0)
    for name, holds in parts.items():
        total = total + F.when(holds, COMPLETENESS[name]).otherwise(0.0)
    return F.round(total, 10)


@query("E8_completeness", "SELECT c_custkey, CAST((CASE WHEN c_acctbal > 0 THEN 25 ELSE 0 END + CASE WHEN c_mktsegment IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN c_nationkey < 15 THEN 15 ELSE 0 END + CASE WHEN c_name LIKE '%7' THEN 10 ELSE 0 END) AS DOUBLE) / 100 AS score FROM customer")
def _(t):
    c = F.col
    return t.customer.select("c_custkey", completeness(readme=c("c_acctbal") > 0, manifest=c("c_mktsegment").isNotNull(), ci=c("c_nationkey") < 15, commits=c("c_name").like("%7")).alias("score"))


def repo_class(fork: Column, commits: Column, name: Column, years_since_push: Column, readme: Column, manifests: Column, practice: str = "(?i)tutorial|exercise|course|example|test-") -> Column:
    """The first rule that holds: fork, abandoned, tutorial (a name that ``practice`` matches), stale (no push counts as long ago), noise, else project."""
    years = F.coalesce(years_since_push, F.lit(float("inf")))
    empty = ~F.coalesce(readme, F.lit(False)) & (commits < 10) & (manifests == 0)
    rules = F.when(fork & (commits < 5), "fork").when(commits < 3, "abandoned").when(name.rlike(practice), "tutorial")
    return rules.when(years > 5, "stale").when(empty, "noise").otherwise("project")


@query("E9_repo_class", "WITH r AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 AND n < 5 THEN 'fork' WHEN n < 3 THEN 'abandoned' WHEN o_custkey % 11 = 0 THEN 'tutorial' WHEN date_diff('day', CAST(last AS DATE), DATE '2004-01-01') / 365.0 > 5 THEN 'stale' WHEN p = 0 AND n < 10 AND o_custkey % 2 = 0 THEN 'noise' ELSE 'project' END AS class FROM r")
def _(t):
    r = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    years = F.datediff(F.lit("2004-01-01").cast("date"), F.col("last").cast("date")) / F.lit(365.0)
    name = F.when(F.col("o_custkey") % 11 == 0, "play/test-repo").otherwise("own/repo")
    return r.select("o_custkey", repo_class(F.col("o_custkey") % 3 == 0, F.col("n"), name, years, F.col("p") > 0, F.col("o_custkey") % 2).alias("class"))


def authorship(commit_share: Column, contributor_share: Column) -> Column:
    """The role by the larger of two shares; a share that is not known counts as 0."""
    share = F.greatest(F.coalesce(commit_share, F.lit(0.0)), F.coalesce(contributor_share, F.lit(0.0)))
    return F.when(share >= 0.6, "owner").when(share >= 0.2, "contributor").otherwise("minor")


def collaboration(people: Column) -> Column:
    """Solo, team (up to 4) or open."""
    return F.when(people <= 1, "solo").when(people <= 4, "team").otherwise("open")


@query("E10_authorship", "SELECT l_orderkey, CASE WHEN share >= 0.6 THEN 'owner' WHEN share >= 0.2 THEN 'contributor' ELSE 'minor' END AS role, CASE WHEN n = 1 THEN 'solo' WHEN n <= 4 THEN 'team' ELSE 'open' END AS collaboration FROM (SELECT l_orderkey, greatest(count(*) FILTER (WHERE l_returnflag = 'A'), count(*) FILTER (WHERE l_linestatus = 'O'))::DOUBLE / count(*) AS share, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey) x")
def _(t):
    x = t.lineitem.groupBy("l_orderkey").agg((F.count_if(F.col("l_returnflag") == "A") / F.count("*")).alias("a"), (F.count_if(F.col("l_linestatus") == "O") / F.count("*")).alias("b"), F.countDistinct("l_linenumber").alias("n"))
    return x.select("l_orderkey", authorship(F.col("a"), F.col("b")).alias("role"), collaboration(F.col("n")).alias("collaboration"))


def set_scores(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Macro recall and precision over rows of two arrays; 1 where the divisor is empty; and how many were dropped or added."""
    both = F.size(F.array_intersect(truth, found))
    part = lambda c: F.when(F.size(c) > 0, both / F.size(c)).otherwise(F.lit(1.0))
    return rows.agg(F.round(F.avg(part(truth)), 6).alias("recall"), F.round(F.avg(part(found)), 6).alias("precision"), F.sum(F.size(F.array_except(truth, found))).cast("long").alias("dropped"), F.sum(F.size(F.array_except(found, truth))).cast("long").alias("added"))


@query(
    "E11_enrichment_eval",
    "WITH x AS (SELECT list_distinct(regexp_extract_all(lower(substr(text, 1, 200)), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(substr(text, 100, 200)), '[a-z]+')) AS b FROM documents) SELECT round(avg(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 1 END), 6) AS recall, round(avg(CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 1 END), 6) AS precision, sum(len(a) - len(list_intersect(a, b)))::BIGINT AS dropped, sum(len(b) - len(list_intersect(a, b)))::BIGINT AS added FROM x",
)
def _(t):
    bag = lambda a, n: F.array_distinct(F.regexp_extract_all(F.lower(F.substring("text", a, n)), F.lit("[a-z]+"), 0))
    return set_scores(t.documents.select(bag(1, 200).alias("a"), bag(100, 200).alias("b")), "a", "b")


def resolution_eval(rows: DataFrame, expected: str, resolved: str) -> DataFrame:
    """Positives, negatives (nothing expected), recall, precision and the share of negatives that were merged; a rate of nothing is 0."""
    e, r = F.col(expected), F.col(resolved)
    rate = lambda hit, all_: F.round(F.coalesce(F.try_divide(F.count_if(hit), F.count_if(all_)), F.lit(0.0)), 6)
    return rows.agg(
        F.count_if(e.isNotNull()).alias("positives"), F.count_if(e.isNull()).alias("negatives"), rate(e.isNotNull() & r.eqNullSafe(e), e.isNotNull()).alias("recall"),
        rate(r.isNotNull() & e.eqNullSafe(r), r.isNotNull()).alias("precision"), rate(e.isNull() & r.isNotNull(), e.isNull()).alias("false_merges"),
    )


@query("E13_resolution_eval", "WITH x AS (SELECT CASE WHEN p_size > 5 THEN p_brand END AS e, CASE p_partkey % 4 WHEN 0 THEN 'Brand#11' WHEN 1 THEN p_brand WHEN 2 THEN p_brand END AS r FROM part) SELECT count(e) AS positives, count(*) - count(e) AS negatives, round(sum(CASE WHEN e = r THEN 1.0::DOUBLE ELSE 0 END) / count(e), 6) AS recall, round(sum(CASE WHEN e = r THEN 1.0::DOUBLE ELSE 0 END) / count(r), 6) AS precision, round(sum(CASE WHEN e IS NULL AND r IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) / sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END), 6) AS false_merges FROM x")
def _(t):
    expected = F.when(F.col("p_size") > 5, F.col("p_brand"))
    resolved = F.when(F.col("p_partkey") % 4 == 0, "Brand#11").when(F.col("p_partkey") % 4 < 3, F.col("p_brand"))
    return resolution_eval(t.part.select(expected.alias("e"), resolved.alias("r")), "e", "r")


def rag_recall(wanted: DataFrame, retrieved: DataFrame, case: str = "qid") -> DataFrame:
    """For each case (case, wanted) the share of its wanted sources that occur in one of its retrieved ones (case, source), in any case; 0 where nothing was
    retrieved."""
    found = retrieved.groupBy(case).agg(F.collect_set(F.lower("source")).alias("sources_"))
    hit = F.exists(F.coalesce("sources_", F.array().cast("array<string>")), lambda s: F.contains(s, F.lower("wanted")))
    return wanted.join(found, case, "left").groupBy(case).agg(F.round(F.avg(hit.cast("double")), 6).alias("recall"))


@query("E14_rag_eval", "WITH s AS (SELECT label AS qid, list(lower('kb/' || vec_id || '/doc')) AS sources FROM embeddings WHERE (vec_id + label) % 3 <> 0 GROUP BY label), e AS (SELECT label AS qid, list('KB/' || vec_id || '/') AS wanted FROM embeddings WHERE vec_id % 7 = 0 GROUP BY label) SELECT qid, round(len(list_filter(wanted, lambda w: len(list_filter(sources, lambda s: contains(s, lower(w)))) > 0)) / len(wanted), 6) AS recall FROM e JOIN s USING (qid)")
def _(t):
    e = t.embeddings.select(F.col("label").alias("qid"), "vec_id")
    retrieved = e.where("(vec_id + qid) % 3 <> 0").select("qid", F.concat(F.lit("kb/"), "vec_id", F.lit("/doc")).alias("source"))
    return rag_recall(e.where("vec_id % 7 = 0").select("qid", F.concat(F.lit("KB/"), "vec_id", F.lit("/")).alias("wanted")), retrieved)


def parity(wanted: DataFrame, found: DataFrame, group: str, item: str, most: int = 25) -> DataFrame:
    """By group the share of distinct wanted items that are found (1 if nothing is wanted), how many are found alone, and the first
    ``most`` of those in order."""
    a, b = wanted.select(group, item).distinct().withColumn("a_", F.lit(True)), found.select(group, item).distinct().withColumn("b_", F.lit(True))
    both = a.join(b, [group, item], "full")
    n = lambda c: F.count_if(c)
    here, there = F.col("a_").isNotNull(), F.col("b_").isNotNull()
    rates = both.groupBy(group).agg(F.when(n(here) == 0, 1.0).otherwise(F.round(n(here & there) / F.greatest(n(here), F.lit(1)), 6)).alias("recall"), n(there & ~here).alias("only_b"))
    alone = both.where(~here).withColumn("rn_", F.row_number().over(W.partitionBy(group).orderBy(item))).where(F.col("rn_") <= most)
    alone = alone.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("alone"))
    return rates.join(alone, group, "left").withColumn("alone", F.coalesce("alone", F.array().cast(f"array<{wanted.schema[item].dataType.simpleString()}>")))


@query("E15_parity", "WITH a AS (SELECT DISTINCT l_suppkey % 10 AS k, l_suppkey * 1000000 + l_partkey AS item FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey % 10 AS k, l_suppkey * 1000000 + l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT k, item, row_number() OVER (PARTITION BY k ORDER BY item) AS rn FROM (SELECT * FROM b EXCEPT SELECT * FROM a)), g AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE (k, item) IN (SELECT (k, item) FROM b)) AS hit FROM a GROUP BY k), u AS (SELECT DISTINCT k FROM (SELECT k FROM a UNION ALL SELECT k FROM b)) SELECT u.k, COALESCE(round(g.hit / g.n, 6), 1) AS recall, (SELECT count(*) FROM o WHERE o.k = u.k) AS only_b, COALESCE((SELECT string_agg(item::VARCHAR, ',' ORDER BY item) FROM o WHERE o.k = u.k AND rn <= 25), '') AS alone FROM u LEFT JOIN g ON u.k = g.k")
def _(t):
    of = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select((F.col("l_suppkey") % 10).alias("k"), (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("item"))
    return parity(of("A"), of("R"), "k", "item").select("k", "recall", "only_b", F.array_join("alone", ",").alias("alone"))


def percent_change(before: Column, after: Column) -> Column:
    """To two digits, null from 0."""
    return F.when(before != 0, F.round(F.lit(100.0) * (after - before) / before, 2))


def commit_metrics(files: DataFrame, commit: str, added: Column, removed: Column, status: str) -> DataFrame:
    """Files, churn, line delta and files by status of each commit; counts that are not known are 0."""
    a, r = F.coalesce(added, F.lit(0)), F.coalesce(removed, F.lit(0))
    kinds = files.groupBy(commit, status).agg(F.count("*").alias("n"), F.sum(a + r).alias("churn"), F.sum(a - r).alias("loc_delta"))
    return kinds.groupBy(commit).agg(F.sum("n").alias("files"), F.sum("churn").alias("churn"), F.sum("loc_delta").alias("loc_delta"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "n")))).alias("by_status"))


@query("E16_commit_metrics", "SELECT l_orderkey, count(*) AS files, sum(CAST(l_quantity AS BIGINT))::BIGINT AS churn, sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END)::BIGINT AS loc_delta, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F') > 0 THEN round(100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE l_linestatus = 'F')) / count(*) FILTER (WHERE l_linestatus = 'F'), 2) END AS change FROM lineitem GROUP BY l_orderkey")
def _(t):
    n = F.col("l_quantity").cast("long")
    back = F.col("l_returnflag") == "R"
    m = commit_metrics(t.lineitem, "l_orderkey", F.when(~back, n), F.when(back, n), "l_linestatus")
    f = F.coalesce(F.try_element_at("by_status", F.lit("F")), F.lit(0))
    return m.select("l_orderkey", "files", "churn", "loc_delta", percent_change(f, F.col("files") - f + f).alias("change"))


# Words and signs that decide between paths of a program.
DECISIONS = ("if", "elif", "for", "while", "case", "catch", "when")
DECISION_SIGNS = ("&&", "||")


def complexity_delta(patch: Column) -> Column:
    """Decision points on a patch's added lines less those on its removed ones; file headers, hunk marks and context do not count. 0 for a null patch."""
    words = "(?<![A-Za-z0-9_])(?:" + "|".join(DECISIONS) + ")(?![A-Za-z0-9_])"
    rule = F.lit("|".join([words, *map(re.escape, DECISION_SIGNS)]))

    def of(line: Column) -> Column:
        sign = F.when(F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++")), 1).when(F.startswith(line, F.lit("-")) & ~F.startswith(line, F.lit("---")), -1).otherwise(0)
        return F.when(sign != 0, sign * F.regexp_count(F.substr(line, F.lit(2)), rule)).otherwise(F.lit(0))

    return F.coalesce(F.aggregate(F.split(patch, "\n"), F.lit(0), lambda n, line: n + of(line)), F.lit(0)).cast("long")


def file_impact(changes: DataFrame, file: str, added: str, removed: str, patch: str, at: str) -> DataFrame:
    """Changes, lines touched, net lines, complexity delta and last change of each file over its history; patches are counted where they lie."""
    a, r = F.coalesce(F.col(added), F.lit(0)), F.coalesce(F.col(removed), F.lit(0))
    each = changes.select(file, a.alias("a_"), r.alias("r_"), complexity_delta(F.col(patch)).alias("d_"), at)
    return each.groupBy(file).agg(F.count("*").alias("changes"), F.sum(F.col("a_") + F.col("r_")).alias("churn"), F.sum(F.col("a_") - F.col("r_")).alias("net_loc"), F.sum("d_").alias("complexity"), F.max(at).alias("last_at"))


#: A patch out of a text: its lines by turns added, removed, context and headers.
_PATCH = "array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE (doc_id + i) % 5 WHEN 0 THEN '-' WHEN 1 THEN '+' WHEN 2 THEN '+' WHEN 3 THEN ' ' ELSE '+++ ' END || replace(replace(l, ' the ', ' if('), ' of ', ' || ')), chr(10))"


@query(
    "E16_file_impact",
    f"""WITH p AS (SELECT source, doc_id, n_chars, {_PATCH} AS patch FROM documents),
    l AS (SELECT doc_id, unnest(string_split(patch, chr(10))) AS line FROM p),
    d AS (SELECT doc_id, sum(CASE WHEN starts_with(line, '+++') OR starts_with(line, '---') THEN 0 WHEN starts_with(line, '+') THEN 1 WHEN starts_with(line, '-') THEN -1 ELSE 0 END * len(regexp_extract_all(substr(line, 2), '\\b(?:if|elif|for|while|case|catch|when)\\b|&&|[|][|]'))) AS delta FROM l GROUP BY doc_id)
    SELECT source, count(*) AS changes, CAST(sum(n_chars + doc_id % 50) AS BIGINT) AS churn, CAST(sum(n_chars - doc_id % 50) AS BIGINT) AS net_loc, CAST(sum(COALESCE(delta, 0)) AS BIGINT) AS complexity, max(doc_id) AS last_at FROM p LEFT JOIN d USING (doc_id) GROUP BY source""",
)
def _(t):
    def line(x: Column, i: Column) -> Column:
        turn = (F.col("doc_id") + i + 1) % 5
        mark = F.when(turn == 0, "-").when(turn.isin(1, 2), "+").when(turn == 3, " ").otherwise("+++ ")
        return F.concat(mark, F.replace(F.replace(x, F.lit(" the "), F.lit(" if(")), F.lit(" of "), F.lit(" || ")))

    patch = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    changes = t.documents.select("source", F.col("n_chars").alias("added"), (F.col("doc_id") % 50).alias("removed"), patch.alias("patch"), "doc_id")
    return file_impact(changes, "source", "added", "removed", "patch", "doc_id")


def test_signal(source: Column, test: Column) -> Column:
    """How far tests go by test files for each source file: none, light, moderate from 0.2, strong from 0.5."""
    ratio = test / F.greatest(source, F.lit(1))
    return F.when(test == 0, "none").when(ratio >= 0.5, "strong").when(ratio >= 0.2, "moderate").otherwise("light")


def ci_maturity(ci: Column, argocd: Column, manifests: Column, deploys: Column, image: Column) -> Column:
    """None without CI; multi_env with a delivery controller, or manifests and a deployment workflow; deploys_to_prod with a workflow or an image; else basic."""
    ci, argocd, manifests, deploys, image = (F.coalesce(c, F.lit(False)) for c in (ci, argocd, manifests, deploys, image))
    return F.when(~ci, "none").when(argocd | manifests & deploys, "multi_env").when(deploys | image, "deploys_to_prod").otherwise("basic")


def doc_density(docs: Column, site: Column) -> Column:
    """Comprehensive with a documentation site, docs_dir from ten documents, readme_only from one, else none."""
    return F.when(F.coalesce(site, F.lit(False)), "comprehensive").when(docs >= 10, "docs_dir").when(docs > 0, "readme_only").otherwise("none")


def to_step(share: Column, step: int = 5) -> Column:
    """A share in percent, rounded to a step: the nearest whole number of steps, counted in one product as in its SQL (0.575 is 11.5 steps of 5)."""
    return (F.round(share * (100 / step)) * step).cast("long")


def evidence_mix(app: Column, infra: Column) -> Column:
    """The share of application files among those of application and infrastructure in percent, to steps of five; null unless there are both."""
    return F.when((app > 0) & (infra > 0), to_step(app / (app + infra)))


@query(
    "E17_depth_markers",
    """WITH x AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'N') AS source, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber < 1 + l_suppkey % 4) AS test, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linenumber = 7 AND l_suppkey % 2 = 0) AS docs,
      count(*) FILTER (WHERE l_returnflag = 'A' AND l_suppkey % 3 > 0) AS infra FROM lineitem GROUP BY 1)
    SELECT l_suppkey, CASE WHEN test = 0 THEN 'none' WHEN test::DOUBLE / greatest(source, 1) >= 0.5 THEN 'strong' WHEN test::DOUBLE / greatest(source, 1) >= 0.2 THEN 'moderate' ELSE 'light' END AS tests,
      CASE WHEN l_suppkey % 5 = 0 THEN 'none' WHEN l_suppkey % 7 = 0 OR l_suppkey % 2 = 0 AND l_suppkey % 3 = 0 THEN 'multi_env' WHEN l_suppkey % 3 = 0 OR l_suppkey % 11 = 0 THEN 'deploys_to_prod' ELSE 'basic' END AS ci,
      CASE WHEN l_suppkey % 13 = 0 THEN 'comprehensive' WHEN docs >= 10 THEN 'docs_dir' WHEN docs > 0 THEN 'readme_only' ELSE 'none' END AS docs,
      CASE WHEN source + test > 0 AND infra > 0 THEN CAST(round((source + test)::DOUBLE / (source + test + infra) * 20) * 5 AS BIGINT) END AS mix FROM x""",
)
def _(t):
    flag, line, k = F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_suppkey")
    lanes = {"source": flag == "N", "test": (flag == "R") & (line < 1 + k % 4), "docs": (flag == "A") & (line == 7) & (k % 2 == 0), "infra": (flag == "A") & (k % 3 > 0)}
    x = t.lineitem.groupBy("l_suppkey").agg(*[F.count_if(c).alias(n) for n, c in lanes.items()])
    app = F.col("source") + F.col("test")
    return x.select(
        "l_suppkey",
        test_signal(F.col("source"), F.col("test")).alias("tests"),
        ci_maturity(k % 5 != 0, k % 7 == 0, k % 2 == 0, k % 3 == 0, k % 11 == 0).alias("ci"),
        doc_density(F.col("docs"), k % 13 == 0).alias("docs"),
        evidence_mix(app, F.col("infra")).alias("mix"),
    )


def top_areas(rows: DataFrame, repo: str, area: str, per_repo: int, most: int) -> DataFrame:
    """The areas of most rows (fixes), ``per_repo`` of each repository and ``most`` of all."""
    n = rows.groupBy(repo, area).agg(F.count("*").alias("fixes"))
    ranked = n.withColumn("rn_", F.row_number().over(W.partitionBy(repo).orderBy(F.desc("fixes"), area))).where(F.col("rn_") <= per_repo)
    return ranked.drop("rn_").orderBy(F.desc("fixes"), repo, area).limit(most)


@query("E18_difficulty_areas", "SELECT l_suppkey, l_returnflag, fixes FROM (SELECT l_suppkey, l_returnflag, count(*) AS fixes, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2) x WHERE rn <= 2 ORDER BY fixes DESC, l_suppkey, l_returnflag LIMIT 8")
def _(t):
    return top_areas(t.lineitem, "l_suppkey", "l_returnflag", 2, 8)


def token_cost(tokens: Column, model: Column, prices: dict[str, float], default: float) -> Column:
    """Cents for tokens at a price for each 1,000, to six digits; an unknown model has the default price."""
    price = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in prices.items() for x in kv]), model), F.lit(default))
    return F.round(tokens / F.lit(1000.0) * price, 6)


@query("E19_token_cost", "SELECT event_type, round(sum(CAST(floor(value) AS BIGINT)) / CAST(1000 AS DOUBLE) * CASE event_type WHEN 'click' THEN CAST(0.25 AS DOUBLE) WHEN 'purchase' THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END, 6) AS cents FROM events GROUP BY event_type")
def _(t):
    n = t.events.groupBy("event_type").agg(F.sum(F.floor("value").cast("long")).alias("n"))
    return n.select("event_type", token_cost(F.col("n"), F.col("event_type"), {"click": 0.25, "purchase": 1.5}, 0.8).alias("cents"))


@query("E20_canonical_hash", "SELECT p_partkey, sha256(concat_ws('|', p_name, p_brand, 'size=' || p_size || ',type=' || p_type)) AS digest FROM part")
def _(t):
    pairs = F.array_join(F.sort_array(F.array(F.concat(F.lit("type="), "p_type"), F.concat(F.lit("size="), "p_size"))), ",")
    return t.part.select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand", pairs), 256).alias("digest"))


# -- graphs -----------------------------------------------------------------


@query("G4_components")
def _(t):
    e = t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1 + F.col("l_partkey") % 3).alias("b")).distinct()
    return connected_components(e, "a", "b")


def alias_map(aliases: DataFrame, alias: str, canonical: str) -> DataFrame:
    """G1: alias -> canonical, both case-folded, the first canonical where an alias has several."""
    fold = lambda c: F.lower(F.col(c).cast("string")) if dict(aliases.dtypes)[c] == "string" else F.col(c)
    return aliases.groupBy(fold(alias).alias("alias")).agg(F.min(fold(canonical)).alias("canonical"))


@query("G1_alias_map", "SELECT lower(p_name) AS alias, min(p_partkey) AS canonical FROM part GROUP BY lower(p_name)")
def _(t):
    return alias_map(t.part, "p_name", "p_partkey")


@query("G2_canonical_set", "SELECT user_id, string_agg(DISTINCT c, ',' ORDER BY c) AS canonical FROM (SELECT user_id, COALESCE(CASE event_type WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'interaction' END, event_type) AS c FROM events) GROUP BY user_id")
def _(t):
    canon = t.spark.createDataFrame([("click", "interaction"), ("view", "interaction")], "event_type string, canonical string")
    named = t.events.join(F.broadcast(canon), "event_type", "left").withColumn("c", F.coalesce("canonical", "event_type"))
    return named.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("c")), ",").alias("canonical"))


def gap_candidates(gaps: DataFrame, keys: list[str], user: str, value: Column, ts: str) -> DataFrame:
    """How often, for how many users, how strongly in all and when last each gap was met."""
    return gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(user).alias("users"), F.sum(value).alias("cents"), F.max(ts).alias("last_at"))


@query("G3_gap_candidates", "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS phrase, count(*) AS n, count(DISTINCT user_id) AS users, sum(CAST(round(value * 100) AS BIGINT)) AS cents, max(ts) AS last_at FROM events GROUP BY 1, 2")
def _(t):
    e = t.events.withColumn("phrase", F.floor(F.col("value") / 10).cast("long"))
    return gap_candidates(e, ["event_type", "phrase"], "user_id", F.round(F.col("value") * 100).cast("long"), "ts")


def transfer_groups(edges: DataFrame, kind: str, member: str, basis: str) -> DataFrame:
    """Members and the first known basis of each class of typed edges; untyped ones make no group."""
    return edges.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.countDistinct(member).alias("members"), F.min(basis).alias("basis"))


@query("G5_transfer_groups", "SELECT p_brand, count(DISTINCT p_name) AS members, min(p_type) AS basis FROM part GROUP BY p_brand")
def _(t):
    return transfer_groups(t.part, "p_brand", "p_name", "p_type")


def groups_of(rows: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Keys that ``least`` rows or more have, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


@query("G6_category_groups", "SELECT p_type, p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_type, p_brand HAVING count(*) >= 2")
def _(t):
    return groups_of(t.part.where("p_size > 10"), ["p_type", "p_brand"])


def successors(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(predecessor, successor) names of succession edges (old, new) between entries of ``names`` (id, name); an edge to nowhere falls out."""
    old, new = names.select(F.col("id").alias("old"), F.col("name").alias("predecessor")), names.select(F.col("id").alias("new"), F.col("name").alias("successor"))
    return edges.join(old, "old").join(new, "new").select("predecessor", "successor").distinct()


@query("G7_succession", "SELECT a.n_name AS predecessor, b.n_name AS successor FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 AND a.n_regionkey <> b.n_regionkey")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    a, b = n.select(F.col("id").alias("old"), F.col("n_regionkey").alias("r")), n.select((F.col("id") - 1).alias("old"), F.col("id").alias("new"), F.col("n_regionkey").alias("s"))
    return successors(a.join(b, "old").where("r <> s").select("old", "new"), n)


#: Languages by file extension.
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "sql": "sql", "tf": "terraform"}


def language_of(path: Column) -> Column:
    """The language of a path by its extension, null where it has none that is known."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def citations(files: DataFrame) -> DataFrame:
    """(canonical, path) of files (canonical, path) that cite a technology, and of each file its language by extension."""
    return files.select("canonical", "path").union(files.select(language_of(F.col("path")).alias("canonical"), "path").where("canonical is not null")).distinct()


@query("G8_citations", "WITH f AS (SELECT p_brand AS canonical, p_name || ['.ts', '.PY', '.txt', ''][p_size % 4 + 1] AS path FROM part) SELECT canonical, path FROM f UNION SELECT CASE WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'python' END, path FROM f WHERE path LIKE '%.ts' OR path LIKE '%.PY'")
def _(t):
    path = F.concat("p_name", F.element_at(F.array(*[F.lit(x) for x in (".ts", ".PY", ".txt", "")]), (F.col("p_size") % 4 + 1).cast("int")))
    return citations(t.part.select(F.col("p_brand").alias("canonical"), path.alias("path")))


def promoted(staged_values: DataFrame, value: str, user: str, quorum: int) -> DataFrame:
    """Values that at least ``quorum`` distinct users have brought; the rest stays staged (a left anti join with these)."""
    return staged_values.groupBy(value).agg(F.countDistinct(user).alias("n_")).where(F.col("n_") >= quorum).select(value)


@query("G9_quorum", "SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 35")
def _(t):
    return promoted(t.lineitem, "l_partkey", "l_suppkey", 35)


def alias_variants(name: Column, script: bool = False) -> Column:
    """How a name may be written, in lower case and order: with blanks, hyphens, underscores or nothing between its words; of a script package (``script``) with
    and without its ending."""
    low = F.lower(F.trim(name))
    bare = F.regexp_replace(low, r"[.]js$", "") if script else low
    joined = [F.regexp_replace(bare, r"[\s_-]+", by) for by in (" ", "-", "_", "")]
    more = [F.concat(bare, F.lit(".js"))] if script else []
    return F.array_sort(F.array_distinct(F.array(low, *joined, *more)))


def partitioned_aliases(names: DataFrame, key: str, name: str, taken: DataFrame, script: bool = False) -> DataFrame:
    """(key, alias, collides) of all variants of the names: whether an alias is taken (taken: alias) or is a variant of another key as well."""
    each = names.select(key, F.explode(alias_variants(F.col(name), script)).alias("alias")).where("alias is not null")
    # one row an alias says whether it collides, and only those that do are joined; a null key is a key of its own
    marks = each.select("alias", F.col(key).alias("key_"), F.col(key).isNull().alias("none_"), F.lit(False).alias("held_"))
    held = taken.select("alias").select("alias", F.lit(None).cast(each.schema[key].dataType).alias("key_"), F.lit(False).alias("none_"), F.lit(True).alias("held_"))
    many = ~F.min("key_").eqNullSafe(F.max("key_")) | (F.bool_or("none_") & F.min("key_").isNotNull())
    clash = marks.union(held).groupBy("alias").agg((many | F.bool_or("held_")).alias("collides")).where("collides")
    return each.distinct().join(clash, "alias", "left").select(key, "alias", F.coalesce("collides", F.lit(False)).alias("collides"))


@query(
    "G10_alias_variants",
    """WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN upper(replace(p_name, ' ', '-')) ELSE replace(p_name, ' ', '') || '.js' END || '-' || (p_partkey // 2) AS name FROM part WHERE p_partkey % 4 < 3 OR p_size > 0),
    w AS (SELECT k, lower(name) AS low, string_split(regexp_replace(lower(name), '[ _-]+', ' ', 'g'), ' ') AS ws FROM n),
    v AS (SELECT DISTINCT k, unnest([low, array_to_string(ws, ' '), array_to_string(ws, '-'), array_to_string(ws, '_'), array_to_string(ws, '')]) AS alias FROM w),
    c AS (SELECT alias, count(*) AS n FROM v GROUP BY alias)
    SELECT k, alias, n > 1 OR alias IN (SELECT p_name || ' ' || (p_partkey // 2) FROM part WHERE p_size > 45) AS collides FROM v JOIN c USING (alias)""",
)
def _(t):
    key, half = F.col("p_partkey"), F.expr("p_partkey div 2").cast("string")
    kind = key % 4
    spelled = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(kind == 2, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".js")))
    names = t.part.select(key.alias("k"), F.concat(spelled, F.lit("-"), half).alias("name"))
    return partitioned_aliases(names, "k", "name", t.part.where("p_size > 45").select(F.concat("p_name", F.lit(" "), half).alias("alias")))


def import_decisions(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """How many rows each rule decides, the first that holds; the rest is unresolved."""
    decision = F.lit("unresolved")
    for name, holds in reversed(rules):
        decision = F.when(holds, name).otherwise(decision)
    return rows.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query("G11_import_decisions", "SELECT decision, count(*) AS n FROM (SELECT CASE WHEN p_name LIKE 'small%' THEN 'rule' WHEN p_partkey % 17 = 0 THEN 'override' WHEN p_size > 25 THEN 'metadata' ELSE 'unresolved' END AS decision FROM part) x GROUP BY decision")
def _(t):
    return import_decisions(t.part, [("rule", F.col("p_name").like("small%")), ("override", F.col("p_partkey") % 17 == 0), ("metadata", F.col("p_size") > 25)])


def vocabulary_term(value: Column, vocabulary: list[str]) -> Column:
    """A term of the vocabulary as it is, another one marked as new."""
    return F.when(value.isin(vocabulary), value).otherwise(F.concat(F.lit("new:"), F.lower(value)))


@query("G12_vocabulary_split", "SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN p_type ELSE 'new:' || lower(p_type) END AS tag FROM part")
def _(t):
    return t.part.select("p_partkey", vocabulary_term(F.col("p_type"), ["PROMO", "SMALL", "LARGE"]).alias("tag"))


def lanes(rows: DataFrame, category: str, mapping: dict[str, str], rest: str) -> DataFrame:
    """Rows by the lane of their category; categories without one go to ``rest``."""
    lane = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col(category)), F.lit(rest))
    return rows.groupBy(lane.alias("lane")).agg(F.count("*").alias("n"))


@query("G13_evidence_lanes", "SELECT lane, sum(n) AS n FROM (SELECT CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'tools' WHEN p_type = 'LARGE' THEN 'platforms' ELSE 'concepts' END AS lane, count(*) AS n FROM part GROUP BY p_type) x GROUP BY lane")
def _(t):
    return lanes(t.part, "p_type", {"PROMO": "tools", "ECONOMY": "tools", "LARGE": "platforms"}, "concepts")


def plain_name(name: Column) -> Column:
    """The form in which names of technologies are compared: lower case, versions and a trailing .js dropped, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"(?:\s+v?\d[\d.]*|\.js)$", ""), "[^a-z0-9]+", "")


def reconciled(claimed: DataFrame, evidenced: DataFrame, key: str) -> DataFrame:
    """Every name of either side (compared as given): verified, claimed_only or evidence_only."""
    a, b = claimed.select(key).distinct().withColumn("a_", F.lit(True)), evidenced.select(key).distinct().withColumn("b_", F.lit(True))
    status = F.when(F.col("a_").isNull(), "evidence_only").when(F.col("b_").isNull(), "claimed_only").otherwise("verified")
    return a.join(b, key, "full").select(key, status.alias("status"))


@query("G14_stack_reconciliation", "SELECT COALESCE(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'evidence_only' WHEN b.k IS NULL THEN 'claimed_only' ELSE 'verified' END AS status FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) a FULL OUTER JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 40) b ON a.k = b.k")
def _(t):
    return reconciled(t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("k")), t.part.where("p_size > 40").select(F.col("p_partkey").alias("k")), "k")


def evidence_stamp(repos: DataFrame, key: str, fork: Column, commits: DataFrame, least: int) -> DataFrame:
    """Flags of each repository: whether it is a fork, and whether its owner wrote at least ``least`` commits (key, n); none is not."""
    return repos.join(commits, key, "left").select(key, fork.alias("is_fork"), (F.coalesce("n", F.lit(0)) >= least).alias("authored"))


@query("G15_evidence_stamp", "SELECT s_suppkey, s_acctbal < 0 AS is_fork, COALESCE(n, 0) > 550 AS authored FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) x ON s_suppkey = l_suppkey")
def _(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return evidence_stamp(t.supplier, "s_suppkey", F.col("s_acctbal") < 0, n, 551)


def signals(files: DataFrame, repo: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """One boolean for each pattern: whether any of a repository's texts (or paths) matches it."""
    return files.groupBy(repo).agg(*[F.coalesce(F.bool_or(F.col(text).rlike(rule)), F.lit(False)).alias(name) for name, rule in patterns.items()])


@query("G16_archetype_signals", "SELECT source, bool_or(text LIKE '%|%') AS has_tables, bool_or(text LIKE '%@%') AS has_mail, bool_or(text LIKE '%token%') AS has_secret FROM documents GROUP BY source")
def _(t):
    return signals(t.documents, "source", "text", {"has_tables": r"\|", "has_mail": "@", "has_secret": "token"})


def main_of(rows: DataFrame, repo: str, kind: str) -> DataFrame:
    """The kind (language) of most rows of each repository, the first by name among equals."""
    n = rows.groupBy(repo, kind).agg(F.count("*").alias("n_"))
    return n.withColumn("rn_", F.row_number().over(W.partitionBy(repo).orderBy(F.desc("n_"), kind))).where("rn_ = 1").select(repo, kind)


@query("G17_language_topology", "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY source, lang) x WHERE rn = 1")
def _(t):
    return main_of(t.documents, "source", "lang")


def archetype(signal: dict[str, Column], archetypes: dict[str, dict[str, list[str]]], prior: Column | None = None) -> tuple[Column, Column]:
    """(archetype, confidence): 2 if any ``required`` signal holds, 1 for each ``positive`` one, -2 for each ``negative`` one, 1 for the prior;
    the first of the best, none without a score above 0; confidence is the score over 4, at most 1."""
    on = lambda k: F.coalesce(signal[k], F.lit(False))
    best, name = F.lit(0), F.lit("none")
    for kind, rule in archetypes.items():
        score = F.lit(0)
        for k in rule.get("required", [])[:1]:
            any_ = on(k)
            for other in rule["required"][1:]:
                any_ = any_ | on(other)
            score = score + F.when(any_, 2).otherwise(0)
        for k in rule.get("positive", []):
            score = score + F.when(on(k), 1).otherwise(0)
        for k in rule.get("negative", []):
            score = score - F.when(on(k), 2).otherwise(0)
        if prior is not None:
            score = score + F.when(prior == kind, 1).otherwise(0)
        name, best = F.when(score > best, kind).otherwise(name), F.greatest(score, best)
    return name, F.least(F.lit(1.0), best / F.lit(4.0))


@query("G18_archetype_score", "WITH s AS (SELECT user_id, bool_or(event_type = 'purchase') AS bought, bool_or(value > 90) AS rich, bool_or(event_type = 'error' AND value > 60) AS broken, bool_or(event_type = 'view') AS viewed, bool_or(event_type = 'click') AS clicked, bool_or(event_type = 'purchase' AND value > 95) AS spent FROM events GROUP BY 1), x AS (SELECT user_id, 2 * bought::INT + rich::INT - 2 * broken::INT AS a, 2 * viewed::INT + clicked::INT - 2 * spent::INT AS b FROM s) SELECT user_id, CASE WHEN greatest(a, b) <= 0 THEN 'none' WHEN a >= b THEN 'buyer' ELSE 'browser' END AS archetype, least(1.0::DOUBLE, greatest(a, b, 0) / 4.0::DOUBLE) AS confidence FROM x")
def _(t):
    e, v = F.col("event_type"), F.col("value")
    held = {"bought": e == "purchase", "rich": v > 90, "broken": (e == "error") & (v > 60), "viewed": e == "view", "clicked": e == "click", "spent": (e == "purchase") & (v > 95)}
    per = t.events.groupBy("user_id").agg(*[F.bool_or(c).alias(k) for k, c in held.items()])
    kind, sure = archetype({k: F.col(k) for k in held}, {"buyer": {"required": ["bought"], "positive": ["rich"], "negative": ["broken"]}, "browser": {"required": ["viewed"], "positive": ["clicked"], "negative": ["spent"]}})
    return per.select("user_id", kind.alias("archetype"), sure.alias("confidence"))


def concerns(evidence: DataFrame, key: str, text: str, signals: dict[str, list[str]], asked: list[str]) -> DataFrame:
    """(key, concern, tier, relevant) of each concern (its signals: words): strong with two of them in the evidence, partial with one, else none; relevant where what
    is asked for (words) shares one with it."""
    words = F.array_distinct(tokens(F.col(text)))
    known = [(name, F.array(*[F.lit(w) for w in ws]), bool(set(ws) & set(asked))) for name, ws in signals.items()]

    def one(name: str, ws: Column, relevant: bool) -> Column:
        n = F.size(F.array_intersect("words_", ws))
        return F.struct(F.lit(name).alias("concern"), F.when(n >= 2, "strong").when(n == 1, "partial").otherwise("none").alias("tier"), F.lit(relevant).alias("relevant"))

    return evidence.select(key, F.coalesce(words, F.array().cast("array<string>")).alias("words_")).select(key, F.inline(F.array(*[one(*k) for k in known])))


@query(
    "G19_concerns",
    """WITH s(concern, words, relevant) AS (VALUES ('tone', ['idiot', 'trash', 'worthless', 'stupid'], TRUE), ('secrets', ['token', 'secret', 'password'], FALSE)),
    x AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), n AS (SELECT doc_id, concern, relevant, len(list_intersect(w, words)) AS n FROM x, s)
    SELECT doc_id, concern, CASE WHEN n >= 2 THEN 'strong' WHEN n = 1 THEN 'partial' ELSE 'none' END AS tier, relevant FROM n""",
)
def _(t):
    return concerns(t.documents, "doc_id", "text", {"tone": ["idiot", "trash", "worthless", "stupid"], "secrets": ["token", "secret", "password"]}, ["trash", "rust"])


def transfer_candidates(wanted: DataFrame, held: DataFrame, token: str, name: str, tier: str) -> DataFrame:
    """(wanted, held, tier) of held skills that share a token with a wanted one of another name, at the best tier of each pair."""
    a = wanted.select(F.col(name).alias("wanted"), F.col(token).alias("t_")).distinct()
    b = held.select(F.col(name).alias("held"), F.col(token).alias("t_"), tier)
    return a.join(b, "t_").where("wanted <> held").groupBy("wanted", "held").agg(F.min(tier).alias("tier"))


@query("G20_transfer_candidates", "SELECT a.p_name AS wanted, b.p_name AS held, min(CASE WHEN b.p_type = 'PROMO' THEN 1 WHEN b.p_type = 'SMALL' THEN 2 ELSE 3 END) AS tier FROM (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS w FROM part WHERE p_size = 50) a JOIN part b ON split_part(b.p_name, ' ', 1) = a.w AND b.p_name <> a.p_name GROUP BY 1, 2")
def _(t):
    p = t.part.select("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w"), "p_size", F.when(F.col("p_type") == "PROMO", 1).when(F.col("p_type") == "SMALL", 2).otherwise(3).alias("tier"))
    return transfer_candidates(p.where("p_size = 50"), p, "w", "p_name", "tier")


def shared_by(rows: DataFrame, signal: str, holder: str, least: int = 2) -> DataFrame:
    """Signals (topics, technologies, name prefixes) that ``least`` holders or more have."""
    return rows.where(F.col(signal).isNotNull()).groupBy(signal).agg(F.countDistinct(holder).alias("brands")).where(F.col("brands") >= least)


@query("G21_shared_signals", "SELECT p_name, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 2")
def _(t):
    return shared_by(t.part, "p_name", "p_brand")


def first_kind(rules: list[tuple[str, Column]], rest: str) -> Column:
    """The kind of the first rule that holds."""
    kind = F.lit(rest)
    for name, holds in reversed(rules):
        kind = F.when(holds, name).otherwise(kind)
    return kind


@query("G22_component_kind", "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'service' WHEN s_acctbal > 5000 THEN 'library' WHEN s_acctbal > 0 THEN 'tool' ELSE 'docs' END AS kind FROM supplier")
def _(t):
    c = F.col
    return t.supplier.select("s_suppkey", first_kind([("service", c("s_nationkey") < 5), ("library", c("s_acctbal") > 5000), ("tool", c("s_acctbal") > 0)], "docs").alias("kind"))


# -- provenance -----------------------------------------------------------------


def provenance(retrieved: DataFrame, cited: DataFrame, key: str, demoted: Column, score: Column, floor: float) -> DataFrame:
    """The status of each retrieved passage: demoted before cited (``cited`` has key and verified) before merely retrieved, and
    whether it passed the floor."""
    said = cited.groupBy(key).agg(F.bool_or("verified").alias("verified_"))
    status = F.when(demoted, "demoted").when(F.col("verified_"), "cited_verified").when(F.col("verified_").isNotNull(), "cited_partial").otherwise("retrieved")
    return retrieved.join(said, key, "left").select(key, status.alias("status"), (score >= floor).alias("passed_floor"))


@query("D1_provenance", "SELECT e.event_id, CASE WHEN e.event_type = 'error' THEN 'demoted' WHEN o.o_orderstatus = 'F' THEN 'cited_verified' WHEN o.o_orderstatus IS NOT NULL THEN 'cited_partial' ELSE 'retrieved' END AS status, e.value >= 20 AS passed_floor FROM events e LEFT JOIN orders o ON e.event_id = o.o_orderkey AND o.o_orderkey % 2 = 0")
def _(t):
    cited = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderstatus") == "F").alias("verified"))
    return provenance(t.events, cited, "event_id", F.col("event_type") == "error", F.col("value"), 20)


def evidence_quality(rows: DataFrame, repo: str, cited: Column) -> DataFrame:
    """Passages retrieved and cited of each repository, and the rate to three digits."""
    return rows.groupBy(repo).agg(F.count("*").alias("retrieved"), F.count_if(cited).alias("cited"), F.round(F.count_if(cited) / F.count("*"), 3).alias("rate"))


@query("D2_evidence_quality", "SELECT l_suppkey, count(*) AS retrieved, count(*) FILTER (WHERE l_returnflag = 'A') AS cited, round(CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) / count(*), 3) AS rate FROM lineitem GROUP BY l_suppkey")
def _(t):
    return evidence_quality(t.lineitem, "l_suppkey", F.col("l_returnflag") == "A")


#: D3: what counts first where a skill has several verdicts.
LEDGER = ("verified", "gap", "group", "partial")


def skill_ledger(tools: DataFrame, verdicts: DataFrame) -> DataFrame:
    """D3: for each tool (position, tool) the verdict (tool, status, skill) of highest precedence; tools without one fall out, of tools that differ in case
    the first counts, and of tools that came to the same assessed skill the first has the row."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEDGER]), F.col("status"))
    first = tools.where("tool <> ''").groupBy(F.lower("tool").alias("key_")).agg(F.min_by(F.struct("position", "tool"), "position").alias("t_"))
    said = verdicts.where(rank > 0).groupBy(F.lower("tool").alias("key_")).agg(F.min_by(F.struct("status", "skill"), F.struct(rank.alias("r"), F.col("skill"))).alias("v_"))
    rows = first.join(said, "key_").select("t_.*", "v_.*")
    return rows.groupBy(F.lower("skill").alias("skill_")).agg(F.min_by(F.struct("tool", "status", "skill"), "position").alias("r_")).select("r_.*")


@query("D3_skill_ledger", "WITH v AS (SELECT p_name AS tool, CASE WHEN p_size > 47 THEN 'verified' WHEN p_size < 3 THEN 'gap' WHEN p_type = 'PROMO' THEN 'group' ELSE 'partial' END AS status, split_part(p_name, ' ', 1) AS skill, p_partkey FROM part), b AS (SELECT tool, skill, status, row_number() OVER (PARTITION BY tool ORDER BY CASE status WHEN 'verified' THEN 0 WHEN 'gap' THEN 1 WHEN 'group' THEN 2 ELSE 3 END, skill) AS rn, min(p_partkey) OVER (PARTITION BY tool) AS position FROM v) SELECT list_reduce(list_transform(string_split(tool, ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS tool, status, skill FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY position) AS k FROM b WHERE rn = 1) WHERE k = 1")
def _(t):
    status = F.when(F.col("p_size") > 47, "verified").when(F.col("p_size") < 3, "gap").when(F.col("p_type") == "PROMO", "group").otherwise("partial")
    tools = t.part.groupBy(F.initcap("p_name").alias("tool")).agg(F.min("p_partkey").alias("position"))
    return skill_ledger(tools, t.part.select(F.col("p_name").alias("tool"), status.alias("status"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("skill")))


def gap_classes(skills: DataFrame, evidenced: DataFrame, groups: DataFrame) -> DataFrame:
    """(skill, class) of skills (skill): direct_evidence if evidenced (skill), transfer_convertible if another member of one of its typed groups
    (kind, skill; a null kind never converts) is, else honest_gap."""
    there = evidenced.select("skill").distinct()
    typed = groups.where("kind is not null").select("kind", "skill").distinct()
    live = typed.join(there, "skill").groupBy("kind").agg(F.min("skill").alias("low"), F.max("skill").alias("high"))
    near = typed.join(live, "kind").where("low <> skill or high <> skill").select("skill").distinct().withColumn("near_", F.lit(True))
    kind = F.when(F.col("there_"), "direct_evidence").when(F.col("near_"), "transfer_convertible").otherwise("honest_gap")
    return skills.join(there.withColumn("there_", F.lit(True)), "skill", "left").join(near, "skill", "left").select("skill", kind.alias("class"))


@query("D4_gap_classes", "WITH e AS (SELECT DISTINCT l_partkey AS skill FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'), g AS (SELECT p_partkey AS skill, p_brand || '/' || p_size % 5 AS kind FROM part WHERE p_brand <> 'Brand#11') SELECT p_partkey AS skill, CASE WHEN p_partkey IN (SELECT skill FROM e) THEN 'direct_evidence' WHEN EXISTS (SELECT 1 FROM g a JOIN g b ON a.kind = b.kind AND a.skill <> b.skill WHERE a.skill = p_partkey AND b.skill IN (SELECT skill FROM e)) THEN 'transfer_convertible' ELSE 'honest_gap' END AS class FROM part")
def _(t):
    skills = t.part.select(F.col("p_partkey").alias("skill"), "p_brand", "p_size")
    typed = skills.select(F.when(F.col("p_brand") != "Brand#11", F.concat("p_brand", F.lit("/"), F.col("p_size") % 5)).alias("kind"), "skill")
    return gap_classes(skills.select("skill"), t.lineitem.where("l_quantity >= 49 and l_returnflag = 'R'").select(F.col("l_partkey").alias("skill")), typed)


def concept_coverage(concepts: DataFrame, known: DataFrame, evidenced: DataFrame) -> DataFrame:
    """(concept, state): unknown unless the ontology (concept) has it, then covered or uncovered by evidence (concept)."""
    k, e = known.select("concept").distinct().withColumn("k_", F.lit(True)), evidenced.select("concept").distinct().withColumn("e_", F.lit(True))
    state = F.when(F.col("k_").isNull(), "unknown").when(F.col("e_").isNull(), "uncovered").otherwise("covered")
    return concepts.join(k, "concept", "left").join(e, "concept", "left").select("concept", state.alias("state"))


@query("D5_concept_coverage", "SELECT v.c AS concept, CASE WHEN a.event_type IS NULL THEN 'unknown' WHEN b.event_type IS NULL THEN 'uncovered' ELSE 'covered' END AS state FROM (SELECT * FROM (VALUES ('click'), ('refund'), ('signup'), ('error')) AS x(c)) v LEFT JOIN (SELECT DISTINCT event_type FROM events) a ON v.c = a.event_type LEFT JOIN (SELECT DISTINCT event_type FROM events WHERE value > 50 AND event_type <> 'error') b ON v.c = b.event_type")
def _(t):
    concepts = t.spark.createDataFrame([("click",), ("refund",), ("signup",), ("error",)], "concept string")
    e = t.events.select(F.col("event_type").alias("concept"), "value")
    return concept_coverage(concepts, e, e.where("value > 50 and concept <> 'error'"))


def code_contradictions(claims: DataFrame, code: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims (repo, tech) that the code (repo, tech) contradicts: it has a successor of the technology (edges: old, new) and not
    itself, and no other predecessor of one of its successors is still in the code. A repository without code contradicts nothing."""
    code = code.select("repo", "tech").distinct()
    edges = edges.select("old", "new").distinct()
    gone = claims.select("repo", "tech").distinct().join(code, ["repo", "tech"], "left_anti").withColumnRenamed("tech", "old")
    moved = gone.join(edges, "old").join(code.withColumnRenamed("tech", "new"), ["repo", "new"]).select("repo", "old").distinct()
    peers = edges.withColumnRenamed("old", "peer").join(edges, "new").where("peer <> old").select("old", "peer").distinct()
    current = moved.join(peers, "old").join(code.withColumnRenamed("tech", "peer"), ["repo", "peer"]).select("repo", "old").distinct()
    return moved.join(current, ["repo", "old"], "left_anti").withColumnRenamed("old", "tech")


@query("D6_contradictions", "WITH p AS (SELECT l_suppkey AS repo, p_brand AS tech, l_quantity, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT DISTINCT repo, tech FROM p WHERE l_quantity > 48), k AS (SELECT DISTINCT repo, tech FROM p WHERE l_quantity <= 3 AND l_returnflag = 'R'), b AS (SELECT DISTINCT p_brand AS x FROM part), e AS (SELECT a.x AS old, b.x AS new FROM b a, b WHERE a.x < b.x AND a.x[7] = b.x[7]) SELECT c.repo, c.tech FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.repo = c.repo AND k.tech = c.tech) AND EXISTS (SELECT 1 FROM e JOIN k ON k.tech = e.new WHERE e.old = c.tech AND k.repo = c.repo) AND NOT EXISTS (SELECT 1 FROM e JOIN e f ON e.new = f.new AND f.old <> e.old JOIN k ON k.tech = f.old WHERE e.old = c.tech AND k.repo = c.repo)")
def _(t):
    pairs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("repo"), F.col("p_brand").alias("tech"), "l_quantity", "l_returnflag")
    brands = t.part.select(F.col("p_brand").alias("old")).distinct()
    edges = brands.join(brands.withColumnRenamed("old", "new"), F.substring("old", 7, 1) == F.substring("new", 7, 1)).where("old < new")
    return code_contradictions(pairs.where("l_quantity > 48"), pairs.where("l_quantity <= 3 and l_returnflag = 'R'"), edges)


#: What parts the head of a long name from the rest.
NAME_BREAKS = (" with ", " — ", ": ")


def spoken_names(name: str, breaks: tuple[str, ...] = NAME_BREAKS) -> set[str]:
    """How prose may call something: by its name, by its head before a break (two words or more), without its bracketed part, or by that part
    (four letters or more)."""
    said = {name}
    said |= {head for b in breaks if len((head := name.partition(b)[0]).split()) > 1}
    before, bracket, inside = name.partition("(")
    if bracket:
        said |= {before, *(x for x in [inside.partition(")")[0]] if len(x) > 3)}
    return {s.strip().lower() for s in said if s.strip()}


def source_lanes(files: Column, prose: Column, projects: list[str], careers: list[str], career_files: str = "(?i)resume|career|curriculum") -> Column:
    """The lanes of an entry in the order repo (a file under owner/repo/), project (prose names one), career (a file that ``career_files`` matches,
    or prose names a company or title); empty where nothing holds."""

    def named(names: list[str]) -> Column:
        said = sorted(set().union(*map(spoken_names, names)))
        return F.exists(F.array(*[F.lit(s) for s in said]), lambda s: F.contains(F.lower(prose), s)) if said else F.lit(False)

    repo = F.exists(files, lambda f: f.rlike("^[^/]+/[^/]+/"))
    career = F.exists(files, lambda f: f.rlike(career_files)) | named(careers)
    return F.array_compact(F.array(F.when(repo, "repo"), F.when(named(projects), "project"), F.when(career, "career")))


@query("D8_source_lanes", "SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(regexp_extract(url, 'https?://[^/]+/(.*)', 1), '^[^/]+/[^/]+/') THEN 'repo' END, CASE WHEN contains(lower(url), 'fr: page') THEN 'project' END, CASE WHEN page_id % 7 = 0 OR contains(lower(url), '/es/ with site') OR contains(lower(url), 'host (example)') OR contains(lower(url), 'host') OR contains(lower(url), 'example') THEN 'career' END) AS lanes FROM pages")
def _(t):
    files = F.array(F.regexp_extract("url", "https?://[^/]+/(.*)", 1), F.when(F.col("page_id") % 7 == 0, "resume-data.ts").otherwise("x"))
    return t.pages.select("page_id", F.array_join(source_lanes(files, F.col("url"), ["fr: page"], ["/es/ with site", "Host (example)"]), ",").alias("lanes"))


def best_row(rows: DataFrame, key: str, version: Column, line: str, *tie: str) -> DataFrame:
    """Of each key the row that has a version, then the lowest line (null last), then the first by ``tie``."""
    order = W.partitionBy(key).orderBy(F.when(version, 0).otherwise(1), F.col(line).asc_nulls_last(), *tie)
    return rows.withColumn("rn_", F.row_number().over(order)).where("rn_ = 1").drop("rn_")


@query("D10_best_row", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_size NULLS LAST, p_partkey) AS rn FROM part) x WHERE rn = 1")
def _(t):
    return best_row(t.part, "p_brand", F.col("p_size") > 25, "p_size", "p_partkey").select("p_brand", "p_partkey")


def within_budget(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """The first rows of each key while their tokens (four characters each, rounded up) fit, with the tokens used so far."""
    used = F.sum(F.ceil(F.length(text) / F.lit(4.0)).cast("long")).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


@query("D11_token_budget", "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(CAST(ceil(length(text) / CAST(4 AS DOUBLE)) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM conversations) x WHERE used <= 400")
def _(t):
    return within_budget(t.conversations, "conv_id", "turn", "text", 400).select("conv_id", "turn", "used")


def stories(rows: DataFrame, kinds: dict[str, tuple[Column, Column, float]], key: str) -> DataFrame:
    """(key, kind, confidence) for each kind both of whose signs a row has, such as a revert's subject and body, or a merge with a closed issue and a metric."""
    found = F.array_compact(F.array(*[F.when(a & b, F.struct(F.lit(k).alias("kind"), F.lit(sure).alias("confidence"))) for k, (a, b, sure) in kinds.items()]))
    return rows.select(key, F.inline(found))


@query("D12_story_mining", "SELECT doc_id, 'incident' AS kind, 0.85::DOUBLE AS confidence FROM documents WHERE text LIKE '%trash%' AND text LIKE '%idiot%' UNION ALL SELECT doc_id, 'optimization', 0.7::DOUBLE FROM documents WHERE text LIKE '%token = %' AND text LIKE '%@%'")
def _(t):
    has = lambda x: F.contains("text", F.lit(x))
    return stories(t.documents, {"incident": (has("trash"), has("idiot"), 0.85), "optimization": (has("token = "), has("@"), 0.7)}, "doc_id")


def enrichment_tier(rows: DataFrame, cache: DataFrame, digest: str, rule: Column) -> DataFrame:
    """What enriches each row: the cache (one column of digests), else the rule where it holds, else the model."""
    held = cache.select(digest).distinct().withColumn("held_", F.lit(True))
    return rows.join(held, digest, "left").withColumn("tier", F.when(F.col("held_"), "cache").when(rule, "rule").otherwise("model")).drop("held_")


@query("D14_enrichment_cache", "SELECT d.doc_id, CASE WHEN c.doc_id IS NOT NULL THEN 'cache' WHEN d.lang = 'en' THEN 'rule' ELSE 'model' END AS tier FROM documents d LEFT JOIN (SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents GROUP BY 2 HAVING count(*) > 1) c ON md5(d.text) = c.h")
def _(t):
    d = t.documents.select("doc_id", "lang", F.md5("text").alias("h"))
    return enrichment_tier(d, d.groupBy("h").count().where("count > 1"), "h", F.col("lang") == "en").select("doc_id", "tier")


def pass_rates(rows: DataFrame, by: str, passed: str) -> DataFrame:
    """Cases and the share that passed, by an expected flag."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(passed).cast("double")), 6).alias("pass_rate"))


@query("D15_eval_rows", "SELECT toxic, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS pass_rate FROM labels GROUP BY toxic")
def _(t):
    return pass_rates(t.labels, "toxic", "quality")


def cost_since(rows: DataFrame, agent: str, cents: Column, ts: str, since: Column) -> DataFrame:
    """Dollars to six digits by agent, of rows since a time."""
    return rows.where(F.col(ts) >= since).groupBy(agent).agg(F.round(F.sum(cents) / F.lit(100.0), 6).alias("usd"))


@query("D16_cost_by_agent", "SELECT event_type, round(sum(CAST(round(value * 100) AS BIGINT)) / CAST(100 AS DOUBLE), 6) AS usd FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type")
def _(t):
    return cost_since(t.events, "event_type", F.round(F.col("value") * 100).cast("long"), "ts", F.expr("timestamp_ntz'2024-01-10 00:00:00'"))


def cache_version(rows: DataFrame, last: str) -> DataFrame:
    """One tag for the state of a table: its last mark and its number of rows."""
    return rows.agg(F.concat_ws("-", F.coalesce(F.max(last).cast("string"), F.lit("none")), F.count("*").cast("string")).alias("tag"))


@query("D17_cache_version", "SELECT max(event_id) || '-' || count(*) AS tag FROM events")
def _(t):
    return cache_version(t.events, "event_id")


def backfilled(rows: DataFrame, derived: DataFrame, key: str, column: str, fallback: Column) -> DataFrame:
    """A column set from a derived table (key, column), each key once; the fallback where that has none."""
    return rows.join(derived.select(key, F.col(column).alias("new_")), key, "left").select(key, F.coalesce("new_", fallback).alias(column))


@query("D19_backfill", "SELECT doc_id, COALESCE(CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END, lang) AS doc_type FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    kind = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("doc_type"))
    return backfilled(t.documents, kind, "doc_id", "doc_type", F.col("lang"))


def top_committer(rows: DataFrame, repo: str, author: str) -> DataFrame:
    """The author of most rows of each repository, the first by name among equals."""
    return main_of(rows, repo, author)


@query("D20_top_committer", "SELECT l_suppkey, l_linenumber FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS rn FROM lineitem GROUP BY 1, 2) x WHERE rn = 1")
def _(t):
    return top_committer(t.lineitem, "l_suppkey", "l_linenumber")


def renamed(rows: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Rows under their key's new name."""
    return rows.withColumn(key, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col(key)), F.col(key)))


@query("D21_rename", "SELECT CASE WHEN source = 'src1' THEN 'core/src1' ELSE source END AS source, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return renamed(t.documents, "source", {"src1": "core/src1"}).groupBy("source").agg(F.count("*").alias("n"))


def inserted_distinct(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct values that a set-based insert adds."""
    return rows.select(*columns).distinct()


@query("D22_set_backfill", "SELECT DISTINCT lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(t):
    return inserted_distinct(t.documents.join(t.labels.where("quality = 0"), "doc_id", "left_semi"), "lang", "source")


