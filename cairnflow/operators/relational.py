"""Relational operators: predicates, joins, aggregates, windows, top-k and set operations as declarative plans.

Statements that read the same in Spark SQL and in DuckDB are registered once for both; Catalyst picks the physical plan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..registry import plain, query
from ..sources.tables import KeyedTable, removed
from ..staging import shared_dir


# -- predicates -------------------------------------------------------------

def optional(frame: DataFrame, **wanted) -> DataFrame:
    """Equality on each named column whose value is given; None leaves the column free."""
    for column, value in wanted.items():
        if value is not None:
            frame = frame.where(F.col(column) == value)
    return frame


def tenant_scope(frame: DataFrame, column: str, tenant) -> DataFrame:
    """The rows of one tenant; applied first, so that the scan prunes by it."""
    return frame.where(F.col(column) == F.lit(tenant))


def passes_if_missing(column: Column, default) -> Column:
    """P5: a flag that counts as ``default`` where it is missing."""
    return F.coalesce(column, F.lit(default))


@query("P1_optional_predicate", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND (NULL IS NULL OR o_orderpriority = NULL)")
def _(t):
    return optional(t.orders, o_orderstatus="F", o_orderpriority=None).select("o_orderkey", "o_totalprice")


@query("S1_tenant_scan", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 37")
def _(t):
    return tenant_scope(t.orders, "o_custkey", 37).select("o_orderkey", "o_orderdate", "o_totalprice")


plain("P2_any_all", "SELECT p_partkey, p_type FROM {part} WHERE p_type IN ('ECONOMY', 'PROMO') AND p_brand NOT IN ('Brand#1', 'Brand#2')")


@query(
    "P3_array_overlap",
    "WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT doc_id, list_contains(w, 'the') AS has_the, list_has_any(w, ['that', 'und']) AS overlaps, list_has_all(w, ['the', 'and']) AS contains_all FROM d",
)
def _(t):
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    both = F.array(F.lit("the"), F.lit("and"))
    return t.documents.select("doc_id", w.alias("w")).select("doc_id", F.array_contains("w", "the").alias("has_the"), F.arrays_overlap("w", F.array(F.lit("that"), F.lit("und"))).alias("overlaps"), (F.size(F.array_except(both, "w")) == 0).alias("contains_all"))


@query("P4_for_all_signals", """SELECT page_id, contains(html, '<nav') AND contains(html, 'charset') AND contains(html, 'lang="fr"') AS all_signals FROM pages""")
def _(t):
    keys = F.array(*[F.lit(x) for x in ("<nav", "charset", 'lang="fr"')])
    return t.pages.select("page_id", F.forall(keys, lambda k: F.contains("html", k)).alias("all_signals"))


@query("P5_fail_open", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE COALESCE(l.toxic, 0) = 0 AND COALESCE(l.quality, 1) <> 0")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left").where((passes_if_missing(F.col("toxic"), 0) == 0) & (passes_if_missing(F.col("quality"), 1) != 0)).select("doc_id")


@query(
    "P6_soft_widener",
    "WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id FROM e WHERE event_type IN ('click', 'view') OR k BETWEEN 10 AND 20 OR (k IS NULL AND NOT regexp_matches(event_type, '(?i)^err'))",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.where(F.col("event_type").isin("click", "view") | k.between(10, 20) | (k.isNull() & ~F.col("event_type").rlike("(?i)^err"))).select("event_id")


@query("P7_regex_predicates", "SELECT p_partkey, regexp_matches(p_name, '(?i)^SMALL') AS starts, p_name ILIKE '%RING' AS ends_ring, NOT regexp_matches(p_brand, '#1[0-9]$') AS not_teen FROM part")
def _(t):
    return t.part.select("p_partkey", F.col("p_name").rlike("(?i)^SMALL").alias("starts"), F.col("p_name").ilike("%RING").alias("ends_ring"), (~F.col("p_brand").rlike("#1[0-9]$")).alias("not_teen"))


plain("P8_case_buckets", "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM {orders} GROUP BY 1")


@query("P9_json_text_equals", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def _(t):
    return t.events.where(F.get_json_object("props", "$.k") == "42").select("event_id")


@query("P10_ttl_predicate", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def _(t):
    now = t.events.agg(F.max("ts").alias("now"))
    return t.events.join(F.broadcast(now), F.col("ts") > F.expr("now - INTERVAL 7 DAYS")).select("event_id")


plain("P11_stale_rows", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus NOT IN ('F', 'O') AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")


@query("P13_json_merge", "SELECT event_id, json_extract_string(json_merge_patch(props, '{\"src\":\"web\"}'), '$.src') AS src, CAST(json_extract(json_merge_patch(props, '{\"src\":\"web\"}'), '$.k') AS BIGINT) AS k FROM events")
def _(t):
    merged = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("src"), F.lit("web")))
    return t.events.select("event_id", merged["src"].alias("src"), merged["k"].cast("long").alias("k"))


# -- joins ------------------------------------------------------------------

plain("J1_inner_join", "SELECT n_name, count(*) AS customers, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
plain("J2_multi_column_join", "SELECT a.l_orderkey, a.l_partkey, count(*) AS pairs FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY 1, 2")
plain("J3_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
plain("J4_full_outer", "SELECT COALESCE(a.k, b.k) AS k, a.n AS n_click, b.n AS n_error FROM (SELECT user_id AS k, count(*) AS n FROM {events} WHERE event_type = 'click' GROUP BY 1) a FULL OUTER JOIN (SELECT user_id AS k, count(*) AS n FROM {events} WHERE event_type = 'error' GROUP BY 1) b ON a.k = b.k")
plain("J5_semi_join", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING count(*) >= 12)")
plain("J6_anti_join", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 150000)")


def in_range(left: DataFrame, right: DataFrame, keys: list[str], position: str, lo: str, hi: str) -> DataFrame:
    """Right rows whose ``position`` lies in the left rows' [lo, hi], per key. The range is spread into positions, so the
    join is a pure equi-join on (keys, position); ranges are meant to be short (a radius around an anchor)."""
    spread = left.withColumn(position, F.explode(F.sequence(lo, hi)))
    return spread.join(right, [*keys, position])


@query(
    "J7_range_join",
    "SELECT a.conv_id, a.turn AS anchor, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'user'",
)
def _(t):
    a = t.conversations.where("role = 'user'").select("conv_id", F.col("turn").alias("anchor"), (F.col("turn") - 1).alias("lo"), (F.col("turn") + 1).alias("hi"))
    return in_range(a, t.conversations.select("conv_id", "turn"), ["conv_id"], "turn", "lo", "hi").select("conv_id", "anchor", "turn")


@query(
    "J8_nearest_anchor",
    "SELECT conv_id, turn, anchor FROM (SELECT b.conv_id, b.turn, a.turn AS anchor, row_number() OVER (PARTITION BY b.conv_id, b.turn ORDER BY abs(a.turn - b.turn), a.turn) AS rn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 WHERE a.role = 'user') WHERE rn = 1",
)
def _(t):
    a = t.conversations.where("role = 'user'").select("conv_id", F.col("turn").alias("anchor"), (F.col("turn") - 2).alias("lo"), (F.col("turn") + 2).alias("hi"))
    near = in_range(a, t.conversations.select("conv_id", "turn"), ["conv_id"], "turn", "lo", "hi")
    return near.groupBy("conv_id", "turn").agg(F.min_by("anchor", F.struct(F.abs(F.col("anchor") - F.col("turn")), F.col("anchor"))).alias("anchor"))


@query(
    "J10_phrase_join",
    "SELECT item_id, doc_id FROM (SELECT item_id, split_part(text, '.', 1) AS phrase FROM benchmark) b JOIN documents d ON contains(d.text, b.phrase) WHERE length(phrase) >= 20",
)
def _(t):
    # a phrase meets a document through its longest word, then the whole phrase is looked for
    phrase = t.benchmark.select("item_id", F.split_part("text", F.lit("."), F.lit(1)).alias("phrase")).where(F.length("phrase") >= 20)
    inner = F.filter(F.split("phrase", "\\s+"), lambda w: F.length(w) > 0)
    inner = F.when(F.size(inner) > 2, F.slice(inner, F.lit(2), F.size(inner) - 2)).otherwise(inner)
    phrase = phrase.withColumn("key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w"))))["w"])
    words = t.documents.select("doc_id", F.explode(F.array_distinct(F.split("text", "\\s+"))).alias("key"))
    pairs = words.join(phrase, "key").select("item_id", "doc_id", "phrase")
    return pairs.join(t.documents.select("doc_id", "text"), "doc_id").where(F.contains("text", "phrase")).select("item_id", "doc_id")


plain("J12_bridge_distinct", "SELECT DISTINCT r_name, p_type FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey JOIN {part} ON l_partkey = p_partkey WHERE l_quantity > 45")
plain("J13_case_folded_lookup", "SELECT e.event_id, a.canonical FROM {events} e LEFT JOIN (SELECT * FROM (VALUES ('click', 'interaction'), ('view', 'interaction'), ('purchase', 'sale')) AS v(alias, canonical)) a ON lower(trim(e.event_type)) = a.alias")
plain("J14_before_after", "SELECT a.event_type, a.v AS before_v, b.v AS after_v FROM (SELECT event_type, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM {events} WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1) a JOIN (SELECT event_type, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM {events} WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1) b ON a.event_type = b.event_type")

# -- aggregates -------------------------------------------------------------

plain("A1_group_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS qty, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_discount), 6) AS disc FROM {lineitem} GROUP BY 1, 2")
plain("A2_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY 1")
plain("A3_filtered_aggregates", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT event_type) FILTER (WHERE value > 50) AS kinds FROM {events} GROUP BY user_id")
plain("A4_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15")
plain("A5_global_scalars", "SELECT (SELECT count(*) FROM {documents}) AS docs, (SELECT count(DISTINCT source) FROM {documents}) AS sources, (SELECT max(n_chars) FROM {documents}) AS longest, (SELECT count(*) FROM {labels} WHERE quality = 1) AS good, (SELECT count(*) FROM {pages}) AS pages")


@query("A6_array_agg_distinct", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("A7_last_by_time", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("A8_histogram_map", "SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def _(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("event_type", "n")))
    return counts.groupBy("user_id").agg(F.map_from_entries(pairs).alias("m")).select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias("histogram"))


@query("A9_filtered_list", "SELECT user_id, COALESCE(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE event_type = 'purchase' AND value > 90), '') AS big FROM events GROUP BY user_id")
def _(t):
    big = F.sort_array(F.collect_list(F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), F.col("event_id"))))
    return t.events.groupBy("user_id").agg(F.array_join(big, ",").alias("big"))


plain("A10_max_not_null", "SELECT p_brand, p_type, max(p_size) FILTER (WHERE p_size > 10) AS newest FROM {part} GROUP BY 1, 2")


@query("A11_unnest_count", "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) GROUP BY w")
def _(t):
    return t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


plain("A12_month_to_date", "SELECT user_id, spent, CASE WHEN spent >= 250000 THEN 'exceeded' WHEN spent >= 200000 THEN 'approaching' ELSE 'ok' END AS status FROM (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) AS spent FROM {events} WHERE ts >= date_trunc('month', TIMESTAMP '2024-01-30 12:00:00') GROUP BY user_id) m")


@query("A13_rate_limit", "SELECT user_id, count(*) AS n, count(*) >= 2 AS limited FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY user_id")
def _(t):
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))
    return t.events.join(now, F.col("ts") > F.expr("now - INTERVAL 1 HOUR")).groupBy("user_id").agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("limited"))


@query("A14_capped_examples", "SELECT p_brand, count(*) AS n, array_to_string(list_slice(list_sort(list(p_partkey)), 1, 3), ',') AS examples FROM part GROUP BY p_brand")
def _(t):
    # the three smallest of each group by a window, so that no group is gathered whole
    ranked = t.part.withColumn("rn", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")))
    return ranked.groupBy("p_brand").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("rn") <= 3, F.col("p_partkey")))), ",").alias("examples"))


plain("A15_median", "SELECT event_type, round(median(value), 6) AS mid FROM {events} GROUP BY event_type")
plain("A16_or_fold", "SELECT user_id, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'error') AS failed, bool_and(value >= 0) AS all_positive FROM {events} GROUP BY user_id")


@query("A17_merge_lanes", "SELECT user_id, event_type, count(*) AS n, arg_min(CAST(json_extract(props, '$.k') AS BIGINT), event_id) FILTER (WHERE json_extract(props, '$.k') IS NOT NULL) AS first_k FROM events GROUP BY 1, 2")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min_by(k, F.when(k.isNotNull(), F.col("event_id"))).alias("first_k"))


plain("A19_rollup_extension", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
plain("A20_cube_extension", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")

# -- windows, sorts, limits ---------------------------------------------------

plain("W1_global_row_number", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM (SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) x")
plain("W3_top_per_group", "SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM {customer}) x WHERE rn <= 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 8")
plain("W4_case_ordered_top", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type = 'PROMO' THEN 0 WHEN p_type = 'ECONOMY' THEN 1 ELSE 2 END, p_size DESC, p_retailprice, p_partkey) AS rn FROM {part}) x WHERE rn <= 12")
plain("W5_round_robin", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM {orders}) x ORDER BY rn, o_orderdate DESC, o_orderkey LIMIT 40")
plain("W7_interval_union", "WITH s AS (SELECT l_suppkey AS k, l_shipdate AS a, l_shipdate + INTERVAL 10 DAY AS b, l_orderkey, l_linenumber FROM {lineitem}), m AS (SELECT k, a, b, max(b) OVER (PARTITION BY k ORDER BY a, b, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), g AS (SELECT k, a, b, CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END AS fresh FROM m) SELECT k, count(*) AS pieces, sum(fresh) AS islands FROM g GROUP BY k")
plain("W9_consecutive_misses", "WITH x AS (SELECT user_id, event_id, ts, event_type, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS last_hit FROM {events}) SELECT user_id, count(CASE WHEN last_hit IS NULL OR ts > last_hit THEN 1 END) AS misses, count(CASE WHEN last_hit IS NULL OR ts > last_hit THEN 1 END) >= 3 AS inactive FROM x GROUP BY user_id")
plain("T2_nulls_last", "SELECT k, least FROM (SELECT user_id AS k, min(CASE WHEN event_type = 'signup' THEN value END) AS least FROM {events} GROUP BY user_id) x ORDER BY least DESC NULLS LAST, k LIMIT 25")
plain("T3_tie_breaks", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type ORDER BY n DESC, event_type")


@query("T4_stable_argmax", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("event_id"))


plain("T5_overfetch", "SELECT vec_id, label FROM (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn FROM {embeddings}) p WHERE rn <= least(4 * 10, 50)) q ORDER BY label DESC, vec_id LIMIT 10")
plain("T6_budget_cut", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {conversations}) x WHERE used <= 900")

# -- set operations -------------------------------------------------------------

plain("U1_union_all", "SELECT 'order' AS kind, o_orderkey AS k FROM {orders} WHERE o_totalprice > 250000 UNION ALL SELECT 'part' AS kind, p_partkey AS k FROM {part} WHERE p_size > 48")
plain("U2_union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
plain("U3_set_difference", "SELECT COALESCE(a.k, b.k) AS k, a.k IS NOT NULL AND b.k IS NOT NULL AS both_sides, a.k IS NULL AS only_b FROM (SELECT DISTINCT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F') a FULL OUTER JOIN (SELECT DISTINCT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'P') b ON a.k = b.k")
plain("U4_last_wins", "SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM {events}) x WHERE rn = 1")
plain("U5_passage_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, substring(text, 1, 100) ORDER BY n_chars DESC, doc_id) AS rn FROM {documents}) x WHERE rn = 1")


@query("U6_body_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE text END) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def _(t):
    body = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise(F.col("text"))
    return t.documents.groupBy(F.md5(body).alias("body")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(
    "U7_gap_dedup",
    "WITH g AS (SELECT p_type || '/' || p_brand AS name, max(p_size) AS severity FROM part GROUP BY 1 UNION ALL SELECT p_type AS name, max(p_size) FROM part WHERE p_size > 20 GROUP BY 1 UNION ALL SELECT p_brand, max(p_size) FROM part WHERE p_brand < 'Brand#2' GROUP BY 1) SELECT name, max(severity) AS severity FROM g WHERE NOT (contains(name, '/') AND split_part(name, '/', 1) IN (SELECT name FROM g) AND split_part(name, '/', 2) IN (SELECT name FROM g)) GROUP BY name",
)
def _(t):
    g = t.part.groupBy(F.concat_ws("/", "p_type", "p_brand").alias("name")).agg(F.max("p_size").alias("severity"))
    g = g.unionByName(t.part.where("p_size > 20").groupBy(F.col("p_type").alias("name")).agg(F.max("p_size").alias("severity")))
    g = g.unionByName(t.part.where("p_brand < 'Brand#2'").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias("severity")))
    return without_covered_compounds(g, "name", "severity")


def without_covered_compounds(gaps: DataFrame, name: str, severity: str) -> DataFrame:
    """The most severe row of each name, without compounds ``a/b`` whose parts are all names themselves."""
    worst = gaps.groupBy(name).agg(F.max(severity).alias(severity))
    parts = worst.where(F.contains(name, F.lit("/"))).select(F.col(name).alias("whole"), F.explode(F.split(name, "/")).alias("part"))
    known = parts.join(worst.select(F.col(name).alias("part"), F.lit(1).alias("known")).distinct(), "part", "left")
    covered = known.groupBy("whole").agg(F.min(F.coalesce("known", F.lit(0))).alias("all_known")).where("all_known = 1")
    return worst.join(covered, worst[name] == covered["whole"], "left_anti")


plain("U8_case_insensitive_cap", "SELECT w FROM (SELECT lower(p_name) AS w, min(p_partkey) AS first_at FROM {part} GROUP BY lower(p_name)) x ORDER BY first_at LIMIT 18")

# -- values, upserts, prunes ------------------------------------------------------

plain("S10_values_relation", "SELECT v.alias, count(e.event_id) AS n FROM (SELECT * FROM (VALUES ('click', 1), ('refund', 2), ('error', 3)) AS x(alias, pos)) v LEFT JOIN {events} e ON e.event_type = v.alias GROUP BY v.alias")


def upsert(store: DataFrame, rows: DataFrame, keys: list[str], digest: str, position: str) -> DataFrame:
    """K1: the store after a keyed upsert. Of rows with one key the last by ``position`` counts; a stored row changes only if its
    ``digest`` differs. ``status`` says inserted, updated, skipped or kept."""
    last = rows.withColumn("rn_", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(position).desc()))).where("rn_ = 1").drop("rn_", position)
    values = [c for c in store.columns if c not in keys]
    new = last.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("given_"))
    both = store.withColumn("held_", F.lit(True)).join(new, keys, "full")
    changed = F.col("given_").isNotNull() & (F.col("held_").isNull() | ~F.col(digest).eqNullSafe(F.col(f"new_{digest}")))
    status = F.when(F.col("held_").isNull(), "inserted").when(F.col("given_").isNull(), "kept").when(changed, "updated").otherwise("skipped")
    return both.select(*keys, *[F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values], status.alias("status"))


@query(
    "K1_upsert",
    """WITH store AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
    news AS (SELECT k, v FROM (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1)
    SELECT COALESCE(s.k, n.k) AS k, CASE WHEN n.k IS NOT NULL AND s.v IS DISTINCT FROM n.v THEN n.v ELSE s.v END AS v,
    CASE WHEN s.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN s.v IS DISTINCT FROM n.v THEN 'updated' ELSE 'skipped' END AS status FROM store s FULL JOIN news n ON s.k = n.k""",
)
def _(t):
    store = t.orders.where("o_orderkey % 3 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"))
    rows = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("at"))
    return upsert(store, rows, ["k"], "v", "at")


@query(
    "K1_table_upsert",
    """WITH store AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
    news AS (SELECT k, v FROM (SELECT o_custkey AS k, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1)
    SELECT COALESCE(n.k, s.k) AS k, COALESCE(n.v, s.v) AS v FROM store s FULL JOIN news n ON s.k = n.k WHERE COALESCE(n.k, s.k) NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def _(t):
    """Written: the store, an upsert, the same one again (which changes nothing), and a delete."""
    table = KeyedTable(t.spark, f"{shared_dir(t.spark)}/table-{uuid.uuid4().hex}", "k long, v long", ["k"])
    change = lambda old, rows: upsert(old, rows, ["k"], "v", "at").drop("status")
    given = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("at"), "o_orderstatus")
    table.apply(change, given.where("at % 3 <> 0").drop("o_orderstatus"), "orders", 0)
    for batch in (1, 1):
        table.apply(change, given.where("o_orderstatus <> 'P'").drop("o_orderstatus"), "orders", batch)
    table.apply(removed(["k"]), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k")))
    table.vacuum(1)
    return table.frame()


def insert_missing(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """K2: the store and the rows whose keys it lacks, each key once."""
    return store.unionByName(rows.dropDuplicates(keys).join(store, keys, "left_anti"))


@query("K2_insert_or_ignore", "SELECT c_nationkey AS k, 'c' AS src FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 10) UNION ALL SELECT DISTINCT s_nationkey, 's' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 10)")
def _(t):
    store = t.customer.where("c_nationkey < 10").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")).distinct()
    return insert_missing(store, t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src")), ["k"])


def upsert_keeping(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """K3: the store after a keyed upsert in which a null of a new row keeps the stored value. ``rows`` has each key once."""
    values = [c for c in store.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values])
    return store.join(new, keys, "full").select(*keys, *[F.coalesce(f"new_{c}", c).alias(c) for c in values])


@query("K3_coalesce_upsert", "SELECT COALESCE(a.k, b.k) AS k, COALESCE(b.v, a.v) AS v FROM (SELECT user_id AS k, min(value) AS v FROM events GROUP BY 1) a FULL OUTER JOIN (SELECT user_id AS k, max(CASE WHEN event_type = 'purchase' THEN value END) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1) b ON a.k = b.k")
def _(t):
    store = t.events.groupBy(F.col("user_id").alias("k")).agg(F.min("value").alias("v"))
    rows = t.events.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("k")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("v"))
    return upsert_keeping(store, rows, ["k"])


def update_from(store: DataFrame, changes: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """K4: every stored row, its columns of ``defaults`` taken from ``changes`` (each key once), the default where no change is given."""
    new = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in defaults])
    kept = [c for c in store.columns if c not in keys and c not in defaults]
    return store.join(new, keys, "left").select(*keys, *kept, *[F.coalesce(F.col(f"new_{c}"), d).alias(c) for c, d in defaults.items()])


@query("K4_update_from_join", "SELECT c.c_custkey, COALESCE(x.n, 0) AS orders, COALESCE(x.last_price, c.c_acctbal) AS stamp FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS last_price FROM orders GROUP BY 1) x ON c.c_custkey = x.o_custkey")
def _(t):
    changes = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("stamp"))
    return update_from(t.customer.select("c_custkey", "c_acctbal"), changes, ["c_custkey"], {"orders": F.lit(0), "stamp": F.col("c_acctbal")}).drop("c_acctbal")


def prune(store: DataFrame, key: str, present: DataFrame, keep_prefix: str) -> DataFrame:
    """K5: the store without keys that are not in ``present`` (one column of that name); keys of the prefix always stay."""
    found = store.join(present.distinct().withColumn("present_", F.lit(True)), key, "left")
    return found.where(F.startswith(key, F.lit(keep_prefix)) | F.col("present_").isNotNull()).drop("present_")


@query("K5_prune", "SELECT p_name || '-' || p_partkey AS path, p_size FROM part WHERE starts_with(p_name, 'small') OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def _(t):
    path = F.concat_ws("-", "p_name", "p_partkey").alias("path")
    present = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).join(t.part, "p_partkey").select(path)
    return prune(t.part.select(path, "p_size"), "path", present, "small")


def replace_partition(store: DataFrame, rows: DataFrame, part: Column) -> DataFrame:
    """K6: the store with all rows of one part (a condition) replaced by ``rows``; where the condition is null a row stays."""
    return store.where(~F.coalesce(part, F.lit(False))).unionByName(rows)


@query("K6_replace_partition", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_custkey, o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
def _(t):
    names = ["o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"]
    rows = t.orders.select(*names).where("o_orderstatus = 'P' and o_totalprice > 200000").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return replace_partition(t.orders.select(*names), rows, F.col("o_orderstatus") == "P").drop("o_orderstatus")


def toggled(rows: DataFrame, *key: str) -> DataFrame:
    """K7: the state of a switch that each row flips: on after an odd number of rows."""
    return rows.groupBy(*key).agg(F.count("*").alias("toggles")).withColumn("liked", F.col("toggles") % 2 == 1)


@query("K7_toggle", "SELECT user_id, count(*) AS toggles, count(*) % 2 = 1 AS liked FROM events WHERE event_type = 'click' GROUP BY user_id")
def _(t):
    return toggled(t.events.where("event_type = 'click'"), "user_id")


