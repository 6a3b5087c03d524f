"""Grounding of texts in what was ingested: cited paths, aliases in prose, passages behind skills; spans of personal data; undeveloped terms."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as X
from ..registry import query
from . import procedural as P
from .retrieval import few

# -- C29: cited paths ----------------------------------------------------------------

# Endings that make a word without a slash a file name.
ENDINGS = "ts tsx js jsx mjs cjs py go rs java rb sql md yml yaml json toml sh".split()
_ENDING = r"\.(?:" + "|".join(ENDINGS) + ")$"


def cited_paths(text: Column) -> Column:
    """The paths that a text cites, each once, in order: words with a slash, and file names with a known ending; signs that end a sentence are taken off."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_@][A-Za-z0-9_@.-]*(?:/[A-Za-z0-9_@.*-]+)*"), 0)
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"[),.;:]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: F.contains(w, F.lit("/")) | w.rlike(_ENDING)))


def grounded(citations: DataFrame, known: DataFrame) -> DataFrame:
    """``citations`` (with a column cited) with ``rule``: exact, glob or basename, null where no known path (path) bears the citation out.

    A glob holds if its folders before the first star are those of a known path, of its ending if it has one; a name without a slash if a known path
    ends in it; any other path must be known as it is. Known paths are laid out by each of their folders, once for each ending, so every rule is an
    equi-join."""
    known = known.select("path").distinct()
    cited = citations.select("cited").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ending = lambda c: F.regexp_extract(c, f"({_ENDING})", 1)
    folders = known.select(F.explode(above).alias("folder"), ending("path").alias("e")).distinct()
    folders = folders.union(folders.select("folder", F.lit("").alias("e"))).distinct()
    globs = cited.where(F.contains("cited", F.lit("*"))).select("cited", F.regexp_replace(F.regexp_extract("cited", r"^[^*]*/", 0), "/$", "").alias("folder"), ending("cited").alias("e"))
    by_glob = globs.join(folders, ["folder", "e"], "left_semi").select("cited", F.lit("glob").alias("glob"))
    names = known.select(F.element_at(parts, -1).alias("cited")).distinct().select("cited", F.lit("basename").alias("basename"))
    exact = known.select(F.col("path").alias("cited"), F.lit("exact").alias("exact"))
    plain = ~F.contains("cited", F.lit("*")) & ~F.contains("cited", F.lit("/"))
    found = cited.join(exact, "cited", "left").join(by_glob, "cited", "left").join(names, "cited", "left")
    rules = found.select("cited", F.coalesce("exact", "glob", F.when(plain, F.col("basename"))).alias("rule"))
    return citations.join(rules, "cited")


_PAGE_PATHS = "SELECT DISTINCT regexp_replace(split_part(url, '?', 1), '^[a-z]+://[^/]+/', '') || CASE page_id % 3 WHEN 0 THEN '/index.ts' WHEN 1 THEN '/notes.md' ELSE '' END AS path FROM pages WHERE page_id % 4 <> 0"


@query(
    "C29_path_grounding",
    f"""WITH k AS ({_PAGE_PATHS}),
    c AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'en/*/index.ts' WHEN 1 THEN 'notes.md' WHEN 2 THEN 'xx/**' WHEN 3 THEN regexp_replace(split_part(url, '?', 1), '^[a-z]+://[^/]+/', '') ELSE 'fr/' || page_id || '/*.md' END AS cited FROM pages),
    r AS (SELECT page_id, cited, regexp_replace(regexp_extract(cited, '^[^*]*/'), '/$', '') AS pre, regexp_extract(cited, '(\\.(?:{"|".join(ENDINGS)}))$', 1) AS e FROM c)
    SELECT page_id, cited, CASE WHEN cited IN (SELECT path FROM k) THEN 'exact'
      WHEN contains(cited, '*') THEN CASE WHEN pre <> '' AND EXISTS (SELECT 1 FROM k WHERE (path = pre OR starts_with(path, pre || '/')) AND (e = '' OR ends_with(path, e))) THEN 'glob' END
      WHEN NOT contains(cited, '/') THEN CASE WHEN EXISTS (SELECT 1 FROM k WHERE string_split(path, '/')[-1] = cited) THEN 'basename' END END AS rule FROM r""",
)
def _(t):
    inside = F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "^[a-z]+://[^/]+/", "")
    end = F.when(F.col("page_id") % 3 == 0, "/index.ts").when(F.col("page_id") % 3 == 1, "/notes.md").otherwise("")
    known = t.pages.where("page_id % 4 <> 0").select(F.concat(inside, end).alias("path"))
    kind = F.col("page_id") % 5
    cited = F.when(kind == 0, "en/*/index.ts").when(kind == 1, "notes.md").when(kind == 2, "xx/**").when(kind == 3, inside).otherwise(F.concat(F.lit("fr/"), "page_id", F.lit("/*.md")))
    return grounded(t.pages.select("page_id", cited.alias("cited")), known).select("page_id", "cited", "rule")


# -- C33: aliases in prose -----------------------------------------------------------

# Vendors before whose products two words are one name, and phrases that make a line say the opposite.
VENDORS = ("aws", "amazon", "azure", "google", "gcp", "apache")
NEGATIONS = ("not using", "no longer using", "instead of", "rejected", "considered but", "never adopted", "moved away from", "migrated from", "deprecated")


def alias_mentions(files: DataFrame, key: str, text: str, aliases: DataFrame, vendors: tuple[str, ...] = VENDORS, negations: tuple[str, ...] = NEGATIONS, least: int = 4, most: int = 200) -> DataFrame:
    """(key, line, alias) of the aliases (alias, lower case) that a file's lines name, each once a line, the first ``most`` of a file: words, and a vendor with
    the word behind it joined by an underscore. Lines with a negation name nothing, nor do aliases of under ``least`` letters. Lines and words stay in
    their task until they meet an alias."""
    said = "|".join(n.replace(" ", r"\s+") for n in negations)
    lines = files.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "said")).withColumn("said", F.lower("said"))
    lines = lines.where(~F.col("said").rlike(rf"(?:^|[^a-z0-9_])(?:{said})(?:$|[^a-z0-9_])")) if negations else lines
    words = F.transform(F.regexp_extract_all("said", F.lit("[a-z0-9_@./-]+"), 0), lambda w: F.regexp_replace(w, "[._/-]+$", ""))

    def with_pairs(ws: Column) -> Column:
        each = lambda w, i: F.when(w.isin(*vendors) & (F.length(F.coalesce(F.get(ws, i + 1), F.lit(""))) > 0), F.array(w, F.concat(w, F.lit("_"), F.get(ws, i + 1)))).otherwise(F.array(w))
        return F.flatten(F.transform(ws, each))

    words = X.bound(words, with_pairs) if vendors else words
    named = lines.select(key, (F.col("line") + 1).alias("line"), F.posexplode(F.filter(words, lambda w: F.length(w) >= least)).alias("at", "alias"))
    hits = named.join(few(aliases.select("alias").distinct(), 1_000_000), "alias").groupBy(key, "line", "alias").agg(F.min("at").alias("at"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("line", "at"))
    return hits.withColumn("rn_", rank).where(F.col("rn_") <= most).select(key, "line", "alias")


@query(
    "C33_alias_scan",
    """WITH a(alias) AS (VALUES ('idiot'), ('trash'), ('with'), ('and'), ('aws_the'), ('google_of'), ('tion'), ('from')),
    f AS (SELECT doc_id, replace(replace(replace(text, ' stupid', ' AWS the'), ' on ', ' Google of '), ' worthless', ' no longer using') AS text FROM documents),
    l AS (SELECT doc_id, i AS line, lower(string_split(text, chr(10))[i]) AS said FROM f, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)),
    k AS (SELECT doc_id, line, list_transform(regexp_extract_all(said, '[a-z0-9_@./-]+'), lambda w: regexp_replace(w, '[._/-]+$', '')) AS ws FROM l WHERE NOT regexp_matches(said, '(?:^|[^a-z0-9_])(?:no\\s+longer\\s+using|instead\\s+of|rejected|deprecated)(?:$|[^a-z0-9_])')),
    w AS (SELECT doc_id, line, j, ws[j] AS alias, 0 AS pair FROM k, unnest(range(1, len(ws) + 1)) AS r(j) UNION ALL SELECT doc_id, line, j, ws[j] || '_' || ws[j + 1], 1 FROM k, unnest(range(1, len(ws))) AS r(j) WHERE ws[j] IN ('aws', 'google')),
    h AS (SELECT doc_id, line, alias, min(j * 2 + pair) AS at_ FROM w SEMI JOIN a USING (alias) WHERE length(alias) >= 4 GROUP BY ALL)
    SELECT doc_id, line, alias FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, at_) AS rn FROM h) WHERE rn <= 20""",
)
def _(t):
    text = F.replace(F.replace(F.replace("text", F.lit(" stupid"), F.lit(" AWS the")), F.lit(" on "), F.lit(" Google of ")), F.lit(" worthless"), F.lit(" no longer using"))
    aliases = t.spark.createDataFrame([(x,) for x in ("idiot", "trash", "with", "and", "aws_the", "google_of", "tion", "from")], "alias string")
    return alias_mentions(t.documents.select("doc_id", text.alias("text")), "doc_id", "text", aliases, most=20).select("doc_id", F.col("line").cast("long").alias("line"), "alias")


# -- D9: passages behind skills ------------------------------------------------------

# Words that name no tool, short names that do, and phrases that say a tool was left.
GENERIC = "and the with for via from into over using management engineering development experience skills".split()
SHORT_TOOLS = "sql go aws eks iam cdk gcp ci cd".split()
LEFT = ("migrated away from", "no longer", "deprecated", "replaced", "moved off", "sunset")


def attached_passages(ledger: DataFrame, passages: DataFrame, most: int = 3, window: int = 8, snippet: int = 200) -> DataFrame:
    """(entry, pid, hits, cosine, snippet, rank): for each entry (entry, tool, status) that is no gap the ``most`` passages (pid, cosine, text) that name at
    least half of its tool's words, most words first, then by cosine. A passage that names one of them within ``window`` words of a phrase that says it was left
    does not count.

    The tools' words are few and are looked for in a passage where it lies; only what was found is joined with the entries."""
    parts = F.filter(F.split(F.lower("tool"), "[^a-z0-9]+"), lambda w: ((F.length(w) >= 4) | w.isin(*SHORT_TOOLS)) & ~w.isin(*GENERIC))
    entries = ledger.where("status <> 'gap'").select("entry", parts.alias("tokens")).where(F.size("tokens") > 0)
    each = entries.select("entry", F.greatest(F.lit(1), F.ceil(F.size("tokens") / 2)).alias("needed"), F.explode("tokens").alias("token"))
    all_ = few(each.agg(F.collect_set("token").alias("all_")))
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    left = r"(?:^|[^a-z0-9])(?:" + "|".join(LEFT) + r")(?:$|[^a-z0-9])"
    held = passages.join(all_).select("pid", "cosine", "text", F.lower("text").alias("hay"), words.alias("ws"), "all_")
    names = lambda token: F.when(token.isin(*SHORT_TOOLS), F.array_contains("ws", token)).otherwise(F.contains("hay", token))
    near = lambda i: F.array_join(F.slice("ws", F.greatest(i - window, F.lit(0)) + 1, i + window + 1 - F.greatest(i - window, F.lit(0))), " ")
    denied = lambda token: F.exists(F.transform("ws", lambda w, i: F.when(F.contains(w, token), near(i).rlike(left))), lambda x: F.coalesce(x, F.lit(False)))
    found = held.withColumn("said", F.filter("all_", names)).where(F.size("said") > 0)
    found = found.select("pid", "cosine", F.substring("text", 1, snippet).alias("snippet"), F.explode("said").alias("token"), F.when(F.lower("text").rlike(left), F.col("ws")).alias("ws"))
    found = found.withColumn("denied", F.when(F.col("ws").isNull(), F.lit(False)).otherwise(denied(F.col("token")))).drop("ws")
    met = found.join(F.broadcast(each), "token").groupBy("entry", "pid").agg(F.count("*").alias("hits"), F.first("needed").alias("needed"), F.bool_or("denied").alias("denied"), F.first("cosine").alias("cosine"), F.first("snippet").alias("snippet"))
    rank = F.row_number().over(W.partitionBy("entry").orderBy(F.desc("hits"), F.desc(F.coalesce("cosine", F.lit(0.0))), "pid"))
    return met.where("hits >= needed and not denied").withColumn("rank", rank).where(F.col("rank") <= most).select("entry", "pid", "hits", "cosine", "snippet", "rank")


@query(
    "D9_passage_provenance",
    """WITH e AS (SELECT item_id AS entry, CASE item_id % 4 WHEN 0 THEN 'Idiot and Trash' WHEN 1 THEN 'SQL token experience' WHEN 2 THEN 'stupid-worthless idiot' ELSE 'with the' END AS tool, CASE WHEN item_id % 10 = 0 THEN 'gap' ELSE 'verified' END AS status FROM benchmark),
    p AS (SELECT doc_id AS pid, (doc_id % 97) / 100.0::DOUBLE AS cosine, replace(text, ' for ', ' no longer ') AS text FROM documents),
    k AS (SELECT entry, list_filter(regexp_split_to_array(lower(tool), '[^a-z0-9]+'), lambda w: (length(w) >= 4 OR w IN ('sql')) AND w NOT IN ('and', 'the', 'with', 'experience')) AS ts FROM e WHERE status <> 'gap'),
    x AS (SELECT pid, cosine, text, lower(text) AS hay, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 0) AS ws FROM p),
    m AS (SELECT entry, pid, cosine, text, ws, ts, list_filter(ts, lambda t: CASE WHEN t = 'sql' THEN list_contains(ws, t) ELSE contains(hay, t) END) AS hit FROM k JOIN x ON TRUE WHERE len(ts) > 0),
    n AS (SELECT *, len(hit) AS hits FROM m WHERE len(hit) >= greatest(1, ceil(len(ts) / 2))),
    g AS (SELECT * FROM n WHERE NOT contains(lower(text), 'no longer') OR len(list_filter(hit, lambda t: len(list_filter(range(1, len(ws) + 1),
      lambda i: contains(ws[i], t) AND contains(' ' || array_to_string(list_slice(ws, greatest(i - 8, 1), i + 8), ' ') || ' ', ' no longer '))) > 0)) = 0)
    SELECT entry, pid, hits, cosine, substr(text, 1, 200) AS snippet, rank FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY hits DESC, cosine DESC, pid) AS rank FROM g) WHERE rank <= 3""",
)
def _(t):
    kind = F.col("item_id") % 4
    tool = F.when(kind == 0, "Idiot and Trash").when(kind == 1, "SQL token experience").when(kind == 2, "stupid-worthless idiot").otherwise("with the")
    ledger = t.benchmark.select(F.col("item_id").alias("entry"), tool.alias("tool"), F.when(F.col("item_id") % 10 == 0, "gap").otherwise("verified").alias("status"))
    passages = t.documents.select(F.col("doc_id").alias("pid"), (F.col("doc_id") % 97 / F.lit(100.0)).alias("cosine"), F.replace("text", F.lit(" for "), F.lit(" no longer ")).alias("text"))
    return attached_passages(ledger, passages)


# -- D13: experience coverage ----------------------------------------------------------

# Words of a requirement that only stress it.
EMPHASIS = frozenset("mission critical rapid rapidly complex deep extensive engineering analysis management".split())


@lru_cache(1 << 16)
def light_stem(word: str) -> str:
    """A word in lower case without a last -ly or -ing, where four letters stay."""
    low = word.lower()
    for end in ("ly", "ing"):
        if low.endswith(end) and len(low) - len(end) >= 4:
            return low[: -len(end)]
    return low


@lru_cache(4)
def stemmed_text(text: str) -> str:
    """A text with its words stemmed, once for all skills that are looked for in it."""
    return re.sub("[A-Za-z]+", lambda m: light_stem(m[0]), text)


def shows_skill(skill: str, text: str, emphasis: frozenset[str] = EMPHASIS) -> bool:
    """Whether a text shows a required skill: its words but those of emphasis stand together there (M2), as they are or stemmed; or, of "base (one, two, ...)", the base
    does or one of the members is named."""

    def core(what: str) -> bool:
        words = re.findall("[a-z0-9]+", what.lower())
        words = [w for w in words if w not in emphasis] or words
        if P.near_phrase(" ".join(words), text):
            return True
        stems = [light_stem(w) for w in words]
        if text.isascii() and any(w.isalpha() and w not in text.lower() for w in stems):
            return False  # a word's stem is how it begins, so one that is nowhere in the text is no stem of its words
        return P.near_phrase(" ".join(stems), stemmed_text(text))

    if core(skill):
        return True
    base, opened, rest = skill.strip().partition("(")
    if not opened or not rest.endswith(")"):
        return False
    padded = f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "
    members = (" ".join(re.findall("[a-z0-9]+", m.lower())) for m in rest[:-1].split(","))
    return bool(base.strip()) and core(base) or any(len(m) >= 3 and f" {m} " in padded for m in members)


def experience_coverage(bullets: DataFrame, targets: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """(key, skill, covered): for each group of bullets (key, text, sources) whether one of them covers each target (skill, anchors): a bullet with a source among the
    anchors does, or one whose text shows the skill. At most ``most`` targets, which go to every task."""
    import pyarrow as pa

    wanted = [(r.skill, frozenset(r.anchors or ())) for r in targets.select("skill", "anchors").distinct().limit(most + 1).collect()]
    if len(wanted) > most:
        raise ValueError(f"more than {most} targets: split them and run one part after the other")

    def run(batches):
        seen: set = set()  # what this task has found for a group: its later bullets need not show it again
        for batch in batches:
            keys, hits, skills = batch.column(0), [], []
            for i, (k, text, sources) in enumerate(zip(keys.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                held = set(sources or ())
                for skill, anchors in wanted:
                    if (k, skill) not in seen and (anchors & held or text and shows_skill(skill, text)):
                        hits.append(i)
                        skills.append(skill)
                        seen.add((k, skill))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(hits, pa.int64())), pa.array(skills, pa.string())], [key, "skill"])
            if len(seen) > 1_000_000:
                seen.clear()

    kind = bullets.schema[key].dataType.simpleString()
    covered = bullets.select(key, "text", "sources").mapInArrow(run, f"`{key}` {kind}, skill string").distinct().withColumn("hit_", F.lit(True))
    every = bullets.select(key).distinct().join(F.broadcast(targets.select("skill").distinct()))
    return every.join(covered, [key, "skill"], "left").select(key, "skill", F.coalesce("hit_", F.lit(False)).alias("covered"))


_TARGETS = [("idiot trash", None), ("deeply idiotic (stupid, worthless things, etc.)", None), ("mission critical", ["3"]), ("rapid trashing", None), ("no such skill", None)]


@query("D13_experience_coverage")
def _(t):
    lines = t.documents.select("source", F.array(F.pmod("doc_id", F.lit(50)).cast("string")).alias("sources"), F.explode(F.split("text", "\n")).alias("text"))
    targets = t.spark.createDataFrame(_TARGETS, "skill string, anchors array<string>")
    return experience_coverage(lines.where("source is not null and length(text) > 0"), targets, "source")


# -- H1, H2: spans on the original text ----------------------------------------------

#: Words after which two capitalised words are a person's name.
NAME_LABELS = ("name", "candidate", "applicant")
_NAME = re.compile(r"(?i:\b(?:" + "|".join(NAME_LABELS) + r")\b)[:\s]+([A-Z][a-z]+ [A-Z][a-z]+)")
_KINDS = [(kind, re.compile(rule)) for kind, rule in X.PII]


def pii_spans(text: str) -> list[tuple[int, int, str, str]]:
    """H1: (start, end, kind, value) of all kinds on one text, by start, then in the order of kinds; they may overlap."""
    found = [(m.start(), m.end(), kind, m[0]) for kind, rule in _KINDS for m in rule.finditer(text)]
    found += [(m.start(1), m.end(1), "NAME", m[1]) for m in _NAME.finditer(text)]
    return sorted(found, key=lambda s: s[0])


def scrubbed(text: str) -> str:
    """H2: a text with each of its spans replaced by its kind, from the last to the first, so that earlier places stay."""
    for start, end, kind, _ in reversed(pii_spans(text)):
        text = f"{text[:start]}[{kind}]{text[end:]}"
    return text


@query("H1_pii_spans")
def _(t):
    named = F.concat("text", F.lit("\nCandidate: Ada Lovelace, 078-05-1120 "), F.col("doc_id").cast("string"))
    return P.per_text(t.documents.select("doc_id", named.alias("text")), "doc_id", "text", "start int, end int, kind string, value string", pii_spans)


@query("H2_span_scrub")
def _(t):
    named = F.concat("text", F.lit("\nCandidate: Ada Lovelace, 078-05-1120 "), F.col("doc_id").cast("string"))
    return P.per_text(t.documents.select("doc_id", named.alias("text")), "doc_id", "text", "scrubbed string", lambda x: [(scrubbed(x),)])


# -- H8, N8 --------------------------------------------------------------------------


def without_section(xml: Column, name: str, by: str) -> Column:
    """H8: a document whose elements of a name, if they hold character data alone, are ``by``."""
    return F.regexp_replace(xml, rf"(?s)<{name}><!\[CDATA\[.*?\]\]></{name}>", by)


def without_cdata(text: Column) -> Column:
    """H8: what a text that is one character data section holds, trimmed; any other text as it is."""
    whole = r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$"
    return F.when(text.rlike(whole), F.regexp_replace(F.regexp_extract(text, whole, 1), r"^\s+|\s+$", "")).otherwise(text)


@query(
    "H8_section_strip",
    """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE ' <![CDATA[ ' || text || ']]> ' END AS one, '<a><letter><![CDATA[' || text || ']]></letter>' || CASE WHEN doc_id % 2 = 0 THEN '<letter>kept</letter>' ELSE '<letter><![CDATA[b]]></letter>' END || '</a>' AS two FROM documents)
    SELECT doc_id, md5(CASE WHEN starts_with(one, ' <![CDATA[') THEN regexp_replace(substr(one, 11, length(one) - 14), '^\\s+|\\s+$', '', 'g') ELSE one END) AS bare,
      CASE WHEN doc_id % 2 = 0 THEN '<a><letter omitted="true"/><letter>kept</letter></a>' ELSE '<a><letter omitted="true"/><letter omitted="true"/></a>' END AS sections FROM x""",
)
def _(t):
    one = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit(" <![CDATA[ "), "text", F.lit("]]> ")))
    last = F.when(F.col("doc_id") % 2 == 0, "<letter>kept</letter>").otherwise("<letter><![CDATA[b]]></letter>")
    two = F.concat(F.lit("<a><letter><![CDATA["), "text", F.lit("]]></letter>"), last, F.lit("</a>"))
    return t.documents.select("doc_id", F.md5(without_cdata(one)).alias("bare"), without_section(two, "letter", '<letter omitted="true"/>').alias("sections"))


def undeveloped(text: Column) -> Column:
    """Settings (inline code of 6 to 60 characters with a dot or an equals sign, no addresses) that a text names once and never shows between its first and last
    fence."""
    spans = F.regexp_extract_all(text, F.lit("`[^`\n]{6,60}`"), 0)
    fence = F.instr(text, "```")
    after = F.substring(text, fence + 3, F.length(text))
    back = F.instr(F.reverse(after), "```")
    shown = F.when((fence > 0) & (back > 0), F.substring(after, F.lit(1), F.length(after) - back - 2)).otherwise(F.lit(""))
    once = lambda ts: F.filter(F.array_distinct(ts), lambda s: F.size(F.filter(ts, lambda o: o == s)) == 1)
    terms = F.transform(once(spans), lambda s: F.substring(s, F.lit(2), F.length(s) - 2))
    return F.filter(terms, lambda s: s.rlike("[=.]") & ~s.rlike("^https?:") & ~F.contains(shown, s))


_ARTICLE = """COALESCE(text, '') || chr(10) || 'set `max.rate=' || doc_id || '` and `plain words` or `http://x.y/z`' || CASE doc_id % 4 WHEN 0 THEN chr(10) || '```' || chr(10) || 'max.rate=' || doc_id || chr(10) || '```' WHEN 1 THEN ' then `max.rate=' || doc_id || '` again' ELSE '' END"""


@query(
    "N8_single_mentions",
    f"""WITH x AS (SELECT doc_id, {_ARTICLE} AS article FROM documents), s AS (SELECT doc_id, article, unnest(regexp_extract_all(article, '`[^`\\n]{{6,60}}`')) AS span FROM x),
    n AS (SELECT doc_id, any_value(article) AS article, span[2:-2] AS term, count(*) AS k FROM s GROUP BY doc_id, span)
    SELECT doc_id, term FROM n WHERE k = 1 AND regexp_matches(term, '[=.]') AND NOT regexp_matches(term, '^https?:') AND NOT regexp_matches(article, '(?s)```.*' || regexp_escape(term) || '.*```')""",
)
def _(t):
    return t.documents.select("doc_id", F.explode(undeveloped(F.expr(_ARTICLE.replace("chr(10)", "char(10)")))).alias("term"))


# -- C31: cloud resources and registries ----------------------------------------------

# Accounts that stand for any in examples.
PLACEHOLDER_ACCOUNTS = ("000000000000", "123456789012")


def cloud_names(files: DataFrame, key: str, text: str, slugs: DataFrame, registry: str = "aws_ecr") -> DataFrame:
    """(key, ecosystem, name) of what a file names: the canonical name (slugs: slug, canonical; a small table) of each resource name's service, once, and the image
    registry if it holds the address of one. Resource names and addresses of placeholder accounts do not count, nor do services that are not known."""
    rule = F.lit("arn:aws:([a-z0-9-]+):([a-z0-9-]*):([0-9]{0,12}):")
    found = F.arrays_zip(F.regexp_extract_all(F.col(text), rule, 1).alias("slug"), F.regexp_extract_all(F.col(text), rule, 3).alias("account"))
    real = F.array_distinct(F.transform(F.filter(found, lambda x: ~x["account"].isin(*PLACEHOLDER_ACCOUNTS)), lambda x: x["slug"]))
    arns = files.select(key, F.explode(real).alias("slug")).join(F.broadcast(slugs), "slug").select(key, F.lit("aws-arn").alias("ecosystem"), F.col("canonical").alias("name")).distinct()
    hosts = F.regexp_extract_all(F.col(text), F.lit(r"(?:^|[^A-Za-z0-9_])([0-9]{12})[.]dkr[.]ecr[.][a-z0-9-]+[.]amazonaws[.]com/[a-zA-Z0-9_./-]"), 1)
    images = files.where(F.exists(hosts, lambda a: ~a.isin(*PLACEHOLDER_ACCOUNTS))).select(key, F.lit("image-uri").alias("ecosystem"), F.lit(registry).alias("name"))
    return arns.unionByName(images)


@query(
    "C31_cloud_names",
    """SELECT DISTINCT s_suppkey, 'aws-arn' AS ecosystem, CASE s_suppkey % 3 WHEN 0 THEN 'aws_s3' ELSE 'aws_sqs' END AS name FROM supplier WHERE s_suppkey % 3 < 2 AND (s_suppkey % 3 = 0 OR s_suppkey % 4 <> 0)
    UNION ALL SELECT s_suppkey, 'image-uri', 'aws_ecr' FROM supplier WHERE s_suppkey % 5 IN (1, 2)""",
)
def _(t):
    service = F.when(F.col("s_suppkey") % 3 == 0, "s3:::bucket").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("sqs:eu-west-1:"), F.when(F.col("s_suppkey") % 4 == 0, "123456789012").otherwise("998877665544"), F.lit(":q"))).otherwise("nosuch:::x")
    account = F.when(F.col("s_suppkey") % 5 == 1, "998877665544").when(F.col("s_suppkey") % 5 == 2, "111122223333").otherwise("000000000000")
    text = F.concat(F.lit("uses arn:aws:"), service, F.lit(" and arn:aws:"), service, F.lit("\nimage: "), account, F.lit(".dkr.ecr.eu-west-1.amazonaws.com/app:1"))
    slugs = t.spark.createDataFrame([("s3", "aws_s3"), ("sqs", "aws_sqs")], "slug string, canonical string")
    return cloud_names(t.supplier.select("s_suppkey", text.alias("text")), "s_suppkey", "text", slugs)
