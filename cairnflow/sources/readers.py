"""Sources and sinks: tables, folders of files, archives, registries, capped reads; exports and metrics."""

from __future__ import annotations

import io
import json
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..registry import plain, query

#: A file above it is left out.
MOST_BYTES = 500_000
INCLUDE = ("**/*.md", "**/*.ts", "**/*.py", "**/*.go", "**/*.tf", "**/*.json", "**/*.yml", "**/*.sql")
EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/*.min.js", "**/*.lock")


def glob_rule(pattern: str) -> str:
    """A glob as a regular expression: ``**/`` any folders, ``*`` within one, ``?`` one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (pattern[i] if pattern[i].isalnum() or pattern[i] in "/_-" else "\\" + pattern[i]), i + 1
    return f"^{out}$"


def any_glob(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{glob_rule(p)})" for p in patterns)


def included(path: Column, size: Column, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> Column:
    """Whether a file is taken; exclusion wins, large files are left out. One regular expression each."""
    return path.rlike(any_glob(include)) & ~path.rlike(any_glob(exclude)) & (size <= MOST_BYTES)


def table(spark: SparkSession, folder: str, name: str, kind: str = "parquet", **options) -> DataFrame:
    """A table of a folder in any of Spark's formats; predicates and columns reach its scan."""
    return spark.read.format(kind).options(**options).load(f"{folder}/{name}.{kind}")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, length, modified and content of a folder's files, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def safe_member(name: str) -> bool:
    """Whether an archive member stays inside: no absolute path, no parent folder."""
    p = PurePosixPath(name)
    return not p.is_absolute() and ".." not in p.parts


def archive_members(archives: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """S3: archive, member, size, text of the files in tar archives (path, content); unsafe members and links go, large ones have no text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    for m in tar:
                        if m.isfile() and safe_member(m.name):
                            text = tar.extractfile(m).read().decode("utf-8", "replace") if m.size <= most else None
                            rows.append((path, m.name, m.size, text))
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["archive", "member", "size", "text"])

    return archives.select("path", "content").mapInArrow(run, "archive string, member string, size long, text string")


def docx_text(docs: DataFrame) -> DataFrame:
    """Path and paragraphs of word-processor files (path, content); null text where a file is none."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(content: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{word}t")) for p in root.iter(f"{word}p"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([read(x.as_py()) for x in batch.column(1)], pa.string())], ["path", "text"])

    return docs.select("path", "content").mapInArrow(run, "path string, text string")


_PDF_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_SHOWN = re.compile(rb"(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[(?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<])*\])\s*(Tj|TJ|'|\")|\b(T\*|Td|TD|ET)\b", re.S)
_PDF_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(said: bytes) -> str:
    if said[:1] == b"<":
        digits = re.sub(rb"\s", b"", said[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPES.get(m[1], b"" if m[1] == b"\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, said[1:-1], flags=re.S).decode("latin-1")


def read_pdf(content: bytes) -> str | None:
    """The text that a PDF's content streams show, a line for each text line; plain and deflated streams, simple fonts; null if the bytes are no PDF."""
    if not content.startswith(b"%PDF-"):
        return None
    lines = [""]
    for head, data in _PDF_STREAM.findall(content):
        if b"/FlateDecode" in head:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        for shown, how, move in _PDF_SHOWN.findall(data):
            if move:
                lines += [""] * bool(lines[-1])
                continue
            lines += [""] * (how in (b"'", b'"') and bool(lines[-1]))
            lines[-1] += "".join(_pdf_string(x) for x in _PDF_STRING.findall(shown))
    return "\n".join(x.strip() for x in lines if x.strip())


def pdf_text(docs: DataFrame) -> DataFrame:
    """Path and text of PDF files (path, content); null text where a file is none."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([read_pdf(x.as_py()) for x in batch.column(1)], pa.string())], ["path", "text"])

    return docs.select("path", "content").mapInArrow(run, "path string, text string")


#: Bytes of a patch that are kept of a file, and of all files of a commit.
FILE_PATCH, COMMIT_PATCH = 64 << 10, 512 << 10


def commit_files(commits: DataFrame) -> DataFrame:
    """One row per file of commits as a hosting service returns them (body: JSON): sha, author, at, path, status, additions, deletions, patch and whether
    it is cut, at FILE_PATCH bytes of a file and COMMIT_PATCH bytes of a commit's files in their order."""
    kind = "sha string, commit struct<author: struct<name: string, date: timestamp>>, files array<struct<filename: string, status: string, additions: long, deletions: long, patch: string>>"
    each = commits.select(F.from_json("body", kind).alias("c")).where(F.col("c.sha").isNotNull())
    each = each.select(F.col("c.sha").alias("sha"), F.col("c.commit.author.name").alias("author"), F.col("c.commit.author.date").alias("at"), F.posexplode("c.files").alias("n", "f"))
    whole = F.coalesce(F.octet_length("f.patch"), F.lit(0))
    before = F.coalesce(F.sum(F.least(whole, F.lit(FILE_PATCH))).over(W.partitionBy("sha").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.least(F.lit(FILE_PATCH), F.greatest(F.lit(COMMIT_PATCH) - before, F.lit(0))).cast("int")
    cut = F.make_valid_utf8(F.substring(F.encode("f.patch", "UTF-8"), F.lit(1), room).cast("string"))
    patch = F.when(whole <= room, F.col("f.patch")).otherwise(F.regexp_replace(cut, "\uFFFD+$", ""))
    return each.select("sha", "author", "at", F.col("f.filename").alias("path"), "f.status", "f.additions", "f.deletions", patch.alias("patch"), (whole > room).alias("truncated"))


def contributors(pages: DataFrame) -> DataFrame:
    """Login and contributions of contributor pages (body: a JSON array), each login once with its sum."""
    rows = pages.select(F.inline(F.from_json("body", "array<struct<login: string, contributions: long>>")))
    return rows.where("login is not null").groupBy("login").agg(F.sum("contributions").alias("contributions"))


def pull_requests(pages: DataFrame) -> DataFrame:
    """Number, title, body, merged_at of pull request pages (body: a JSON array), each number once, the last by update."""
    kind = "array<struct<number: long, title: string, body: string, merged_at: timestamp, updated_at: timestamp>>"
    rows = pages.select(F.inline(F.from_json("body", kind))).where("number is not null")
    return rows.groupBy("number").agg(F.max_by(F.struct("title", "body", "merged_at"), "updated_at").alias("p")).select("number", "p.*")


def capped(content: Column, most: int) -> Column:
    """The first ``most`` bytes and whether there were more."""
    return F.struct(F.substring(content, 1, most).alias("body"), (F.octet_length(content) > most).alias("truncated"))


def registry_rows(raw: DataFrame, drop: str) -> DataFrame:
    """Name, alias of package rows (name); names that match ``drop`` go, underscores also give a spaced alias."""
    kept = raw.where(~F.col("name").rlike(drop)).select("name")
    return kept.select("name", F.explode(F.array_distinct(F.array(F.col("name"), F.replace("name", F.lit("_"), F.lit(" "))))).alias("alias"))


def dataset_card(docs: DataFrame, name: str) -> DataFrame:
    """K9: one row, the JSON-LD description of a corpus from its aggregates."""
    a = docs.agg(F.count("*").alias("records"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))
    return a.select(F.to_json(F.struct(F.lit("https://schema.org/").alias("@context"), F.lit("Dataset").alias("@type"), F.lit(name).alias("name"), F.col("records"), F.col("sources"), F.col("chars"))).alias("card"))


def prometheus(rows: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """K8: rows as lines of Prometheus text format."""
    said = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return rows.select(F.concat(F.lit(name + "{"), said, F.lit("} "), F.col(value).cast("string")).alias("line"))


def emf(row: dict, namespace: str, metrics: list[str]) -> str:
    """K8: one embedded-metric log line."""
    return json.dumps({"_aws": {"CloudWatchMetrics": [{"Namespace": namespace, "Dimensions": [[k for k in row if k not in metrics]], "Metrics": [{"Name": m} for m in metrics]}]}, **row}, sort_keys=True)


@query("S4_file_filter", f"WITH f AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path, length(html) AS size FROM pages) SELECT page_id FROM f WHERE regexp_matches(path, '{any_glob(('**/en/*', '**/fr/*'))}') AND NOT regexp_matches(path, '{any_glob(('m.*/**',))}') AND size <= 500000")
def _(t):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return t.pages.where(included(path, F.length("html"), ("**/en/*", "**/fr/*"), ("m.*/**",))).select("page_id")


@query("S6_registry_rows", "SELECT n_name AS name, unnest(list_distinct([n_name, replace(n_name, '_', ' ')])) AS alias FROM nation WHERE NOT regexp_matches(n_name, '1$')")
def _(t):
    return registry_rows(t.nation.select(F.col("n_name").alias("name")), "1$")


@query("S7_capped_body", "SELECT page_id, least(octet_length(encode(html)), 2000)::BIGINT AS n, octet_length(encode(html)) > 2000 AS truncated FROM pages")
def _(t):
    c = capped(F.col("html").cast("binary"), 2000)
    return t.pages.select("page_id", F.octet_length(c["body"]).cast("long").alias("n"), c["truncated"].alias("truncated"))


@query("S9_json_column", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.variant_get(F.parse_json("props"), "$.k", "long").alias("k")).agg(F.count("*").alias("n"))


@query("K8_metric_lines", "SELECT 'events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def _(t):
    return prometheus(t.events.groupBy("event_type").agg(F.count("*").alias("n")), "events_total", ["event_type"], "n")


@query("K9_dataset_card", "SELECT '{\"@context\":\"https://schema.org/\",\"@type\":\"Dataset\",\"name\":\"corpus\",\"records\":' || count(*) || ',\"sources\":' || count(DISTINCT source) || ',\"chars\":' || sum(n_chars) || '}' AS card FROM documents")
def _(t):
    return dataset_card(t.documents, "corpus")
