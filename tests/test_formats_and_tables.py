"""Data sources over folders of archives and registry dumps, and table functions in SQL."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from cairnflow.functions import tables as T
from cairnflow.operators import procedural as P
from cairnflow.sources import formats, registries as G


def archive(path, members, mode="w:gz", cut=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    path.write_bytes(out.getvalue()[:cut])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    archive(tmp_path / "in/a.tar.gz", [("ok.txt", "grün".encode()), ("../out.txt", b"x"), ("/abs.txt", b"x"), ("a/../../b", b"x"), ("link", None), ("large.bin", b"y" * 5000), ("empty", b"")])
    archive(tmp_path / "in/deep/b.tar", [(f"f{i}.py", f"print({i})".encode()) for i in range(450)], "w")
    archive(tmp_path / "in/c.tar", [("first", b"1" * 600), ("second", b"2" * 100_000)], "w", 40_000)
    (tmp_path / "in/note.md").write_text("no archive")
    return tmp_path


def test_archives(spark, folder):
    formats.register(spark)
    rows = spark.read.format("archives").option("pattern", "*.tar*").option("most_bytes", 4000).load(f"file://{folder}/in").collect()
    of = lambda end: [r for r in rows if r.archive.endswith(end)]
    assert {(r.member, r.size, r.text) for r in of("a.tar.gz")} == {("ok.txt", 5, "grün"), ("large.bin", 5000, None), ("empty", 0, "")}
    assert {r.text for r in of("b.tar")} == {f"print({i})" for i in range(450)}
    cut = of("c.tar")
    assert cut[0].member == "first" and cut[-1].member is None and cut[-1].error
    assert spark.read.format("archives").load(f"file://{folder}/in/deep").rdd.getNumPartitions() == 1
    assert spark.read.format("archives").load(f"file://{folder}/none").count() == 0


def test_archives_as_a_stream(spark, folder):
    formats.register(spark)

    def run():
        stream = spark.readStream.format("archives").option("pattern", "*.tar*").option("files_per_batch", 1).load(f"file://{folder}/in")
        made = stream.where("member is not null").writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).start()
        made.processAllAvailable()
        made.stop()
        return spark.read.parquet(str(folder / "out")).groupBy(F.element_at(F.split("archive", "/"), -1).alias("a")).count().collect()

    assert {r.a: r["count"] for r in run()} == {"a.tar.gz": 3, "b.tar": 450, "c.tar": 1}
    archive(folder / "in/d.tar", [("new", b"n")], "w")
    assert {r.a: r["count"] for r in run()} == {"a.tar.gz": 3, "b.tar": 450, "c.tar": 1, "d.tar": 1}  # nothing is read again


def test_registry_dumps(spark, tmp_path):
    formats.register(spark)
    for name, data in {
        "npm/a.jsonl": "\n".join(json.dumps(d) for d in ({"name": "left", "keywords": ["a"], "repository": {"url": "git+https://x/left.git"}}, {"name": "@types/left"}, {"name": "left", "description": "again"}, {"no": 1})) + "\nbroken\n",
        "pypi/b.json": json.dumps([{"info": {"name": "Numb", "keywords": "x, y", "classifiers": ["Other", "Topic :: Database :: Z", "Framework :: Q"], "project_urls": {"Homepage": "h"}}}, {"info": {}}]),
        "maven/c.json": json.dumps({"response": {"docs": [{"g": "org.x", "a": "Core"}]}}),
        "crates/d.json": json.dumps({"crates": [{"id": "serde", "keywords": ["k"], "repository": "https://x/serde.git", "categories": ["encoding"]}]}),
        "services/e.json": json.dumps({"provider": "cloud", "services": [{"id": "Run-Jobs", "name": "Run Jobs"}]}),
    }.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(data)
    (tmp_path / "curated").mkdir()
    (tmp_path / "curated/f.json.gz").write_bytes(gzip.compress(json.dumps({"ecosystem": "skills", "entries": [{"name": "SQL", "category": "data", "aliases": ["sql"]}]}).encode()))
    read = lambda k: spark.read.format("registry").option("registry", k).load(f"file://{tmp_path}/{k}")
    npm = G.kept(read("npm")).collect()
    assert [(r.identifier, r.keywords, r.repository) for r in npm] == [("left", ["a"], "https://x/left")]
    prefixes = spark.createDataFrame([(0, "Framework ::", "web"), (1, "Topic :: Database", "database")], "place int, prefix string, category string")
    assert [(r.identifier, r.display, r.keywords, r.repository, r.category) for r in G.categorised(read("pypi"), prefixes).collect()] == [("numb", "Numb", ["x", "y"], "h", "database")]
    assert [(r.identifier, r.canonical) for r in read("maven").collect()] == [("org.x:Core", "core")]
    assert [(r.ecosystem, r.repository, r.classes) for r in read("crates").collect()] == [("cargo", "https://x/serde", ["encoding"])]
    assert [r.canonical for r in read("services").collect()] == ["cloud_run_jobs"]
    assert [(r.canonical, r.classes) for r in read("curated").collect()] == [("sql", ["data"])]
    said = spark.createDataFrame([(" AWS_CDK ", ["Cdk ", "", None, "cdk"]), ("plain", None)], "n string, a array<string>").select(*[c.alias(k) for c, k in zip(G.names(F.col("n"), F.col("a")), "xy")]).collect()
    assert [(r.x, r.y) for r in said] == [("aws cdk", ["aws_cdk", "cdk"]), ("plain", [])]


def test_table_functions_in_sql(spark):
    T.register(spark, [(None, "mail", r"@", 0.8), (".py", "import", r"^import ", 0.9)], shout=T.per_text(lambda x: [(x.upper(),)], "loud string"))
    text = "# One\n" + "word " * 30 + "\n\n## Two\n" + "more text here. " * 10
    code = "import os\n\n\ndef f(x):\n    return x\n\n\nclass A:\n    y = 'a@b'\n"
    frame = spark.createDataFrame([(1, "a.md", text), (2, "b.py", code), (3, "c.md", None)], "id int, path string, text string")
    chunks = spark.sql("SELECT f.id, c.* FROM {f} f, LATERAL markdown_chunks(f.text) c WHERE f.path LIKE '%.md'", f=frame).collect()
    assert [(r.part, r.heading, r.chunk) for r in chunks] == P.markdown_chunks(text)
    parts = spark.sql("SELECT f.id, c.* FROM {f} f, LATERAL code_chunks(f.text, true) c WHERE f.path LIKE '%.py'", f=frame).collect()
    assert [(r.part, r["first"], r["last"], list(r.names), r.code) for r in parts] == P.code_chunks(code, True)
    hits = spark.sql("SELECT f.id, c.* FROM {f} f, LATERAL line_topics(f.text, f.path) c", f=frame).collect()
    assert sorted((r.id, r.line, r.topic) for r in hits) == [(2, 1, "import"), (2, 9, "mail")]
    assert [r.loud for r in spark.sql("SELECT * FROM shout('a')").collect()] == ["A"]
    sizes = [5, 9, 50, 1, 1, 1, 7, 30, 2]
    rows = spark.createDataFrame([(g, i, n) for g in ("x", "y") for i, n in enumerate(sizes)], "g string, o int, size int").repartition(4)
    found = spark.sql("SELECT * FROM packs(TABLE(SELECT * FROM {r}) PARTITION BY g ORDER BY (o), 3, 20)", r=rows).collect()
    for g in ("x", "y"):
        assert [r.pack for r in sorted((r for r in found if r.g == g), key=lambda r: r.o)] == P.packs(sizes, 3, 20)
