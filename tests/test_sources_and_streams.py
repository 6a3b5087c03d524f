import random
import io
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairnflow.operators.relational import insert_missing, prune, upsert
from cairnflow.operators.scoring import connected_components
from cairnflow.sources import readers as R
from cairnflow.streaming import state as S


def test_globs():
    rule = R.any_glob(("**/*.md", "src/*.ts"))
    import re

    assert [bool(re.search(rule, p)) for p in ("a.md", "x/y/a.md", "src/a.ts", "src/b/a.ts", "a.mdx")] == [True, True, True, False, False]


def test_archives_keep_members_inside(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, body in (("ok/a.txt", b"hello"), ("../out.txt", b"no"), ("/abs.txt", b"no")):
            m = tarfile.TarInfo(name)
            m.size = len(body)
            tar.addfile(m, io.BytesIO(body))
    rows = R.archive_members(R.files(spark, str(tmp_path), "*.tar")).collect()
    assert [(r.member, r.text) for r in rows] == [("ok/a.txt", "hello")]


def test_docx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t></w:p><w:p><w:t>T</w:t><w:t>wo</w:t></w:p></w:document>')
    (tmp_path / "b.docx").write_bytes(b"no zip")
    assert sorted(r.text or "" for r in R.docx_text(R.files(spark, str(tmp_path), "*.docx")).collect()) == ["", "One\nTwo"]


def test_formats_round_trip(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/nation.parquet")
    for kind in ("parquet", "orc", "json", "csv"):
        rows.write.format(kind).options(header="true").save(f"{tmp_path}/nation.{kind}")
        assert R.table(spark, str(tmp_path), "nation", kind, header="true").count() == rows.count()


def test_upsert_is_idempotent(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 3)], "k int, v string, at int")
    once = upsert(store, rows, ["k"], "v", "at")
    assert {(r.k, r.v, r.status) for r in once.collect()} == {(1, "a", "kept"), (2, "y", "updated"), (3, "z", "inserted")}
    twice = upsert(once.drop("status"), rows, ["k"], "v", "at")
    assert {r.status for r in twice.collect()} == {"kept", "skipped"}
    assert insert_missing(store, store, ["k"]).count() == 2


def test_prune_of_an_empty_list_keeps_the_prefix_only(spark):
    store = spark.createDataFrame([("_commits/1",), ("a",)], "path string")
    assert [r.path for r in prune(store, "path", store.where("false"), "_commits/").collect()] == ["_commits/1"]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7)] + [(i, i + 1) for i in range(20, 60)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert found[5] == 3 and found[9] == 8 and found[7] == 7 and found[60] == 20


def test_components_of_a_long_shuffled_chain(spark):
    ids = list(range(1000, 2000))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    found = connected_components(edges, "a", "b").collect()
    assert {r.node for r in found} == set(ids) and {r.component for r in found} == {1000}


@pytest.fixture()
def events(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "events.parquet"))
    return rows, str(tmp_path)


def test_stream_windows_match_batch(spark, events):
    rows, folder = events
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/events.parquet")
    got = S.drained(S.stream_windows(stream, "ts", "6 hours", ["event_type"]), "win", "complete")
    want = rows.groupBy(F.window("ts", "6 hours"), "event_type").count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stream_dedup_keeps_one_of_each(spark, events):
    rows, folder = events
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/events.parquet").withColumn("delivery", F.col("event_id") % 50)
    got = S.drained(S.stream_dedup(stream, ["delivery"], "ts", "60 days"), "dedup")
    assert got.count() == 50


def test_stream_cooldown_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, m)) for m in (0, 2, 30, 31, 50)] + [("b", datetime(2024, 1, 1))], "k string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = S.drained(S.stream_cooldown(stream, "k", "ts", 5), "cool").collect()
    want = S.first_of_bursts(rows, "k", "ts", "ts", 5).collect()
    assert sorted((r.k, r.ts) for r in got) == sorted((r.k, r.ts) for r in want)
