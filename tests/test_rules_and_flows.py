"""Operators whose results SQL does not give: parsers, readers, streams out of order and the flows, on small fixtures."""

import json
import math
import re
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairnflow.functions import text as X
from cairnflow.operators import documents as D, procedural as P, retrieval as V, scoring as C
from cairnflow.plans import flows
from cairnflow.sources import readers as R
from cairnflow.streaming import state as S


def pdf(*streams, head=b"/Length 1"):
    return b"%PDF-1.4\n" + b"".join(b"1 0 obj\n<<" + h + b">>\nstream\n" + s + b"\nendstream\nendobj\n" for h, s in streams) + b"%%EOF"


def test_pdf_text(spark):
    plain = (b"/Length 9", b"BT (Hello \\(you\\)) Tj 0 -12 Td [(W) -20 (or) <6C64>] TJ T* (caf\\351) ' ET")
    packed = (b"/Filter /FlateDecode", zlib.compress(b"BT (second) Tj ET"))
    image = (b"/Filter /DCTDecode", b"(not text) Tj")
    rows = spark.createDataFrame([("a.pdf", pdf(plain, packed, image)), ("b.pdf", b"no pdf"), ("c.pdf", pdf()), ("d.pdf", pdf((b"/Filter /FlateDecode", b"broken")))], "path string, content binary")
    got = {r.path: r.text for r in R.pdf_text(rows).collect()}
    assert got == {"a.pdf": "Hello (you)\nWorld\ncafé\nsecond", "b.pdf": None, "c.pdf": "", "d.pdf": ""}


def test_commit_files_cap_patches(spark, monkeypatch):
    monkeypatch.setattr(R, "FILE_PATCH", 10)
    monkeypatch.setattr(R, "COMMIT_PATCH", 15)
    files = [{"filename": "a", "status": "modified", "additions": 1, "deletions": 0, "patch": "x" * 8}, {"filename": "b", "status": "added", "patch": "é" * 9}, {"filename": "c", "patch": "z"}, {"filename": "d"}]
    body = json.dumps({"sha": "s1", "commit": {"author": {"name": "me", "date": "2024-01-01T00:00:00Z"}}, "files": files})
    got = {r.path: (r.patch, r.truncated) for r in R.commit_files(spark.createDataFrame([(body,), ("no json",)], "body string")).collect()}
    assert got["a"] == ("x" * 8, False) and got["d"] == (None, False) and got["c"] == ("", True)
    assert got["b"][1] and re.fullmatch("é{3}\ufffd?", got["b"][0])


def test_contributors_and_pull_requests(spark):
    pages = spark.createDataFrame([('[{"login": "a", "contributions": 2}, {"login": null}]',), ('[{"login": "a", "contributions": 3}]',)], "body string")
    assert [tuple(r) for r in R.contributors(pages).collect()] == [("a", 5)]
    pulls = spark.createDataFrame([('[{"number": 1, "title": "old", "updated_at": "2024-01-01T00:00:00Z"}, {"number": 1, "title": "new", "updated_at": "2024-01-02T00:00:00Z"}]',)], "body string")
    assert [r.title for r in R.pull_requests(pulls).collect()] == ["new"]


MANIFEST = """\
# a comment
apiVersion: apps/v1
kind: Deployment
metadata:
  name: web
  annotations:
    eks.amazonaws.com/role-arn: "arn:aws:iam::999988887777:role/x"
spec:
  template:
    spec:
      containers:
        - name: a
          image: registry.example/team/app:1.2@sha256:00
          args: ["--x", 'y']
        - name: b
          image: redis
---
apiVersion: v1
kind: RoleBinding
---
apiVersion: v1
kind: NetworkPolicy
---
kind: ConfigMap
data:
  image: nothing
"""


def test_manifest_facts():
    assert P.manifest_facts(MANIFEST) == [("iac", "kubernetes"), ("iac", "k8s_rbac"), ("iac", "k8s_networkpolicy"), ("k8s-annotation", "aws_eks"), ("aws", "iam"), ("docker", "app"), ("docker", "redis")]
    assert P.manifest_facts("") == [] and P.manifest_facts("pipeline { agent any }") == [] and P.manifest_facts("a: b\n") == []


def test_yaml_documents():
    said = P.yaml_documents("a:\n  - x\n  - k: v # c\n    z: |\n      one: 1\n      # two\n    y: w\n  -\n    - deep\n'q r': \"s: t\"\nn:\ne: [1, two]\n")
    assert said == [{"a": ["x", {"k": "v", "z": "one: 1\n# two", "y": "w"}, ["deep"]], "q r": "s: t", "n": None, "e": ["1", "two"]}]


def test_workflow_concepts():
    ci = "on: push\njobs:\n  build:\n    steps:\n      - uses: actions/checkout@v4\n      - run: |\n          # kubectl apply\n          make\n"
    path = ".github/workflows/ci.yml"
    assert [d for _, d, _ in P.workflow_concepts(path, ci)] == ["pipeline"]
    assert [d for _, d, _ in P.workflow_concepts(path, ci + "          helm  upgrade x\n")] == ["pipeline", "deployment"]
    assert P.workflow_concepts("src/ci.yml", ci) == P.workflow_concepts("fixtures/" + path, ci) == P.workflow_concepts(path, "name: x\n") == P.workflow_concepts("Jenkinsfile", "pipeline { }") == []


def test_normal_prose(spark):
    said = {"≥42% → 0.5": "at least 42% to 0.5", "265+ users, C++ and 3++": "more than 265 users, C++ and 3++", "a — b—c ,, d , .": "a, b, c, d.", "x  \t y 2021–2024": "x y 2021–2024", "1+2+3": "1+2+3", "over (3.5+), 9+.\nnext": "over (more than 3.5), more than 9.\nnext"}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", X.normal_prose(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == said


def test_readability_of_edge_words(spark):
    texts = ["the " * 30, "hmm shh. " * 20, "queue e ee rhythm naïve Eye! " * 8, "one two", "", None]

    def ease(text):
        words = re.findall("[a-z]+", (text or "").lower())
        if text is None or len(words) < 25:
            return None
        syllables = sum(max(1, len(re.findall("[aeiouy]+", w)) - w.endswith("e")) for w in words)
        return round(206.835 - 1.015 * (len(words) / max(1, len(re.findall("[.!?]+", text)))) - 84.6 * (syllables / len(words)), 4)

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.reading_ease(F.col("t")).alias("e")).collect()
    for r in got:
        want = ease(texts[r.i])
        assert (r.e is None) == (want is None) and (want is None or math.isclose(r.e, want, abs_tol=1e-4))


def test_ngrams_need_distinctive_words(spark):
    rows = [(1, "of the and to in is alpha"), (2, "of the and to in is alpha"), (3, "alpha beta of gamma the delta alpha beta of gamma the delta"), (4, "x alpha beta of gamma the delta"), (5, "short"), (6, None)]
    got = {(r.section, r.gram, r.first_section) for r in D.repeated_ngrams(spark.createDataFrame(rows, "section int, text string")).collect()}
    assert got == {(4, "alpha beta of gamma the delta", 3)}


def test_cooldown_of_late_rows(spark, tmp_path):
    at = lambda *minutes: spark.createDataFrame([("a", datetime(2024, 1, 1, 0, m)) for m in minutes], "k string, ts timestamp").coalesce(1)
    for i, minutes in enumerate(((0, 10), (7,), (14,), (16,), (40,))):
        at(*minutes).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
    for i, p in enumerate(files):  # the order in which a file source takes them
        import os

        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(r.ts.minute for r in S.drained(S.stream_cooldown(stream, "k", "ts", 5), "late").collect())
    # 7 comes late and neither fires nor moves the mark from 10
    assert got == [0, 10, 16, 40]  # 14 comes within five minutes of 10, the row that fired last, and 16 does not


def test_code_contradictions(spark):
    rows = lambda x, names: spark.createDataFrame(x, ", ".join(f"{n} string" for n in names))
    edges = rows([("helm2", "helm3"), ("tiller", "helm3")], ["old", "new"])
    claims = rows([("r1", "helm2"), ("r2", "helm2"), ("r3", "helm2"), ("r4", "helm2"), ("r5", "go")], ["repo", "tech"])
    code = rows([("r1", "helm3"), ("r2", "helm3"), ("r2", "helm2"), ("r3", "helm3"), ("r3", "tiller"), ("r5", "helm3")], ["repo", "tech"])
    assert [tuple(r) for r in C.code_contradictions(claims, code, edges).collect()] == [("r1", "helm2")]


def test_skill_ledger(spark):
    tools = spark.createDataFrame([(1, "OpenAI API"), (2, "openai api"), (3, "OpenAI"), (4, "Go"), (5, "Rust"), (6, "")], "position int, tool string")
    verdicts = spark.createDataFrame([("OpenAI API", "partial", "OpenAI"), ("openai", "verified", "openai"), ("Go", "partial", "Go"), ("go", "gap", "Go lang")], "tool string, status string, skill string")
    assert {tuple(r) for r in C.skill_ledger(tools, verdicts).collect()} == {("OpenAI API", "partial", "OpenAI"), ("Go", "gap", "Go lang")}


def test_queries_over_the_bound_stop(spark):
    rows = spark.range(5)
    assert V.few(rows, 5).count() == 5
    with pytest.raises(ValueError):
        V.few(rows, 4)


def test_flows(spark):
    vectors = spark.createDataFrame([(i, [float(i == j) + 0.01 * i for j in range(4)]) for i in range(4)], "id long, embedding array<float>")
    texts = spark.createDataFrame([(0, "alpha beta"), (1, "gamma delta alpha"), (2, "delta"), (3, "epsilon alpha beta gamma")], "id long, text string")
    asked = spark.createDataFrame([(7, [0.0, 1.0, 0.0, 0.0], "what is gamma delta?")], "qid long, q_embedding array<float>, q_text string")
    found = flows.retrieve(vectors, texts, asked, 2).orderBy("rank").collect()
    assert [(r.qid, r.id, r.rank) for r in found] == [(7, 1, 1)] or found[0].id == 1
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 4)], "qid int, id int, rank int")
    golden = spark.createDataFrame([(1, 11), (2, 20), (3, 30)], "qid int, id int")
    score = flows.evaluate(results, golden).first()
    assert (score.recall, score.mrr, score.score) == (round(1 / 3, 6), 0.25, round(0.6 / 3 + 0.4 * 0.25, 2))
    files = spark.createDataFrame([("src/a.md", "one\ntwo"), ("README.md", "x")], "path string, text string")
    first = flows.ingest(files, spark.createDataFrame([], "chunk_key string, digest string"))
    assert {r.status for r in first.collect()} == {"missing"}
    store = first.select("chunk_key", F.when(F.col("path") == "README.md", "other").otherwise(F.col("digest")).alias("digest"))
    assert {(r.path, r.status, r.doc_type) for r in flows.ingest(files, store).collect()} == {("src/a.md", "unchanged", "general"), ("README.md", "stale", "readme")}


def test_cited_paths_and_spans(spark):
    from cairnflow.operators import grounding as G

    said = "See infra/lib/a.ts, infra/**/*.ts; and queue.py. Not 1.5 or e.g. but (docs/x.md), docs/x.md: and Makefile"
    row = spark.createDataFrame([(said,), (None,), ("",)], "t string").select(G.cited_paths(F.col("t")).alias("c")).collect()
    assert row[0].c == ["infra/lib/a.ts", "infra/**/*.ts", "queue.py", "docs/x.md"] and row[1].c == row[2].c == []
    text = "Name: Ada Lovelace, ada@x.org, 10.0.0.1 and 078-05-1120; name Max"
    spans = G.pii_spans(text)
    assert [(k, v) for _, _, k, v in spans] == [("NAME", "Ada Lovelace"), ("EMAIL", "ada@x.org"), ("IP", "10.0.0.1"), ("SSN", "078-05-1120")] and all(text[a:b] == v for a, b, _, v in spans)
    assert G.scrubbed(text) == "Name: [NAME], [EMAIL], [IP] and [SSN]; name Max" and G.scrubbed("") == ""


def test_alias_mentions_and_undeveloped_terms(spark):
    from cairnflow.operators import grounding as G

    files = spark.createDataFrame([("f", "Uses AWS Bedrock, redis. And redis/\nwe are not  using redis\naws_bedrock Redis grafana go\n"), ("g", None)], "k string, t string")
    aliases = spark.createDataFrame([("redis",), ("aws_bedrock",), ("go",), ("grafana",)], "alias string")
    mentions = lambda **more: [tuple(r) for r in G.alias_mentions(files, "k", "t", aliases, **more).orderBy("line", "alias").collect()]
    assert mentions() == [("f", 1, "aws_bedrock"), ("f", 1, "redis"), ("f", 3, "aws_bedrock"), ("f", 3, "grafana"), ("f", 3, "redis")]
    assert mentions(most=3) == [("f", 1, "aws_bedrock"), ("f", 1, "redis"), ("f", 3, "aws_bedrock")]
    texts = ["`a.b=c1` once", "`a.b=c1` `a.b=c1`", "`a.b=c1`\n```\na.b=c1\n```", "```x\n```\n`a.b=c1`\n```y\n```", "`http://x.y` `no dots` `a.b`", "", None]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", G.undeveloped(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in found} == {0: ["a.b=c1"], 1: [], 2: [], 3: [], 4: [], 5: [], 6: None}


def test_experience_coverage(spark):
    from cairnflow.operators import grounding as G

    assert [G.light_stem(w) for w in ("Rapidly", "fly", "learning", "ring", "coding")] == ["rapid", "fly", "learn", "ring", "coding"]
    said = [("kafka streaming", "Built a stream on Kafka"), ("rapid incident response", "responding to an incident"), ("mission critical", "mission critical work"), ("scripting (Python, Go, etc.)", "wrote python tools"), ("scripting (Python)", "scripts daily"), ("scripting (R)", "r tools"), ("graph (", "graph theory")]
    assert [G.shows_skill(a, b) for a, b in said] == [True, False, True, True, False, False, True]
    bullets = spark.createDataFrame([("u", "Kafka stream jobs", ["repo/a"]), ("u", None, None), ("v", "nothing", ["repo/b"])], "k string, text string, sources array<string>")
    targets = spark.createDataFrame([("kafka streaming", None), ("held elsewhere", ["repo/b"]), ("absent", [])], "skill string, anchors array<string>")
    found = {(r.k, r.skill): r.covered for r in G.experience_coverage(bullets, targets, "k").collect()}
    assert found == {("u", "kafka streaming"): True, ("u", "held elsewhere"): False, ("u", "absent"): False, ("v", "kafka streaming"): False, ("v", "held elsewhere"): True, ("v", "absent"): False}
