"""Order-dependent text operators on hand-made texts."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cairnflow.operators import chains as C, procedural as P


def test_markdown_sections_and_limits():
    text = "---\ntitle: A\ntags: [x, \"y\"]\n# note\n---\nBefore any heading there is some text here.\n\n# One\n" + "word " * 20 + "\n##### not a boundary\n## Two\nshort\n### Three\n" + "\n\n".join("p%d " % i + "z" * 700 for i in range(6))
    meta, _ = P.front_matter(text)
    assert meta == {"title": "A", "tags": ["x", "y"]}
    chunks = P.markdown_chunks(text)
    assert [h for _, h, _ in chunks][:2] == [None, "One"] and all(h != "Two" for _, h, _ in chunks)
    three = [c for _, h, c in chunks if h == "Three"]
    assert len(three) > 1 and three[1].startswith("(continued from: ")
    assert [i for i, _, _ in chunks] == list(range(len(chunks)))


def test_wikilinks_and_fences():
    chunks = P.markdown_chunks("See [[a/b/Page]] and [[x|Alias]] in this sentence.\n```\n# no heading\n```\n")
    assert len(chunks) == 1 and "Page and Alias" in chunks[0][2] and "# no heading" in chunks[0][2]


def test_sections_start_with_the_preamble():
    assert P.sections("a\n## B\nc\n## D\n") == [(None, 1, "a"), ("B", 2, "c"), ("D", 4, "")]


def test_code_chunks_cover_every_line_once():
    text = "".join(f"function f{i}() {{\n  // }} not a brace\n  return '{{';\n}}\n" * 12 for i in range(10))
    chunks = P.code_chunks(text)
    assert len(chunks) > 1
    spans = [(a, b) for _, a, b, _, _ in chunks]
    assert spans[0][0] == 1 and all(b + 1 == c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert "f0" in chunks[0][3]


def test_python_code_chunks():
    text = "import os\n\n" + "".join(f"def g{i}():\n    x = '#{{'\n    return x\n\n" for i in range(200))
    assert all(len(c) <= P.CODE_HARD * P.CODE_CHARS for *_, c in P.code_chunks(text, python=True))
    assert sum(len(s) for _, _, _, s, _ in P.code_chunks(text, python=True)) == 200


def test_comments_imports_and_markers():
    assert P.comments("a // one\n// two\nb\n/* three\n * four */") == [(1, 2, "one two"), (4, 5, "three four")]
    assert P.imports("from a.b import c\nimport os\nimport x from '@scope/pkg/deep'\nrequire('./local')\nconst y = require('left')") == [(1, "python", "a"), (2, "python", "os"), (3, "javascript", "@scope/pkg"), (5, "javascript", "left")]
    assert P.infra_markers('FROM registry.io/team/node:20@sha256:1\n- uses: actions/checkout@v4\nresource "aws_s3_bucket" "b" {') == [("image", "node"), ("action", "checkout"), ("resource", "aws_s3_bucket"), ("marker", "image"), ("marker", "action"), ("marker", "resource")]
    assert P.arns("arn:aws:s3:::b arn:aws:sqs:eu-west-1:123456789012:q arn:aws:s3:::c") == [("s3", "arn:aws:s3:::b")]


def test_manifests():
    assert P.dependencies("a/package.json", '{"dependencies": {"x": "^1"}, "devDependencies": {"y": "2"}}') == [("npm", "x", "^1"), ("npm", "y", "2")]
    assert P.dependencies("go.mod", "require (\n  github.com/a/b v1.2.3\n)") == [("go", "github.com/a/b", "v1.2.3")]
    assert P.dependencies("requirements.txt", "Flask==2.0\n# no\nrich>=13") == [("pypi", "flask", "2.0"), ("pypi", "rich", "13")]
    assert P.dependencies("pyproject.toml", '[project]\ndependencies = ["httpx[http2]>=0.2"]') == [("pypi", "httpx", "0.2")]
    assert P.dependencies("Cargo.toml", '[dependencies]\nserde = {version = "1"}\nlog = "0.4"') == [("cargo", "serde", "1"), ("cargo", "log", "0.4")]
    assert P.dependencies("package.json", "{") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50)), st.integers(1, 5), st.integers(10, 60))
def test_packs_keep_order_and_budgets(sizes, items, chars):
    found = P.packs(sizes, items, chars)
    assert found == sorted(found)
    for p in set(found):
        mine = [n for n, q in zip(sizes, found) if q == p]
        assert len(mine) <= items and (sum(mine) <= chars or len(mine) == 1)


def test_numbers_phrases_and_merges():
    assert P.without_unknown_numbers("cut cost by 40% for 12 users", {"12"}) == "cut cost for 12 users"
    assert P.near_phrase("machine learning", "learning about a machine.") and not P.near_phrase("machine learning", "A machine. Learning.")


@pytest.mark.parametrize("block,items,chars", [(8, 3, 40), (8, 8, 1000), (16, 5, 10), (1 << 16, 4, 60)])
def test_packs_of_groups_of_any_size(spark, block, items, chars):
    r = random.Random(block + items)
    rows = [(g, i, r.choice([0, 1, 5, 9, 30, 100, None])) for g, n in (("a", 300), ("b", 1), ("c", 17), (None, 40), ("d", 16)) for i in range(n)]
    frame = spark.createDataFrame(r.sample(rows, len(rows)), "g string, i int, size int").repartition(7)
    found = {(x.g, x.i): x.pack for x in C.packed(frame, "g", ["i"], "size", items, chars, block=block).collect()}
    want = {}
    for g in ("a", "b", "c", None, "d"):
        mine = [x for x in rows if x[0] == g]
        want |= {(g, i): p for (_, i, _), p in zip(mine, P.packs([s or 0 for *_, s in mine], items, chars))}
    assert found == want


def test_packs_of_one_group_of_a_million_rows(spark):
    rows = spark.range(1_000_000).selectExpr("'x' g", "id", "pmod(xxhash64(id), 900) size")
    found = C.packed(rows, "g", ["id"], "size", 20, 6000).groupBy("pack").agg(F.min("id").alias("i")).orderBy("pack").toArrow()
    packs = P.packs(rows.orderBy("id").select("size").toArrow().column(0).to_pylist(), 20, 6000)
    starts = [i for i, p in enumerate(packs) if not i or packs[i - 1] != p]
    assert found.column("i").to_pylist() == starts and found.column("pack").to_pylist() == list(range(len(starts)))
