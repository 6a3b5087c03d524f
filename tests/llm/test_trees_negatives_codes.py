"""Word windows by suffix trees, hard negatives by pivots and vector codes by annuli, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.llm import negatives, prefixtrees, quantised

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(11)
    word = lambda: r.choice(["the", "The", "of", "naïve", " ", "x\x1cy", "end.", "\U0001f600", "q", str(r.randint(0, 400))])
    some = lambda n: " ".join(word() for _ in range(n))
    passage, frame = some(40), some(12)
    rows = [(i, some(r.randint(0, 60))) for i in range(0, 60, 2)]
    rows += [(i, f"{some(9)}\t{passage}\n\n{some(5)}") for i in (1, 3, 101, 5)]  # one passage, other space around it
    rows += [(200 + i, rows[4][1]) for i in range(3)] + [(300, f" {frame}  x"), (301, f"{frame} x "), (302, frame)]
    rows += [(400, "a " * 300), (401, "a " * 299 + "b"), (402, "\n".join(["a"] * 13)), (500, some(5000)), (501, None), (502, ""), (503, " \t\r\x0b\x0c\n")]
    rows += [(3, f"{passage} {passage}"), (None, passage), (None, some(20)), rows[20], rows[20], (-7, f"{some(3)} {passage}")]
    return rows


def expected(rows, window):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = WORD.findall(t or "")
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    out = []
    for i, t in rows:
        words, gone = WORD.findall(t or ""), set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,group", [(13, prefixtrees.GROUP), (13, 3), (3, 5), (2, 1)])
def test_windows_equal_brute_force(spark, monkeypatch, window, group):
    monkeypatch.setattr(prefixtrees, "GROUP", group)
    monkeypatch.setattr(prefixtrees, "HEAVY_A_UNIT", 0)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"unit": F.lit(1), "said": F.lit("x")}).repartition(5)
    found = prefixtrees.deduplicated(docs, window, keep_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in found), key=str) == expected(rows, window)
    for r in found:
        assert sum(int(b) - int(a) for a, b in (x.split(":") for x in r.spans.split(",") if x)) == r.n_removed


def test_prefixes_split_until_they_are_light():
    r = random.Random(3)
    data = [" ".join(r.choice("abc") for _ in range(400)).encode() for _ in range(3)]
    w = prefixtrees.Windows(data, np.ones(3, bool), 6)
    at, _ = w.each()
    prefix, many = w.reported(at, 20)
    heavy = np.sort(prefix[many > 30])
    groups = Counter(w.groups(at, heavy).tolist())
    by = defaultdict(set)
    for a, g in zip(at.tolist(), w.groups(at, heavy).tolist()):
        by[g].add(w.data[w.begin[a] : w.end[a + 5]])
    assert len(heavy) and max(groups.values()) <= 60
    # a group holds whole prefixes: no window lies in two of them
    assert sum(len(x) for x in by.values()) == len(set().union(*by.values()))


def vectors(r, n, width=16, kinds=4):
    rows = []
    for i in range(n):
        centre = np.random.default_rng(i % 7).normal(size=width)
        rows.append((i, [float(np.float32(x)) for x in (centre + r.normal(size=width) * (0.0 if i % 11 == 0 else 0.3))], i % kinds))
    bad = [(None, None, 1), (9001, None, 1), (9002, [1.0] * (width - 1) + [None], 2), (9003, [float("nan")] * width, 0), (9004, [float("inf")] + [0.0] * (width - 1), 0), (9005, [3e38] * width, 0)]
    return rows + bad + [(9100, [0.0] * width, 1), (9200, [0.5] * (width - 3), 2), (9300, [], 3), (9400, [0.25] * width, None), rows[3]]


VECTORS = "vec_id long, embedding array<float>, label int"


def scaled(rows, scale, most, width):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) and abs(x) < 2**31 for x in v):
            x = np.array([int(np.floor(scale * x)) for x in v] + [0] * (width - len(v)), np.int64)
            if (x.astype(float) ** 2).sum() < most:
                out.append((i, label, x))
    return out


def negatives_by_force(rows, width, low=80):
    kept = [r for r in scaled(rows, 256, 2.0**62, width) if r[0] is not None and r[1] is not None]
    out = []
    for i, label, q in kept:
        if i % 10:
            continue
        score = [(-int(q @ x), j, of) for j, of, x in kept]
        positive = sorted(s for s in score if s[2] == label and s[1] != i)[:5]
        for s, p, _ in positive:
            fit = sorted(n for n in score if n[2] != label and low * -s <= 100 * -n[0] <= 100 * -s)[:5]
            out += [(i, p, k + 1, n[1], -s, -n[0]) for k, n in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block,together,slice_bytes", [(negatives.BLOCK, negatives.TOGETHER, negatives.SLICE_BYTES), (7, 3, 2000)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, together, slice_bytes):
    for name, value in (("BLOCK", block), ("TOGETHER", together), ("SLICE_BYTES", slice_bytes), ("PARTITION_BYTES", 8000 if block == 7 else negatives.PARTITION_BYTES)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(np.random.default_rng(5), 240)
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"row": F.lit("a"), "score": F.lit(2.0)}).repartition(3)
    found = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0)
    want = negatives_by_force(rows, 16)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100


def test_brackets_hold_and_prune():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-300, 300, (1, 8)) * 3 + r.integers(-9, 9, (60, 8)), r.integers(-300, 300, (60, 8))])
    space = negatives.Space(x[::7], int((x * x).sum(1).max()))
    low, high = space.brackets((x * x).sum(1), space.distances(x, anchors=True), space.distances(x), space.distances(x))
    score = x @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high < np.sort(score, axis=1)[:, -20][:, None]).mean() > 0.2  # rows that cannot be among an anchor's first twenty


def test_products_are_exact():
    a = np.array([[2**30, 1], [3, -(2**29)]])
    assert (negatives.products(a, a) == np.array([[2**60 + 1, 3 * 2**30 - 2**29], [3 * 2**30 - 2**29, 9 + 2**58]])).all()


def test_nearest_entry_by_annuli():
    r = np.random.default_rng(4)
    done = []
    for n in (1, 2, 16):
        for spread in (3, 50, 2000):
            entries = r.integers(-spread, spread, (n, 4)) * r.integers(0, 9, (n, 1))
            x = np.concatenate([r.integers(-spread, spread, (200, 4)) * r.integers(0, 9, (200, 1)), entries, np.zeros((1, 4), np.int64)])
            d = ((x[:, None] - entries[None]) ** 2).sum(2)
            code, best, many = quantised.nearest(x, entries)
            assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
            done.append(many / d.size)
    assert min(done[-3:]) < 0.7  # of 16 entries some are never evaluated


def codes_by_force(rows, width):
    kept = sorted(scaled(rows, 4096, 2.0**60, width), key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    x = np.stack([r[2] for r in kept]).reshape(len(kept), 8, -1)
    books = [x[:16, p].copy() for p in range(8)]
    assign = lambda p: ((x[:, p][:, None] - books[p][None]) ** 2).sum(2)
    for _ in range(6):
        for p in range(8):
            code = assign(p).argmin(1)
            for e in set(code.tolist()):
                books[p][e] = [sum(c) // len(c) for c in x[code == e, p].T.tolist()]
    d = np.stack([assign(p) for p in range(8)])
    code, error = d.argmin(2).T, d.min(2).sum(0)
    by = Counter()
    for (_, label, _), e in zip(kept, error.tolist()):
        by[label] += e
    name = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in k), e, by[label], name) for (i, label, _), k, e in zip(kept, code, error.tolist())]


@pytest.mark.parametrize("n", [300, 5])
def test_codes_equal_brute_force(spark, n):
    rows = vectors(np.random.default_rng(6), n)
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"code": F.lit("a"), "of": F.lit(2.0)}).repartition(3)
    found = sorted((tuple(r) for r in quantised.coded(frame).collect()), key=str)
    assert found == sorted(codes_by_force(rows, 16), key=str)


def test_empty_tables_of_words_and_vectors(spark):
    assert prefixtrees.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == [] and quantised.coded(none).collect() == []
    alone = spark.createDataFrame([(100, [1.0, 2.0], 1), (101, None, 1)], VECTORS)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).collect() == []
    assert [r.vec_id for r in quantised.coded(alone).collect()] == [100]
