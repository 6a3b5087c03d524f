"""Vector index, similarity joins and merges against all pairs; stems, postings and covers against direct forms."""

import random
import re

import numpy as np
import pytest

from cairnflow.operators import evidence as V, fulltext as T, retrieval as R, vector_index as VI


def some_vectors(n=600, width=12, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(15, width))
    x = centres[r.integers(0, 15, n)] + r.normal(size=(n, width)) * r.choice([0.1, 0.5, 2.0], (n, 1))
    x[50:70], x[100] = x[50], 0.0
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = some_vectors()
    bad = [(None, rows[0][1]), (7001, None), (7002, []), (7003, [None] * 12), (7004, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows + bad, "id long, embedding array<double>").repartition(3)


def cosines(rows):
    x = np.array([v for _, v in rows])
    n = np.linalg.norm(x, axis=1)
    x = x / np.where(n > 0, n, 1)[:, None]
    return np.round(x @ x.T, 6)


def test_index_recall_and_exact_path(spark, vectors, monkeypatch):
    monkeypatch.setattr(VI, "BLOCK", 50)
    monkeypatch.setattr(VI, "QUERY_BLOCK", 7)
    rows, frame = vectors
    index = VI.build(frame)
    asked = frame.where("id % 50 = 0").selectExpr("id qid", "embedding q_embedding")
    lists = len(index.centroids.value)
    assert sum(len(np.frombuffer(b.ids, "<i8")) for b in index.blocks.collect()) == len(rows) and lists > 10
    near = cosines(rows)
    true = {i: {(j, near[i, j]) for j in np.lexsort((np.arange(len(rows)), -near[i]))[:10]} for i in range(0, len(rows), 50)}
    exact = VI.search(index, asked, 10, lists).collect()
    for i in true:
        assert {(r.id, r.cosine) for r in exact if r.qid == i} == true[i]
    probes = VI.probes_for(index, 10, 0.95)
    found = VI.search(index, asked, 10, probes).collect()
    recall = np.mean([len({r.cosine for r in found if r.qid == i} & {c for _, c in true[i]}) / len({c for _, c in true[i]}) for i in true])
    assert probes < lists and recall >= 0.9


@pytest.mark.parametrize("least", [0.5, 0.9, 0.99])
def test_join_finds_all_pairs(vectors, monkeypatch, least):
    monkeypatch.setattr(VI, "BLOCK", 60)
    rows, frame = vectors
    pairs, member = VI.similarity_join(frame, least)
    first = {r.id: r["first"] for r in member.collect()}
    assert {i for i in first if first[i] != i} == set(range(51, 70)) and first[55] == 50
    near = cosines(rows)
    firsts = [i for i, _ in rows if first.get(i) == i]
    want = {(i, j) for a, i in enumerate(firsts) for j in firsts[a + 1 :] if near[i, j] >= least}
    assert {(r.i, r.j) for r in pairs.collect()} == want
    known = VI.usable(frame).where("size(embedding) = 12 and id <> 100").join(member.where("id = first").select("id"), "id", "left_semi")
    held = VI.candidates(known, least)
    if least >= 0.9:
        assert held.compared < 0.5 * held.all_pairs


@pytest.mark.parametrize("most", [5, 32, 300])
def test_most_similar_pairs(vectors, most):
    rows, frame = vectors
    near = cosines(rows)
    want = sorted((-near[i, j], i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if near[i, j] >= 0.2)[:most]
    assert [(r.i, r.j) for r in VI.most_similar(frame, 0.2, most).collect()] == [(i, j) for _, i, j in want]


def in_turn(n, near, curated, auto, floor):
    """The rule one pair after the other."""
    gone, out = set(), []
    for i in range(n):
        if i in gone:
            continue
        for j in range(i + 1, n):
            s = near.get((i, j), 0)
            if j in gone or s < floor:
                continue
            keep, drop = (j, i) if j in curated and i not in curated else (i, j)
            if s >= auto:
                gone.add(drop)
            out.append((i, j, keep, drop, "merge" if s >= auto else "review"))
    return out


def test_merges_equal_the_rule_in_turn(spark):
    r = random.Random(9)
    pairs, curated, want = [], [], []
    for g in range(1000):
        n, base = r.randint(2, 9), g * 20
        own = {(i, j): r.choice([0.5, 0.8, 0.95, 0.99]) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        kept = {i for i in range(n) if r.random() < 0.25}
        pairs += [(base + i, base + j, s) for (i, j), s in own.items()]
        curated += [(base + i,) for i in kept]
        want += [(base + i, base + j, base + k, base + d, v) for i, j, k, d, v in in_turn(n, own, kept, 0.9, 0.7)]
    found = V.merged_pairs(spark.createDataFrame(pairs, "i long, j long, similarity double"), spark.createDataFrame(curated, "id long"), 0.9, 0.7)
    assert sorted(tuple(x) for x in found.select("i", "j", "kept", "other", "verdict").collect()) == sorted(want)
    assert len({v for *_, v in want}) == 2


def test_merge_query_equals_the_rule(spark, data):
    from cairnflow.catalog import QUERIES
    from cairnflow.registry import Tables

    rows = sorted((r.id, r.embedding) for r in V.families(Tables(spark, data)).collect())
    names = {}
    for i, v in rows:
        names.setdefault(tuple(v), []).append(i)
    entry = {i: min([x for x in same if x % 7 == 0] or same) for same in names.values() for i in same}
    ids = sorted(set(entry.values()))
    near = cosines([(i, v) for i, v in rows if i in set(ids)])
    own = {(a, b): near[a, b] for a in range(len(ids)) for b in range(a + 1, len(ids))}
    want = [(ids[k], ids[d], v) for _, _, k, d, v in in_turn(len(ids), own, {a for a, i in enumerate(ids) if i % 7 == 0}, 0.95, 0.88)]
    want += [(entry[i], i, "copy") for i in entry if entry[i] != i]
    found = [tuple(r) for r in QUERIES["V19_greedy_merge"](spark, data).collect()]
    assert sorted(found) == sorted(want) and {v for *_, v in found} == {"merge", "review", "copy"}


# -- words ------------------------------------------------------------------------

STEMS = """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consistency consist|consistently consist|consisting consist|consolation consol
consolations consol|consolatory consolatori|console consol|consolidate consolid|consolidated consolid|consolingly consol|consols consol|consonant conson|consorted consort
conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir|conspire conspir|constable constabl|constance constanc|constancy constanc|knack knack
knackeries knackeri|knavish knavish|kneaded knead|kneel kneel|knees knee|knelt knelt|knif knif|knife knife|knightly knight|knit knit|knitted knit|knitting knit|knives knive
knocker knocker|knockers knocker|knopp knopp|knots knot|skies sky|dying die|hoping hope|hopping hop|falling fall|happy happi|by by|say say|ties tie|cries cri|gas gas|this this
kiwis kiwi|agreed agre|luxuriating luxuri|proceed proceed|exceeding exceed|inning inning|sensational sensat|rationally ration|generate generat|generic generic|communism communism
communication communic|youth youth|yellow yellow|employment employ|relational relat|conditional condit|valency valenc|digitizer digit|operator oper|feudalism feudal|hopefulness hope
callousness callous|sensitivity sensit|triplicate triplic|electrical electr|goodness good|revival reviv|allowance allow|adjustable adjust|replacement replac|adoption adopt
rate rate|cease ceas|controlling control|roll roll|news news|indexes index|queries queri|databases databas|running run|partitioned partit"""


def direct_stem(word):
    """The published steps, one after the other on plain strings."""
    whole = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    if len(word) < 3 or word in {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}:
        return word
    if word in whole:
        return whole[word]
    w = ["Y" if c == "y" and (i == 0 or word[i - 1] in "aeiou" or word[i - 1] == "y" and False) else c for i, c in enumerate(word)]
    for i in range(1, len(w)):  # from the left, so that a Y counts as a consonant for the next one
        w[i] = "Y" if word[i] == "y" and w[i - 1] in "aeiouy" else w[i] if word[i] != "y" else "y"
    w = "".join(w)
    vowel = lambda c: c in "aeiouy"

    def after(start):
        for i in range(start + 1, len(w)):
            if not vowel(w[i]) and vowel(w[i - 1]):
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    r2 = after(r1) if r1 < len(w) else len(w)

    def short(x):
        if len(x) == 2:
            return vowel(x[0]) and not vowel(x[1])
        return len(x) > 2 and not vowel(x[-1]) and x[-1] not in "wxY" and vowel(x[-2]) and not vowel(x[-3])

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(map(vowel, w[:-2])):
        w = w[:-1]
    if w in {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}:
        return w.replace("Y", "y")
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if end in ("eed", "eedly"):
                w = stem + "ee" if len(stem) >= r1 else w
            elif any(map(vowel, stem)):
                if stem.endswith(("at", "bl", "iz")):
                    w = stem + "e"
                elif stem[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                    w = stem[:-1]
                else:
                    w = stem + "e" if short(stem) and r1 >= len(stem) else stem
            break
    if len(w) > 2 and w[-1] in "yY" and not vowel(w[-2]):
        w = w[:-1] + "i"

    def swap(rules):
        nonlocal w
        for end in sorted(rules, key=len, reverse=True):
            if w.endswith(end):
                by, region, ok = rules[end]
                if len(w) - len(end) >= region and ok(w[: -len(end)]):
                    w = w[: -len(end)] + by
                return

    yes = lambda s: True
    two = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", fulli="ful", lessli="less")
    swap({k: (v, r1, yes) for k, v in two.items()} | {"ogi": ("og", r1, lambda s: s.endswith("l")), "li": ("", r1, lambda s: s[-1:] in tuple("cdeghkmnrt"))})
    three = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="")
    swap({k: (v, r1, yes) for k, v in three.items()} | {"ative": ("", r2, yes)})
    swap({k: ("", r2, yes) for k in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()} | {"ion": ("", r2, lambda s: s.endswith(("s", "t")))})
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def test_stems(spark, data):
    table = dict(x.split() for line in STEMS.split("\n") for x in line.split("|"))
    assert {w: direct_stem(w) for w in table} == table
    r = random.Random(1)
    parts = ["y", "ay", "th", "io", "ent", "li", "ness", "ing", "ed", "at", "bl", "ational", "ee", "s", "ies", "ll", "e", "gener", "x", "ization", "o", "tt", "ous"]
    words = set(table) | {"".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(4000)} | {"b2b", "x86", "007", "yy", "syzygy", "ayyyed"}
    held = spark.read.parquet(f"{data}/documents.parquet").selectExpr("explode(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) w").distinct().limit(3000)
    words |= {x.w for x in held.collect()}
    found = {x.word: x.stem for x in T.stems(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()}
    assert {w: s for w, s in found.items() if s != direct_stem(w)} == {} and len(found) == len(words)


def covers(words, stems):
    """Shortest stretches that hold all stems, by trying all."""
    at = [i for i, w in enumerate(words) if w in stems]
    held = [(a, b) for a in at for b in at if a <= b and stems <= set(words[a : b + 1])]
    least = [(a, b) for a, b in held if not any((c, d) != (a, b) and a <= c and d <= b for c, d in held)]
    return sum(0.1 / (1 + sum(w not in stems for w in words[a : b + 1])) for a, b in least)


def test_full_text_rank(spark):
    r = random.Random(4)
    texts = {i: " ".join(r.choice(["indexes", "index", "query", "queries", "the", "fast", "fasting", "disk", "of"]) for _ in range(r.randint(0, 25))) for i in range(60)}
    asked = {1: "Index the queries", 2: "fast disk index", 3: "the of", 4: "disk disks", 5: "absent index"}
    corpus = spark.createDataFrame([*texts.items(), (900, None)], "id long, text string")
    queries = spark.createDataFrame(list(asked.items()), "qid long, q_text string")
    for any_ in (False, True):
        found = {(x.qid, x.id): x.lexical for x in R.lexical_rank(corpus, queries, 1000, any_).collect()}
        want = {}
        for q, text in asked.items():
            stems = {direct_stem(w) for w in re.findall("[a-z0-9]+", text.lower()) if w not in T.STOP_WORDS}
            for i, t in texts.items():
                words = [w if w in T.STOP_WORDS else direct_stem(w) for w in t.split()]
                rank = 0.1 * sum(w in stems for w in words) if any_ else covers(words, stems) if stems else 0
                if rank:
                    want[q, i] = round(rank, 6)
        assert found == pytest.approx(want) and want
    kept = T.index(corpus)
    terms = T.query_terms(queries, T.forms(queries.selectExpr("explode(split(lower(q_text), ' ')) word")))
    assert {(x.qid, x.id) for x in T.ranked(kept, terms).collect()} == {k for k in {(x.qid, x.id) for x in R.lexical_rank(corpus, queries, 1000).collect()}}
