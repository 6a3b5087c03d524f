"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from cairnflow.llm import bpe, fingerprints, licenses, lm, media, mixing, neardup, pii, quality, queries, suffixes
from cairnflow.llm.eliasfano import EliasFano, Trie
from cairnflow.operators.graphs import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sentence(r, n):
    return " ".join(r.choice(["the", "An", "über", "token", "of", "x", "naïve", "42", "end.", "\U0001f600"]) + r.choice(["", "s", "ing", str(r.randint(0, 9))]) for _ in range(n))


def corpus():
    r = random.Random(7)
    base = [sentence(r, r.randint(1, 120)) for _ in range(40)]
    near = [" ".join(w if i != 50 else "edited" for i, w in enumerate(b.split())) for b in base if len(b.split()) > 90]
    shared = sentence(r, 40)
    texts = [*base, *near, base[3], base[3], *(f"{sentence(r, 20)} {shared} {sentence(r, 10)}" for _ in range(8))]
    texts += [None, "", "   ", "\n\t", "one", "One two three", sentence(r, 6000), "a" * 3000, "ab" * 700]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id", "en", "s0", 5)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(empty):
    plain = empty.select("doc_id", "text")
    for made in (fingerprints.fingerprints(plain), media.stored_and_read(plain), neardup.near_duplicates(plain), pii.scan(plain), suffixes.deduplicated(plain), lm.scored(plain), bpe.digests(plain), mixing.mix(empty), licenses.scan_documents(empty.sparkSession, empty)):
        assert made.collect() == []


def test_pii_finds_and_checks():
    text = "mail a.b+c@x.example.org, ip 10.0.0.256 or 10.0.0.255, card 4111 1111 1111 1111 not 4111111111111112, call +1 (706) 555-3138, IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789"
    kinds = Counter(s.kind for s in pii.find(text))
    assert kinds == {"email": 1, "ip": 1, "card": 1, "phone": 1, "iban": 1, "ssn": 1}
    for s in pii.find(text):
        assert "".join(re.findall(r"\w", text[s.start : s.end]))
    assert pii.mask("x a@b.co y") == "x [EMAIL] y" and pii.mask(None) is None
    assert not [s for s in pii.find("123-45-6789") if s.kind == "ssn"]  # without context


def reference_pii(text):
    def spans(rule, ok=lambda m: True):
        return [(m.start(), m.end()) for m in re.finditer(rule, text) if ok(m[0])]

    digits = lambda x: re.sub("[^0-9]", "", x)
    small = lambda p: len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255
    return {
        "email": spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(small(p) for p in x.split("."))),
        "card": spans(r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and pii.luhn(digits(x))),
        "phone": spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    }


def test_pii_base_spans_equal_the_patterns(spark, data):
    r = random.Random(3)
    texts = ["".join(r.choice("a@.1 -+()9 0b%") for _ in range(200)) for _ in range(300)] + [x.text for x in queries.documents(spark, data).collect()]
    for text in texts:
        mine = {k: [(s.start, s.end) for s in pii.find(text) if s.kind == k] for k in pii.BASE_KINDS}
        assert mine == reference_pii(text)


def test_pii_scan_equals_the_patterns(spark, rows):
    r = random.Random(5)
    said = ["a.b@c.example x 1.2.3.4", "1.2.3." + "0" * 5000 + "1", "0" * 4400 + "1.2.3.256", "4111 1111 1111 1111, +1 (706) 555-3138", "\U0001f600 x@y.org", None, "", "x@y.org", "x@y.org"]
    table = [*rows, *((10_000 + i, t, "en", "s", 0) for i, t in enumerate(said)), *((20_000 + i, "".join(r.choice("a@.1 -+()9 0b%é") for _ in range(300)), "en", "s", 0) for i in range(50))]
    want = Counter()
    for i, t, *_ in table:
        found = reference_pii(t or "")
        base = [f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in found[k]]
        want[(i, *(len(found[k]) for k in pii.BASE_KINDS), hashlib.sha256(",".join(base).encode()).hexdigest())] += 1
    # a clashing column beside them is not read
    got = pii.scan(spark.createDataFrame(table, SCHEMA).withColumnRenamed("lang", "spans").repartition(3)).collect()
    assert Counter((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got) == want
    for x in got:
        spans = x.spans.split(",") if x.spans else []
        assert len(spans) == x.n_spans == len(x.scores.split(",") if x.scores else [])
        base = [s for s in spans if s.split(":")[0] in pii.BASE_KINDS]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == x.base_sha256
        keys = [(pii.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert keys == sorted(keys)


def test_pii_is_linear_in_long_texts():
    for text in ("1" * 300_000, "1.2.3." + "0" * 300_000 + "1", "1." * 100_000, "a" * 300_000 + "@", "+1 " * 100_000, "a@" * 100_000):
        pii.find(text)


def reference_fingerprint(data):
    """By loops over bytes: a chunk ends where the hash of the last seven bytes is a multiple of the block size."""
    m, low = 0x9E3779B1, (1 << 32) - 1
    value = [(c * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64 >> 24 & low for c in range(256)]

    def ends(i):
        h = sum(value[c] * pow(m, k, 1 << 32) for k, c in enumerate(reversed(data[max(0, i - 6) : i + 1]))) & low
        h ^= h >> 15
        h = h * 0x2C1B3C6D & low
        return h ^ h >> 13

    hashes = [ends(i) for i in range(len(data))]

    def signature(block):
        cuts = [i + 1 for i, h in enumerate(hashes) if h % block == 0]
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)]) if a < b]
        codes = [zlib.crc32(x) for x in parts]
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return "".join(alphabet[(c ^ c >> 13 ^ c >> 23) & 63] for c in codes), len(cuts)

    if not data:
        return "4::"
    block = 4
    while signature(block)[1] >= 64:
        block *= 2
    return f"{block}:{signature(block)[0]}:{signature(2 * block)[0]}"


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        new = [i]
        for j, q in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
        row = new
    return row[-1]


def reference_likeness(a, b):
    if a == b:
        return 1.0
    (ka, *sa), (kb, *sb) = a.split(":"), b.split(":")
    held, other = {int(ka): sa[0], 2 * int(ka): sa[1]}, {int(kb): sb[0], 2 * int(kb): sb[1]}
    return max([1 - levenshtein(held[k], other[k]) / max(len(held[k]), len(other[k])) for k in held if k in other and held[k] and other[k]], default=0.0)


@pytest.mark.parametrize("block, most, apart", [(fingerprints.BLOCK, fingerprints.MOST_BLOCKS, 1), (4, 5, 1), (4, 1000, 10_000_000)])
def test_fingerprints(docs, rows, monkeypatch, block, most, apart):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    monkeypatch.setattr(fingerprints, "MOST_BLOCKS", most)
    more = [(5000, "far away " * 30, "en", "s", 0), (-7, "before all", "en", "s", 0)] + [(10**15 + i * apart, f"sparse {i} " * i, "en", "s", 0) for i in range(30)]
    table = docs.unionByName(docs.sparkSession.createDataFrame(more, SCHEMA)).withColumnRenamed("lang", "block")
    order = sorted(((i, t or "") for i, t, *_ in rows + more), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    want = Counter()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        n = len(t) // 2
        new = (t[: len(t) - n] + nxt[:n]).encode()
        f, e, g = (reference_fingerprint(x) for x in (t.encode(), new, nxt.encode()))
        want[(i, len(t), hashlib.sha256(new).hexdigest(), f, e, round(reference_likeness(f, e), 9), round(reference_likeness(f, g), 9))] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.fingerprints(table).collect())
    assert got == want
    assert fingerprints.likeness(["8:AB:C", "8:AB:C"], ["8:AB:C", "64:AB:C"]).tolist() == [1.0, 0.0]


def test_fingerprints_of_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 4)
    texts = [f"text {i} " * (i + 1) for i in range(20)] + [None] * 9
    found = fingerprints.fingerprints(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")).collect()
    assert Counter(r.edited_sha256 for r in found if not r.n_chars) == {hashlib.sha256(b"").hexdigest(): 9}  # half of no code points is none
    assert Counter(r.fingerprint for r in found) == Counter(reference_fingerprint((t or "").encode()) for t in texts)
    assert all(r.doc_id is None for r in found)


def test_edit_distance():
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 64))) for _ in range(60)]
    (a, la), (b, lb) = fingerprints._codes(words[::2]), fingerprints._codes(words[1::2])

    assert fingerprints._myers(a, la, b, lb).tolist() == [levenshtein(x, y) for x, y in zip(words[::2], words[1::2])]


def reference_medium(payload, dictionary):
    """A payload's medium by a loop over its bytes."""
    import struct

    import zstandard

    gear = np.random.Generator(np.random.PCG64(20260101)).integers(0, 2**32, 256, dtype=np.uint32).tolist()
    h, ends, at = 0, [], 0
    for i, c in enumerate(payload, 1):
        h = (2 * h + gear[c]) % 2**32
        if i - at >= 1024 and h < 2**20 or i - at == 16384:
            ends.append(i)
            at = i
    ends += [len(payload)] if not ends or ends[-1] < len(payload) else []
    pack = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(dictionary))
    parts = [payload[a:b] for a, b in zip([0, *ends], ends)]
    frames = [pack.compress(p) for p in parts]
    head = b"CDC2" + struct.pack("<QI", len(payload), len(parts)) + hashlib.sha256(dictionary).digest()[:16]
    return head + b"".join(hashlib.sha256(p).digest()[:16] + struct.pack("<II", len(p), len(f)) for p, f in zip(parts, frames)) + b"".join(frames), len(parts)


def reference_feature(payload):
    x = list(payload)
    mean = sum(x) / len(x)
    spread = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
    turns = sum((a < 128) != (b < 128) for a, b in zip(x, x[1:]))
    return f"mean={mean:.4f};std={spread:.4f};zcr={turns};bands=" + "/".join(str(sum(v >> 5 == k for v in x) * 1000 // len(x)) for k in range(8))


@pytest.mark.parametrize("references", [media.REFERENCES, 2])
def test_media_round_trip(docs, rows, monkeypatch, references):
    monkeypatch.setattr(media, "REFERENCES", references)
    more = [(10_000 + i, t, "en", "s", 0) for i, t in enumerate([None] * 20 + [""] * 20 + ["copy " * 900] * 20)]
    table = docs.unionByName(docs.sparkSession.createDataFrame(more, SCHEMA)).withColumnRenamed("lang", "key")
    found = media.stored_and_read(table).collect()
    texts = {r[0]: r[1] for r in rows + more}
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows + more)
    _, store, named = media.stored(table)
    held = {bytes(r.chunk): bytes(r.frame) for r in store.collect()}
    assert store.count() == len(held)  # one copy of each chunk
    dictionary = held[named]
    want = {}
    for r in found:
        t = texts[r.doc_id]
        payload = media.payload_of(t)
        if payload not in want:
            stored, chunks = reference_medium(payload, dictionary)
            assert media.decoded(stored, dictionary) == payload
            want[payload] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), reference_feature(payload), chunks)
        assert r.n_bytes == len((t or "").encode()) and len(payload) % 192 == 0 and payload[: r.n_bytes] == (t or "").encode()
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.n_chunks) == want[payload]


def near_brute(rows, width):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = [x.translate(LOWER) for x in WORD.findall(t or "")]
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared) and root(a) != root(b):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i) if i is not None else None) for i in sets}


@pytest.mark.parametrize("short, turns", [(64, 3), (2, 0), (2, 3)])
def test_near_duplicates(docs, rows, monkeypatch, short, turns):
    monkeypatch.setattr(neardup, "SHORT", short)
    monkeypatch.setattr(neardup, "TURNS", turns)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    want = near_brute(rows, 4)
    found = neardup.near_duplicates(docs.withColumnRenamed("lang", "component"), width=4).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_a_group_of_near_copies_is_dealt_to_few_blocks(spark, monkeypatch):
    """Copies that differ by more than the limit share lists but no links: those with many shingles of their own are in no block, and lists of the same copies are one."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        text = list(base)
        for at in r.sample(range(200), (1, 6, 20)[i % 3]):
            text[at] = f"own{i}x{at}"
        rows.append((i, " ".join(text), "en", "s", 0))
    for name, size in (("SHORT", 4), ("BLOCK", 8), ("TURNS", 0)):
        monkeypatch.setattr(neardup, name, size)
    dealt = []
    monkeypatch.setattr(neardup, "_blocked", lambda rows, percent, was=neardup._blocked: dealt.append(rows.count()) or was(rows, percent))
    want = near_brute(rows, 4)
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: want[i] for i in range(90)}
    assert dealt and dealt[0] < 10 * len(rows)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_near_duplicates_refuse_similarities_they_are_not_sized_for(docs):
    for percent in (30, 79, 101):
        with pytest.raises(ValueError):
            neardup.near_duplicates(docs, percent=percent)


def test_structured_words_do_not_meet(spark):
    rows = [(2 * k + j, w, "en", "s", 0) for k, n in enumerate((512, 1024, 2048, 4096)) for j, w in enumerate(thue_morse(n))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in found)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(40)}
    train, other = (i for i in held if not held[i]), (i for i in held if held[i])
    a, b = thue_morse(1024)
    said = [(next(train), a), (next(train), a), (next(train), a), (next(train), b), (next(other), b), (next(other), a)]
    for r in lm.scored(spark.createDataFrame(said, "doc_id long, text string")).collect():
        count = {a: 3, b: 1}[dict(said)[r.doc_id]]
        assert abs(r.base_score - math.log10((count + 0.5) / (8 + 0.5 * 4)) - math.log10(4.5 / 10)) < 1e-9 and r.n_known == 2


def test_star_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(3, 3), (5, 4), (4, 5)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found[3] == 3 and found[5] == 4 and {found[i] for i in range(10, 41)} == {10}


def test_suffix_ranks_sort():
    r = np.random.default_rng(2)
    for _ in range(100):
        text, span = r.integers(1, 4, r.integers(1, 150)), int(r.choice([1, 3, 9, 50]))
        by = [tuple(text[i : i + span]) for i in np.argsort(suffixes.suffix_ranks(text, span))]
        assert by == sorted(by)


@pytest.mark.parametrize("size", [suffixes.SORTED_BYTES, 512])
def test_suffix_dedup(docs, rows, monkeypatch, size):
    monkeypatch.setattr(suffixes, "SORTED_BYTES", size)
    first, want = {}, {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (t or "").encode()
        hit = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], i) < i:
                hit[p : p + 50] = True
        spans = int((hit & ~np.r_[False, hit[:-1]]).sum()) if len(data) else 0
        want[i] = (len(data), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~hit].tobytes()).hexdigest())
    for r in suffixes.deduplicated(docs).collect():
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        else:
            assert r.n_removed == 0


def test_elias_fano_and_trie():
    r = np.random.default_rng(4)
    for n, u in ((1, 1), (7, 100), (2000, 10**9)):
        v = np.sort(r.integers(0, u, n).astype(np.uint64))
        e, q = EliasFano.of(v, u), r.integers(0, u, 300).astype(np.uint64)
        assert (e.access(np.arange(n)) == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()
    c, w = np.array([1, 1, 5], np.uint64), np.array([2, 9, 2], np.uint64)
    trie = Trie.mapped(c, w, np.array([1, 3, 2]), discount=0.5)
    codes, weights = trie.query(np.array([1, 1, 1, 5, 7], np.uint64), np.array([2, 3, 9, 9, 2], np.uint64))
    assert (codes > 0).tolist() == [True, False, True, False, False] and (weights > 0).tolist() == [True, True, True, True, False]


def test_elias_fano_tells_whether_a_value_is_there():
    """The search itself says so, without reading the value it found; runs of equal high parts, full and empty words included."""
    r = np.random.default_rng(9)
    for n, u in ((1, 1), (1, 10**6), (300, 40), (3000, 10**4), (500, 10**15)):
        v = np.sort(r.integers(0, u, n).astype(np.uint64))
        e, q = EliasFano.of(v, u), np.r_[r.integers(0, u, 400).astype(np.uint64), v[:200]]
        at, there = e.sought(q)
        assert (at == np.searchsorted(v, q)).all() and (there == np.isin(q, v)).all() and (e.access(np.arange(n)) == v).all()


@pytest.mark.parametrize("hot", [lm.HOT, 1.0, 0.01])
def test_language_model(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "LEAST_BUCKETS", 64)
    monkeypatch.setattr(lm, "UNIT_BYTES", 3000)
    tokens = [(i, [x.translate(LOWER) for x in WORD.findall(t or "")] + ["\n"]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    uni, pairs, after, kinds = Counter(), Counter(), Counter(), Counter()
    for i, ts in tokens:
        if not held(i):
            uni.update(ts)
            pairs.update(zip([""] + ts, ts))
    for (a, _), n in pairs.items():
        after[a] += n
        kinds[a] += 1
    n, v = sum(uni.values()), len(uni)
    want = {}
    for i, ts in tokens:
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)
        score = 0.0
        for a, x in zip([""] + ts, ts):
            p1 = (uni[x] - lm.WORD_DISCOUNT) / n if uni[x] else lm.WORD_DISCOUNT * v / n
            p = (1 - lm.MU) * p1 + lm.MU * (max(pairs[a, x] - lm.DISCOUNT, 0) + lm.DISCOUNT * kinds[a] * p1) / after[a] if after[a] else p1
            score += math.log10(p)
        want[i] = (held(i), len(ts), sum(uni[x] > 0 for x in ts), n, base, score)
    for r in lm.scored(docs).collect():
        h, k, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, k, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - score) < 0.03 * k  # 8-bit steps


def test_bpe_equals_the_library(docs, rows):
    import tiktoken

    ranks = bpe.read_ranks(bpe.default_path())
    library = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] or "" for r in rows}
    found = bpe.digests(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_quality_on_held_out_rows(spark):
    docs, labels = queries.documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    rows = [r for r in docs.collect() if r.doc_id in truth]
    right = (model.scores([r.text for r in rows]) >= quality.THRESHOLD) == np.array([truth[r.doc_id] for r in rows])
    assert right.mean() > 0.96
    assert quality.fit_rows([], {}).scores([None, ""]).tolist() == [1.0, 1.0]
    s = model.scores([None, "", "same", "same"])
    assert s[0] == s[1] and s[2] == s[3] and ((s >= 0) & (s <= 1)).all()


def test_mixing(docs, rows):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    size = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        size.setdefault(r.source, []).append(r)
    total = sum(r.size for r in found)
    for part in size.values():
        assert part[0].source_size == sum(r.size for r in part) and part[0].target <= 2 * part[0].source_size + 1e-6
        longest = max([r.size for r in part])
        assert abs(sum(r.taken for r in part) - part[0].target) <= longest
    assert abs(sum(p[0].target for p in size.values()) - 1.5 * total) < 1e-6 * total
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(str((r.doc_id, r.taken)) for r in again) == sorted(str((r.doc_id, r.taken)) for r in found)


def mixed_brute(rows):
    """(doc_id, taken) by the definition: every source sorted whole by its odds ratios."""
    size = lambda t: len(WORD.findall(t or ""))
    number = lambda i, t: (int(hashlib.md5(f"{mixing.SEED}:{hashlib.md5((t or '').encode()).hexdigest() if i is None and t is not None else '' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    sources = {}
    for i, t, _, s, *_ in rows:
        sources.setdefault(s, []).append((i, size(t), number(i, t)))
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, total = set(sources), 1.5 * sum(x[1] for part in sources.values() for x in part)
    own = {s: sum(x[1] for x in part) for s, part in sources.items()}
    goal = {}
    while left:
        level = (total - sum(goal.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] >= 2 * own[s]}
        goal.update({s: 2 * own[s] for s in over} if over else {s: level * weight[s] for s in left})
        left -= over or left
    out, orders = Counter(), []
    for s, part in sources.items():
        m = lambda n: math.floor(math.sqrt(math.sqrt(n)) * mixing.MEASURE)
        rate = None
        for top in sorted({m(n) for _, n, _ in part if n}, reverse=True):
            rate = (goal[s] - 2 * sum(n for _, n, _ in part if m(n) > top)) / sum(n * m(n) for _, n, _ in part if m(n) <= top)
            if rate * top <= 2:
                break
            rate = None
        copies = {}
        for x in part:
            e = (2 * mixing.COPY if rate is None else min(2 * mixing.COPY, math.floor(rate * m(x[1]) * mixing.COPY))) if x[1] else 0
            copies[x] = [e // mixing.COPY, e % mixing.COPY / mixing.COPY]
        missing = goal[s] - sum(copies[x][0] * x[1] for x in part)
        odds = lambda x: (x[2] / (1 - x[2])) / (copies[x][1] / (1 - copies[x][1]))
        drawn = []
        for long in (True, False):
            group = [x for x in part if copies[x][1] and (x[1] >= mixing.LONG) == long]
            quota = sum(copies[x][1] * x[1] for x in group) if long else max(0.0, missing)
            ahead = 0
            for x in sorted(group, key=lambda x: (odds(x), x[1], x[0] is not None, x[0])):
                if ahead + x[1] / 2 <= quota:
                    drawn.append(x)
                ahead += x[1]
            missing -= sum(x[1] for x in drawn if (x[1] >= mixing.LONG) == long)
            by = sorted(group, key=lambda x: x[2])
            orders.append((by, sorted(group, key=odds)))
        chosen = Counter(drawn)
        for x in part:
            out[x[0], x[1] * (copies[x][0] + (1 if chosen[x] > 0 else 0))] += 1
            chosen[x] -= 1
    return out, orders


def test_mixing_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 16)
    monkeypatch.setattr(mixing, "LONG", 60)
    r = random.Random(12)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(int(r.paretovariate(0.7) * 4) % 900)), "en", f"s{r.choice([0, 0, 0, 1, 2])}" if i % 11 else None, 0) for i in range(900)]
    rows += [(None, f"no id {i}", "en", "s0", 0) for i in range(40)] + [(5000, None, "en", "s0", 0), (5001, "", None, None, None)]
    want, orders = mixed_brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "size").repartition(4)
    assert Counter((x.doc_id, x.taken) for x in mixing.mix(docs).collect()) == want
    # inclusion probabilities are unequal, so that the order is not that of the random numbers alone
    assert any(a != b for a, b in orders)


def test_mix_keeps_rows_without_ids(spark, data):
    r = random.Random(11)
    rows = [(i if i % 3 else None, " ".join(f"w{i}x{j}" for j in range(r.randint(5, 60))), "en", f"s{i % 4}", 0) for i in range(1200)]
    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), data).collect()
    size, taken, bare = Counter(), Counter(), Counter()
    for _, text, _, source, _ in rows:
        size[source] += len(text.split())
    for m in mixed:
        taken[m.source] += len(m.text.split())
        bare[m.source] += m.doc_id is None
    goal = {g.source: g.target for g in mixing.targets(spark.createDataFrame(list(size.items()), "source string, size long")).collect()}
    assert any(goal[s] < size[s] for s in goal)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 60
        assert 0.2 < bare[s] / sum(m.source == s for m in mixed) < 0.47
    assert max(Counter(m.text for m in mixed).values()) <= mixing.MOST


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    said, frame = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, data)
    assert sorted(said.columns) == sorted(frame.columns)
    at = [said.columns.index(c) for c in frame.columns]
    assert sorted(str(tuple(r)) for r in frame.collect()) == sorted(str(tuple(r[i] for i in at)) for r in said.fetchall())


def test_notices_anywhere_in_a_text(spark):
    """Against a loop over every template and every place of its anchor."""
    noise = "der Text mit of words about rivers and 42 things "
    said = [
        "All rights reserved.", "Copyright (c) 2021 Foo. All rights reserved.", noise * 300 + "Released under the MIT License. " + noise,
        "# This program is free software: you can\n# redistribute it and/or modify it under the terms of\n# the GNU General Public License as published by the Free\n# Software Foundation, either version 3 of the License",
        "This project is licensed under the MIT License - see the LICENSE.md file", noise + "Licensed under the Apache Licence, Version 2.0 " + noise * 20, "a license to fish", "license", "rights", "", None, "mit License", "license " * 400,
        "Released under the MIT License.", "Released under the MIT License.",
    ]
    weights, unknown = licenses.template_weights()
    w, idf = {(r[0], r[2]): r[3] for r in weights}, {r[2]: r[4] for r in weights}

    def best(text):
        ts, found = licenses.tokens_of(text or ""), []
        if not text or not re.search(licenses.TRIGGER, text):
            return None, None, None
        for anchor, i, name, before, n in licenses.template_anchors():
            for at in (k for k, x in enumerate(ts) if x == anchor):
                bag = Counter(ts[max(0, at - before) : at - before + n])
                x = {t: c * idf.get(t, unknown) for t, c in bag.items()}
                score = round(sum(v * w.get((i, t), 0) for t, v in x.items()) / math.sqrt(sum(v * v for v in x.values())), 4)
                if score >= licenses.LEAST:
                    found.append((-score, max(0, at - before), i, name))
        return (min(found)[3], -min(found)[0], min(found)[1]) if found else (None, None, None)

    files = spark.createDataFrame([(i, f"d/{i}.txt", t, "x", "y") for i, t in enumerate(said)], "doc_id long, path string, text string, token string, template string")
    got = {r.doc_id: (r.own_license, r.own_score, r.own_at) for r in licenses.scan(files).collect()}
    assert len(got) == len(said) and got == {i: best(t) for i, t in enumerate(said)}
    names = [got[i][0] for i in range(len(said))]
    assert names[:6] == ["Proprietary", "Proprietary", "MIT", "GPL-3.0", "MIT", "Apache-2.0"] and names[6:11] == [None] * 5 and names[-1] == "MIT"


def test_license_scan_keeps_clashing_columns(spark):
    rows = [("a/LICENSE", licenses.TEMPLATES[0][1], "f", "d", 1, "mine"), ("a/b.txt", "no notice", "g", "e", 2, "mine")]
    found = licenses.scan(spark.createDataFrame(rows, "path string, text string, file string, dir string, `n dir` int, license_dir string")).orderBy("path").collect()
    assert [(r.path, r.file, r.dir, r["n dir"]) for r in found] == [("a/LICENSE", "f", "d", 1), ("a/b.txt", "g", "e", 2)]
    assert [(r.origin, r.license_dir) for r in found] == [("own", None), ("inherited", "a")] and len(found[0]) == 10


def test_masking_hides_base_spans_in_any_context():
    assert pii.mask("for example 192.168.1.7 or order +49 30 901820 99") == "for example [IP] or order [PHONE]"
    assert pii.mask("version 1.2 of order 12") == "version 1.2 of order 12"


def test_license_inheritance(spark):
    files = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "code"), (3, "a/b/COPYING", "x\nThis work is licensed under the GNU General Public License, version 3.\n"), (4, "a/b/y.py", None), (5, "z/w.py", ""), (6, None, "t"), (7, "a/q.py", "Licensed under CC BY-NC 4.0.")],
        "doc_id long, path string, text string",
    )
    found = {r.doc_id: (r.license, r.origin, r.license_dir) for r in licenses.scan(files).collect()}
    assert found == {1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "inherited", "a/b"), 5: (None, "none", None), 6: (None, "none", None), 7: ("CC-BY-NC-4.0", "own", None)}


def test_pipeline_stages(spark, data, rows):
    docs = queries.load(spark, data, "documents")
    extra = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (10_001, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.staged(stage(spark, docs, data), f"test-{i}")
        assert docs.columns == columns and docs.count() > 0
    assert not [r for r in docs.collect() if re.search(r"[A-Za-z0-9]@[a-z]+\.example", r.text or "")]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert last.count() == docs.count() and all(len(r.ids) == r.n_tokens for r in last.collect())


OWN = ["quality_score_", "rank_", "row_", "copies_", "copy_", "component_id", "kept", "size", "taken", "unit", "score"]


def test_pipeline_stages_keep_clashing_columns_and_empty_tables(spark, data, rows):
    extra = spark.createDataFrame([(*r, *(f"{c}{i}" for c in OWN)) for i, r in enumerate(rows)], SCHEMA + "".join(f", {c} string" for c in OWN))
    none = extra.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, data).collect() == []
        out = stage(spark, extra, data)
        assert out.columns == extra.columns
        for r in out.collect():
            assert len({r[c][len(c) :] for c in OWN}) == 1 and r.size[4:].isdigit()
    assert corpus_pipeline.STAGES[-1][1](spark, none, data).collect() == []


def test_pipeline_says_which_rows_go(spark, data):
    r = random.Random(21)
    words = [f"word{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(12)]
    near = [" ".join(w if j != 40 else "changed" for j, w in enumerate(b.split())) for b in base[:4]]
    texts = base + near + [base[0]]
    docs = spark.createDataFrame([(100 - i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = {x.doc_id for x in corpus_pipeline.keep_one_of_each_group(spark, docs, data).collect()}
    group = {100 - i: {0: 0, 1: 1, 2: 2, 3: 3}.get(i - 12 if 12 <= i < 16 else 0 if i == 16 else i, i) for i in range(len(texts))}
    assert kept == {min(d for d in group if group[d] == g) for g in set(group.values())}
    labels = spark.read.parquet(f"{data}/labels.parquet")
    corpus = queries.load(spark, data, "documents")
    good = {x.doc_id for x in corpus_pipeline.reject_by_quality(spark, corpus, data).collect()}
    model = quality.fit(corpus, labels)
    pairs = [(x.doc_id, x.text) for x in corpus.collect()]
    want = {i for (i, _), s in zip(pairs, model.scores([t for _, t in pairs])) if s >= corpus_pipeline.REJECT_BELOW}
    assert good == want
    masked = {x.doc_id: x.text for x in corpus_pipeline.mask_personal_data(spark, corpus, data).collect()}
    assert masked == {i: pii.mask(t) for i, t in pairs}


def test_long_words_merge_by_the_same_rule(spark, monkeypatch):
    import tiktoken

    r = random.Random(8)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "ab" * 3000, "x" * 2000, "é" * 700, " " * 900 + "end", "".join(r.choice("eatinsorl") for _ in range(513)) + " short"]
    library = tiktoken.Encoding("t", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in bpe.encode(frame).collect():
        assert x.ids == library.encode_ordinary(texts[x.doc_id]) and x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()
    ranks = bpe.read_ranks(bpe.default_path())
    words = ["".join(r.choice("abcnstéñ") for _ in range(r.randint(1, 40))).encode() for _ in range(200)]
    assert [bpe.merged_long(w, ranks) for w in words] == [library._encode_single_piece(w) for w in words]


def test_bpe_cuts_as_the_pattern():
    import regex

    assert bpe.default_pattern() == bpe.KNOWN_PATTERN
    find, r = regex.compile(bpe.KNOWN_PATTERN).findall, random.Random(1)
    for _ in range(1500):
        texts = ["".join(r.choice("'''  \n\t　 stmdrevlaé1٣.!\U0001f600Zx") for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 6))]
        want = [find(t) for t in texts]
        assert bpe._cut(texts) == ([w for x in want for w in x], list(map(len, want)))


@pytest.mark.parametrize("rows_in_unit, cut_chars", [(7, 1), (bpe.UNIT_ROWS, bpe.CUT_CHARS)])
def test_bpe_returns_ids_in_units_of_any_size(docs, rows, monkeypatch, rows_in_unit, cut_chars):
    import tiktoken

    monkeypatch.setattr(bpe, "UNIT_ROWS", rows_in_unit)
    monkeypatch.setattr(bpe, "CUT_CHARS", cut_chars)
    library = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    found = bpe.encode(docs.withColumnRenamed("lang", "unit")).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == want
