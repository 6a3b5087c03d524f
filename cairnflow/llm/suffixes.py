"""Repeated passages by difference-cover suffix sorting.

A byte is removed if a ``LENGTH``-byte string that covers it also starts in a document of a smaller doc_id.

Equal strings are brought together by their content: a string belongs to the smallest hash among its ``GRAM``-byte
pieces (its anchor), and consecutive strings of one anchor form a run. A first exchange of anchors (5 bytes each) tells which
of them lie in more than one document; the others hold no repeated string. In a second one, the runs of the rest meet in buckets
by anchor: each unit of documents sends a run once, with its smallest doc_id, so that copies and common passages
are gathered before the shuffle. Runs are told apart by their bytes. A run whose anchor no other distinct run of its bucket has holds
all its strings alone. Of the others a bucket sorts the suffixes with the difference cover {1, 2} mod 3:
it names the sampled triples, recurses on the names until they span ``LENGTH`` bytes, places the remaining suffixes by their first
byte and the rank behind it, merges, and compares adjacent suffixes. For each string it gives the smallest doc_id it starts
in, and a unit removes what starts in a smaller one.

Defined results: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose none; rows that share a doc_id
do not remove from each other; rows without a doc_id neither lose bytes nor take any from others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged
from .lm import LEAST_BUCKETS, MOST_BUCKETS, _cuts, _packed, _texts, _unpacked, units
from .shingles import TOGETHER, grouped, mix

LENGTH = 50
GRAM = 22
_U = np.uint64
NOBODY = 2**63 - 1
#: Bytes of runs whose suffixes are sorted together; a bucket is cut into parts of about this size by further bits of the anchor.
SORTED_BYTES = 1 << 19
PART_BITS = 32


_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, TOGETHER + (1 << 16))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[_U(1), np.full(m - 1, _U(b))]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` values."""
    span, m = 1, h
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Runs:
    """The runs of a unit's texts: anchor, text, start within the text, strings that start in the run."""

    def __init__(self, texts: list[bytes]):
        parts = [self._of(texts[a:b], a) for a, b in grouped(texts)]
        self.anchor, self.text, self.start, self.many = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate((_U, np.int64, np.int64, np.int64)))

    @staticmethod
    def _of(texts: list[bytes], first: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) < LENGTH:
            none = np.zeros(0, np.int64)
            return none.astype(_U), none, none, none
        power, inverse = powers(len(data) + 1)
        bounds = np.r_[0, np.cumsum(sizes)]
        with np.errstate(over="ignore"):
            total = np.r_[_U(0), np.cumsum(_BYTES[data] * power[: len(data)])]
            h = (total[GRAM:] - total[:-GRAM]) * inverse[: len(data) - GRAM + 1]
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(29)
        anchors = _smallest(h, LENGTH - GRAM + 1)
        # strings that end within their text
        whole = np.zeros(len(data) + 1, np.int64)
        fits = sizes >= LENGTH
        np.add.at(whole, bounds[:-1][fits], 1)
        np.add.at(whole, (bounds[1:] - LENGTH + 1)[fits], -1)
        whole = np.cumsum(whole[: len(anchors)]) > 0
        at = np.flatnonzero(whole)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none.astype(_U), none, none, none
        value = anchors[at]
        begins = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)])
        start, many = at[begins], np.diff(np.r_[begins, len(at)])
        text = np.searchsorted(bounds, start, "right") - 1
        # texts that lie end to end may share an anchor: the gap between whole strings parts them, LENGTH > 1
        return value[begins], text + first, start - bounds[text], many

    def pick(self, keep: np.ndarray) -> None:
        for name in ("anchor", "text", "start", "many"):
            setattr(self, name, getattr(self, name)[keep])


def _named(*columns: np.ndarray) -> np.ndarray:
    """The dense rank of each row of small non-negative columns."""
    key, size = columns[0], int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        k = int(c.max(initial=0)) + 1
        if size * k >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max(initial=0)) + 1
        key, size = key * k + c, size * k
    return np.unique(key, return_inverse=True)[1]


def suffix_ranks(text: np.ndarray, span: int) -> np.ndarray:
    """The place of each suffix of ``text`` (positive integers) in their order by the first ``span`` symbols at least; suffixes
    that agree in those may stand in any order beside each other."""
    n = len(text)
    t = np.r_[text, np.zeros(3, text.dtype)].astype(np.int64)
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.r_[one, two]
    names = _named(t[sample], t[sample + 1], t[sample + 2])
    if span > 3 and len(names) and names.max() + 1 < len(names):
        # the recursion's text: the names of either class of positions, parted by 0
        deep = suffix_ranks(np.r_[names[: len(one)] + 2, 1, names[len(one) :] + 2], -(-span // 3))
        ranks = np.r_[deep[: len(one)], deep[len(one) + 1 :]]
    else:
        ranks = names
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = ranks + 1
    top = int(rank.max(initial=0)) + 1
    zero = np.arange(0, n, 3)
    # the remaining suffixes by their first symbol and the rank behind it
    zero_key = t[zero] * top + rank[zero + 1]
    zero_order = np.argsort(zero_key)
    sample_order = np.argsort(ranks)
    place = np.zeros(n, np.int64)
    place[sample[sample_order]] = np.arange(len(sample))
    place[zero[zero_order]] = np.arange(len(zero))
    # merge: a remaining suffix against either class of sampled ones, whose ranks behind one or two symbols are known
    width = int(t.max(initial=0)) + 1
    one_key = t[one] * top + rank[one + 1]
    pair = _named(np.r_[t[two] * width + t[two + 1], t[zero] * width + t[zero + 1]])
    two_key, zero_two_key = pair[: len(two)] * top + rank[two + 2], pair[len(two) :] * top + rank[zero + 2]
    # both sides are searched in their order, which keeps to the cache
    for keys, zeros, members in ((one_key, zero_key, one), (two_key, zero_two_key, two)):
        by_key, by_zero = np.argsort(keys), np.argsort(zeros)
        sorted_keys, sorted_zeros = keys[by_key], zeros[by_zero]
        place[zero[by_zero]] += np.searchsorted(sorted_keys, sorted_zeros, "left")
        place[members[by_key]] += np.searchsorted(sorted_zeros, sorted_keys, "right")
    out = np.empty(n, np.int64)
    out[np.argsort(place)] = np.arange(n)
    return out


def repeated(strings: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each of distinct ``strings``, at each start of a LENGTH-byte string in it, the smallest ``least`` of the strings it starts in."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(sizes) - sizes
    # a 1 after each string, bytes from 2
    owner = np.repeat(np.arange(len(strings)), sizes)
    text = np.ones(len(data) + len(strings), np.int64)
    text[np.arange(len(data)) + owner] = data.astype(np.int64) + 2
    starts = np.concatenate([np.arange(a, a + n - LENGTH + 1) for a, n in zip(begin, sizes)])
    ranks = suffix_ranks(text, LENGTH)
    own = owner[starts]
    order = np.argsort(ranks[starts + own])
    sorted_starts = starts[order]
    # compare adjacent prefixes, eight bytes at a time
    padded = np.r_[data, np.zeros(16, np.uint8)].tobytes()
    words = np.empty(len(data) + 1, _U)
    for s in range(8):
        part = np.frombuffer(padded, "<u8", (len(padded) - s) // 8, s)
        words[s::8] = part[: len(words[s::8])]
    same = np.ones(max(0, len(order) - 1), bool)
    for at in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        w = words[sorted_starts + at]
        same &= w[1:] == w[:-1]
    group = np.r_[0, np.cumsum(~same)]
    first = np.flatnonzero(np.r_[True, ~same])
    smallest = np.minimum.reduceat(least[own[order]], first)[group]
    result = np.empty(len(starts), np.int64)
    result[order] = smallest
    return np.split(result, np.cumsum(sizes - LENGTH + 1)[:-1])


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _spread(texts: list[bytes], ids: np.ndarray, known: np.ndarray) -> Runs:
    runs = Runs(texts)
    runs.pick(known[runs.text])
    return runs


def _anchors(runs: Runs, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A unit's distinct anchors, the anchor of each run among them, and whether several documents of the unit have it."""
    anchors, at = np.unique(runs.anchor, return_inverse=True)
    low, high = np.full(len(anchors), NOBODY), np.full(len(anchors), -NOBODY)
    np.minimum.at(low, at, ids[runs.text])
    np.maximum.at(high, at, ids[runs.text])
    return anchors, at, low < high


def _row(batch, i: int):
    return tuple(c[i].as_py() for c in batch.columns)


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


def _grouped_rows(batches, key: int = 0):
    """Rows of batches, sorted by their first columns, as (key, rows)."""
    now, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = _row(batch, i)
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def shared_anchors(table: DataFrame, buckets: int, spread=_spread) -> DataFrame:
    """(unit, bucket, said): a bit for each anchor that a unit has in a bucket, in order: whether several documents have it.
    ``spread``: the anchors of a unit's texts and the text of each."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                unit, ids, known, lengths, texts = _row(batch, i)
                ids, known = np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8) == 1
                anchors, _, several = _anchors(spread(_texts(lengths, texts), ids, known), ids)
                cuts = _cuts(anchors, buckets)
                rows = [(k, unit, _five(anchors[a:b]), np.packbits(several[a:b]).tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                yield _table(rows, ["bucket", "unit", "anchors", "several"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def answer(batches):
        for bucket, held in _grouped_rows(batches):
            anchors = [_unfive(r[2]) for r in held]
            several = [np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(a)) for r, a in zip(held, anchors)]
            every, at = np.unique(np.concatenate(anchors), return_inverse=True)
            # once for each unit, once more where a unit has it in several documents
            shared = (np.bincount(at, 1 + np.concatenate(several), minlength=len(every)) > 1)[at]
            said = np.split(shared, np.cumsum([len(a) for a in anchors])[:-1])
            yield _table([(r[1], bucket, np.packbits(s).tobytes()) for r, s in zip(held, said)], ["unit", "bucket", "said"], [pa.int64(), pa.int32(), pa.binary()])

    asked = table.select("unit", "ids", "known", "lengths", "texts").mapInArrow(ask, "bucket int, unit long, anchors binary, several binary")
    return asked.repartition("bucket").sortWithinPartitions("bucket", "unit").mapInArrow(answer, "unit long, bucket int, said binary")


_UNIT = ["unit", "bucket", "ids", "known", "lengths", "texts", "kind", "said"]


def _with_replies(table: DataFrame, *replies: DataFrame) -> DataFrame:
    """Units (bucket -1) and the replies of each kind, sorted so that a unit's row comes first and replies follow by kind and bucket."""
    none = F.lit(None).cast("binary")
    out = table.select("unit", F.lit(-1).alias("bucket"), "ids", "known", "lengths", "texts", F.lit(-1).alias("kind"), none.alias("said"))
    for k, r in enumerate(replies):
        out = out.unionByName(r.select("unit", "bucket", *[none.alias(c) for c in ("ids", "known", "lengths", "texts")], F.lit(k).alias("kind"), "said"))
    return out.repartition("unit").sortWithinPartitions("unit", "kind", "bucket").select(*_UNIT)


def _candidates(held: list[tuple], buckets: int):
    """(ids, known, texts, runs with shared anchors, replies of later kinds) of a unit from its rows."""
    _, _, ids, known, lengths, texts, *_ = held[0]
    ids, known, texts = np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8) == 1, _texts(lengths, texts)
    runs = _spread(texts, ids, known)
    anchors, at, _ = _anchors(runs, ids)
    cuts = _cuts(anchors, buckets)
    bits = {r[1]: r[7] for r in held[1:] if r[6] == 0}
    shared = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a).astype(bool) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b)])
    runs.pick(shared[at] if len(at) else np.zeros(0, bool))
    return ids, known, texts, runs, [r for r in held[1:] if r[6] == 1]


def _distinct(runs: Runs, texts: list[bytes], buckets: int):
    """A unit's distinct runs by bucket: the first of each, the run of each occurrence, the buckets' cuts, and the runs' bytes."""
    shift = _U(64 - (buckets.bit_length() - 1))
    seen: dict[bytes, int] = {}
    of = np.fromiter((seen.setdefault(texts[t][s : s + m], len(seen)) for t, s, m in zip(runs.text.tolist(), runs.start.tolist(), (runs.many + LENGTH - 1).tolist())), np.int64, len(runs.text))
    first = np.full(len(seen), len(of))
    np.minimum.at(first, of, np.arange(len(of)))
    bucket = runs.anchor[first] >> shift
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    strings = list(seen)
    return first[order], place[of] if len(of) else of, np.searchsorted(bucket[order], np.arange(buckets + 1).astype(_U)), [strings[i] for i in order.tolist()]


def smallest_owners(table: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """(unit, bucket, said): for each string of each distinct run of a unit, the smallest doc_id that it starts in."""

    def ask(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for unit, held in _grouped_rows(batches):
            ids, _, texts, runs, _ = _candidates(held, buckets)
            if not len(runs.anchor):
                continue
            first, of, cuts, strings = _distinct(runs, texts, buckets)
            least = np.full(len(first), NOBODY)
            np.minimum.at(least, of, ids[runs.text])
            low = _U(64 - (buckets.bit_length() - 1) - PART_BITS)
            part = (runs.anchor[first] >> low & _U((1 << PART_BITS) - 1)).astype("<u4")
            rows = [
                (k, unit, _packed(runs.many[first[a:b]].astype("<u4")), pack.compress(b"".join(strings[a:b])), _packed(least[a:b].astype("<i8")), part[a:b].tobytes())
                for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()))
                if a < b
            ]
            yield _table(rows, ["bucket", "unit", "many", "strings", "least", "part"], [pa.int32(), pa.int64()] + [pa.binary()] * 4)

    def answer(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for bucket, held in _grouped_rows(batches):
            many = [_unpacked(r[2], "<u4").astype(np.int64) for r in held]
            seen: dict[bytes, int] = {}
            of = []
            for r, m in zip(held, many):
                raw, ends = unpack.decompress(r[3]), np.cumsum(m + LENGTH - 1).tolist()
                of += [seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *ends], ends)]
            strings, of = list(seen), np.array(of)
            del seen
            first = np.full(len(strings), len(of))
            np.minimum.at(first, of, np.arange(len(of)))
            owner = np.full(len(strings), NOBODY)
            np.minimum.at(owner, of, np.concatenate([_unpacked(r[4], "<i8") for r in held]))
            base = np.cumsum([0, *map(len, many)])
            starts = np.concatenate(many)[first]
            part = np.concatenate([np.frombuffer(r[5], "<u4") for r in held])[first].astype(np.int64)
            order = np.argsort(part, kind="stable")
            new = part[order][1:] != part[order][:-1]
            alone = np.empty(len(order), bool)
            alone[order] = np.r_[True, new] & np.r_[new, True]
            found: list[np.ndarray] = [np.full(n, w) if single else None for n, w, single in zip(starts.tolist(), owner.tolist(), alone.tolist())]
            # equal strings have equal anchors, so parts by anchor are sorted one after the other
            order = order[~alone[order]]
            size = np.cumsum(starts[order] + LENGTH - 1)
            cut = np.flatnonzero(np.r_[False, (part[order][1:] != part[order][:-1])])
            cut = cut[np.r_[True, np.diff(size[cut - 1] // SORTED_BYTES) > 0]] if len(cut) else cut
            for mine in np.split(order, cut):
                if len(mine):
                    for at, x in zip(mine.tolist(), repeated([strings[i] for i in mine.tolist()], owner[mine])):
                        found[at] = x
            for k, r in enumerate(held):
                mine = [found[c] for c in of[base[k] : base[k + 1]]]
                yield _table([(r[1], bucket, _packed(np.concatenate(mine).astype("<i8")))], ["unit", "bucket", "said"], [pa.int64(), pa.int32(), pa.binary()])

    asked = _with_replies(table, anchors).mapInArrow(ask, "bucket int, unit long, many binary, strings binary, least binary, part binary")
    return asked.repartition("bucket").sortWithinPartitions("bucket", "unit").mapInArrow(answer, "unit long, bucket int, said binary")


def deduplicated(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the remaining bytes) for each row of ``docs``."""
    table = staged(units(docs), "suffix-units")
    buckets = 1 << int(np.clip(table.select("unit").count(), LEAST_BUCKETS, MOST_BUCKETS) - 1).bit_length()
    anchors = staged(shared_anchors(table, buckets), "suffix-anchors")
    owners = staged(smallest_owners(table, anchors, buckets), "suffix-owners")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text

    def remove(batches):
        for _, held in _grouped_rows(batches):
            ids, known, texts, runs, said = _candidates(held, buckets)
            spans: dict[int, list[tuple[int, int]]] = {}
            if len(runs.anchor):
                first, of, cuts, _ = _distinct(runs, texts, buckets)
                replies = {r[1]: r[7] for r in said}
                owner = np.concatenate([_unpacked(replies[k], "<i8") for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b])
                at = np.cumsum(runs.many[first]) - runs.many[first]
                where = np.repeat(at[of] - (np.cumsum(runs.many) - runs.many), runs.many) + np.arange(runs.many.sum())
                text = np.repeat(runs.text, runs.many)
                start = np.repeat(runs.start - (np.cumsum(runs.many) - runs.many), runs.many) + np.arange(runs.many.sum())
                hit = owner[where] < ids[text]
                text, start = text[hit], start[hit]
                order = np.lexsort((start, text))
                text, start = text[order], start[order]
                new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (start[1:] > start[:-1] + LENGTH)][: len(text)])
                for a, b in zip(new.tolist(), [*(new[1:] - 1).tolist(), len(text) - 1]):
                    spans.setdefault(int(text[a]), []).append((int(start[a]), int(start[b]) + LENGTH))
            rows = []
            for i, (doc_id, there, data) in enumerate(zip(ids.tolist(), known.tolist(), texts)):
                parts, at = [], 0
                for a, b in spans.get(i, []):
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]]) if parts else data
                rows.append((doc_id if there else None, len(data), len(data) - len(kept), len(spans.get(i, [])), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            yield _table(rows, names, kinds)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return _with_replies(table, anchors, owners).mapInArrow(remove, schema)
