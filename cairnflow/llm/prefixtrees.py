"""Repeated passages of words by prefix-partitioned suffix trees.

A word is removed if a window of ``WINDOW`` consecutive words that covers it has a word sequence that also starts in a document of a
smaller doc_id. The suffixes are those that start at a window, cut behind it, so a node of depth ``WINDOW`` is a repeated passage.

Four steps, each over units of documents of about 4 MB:

1. A window's anchor is the smallest hash among its ``GRAM``-word pieces, so equal windows have equal anchors. An exchange of distinct
   anchors tells which of them lie in more than one document; windows of the others start no repeat and go no further.
2. Prefixes are counted over the suffixes that are left. A unit reports each prefix (of one word, and below a reported one of one
   word more) that starts at least 1 / units of ``GROUP`` of its distinct suffixes; a prefix with more than ``GROUP`` reported suffixes
   is heavy and gets split by its next word. So a suffix belongs to its shortest prefix that is not heavy, or to its whole window. What
   was not reported adds less than ``GROUP``, so a prefix that is not split has at most twice ``GROUP`` suffixes before units merge
   equal ones, whatever its first words' share of the corpus; a whole window has one a unit.
3. Small prefixes share a bucket (a virtual tree). A unit sends a bucket its distinct suffixes once each, with their smallest doc_id.
   The bucket sorts them; leaves that agree with their neighbour for ``WINDOW`` words hang below one deep internal node, whose smallest
   doc_id goes back to each of them.
4. A unit removes what its windows with a smaller owner cover; overlapping windows make maximal spans.

Hashes only choose buckets; suffixes are told apart by their bytes (words joined by one space).

Defined results: null and blank texts have no words; texts of fewer than ``WINDOW`` words lose none; rows that share a doc_id do not
remove from each other; rows without a doc_id neither lose words nor take any from others; an empty table gives no rows; columns
other than doc_id and text are not read. Texts are whole; one longer than a unit is its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_staged, staged
from .lm import LEAST_BUCKETS, MOST_BUCKETS, _cuts, _packed, _texts, _unpacked, units
from .shingles import SPACE, grouped, mix, word_lanes
from .suffixes import NOBODY, _anchors, _grouped_rows, _smallest, _table, shared_anchors

WINDOW = 13
GRAM = 4
#: Suffixes from which a prefix is split by its next word; more only where MOST_HEAVY needs it.
GROUP = 1 << 17
#: A unit has at most some 2 ** 21 words, so WINDOW * 2 ** 21 / HEAVY_A_UNIT bounds the heavy prefixes, whatever the input: under 30 MB.
HEAVY_A_UNIT = 8
_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)


def _extended(prefix: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashes of prefixes that are one word longer, ``at`` the place of that word."""
    with np.errstate(over="ignore"):
        return mix(prefix * _STEP + words[at])


class Windows:
    """The words of a unit's texts, and its windows as runs of one anchor: anchor, text, first window, how many."""

    def __init__(self, texts: list[bytes], known: np.ndarray, window: int):
        canon = [b" ".join(t.split()) for t in texts]  # at exactly the bytes 20 and 09 to 0D
        self.window = window
        self.data = b"\n".join([*canon, b""])
        space = SPACE[np.frombuffer(self.data, np.uint8)]
        edges = np.flatnonzero(np.r_[True, space[:-1]] != space)
        self.begin, self.end = edges[::2], edges[1::2]
        parts = [word_lanes(canon[a:b], fold=False) for a, b in grouped(canon)]
        self.counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
        self.words = np.concatenate([np.zeros(0, _U), *(h[0] for h, _ in parts)])
        n = len(self.words)
        if n < window:
            self.anchor, self.text, self.first, self.many = np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3))
            return
        gram = min(GRAM, window)
        piece = self.words[: n - gram + 1].copy()
        for i in range(1, gram):
            piece = _extended(piece, self.words, np.arange(i, i + len(piece)))
        anchors = _smallest(piece, window - gram + 1)
        text = np.repeat(np.arange(len(canon)), self.counts)
        at = np.flatnonzero((text[: n - window + 1] == text[window - 1 :]) & known[text[: n - window + 1]])
        value, of = anchors[at], text[at]
        new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])][: len(at)])
        self.anchor, self.text, self.first, self.many = value[new], of[new], at[new], np.diff(np.r_[new, len(at)])

    def pick(self, keep: np.ndarray) -> None:
        for name in ("anchor", "text", "first", "many"):
            setattr(self, name, getattr(self, name)[keep])

    def each(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the text of every window of the runs."""
        before = np.cumsum(self.many) - self.many
        return np.repeat(self.first - before, self.many) + np.arange(self.many.sum()), np.repeat(self.text, self.many)

    def distinct(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first occurrence of each distinct window among those at ``at``, and which of them each is."""
        seen: dict[bytes, int] = {}
        data, put = self.data, seen.setdefault
        of = np.fromiter((put(data[a:b], len(seen)) for a, b in zip(self.begin[at].tolist(), self.end[at + self.window - 1].tolist())), np.int64, len(at))
        first = np.full(len(seen), len(of))
        np.minimum.at(first, of, np.arange(len(of)))
        return at[first], of

    def groups(self, at: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """The hash of the shortest prefix of each suffix that is not heavy, or of its whole window."""
        out = mix(self.words[at])
        live = np.arange(len(at))
        for k in range(1, self.window):
            live = live[np.isin(out[live], heavy)] if len(heavy) else live[:0]
            if not len(live):
                break
            out[live] = _extended(out[live], self.words, at[live] + k)
        return out

    def reported(self, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes that start at least ``least`` of the suffixes, each below a reported one, with their numbers."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        out = mix(self.words[at])
        for k in range(1, self.window):
            if len(at) < least:
                break
            prefix, of, many = np.unique(out, return_inverse=True, return_counts=True)
            often = many >= least
            found.append((prefix[often], many[often]))
            live = often[of]
            at, out = at[live], out[live]
            out = _extended(out, self.words, at + k)
        return tuple(np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in enumerate((_U, np.int64)))


_KEPT = "unit long, ids binary, known binary, lengths binary, texts binary, bits binary"
_NAMES = ["unit", "ids", "known", "lengths", "texts", "bits"]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _left(row: tuple, window: int, buckets: int):
    """(unit, ids, known, windows whose anchor several documents have) of a unit with its bits, whole bytes of them for each bucket."""
    unit, ids, known, lengths, texts, bits, *_ = row
    ids, known = np.frombuffer(ids, "<i8"), np.frombuffer(known, np.uint8) == 1
    w = Windows(_texts(lengths, texts), known, window)
    every, at = np.unique(w.anchor, return_inverse=True)
    many = np.diff(_cuts(every, buckets))
    bits, ends = np.frombuffer(bits, np.uint8), np.cumsum(-(-many // 8)).tolist()
    shared = np.concatenate([np.zeros(0, bool), *(np.unpackbits(bits[b - -(-n // 8) : b], count=n).astype(bool) for n, b in zip(many.tolist(), ends) if n)])
    w.pick(shared[at] if len(at) else shared)
    return unit, ids, known, w


def _with_bits(table: DataFrame, replies: DataFrame) -> DataFrame:
    """Units with a bit for each of their distinct anchors, from the replies of the buckets in order."""
    none = F.lit(None).cast("binary")
    both = table.select("unit", F.lit(-1).alias("bucket"), "ids", "known", "lengths", "texts", none.alias("said"))
    both = both.unionByName(replies.select("unit", "bucket", *[none.alias(c) for c in ("ids", "known", "lengths", "texts")], "said"))

    def run(batches):
        for unit, held in _grouped_rows(batches):
            yield _table([(unit, *held[0][2:6], b"".join(r[6] for r in held[1:]))], _NAMES, [pa.int64()] + [pa.binary()] * 5)

    return both.repartition("unit").sortWithinPartitions("unit", "bucket").mapInArrow(run, _KEPT)


def heavy_prefixes(kept: DataFrame, units_there: int, window: int, buckets: int) -> np.ndarray:
    """The sorted hashes of the heavy prefixes; their number is bounded (see HEAVY_A_UNIT)."""
    group = max(GROUP, HEAVY_A_UNIT * units_there)
    least = max(2, group // max(1, units_there))

    def run(batches):
        for row in _rows(batches):
            _, _, _, w = _left(row, window, buckets)
            at, _ = w.each()
            whole = mix(w.words[at])
            for k in range(1, window):
                whole = _extended(whole, w.words, at + k)
            prefix, many = w.reported(at[np.unique(whole, return_index=True)[1]], least)
            yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(many)], ["prefix", "many"])

    counted = kept.mapInArrow(run, "prefix long, many long").groupBy("prefix").agg(F.sum("many").alias("many")).where(F.col("many") > group)
    return np.sort(np.array(counted.select("prefix").toArrow().column(0).to_pylist(), np.int64).view(_U))


def deep_nodes(leaves: list[bytes], least: np.ndarray) -> np.ndarray:
    """For each leaf of a subtree (suffixes cut at the window's depth) the smallest ``least`` below its deep node: leaves that are
    neighbours in the sorted order and agree in all their words."""
    order = sorted(range(len(leaves)), key=leaves.__getitem__)
    agree = np.fromiter((leaves[a] == leaves[b] for a, b in zip(order, order[1:])), bool, max(0, len(order) - 1))
    first = np.flatnonzero(np.r_[True, ~agree][: len(order)])
    node = np.cumsum(np.r_[True, ~agree][: len(order)]) - 1
    order = np.array(order, np.int64)
    out = np.empty(len(leaves), np.int64)
    out[order] = np.minimum.reduceat(least[order], first)[node] if len(order) else 0
    return out


def smallest_owners(kept: DataFrame, heavy, buckets: int, window: int) -> DataFrame:
    """(unit, bucket, said): for each distinct suffix that a unit sent, the smallest doc_id that it starts in."""

    def ask(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for row in _rows(batches):
            unit, ids, _, w = _left(row, window, buckets)
            at, text = w.each()
            if not len(at):
                continue
            first, of = w.distinct(at)
            least = np.full(len(first), NOBODY)
            np.minimum.at(least, of, ids[text])
            group = w.groups(first, heavy.value)
            order = np.argsort(group, kind="stable")
            cuts = _cuts(group[order], buckets).tolist()
            begin, end = w.begin[first[order]].tolist(), w.end[first[order] + window - 1].tolist()
            least = least[order].astype("<i8")
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    sent = pack.compress(b"\n".join(w.data[x:y] for x, y in zip(begin[a:b], end[a:b])))
                    yield _table([(k, unit, sent, _packed(least[a:b]))], ["bucket", "unit", "suffixes", "least"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    def answer(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for bucket, held in _grouped_rows(batches):
            sent = [unpack.decompress(r[2]).split(b"\n") for r in held]
            found = deep_nodes([s for part in sent for s in part], np.concatenate([_unpacked(r[3], "<i8") for r in held]))
            parts = np.split(found, np.cumsum([len(s) for s in sent])[:-1])
            yield _table([(r[1], bucket, _packed(x.astype("<i8"))) for r, x in zip(held, parts)], ["unit", "bucket", "said"], [pa.int64(), pa.int32(), pa.binary()])

    asked = kept.mapInArrow(ask, "bucket int, unit long, suffixes binary, least binary")
    return asked.repartition("bucket").sortWithinPartitions("bucket", "unit").mapInArrow(answer, "unit long, bucket int, said binary")


def deduplicated(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept: the remaining words, spans: the removed ones as from:to in words) for each row of ``docs``."""
    spark = docs.sparkSession
    table = staged(units(docs), "tree-units")
    there = table.select("unit").count()
    buckets = 1 << int(np.clip(there, LEAST_BUCKETS, MOST_BUCKETS) - 1).bit_length()
    anchors = shared_anchors(table, buckets, lambda texts, ids, known: Windows(texts, known, window))
    kept = staged(_with_bits(table, anchors), "tree-bits")
    drop_staged(table)
    heavy = spark.sparkContext.broadcast(heavy_prefixes(kept, there, window, buckets))
    owners = staged(smallest_owners(kept, heavy, buckets, window), "tree-owners")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept", "spans"] * keep_text
    kinds = [pa.int64()] * 3 + [pa.string()] * (1 + 2 * keep_text)

    def remove(batches):
        for _, held in _grouped_rows(batches):
            row = held[0]
            _, ids, known, w = _left((row[0], *row[2:7]), window, buckets)
            cover = np.zeros(len(w.words) + 1, np.int64)
            at, text = w.each()
            if len(at):
                first, of = w.distinct(at)
                group = w.groups(first, heavy.value)
                owner = np.empty(len(first), np.int64)
                owner[np.argsort(group, kind="stable")] = np.concatenate([_unpacked(r[7], "<i8") for r in held[1:]])
                hit = at[owner[of] < ids[text]]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            rows, ends = [], np.cumsum(w.counts).tolist()
            for doc_id, there, n, b in zip(ids.tolist(), known.tolist(), w.counts.tolist(), ends):
                mine = gone[b - n : b]
                turns = np.flatnonzero(np.diff(np.r_[False, ~mine, False])) + (b - n)  # kept words from, to, by turns
                text = b" ".join(w.data[w.begin[x] : w.end[y - 1]] for x, y in zip(turns[::2], turns[1::2]))
                out = [doc_id if there else None, n, int(mine.sum()), hashlib.sha256(text).hexdigest()]
                if keep_text:
                    cut = np.flatnonzero(np.diff(np.r_[False, mine, False]))
                    out += [text.decode("utf-8", "replace"), ",".join(f"{x}:{y}" for x, y in zip(cut[::2].tolist(), cut[1::2].tolist()))]
                rows.append(tuple(out))
            yield _table(rows, names, kinds)

    none = F.lit(None).cast("binary")
    both = kept.select("unit", F.lit(-1).alias("bucket"), "ids", "known", "lengths", "texts", "bits", none.alias("said"))
    both = both.unionByName(owners.select("unit", "bucket", *[none.alias(c) for c in ("ids", "known", "lengths", "texts", "bits")], "said"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans string" * keep_text
    return both.repartition("unit").sortWithinPartitions("unit", "bucket").mapInArrow(remove, schema)
