"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Documents are cut into matches of the split pattern. A unit of documents keeps, for each match, its place among the unit's distinct
matches (words), and asks for those once: words meet in buckets by hash, so that a word of many units is folded once. Higher-order
functions fold the merges over each distinct word of a bucket: the word is an array of its bytes, and ``aggregate``
merges the adjacent pair of lowest rank, leftmost first, until no pair has a rank. Ranks come from a literal map,
split by CRC-32 into an array of small maps, because Spark searches a map from its start. A word that is itself in the
vocabulary keeps its own rank. Decoding looks each id up in a literal array of byte pieces and concatenates them. The units then
put the ids and bytes of their words in the order of their matches.

A fold's time is quadratic in the word's length. A word of more than ``LONG`` bytes (a run of letters that no language has) is merged by the
same rule in a linked list with a heap instead, in the task that has its bucket; its time follows its length.

Bytes are written as the characters U+0000 to U+00FF of a string (ISO 8859-1), which Spark's map keys and ``concat``
take directly. Units are written once, in buckets by their number, and only the words and their ids travel after that.

Defined results: a null text encodes as the empty text (no ids); white space, digits and any other characters are
encoded without loss; ids come in text order; repeated rows give repeated results. Texts of any length are whole; a
unit ends after ``UNIT_ROWS`` documents or ``UNIT_CHARS`` characters, and a longer document is a unit of its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import staged_by
from .common import short_plans, staged

#: Small maps that the rank map is split into.
MAPS = 16384
UNIT_ROWS = 8192
UNIT_CHARS = 32_000_000
#: Texts that are cut together: characters.
CUT_CHARS = 1 << 20
#: Documents or bytes of text to a bucket of words, and the least and most buckets; a bucket's words are in one task.
BUCKET_DOCS, BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 1024, 4 << 20, 8, 1 << 17
#: Bytes of a word from which it is merged in a linked list.
LONG = 512
#: Units of full size in one part of the table of units.
UNITS_A_PART = 16
#: Documents in one batch of results.
TOGETHER = 200
DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal: an array of maps from a byte string to its rank."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        maps[zlib.crc32(key.encode()) % MAPS][key] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def piece_array(ranks: dict[bytes, int]) -> Column:
    """The literal for decoding: byte pieces in the order of their ids, gaps empty."""
    pieces = [""] * (max(ranks.values(), default=0) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")


def encode_word(word: Column, table: Column) -> Column:
    """The ids of one word (a string of byte characters) as an array."""

    def rank(piece: Column) -> Column:
        return F.element_at(F.get(table, (F.crc32(piece.cast("binary")) % MAPS).cast("int")), piece)

    # null on either side stands for the word's ends: no pair with it has a rank
    nothing = F.array(F.lit(None).cast("string"))
    pieces = F.concat(nothing, F.split(word, ""), nothing)
    start = F.transform(
        F.array(pieces),
        lambda p: F.struct(p.alias("p"), F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: rank(F.concat(F.get(p, i), F.get(p, i + 1)))).alias("r")),
    )

    def step(acc: Column, _: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def merged(at: Column) -> Column:
            one = F.concat(F.get(p, at - 1), F.get(p, at))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(one), F.slice(p, at + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), at - 2), F.array(rank(F.concat(F.get(p, at - 2), one)), rank(F.concat(one, F.get(p, at + 1)))), F.slice(r, at + 2, F.size(r))).alias("r"),
            )

        least = F.array_min(r)
        return F.when(least.isNull(), acc).otherwise(F.get(F.transform(F.array(F.array_position(r, least).cast("int")), merged), F.lit(0)))

    folded = F.aggregate(F.sequence(F.lit(2), F.length(word)), F.get(start, F.lit(0)), step, lambda acc: F.transform(F.slice(acc["p"], F.lit(2), F.size(acc["p"]) - 2), rank))
    whole = rank(word)
    return F.when(whole.isNotNull(), F.array(whole)).when(F.length(word) > 1, folded).otherwise(F.array().cast("array<int>"))


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word by the rule of ``encode_word``: always the adjacent pair of lowest rank, leftmost first; bytes without a rank are null there and -1
    here. A heap holds the pairs there were, and those that a merge has changed are passed over."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    before, end = list(range(-1, n - 1)), list(range(1, n + 1))  # of the piece that begins at a place; pieces lie end to end
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not live[i] or j >= n or end[j] != stop:
            continue
        live[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks.get(word[i : end[i]], -1))
        i = end[i]
    return out


def decode_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of an array of ids."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def _folded(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``rows`` with word_ids and word_bytes, one element for each of ``words``, in their place."""
    # each literal is bound to a lambda variable, so that the plan holds it once
    ids = F.transform(F.array(rank_map(ranks)), lambda table: F.transform("words", lambda w: encode_word(w, table)))
    rows = rows.withColumn("word_ids", F.get(ids, F.lit(0))).drop("words")
    decoded = F.transform(F.array(piece_array(ranks)), lambda pieces: F.transform("word_ids", lambda x: decode_ids(x, pieces)))
    return rows.withColumn("word_bytes", F.get(decoded, F.lit(0)))


SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: The pattern that ``_cut`` follows; another one goes through the regular expression engine.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point, as the regular expression engine has it."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    for a, b in ((0, 0xD800), (0xE000, 0x110000)):
        chars = "".join(map(chr, range(a, b)))
        for kind, rule in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(rule, chars):
                out[a + m.start() : a + m.end()] = kind
    return out


def _cut(texts: list[str]) -> tuple[list[str], list[int]]:
    """The matches of KNOWN_PATTERN in all texts in order, and how many each text has, by runs of one class of characters.

    A run of letters, digits or others is a match, with a blank just before it. A run of white space before another run leaves its last
    character out, which is a match of its own unless it is a blank. An apostrophe alone, with no blank before it, takes
    the letters of a contraction from the run behind it."""
    if not texts:
        return [], []
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes()[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[ends] = END
    first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == END)])
    of, last = kind[first], np.r_[first[1:], len(kind)] - 1
    mark = np.zeros(len(kind) + 1, bool)
    blank = points == 32
    white = of == SPACE
    closed = of[np.minimum(np.arange(len(of)) + 1, len(of) - 1)] == END
    mark[first] = True
    mark[last[white & ~closed]] = True  # the last of a run of white space, by itself or with what follows
    joins = np.flatnonzero(white & ~closed & blank[last])
    mark[first[joins + 1]] = False
    alone = np.flatnonzero((of == OTHER) & (first == last) & (points[first] == 39))
    alone = alone[(of[np.minimum(alone + 1, len(of) - 1)] == LETTER) & (first[alone] > 0)]
    starts = mark[first[alone]]
    alone = alone[starts]
    if len(of) > 1 and of[0] == OTHER and first[0] == last[0] and points[0] == 39 and of[1] == LETTER:
        alone = np.r_[0, alone]
    padded = np.r_[points, np.zeros(3, points.dtype)]
    one, two = padded[first[alone] + 1], padded[first[alone] + 2]
    takes = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
    alone, takes = alone[takes > 0], takes[takes > 0]
    mark[first[alone] + 1] = False
    mark[first[alone] + 1 + takes] = True
    at = np.flatnonzero(mark[:-1])
    at = at[kind[at] != END]
    stop = np.r_[np.flatnonzero(mark[:-1]), len(kind)]
    stop = stop[np.searchsorted(stop, at, "right")]
    counts = np.diff(np.r_[0, np.searchsorted(at, ends)])
    return [joined[a:b] for a, b in zip(at.tolist(), stop.tolist())], counts.tolist()


def cutter(pattern: str):
    """A function from texts to (all their matches in order, the number of each text's)."""
    if pattern == KNOWN_PATTERN:
        return _cut
    import regex

    find = regex.compile(pattern).findall

    def cut(texts):
        found = [find(t) for t in texts]
        return [w for ws in found for w in ws], [len(ws) for ws in found]

    return cut


class _Positions(dict):
    """Words by position; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(x: np.ndarray) -> bytes:
    """32-bit values, byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of an Arrow list array of ids."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
    return np.diff(offsets), values[offsets[0] : offsets[-1]] if len(lists) else values[:0]


def units(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Rows (unit, bucket -1, doc_ids, known, ends, found, place) of units, and (unit, bucket, sizes, words) of the words that each asks for.

    ``found`` has the number of each match's word, frequent words first, ``place`` each word's place among the words in the order of
    buckets; ``words`` are the joined bytes of a bucket's words of ``sizes``."""
    names = ["unit", "bucket", "doc_ids", "known", "ends", "found", "place", "sizes", "words"]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        pack, cut = zstandard.ZstdCompressor(level=3), cutter(pattern)
        number = TaskContext.get().partitionId() << 32
        ids, counts, found, seen, chars = [], [], [], _Positions(), 0
        texts, held = [], 0

        def read():
            nonlocal texts, held
            if not texts:
                return
            words, many = cut(texts)
            found.append(np.fromiter(map(seen.__getitem__, words), "<u4", len(words)))
            counts.extend(many)
            texts, held = [], 0

        def rows():
            read()
            each = np.concatenate(found).astype(np.int64)
            by = np.argsort(-np.bincount(each, minlength=len(seen)), kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            words = list(seen)
            said = [words[i].encode("utf-8", "surrogatepass") for i in by.tolist()]
            bucket = np.fromiter((zlib.crc32(w) for w in said), np.int64, len(said)) % buckets
            # words of a bucket in their order, in which they compress best
            order = np.array(sorted(range(len(said)), key=said.__getitem__), np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            table = [[number, -1, np.asarray([i or 0 for i in ids], "<i8").tobytes(), bytes(i is not None for i in ids), np.cumsum([0, *counts]).astype("<i8").tobytes(), _packed(rank[each]), _packed(place), None, None]]
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                asked = [said[i] for i in part.tolist()]
                table.append([number, int(bucket[part[0]]), *[None] * 5, _packed(np.fromiter(map(len, asked), np.int64, len(asked))), pack.compress(b"".join(asked))])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*table), kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                chars += len(text)
                if held >= CUT_CHARS:
                    read()
                if len(ids) >= UNIT_ROWS or chars >= UNIT_CHARS:
                    yield from rows()
                    number += 1
                    ids, counts, found, seen, chars = [], [], [], _Positions(), 0
        if ids:
            yield from rows()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "unit long, bucket int, doc_ids binary, known binary, ends binary, found binary, place binary, sizes binary, words binary"
    )


def _gathered(asked: DataFrame) -> DataFrame:
    """One row per bucket: its units, the place of each unit's words among the bucket's distinct words, and those."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        now, units_, places, seen = None, [], [], _Positions()

        def row():
            # a long word leaves an empty one in its place
            words = [w.decode("latin-1") if len(w) <= LONG else "" for w in seen]
            long = [w for w in seen if len(w) > LONG]
            at = [i for i, w in enumerate(seen) if len(w) > LONG]
            cols = [([now], pa.int32()), ([units_], pa.list_(pa.int64())), ([places], pa.list_(pa.binary())), ([words], pa.list_(pa.string())), ([at], pa.list_(pa.int64())), ([long], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], ["bucket", "units", "places", "words", "long_at", "long"])

        for batch in batches:
            for bucket, unit, sizes, words in zip(*(batch.column(i) for i in range(4))):
                if bucket.as_py() != now:
                    if units_:
                        yield row()
                    now, units_, places, seen = bucket.as_py(), [], [], _Positions()
                units_.append(unit.as_py())
                joined, ends = unpack.decompress(words.as_py()), np.cumsum(_unpacked(sizes.as_py()).astype(np.int64)).tolist()
                words = [joined[a:b] for a, b in zip([0, *ends], ends)]
                places.append(_packed(np.fromiter(map(seen.__getitem__, words), "<u4", len(words))))
        if units_:
            yield row()

    dealt = asked.repartition("bucket").sortWithinPartitions("bucket", "unit").select("bucket", "unit", "sizes", "words")
    return dealt.mapInArrow(run, "bucket int, units array<long>, places array<binary>, words array<string>, long_at array<long>, long array<binary>")


def _answers(folded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(unit, bucket, lengths, ids, sizes, bytes): numbers of ids and of bytes of the words a unit asked for, in its order, and those joined."""
    held = folded.sparkSession.sparkContext.broadcast(ranks)
    names = ["unit", "bucket", "lengths", "ids", "sizes", "bytes"]

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        names_of = None
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                if names_of is None and len(batch.column("long_at")[i]):
                    names_of = {v: k for k, v in held.value.items()}
                lengths, flat = _flat(batch.column("word_ids")[i].values)
                offsets = np.cumsum(lengths) - lengths
                pieces = batch.column("word_bytes")[i].values.to_pylist()
                for at, word in zip(batch.column("long_at")[i].as_py(), batch.column("long")[i].as_py()):
                    merged = np.array(merged_long(word, held.value), np.int64).astype("<u4")
                    lengths[at], offsets[at] = len(merged), len(flat)
                    flat, pieces[at] = np.concatenate([flat, merged]), b"".join(names_of.get(x, b"") for x in merged.tolist())
                for unit, place in zip(batch.column("units")[i].as_py(), batch.column("places")[i].as_py()):
                    at = _unpacked(place).astype(np.int64)
                    n = lengths[at]
                    mine = [pieces[k] for k in at.tolist()]
                    ids = flat[_spans(offsets[at], n)]
                    row = [unit, bucket, _packed(n), _packed(ids), _packed(np.fromiter(map(len, mine), np.int64, len(mine))), pack.compress(b"".join(mine))]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64(), pa.int32(), *[pa.binary()] * 4])], names)

    return folded.mapInArrow(run, "unit long, bucket int, lengths binary, ids binary, sizes binary, bytes binary")


def _spans(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each of several spans, one after the other."""
    return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _by_document(docs: DataFrame, path: str | None, pattern: str | None, result, schema: str) -> DataFrame:
    """``result`` of lists of (doc_id, ids as a numpy array, decoded bytes), of at most TOGETHER documents."""
    pattern, ranks = pattern or default_pattern(), read_ranks(path or default_path())
    many, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.lit(0))).first()
    buckets = 1 << int(np.clip(max(many // BUCKET_DOCS, size // BUCKET_BYTES), LEAST_BUCKETS, MOST_BUCKETS) - 1).bit_length()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), many // (UNITS_A_PART * UNIT_ROWS), size // (UNITS_A_PART * UNIT_CHARS))
    table = staged_by(units(docs, pattern, buckets), "bpe-units", "unit", parts)
    asked = table.where("bucket >= 0").select("bucket", "unit", "sizes", "words")
    with short_plans(docs.sparkSession):
        answers = staged(_answers(_folded(_gathered(asked), ranks), ranks), "bpe-answers")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        doc_ids, known, ends, found, place = (left.column(c)[0].as_py() for c in ("doc_ids", "known", "ends", "found", "place"))
        doc_ids, ends, found, place = np.frombuffer(doc_ids, "<i8").tolist(), np.frombuffer(ends, "<i8").tolist(), _unpacked(found), _unpacked(place)
        said = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "lengths", "ids", "sizes", "bytes"))))
        none = [np.zeros(0, "<u4")]
        lengths, flat, sizes = (np.concatenate([_unpacked(r[i]) for r in said] or none) for i in (1, 2, 3))
        lengths, sizes = lengths.astype(np.int64)[place], sizes.astype(np.int64)
        stops = np.cumsum(sizes)
        joined = b"".join(unpack.decompress(r[4]) for r in said)
        decoded = [joined[a:b] for a, b in zip((stops - sizes)[place].tolist(), stops[place].tolist())]
        offsets = np.empty(len(place), np.int64)
        in_order = np.empty(len(place), np.int64)
        in_order[place] = lengths
        offsets[:] = (np.cumsum(in_order) - in_order)[place]
        del said, joined

        def documents():
            for doc_id, there, a, b in zip(doc_ids, known, ends, ends[1:]):
                words = found[a:b]
                yield doc_id if there else None, flat[_spans(offsets[words], lengths[words])], b"".join(map(decoded.__getitem__, words.tolist()))

        return pa.Table.from_batches([result(x) for x in batched(documents(), TOGETHER)])

    left = table.where("bucket < 0").select("unit", "doc_ids", "known", "ends", "found", "place")
    return left.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``."""

    def table(rows):
        ids, n, x, d = zip(*((i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(d).hexdigest()) for i, x, d in rows))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _by_document(docs, path, pattern, table, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded_sha256 for each row of ``docs``."""

    def table(rows):
        doc_ids, lists, digests_ = zip(*((i, x, hashlib.sha256(d).hexdigest()) for i, x, d in rows))
        ends = np.cumsum([0, *map(len, lists)])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.diff(ends), pa.int64()), ids, pa.array(digests_, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return _by_document(docs, path, pattern, table, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
