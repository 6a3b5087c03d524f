"""Language-model scores from n-gram counts of the whole training corpus in Elias-Fano tries.

Words (A-Z lower-cased) and an end token follow a start context in every text. The probability of a token is
    p(w | c) = (1 - MU) p1(w) + MU (max(n(c, w) - DISCOUNT, 0) / n(c) + DISCOUNT t(c) / n(c) * p1(w))
with t(c) the distinct successors of c, p1(w) where c is unseen, and p1 the absolutely discounted word frequency; all
unknown words share one class, which gets what discounting frees.

Texts are cut into units of about ``UNIT_BYTES``, written once to the shared folder. A unit asks for its distinct words
and word pairs, sorted by hash, with their training counts; requests meet in buckets by the top bits of the (context) hash. A
bucket builds its trie from the counts of all units: contexts, monotone pointers to their successors, successors as one
Elias-Fano sequence, 8-bit probabilities and back-off weights, in a file that is mapped into memory. It answers each
unit's requests in their order by context-relative successor search, one byte each, and a unit scores its texts with
the answers. The number of buckets follows the input; words are 64-bit hashes that mix their bytes (see ``shingles``).

A frequent context (by the counts of its word, at least ``HOT`` of all tokens or an eighth of a bucket's share) has more successors than a
bucket should hold. It stands for ``SPLIT`` contexts, each with the successors of some bits of their hash, that lie in buckets of their own; a
bucket's probabilities are relative to such a part, and the parts' totals (a bounded table) lead back to the whole. So no bucket gets more
than a small share of the pairs.

Defined results: a null or empty text is one end token; without training texts every score is 0 and base_score too; rows that
repeat count and are scored each; a null doc_id has the crc32 of the empty text. Texts are whole; one longer than a unit is its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import split_batch, staged, utf8
from .eliasfano import LEVELS, Trie
from .shingles import LOWER, grouped, mix, word_hashes

UNIT_BYTES = 4 << 20
UNIT_DOCS = 4096
FOLD, HELD = 5, 1
DISCOUNT, WORD_DISCOUNT, MU = 0.75, 0.5, 0.2
LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 17
#: Share of the tokens from which a context is split, and into how many; at most SPLIT / HOT parts in all.
HOT, SPLIT = 1 / 4096, 64
_U = np.uint64
END, START = mix(np.array([0xE0D], _U))[0], mix(np.array([0x57A], _U))[0]


def units(docs: DataFrame) -> DataFrame:
    """unit, ids (8 bytes each), held (1 byte each: not in training), known (id is not null), texts (zstandard of length-prefixed UTF-8)."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row():
            held = bytes(zlib.crc32(b"" if i is None else str(i).encode()) % FOLD == HELD for i in ids)
            lengths = np.fromiter(map(len, texts), "<i8", len(texts)).tobytes()
            cols = [number, np.asarray([i or 0 for i in ids], "<i8").tobytes(), held, bytes(i is not None for i in ids), lengths, pack.compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int64() if k == "unit" else pa.binary()) for k, c in zip(names, cols)], names)

        names = ["unit", "ids", "held", "known", "lengths", "texts"]
        for big in batches:
            for batch in split_batch(big):
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids.append(i)
                    texts.append(utf8(text))
                    size += len(texts[-1])
                    if size >= UNIT_BYTES or len(ids) >= UNIT_DOCS:
                        yield row()
                        number += 1
                        ids, texts, size = [], [], 0
        if ids:
            yield row()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "unit long, ids binary, held binary, known binary, lengths binary, texts binary")


def _texts(lengths: bytes, packed: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(np.frombuffer(lengths, "<i8")).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def parts_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The part of a split context that a successor lies in."""
    with np.errstate(over="ignore"):
        return mix(context + ((word >> _U(64 - (SPLIT.bit_length() - 1))) + _U(1)) * _U(0x9E3779B97F4A7C15))


def frequent_contexts(table: DataFrame, buckets: int) -> np.ndarray:
    """The sorted hashes of the contexts that are split: words (and the start) of at least HOT of all tokens or an eighth of a bucket's share. A unit tells the
    counts of those that make half as much of it, so what it leaves out of a context that is split elsewhere does not matter for the split."""
    share = max(HOT, 1 / (8 * buckets))

    def run(batches):
        from collections import Counter

        for batch in batches:
            for lengths, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bodies = _texts(lengths, texts)
                seen: Counter[bytes] = Counter()
                for body in bodies:
                    seen.update(body.translate(LOWER).split())
                n = seen.total() + len(bodies)
                often = [(w, k) for w, k in seen.items() if k >= share * n / 2]
                hashes, _ = word_hashes([b" ".join(w for w, _ in often)])
                keys = np.r_[_U(0), START, hashes].view(np.int64)  # 0: all tokens
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([n, len(bodies), *(k for _, k in often)], pa.int64())], ["context", "n"])

    found = table.select("lengths", "texts").mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    total = found.where("context = 0").select("n").first()
    hot = found.where("context <> 0").where(F.col("n") >= share * (total[0] if total else 0)).select("context").toArrow()  # 2 / share at most
    return np.sort(np.array(hot.column(0).to_pylist(), np.int64).view(_U))


class Tokens:
    """The tokens of a unit's texts: word and context hashes in order, the text of each; and its distinct words and pairs in order. ``hot``: the
    contexts that are split, sorted."""

    def __init__(self, texts: list[bytes], held: bytes, hot: np.ndarray = np.zeros(0, _U)):
        parts = [word_hashes(texts[a:b]) for a, b in grouped(texts)]
        counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
        words = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, _U)
        self.n = counts + 1
        ends = np.cumsum(self.n) - 1
        self.word = np.insert(words, np.cumsum(counts), END) if len(counts) else words
        self.context = np.r_[START, self.word[:-1]][: len(self.word)]
        self.context[np.r_[0, ends[:-1] + 1][: len(counts)]] = START
        if len(hot) and len(self.context):
            split = hot[np.minimum(np.searchsorted(hot, self.context), len(hot) - 1)] == self.context
            self.context[split] = parts_of(self.context[split], self.word[split])
        self.text = np.repeat(np.arange(len(counts)), self.n)
        train = (np.frombuffer(held, np.uint8) == 0)[self.text]
        self.words, self.word_at = np.unique(self.word, return_inverse=True)
        self.word_train = np.bincount(self.word_at[train], minlength=len(self.words))
        # pairs in the order of (context, successor); contexts are ranked by the words, START beside them
        contexts, context_at = np.unique(self.context, return_inverse=True)
        pair = context_at.astype(_U) << _U(32) | self.word_at.astype(_U)
        pairs, self.pair_at = np.unique(pair, return_inverse=True)
        self.pair_context = contexts[(pairs >> _U(32)).astype(np.int64)]
        self.pair_word = self.words[(pairs & _U(0xFFFFFFFF)).astype(np.int64)]
        self.pair_train = np.bincount(self.pair_at[train], minlength=len(pairs))


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted 64-bit keys pass from bucket to bucket (a power of two of them, by the top bits)."""
    shift = 64 - (buckets.bit_length() - 1)
    return np.searchsorted(keys >> _U(shift) if shift < 64 else np.zeros(len(keys), _U), np.arange(buckets + 1))


def requests(table: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, unit, words, word_train, contexts, runs, successors, pair_train) for each bucket that a unit asks."""
    names = ["bucket", "unit", "words", "word_train", "contexts", "runs", "successors", "pair_train"]

    def run(batches):
        for batch in batches:
            for unit, held, lengths, texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                t = Tokens(_texts(lengths, texts), held, hot)
                by_word, by_pair = _cuts(t.words, buckets), _cuts(t.pair_context, buckets)
                rows = []
                for k in np.flatnonzero((np.diff(by_word) > 0) | (np.diff(by_pair) > 0)).tolist():
                    a, b, c, d = by_word[k], by_word[k + 1], by_pair[k], by_pair[k + 1]
                    contexts, runs = np.unique(t.pair_context[c:d], return_counts=True)
                    rows.append((k, unit, t.words[a:b].tobytes(), _packed(t.word_train[a:b].astype("<u4")), contexts.tobytes(), _packed(runs.astype("<u4")), t.pair_word[c:d].tobytes(), _packed(t.pair_train[c:d].astype("<u4"))))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i == 1 else pa.int32() if not i else pa.binary()) for i, x in enumerate(zip(*rows))], names)

    return table.select("unit", "held", "lengths", "texts").mapInArrow(run, "bucket int, unit long, words binary, word_train binary, contexts binary, runs binary, successors binary, pair_train binary")


def answers(asked: DataFrame, parts: np.ndarray) -> DataFrame:
    """(unit, bucket, counts, codes, weights): counts of the words, codes of the pairs and weights of their contexts, in the
    order of the request. Rows of unit -1 hold the bucket's training tokens and distinct training words as counts, and as codes the place (among all
    ``parts`` of split contexts, sorted), tokens and distinct successors of each part that it has."""
    held_parts = asked.sparkSession.sparkContext.broadcast(parts)
    names = ["unit", "bucket", "counts", "codes", "weights"]

    def answer(bucket, held):
        words = [np.frombuffer(r[1], "<u8") for r in held]
        train = [_unpacked(r[2], "<u4").astype(np.int64) for r in held]
        every, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, np.concatenate(train), minlength=len(every)).astype("<i8")
        counts = np.split(total[at], np.cumsum([len(w) for w in words])[:-1])
        contexts = [np.repeat(np.frombuffer(r[3], "<u8"), _unpacked(r[4], "<u4")) for r in held]
        followers = [np.frombuffer(r[5], "<u8") for r in held]
        n = [_unpacked(r[6], "<u4").astype(np.int64) for r in held]
        c, w, k = np.concatenate(contexts), np.concatenate(followers), np.concatenate(n)
        live = np.flatnonzero(k > 0)
        live = live[np.lexsort((w[live], c[live]))]
        tc, tw, tk = c[live], w[live], k[live]
        first = np.flatnonzero(np.r_[True, (tc[1:] != tc[:-1]) | (tw[1:] != tw[:-1])][: len(tc)])
        trie = Trie.mapped(tc[first], tw[first], np.add.reduceat(tk, first) if len(first) else tk, discount=DISCOUNT)
        for r, number, x, y in zip(held, counts, contexts, followers):
            codes, weights = trie.query(x, y)
            starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
            yield r[0], bucket, _packed(number), _packed(codes), _packed(weights[starts])
        own, starts = np.unique(tc[first], return_index=True) if len(first) else (np.zeros(0, _U), first)
        place = np.minimum(np.searchsorted(held_parts.value, own), max(0, len(held_parts.value) - 1))
        mine = held_parts.value[place] == own if len(held_parts.value) else np.zeros(len(own), bool)
        kinds = np.diff(np.r_[starts, len(first)])
        tokens = np.add.reduceat(np.add.reduceat(tk, first), starts) if len(starts) else kinds
        told = np.stack([place[mine], tokens[mine], kinds[mine]]).astype("<i8")
        yield -1, bucket, np.asarray([total.sum(), np.count_nonzero(total)], "<i8").tobytes(), _packed(told), b""

    def run(batches):
        now, held = None, []

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if not i else pa.int32() if i == 1 else pa.binary()) for i, x in enumerate(zip(*rows))], names)

        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column(0)[i].as_py()
                if bucket != now and held:
                    yield table(answer(now, held))
                    held = []
                now = bucket
                held.append(tuple(batch.column(j)[i].as_py() for j in range(1, 8)))
        if held:
            yield table(answer(now, held))

    dealt = asked.repartition("bucket").sortWithinPartitions("bucket", "unit")
    return dealt.mapInArrow(run, "unit long, bucket int, counts binary, codes binary, weights binary")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    table = staged(units(docs), "lm-units")
    buckets = 1 << int(np.clip(table.select("unit").count(), LEAST_BUCKETS, MOST_BUCKETS) - 1).bit_length()
    hot = frequent_contexts(table, buckets)
    every = np.arange(SPLIT, dtype=_U) << _U(64 - (SPLIT.bit_length() - 1))
    parts = parts_of(np.repeat(hot, SPLIT), np.tile(every, len(hot)))
    by_hash = np.argsort(parts)
    replies = staged(answers(requests(table, buckets, hot), parts[by_hash]), "lm-answers")
    told = replies.where("unit = -1").select("counts", "codes").toArrow()  # one row a bucket
    totals = told.column(0).to_pylist()
    # tokens and distinct successors of each part, then of its context
    sums = np.zeros((2, len(parts)), np.int64)
    for x in told.column(1).to_pylist():
        place, *of = _unpacked(x, "<i8").reshape(3, -1)
        sums[:, by_hash[place]] += np.stack(of)
    whole = sums.reshape(2, len(hot), SPLIT).sum(2).repeat(SPLIT, axis=1)
    # what leads from a part's share to that of its context, and the context's back-off weight
    scale = np.stack([sums[0] / np.maximum(whole[0], 1), np.where(whole[0] > 0, DISCOUNT * whole[1] / np.maximum(whole[0], 1), 0.0)])[:, by_hash]
    lead = docs.sparkSession.sparkContext.broadcast((parts[by_hash], scale))
    n, v = (int(x) for x in np.sum([np.frombuffer(x, "<i8") for x in totals], axis=0)) if totals else (0, 0)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def score(row, replies):
        ids, held, known, lengths, texts = row
        t = Tokens(_texts(lengths, texts), held, hot)
        count = np.concatenate([_unpacked(r[0], "<i8") for r in replies])
        code, weight = (np.concatenate([_unpacked(r[j], np.uint8) for r in replies]) for j in (1, 2))
        starts = np.flatnonzero(np.r_[True, t.pair_context[1:] != t.pair_context[:-1]][: len(t.pair_context)])
        weight = np.repeat(weight, np.diff(np.r_[starts, len(t.pair_context)]))
        many = len(t.n)
        if n:
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[t.word_at]
            p1 = np.where(count > 0, (count - WORD_DISCOUNT) / n, WORD_DISCOUNT * v / n)[t.word_at]
            pair, back = LEVELS[code], LEVELS[weight]
            known_parts, scale = lead.value
            if len(known_parts) and len(t.pair_context):
                place = np.minimum(np.searchsorted(known_parts, t.pair_context), len(known_parts) - 1)
                split = known_parts[place] == t.pair_context
                pair, back = np.where(split, pair * scale[0][place], pair), np.where(split, scale[1][place], back)
            pair, back = pair[t.pair_at], back[t.pair_at]
            p = np.where(back > 0, (1 - MU) * p1 + MU * (pair + back * p1), p1)
            sums = [np.bincount(t.text, x, minlength=many) for x in (base, np.log10(p))]
        else:
            sums = [np.zeros(many)] * 2
        seen = np.bincount(t.text, count[t.word_at] > 0, minlength=many).astype(np.int64)
        there = np.frombuffer(known, np.uint8) == 1
        cols = [pa.array(np.frombuffer(ids, "<i8"), mask=~there), pa.array(np.frombuffer(held, np.uint8) == 1), t.n, seen, np.full(many, n), *sums]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(cols, kinds)], names)

    def run(batches):
        now, row, held = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                unit, bucket = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if unit != now and row:
                    yield score(row, held)
                    row, held = None, []
                now = unit
                if bucket < 0:
                    row = tuple(batch.column(j)[i].as_py() for j in range(2, 7))
                else:
                    held.append(tuple(batch.column(j)[i].as_py() for j in range(7, 10)))
        if row:
            yield score(row, held)

    none = F.lit(None).cast("binary")
    left = table.select("unit", F.lit(-1).alias("bucket"), "ids", "held", "known", "lengths", "texts", none.alias("counts"), none.alias("codes"), none.alias("weights"))
    right = replies.where("unit >= 0").select("unit", "bucket", *[none.alias(c) for c in ("ids", "held", "known", "lengths", "texts")], "counts", "codes", "weights")
    both = left.unionByName(right).repartition("unit").sortWithinPartitions("unit", "bucket")
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
