"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last ``WINDOW`` bytes ends a chunk wherever it is a multiple of the block size; each chunk gives
one of 64 characters by its CRC-32. The block size is the smallest power of two (from 4) at which a text has at most 64
chunks; a fingerprint is ``block:signature:signature at twice the block``. Two fingerprints are compared at the block
sizes that they have in common by Levenshtein distance over the longer length; 0 where they have none.

The next document (in the order of doc_id, then text; null ids last, by a hash of their text and the text) comes without a global sort:
ids are dealt into blocks of about ``BLOCK`` rows at quantiles of the ids there are, however far apart they lie, null ids by their text into as many as they
need; there are at most ``MOST_BLOCKS`` of either. A block's rows are sorted where they lie, and the first row of each block is also sent to
the block before it.

Defined results: a null or empty text has the fingerprint ``4::`` and is like another empty text 1, like any other
text 0; a table of one row is its own next document; equal texts have equal fingerprints; any length is read whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import staged, utf8

WINDOW = 7
SMALLEST = 4
SIGNATURE = 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Rows in a block, of which there may be more where blocks would be more than MOST_BLOCKS.
BLOCK, MOST_BLOCKS = 1024, 1 << 16
#: Where the blocks of null ids begin.
NULLS = 2**62
#: Rows whose fingerprints are compared together.
TOGETHER = 1024

_MULTIPLIER = np.uint32(0x9E3779B1)
_TABLE = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15) >> np.uint64(24)).astype(np.uint32)


def _rolling(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the last WINDOW bytes at each position, as uint32."""
    m = _MULTIPLIER
    h = _TABLE[data]

    def later(x, n):
        out = x.copy()
        with np.errstate(over="ignore"):
            out[n:] += x[:-n] * m**np.uint32(n) if len(x) > n else 0
        return out

    with np.errstate(over="ignore"):
        two = later(h, 1)
        four = two.copy()
        four[2:] += two[:-2] * (m * m)
        seven = four.copy()
        m4 = m * m * m * m
        seven[4:] += two[:-4] * m4
        seven[6:] += h[:-6] * (m4 * m * m)
        seven ^= seven >> np.uint32(15)
        seven *= np.uint32(0x2C1B3C6D)
        seven ^= seven >> np.uint32(13)
    return seven


def _signature(data: bytes, ends: list[int]) -> str:
    codes = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends], [*ends, len(data)]) if a < b]
    folded = np.asarray(codes, np.uint32)
    return ALPHABET[(folded ^ (folded >> np.uint32(13)) ^ (folded >> np.uint32(23))) & 63].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's bytes."""
    if not data:
        return f"{SMALLEST}::"
    h = _rolling(np.frombuffer(data, np.uint8))
    at = np.flatnonzero((h & np.uint32(SMALLEST - 1)) == 0)
    low = h[at]
    low = np.where(low == 0, np.uint32(1 << 31), low & (~low + np.uint32(1)))
    # the largest block size at which each position ends a chunk, in descending order
    block = SMALLEST
    if len(at) >= SIGNATURE:
        top = np.partition(low, len(low) - SIGNATURE)[len(low) - SIGNATURE]
        block = max(SMALLEST, int(top) * 2)
    one, two = at[low >= block] + 1, at[low >= 2 * block] + 1
    return f"{block}:{_signature(data, one.tolist())}:{_signature(data, two.tolist())}"


def _myers(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Levenshtein distances of rows of codes (padded with 255) by bit-parallel columns; a has at most 64 codes."""
    n = len(a)
    match = np.zeros((n, 256), np.uint64)
    rows = np.arange(n)
    one = np.uint64(1)
    for i in range(a.shape[1]):
        live = i < la
        match[rows[live], a[live, i]] |= one << np.uint64(i)
    pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = la.astype(np.int64)
    last = one << (np.maximum(la, 1) - 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(b.shape[1]):
            live = (j < lb) & (la > 0)
            eq = match[rows, b[:, j]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += np.where(live & ((ph & last) != 0), 1, 0) - np.where(live & ((mh & last) != 0), 1, 0)
            ph, mh = (ph << one) | one, mh << one
            pv, mv = np.where(live, mh | ~(xv | ph), pv), np.where(live, ph & xv, mv)
    return np.where(la == 0, lb, score)


def _codes(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray([len(s) for s in signatures])
    width = max(1, int(lengths.max(initial=0)))
    joined = "".join(s.ljust(width, "\x7f") for s in signatures).encode("latin-1")
    return np.frombuffer(joined, np.uint8).reshape(len(signatures), width), lengths


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """The likeness (0 to 1) of fingerprints, pair by pair: the best at the block sizes that both have."""
    out = np.zeros(len(left))
    x, y, where = [], [], []
    for i, (a, b) in enumerate(zip(left, right)):
        if a == b:
            out[i] = 1.0
            continue
        (ka, a1, a2), (kb, b1, b2) = a.split(":"), b.split(":")
        ka, kb = int(ka), int(kb)
        for s, t in ([(a1, b1), (a2, b2)] if ka == kb else [(a2, b1)] if 2 * ka == kb else [(a1, b2)] if ka == 2 * kb else []):
            if s and t:
                x.append(s)
                y.append(t)
                where.append(i)
    if x:
        (a, la), (b, lb) = _codes(x), _codes(y)
        np.maximum.at(out, where, 1.0 - _myers(a, la, b, lb) / np.maximum(la, lb))
    return out


def edited(text: str, following: str) -> str:
    """The text whose last half of code points is replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``."""
    bare = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    there, nulls = bare.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    many = lambda n: min(MOST_BLOCKS, max(1, -(-n // BLOCK)))
    shares = [i / many(there) for i in range(1, many(there))]
    bounds = bare.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", shares, 1 / (4 * many(there))) if shares else []
    cuts = np.unique(np.array(bounds, np.int64))  # of equal ids all are in one block

    @F.pandas_udf("long")
    def block(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int64)
        out[known] = np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64), "right")
        return pd.Series(out)

    of_null = F.lit(NULLS) + F.pmod(F.xxhash64("text"), F.lit(many(nulls)))
    rows = bare.withColumn("block", F.when(F.col("doc_id").isNull(), of_null).otherwise(block(F.col("doc_id"))))
    firsts = rows.groupBy("block").agg(F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("first_id"))  # at most twice MOST_BLOCKS rows
    order = W.orderBy("block")
    last = F.max("block").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    firsts = staged(firsts.select(F.col("block").alias("first_block"), "first_id", F.coalesce(F.lag("block").over(order), last).alias("into")), "first-of-block")
    keyed = rows.join(F.broadcast(firsts), F.col("block") == F.col("first_block"), "left")
    leads = F.col("first_id") == F.coalesce("doc_id", F.lit(2**63 - 1))
    sent = F.when(leads, F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("lead")), F.struct(F.col("into").alias("b"), F.lit(True).alias("lead")))).otherwise(
        F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("lead")))
    )
    dealt = keyed.select("doc_id", "text", F.inline(sent)).repartition("b").sortWithinPartitions("b", "lead", F.col("doc_id").asc_nulls_last(), "text")

    def run(batches):
        held: list[tuple] = []
        before = None  # (block, doc_id, text, fingerprint) of the row that waits for its next
        last_block = None

        def flush():
            a, f, g, e = [x[0] for x in held], [x[1] for x in held], [x[2] for x in held], [x[3] for x in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in a], pa.int64()), pa.array([x[1] for x in a], pa.int64()), pa.array([x[2] for x in a], pa.string()), pa.array(f, pa.string()), pa.array(e, pa.string()), pa.array(likeness(f, e)), pa.array(likeness(f, g))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for doc_id, text, block, lead in zip(*(batch.column(i) for i in range(4))):
                doc_id, text, block, lead = doc_id.as_py(), text.as_py(), block.as_py(), lead.as_py()
                if before is None and lead:
                    continue  # a further row of the next block's first id
                print_ = fingerprint(utf8(text))
                if before is not None:
                    _, i, t, f = before
                    new = utf8(edited(t, text))
                    held.append(((i, len(t), hashlib.sha256(new).hexdigest()), f, print_, fingerprint(new)))
                before = None if lead else (block, doc_id, text, print_)
                if len(held) >= TOGETHER:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
