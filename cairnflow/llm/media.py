"""Media columns: payloads cut by content, stored once per chunk, rebuilt from ordered chunk lists and verified.

A payload is cut where a gear hash of its last ``REACH`` bytes has ``CUT_BITS`` zero bits, at least ``LEAST`` and at most
``MOST`` bytes after the last cut. A chunk is stored as a zstandard frame under the first 16 bytes of its SHA-256.
Equal payloads become one list of chunks; grouping by digest leaves one stored copy of each chunk, and lists and store are written to
the shared folder. Reading joins the written lists with the written store, puts the chunks in order, checks every chunk's digest and
length and the payload's digest, and computes the features from the bytes it read, once for each distinct payload; rows get
their payload's values by a join, which adaptive execution splits where many rows have one payload.

A digest that many payloads list is read in parts: its references are dealt over salts, of which there is one more for
each ``REFERENCES`` references, and its stored copy is sent to each salt.

The stored form of a payload (its medium) is a header, the list (digest and length of each chunk) and the frames. Frames need a dictionary,
which is part of the store under its own digest, and which the header names. It is trained on a bounded sample: distinct texts of at most
``SAMPLE_LONGEST`` bytes whose hash falls below a bound, about ``SAMPLE_ROWS`` of them, in the order of their hash.

Defined results: null text is an empty payload, which is padded like any other; equal texts have equal values; payloads of any length
are cut whole; an empty table stores nothing. A payload that fails a check stops the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import staged_by
from .common import staged, utf8

UNIT = 192
PAD = b"\x20"
TAIL = 16
LEAST, MOST, CUT_BITS = 1024, 16384, 12
REACH = 32
ZSTD_LEVEL = 9
REFERENCES = 256
#: Bytes up to which the table of often listed digests is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
MAGIC = b"CDC2"
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_LONGEST, DICTIONARY_BYTES = 1000, 4 << 20, 16384, 32768

_GEAR = np.random.Generator(np.random.PCG64(20260101)).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    """The text's bytes, padded to a positive multiple of UNIT."""
    data = utf8(text)
    return data + PAD * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h = 2h + gear[byte] mod 2**32 at each position: bytes more than 32 back shift out, so doubling gives it without a loop."""
    h = _GEAR[data]
    for n in (1, 2, 4, 8, 16):
        out = h.copy()
        out[n:] += h[:-n] << np.uint32(n) if len(h) > n else 0
        h = out
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of a payload's chunks."""
    h = gear_hash(np.frombuffer(data, np.uint8))
    marks = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, at, i = [], 0, 0
    while at < len(data):
        while i < len(marks) and marks[i] < at + LEAST:
            i += 1
        end = marks[i] if i < len(marks) and marks[i] <= at + MOST else at + MOST
        at = min(end, len(data))
        ends.append(at)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def features(payload: bytes) -> str:
    """Level, spread, zero crossings around the middle of the range, and the shares of eight bands of sample values, per mille."""
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(centred))))
    bands = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"mean={x.mean():.4f};std={x.std():.4f};zcr={crossings};bands={'/'.join(map(str, bands))}"


def trained(docs: DataFrame) -> bytes:
    """The dictionary of the store; empty where there is too little text to train one."""
    import zstandard

    texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''").withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    bound = (SAMPLE_ROWS << 40) // max(1, docs.count())
    rows = texts.where((F.col("h") < bound) & (F.octet_length("text") <= SAMPLE_LONGEST)).groupBy("h").agg(F.min("text").alias("text")).toArrow().sort_by("h")
    pieces, size = [], 0
    for text in rows.column("text"):
        data = utf8(text.as_py())
        if size + len(data) <= SAMPLE_BYTES:
            pieces += [data[i : i + 1024] for i in range(0, len(data), 1024)]
            size += len(data)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def chunked(docs: DataFrame, dictionary: bytes | None) -> DataFrame:
    """One row per chunk of each distinct payload of a task: key (the payload's digest), seq, chunk, n, and the frame unless the dictionary is None."""

    def run(batches):
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=ZSTD_LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary or b"")), set()
        rows, size = [], 0
        names = ["key", "seq", "chunk", "n", "frame"]
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
        for batch in batches:
            for text in batch.column(0):
                payload = payload_of(text.as_py())
                key = digest(payload)
                if key in seen:
                    continue
                seen.add(key)
                at = 0
                for seq, end in enumerate(cuts(payload)):
                    part = payload[at:end]
                    rows.append((key, seq, digest(part), len(part), None if dictionary is None else pack.compress(part)))
                    size += len(part)
                    at = end
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.selectExpr("cast(text as string) text").mapInArrow(run, "key binary, seq int, chunk binary, n int, frame binary")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the key of its payload for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(utf8(t)) for t in texts], pa.int64()), pa.array([digest(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "key"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_bytes long, key binary")


def medium(key: bytes, parts: list[tuple], dictionary: bytes) -> bytes:
    """The stored form of a payload: header (magic, length, number of chunks, digest of the dictionary), list, frames of (seq, chunk, n, frame)."""
    head = MAGIC + struct.pack("<QI", sum(n for _, _, n, _ in parts), len(parts)) + digest(dictionary)
    return head + b"".join(c + struct.pack("<II", n, len(f)) for _, c, n, f in parts) + b"".join(f for *_, f in parts)


def decoded(media: bytes, dictionary: bytes) -> bytes:
    """The payload of a medium and the dictionary that it names."""
    import zstandard

    length, many = struct.unpack("<QI", media[4:16])
    if media[:4] != MAGIC or media[16:32] != digest(dictionary):
        raise ValueError("not a medium of this dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    at, out = 32 + 24 * many, []
    for i in range(many):
        n, size = struct.unpack("<II", media[48 + 24 * i : 56 + 24 * i])
        out.append(unpack.decompress(media[at : at + size], max_output_size=n))
        at += size
    if sum(map(len, out)) != length:
        raise ValueError("a medium of another length")
    return b"".join(out)


def rebuilt(lists: DataFrame, dictionary: bytes) -> DataFrame:
    """One row for each payload (key): what the bytes read from the chunks ``lists`` (key, seq, chunk, n, frame) give."""
    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        out = []

        def done(key, parts):
            data = []
            for seq, (at, chunk, n, frame) in enumerate(parts):
                raw = unpack.decompress(frame, max_output_size=n)
                if at != seq or len(raw) != n or digest(raw) != chunk:
                    raise ValueError(f"chunk {seq} of payload {key.hex()} does not match its list")
                data.append(raw)
            payload = b"".join(data)
            if digest(payload) != key:
                raise ValueError(f"payload {key.hex()} does not match its digest")
            media = medium(key, parts, dictionary)
            return key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), features(payload), len(parts)

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        key, parts = None, []
        for batch in batches:
            for row in zip(*batch.columns):
                k, *part = (x.as_py() for x in row)
                if k != key:
                    if parts:
                        out.append(done(key, parts))
                    key, parts = k, []
                parts.append(tuple(part))
                if len(out) >= 1000:
                    yield table()
                    out = []
        if parts:
            out.append(done(key, parts))
        if out:
            yield table()

    schema = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    return lists.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, schema)


def stored(docs: DataFrame) -> tuple[DataFrame, DataFrame, bytes]:
    """(lists, store, digest of the dictionary), written: lists (key, seq, chunk, n) of the distinct payloads, store (chunk, frame) of the distinct
    chunks and the dictionary."""
    dictionary = trained(docs)
    lists = staged(chunked(docs, None).select("key", "seq", "chunk", "n").dropDuplicates(["key", "seq"]), "chunk-lists")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (lists.agg(F.sum("n")).first()[0] or 0) >> 28)
    own = docs.sparkSession.createDataFrame([(digest(dictionary), dictionary)], "chunk binary, frame binary")
    frames = chunked(docs, dictionary).select("chunk", "frame").unionByName(own)
    # frames are dealt once, to the buckets that they are written in
    store = staged_by(frames, "chunk-store", "chunk", parts, lambda dealt: dealt.groupBy("chunk").agg(F.first("frame").alias("frame")))
    return lists, store, digest(dictionary)


def stored_and_read(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and, from the bytes read back, payload, medium and feature values for each row of ``docs``."""
    lists, store, named = stored(docs)
    dictionary = bytes(store.where(F.col("chunk") == F.lit(named)).select("frame").first()[0])
    hot = staged(lists.groupBy("chunk").agg(F.count(F.lit(1)).alias("refs")).where(F.col("refs") > REFERENCES).select(F.col("chunk").alias("h_chunk"), (F.col("refs") / REFERENCES).cast("int").alias("salts")), "hot-chunks")
    few = F.broadcast(hot) if hot.count() * 40 <= BROADCAST_BYTES else hot
    lists = lists.join(few, F.col("chunk") == F.col("h_chunk"), "left").drop("h_chunk")
    store = store.select(F.col("chunk").alias("s_chunk"), "frame")
    cold = lists.where(F.col("salts").isNull()).join(store.hint("merge"), F.col("chunk") == F.col("s_chunk"))
    copies = store.join(few, F.col("s_chunk") == F.col("h_chunk")).select("s_chunk", "frame", F.explode(F.sequence(F.lit(0), "salts")).alias("s_salt"))
    dealt = lists.where(F.col("salts").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("key", "seq"), F.col("salts") + 1).cast("int"))
    warm = dealt.join(copies, (F.col("chunk") == F.col("s_chunk")) & (F.col("salt") == F.col("s_salt")))
    names = ["key", "seq", "chunk", "n", "frame"]
    read = staged(rebuilt(cold.select(*names).unionByName(warm.select(*names)), dictionary).withColumnRenamed("key", "r_key"), "payloads")
    return keyed(docs).join(read, F.col("key") == F.col("r_key")).drop("key", "r_key")
