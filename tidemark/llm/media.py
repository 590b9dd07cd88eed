"""Media payloads as content-defined chunks, stored once and put together again.

A document's payload is wrapped as an 8-bit mono WAV file, which is the media. The media is cut where a rolling gear hash has its
top bits zero, so equal stretches of different media are cut alike. Chunk digests are counted over all media by Spark; a digest
that several media have is owned by one of them and borrowed by the others. The chunk store has, per media, the ordered list of all its
digests and the bytes of the chunks that it owns. Reading back, media without borrowed chunks are put together from their own row, the others
by a join of the borrowed digests with the owners' rows; the digest of every chunk and of the whole media is verified, and features are
computed from the samples that were read.

Equal media are stored and read once, and their features meet the documents by the media's digest.

Nulls and edges: a null text is an empty one; an empty text still has one padded unit; an empty table gives no rows; repeated rows share one
media. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shelf

UNIT, PAD, RATE = 576, b"\xff", 8000
LEAST, MOST, CUT_BITS = 1024, 16384, 12
#: What a broadcast of the borrowed digests may hold; beyond, the documents are joined with them by a shuffle.
BROADCAST_BYTES = 32 << 20
_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)
BLOCK = 1 << 20


def payload_of(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_media(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_media(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks: a gear hash of the 32 bytes before has its top bits zero, or the chunk is as long as may be."""
    data, marks = np.frombuffer(media, np.uint8), []
    for at in range(0, len(data), BLOCK):
        lead = min(at, 31)
        h = _GEAR[data[at - lead:at + BLOCK]]
        for step in (1, 2, 4, 8, 16):  # the sum over 32 bytes, each shifted by its age, by doubling
            h[step:] += h[:-step] << np.uint32(step)
        marks.append(np.flatnonzero(h[lead:] >> np.uint32(32 - CUT_BITS) == 0) + at + 1)
    ends, start = [], 0
    for mark in np.concatenate(marks).tolist() + [len(data)]:
        while mark - start > MOST:
            start += MOST
            ends.append(start)
        if mark - start >= LEAST or mark == len(data) and mark > start:
            start = mark
            ends.append(start)
    return ends


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def feature(payload: bytes) -> str:
    """Mean, deviation, sign changes about the middle and entropy of the samples, as fixed decimals."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    mean = float(n @ np.arange(256) / len(x))
    deviation = float(np.sqrt(max(0.0, n @ (np.arange(256.0) - mean) ** 2 / len(x))))
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"{mean:.4f},{deviation:.4f},{turns},{float(-(p * np.log2(p)).sum()):.4f}"


MEASURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, feature string"


def measured(media: bytes, name: bytes) -> tuple:
    if digest(media) != name:
        raise ValueError("stored media differs from what was written")
    payload = from_media(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), feature(payload)


def _text_key(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def index(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_bytes, media digest and ordered chunk digests."""
    kind = dict(docs.dtypes)["doc_id"]

    def read(batches):
        for batch in batches:
            rows = []
            for text in batch.column(2):
                raw = text.as_py()
                media = to_media(payload_of(raw))
                rows.append((len(raw or b""), digest(media), [digest(c) for c in chunks(media)]))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.binary()))],
                names=["doc_id", "text_key", "n_bytes", "media", "digests"])

    return docs.select("doc_id", _text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary")).mapInArrow(
        read, f"doc_id {kind}, text_key binary, n_bytes bigint, media binary, digests array<binary>")


def store(docs: DataFrame, indexed: DataFrame, shelf: Shelf, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The chunk store. Per media: its digests in order, for each the chunk's bytes or null where another media owns them, and
    the digests of those that it lends."""
    once = indexed.groupBy("media").agg(F.first("digests").alias("digests"), F.first("text_key").alias("text_key"), F.min("doc_id").alias("writer"), F.count(F.lit(1)).alias("copies"))
    each = once.select("media", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("media").alias("owner")).filter("n > 1").select("digest", "owner")
    sides = each.join(shared, "digest").groupBy("media").agg(
        F.collect_set(F.when(F.col("media") != F.col("owner"), F.col("digest"))).alias("borrowed"),
        F.collect_set(F.when(F.col("media") == F.col("owner"), F.col("digest"))).alias("lends"))
    # A note for each media that several documents have, or that borrows or lends; the rest are written as they come.
    notes = once.join(sides, "media", "left").filter("copies > 1 OR borrowed IS NOT NULL")
    notes = shelf.put(notes.select(F.col("text_key").alias("_key"), F.col("writer").alias("_writer"), "borrowed", "lends"), "notes")
    rows, held = notes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.coalesce("borrowed", F.array())) + F.size(F.coalesce("lends", F.array()))), F.lit(0))).first()
    noted = F.broadcast(notes) if rows * 96 + held * 48 <= broadcast_bytes else notes
    written = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _text_key(F.col("text")).alias("_own_key")).join(
        noted, F.col("_own_key") == F.col("_key"), "left").filter("_key IS NULL OR doc_id <=> _writer")
    return written.select("text", "borrowed", "lends").mapInArrow(_written, f"media binary, digests array<binary>, own array<binary>, lends array<binary>, whole boolean")


def _written(batches):
    kinds = [pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.bool_()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["media", "digests", "own", "lends", "whole"])

    for batch in batches:
        rows, held = [], 0
        for text, borrowed, lends in zip(*batch.columns):
            media = to_media(payload_of(text.as_py()))
            parts, lent = chunks(media), set(borrowed.as_py() or ())
            names = [digest(c) for c in parts]
            first = {n: i for i, n in reversed(list(enumerate(names)))}
            own = [c if n not in lent and first[n] == i else None for i, (n, c) in enumerate(zip(names, parts))]
            rows.append((digest(media), names, own, lends.as_py() or [], not lent))
            held += len(media)
            if held > BLOCK * 8:
                yield packed(rows)
                rows, held = [], 0
        yield packed(rows)


def _measured(batches):
    """media, digests, own, lent: lent has the borrowed chunks by digest."""
    for batch in batches:
        rows = []
        for name, digests, own, lent in zip(*batch.columns):
            names, parts = digests.as_py(), own.as_py()
            known = {n: c for n, c in zip(names, parts) if c is not None} | {digest(c): c for c in lent.as_py() or ()}
            name = name.as_py()
            rows.append((name, *measured(b"".join(known[n] for n in names), name)))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])


def read_back(stored: DataFrame) -> DataFrame:
    """media and what its samples measure, from the chunk store alone."""
    parts = stored.filter("NOT whole")
    wanted = parts.select("media", F.explode(F.array_distinct(F.transform(F.filter(
        F.arrays_zip("digests", "own"), lambda x: x["own"].isNull()), lambda x: x["digests"]))).alias("digest"))
    held = stored.filter(F.size("lends") > 0).select("lends", F.explode(F.arrays_zip("digests", "own")).alias("x")).filter(
        F.col("x.own").isNotNull() & F.array_contains("lends", F.col("x.digests"))).select(F.col("x.digests").alias("digest"), F.col("x.own").alias("chunk"))
    lent = wanted.join(held.dropDuplicates(["digest"]), "digest").groupBy("media").agg(F.collect_set("chunk").alias("lent"))
    patched = parts.join(lent, "media", "left").select("media", "digests", "own", "lent")
    alone = stored.filter("whole").select("media", "digests", "own", F.lit(None).cast("array<binary>").alias("lent"))
    schema = f"media binary, {MEASURES}"
    return alone.mapInArrow(_measured, schema).unionByName(patched.mapInArrow(_measured, schema)).dropDuplicates(["media"])


def media_features(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    shelf = Shelf(docs.sparkSession, "media")
    indexed = shelf.put(index(docs), "index")
    stored = shelf.put(store(docs, indexed, shelf, broadcast_bytes), "chunks", codec="zstd")
    measures = shelf.put(read_back(stored), "measures")
    return indexed.select("doc_id", "n_bytes", "media").join(measures, "media").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")
