"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash (each byte's random number, shifted by its distance) runs over the last ``DEPTH`` bytes. A chunk
begins where the hash is the largest within ``REACH`` bytes to both sides, so borders depend on the bytes
nearby only and find themselves again after an insertion. Words are kept whole where there is white space.

Chunks are deduplicated by a 128-bit digest: the document with the smallest ``doc_id`` owns a chunk, and
other documents lose it where at least ``LEAST_WORDS`` words in a row are owned by earlier documents (chance
repeats of a few words stay).

A passage may occur in a third of all documents: a digest's owner is an aggregate that combines in the map
tasks first, and the join that takes it back to the chunks has one row for each digest on the owner's side.

Defined results: null and empty texts have no chunks; repeats within one document stay; rows that share a
``doc_id`` count as one document, each with its own spans; rows without ``doc_id`` take no part; an empty
table gives an empty result; other columns are left alone. The cleaned text of a document may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, table, unused

DEPTH, REACH, LEAST_WORDS = 16, 20, 16

_GEAR = np.random.RandomState(1931).randint(0, 1 << 32, 256).astype(np.uint32)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Large texts are hashed in pieces of this many bytes, to bound memory.
_PIECE = 1 << 20

CHUNKS = "doc_id long, tag int, start int, length int, words int, high long, low long"


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the ``DEPTH`` bytes that end at each position, by doubling."""
    h, reach = _GEAR[data], 1
    while reach < DEPTH:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = more, 2 * reach
    return h


def _largest(x: np.ndarray, reach: int) -> np.ndarray:
    """The maximum of the ``reach`` values before each position, and 0 at the front."""
    out, span = x, 1
    while 2 * span <= reach:
        more = out.copy()
        np.maximum(more[span:], out[:-span], out=more[span:])
        out, span = more, 2 * span
    full = out.copy()
    k = reach - span
    if k:
        np.maximum(full[k:], out[:-k], out=full[k:])
    before = np.zeros_like(x)
    before[1:] = full[:-1]
    return before


def _starts(data: np.ndarray) -> np.ndarray:
    """The borders by content: where the hash of the bytes before a position exceeds those nearby."""
    white = _WHITE[data]
    rank = np.zeros(len(data), np.uint32)
    rank[1:] = (gear(data)[:-1] >> np.uint32(1)) + np.uint32(1)
    rank[1:][white[:-1] & ~white[1:]] |= np.uint32(1 << 31)  # the beginnings of words come first
    rank[(data & 0xC0) == 0x80] = 0  # never within a character
    before, after = _largest(rank, REACH), _largest(rank[::-1], REACH)[::-1]
    return np.flatnonzero((rank > before) & (rank >= after) & (rank > 0))


def chunk_starts(data: bytes) -> np.ndarray:
    """Where the chunks of a text begin, 0 first; none for no bytes."""
    if not data:
        return np.empty(0, np.int64)
    raw, margin = np.frombuffer(data, np.uint8), DEPTH + REACH + 8
    found = [np.zeros(1, np.int64)]
    for at in range(0, len(raw), _PIECE):
        low, high = max(0, at - margin), min(len(raw), at + _PIECE + margin)
        s = _starts(raw[low:high]) + low
        found.append(s[(s >= max(at, 1)) & (s < at + _PIECE)])
    return np.concatenate(found)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    for batch in batches:
        for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
            ids, tags, counts, starts, lengths, words, digests = [], [], [], [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                at = chunk_starts(data)
                if not len(at):
                    continue
                ends = np.append(at[1:], len(data))
                raw = np.frombuffer(data, np.uint8)
                white = _WHITE[raw]
                begin = ~white
                begin[1:] &= white[:-1]
                ids.append(doc_id)
                tags.append(xxhash.xxh32_intdigest(data) - (1 << 31))
                counts.append(len(at))
                starts.append(at)
                lengths.append(ends - at)
                words.append(np.add.reduceat(begin, at, dtype=np.int64))
                digests += [digest(data[i:j]) for i, j in zip(at.tolist(), ends.tolist(), strict=True)]
            if ids:
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                columns = [np.repeat(np.array(ids, np.int64), counts), np.repeat(np.array(tags, np.int32), counts), *(np.concatenate(x).astype(np.int32) for x in (starts, lengths, words)), both[:, 0].copy(), both[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The byte ranges that documents lose: doc_id, tag, start, length, words, chunks, owner_id (the smallest)."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = arrow(rows, _chunked, CHUNKS)
    owners = (
        chunks.groupBy("high", "low").agg(F.min("doc_id").alias("owner_id"), F.max("doc_id").alias("last"))
        .where("owner_id < last").select("high", "low", "owner_id")
    )
    lost = chunks.join(owners, ["high", "low"]).where("doc_id > owner_id").select("doc_id", "tag", "start", "length", "words", "owner_id").distinct()
    in_text = Window.partitionBy("doc_id", "tag").orderBy("start")
    runs = lost.withColumn("new", (F.col("start") > F.lag(F.col("start") + F.col("length"), 1, -1).over(in_text)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(in_text))
    return (
        runs.groupBy("doc_id", "tag", "run")
        .agg(F.min("start").alias("start"), F.sum("length").cast("int").alias("length"), F.sum("words").cast("int").alias("words"), F.count(F.lit(1)).cast("int").alias("chunks"), F.min("owner_id").alias("owner_id"))
        .where(F.col("words") >= least_words)
        .drop("run")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are documents with three more columns at the end: the spans' tags, starts and lengths."""
    for batch in batches:
        texts, width = batch.column("text").to_pylist(), batch.num_columns - 3
        for n, (text, tags, starts, lengths) in enumerate(zip(texts, *(batch.column(width + k).to_pylist() for k in range(3)), strict=True)):
            if not text or not starts:
                continue
            data = text.encode("utf-8", "surrogatepass")
            tag, kept, at = xxhash.xxh32_intdigest(data) - (1 << 31), [], 0
            for t, start, length in sorted(zip(tags, starts, lengths, strict=True)):
                if t == tag:
                    kept.append(data[at:start])
                    at = start + length
            kept.append(data[at:])
            texts[n] = b"".join(kept).decode("utf-8", "surrogatepass")
        names = batch.schema.names[:width]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names)


def substring_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """All documents, with the columns of ``docs``; repeated spans are gone from ``text``."""
    doc, tags, starts, lengths = unused(docs, "doc", "tags", "starts", "lengths")
    spans = repeated_spans(docs, least_words).groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list("tag").alias(tags), F.collect_list("start").alias(starts), F.collect_list("length").alias(lengths))
    both = docs.join(spans, F.col("doc_id").cast("long") == F.col(doc), "left").drop(doc)
    out = arrow(both, _cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
