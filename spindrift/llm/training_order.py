"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride binary shards.

Every document is encoded, closed by an end id and cut into sequences of ``LENGTH`` ids. Sequence p of a
document has the index (doc_id - smallest doc_id) * 2^k + p, where 2^k is twice the most sequences that a document
can have by its bytes; indices have up to 126 bits, held as two halves, so that ids may span all 64. A keyed Feistel
network permutes the index; where it leaves the range of indices it is applied again (cycle-walking). Equal ranges
of the permuted indices' left halves are the shards: Spark deals sequences by range, sorts each range and writes
it as one file of records of the same size. The gaps that unused indices leave close within each file, and a
sequence's global slot is its shard's first slot plus its row. The order depends on ids, the key and the largest
document, not on how the input is laid out. A corpus of more than a terabyte of text gets ``MOST_SHARDS`` larger
shards instead of more, as the shards' first slots are broadcast.

A record is ``LENGTH`` little-endian 16-bit ids, filled with ``FILL``. Reading from slot s on is a seek to
row * stride in the shard that holds s, so a reader can resume anywhere. Files are written under a name of
the attempt and renamed, so that a repeated task replaces its own file.

Rows without an id of their own (none, or one that several rows have) would all have one index; they are spread over all indices by a
hash of their id, text and place in the input instead, beside those of the ids, so that no shard gets them all.

Defined results: null and empty texts are one sequence of the end id alone; rows without ``doc_id`` and rows that share an id keep all
their sequences, in an order that depends on their content (and, for equal ones, on the input's layout); an empty table gives no shards
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, scratch_path, shipped, table, written
from .tokens import word_encoder

LENGTH, END, FILL, KEY, ROUNDS = 512, 2, 0xFFFF, 0x5EED, 6
#: Bytes of text that a shard holds on average, unless that makes more shards than the second number (their first slots are broadcast).
SHARD_TEXT, MOST_SHARDS = 16 << 20, 1 << 16


class Permutation:
    """The keyed permutation of the indices number * 2^bits + piece, for numbers 0 .. ``most``, as halves of equal width."""

    def __init__(self, most: int, bits: int, key: int = KEY):
        width = most.bit_length() + bits
        half = max((width + 1) // 2, 1)
        if half > 63:
            raise ValueError("a document has too many sequences")
        self.most, self.bits, self.half = np.uint64(most), np.uint64(bits), np.uint64(half)
        self.mask = np.uint64((1 << half) - 1)
        #: How many bits of the number are in the right half, and how many of the piece in the left one.
        self.down, self.up = np.uint64(max(half - bits, 0)), np.uint64(max(bits - half, 0))
        #: A piece of a row without an id of its own is this many pieces behind.
        self.beside = 1 << (bits - 1)
        #: How many left halves there are.
        self.lefts = ((most << int(self.up)) >> int(self.down)) + (1 << int(self.up))
        self.seeds = np.random.RandomState(key % (1 << 32)).randint(1, 1 << 62, ROUNDS).astype(np.uint64)

    def _once(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for seed in self.seeds:
            h = (right + seed) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & self.mask)
        return left, right

    def _outside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether an index has a number above ``most``; compared by halves, so that nothing overflows."""
        if not self.down:
            return (left >> self.up) > self.most
        top, rest = self.most >> self.down, self.most & ((np.uint64(1) << self.down) - np.uint64(1))
        return (left > top) | ((left == top) & ((right >> self.bits) > rest))

    def __call__(self, number: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The left and right halves of the permuted indices."""
        if not self.down:
            left, right = (number << self.up) | (piece >> self.half), piece & self.mask
        else:
            left, right = number >> self.down, ((number & ((np.uint64(1) << self.down) - np.uint64(1))) << self.bits) | piece
        left, right = self._once(left, right)
        while (outside := self._outside(left, right)).any():
            left[outside], right[outside] = self._once(left[outside], right[outside])
        return left, right


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def with_spread(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with ``spread``: null for an id of one row, else a number that spreads the rows without such an id."""
    number = F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).bitwiseAND((1 << 62) - 1)
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    twice = written(twice, "training-repeats")
    if twice.isEmpty():
        return docs.withColumn("spread", F.when(F.col("doc_id").isNull(), number))
    numbered = docs.withColumn("number", number).join(twice, F.col("doc_id") == F.col("again"), "left")
    return numbered.select("doc_id", "text", F.when(F.col("doc_id").isNull() | F.col("again").isNotNull(), F.col("number")).alias("spread"))


def materialise(docs: DataFrame, path: str | None = None, length: int = LENGTH, key: int = KEY) -> tuple[str, DataFrame]:
    """Write the shards; returns their folder and, for each sequence, doc_id, start, length, slot, shard, row, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "training-order")
    docs = with_spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    seen = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(size).alias("most"), F.sum(size.cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    low, high = (seen["low"] or 0), (seen["high"] or 0)
    pieces = ((seen["most"] or 0) + 1 + length - 1) // length  # no text has more ids than bytes
    most = max(high - low, seen["n"] - 1, 0)
    order_of = Permutation(most, 1 + pieces.bit_length(), key)
    shards = min(MOST_SHARDS, max(1, -(-(seen["bytes"] or 0) // SHARD_TEXT)), order_of.lefts)
    width = np.uint64(-(-order_of.lefts // shards))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(), END.to_bytes(2, "little")
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                ids, starts, data, numbers, beside = [], [], [], [], []
                for doc_id, text, place in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("spread").to_pylist(), strict=True):
                    raw = encode(text) + end if text else end
                    at = range(0, len(raw) // 2, length)
                    ids += [doc_id] * len(at)
                    numbers += [doc_id - low if place is None else place % (most + 1)] * len(at)
                    beside += [0 if place is None else order_of.beside] * len(at)
                    starts += at
                    data += [raw[2 * i : 2 * (i + length)] for i in at]
                if not ids:
                    continue
                number = np.array(numbers, np.uint64)
                piece = np.array(starts, np.uint64) // np.uint64(length) + np.array(beside, np.uint64)
                left, right = order_of(number, piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((left // width).astype(np.int32)), pa.array(left.astype(np.int64)), pa.array(right.astype(np.int64)), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())],
                    ["shard", "left", "right", "doc_id", "start", "ids"],
                )

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and index; a task holds whole shards and writes one after the other."""
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        shard, row, out = None, 0, None

        def close() -> None:
            if out is not None:
                out.close()
                final = f"{folder}/shard-{shard:06d}.bin"
                if store.get_file_info(final).type != fs.FileType.NotFound:
                    store.delete_file(final)
                store.move(f"{final}.{attempt}", final)

        fill = FILL.to_bytes(2, "little")
        for batch in batches:
            rows, crcs = [], []
            raw = batch.column("ids").to_pylist()
            for k, ids in zip(batch.column("shard").to_pylist(), raw, strict=True):
                if k != shard:
                    close()
                    shard, row = k, 0
                    out = store.open_output_stream(f"{folder}/shard-{k:06d}.bin.{attempt}")
                out.write(ids + fill * (length - len(ids) // 2))
                rows.append(row)
                crcs.append(crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array([len(x) // 2 for x in raw], pa.int64()), batch.column("shard"), pa.array(rows, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "length", "shard", "row", "ids_crc32"],
            )
        close()

    shipped(spark)
    ranges = arrow(docs, cut, "shard int, left long, right long, doc_id long, start long, ids binary").repartitionById(shards, "shard")
    done = written(arrow(ranges.sortWithinPartitions("shard", "left", "right", "start", "ids"), stored, "doc_id long, start long, length long, shard int, row long, ids_crc32 long"), "training-rows")
    counts = done.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = {r["shard"]: r["n"] for r in counts.collect()}
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/manifest.json") as file:
        file.write(json.dumps({"length": length, "key": key, "fill": FILL, "rows": [rows.get(k, 0) for k in range(shards)]}).encode())
    return path, done.join(F.broadcast(first.drop("n")), "shard").select("doc_id", "start", "length", (F.col("first") + F.col("row")).alias("slot"), "shard", "row", "ids_crc32")


def read(path: str, slot: int = 0) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in training order."""
    store, folder = _store(path)
    with store.open_input_stream(f"{folder}/manifest.json") as file:
        manifest = json.loads(file.read())
    stride = 2 * manifest["length"]
    for shard, rows in enumerate(manifest["rows"]):
        if slot < rows:
            with store.open_input_file(f"{folder}/shard-{shard:06d}.bin") as file:
                file.seek(slot * stride)
                while record := file.read(stride):
                    ids = np.frombuffer(record, "<u2")
                    yield ids[ids != manifest["fill"]]
        slot = max(0, slot - rows)


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"))[1]
