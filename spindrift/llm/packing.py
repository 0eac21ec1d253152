"""Packing by order-preserving dynamic programming.

Documents keep their order (by ``doc_id``) and are laid end to end; windows of at most 4096 tokens are cut
from that line. Cuts may lie at the end of a document (free), of a sentence and, in documents that have a sentence of
more than ``LONG_SENTENCE`` tokens, of a line (a small penalty); within a sentence only where it is longer than a window, every ``GRID`` tokens (a larger penalty).
With f(j) the least cost of the line up to candidate j at position p(j),

    f(j) = penalty(j) + min over i with p(j) - p(i) <= 4096 of f(i) + 4096 - (p(j) - p(i)).

f(i) + p(i) does not depend on j, so the minimum over the moving range of i is kept in a monotone queue and
each candidate costs constant time. The line is solved in stretches of ``STRETCH`` windows; a stretch's last
window stays open for the next one.

Spark splits the documents by ranges of ``doc_id`` into runs of some ``RUN_TEXT`` bytes, whatever the session's
number of partitions, and a task packs a run. A window that is shorter than 4096 tokens is padded. The rest that a
run's last window would hold is cut into lengths that are powers of two, which need no padding.

Defined results: null or empty text is the closing id alone; every id lies in exactly one piece; rows that
share a ``doc_id`` follow each other in the order of a hash of their texts; the same row given twice is packed
twice; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, table
from .tokens import place, word_encoder

TOKENIZER, CLOSE, WINDOW = "word_bpe_49k.json", 2, 4096
#: Penalties, in tokens of padding, and the spacing of cuts within sentences that are longer than a window.
AFTER_SENTENCE, WITHIN_SENTENCE, GRID = 4, 24, 32
STRETCH, RUN_TEXT, LONG_SENTENCE = 64, 8 << 20, 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def sentence_ends(name: str = TOKENIZER) -> np.ndarray:
    """Whether a token closes a sentence, by id."""
    with open(place(name), encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    out = np.zeros(1 << 16, bool)  # ids of special tokens lie outside the vocabulary
    for token, k in vocab.items():
        out[k] = token.endswith("</w>") and token[:-4].endswith((".", "!", "?"))
    return out


class Tokens(NamedTuple):
    """A document's ids, with the closing one, and where its lines end among them."""

    doc_id: int
    ids: np.ndarray
    lines: np.ndarray


_NO_LINES = np.empty(0, np.int64)


def longest_sentence(ends: np.ndarray, ids: np.ndarray) -> int:
    at = np.flatnonzero(ends[ids])
    if not len(at):
        return len(ids)
    inner = int((at[1:] - at[:-1]).max()) if len(at) > 1 else 0
    return max(int(at[0]) + 1, inner, len(ids) - 1 - int(at[-1]))


def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    """The documents of batches, with the line ends of those that have a long sentence.

    Line ends are not among the ids of a text, so its lines are encoded one by one to find them.
    """
    encode, close, ends = word_encoder(TOKENIZER), CLOSE.to_bytes(2, "little"), sentence_ends()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids, lines = np.frombuffer(encode(text) + close if text else close, "<u2"), _NO_LINES
            if len(ids) > LONG_SENTENCE and "\n" in text and longest_sentence(ends, ids) > LONG_SENTENCE and not _SPECIAL.search(text):
                lines = np.cumsum([len(encode(line)) for line in text.split("\n")]) // 2  # a special token, too, may hold a line end
            yield Tokens(doc_id, ids, lines)


_SPECIAL = re.compile(r"<\|")


def candidates(ids: np.ndarray, ends: np.ndarray, lines: np.ndarray = _NO_LINES, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may lie in a line of ids (after each document's end in ``ends``, and where ``lines`` end), and their penalties."""
    # What a cut at each place costs, with places where none may lie at -1.
    cost = np.full(len(ids) + 1, -1, np.int8)
    cost[1:][sentence_ends()[ids]] = AFTER_SENTENCE
    cost[lines] = AFTER_SENTENCE
    cost[0] = WITHIN_SENTENCE
    cost[ends] = 0
    at = np.flatnonzero(cost >= 0)
    if wide := np.flatnonzero(np.diff(at) > window).tolist():
        for i in wide:
            cost[at[i] + GRID : at[i + 1] : GRID] = WITHIN_SENTENCE
        at = np.flatnonzero(cost >= 0)
    return at, cost[at].astype(np.int64)


def best_cuts(at: list[int], penalty: list[int], window: int = WINDOW) -> list[int]:
    """The cheapest cuts of a line from 0 on, as far as the cheapest that leaves no more than a window.

    ``at`` ascends by steps of ``window`` at most.
    """
    cost, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f(i) + p(i), i), rising
    for j in range(1, len(at)):
        while at[queue[0][1]] < at[j] - window:
            queue.popleft()
        least, back[j] = queue[0]
        cost[j] = penalty[j] + least + window - at[j]
        key = cost[j] + at[j]
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = min((i for i in range(len(at)) if at[i] >= at[-1] - window and i < len(at) - 1), key=lambda i: (cost[i], -i))
    out = [at[j]]
    while j:
        j = back[j]
        out.append(at[j])
    return out[::-1]


def powers(length: int) -> list[int]:
    """The powers of two that a length is the sum of, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def pack(docs: Iterator[Tokens], first_sequence: int = 0, window: int = WINDOW) -> Iterator[tuple]:
    """The pieces of documents given in order."""
    held: list[tuple[int, np.ndarray, int, int, np.ndarray]] = []  # doc_id, ids still to pack, how many went before, all, line ends
    size, sequence = 0, first_sequence

    def cut(last: bool) -> Iterator[tuple]:
        nonlocal held, size, sequence
        line = np.concatenate([x[1] for x in held])
        ends = np.cumsum([len(x[1]) for x in held])
        lines = np.concatenate([x[4] + (end - len(x[1])) for x, end in zip(held, ends, strict=True)])
        where, penalty = candidates(line, ends, lines, window)
        borders = best_cuts(where.tolist(), penalty.tolist(), window)
        if last:
            borders += (borders[-1] + np.cumsum(powers(size - borders[-1]))).tolist()
        starts, k = [0, *ends.tolist()], 0
        for low, high in zip(borders, borders[1:]):
            at = low
            while at < high:
                while starts[k + 1] <= at:
                    k += 1
                doc_id, ids, before, total, _ = held[k]
                i, j = at - starts[k], min(high, starts[k + 1]) - starts[k]
                yield doc_id, before + i, j - i, crc32(ids[i:j].astype("<u4").tobytes()), total, sequence, at - low
                at = starts[k] + j
            sequence += 1
        done = borders[-1]
        rest = []
        for n, (doc_id, ids, before, total, lines) in enumerate(held):
            if starts[n + 1] > done:
                skip = max(0, done - starts[n])
                rest.append((doc_id, ids[skip:], before + skip, total, lines[lines > skip] - skip))
        held, size = rest, size - done

    for doc_id, ids, lines in docs:
        held.append((doc_id, ids, 0, len(ids), lines))
        size += len(ids)
        if size >= STRETCH * window:
            yield from cut(False)
    if held:
        yield from cut(True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    rows: list[tuple] = []
    names = [x.split()[0] for x in PIECES.split(", ")]
    for row in pack(tokenized(batches), (context.partitionId() if context else 0) << 40):
        rows.append(row)
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of all documents, with the columns of ``PIECES``."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # Equal rows, which may be many, are told apart by a number, so that they need not share a run.
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"))
    # Texts are dealt out, not ids: Spark draws the ranges from a first pass, which then encodes nothing.
    order = ["doc_id", "tie", "copy"]
    ordered = ordered.repartitionByRange(max(1, -(-size // RUN_TEXT)), *order).sortWithinPartitions(*order)
    return arrow(ordered.select("doc_id", "text"), _packed, PIECES)


def op8_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
