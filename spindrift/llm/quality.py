"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes and each block compressed with either dictionary; with b and g the summed
sizes under the bad and the good one and n the bytes of the text, the normalised difference is d = (b - g) / n, positive
where the good dictionary helps more. It is the only thing that tells texts apart. The difference of a short text is noisier: it is
divided by its spread at that length, sqrt(1 + c / n), with c measured on labelled rows. A curve that only rises turns the result into a
probability: log-odds that are a straight line on either side of two knots, fitted with slopes above zero. The knots are where the bad
rows end and the good ones begin (the upper tenth of the one and the lower tenth of the other). So at any length, a
text that the good dictionary compresses better scores higher, and a text of no difference scores the same at all lengths.

Training takes a bounded number of labelled rows: ``PER_CLASS`` of either kind in the order of a hash of the
id. The dictionaries are trained on two thirds of them, on at most ``DRAWN`` blocks of each text, which the tasks draw evenly from the whole
of it (43 MB at the driver at most). The other third, which neither dictionary has seen, fits the curve; it is measured in
tasks and by whole texts, as everything is that is scored, and its rows count for as many labelled rows as they stand for, so that
scores follow the mix of all labels whatever the size of the table. Two dictionaries of ``DICTIONARY`` bytes (an eighth of the
text that they are trained on, where that is less) and seven numbers go to the tasks.

Defined results: null and empty texts score what the curve gives for no difference; without labels of both kinds, or
with too little labelled text for zstandard to train a dictionary of, every row scores the share of good labels (1 without any); rows of ``labels`` with nulls are skipped,
and a document with contradictory labels counts as bad; the same row given twice is scored twice; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, table, written
from .toxicity import represented, row_weights, sigmoid, training_sample

PER_CLASS, BLOCK, DRAWN, DICTIONARY, LEVEL = 4000, 256, 32, 112_640, 3
#: Of the sample, every third row is kept for the curve.
CURVE = 3
THRESHOLD = 0.3


class Sizes:
    """The compressed sizes of texts under one dictionary."""

    def __init__(self, dictionary: bytes):
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress

    def __call__(self, data: bytes) -> int:
        return sum(len(self._compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK))


def difference(data: bytes, good: Sizes, bad: Sizes) -> float:
    """The difference of the sizes, as a share of the bytes."""
    return (bad(data) - good(data)) / len(data) if data else 0.0


class Curve:
    """Difference and length -> probability of a good text; rises with the difference at every length."""

    LEAST_SLOPE = 1e-3

    def __init__(self, d: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Fit by Newton's method with a small ridge, each row counting ``weight`` times; slopes stay above zero."""
        self.c = self._noise(d, length, label, weight)
        z = self.standard(d, length)
        self.knots = sorted((np.quantile(z[label == 0], 0.9), np.quantile(z[label == 1], 0.1)))
        a, w = self._lines(z), np.array([self.LEAST_SLOPE] * 3 + [0.0])
        for _ in range(200):
            p = sigmoid(a @ w)
            h = a.T @ (a * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
            w += np.clip(np.linalg.solve(h, a.T @ (weight * (label - p)) - 1e-2 * w), -2, 2)
            w[:3] = np.maximum(w[:3], self.LEAST_SLOPE)
        self.weights = w

    @staticmethod
    def _noise(d: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
        """c of the spread: the squared distance from the kind's mean as a line over 1 / length, in groups of like length."""
        mean = np.array([np.average(d[label == k], weights=weight[label == k]) for k in (0, 1)])
        far, group = (d - mean[label.astype(int)]) ** 2, np.floor(np.log2(np.maximum(length, 1)))
        each = [(np.mean(1 / np.maximum(length[group == g], 1)), far[group == g].mean() + 1e-9, (group == g).sum()) for g in np.unique(group)]
        x, v, n = np.array(each).T
        a, use = np.column_stack((np.ones(len(x)), x)), n / v**2
        level, slope = np.linalg.lstsq(a * np.sqrt(use)[:, None], v * np.sqrt(use), rcond=None)[0]
        return float(max(slope, 0.0) / max(level, 1e-6))

    def standard(self, d: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 10 * d / np.sqrt(1 + self.c / np.maximum(length, 1))

    def _lines(self, z: np.ndarray) -> np.ndarray:
        low, high = self.knots
        return np.column_stack((np.minimum(z, low), np.clip(z, low, high) - low, np.maximum(z, high) - high, np.ones(len(z))))

    def __call__(self, d: np.ndarray, length: np.ndarray) -> np.ndarray:
        return sigmoid(self._lines(self.standard(d, length)) @ self.weights)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def drawn(data: bytes, most: int = DRAWN) -> list[bytes]:
    """At most ``most`` blocks of a text, evenly from the whole of it; blocks of less than 16 bytes are left out."""
    n = -(-len(data) // BLOCK)
    places = range(n) if n <= most else [(2 * k + 1) * n // (2 * most) for k in range(most)]
    return [block for k in places if len(block := data[k * BLOCK : (k + 1) * BLOCK]) >= 16]


def _blocks(ids: np.ndarray):
    """doc_id and drawn blocks of the rows of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), ids), pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([drawn(encoded(text)) for text in batch.column("text").to_pylist()], pa.list_(pa.binary()))], ["doc_id", "blocks"])

    return run


def measured(data: list[bytes], good: Sizes, bad: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """The normalised difference and the length, of each text."""
    return np.array([difference(d, good, bad) for d in data], float), np.array([len(d) for d in data], np.int64)


def _measures(ids: np.ndarray, of: dict[int, bytes]):
    """doc_id, difference and length of the rows of ``ids``, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = Sizes(of[1]), Sizes(of[0])
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), ids), pa.bool_()))
            d, length = measured([encoded(text) for text in batch.column("text").to_pylist()], good, bad)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(d), pa.array(length)], ["doc_id", "difference", "length"])

    return run


def dictionary(blocks: list[bytes]) -> bytes | None:
    """A dictionary trained on blocks; None where they are too little to train one."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, blocks)) // 8), blocks, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def first_rows(found: DataFrame) -> dict[int, tuple]:
    """The rows by their doc_id, of each the first."""
    rows: dict[int, tuple] = {}
    for r in found.toLocalIterator():
        rows.setdefault(r["doc_id"], tuple(r)[1:])
    return rows


def train(sample: DataFrame, stands_for: dict[int, float]) -> dict:
    """The model of (doc_id, label, text) rows, label 1 being good; ``stands_for``: how many labelled rows one of either label stands for."""
    rows = sorted(map(tuple, sample.select("doc_id", "label").distinct().collect()), key=lambda r: (crc32(f"{r[0]}".encode()[::-1]), r[0]))
    ids, label = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    if not len(label) or label.min() == label.max():
        return {"share": float(label.mean()) if len(label) else 1.0}
    held = np.zeros(len(rows), bool)
    for k in (0, 1):
        held[np.flatnonzero(label == k)[::CURVE]] = True
    data = first_rows(arrow(sample, _blocks(ids[~held]), "doc_id long, blocks array<binary>"))
    of = {k: dictionary([bytes(x) for i in ids[~held & (label == k)].tolist() for x in data[i][0]]) for k in (0, 1)}
    del data
    if None in of.values():
        return {"share": float((row_weights(label, stands_for) * label).mean())}
    found = first_rows(arrow(sample, _measures(ids[held], of), "doc_id long, difference double, length long"))
    numbers = np.array([found[i] for i in ids[held].tolist()])
    each = {k: stands_for.get(k, 1.0) * (label == k).sum() / (held & (label == k)).sum() for k in (0, 1)}
    return {"good": of[1], "bad": of[0], "curve": Curve(numbers[:, 0], numbers[:, 1], label[held], row_weights(label[held], each))}


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score, of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "share" not in model:
            good, bad = Sizes(model["good"]), Sizes(model["bad"])
        for batch in batches:
            if "share" in model:
                p = np.full(batch.num_rows, model["share"])
            else:
                d, length = measured([encoded(text) for text in batch.column("text").to_pylist()], good, bad)
                p = model["curve"](d, length)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "doc_id long, score double")


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The model, from rows of ``labels`` (doc_id, quality)."""
    worst = labels.where("quality is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    sample = written(training_sample(docs, worst, "bad", per_class).withColumn("label", 1 - F.col("label")), "quality-sample")
    return train(sample, {1 - k: n for k, n in represented(worst, "bad", per_class).items()})


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = scores(docs, fitted(docs, labels.where("doc_id is not null").where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
