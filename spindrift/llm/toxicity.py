"""Toxicity by a classifier chain.

The categories are predicted one after another by linear (logistic) models over words and word beginnings;
each later model also gets the earlier categories' log-odds. While training, those are out-of-fold: every
row's come from models that never saw it, so that a later model learns how far the earlier ones can be
trusted on new rows.

``labels`` marks documents as toxic or not, and no kinds of toxicity. The kinds are therefore found first: toxic rows are
clustered by the telling features that occur in them together (spherical k-means over features that are much more
frequent in toxic rows), so that, say, the languages or the vocabularies of toxic documents become categories of their own, the largest
first; ``toxic`` itself comes last. A row of no cluster is of no kind. All that looks at labels happens inside a fold: the rows
of the other folds alone choose the features, find the kinds and fit the models that give a row its out-of-fold odds; a fold's kinds are
matched to those of all rows by the likeness of their centres.

Training takes a bounded sample of labelled rows (``PER_CLASS`` of either kind, in the order of a hash of
the id); everything is scored by its whole text. A sampled row counts for as many labelled rows as it stands
for, so that bias, scores and threshold follow the mix of all labels whatever the size of the table. What goes
to the tasks has a fixed bound: ``FEATURES`` weights for each category.

Defined results: texts without a word (null, empty, blank, or signs and single characters only) score 0 and are
never predicted to be toxic, nor are they trained on; where the labels are all of one kind, all other texts score
the share of toxic rows (0 without labels); rows of ``labels`` with nulls are skipped, and a document with
contradictory labels counts as toxic; the same row given twice is scored twice; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, arrow, released, table

KINDS = 3
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
PER_CLASS, FEATURES, FOLDS, BITS = 2500, 8192, 5, 20
#: Telling features are those that occur in at least this many toxic rows and this much more often than elsewhere.
LEAST_ROWS, LEAST_LIFT = 8, 6.0
#: Letters of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 7)
_STEPS, _RATE, _RIDGE = 150, 0.3, 1e-3


def word_features(token: str) -> list[int]:
    """The hashed features of a token: its word and the word's beginnings."""
    word = "".join(c for c in token.lower() if c.isalnum())
    if len(word) < 2:
        return []
    mask = (1 << BITS) - 1
    found = [crc32(word.encode()) & mask]
    return found + [crc32(f"{word[:k]}-".encode()) & mask for k in BEGINNINGS if len(word) > k]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The feature counts of training rows: id, label, words, features, counts."""
    known = Memo(word_features, 200_000)
    for batch in batches:
        out: list[list] = [[], [], []]
        for text in batch.column("text").to_pylist():
            tokens = (text or "").split()
            features = [f for t in tokens for f in known[t]]
            at, counts = np.unique(np.array(features, np.int64), return_counts=True)
            for column, value in zip(out, (len(tokens), at.tolist(), counts.tolist()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(out[0], pa.int64()), *(pa.array(c, pa.list_(pa.int32())) for c in out[1:])],
            ["doc_id", "label", "words", "features", "counts"],
        )


class Rows:
    """Sparse rows: for each row its columns and values, laid end to end."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int):
        self.row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        self.column = np.concatenate(columns) if columns else np.empty(0, np.int64)
        self.value = np.concatenate(values) if values else np.empty(0)
        self.height, self.width = len(columns), width

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], self.height)

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * errors[self.row], self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: Rows, more: np.ndarray, label: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Logistic weights: those of ``rows``, of the columns of ``more``, and the bias; by Adam, each row counting ``use`` times."""
    n, width = use.sum(), rows.width + more.shape[1] + 1
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    share = (use * label).sum() / n if n else 0.0
    w[-1] = np.log((share + 1e-4) / (1 - share + 1e-4))
    for t in range(1, _STEPS + 1):
        p = sigmoid(rows.times(w[: rows.width]) + more @ w[rows.width : -1] + w[-1])
        e = use * (p - label) / max(n, 1)
        g = np.concatenate((rows.back(e), more.T @ e, [e.sum()]))
        g[:-1] += _RIDGE / max(n, 1) * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= _RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def values(counts: np.ndarray, words: int) -> np.ndarray:
    """A feature's value: its share of the words, damped."""
    return np.sqrt(counts / max(words, 1)) * 4


def row_weights(label: np.ndarray, stands_for: dict[int, float] | None) -> np.ndarray:
    """What each row counts, 1 on average: in proportion to the labelled rows that it stands for."""
    weight = np.array([(stands_for or {}).get(int(k), 1.0) for k in label])
    return weight / weight.mean()


class View:
    """What the rows marked by ``use`` say: the features that they choose and all rows over these, the telling features, the kinds' centres."""

    def __init__(self, sample: list[dict], label: np.ndarray, weight: np.ndarray, use: np.ndarray):
        size = 1 << BITS
        in_toxic, in_clean = np.zeros(size), np.zeros(size)
        for r, toxic, used in zip(sample, label, use, strict=True):
            if used:
                (in_toxic if toxic else in_clean)[r["features"]] += 1
        n = [max((use & (label == k)).sum(), 1) for k in (0, 1)]
        lift = ((in_toxic + 1) / (n[1] + 2)) / ((in_clean + 1) / (n[0] + 2))
        of_toxic, of_clean = (x * (weight[label == k][0] if (label == k).any() else 1.0) for k, x in ((1, in_toxic), (0, in_clean)))
        expected = (of_toxic + of_clean) * (weight * label * use).sum() / (weight * use).sum()
        gain = np.where(in_toxic + in_clean >= 3, (of_toxic - expected) ** 2 / (expected + 0.5), 0)
        chosen = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
        self.chosen = chosen[gain[chosen] > 1e-9]
        place = np.full(size, -1)
        place[self.chosen] = np.arange(len(self.chosen))
        columns, vals = [], []
        for r in sample:
            at = place[r["features"]]
            columns.append(at[at >= 0])
            vals.append(values(r["counts"][at >= 0], r["words"]))
        self.rows = Rows(columns, vals, len(self.chosen))
        self.telling = np.flatnonzero((lift >= LEAST_LIFT) & (in_toxic >= LEAST_ROWS))
        self.centres = kinds([self.directions(r) for r, toxic, used in zip(sample, label, use, strict=True) if toxic and used])

    def directions(self, row: dict) -> dict[int, float]:
        """A row's telling features, as a vector of length one."""
        found = np.intersect1d(row["features"], self.telling).tolist()
        return dict.fromkeys(found, 1 / np.sqrt(len(found))) if found else {}

    def kind(self, row: dict) -> int:
        """The nearest centre; -1 without telling features."""
        x = self.directions(row)
        return int(np.argmax([likeness(x, c) for c in self.centres])) if x and self.centres else -1


def likeness(a: dict[int, float], b: dict[int, float]) -> float:
    if len(a) > len(b):
        a, b = b, a
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def kinds(rows: list[dict[int, float]]) -> list[dict[int, float]]:
    """At most ``KINDS`` centres of the rows' directions, by spherical k-means, those of most rows first; the start is the row that is like most others,
    then always the one least like the centres so far."""
    rows = [r for r in rows if r]
    if not rows:
        return []
    total: dict[int, float] = {}
    for r in rows:
        for k, v in r.items():
            total[k] = total.get(k, 0.0) + v
    centres = [rows[int(np.argmax([likeness(r, total) for r in rows]))]]
    while len(centres) < KINDS:
        near = [max(likeness(r, c) for c in centres) for r in rows]
        if min(near) > 0.999:
            break
        centres.append(rows[int(np.argmin(near))])
    for _ in range(10):
        of = [int(np.argmax([likeness(r, c) for c in centres])) for r in rows]
        after = []
        for j in range(len(centres)):
            total = {}
            for r in (r for r, k in zip(rows, of, strict=True) if k == j):
                for k, v in r.items():
                    total[k] = total.get(k, 0.0) + v
            norm = np.sqrt(sum(v * v for v in total.values()))
            after.append({k: v / norm for k, v in total.items()} if norm else centres[j])
        if after == centres:
            break
        centres = after
    return [centres[j] for j in sorted(range(len(centres)), key=lambda j: -of.count(j))]


def matched_kinds(own: list[dict[int, float]], to: list[dict[int, float]]) -> list[int]:
    """For each centre of ``own`` the one of ``to`` that it stands for: the most alike pairs first, each used once; -1 for none left."""
    out, free = [-1] * len(own), set(range(len(to)))
    for _, i, j in sorted((-likeness(a, b), i, j) for i, a in enumerate(own) for j, b in enumerate(to)):
        if out[i] < 0 and j in free:
            out[i] = j
            free.discard(j)
    return out


def train(sample: list[dict], stands_for: dict[int, float] | None = None, categories: int = KINDS + 1) -> dict:
    """The chain: the chosen features, and each category's weights (features, earlier categories, bias).

    ``stands_for``: how many labelled rows a row of either label stands for; ``categories``: how many there are, ``toxic`` being the last.
    """
    sample = sorted((r | {c: np.array(r[c], np.int64) for c in ("features", "counts")} for r in sample if len(r["features"])), key=lambda r: crc32(str(r["doc_id"]).encode()))
    label = np.array([r["label"] for r in sample], float)
    if not len(sample) or label.min() == label.max():
        share = float(label.mean()) if len(sample) else 0.0
        return {"features": np.empty(0, np.int64), "weights": [], "share": share, "threshold": 0.5}
    weight = row_weights(label, stands_for)
    mix = float((weight * label).sum() / weight.sum())
    fold = np.arange(len(sample)) % FOLDS
    whole = View(sample, label, weight, np.ones(len(sample), bool))
    parts = [View(sample, label, weight, fold != k) for k in range(FOLDS)]

    def targets(view: View) -> np.ndarray:
        """1 for the toxic rows of each kind of ``whole``, as ``view`` tells kinds; the last column is the label."""
        to = [*matched_kinds(view.centres, whole.centres), -1]
        kind = np.array([to[view.kind(r)] if toxic else -1 for r, toxic in zip(sample, label, strict=True)])
        return np.column_stack((*((kind == j).astype(float) for j in range(categories - 1)), label))

    of_whole, of_parts = targets(whole), [targets(v) for v in parts]
    earlier, weights = np.zeros((len(sample), 0)), []
    for j in range(categories):
        odds = np.zeros(len(sample))
        for k, view in enumerate(parts):
            w = fit(view.rows, earlier, of_parts[k][:, j], weight * (fold != k))
            odds = np.where(fold == k, view.rows.times(w[: view.rows.width]) + earlier @ w[view.rows.width : -1] + w[-1], odds)
        weights.append(fit(whole.rows, earlier, of_whole[:, j], weight))
        earlier = np.column_stack((earlier, np.clip(odds, -12, 12) / 4))
    # The threshold of the last category's out-of-fold scores with the best F1.
    order = np.argsort(-odds, kind="stable")
    hits, taken = np.cumsum((weight * label)[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hits / (taken + hits[-1])))
    low = odds[order[min(best + 1, len(order) - 1)]]
    threshold = float(sigmoid(np.array((odds[order[best]] + low) / 2)))
    return {"features": whole.chosen, "weights": weights, "share": mix, "threshold": min(max(threshold, 0.05), 0.95)}


def scorer(model: dict):
    """A function text -> the categories' probabilities, in order."""
    place = {int(f): k for k, f in enumerate(model["features"])}
    known = Memo(lambda token: b"".join(place[f].to_bytes(2, "little") for f in word_features(token) if f in place), 150_000)
    wordless, none = [0.0] * len(CATEGORIES), [model["share"]] * len(CATEGORIES)

    def score(text: str | None) -> list[float]:
        tokens = (text or "").split()
        found = b"".join(map(known.__getitem__, tokens))
        if not found and not any(map(word_features, tokens)):
            return wordless
        if not model["weights"]:
            return none
        at, counts = np.unique(np.frombuffer(found, "<u2"), return_counts=True)
        x, odds = values(counts, len(tokens)), []
        for w in model["weights"]:
            k = len(odds)
            now = float(w[at] @ x) + sum(a * b for a, b in zip(w[len(place) : len(place) + k], odds, strict=True)) + float(w[-1])
            odds.append(min(max(now, -12.0), 12.0) / 4)
        return [float(sigmoid(np.array(4 * o))) for o in odds]

    return score


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label, one row for each labelled id: the larger of contradictory labels."""
    return labels.where(f"doc_id is not null and {label} is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))


def represented(labels: DataFrame, label: str, per_class: int = PER_CLASS) -> dict[int, float]:
    """How many labelled ids a row of :func:`training_sample` stands for, for each label: counted over all of ``labels``."""
    counts = known_labels(labels, label).where("label in (0, 1)").groupBy("label").count().collect()
    return {r["label"]: r["count"] / min(r["count"], per_class) for r in counts}


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text and label of at most ``per_class`` labelled documents of either kind, by a hash of the id."""
    known = known_labels(labels, label)
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * per_class ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, categories: int = KINDS + 1) -> dict:
    sample = arrow(
        training_sample(docs, labels, label, per_class),
        _counted,
        "doc_id long, label int, words long, features array<int>, counts array<int>",
    )
    rows = {}
    for r in sample.toLocalIterator():
        if r["doc_id"] not in rows:  # arrays, as lists of numbers take many times their memory
            lists = {c: np.array(r[c], np.int32) for c in ("features", "counts")}
            rows[r["doc_id"]] = {"doc_id": r["doc_id"], "label": r["label"], "words": r["words"]} | lists
    sample = list(rows.values())
    del rows
    model = train(sample, represented(labels, label, per_class), categories)
    del sample
    released()  # the driver lives on, with the model alone
    return model


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, a probability for each category, score (of ``toxic``), predicted."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            p = np.array([score(text) for text in batch.column("text").to_pylist()]).reshape(-1, len(CATEGORIES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(p[:, k].copy()) for k in range(len(CATEGORIES))), pa.array((p[:, -1] >= model["threshold"]).astype(np.int32))],
                ["doc_id", *(f"p_{c}" for c in CATEGORIES), "predicted"],
            )

    schema = f"doc_id long, {', '.join(f'p_{c} double' for c in CATEGORIES)}, predicted int"
    out = arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, schema)
    return out.withColumn("score", F.col(f"p_{CATEGORIES[-1]}")).select("doc_id", *(f"p_{c}" for c in CATEGORIES), "score", "predicted")


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that are not predicted to be toxic, with the columns of ``docs``."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([score(text)[-1] < model["threshold"] for text in batch.column("text").to_pylist()], pa.bool_()))

    return arrow(docs, kept, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fitted(docs, table(spark, sf_dir, "labels")))
