"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes) and a signature of 128 minima.
   Texts of equal sets form a *class*, which has a number from here on, and its smallest ``doc_id`` at the end.
2. Signatures are cut into 32 bands of 4. Classes that agree in a band share a bucket. At a similarity of
   0.75 two classes share none with probability (1 - 0.75^4)^32, about 5e-6.
3. Candidates are compared in three rounds, none of which pairs up what is already connected:
   each bucket's smallest member with the others; then one drawn by hash with those not yet connected to it;
   then all that are still in different components, in blocks of a bucket against blocks, inside tasks that
   return links only. The last round makes the search complete; the first two join most of a bucket of many
   near copies in linear work.
4. A candidate's signatures are compared 16 minima at a time. Under a uniform prior the posterior chance
   of a similarity of 0.75 or more is a binomial tail; when it falls below ``MISS`` the pair is dropped.
5. Survivors are verified on their full sets: 100 * intersection >= 75 * union.
6. Links are joined into components.

Defined results: null or empty text has no shingles and stands alone; fewer than five words are one shingle;
a null ``doc_id`` takes no part in links of its own but belongs to the component of an equal text, if any;
the same row given twice gets the same component twice; rows that share a ``doc_id`` but not the text are
documents of their own, each in its text's component; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, arrow, table, unused, written
from .components import components

WORDS, MINIMA, BANDS, STEP, MISS = 5, 128, 32, 16, 1e-6
#: Members of a bucket that the last round compares as one block, pairs and shingles taken at a time.
BLOCK, PAIRS, COLUMNS = 512, 1 << 18, 4096

_RANDOM = np.random.RandomState(20240229)
_MULTIPLY = _RANDOM.randint(0, 1 << 62, MINIMA).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.randint(0, 1 << 62, MINIMA).astype(np.uint64)
_OF_WORD = _RANDOM.randint(0, 1 << 62, WORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@cache
def _words() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 50_000)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h ^ (h >> np.uint64(32))) * _MIX


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        return _mixed((h * _OF_WORD[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - WORDS + 1
    total = h[:n] * _OF_WORD[0]
    for k in range(1, WORDS):
        total += h[k : n + k] * _OF_WORD[k]
    return np.unique(_mixed(total))


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 512):
        x = s[None, i : i + 512] * _MULTIPLY[:, None]
        x += _ADD[:, None]
        np.minimum(low, x.min(axis=1) >> np.uint64(32), out=low)
    return low.astype("<u4")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, high, lower, signs = [], [], [], []
        for value in batch.column("text"):
            s = shingles(value.as_py())
            count.append(len(s))
            d = xxhash.xxh3_128_digest(s.tobytes())
            high.append(int.from_bytes(d[:8], "little", signed=True))
            lower.append(int.from_bytes(d[8:], "little", signed=True))
            signs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(count, pa.int64()), pa.array(high, pa.int64()), pa.array(lower, pa.int64()), pa.array(signs, pa.binary())],
            ["doc_id", "text_hash", "n_shingles", "high", "low", "signature"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = MINIMA // BANDS
    salt = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX)
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, BANDS, rows).astype(np.uint64)
        bucket = np.broadcast_to(salt, signs.shape[:2]).copy()
        for k in range(rows):
            bucket = _mixed(bucket ^ (signs[:, :, k] + _OF_WORD[k]))
        ids = np.repeat(batch.column("id").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1).view(np.int64)), pa.array(ids)], ["bucket", "id"])


@cache
def least_matches(n: int) -> int:
    """The fewest equal minima of ``n`` for which the posterior chance of a similarity >= 0.75 is ``MISS`` or more.

    With m of n equal and a uniform prior, that chance is the chance that n + 1 draws of 0.75 hit at most m times.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * 0.75**m * 0.25 ** (n + 1 - m)
        if tail >= MISS:
            return m
    return n


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, MINIMA) for c in ("left", "right"))
        alive, equal = np.arange(len(left)), np.zeros(len(left), np.int64)
        for n in range(STEP, MINIMA + 1, STEP):
            equal[alive] += (left[alive, n - STEP : n] == right[alive, n - STEP : n]).sum(axis=1)
            alive = alive[equal[alive] >= least_matches(n)]
        yield batch.select(["a", "b"]).take(pa.array(alive))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        keep = []
        for i, (a, left, right) in enumerate(zip(batch.column("a").to_pylist(), batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)):
            if last[0] != a:
                last = (a, shingles(left))
            s, t = last[1], shingles(right)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= 75 * (len(s) + len(t) - both):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "set"])


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, by products of 0-1 matrices over the shingles that both sides have."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def matrix(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(columns)), np.float32)
        for row, s in zip(m, sets, strict=True):
            row[np.isin(columns, s, assume_unique=True)] = 1
        return m

    for k in range(0, len(both), COLUMNS):
        columns = both[k : k + COLUMNS]
        out += matrix(left, columns) @ matrix(right, columns).T
    return out


def _block_links(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """The links between members of block i and of block j that are in different components."""
    left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    if not len(left) or not len(right):
        return []
    apart = component[left][:, None] != component[right][None, :]
    if i == j:
        apart &= ids[left][:, None] < ids[right][None, :]
    x, y = np.nonzero(apart)
    if not len(x):
        return []
    signs = np.stack([signature(s) for s in sets])
    alive = []
    for k in range(0, len(x), PAIRS):
        a, b = left[x[k : k + PAIRS]], right[y[k : k + PAIRS]]
        equal = np.zeros(len(a), np.int64)
        for n in range(STEP, MINIMA + 1, STEP):
            equal += (signs[a, n - STEP : n] == signs[b, n - STEP : n]).sum(axis=1)
            go = equal >= least_matches(n)
            a, b, equal = a[go], b[go], equal[go]
        alive.append((a, b))
    a, b = (np.concatenate(c) for c in zip(*alive, strict=True))
    if not len(a):
        return []
    rows, row = np.unique(a, return_inverse=True)
    columns, column = np.unique(b, return_inverse=True)
    both = _common([sets[k] for k in rows], [sets[k] for k in columns])[row, column]
    sizes = np.array([len(s) for s in sets])
    linked = 100 * both >= 75 * (sizes[a] + sizes[b] - both)
    return [(min(p, q), max(p, q)) for p, q in zip(ids[a[linked]].tolist(), ids[b[linked]].tolist(), strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, i, j); each group is at most two blocks."""
    held: list[tuple] = []
    key = None

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            ids, component, blocks, sets = zip(*held, strict=True)
            found = _block_links(np.array(ids), np.array(component), [np.frombuffer(s, np.uint64) for s in sets], np.array(blocks), key[1], key[2])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "id", "component", "block", "set")]
        for bucket, i, j, *row in zip(*columns, strict=True):
            if (bucket, i, j) != key:
                yield from done()
                held, key = [], (bucket, i, j)
            held.append(tuple(row))
    yield from done()


def _links(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are links. known: id, signature, text."""
    pairs = written(pairs, "pairs")

    def beside(pairs: DataFrame, what: str) -> DataFrame:
        side = known.select("id", what)
        with_left = pairs.join(side.select(F.col("id").alias("b"), F.col(what).alias("right")), "b")
        return with_left.join(side.select(F.col("id").alias("a"), F.col(what).alias("left")), "a").select("a", "b", "left", "right")

    likely = written(arrow(beside(pairs, "signature"), _prune, "a long, b long"), "likely")
    return written(arrow(beside(likely, "text"), _verify, "a long, b long"), "links")


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    found = written(arrow(docs, _features, "doc_id long, text_hash long, n_shingles long, high long, low long, signature binary"), "shingle-features")
    key = ["n_shingles", "high", "low"]
    # A class is a number that its row gets when it is written; one of its documents lends signature and text.
    with_set = found.where("n_shingles > 0 and doc_id is not null")
    first = with_set.groupBy(*key).agg(F.min("doc_id").alias("doc_id"))
    lenders = with_set.join(first, [*key, "doc_id"], "left_semi").dropDuplicates([*key, "doc_id"])
    classes = written(lenders.select(F.monotonically_increasing_id().alias("id"), *key, F.col("doc_id").alias("first_id"), "text_hash", "signature"), "shingle-classes")
    signs = classes.select("id", "signature")
    rows = arrow(signs, _bands, "bucket long, id long")

    drawn = F.struct(F.xxhash64("id", "bucket").alias("h"), "id")
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot"), F.min(drawn).alias("drawn")).where("n > 1")
    members = written(rows.join(buckets.select("bucket", "n", "pivot", F.col("drawn.id").alias("drawn")), "bucket"), "bucket-members")
    involved = members.select("id").distinct()
    lent = classes.join(involved, "id", "left_semi").select("id", F.col("first_id").alias("doc_id"), "text_hash", "signature")
    known = written(docs.join(lent, ["doc_id", "text_hash"]).dropDuplicates(["id"]).select("id", "signature", "text"), "candidates")

    def pair(rows: DataFrame, x: str, y: str) -> DataFrame:
        return rows.where(f"{x} <> {y}").select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    links = _links(pair(members, "id", "pivot"), known)
    labels = written(components(links), "labels")
    for last in (False, True):
        placed = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if last:  # these two have met all others of their bucket
            placed = placed.where("id <> pivot and id <> drawn")
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("bucket")
        open_ = placed.join(mixed, "bucket", "left_semi")
        if last:
            open_ = written(open_.select("bucket", "id", "component", "n"), "open-members")
            if open_.isEmpty():
                break
            # Block i meets block j once, for i <= j; the copies of a row number as many as its bucket has blocks.
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            dealt = open_.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            sets = arrow(known.join(open_.select("id").distinct(), "id", "left_semi").select("id", "text"), _sets, "id long, set binary")
            met = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "block").join(sets, "id")
            met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            more = written(arrow(met, _blocks, "a long, b long").distinct(), "links")
        else:
            other = open_.select("id", "drawn", "component").join(labels.select(F.col("id").alias("drawn"), F.col("component").alias("of")), "drawn", "left")
            more = _links(pair(other.where(F.col("component") != F.coalesce("of", "drawn")), "id", "drawn"), known)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = written(components(links), "labels")

    joined = labels.join(classes.select("id", "first_id"), "id")
    least = joined.groupBy("component").agg(F.min("first_id").alias("least"))
    of_class = classes.join(joined.join(least, "component").select("id", "least"), "id", "left").select(*key, F.coalesce("least", "first_id").alias("component"))
    out = found.select("doc_id", "text_hash", *key).join(of_class, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return _placed(docs).drop("text_hash")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each component, with the columns of ``docs``; rows without ``doc_id`` stay.

    A row goes by its id and text together, so that one that shares its id with a near copy of another stays; rows
    of one component that share the id that stays stay together.
    """
    id_, hash_ = unused(docs, "gone_id", "gone_hash")
    gone = _placed(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    of = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(id_)) & (of == F.col(hash_)), "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
