"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by K floors of (a . v + b) / w with normal a (stable for Euclidean distance); equal
floors share a bucket. A query visits its own bucket and then perturbed ones (one floor up or down in some
of the K), in the order of the estimated chance that a near vector lies there: the squared distances from
the query's projections to the borders that are crossed, summed (Lv et al., 2007). Candidates of all tables
are merged and ranked by their exact distance.

K, w and the number of probes are fitted on a bounded sample (``SAMPLE`` vectors, ``PROBES_FOR`` of them as
queries), but against the neighbours that these queries have among *all* vectors, which one pass finds. Of the
settings whose buckets hold ``RECALL`` of those neighbours, the one that looks at the smallest share of the
vectors is taken (of equal ones the first); where none does, the one that holds most of them. As neighbours
come nearer while the table grows, so do the buckets that the fit can afford. Every vector is indexed. Queries
whose buckets hold fewer than k candidates, while the table has more, are compared with all vectors in blocks;
so are all queries with ``exact=True``.

Equal vectors are one class for the search, known by its smallest ids, so that a vector that is a third of
all rows is compared once. A bucket is held in blocks of about ``BLOCK`` vectors; a query visits all of them.

Defined results: vectors that are null, zero, hold null or non-finite components, or differ in length from
the most common one, take no part; nor do rows without id; of rows with the same id one counts (by a hash of the
vector); an empty table gives an empty result; fewer candidates than k give as many ranks; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, table, written

TABLES, SAMPLE, PROBES_FOR, RECALL, BLOCK = 2, 4000, 100, 0.96, 4096
#: The one bucket that holds all vectors.
EXACT = {"hashes": 0, "width": 1.0, "probes": 1, "tables": 1}
_SEED = 7


def perturbations(x: np.ndarray, probes: int) -> list[list[int]]:
    """The first ``probes`` sets of border crossings by rising score; 2k is one down, 2k + 1 one up, in hash k.

    x: how far each projection is above its floor, in widths.
    """
    score = np.empty(2 * len(x))
    score[0::2], score[1::2] = x**2, (1 - x) ** 2
    order = np.argsort(score, kind="stable")
    s = score[order].tolist()
    out: list[list[int]] = [[]]
    heap = [(s[0], [0])]
    while heap and len(out) < probes:
        total, chosen = heappop(heap)
        moves = [int(order[k]) for k in chosen]
        if len({m // 2 for m in moves}) == len(moves):  # not both up and down
            out.append(moves)
        last = chosen[-1]
        if last + 1 < len(s):
            heappush(heap, (total - s[last] + s[last + 1], chosen[:-1] + [last + 1]))
            heappush(heap, (total + s[last + 1], [*chosen, last + 1]))
    return out


class Index:
    """The hash functions of all tables."""

    def __init__(self, dimensions: int, hashes: int, width: float, probes: int, tables: int = TABLES):
        random = np.random.RandomState(_SEED)
        self.hashes, self.width, self.probes, self.tables = hashes, width, probes, tables
        self.a = random.randn(tables, dimensions, hashes)
        self.b = random.rand(tables, hashes) * width
        self.mix = random.randint(1, 1 << 62, (tables, hashes + 1)).astype(np.int64) * 2 + 1

    def _bucket(self, t: int, floors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (floors.astype(np.int64) * self.mix[t, :-1]).sum(axis=-1) + self.mix[t, -1]

    def _projected(self, t: int, v: np.ndarray) -> np.ndarray:
        return (v @ self.a[t] + self.b[t]) / self.width

    def buckets(self, v: np.ndarray) -> np.ndarray:
        """tables x vectors."""
        if not self.hashes:
            return np.zeros((self.tables, len(v)), np.int64)
        return np.stack([self._bucket(t, np.floor(self._projected(t, v))) for t in range(self.tables)])

    def visited(self, v: np.ndarray) -> Iterator[np.ndarray]:
        """For each vector its buckets of all tables, best first within each."""
        for q in v:
            if not self.hashes:
                yield np.zeros(1, np.int64)
                continue
            found = []
            for t in range(self.tables):
                p = self._projected(t, q)
                floors = np.floor(p)
                moves = np.zeros((self.probes, self.hashes), np.int64)
                sets = perturbations(p - floors, self.probes)
                for row, chosen in zip(moves, sets):
                    for m in chosen:
                        row[m // 2] += 1 if m % 2 else -1
                found.append(self._bucket(t, floors.astype(np.int64) + moves[: len(sets)]))
            yield np.unique(np.concatenate(found))


def fit(sample: np.ndarray, queries: np.ndarray, near: list[np.ndarray]) -> dict:
    """hashes, width and probes that hold enough of the queries' neighbours while looking at few of a sample's vectors.

    near: the neighbours' vectors, for each query.
    """
    if not len(queries) or not sum(map(len, near)):
        return {"hashes": 2, "width": 1.0, "probes": 1, "tables": TABLES}
    farthest = [np.sqrt(((n - q) ** 2).sum(axis=1).max()) for q, n in zip(queries, near, strict=True) if len(n)]
    radius = max(float(np.median(farthest)), 1e-6)
    of = np.repeat(np.arange(len(queries)), [len(n) for n in near])
    others = np.concatenate([n for n in near if len(n)])
    best, least, most_held = None, np.inf, -1
    for hashes in (2, 4, 6, 8, 12, 16, 20, 24):
        for wide in (1.0, 1.5, 2.0, 3.0):
            widest = Index(sample.shape[1], hashes, radius * wide, min(64, 3**hashes))
            own, theirs = widest.buckets(sample), widest.buckets(others)
            for probes in (p for p in (1, 4, 16, 64) if p <= widest.probes):
                index = Index(sample.shape[1], hashes, radius * wide, probes)
                held = looked = 0
                for q, seen in enumerate(index.visited(queries)):
                    held += int(np.isin(theirs[:, of == q], seen).any(axis=0).sum())
                    if held < 0.8 * RECALL * (of <= q).sum() and q >= len(queries) // 4:
                        break
                    looked += int(np.isin(own, seen).any(axis=0).sum())
                else:
                    enough = held >= RECALL * len(others)
                    share = looked / len(queries) / len(sample)
                    if (enough and share < least) or (not np.isfinite(least) and held > most_held):
                        best = {"hashes": hashes, "width": radius * wide, "probes": probes, "tables": TABLES}
                        least, most_held = share if enough else np.inf, held
                    if enough:
                        break
    return best or EXACT


def nearest(block: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, id, exact distance) of the k nearest of a block for each query (own class included).

    Products of matrices choose what is measured exactly: all that is as near as the k-th, within the products'
    rounding error, so that ties at the k-th place are decided by id.
    """
    size, sizes = (queries**2).sum(1), (block**2).sum(1)
    rough = size[:, None] + sizes - 2 * queries @ block.T
    if k < len(block):
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        error = 1e-15 * (8 + block.shape[1]) * (size + sizes.max())
        number, some = np.nonzero(rough <= (kth + 2 * error)[:, None])
    else:
        number, some = (x.ravel() for x in np.indices(rough.shape))
    exact = np.empty(len(number))
    for i in range(0, len(number), 1 << 15):
        part = slice(i, i + (1 << 15))
        exact[part] = np.sqrt(((queries[number[part]] - block[some[part]]) ** 2).sum(axis=1))
    order = np.lexsort((ids[some], exact, number))
    number = number[order]
    first = np.searchsorted(number, np.arange(len(queries)))
    take = np.arange(len(number)) - first[number] < k
    return number[take], ids[some][order][take], exact[order][take]


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_column: str = "vec_id", column: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score for the rows where ``is_query`` holds, against all other rows.

    ``exact``: compare every query with every vector, in blocks, and hash nothing.
    """
    element = vectors.schema[column].dataType.elementType.simpleString()
    kind, size = ("<f4", 4) if element == "float" else ("<f8", 8)
    v = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("v") if size == 4 else F.col(column).cast("array<double>").alias("v"))
    unfit = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = v.where("id is not null and v is not null").where(~unfit & F.exists("v", lambda x: x != 0))
    common = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimensions = common[0]["n"] if common else 1
    valid = valid.where(F.size("v") == dimensions).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))

    # Of an id with several vectors the one of the smallest hashes counts; such ids are few, so Spark broadcasts them.
    pair = F.struct("h1", "h2")
    several = valid.groupBy("id").agg(F.min(pair).alias("low"), F.max(pair).alias("high")).where("low <> high").select(F.col("id").alias("of"), "low")
    valid = valid.join(several, F.col("id") == F.col("of"), "left").where(F.col("low").isNull() | (pair == F.col("low"))).drop("of", "low")

    # Classes of equal vectors, with their k + 1 smallest ids: what ranks ids drops the others before the shuffle.
    first = Window.partitionBy("h1", "h2").orderBy("id")
    few = valid.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = written(few.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.array_sort(F.collect_set("id")).alias("members"), F.first("v").alias("v")), "vector-classes")
    asked = written(valid.where(is_query(F.col("id"))).select("id", "h1", "h2").join(classes.select("h1", "h2", "class"), ["h1", "h2"]).select(F.col("id").alias("query_id"), F.col("class").alias("query")).distinct(), "query-classes")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column("v").flatten(), kind).reshape(-1, dimensions)

    def fitted() -> dict:
        sample = classes.select("class", "v", F.xxhash64("class").alias("h")).orderBy("h", "class").limit(SAMPLE).collect()
        drawn = np.array([r["v"] for r in sample], np.float64).reshape(-1, dimensions)
        asking, own = drawn[:PROBES_FOR], np.array([r["class"] for r in sample[:PROBES_FOR]], np.int64)

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The k + 1 nearest of each batch to the drawn queries."""
            for batch in batches:
                if batch.num_rows:
                    data, ids = matrix(batch), batch.column("class").to_numpy()
                    n, found, score = nearest(data.astype(np.float64), np.arange(len(ids)), asking, k + 1)
                    keep = ids[found] != own[n]
                    yield pa.RecordBatch.from_arrays([pa.array(n[keep], pa.int32()), pa.array(score[keep]), pa.array(ids[found[keep]]), pa.array([x.tobytes() for x in data[found[keep]]], pa.binary())], ["query", "score", "class", "v"])

        by_score = Window.partitionBy("query").orderBy("score", "class")
        close = arrow(classes.select("class", "v"), beside, "query int, score double, class long, v binary").withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k)
        near: list[list] = [[] for _ in asking]
        for r in close.select("query", "v").collect():  # k rows for each of the drawn queries
            near[r["query"]].append(np.frombuffer(r["v"], kind).astype(np.float64))
        return fit(drawn, asking, [np.array(x).reshape(-1, dimensions) for x in near])

    def ranked(asked: DataFrame, setting: dict) -> DataFrame:
        return _ranked(classes, asked, setting, dimensions, kind, k)

    if exact:
        return _answers(ranked(asked, EXACT), k)
    found = written(ranked(asked, fitted()), "vector-lists")
    # A query whose buckets held too few candidates meets all vectors.
    few_found = found.where(F.size("found") < F.lit(k)).select("query_id")
    unmet = asked.join(found.select("query_id"), "query_id", "left_anti").select("query_id").unionByName(few_found)
    short = written(asked.join(unmet, "query_id", "left_semi"), "short-queries")
    if short.isEmpty():
        return _answers(found, k)
    again = ranked(short, EXACT)
    return _answers(found.join(short.select("query_id"), "query_id", "left_anti").unionByName(again), k)


def _answers(found: DataFrame, k: int) -> DataFrame:
    """A row for each rank, of query_id and found (score, vec_id) in order."""
    each = found.select("query_id", F.posexplode("found").alias("n", "x"))
    return each.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _ranked(classes: DataFrame, asked: DataFrame, setting: dict, dimensions: int, kind: str, k: int) -> DataFrame:
    """query_id and found: an array of (score, vec_id), the k nearest of the buckets that each query visits."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(dimensions, **setting)
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.asarray(batch.column("v").flatten(), kind).reshape(-1, dimensions)
            raw, ids, query = [x.tobytes() for x in data], batch.column("class").to_pylist(), batch.column("query").to_pylist()
            for found in index.buckets(data.astype(np.float64)):
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.zeros(len(ids), bool)), pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["bucket", "asks", "class", "v"])
            at = [n for n, q in enumerate(query) if q]
            out: list[list] = [[], [], []]
            for n, seen in zip(at, index.visited(data[at].astype(np.float64)), strict=True):
                out[0] += seen.tolist()
                out[1] += [ids[n]] * len(seen)
                out[2] += [raw[n]] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(np.ones(len(out[0]), bool)), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["bucket", "asks", "class", "v"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (bucket, block, asks): a block's vectors, then the queries that visit it."""
        key, block, ids, queries, asking = None, [], [], [], []

        def answers() -> Iterator[pa.RecordBatch]:
            if queries and ids:
                m, i = np.frombuffer(b"".join(block), kind).reshape(len(ids), -1).astype(np.float64), np.array(ids)
                q, own = np.frombuffer(b"".join(queries), kind).reshape(len(asking), -1).astype(np.float64), np.array(asking)
                n, found, score = nearest(m, i, q, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(own[n]), pa.array(found), pa.array(score)], ["query", "class", "score"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "block", "asks", "class", "v")]
            for bucket, part, asks, one, raw in zip(*columns, strict=True):
                if (bucket, part) != key:
                    yield from answers()
                    key, block, ids, queries, asking = (bucket, part), [], [], [], []
                if asks:
                    queries.append(raw)
                    asking.append(one)
                    if len(asking) == 256:
                        yield from answers()
                        queries, asking = [], []
                else:
                    block.append(raw)
                    ids.append(one)
        yield from answers()

    marked = classes.select("class", "v").join(asked.select(F.col("query").alias("class")).distinct().withColumn("query", F.lit(True)), "class", "left")
    rows = arrow(marked.select("class", "v", F.coalesce("query", F.lit(False)).alias("query")), cells, "bucket long, asks boolean, class long, v binary")
    rows = written(rows, "vector-cells")
    large = rows.where("not asks").groupBy("bucket").count().where(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), "blocks").cast("int")))))
    dealt = dealt.drop("blocks").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks")
    pairs = arrow(dealt, compared, "query long, class long, score double").distinct()
    by_score = Window.partitionBy("query").orderBy("score", "class")
    top = pairs.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1).drop("n")

    # Classes become rows again.
    members = top.join(classes.select("class", "members"), "class").select("query", "score", F.explode("members").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy("score", "vec_id")
    best = members.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    return asked.join(lists, "query").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))


def op1_multiprobe_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)
