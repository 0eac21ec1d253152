"""Resharding by minimum-cost flow.

Given the sizes of the old shards and the capacities of the new ones, a minimum-cost flow decides how many
bytes each old shard hands to each new one: bytes that stay under their number cost nothing, bytes that move
cost one each. The flow is between shards, so that the problem that is solved has as many nodes as there are
shards, however large the corpus is.

An old shard's documents lie in blocks (by a hash of the id). Blocks are dealt to the old shard's outgoing
flows in order: a block within one flow's range of bytes moves whole, and only a block that straddles the
border of two flows is divided, by the running size of its documents. Blocks get more numerous as the corpus
grows, so no task orders more than a few tens of megabytes of ids.

Law: ``bytes``; sizes of new shards differ from their capacities by less than a document at each border.

Defined results: null text has size 1 and the CRC of no bytes; a null ``source`` belongs to old shard 0;
every row is placed, and the same row given twice takes two slots; an empty table gives an empty result;
other columns are ignored by the plan and carried along by :func:`rewrite`.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, table, text_or_empty, written

#: Rows that a block holds on average.
BLOCK_ROWS = 20_000


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """The flows (old, new) -> bytes of least cost, by successive shortest paths with potentials.

    Cost: 0 from i to i, else 1 a byte. The capacities must hold the supply.
    """
    n, m = len(supply), len(capacity)
    source, sink, size = n + m, n + m + 1, n + m + 2
    graph: list[list[int]] = [[] for _ in range(size)]
    arcs: list[list[int]] = []  # to, room, cost; the arc back is the next one

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(len(arcs))
        arcs.append([b, room, cost])
        graph[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    total = sum(supply)
    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    first = len(arcs)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, total, int(i != j))
    potential, sent = [0] * size, 0
    while sent < total:
        best, by = [None] * size, [-1] * size
        best[source], queue = 0, [(0, source)]
        while queue:
            d, a = heappop(queue)
            if d > best[a]:
                continue
            for k in graph[a]:
                b, room, cost = arcs[k]
                if room and (best[b] is None or d + cost + potential[a] - potential[b] < best[b]):
                    best[b], by[b] = d + cost + potential[a] - potential[b], k
                    heappush(queue, (best[b], b))
        if best[sink] is None:
            raise ValueError("the new shards cannot hold the old ones")
        potential = [p + d if d is not None else p for p, d in zip(potential, best, strict=True)]
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = arcs[by[at] ^ 1][0]
        room = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= room
            arcs[k ^ 1][1] += room
        sent += room
    return {(i, j): moved for i in range(n) for j in range(m) if (moved := arcs[first + 2 * (i * m + j) + 1][1])}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def cuts(flows: dict[tuple[int, int], int], old: int) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): the range of an old shard's bytes that goes to each new shard; what stays comes first."""
    out = []
    for i in range(old):
        at = 0
        for j in sorted((j for o, j in flows if o == i), key=lambda j: (j != i, j)):
            out.append((i, j, at, at + flows[i, j]))
            at += flows[i, j]
    return out


def place(docs: DataFrame, old: Column, shards: int = 16, old_shards: int = 16, capacities: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, block, shard and slot of every document."""
    spark = docs.sparkSession
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(old.cast("int"), F.lit(0)).alias("old_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "reshard-rows")
    strange = rows.where(~F.col("old_shard").between(0, old_shards - 1)).select("old_shard").limit(5).collect()
    if strange:
        raise ValueError(f"old shards beyond 0 to {old_shards - 1}: {sorted({r['old_shard'] for r in strange})}")
    sizes = {r["old_shard"]: (r["bytes"], r["n"]) for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    supply = [sizes.get(i, (0, 0))[0] for i in range(old_shards)]
    count = sum(n for _, n in sizes.values())
    flows = min_cost_flow(supply, capacities or even_capacities(sum(supply), shards))

    blocks = max(1, -(-count // (BLOCK_ROWS * old_shards)))
    most = max([1, *(n for _, n in sizes.values())])
    blocks = max(blocks, -(-most // BLOCK_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("int"))
    # Where each block's bytes begin in its old shard: one row for each block.
    in_shard = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("old_shard", "block")
        .agg(F.sum("size").alias("bytes"))
        .withColumn("start", F.coalesce(F.sum("bytes").over(in_shard), F.lit(0)))
        .drop("bytes")
    )
    running = Window.partitionBy("old_shard", "block").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("inside", F.coalesce(F.sum("size").over(running), F.lit(0))).join(starts, ["old_shard", "block"])
    # At most old + new shards - 1 ranges of an old shard's bytes: a fixed expression.
    ranges, shard = cuts(flows, old_shards), F.lit(0)
    position = F.col("start") + F.col("inside")
    for i, j, low, high in ranges:
        shard = F.when((F.col("old_shard") == i) & (position >= low) & (position < high), F.lit(j)).otherwise(shard)
    placed = written(at.select("doc_id", "size", "text_crc32", "old_shard", "block", shard.cast("int").alias("shard"), "row"), "reshard-placed")

    part = ["shard", "old_shard", "block"]
    before = (
        placed.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    within = F.row_number().over(Window.partitionBy(*part).orderBy("doc_id", "row")) - 1
    return placed.withColumn("within", within).join(before, part).withColumn("slot", (F.col("base") + F.col("within")).cast("long")).drop("base", "within", "row")


def _keyed(rows: DataFrame, key: list[str], order: list[str], slices: int) -> DataFrame:
    """``rows`` with ``__nth``, the place of each among those of equal ``key``.

    A key's rows are numbered in slices (by a hash of ``order``), so that no task orders all rows of a hot key.
    """
    rows = rows.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*key, "__slice").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(*key, "__slice").orderBy(*order))
    return rows.withColumn("__within", within).join(bases, [*key, "__slice"]).withColumn("__nth", F.col("__base") + F.col("__within")).drop("__base", "__within", "__slice")


def rewrite(docs: DataFrame, placed: DataFrame, path: str | None = None, old: Column | None = None) -> str:
    """Write the new shards' files, ``shard=N`` folders whose files are sorted by ``slot``; returns their folder.

    ``docs`` are the documents that were placed, ``old`` the column that gave their old shards. With it, only the
    shards of :func:`affected` are written: the others keep their old files. Without it every shard is.

    Each row goes to one slot, by id (null too), size and CRC of the text, and old shard. Where several rows agree in all of these
    (``repeated``), they are numbered on both sides, documents by a hash of all their columns, so that rows are told apart as
    far as they differ. A document moves once, to the task that writes it. Columns of ``docs`` named ``shard`` or ``slot`` give way to the plan's.
    """
    path = path or scratch_path(docs.sparkSession, "shards")
    text = text_or_empty()
    docs = docs.select(
        *(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"),
        F.col("doc_id").cast("long").isNull().alias("__none"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
        (F.lit(0) if old is None else F.coalesce(old.cast("int"), F.lit(0))).alias("__old"),
        F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType))).alias("__row"),
    )
    slots = placed.select(
        F.coalesce("doc_id", F.lit(0)).alias("__id"),
        F.col("doc_id").isNull().alias("__none"),
        F.col("size").alias("__size"),
        F.col("text_crc32").alias("__crc"),
        (F.lit(0) if old is None else F.col("old_shard")).alias("__old"),
        "shard",
        "slot",
    )
    if old is not None:
        changed = affected(placed)
        slots = slots.withColumn("__go", F.col("shard").isin(changed))
    else:
        slots = slots.withColumn("__go", F.lit(True))
    slots = written(slots, "reshard-slots")
    key = ["__id", "__none", "__size", "__crc", "__old"]
    repeated = written(slots.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"), "reshard-repeated")
    once = slots.join(repeated, key, "left_anti").where("__go")
    out = docs.join(once, key).drop(*key, "__row", "__go")
    if not repeated.isEmpty():
        slices = max(1, -(-slots.count() // BLOCK_ROWS))
        theirs = _keyed(slots.join(repeated, key, "left_semi"), key, ["shard", "slot"], slices)
        mine = _keyed(docs.join(repeated, key, "left_semi"), key, ["__row"], slices)
        out = out.unionByName(mine.join(theirs.select(*key, "__nth", "shard", "slot", "__go"), [*key, "__nth"]).where("__go").drop(*key, "__nth", "__row", "__go"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def affected(placed: DataFrame) -> list[int]:
    """The new shards whose files change: something came, or something went."""
    moved = placed.where("shard <> old_shard")
    both = moved.select(F.col("shard").alias("s")).unionByName(moved.select(F.col("old_shard").alias("s")))
    return sorted(r["s"] for r in both.distinct().collect())


def op2_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in old shards by their source (uneven); they are dealt evenly by bytes to 16 shards.

    The affected shards' files are written and the rows come from them; shards that nothing enters or leaves keep their place.
    """
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(16))
    placed = written(place(docs, old), "reshard-plan")
    changed = affected(placed)
    files = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(rewrite(docs, placed, old=old))
    text = text_or_empty()
    moved = files.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "slot")
    stay = placed.where(~F.col("shard").isin(changed)).select("doc_id", "size", "text_crc32", "shard", "slot")
    return moved.unionByName(stay).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
