"""A Merkle manifest of a dataset: one tree for each group of rows, one tree over the groups, and proofs for every row.

A row's *leaf* is a hash of its fields. The leaves of a group, in the order of their ids, are the lowest nodes of its tree;
every ``ARITY`` consecutive nodes become the hash of their hex digests, until one node, the group's *subroot*, is left. The
subroots, in the order of the groups, are the leaves of the top tree, whose last node is the *root*.

Work is by *superblocks*: ``ARITY ** HEIGHT`` consecutive nodes of one tree, whatever the size of the group, so that a group
that holds a third of all rows is many superblocks.

* Places: leaves are sorted by range over all groups; a place in the group is the row's place in its range less the place where the
  group's rows begin there, plus the group's rows in earlier ranges.
* Up: a superblock is reduced to one node in a task; its results are the nodes of the next *storey*, until every tree has one node,
  and the same goes on over the top tree. A storey has 1 / 729 of the rows of the one below (and one for each group at least).
* Down: the nodes of a storey and the *outer nodes* of their superblock (the siblings on the way from the superblock's own node
  to the root, one row for each superblock) are cogrouped by superblock. The task repeats the local reduction, takes each
  node's siblings inside the superblock and joins the outer ones to them: these are the outer nodes of the storey below. On
  the lowest storey it hashes the proof and folds the leaf that a reader has now along it.

Defined results: a null field counts as ``-``, any other as its length in UTF-8 bytes, a colon and the value, so that no two rows
have the same bytes by shifting a border; null groups are one group, which comes first; null ids come first in
their group; rows that share group and id are ordered by their leaf, and repeated rows, which have equal leaves, in any order; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shipped, table, written

ARITY, HEIGHT = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The hash of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def node(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def ladder(nodes: list[str], size: int, height: int) -> list[list[str]]:
    """The nodes of a superblock of a tree with ``size`` nodes, level by level: until the tree has one node, ``height`` levels at most."""
    levels = [nodes]
    while len(levels) <= height and ARITY ** (len(levels) - 1) < size:
        levels.append([node(levels[-1][i : i + ARITY]) for i in range(0, len(levels[-1]), ARITY)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """For each level, what stands left and right of the node ``at`` or of its ancestor in its run."""
    out = []
    for level in levels[:-1]:
        first = at - at % ARITY
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + ARITY])))
        at //= ARITY
    return out


def _written(steps: list[tuple[str, str]]) -> str:
    return ",".join(f"{left}|{right}" for left, right in steps)


def _steps(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split("|")) for x in text.split(",")] if text else []


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0) and ``size``: their place in their tree by ``order``, and the tree's number of rows."""
    ranges = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", F.monotonically_increasing_id())
    ranges = written(ranges, "merkle-ranges").withColumn("part", F.shiftright("at", 33))
    counts = ranges.groupBy(F.col(tree).alias("of"), F.col("part").alias("of_part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("of")
    before = F.coalesce(F.sum("n").over(whole.orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.withColumn("before", before).withColumn("size", F.sum("n").over(whole)).drop("n"), "merkle-counts")
    joined = ranges.join(counts, F.col(tree).eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return joined.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "of", "of_part", "first", "before")


def _block(height: int) -> Column:
    return F.expr(f"pos div {ARITY**height}").alias("block")


def raised(nodes: DataFrame, height: int) -> DataFrame:
    """The next storey of (tree, pos, size, h): one node for each superblock."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size = int(rows["size"].iloc[0])
        top = ladder([x.hex() for x in rows["h"]], size, height)[-1]
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "pos": [rows["block"].iloc[0]], "size": [-(-size // ARITY**height)], "h": [bytes.fromhex(top[0])]})

    shipped(nodes.sparkSession)
    return written(nodes.select("tree", "pos", "size", "h", _block(height)).groupBy("tree", "block").applyInPandas(reduce, "tree long, pos long, size long, h binary"), "merkle-storey")


def storeys_of(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` and all storeys above them, up to the one with a single node for each tree."""
    out = [nodes]
    while (out[-1].agg(F.max("size")).first()[0] or 0) > 1:
        out.append(raised(out[-1], height))
    return out


def lowered(nodes: DataFrame, outer: DataFrame, height: int, make: Callable[[dict, list[list[str]], int, dict], dict], schema: str) -> DataFrame:
    """Cogroup a storey's nodes with the outer nodes (tree, pos of the superblock, ...) and make a row of each node.

    ``make`` gets the node's row, the superblock's levels, the node's place in the superblock and the outer row.
    """

    def meet(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, way = rows.sort_values("pos"), above.to_dict("records")[0]
        levels = ladder([x.hex() for x in rows["h"]], int(rows["size"].iloc[0]), height)
        return pd.DataFrame([make(row, levels, k, way) for k, row in enumerate(rows.to_dict("records"))])

    shipped(nodes.sparkSession)
    left = nodes.withColumn("block", _block(height)).groupBy("tree", "block")
    return left.cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(meet, schema)


_WAY = "tree long, pos long, subroot binary, way string"


def _way(row: dict, levels: list[list[str]], k: int, above: dict) -> dict:
    own = siblings(levels, k)
    return {"tree": row["tree"], "pos": row["pos"], "subroot": above["subroot"] or row["h"], "way": ",".join(filter(None, [_written(own), above["way"]]))}


def _proof(row: dict, levels: list[list[str]], k: int, above: dict) -> dict:
    steps = siblings(levels, k) + _steps(above["way"])
    folded = row["now"].hex()
    for left, right in steps:
        folded = node([left, folded, right])
    return {"id": None if pd.isna(row["id"]) else str(row["id"]), "leaf": row["h"].hex(), "subroot": above["subroot"].hex(), "proof": node([left + right for left, right in steps]), "folded": folded}


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for rows of (doc_id, grp, h: leaf, now: the leaf of what a reader has)."""
    spark = rows.sparkSession
    rows = written(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "grp", "h", "now"), "merkle-leaves")
    groups = rows.groupBy("grp").agg(F.lit(0).cast("long").alias("tree"))
    groups = placed(groups, "tree", ["grp"]).select(F.col("grp").alias("of"), F.col("pos").alias("tree"), F.col("size").alias("trees"))
    groups = written(groups, "merkle-groups")
    leaves = placed(rows, "grp", ["doc_id", "h"])
    leaves = written(leaves.join(groups, F.col("grp").eqNullSafe(F.col("of"))).select("tree", "pos", "size", F.col("doc_id").cast("string").alias("id"), "h", "now"), "merkle-placed")
    low = storeys_of(leaves.drop("id", "now"), height)
    tops = low[-1].join(groups.select("tree", "trees"), "tree")
    high = storeys_of(written(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("size"), "h"), "merkle-subroots"), height)
    top = high[-1].first()
    root = top["h"].hex() if top else None
    way = high[-1].select("tree", "pos", F.lit(None).cast("binary").alias("subroot"), F.lit("").alias("way"))
    for nodes in reversed(high[:-1]):
        way = written(lowered(nodes, way, height, _way, _WAY).withColumn("subroot", F.lit(None).cast("binary")), "merkle-outer")
    # The top tree's leaves are the last nodes of the groups' trees.
    way = written(way.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "way").join(low[-1].select("tree", F.col("h").alias("subroot")), "tree").select("tree", "pos", "subroot", "way"), "merkle-outer")
    for nodes in reversed(low[1:-1]):
        way = written(lowered(nodes, way, height, _way, _WAY), "merkle-outer")
    out = lowered(leaves, way, height, _proof, "id string, leaf string, subroot string, proof string, folded string")
    return out.select(
        F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", F.lit(root).alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(root)).alias("verified")
    )


def leaves_of(docs: DataFrame, now: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source") -> DataFrame:
    """What :func:`manifest` takes, of a table; ``now``: the text that a reader has instead of the written one."""
    columns = [F.col(f"`{c}`") for c in fields]
    later = [now if now is not None and c == "text" else F.col(f"`{c}`") for c in fields]
    return docs.select("doc_id", F.col(f"`{group}`").cast("string").alias("grp"), leaf(*columns).alias("h"), leaf(*later).alias("now"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(leaves_of(table(spark, sf_dir, "documents"), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))))


_H = "sha256(string_agg(h, '' ORDER BY pos))"
_CRC = """list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: 0::BIGINT)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
)"""


def _field(column: str, text: str | None = None) -> str:
    text = text or f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


_ROW = " || ".join(map(_field, FIELDS[:-1]))

OP13_SQL = f"""
WITH RECURSIVE l AS (
    SELECT doc_id, source, sha256({_ROW} || {_field("text")}) AS leaf,
        CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN sha256({_ROW} || {_field("text", "replace(text, chr(10), '')")}) ELSE sha256({_ROW} || {_field("text")}) END AS now,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM documents
),
low AS (
    SELECT 0 AS lvl, tree, pos, n, leaf AS h FROM l
    UNION ALL
    SELECT any_value(lvl) + 1, tree, pos // 3, (any_value(n) + 2) // 3, {_H} FROM low WHERE n > 1 GROUP BY tree, pos // 3
),
subroots AS (SELECT tree, h, lvl, count(*) OVER () AS trees FROM low WHERE n = 1),
high AS (
    SELECT 0 AS lvl, tree AS pos, trees AS n, h FROM subroots
    UNION ALL
    SELECT any_value(lvl) + 1, pos // 3, (any_value(n) + 2) // 3, {_H} FROM high WHERE n > 1 GROUP BY pos // 3
),
steps AS (
    SELECT l.doc_id, x.lvl AS lvl, string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < l.pos // pow(3, x.lvl)::BIGINT) AS lft, string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > l.pos // pow(3, x.lvl)::BIGINT) AS rgt
    FROM l JOIN low x ON x.tree = l.tree AND x.n > 1 AND x.pos // 3 = l.pos // pow(3, x.lvl + 1)::BIGINT GROUP BY ALL
    UNION ALL
    SELECT l.doc_id, 100 + x.lvl, string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < l.tree // pow(3, x.lvl)::BIGINT), string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > l.tree // pow(3, x.lvl)::BIGINT)
    FROM l JOIN high x ON x.n > 1 AND x.pos // 3 = l.tree // pow(3, x.lvl + 1)::BIGINT GROUP BY ALL
),
ways AS (SELECT doc_id, coalesce(lft, '') AS lft, coalesce(rgt, '') AS rgt, row_number() OVER (PARTITION BY doc_id ORDER BY lvl) AS step, count(*) OVER (PARTITION BY doc_id) AS n FROM steps),
fold AS (
    SELECT doc_id, 0 AS step, now AS h FROM l
    UNION ALL
    SELECT f.doc_id, f.step + 1, sha256(w.lft || f.h || w.rgt) FROM fold f JOIN ways w ON w.doc_id = f.doc_id AND w.step = f.step + 1
),
folded AS (SELECT doc_id, arg_max(h, step) AS h FROM fold GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS h FROM ways GROUP BY doc_id),
root AS (SELECT h FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, coalesce(p.h, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM l JOIN subroots s USING (tree) CROSS JOIN root r JOIN folded f USING (doc_id) LEFT JOIN proofs p USING (doc_id)
"""
