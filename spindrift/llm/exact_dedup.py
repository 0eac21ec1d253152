"""Exact dedup by a log-structured merge index over digests, in DataFrame operations only.

* A *memtable* is what a task holds while it aggregates a batch's entries by digest: one entry for each digest,
  with the number of documents and the one that ranks first. It is flushed as a sorted *run*, a Parquet folder of
  the log. Each run has a *filter*, a bitmap over hashed digests in pages of ``PAGE`` bits, and the log remembers
  how many pages its filters have, so that a filter has some 16 bits for each entry.
* *Probing* looks the entries of each run up in the filters of the other runs. An entry that no other filter
  knows is alone and passes into the index as it is.
* *Compaction* merges the entries that some filter knows: of every digest it keeps one, with the summed number of
  documents and the smallest identifier of those that rank first. A log takes further batches at any time
  (:func:`append`); its next compaction covers all of them.
* *Hits* are documents whose digest more than one document has. Their normalised bytes are compared by
  grouping on digest and bytes together; equal digests of different bytes (not known to exist for SHA-256)
  would be told apart by their bytes.

A group may hold a third of all rows. Every aggregate combines in the map tasks first, so that such a
group sends a row for each task; a digest occurs once in a run, so that probing meets no hot key; the joins from
documents to the index have one row per digest on the index's side, so that Spark splits a hot digest's partition.

Defined results: null text counts as empty; all texts without a character other than white space are equal;
of equal texts the row with the most code points in the original stays, then the smallest ``doc_id``
(null ids last); of rows that are equal in all of that one stays, which of them is open; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, scratch_path, table, text_or_empty, unused, written

#: Bits in a page of a filter: what Spark's bitmap functions put into one bitmap. Entries for each page, on average.
PAGE, PAGE_ENTRIES = 1 << 15, 1 << 11
RUNS = 4
_RUN = "digest binary, less int, no_id boolean, id bigint, row bigint, n bigint, run int"


def normalised(text: Column) -> Column:
    """The text without the characters of ``SPACES``."""
    out = text
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def entries(docs: DataFrame) -> DataFrame:
    """doc_id, n_points, digest and row (a number for each row) of every document, as a written table."""
    text = text_or_empty()
    return written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.char_length(text).alias("n_points"),
            digest_of(normalised(text)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digest-entries",
    )


def _page(pages: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64("digest"), 15), F.lit(pages)).cast("int")


def _bit() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(PAGE)).cast("int")


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One entry for each of ``keys``: the one that ranks first, and the number of documents."""
    return rows.groupBy(*keys).agg(F.min(F.struct("less", "no_id", "id", "row")).alias("f"), F.sum("n").alias("n")).select("digest", "f.*", "n", *(k for k in keys if k != "digest"))


def append(found: DataFrame, log: str | None = None, runs: int = RUNS, first_run: int = 0) -> str:
    """Flush :func:`entries` into new runs (numbers from ``first_run``) of a log, each sorted by digest; returns the log's folder.

    A row's run follows from its number, so that a repeated task writes the same rows.
    """
    log = log or scratch_path(found.sparkSession, "digest-log")
    run = (F.pmod(F.xxhash64("row"), F.lit(runs)) + first_run).cast("int").alias("run")
    of = found.select((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row", "digest", F.lit(1).cast("long").alias("n"), run)
    memtable = merged(of, ["run", "digest"])
    memtable.sortWithinPartitions("run", "digest").write.mode("append").partitionBy("run").parquet(f"{log}/runs")
    return log


def runs_of(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(_RUN).parquet(f"{log}/runs")


def filters(runs: DataFrame) -> tuple[DataFrame, int]:
    """(page, filters: a bitmap for each run that has an entry there), and the number of pages."""
    most = runs.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    pages = max(1, -(-most // PAGE_ENTRIES))
    bitmaps = runs.groupBy("run", _page(pages).alias("page")).agg(F.bitmap_construct_agg(_bit()).alias("bits"))
    return bitmaps.groupBy("page").agg(F.collect_list(F.struct("run", "bits")).alias("filters")), pages


def probed(runs: DataFrame, others: DataFrame, pages: int) -> DataFrame:
    """``runs`` with ``met``: whether a filter of another run knows the entry's digest.

    Filters may say so wrongly, for about one entry in 16 a run, and never miss one.
    """
    spot = F.col("spot")
    rows = runs.withColumn("page", _page(pages)).withColumn("spot", _bit()).join(others, "page", "left")

    def known(x: Column) -> Column:
        byte = F.conv(F.hex(x["bits"].substr((spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (x["run"] != F.col("run")) & (F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(spot, F.lit(8)))), F.lit(2)) == 1)

    return rows.withColumn("met", F.exists("filters", known)).drop("page", "spot", "filters")


def compacted(spark: SparkSession, log: str) -> DataFrame:
    """The index over all runs of a log, sorted by digest: digest, less, no_id, id, row, n."""
    runs = runs_of(spark, log)
    looked_up = written(probed(runs, *filters(runs)), "digest-probed")
    columns = ["digest", "less", "no_id", "id", "row", "n"]
    alone = looked_up.where("not met").select(columns)
    return written(alone.unionByName(merged(looked_up.where("met"), ["digest"]).select(columns)).sortWithinPartitions("digest"), "digest-index")


def hits(docs: DataFrame, index: DataFrame) -> DataFrame:
    """digest, norm, f (what ranks first), n: the documents that share a digest, grouped by digest and bytes."""
    text = text_or_empty()
    shared = index.where("n > 1").select(F.col("digest").alias("of"))
    norm = docs.select(F.col("doc_id").cast("long").alias("id"), (-F.char_length(text)).alias("less"), F.col("doc_id").isNull().alias("no_id"), normalised(text).alias("norm"))
    return (
        norm.withColumn("digest", digest_of(F.col("norm")))
        .join(shared.hint("shuffle_hash"), F.col("digest") == F.col("of"), "inner")
        .groupBy("digest", "norm")
        .agg(F.min(F.struct("less", "no_id", "id")).alias("f"), F.count(F.lit(1)).alias("n"))
    )


def _groups(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, n_points, keep_id, n, kept, digest of every document, by the index and a comparison of bytes."""
    docs = docs.select("doc_id", "text")
    found = entries(docs)
    index = compacted(docs.sparkSession, append(found, runs=runs))
    differ = written(hits(docs, index).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "digest-differ")
    columns = ["doc_id", "n_points", "keep_id", "n", "kept", "digest"]
    first = index.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("first_row"), "n")
    out = found.join(first, "digest").withColumn("kept", F.col("row") == F.col("first_row")).select(columns)
    if differ.isEmpty():
        return out
    # The same by bytes, for digests that different texts share.
    same = out.join(differ.select("digest"), "digest", "left_anti").select(columns)
    text = text_or_empty()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("n_points"), normalised(text).alias("norm"))
    apart = texts.withColumn("digest", digest_of(F.col("norm"))).join(differ.select("digest"), "digest").join(hits(docs, index), ["digest", "norm"])
    first_of = F.col("doc_id").eqNullSafe(F.col("f.id")) & (F.col("n_points") == -F.col("f.less"))
    return same.unionByName(apart.withColumn("keep_id", F.col("f.id")).withColumn("kept", first_of).select(columns))


def index_groups(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    return _groups(docs, runs).select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    of, same, n, digest = unused(docs, "of", "same_id", "n_points", "digest")
    kept = _groups(docs, runs).where("kept").select(F.col("doc_id").alias(same), F.col("n_points").alias(n), F.col("digest").alias(digest))
    text = text_or_empty()
    rows = docs.withColumn(of, digest_of(normalised(text)))
    stay = rows.join(kept, (F.col(of) == F.col(digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(same)) & (F.char_length(text) == F.col(n)), "left_semi")
    # Rows that agree in digest, id and length rank alike: one of them stays.
    return stay.dropDuplicates([of, "doc_id"]).drop(of)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_groups(table(spark, sf_dir, "documents"))


_NORM = r"regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')"

OP4_SQL = f"""
WITH e AS (SELECT doc_id, {_NORM} AS norm, length(coalesce(text, '')) AS n_points FROM documents),
g AS (SELECT norm, count(*) AS n, arg_min(doc_id, (-n_points, doc_id)) AS keep_id FROM e GROUP BY norm)
SELECT e.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, e.doc_id = g.keep_id AS kept, sha256(e.norm) AS text_sha256
FROM e JOIN g USING (norm)
"""
