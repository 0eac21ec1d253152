"""Page files that arrive in a folder are landed study by study, in all registry tables; a study that comes again is refreshed in place.

A target holds a folder for each table, by version and bucket, and ``manifest``, which says of each bucket which version counts. A
batch writes the buckets of its studies anew in every table, under a version that nobody reads yet, and its manifest last:
the tables of a batch become visible together, or not at all where a job is lost on the way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import registry_json as r

#: Into how many buckets (by a hash of the study's id) the tables are cut; a batch rewrites those that its studies lie in.
BUCKETS = 64
#: The tables, each with what makes its rows of study records.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "studies": r.flatten_studies, "outcomes": r.flatten_planned_outcomes, "arms": r.flatten_arms, "conditions": r.flatten_conditions,
    "condition_mesh": partial(r.flatten_mesh, side="condition"), "intervention_mesh": partial(r.flatten_mesh, side="intervention"),
    "condition_branches": partial(r.flatten_branches, side="condition"), "intervention_branches": partial(r.flatten_branches, side="intervention"),
    "interventions": r.flatten_interventions, "intervention_other_names": r.flatten_aliases, "arm_interventions": r.flatten_arm_links,
    "reported_outcomes": r.flatten_reported_outcomes, "outcome_groups": r.flatten_outcome_groups, "measurements": r.flatten_measurements, "analyses": r.flatten_analyses, "baseline": r.flatten_baseline,
}
#: A row for each bucket that holds studies; ``source`` and ``batch`` are the batch that made the version.
MANIFEST = "source string, batch long, bucket int, since int"


def bucket() -> Column:
    return F.pmod(F.xxhash64("nct_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def last_records(arrived: DataFrame) -> DataFrame:
    """study: of each study the record that arrived last, by its file's time and name and its place in the page.

    arrived: studies, arrived_at (anything that rises with the arrival of pages).
    """
    each = arrived.select(F.col("arrived_at").alias("at"), F.posexplode("studies").alias("place", "study")).where(F.col(r.ID).isNotNull())
    return each.groupBy(F.col(r.ID).alias("nct_id")).agg(F.max_by("study", F.struct("at", "place")).alias("study")).select("study")


def land(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Process what has arrived since the last call; a batch that comes a second time changes nothing."""
    pages = spark.readStream.schema(r.page_schema()).option("multiLine", True).json(folder)
    came = pages.select("studies", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("arrived_at"))
    write = lambda arrived, number: land_batch(spark, arrived, target, checkpoint, number)
    came.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def land_batch(spark: SparkSession, arrived: DataFrame, target: str, source: str, number: int) -> None:
    """One batch of pages (studies, arrived_at); ``source`` and ``number`` name it for good. A target has one writer at a time."""
    made = manifests(spark, target)
    if made.where((F.col("source") == source) & (F.col("batch") == number)).limit(1).count():
        return
    before = current(spark, target)
    version = (made.agg(F.max("v")).first()[0] or 0) + 1
    path = f"{target}/arrived/v={version:08d}"
    last_records(arrived).write.mode("overwrite").parquet(path)  # each table is made from it
    records = spark.read.schema(T.StructType([T.StructField("study", T._parse_datatype_string(r.STUDY))])).parquet(path)
    touched = records.select(F.col(r.ID).alias("nct_id"))
    buckets = sorted(x["bucket"] for x in touched.select(bucket()).distinct().collect())  # at most BUCKETS numbers
    for name, flatten in TABLES.items():
        rows = flatten(records).withColumn("bucket", bucket())
        kept = read(spark, target, name, {b: v for b, v in before.items() if b in buckets}).join(touched, "nct_id", "left_anti")
        # The hint leaves it to the sizes that are met into how many files a bucket is split.
        rows.unionByName(kept.select(rows.columns)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/{name}/v={version:08d}")
    state = before | dict.fromkeys(buckets, version)
    out = spark.createDataFrame([(source, number, b, v) for b, v in sorted(state.items())] or [(source, number, None, None)], MANIFEST)
    out.coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/v={version:08d}")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def manifests(spark: SparkSession, target: str) -> DataFrame:
    """The manifests of all versions (v), BUCKETS rows each at most."""
    schema = f"{MANIFEST}, v int"
    fs, path = _path(spark, f"{target}/manifest")
    return spark.read.schema(schema).parquet(f"{target}/manifest") if fs.exists(path) else spark.createDataFrame([], schema)


def current(spark: SparkSession, target: str, back: int = 0) -> dict[int, int]:
    """The version that counts of each bucket, now or ``back`` versions ago."""
    made = manifests(spark, target)
    newest = made.agg(F.max("v")).first()[0]
    if newest is None:
        return {}
    return {x["bucket"]: x["since"] for x in made.where((F.col("v") == newest - back) & F.col("bucket").isNotNull()).collect()}  # at most BUCKETS rows


def read(spark: SparkSession, target: str, name: str, state: dict[int, int]) -> DataFrame:
    """A table's rows in a state, with their bucket; folders of other versions are pruned by their names."""
    none = TABLES[name](spark.createDataFrame([], f"study {r.STUDY}"))
    schema = T.StructType([*none.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("v", T.IntegerType())])
    if not state:
        return spark.createDataFrame([], schema).drop("v")
    wanted = F.lit(False)
    for version in sorted(set(state.values())):
        wanted = wanted | ((F.col("v") == version) & F.col("bucket").isin([b for b, v in state.items() if v == version]))
    return spark.read.schema(schema).parquet(f"{target}/{name}").where(wanted).drop("v")


def latest(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """All tables as the last whole batch left them."""
    state = current(spark, target)
    return {name: read(spark, target, name, state).drop("bucket") for name in TABLES}


def compact(spark: SparkSession, target: str, keep: int = 1) -> int:
    """Delete the bucket folders that none of the last ``keep`` versions reads, and the records of landed batches; returns how many folders went.

    Nothing is rewritten, since a version holds whole buckets. Readers that began more than ``keep`` versions ago must be done.
    """
    newest = manifests(spark, target).agg(F.max("v")).first()[0] or 0
    alive = {pair for back in range(keep) for pair in current(spark, target, back).items()}
    gone = 0
    for name in [*TABLES, "arrived"]:
        fs, root = _path(spark, f"{target}/{name}")
        for version in fs.listStatus(root) if fs.exists(root) else []:
            label = version.getPath().getName()
            number = int(label.removeprefix("v=")) if label.startswith("v=") else newest + 1
            if number > newest:
                continue  # of a batch that is being written, or no version
            if name == "arrived":
                gone += fs.delete(version.getPath(), True)
                continue
            for part in fs.listStatus(version.getPath()):
                of = part.getPath().getName()
                if of.startswith("bucket=") and (int(of.removeprefix("bucket=")), number) not in alive:
                    gone += fs.delete(part.getPath(), True)
    return gone
