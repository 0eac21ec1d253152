"""Keeping stored tables: upserts, child replacement, schema changes, retention, run logs.

Plain Parquet has no MERGE: a new version is computed from the old one and the change, written to a path of its
own, and the caller swaps the path.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, the folder that all machines share; on one machine a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spindrift-")
    return f"{root.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def last_of_batch(delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the batch's order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return delta.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_rows(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``delta`` (the last of each key) replace those of ``base`` with the same key, or are added."""
    new = last_of_batch(delta, keys, order).select(base.columns)
    return base.join(new.select(keys), keys, "left_anti").unionByName(new)


def replace_children(base: DataFrame, touched: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Without the rows of the touched keys, and with the new ones; a touched key may end without rows."""
    return base.join(touched.select(keys).distinct(), keys, "left_anti").unionByName(delta.select(base.columns))


def reconcile_schema(df: DataFrame, schema: T.StructType, key: list[str] | None = None) -> tuple[DataFrame, dict]:
    """The table under a new schema, and what changed: added columns are null, others are cast or dropped.

    With a key, rows without it go and one row of each key stays. A key column that the table lacks is an
    error if the table has rows.
    """
    have = {f.name: f.dataType for f in df.schema}
    change = {
        "added": [f.name for f in schema if f.name not in have], "dropped": [n for n in have if n not in schema.fieldNames()],
        "cast": [f.name for f in schema if f.name in have and have[f.name] != f.dataType],
    }
    missing = [k for k in key or [] if k not in have]
    if missing and not df.isEmpty():
        raise ValueError(f"rows without the key columns {missing}")
    out = df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))
    if key:
        rest = [F.col(c).asc_nulls_last() for c in out.columns if c not in key]
        w = Window.partitionBy(*key).orderBy(*(rest or [F.lit(0)]))
        out = out.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in key))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out, change


def retain_studies(tables: dict[str, DataFrame], pulled: DataFrame, keep: DataFrame, study: str = "nct_id") -> dict[str, DataFrame]:
    """Tables without this batch's studies that are not kept; earlier studies stay."""
    gone = pulled.select(study).distinct().join(keep.select(study), study, "left_anti")
    return {name: df.join(gone, study, "left_anti") for name, df in tables.items()}


def run_log(df: DataFrame, run_id: str, source: str, filters: dict[str, str]) -> DataFrame:
    """One row on a run: time, source, filters as JSON, the number of rows."""
    pairs = F.create_map(*(F.lit(x) for kv in filters.items() for x in kv)) if filters else F.lit(None).cast("map<string,string>")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("pulled_at"), F.lit(source).alias("source"), F.to_json(pairs).alias("filters_json"), "row_count")


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """A table's row count and a checksum that does not depend on the order of rows."""
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("checksum")).select(F.lit(name).alias("name"), "n", "checksum")


#: The log of runs: a row for each table that a run wrote.
LOG = "run_id string, pulled_at timestamp, source string, filters_json string, table_name string, row_count long, checksum long"


class Run:
    """A run that writes tables and keeps their counts and checksums, taken by ``Observation`` while the rows go to their files.

    ``close`` appends a row for each table to the log, in one job, so that a log shows a run with all its tables or not at all; a run that
    has the id of a logged one is refused. The checksum does not depend on the order of the rows or the layout of the files.
    """

    def __init__(self, spark: SparkSession, log: str, run_id: str, source: str, filters: dict[str, str] | None = None):
        self.spark, self.log, self.run_id, self.source = spark, log, run_id, source
        self.filters = json.dumps(filters, sort_keys=True) if filters else None
        self.seen: dict[str, Observation] = {}
        if read_log(spark, log).where(F.col("run_id") == run_id).limit(1).count():
            raise ValueError(f"run {run_id} is in the log already")

    def write(self, name: str, df: DataFrame, path: str) -> DataFrame:
        """Write a table and return what was written."""
        if name in self.seen:
            raise ValueError(f"table {name} is written already")
        seen = Observation(f"{self.run_id}-{name}-{uuid.uuid4().hex}")
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.expr(f"bit_xor({_row_hash(df)})").alias("checksum")).write.mode("overwrite").parquet(path)
        self.seen[name] = seen
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> DataFrame:
        """Append the run to the log; returns its rows. A table without rows has the checksum 0."""
        found = {name: seen.get for name, seen in self.seen.items()}
        at = datetime.now(UTC)
        rows = [(self.run_id, at, self.source, self.filters, name, x["n"], x["checksum"] or 0) for name, x in found.items()]
        out = self.spark.createDataFrame(rows, LOG)
        out.coalesce(1).write.mode("append").parquet(self.log)
        return out


def _row_hash(df: DataFrame) -> str:
    """A row's hash; maps, which have none, by their sorted entries as JSON."""
    columns = [f"to_json(array_sort(map_entries(`{f.name}`)))" if isinstance(f.dataType, T.MapType) else f"`{f.name}`" for f in df.schema]
    return f"xxhash64({', '.join(columns) or '0'})"


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The log's rows; none where nothing has been logged yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(log)


def compared(log: DataFrame, before: str, after: str) -> DataFrame:
    """table_name, status (added, dropped, changed, same), rows_before, rows_after of the tables of two runs."""
    of = lambda run, name: log.where(F.col("run_id") == run).groupBy("table_name").agg(F.max("row_count").alias(f"rows_{name}"), F.max("checksum").alias(f"sum_{name}"))
    both = of(before, "before").join(of(after, "after"), "table_name", "full")
    same = F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("sum_before").eqNullSafe(F.col("sum_after"))
    status = F.when(F.col("rows_before").isNull(), "added").when(F.col("rows_after").isNull(), "dropped").when(same, "same").otherwise("changed")
    return both.select("table_name", status.alias("status"), "rows_before", "rows_after")


def write_replace(df: DataFrame, path: str) -> DataFrame:
    """A derived table written anew; returns what was written. The rows must not be read from the path itself."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
