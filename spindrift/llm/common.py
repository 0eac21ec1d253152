"""Helpers shared by the corpus operators: scratch tables, text columns and a bounded memo."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the contracts name: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent on a local master (one machine, as in tests) a temporary folder takes its
    place; on a cluster its absence is an error, as tasks would write to the disks of different machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.spindrift.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.spindrift.scratch", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet, under the shared folder."""
    return f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to Python while a scratch table is written: its buffers are beside the heap, and each task has some of that size.
BATCH, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, batches have about ``BATCH`` bytes at most; then the session's setting holds again."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows rereads files that outlive any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_spindrift_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="spindrift-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._spindrift_shipped = True


def released() -> None:
    """What this Python process has freed goes back to the system, which it else keeps for itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def arrow(df: DataFrame, function: Callable, schema: str, barrier: bool = False) -> DataFrame:
    """``mapInArrow`` with a function of this package, which the executors get first.

    A Python worker serves many tasks; what a task has freed goes back to the system at its end.
    """
    shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            released()

    return df.mapInArrow(run, schema, barrier)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as keep them apart from the table's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


class Memo(dict):
    """What ``make`` returns for a key, kept for at most ``most`` keys at a time.

    Where keys are texts (``width`` > 0), they also have at most ``width`` characters each on average, and a key longer
    than ``LONG`` is never kept: in scripts without spaces a "word" may be a whole document.
    """

    LONG = 512

    def __init__(self, make: Callable, most: int = 250_000, width: int = 32):
        self.make, self.most, self.room, self.held = make, most, most * width, 0

    def __missing__(self, key):
        value = self.make(key)
        if self.room:
            size = len(key)
            if size > self.LONG:
                return value
            self.held += size
            if self.held > self.room:
                self.clear()
                self.held = size
        if len(self) >= self.most:
            self.clear()
            self.held = 0
        self[key] = value
        return value

    def of_all(self, keys: list) -> list:
        """The values of texts, as ``self[key]`` for each; the calls for what is new cost less."""
        values = list(map(self.get, keys))
        make, most, room, held = self.make, self.most, self.room, self.held
        for i in [i for i, value in enumerate(values) if value is None]:
            key = keys[i]
            value = self.get(key)  # a key may come twice
            if value is None:
                value = make(key)
                size = len(key)
                if size <= self.LONG:
                    if held + size > room or len(self) >= most:
                        self.clear()
                        held = 0
                    held += size
                    self[key] = value
            values[i] = value
        self.held = held
        return values
