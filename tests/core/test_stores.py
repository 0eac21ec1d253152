"""The relational source over a database, and the log of runs."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from spindrift.sources import registry_relational as rel
from spindrift.sources import tables as k

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
#: The table with texts that the database can compare; Spark makes them CLOBs there.
STUDIES = '(SELECT CAST("nct_id" AS VARCHAR(16)) AS nct_id, "seq" AS seq, CAST("phase" AS VARCHAR(16)) AS phase FROM studies) t'


@pytest.fixture(scope="module")
def mirror(spark):
    """A mirror's studies in the database that comes with Spark, in memory."""
    url = f"jdbc:derby:memory:mirror{uuid.uuid4().hex};create=true"
    rows = spark.range(1, 501).select(F.format_string("NCT%08d", "id").alias("nct_id"), F.col("id").cast("int").alias("seq"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("Phase "), (F.col("id") % 3).cast("string"))).alias("phase"))
    rows.write.jdbc(url, "studies", properties=DERBY)
    return url


def test_ranges_of_ids_are_read_by_a_task_each(spark, mirror):
    df = rel.read_table(spark, mirror, STUDIES, DERBY, where=rel.id_ranges(1, 500, 7))
    assert df.rdd.getNumPartitions() == 7 and df.count() == 500 == df.agg(F.count_distinct("nct_id")).first()[0]
    assert sorted(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())[0] > 60


def test_ranges_of_a_key(spark, mirror):
    df = rel.read_table(spark, mirror, STUDIES, DERBY, key="seq", bounds=(100, 400), partitions=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 500
    assert rel.read_table(spark, mirror, STUDIES, DERBY).rdd.getNumPartitions() == 1
    with pytest.raises(ValueError, match="either"):
        rel.read_table(spark, mirror, STUDIES, DERBY, key="seq", bounds=(1, 2), where=["1 = 1"])


def test_filters_and_columns_reach_the_database(spark, mirror):
    some = rel.read_table(spark, mirror, STUDIES, DERBY, where=rel.id_ranges(1, 500, 3)).where("phase = 'Phase 1' and seq > 490").select("nct_id")
    plan = some._jdf.queryExecution().executedPlan().toString().upper()
    pushed = plan[plan.index("PUSHEDFILTERS") :].partition("]")[0]
    assert "PHASE" in pushed and "SEQ" in pushed and "FILTER (" not in plan
    assert [r[0] for r in some.orderBy("nct_id").collect()] == ["NCT00000493", "NCT00000496", "NCT00000499"][: some.count()] and some.count() == sum(i % 3 == 1 for i in range(491, 501))


def test_a_run_logs_every_table_once(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    assert k.read_log(spark, log).count() == 0
    df = spark.createDataFrame([(1, "a", {"x": 1, "y": 2}), (2, None, None), (2, None, None)], "id int, t string, m map<string,int>")
    run = k.Run(spark, log, "r1", "json", {"phase": "2"})
    back = run.write("a", df, f"file://{tmp_path}/a")
    run.write("none", df.limit(0), f"file://{tmp_path}/none")
    with pytest.raises(ValueError, match="already"):
        run.write("a", df, f"file://{tmp_path}/again")
    rows = {r["table_name"]: r for r in run.close().collect()}
    assert back.count() == 3 and rows["a"]["row_count"] == 3 and (rows["none"]["row_count"], rows["none"]["checksum"]) == (0, 0) and rows["a"]["filters_json"] == '{"phase": "2"}'
    with pytest.raises(ValueError, match="already"):
        k.Run(spark, log, "r1", "json")
    second = k.Run(spark, log, "r2", "json")
    second.write("a", df.repartition(3).orderBy("id"), f"file://{tmp_path}/a2")
    second.write("new", df, f"file://{tmp_path}/new")
    second.close()
    third = k.Run(spark, log, "r3", "json")
    third.write("a", df.withColumn("t", F.lit("b")), f"file://{tmp_path}/a3")
    third.close()
    status = lambda a, b: {r["table_name"]: r["status"] for r in k.compared(k.read_log(spark, log), a, b).collect()}
    assert status("r1", "r2") == {"a": "same", "none": "dropped", "new": "added"} and status("r2", "r3") == {"a": "changed", "new": "dropped"} and status("x", "y") == {}
