"""Landing, table keeping and the incremental job."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.plans import QUERIES, landing
from spindrift.plans.projections import TABLES
from spindrift.sources import registry_json as r
from spindrift.sources import tables as k
from spindrift.streaming import incremental


def study(nct_id: str, title: str, measures: list[str]) -> dict:
    return {
        "protocolSection": {
            "identificationModule": {"nctId": nct_id, "briefTitle": title}, "statusModule": {"startDateStruct": {"date": "2020-03"}}, "designModule": {"phases": ["PHASE1", "PHASE2"]},
            "armsInterventionsModule": {"armGroups": [{"label": "A", "type": "EXPERIMENTAL"}], "interventions": [{"type": "DRUG", "name": " Some  Drug", "otherNames": ["x", " "], "armGroupLabels": ["A", "B"]}]},
            "outcomesModule": {"primaryOutcomes": [{"measure": m, "timeFrame": "Week 4"} for m in measures]},
        },
        "resultsSection": {"outcomeMeasuresModule": {"outcomeMeasures": [
            {"type": "PRIMARY", "title": "T", "timeFrame": "Week 4", "groups": [{"id": "OG000", "title": "A"}], "denoms": [{"units": "eyes", "counts": [{"groupId": "OG000", "value": "7"}]}, {"units": "Participants", "counts": [{"groupId": "OG000", "value": "1,204"}]}],
             "classes": [{"title": "c", "categories": [{"measurements": [{"groupId": "OG000", "value": "3.5", "spread": "NA"}]}]}]}] * 2}},
    }


def pages(folder, name, *studies):
    (folder / name).write_text(json.dumps({"studies": list(studies)}))


def test_records_are_flattened(spark, tmp_path):
    pages(tmp_path, "1.json", study("N1", "one", ["m1", "m2"]))
    s = r.read_registry_json(spark, str(tmp_path))
    flat = r.flatten_studies(s).first()
    assert (flat["phase"], str(flat["start_date"])) == ("PHASE1/PHASE2", "2020-03-01")
    assert [x["name_normalised"] for x in r.flatten_interventions(s).collect()] == ["some drug"]
    assert [x["other_name"] for x in r.flatten_aliases(s).collect()] == ["x"] and [x["group_title"] for x in r.flatten_arm_links(s).collect()] == ["A"]
    outcomes = r.flatten_reported_outcomes(s).collect()
    assert len({x["outcome_id"] for x in outcomes}) == 2  # equal outcomes keep ids of their own
    assert {(x["n"], x["n_units"]) for x in r.flatten_outcome_groups(s).collect()} == {(1204, "Participants")}
    m = r.flatten_measurements(s).collect()
    assert {(x["param_value_num"], x["dispersion_value_num"]) for x in m} == {(3.5, None)} and len(m) == 2


def test_descriptors_and_branches_are_flattened(spark, tmp_path):
    one = study("N1", "one", [])
    one["derivedSection"] = {
        "conditionBrowseModule": {"meshes": [{"id": "D1", "term": " Asthma  Severe "}, {"id": "D2"}], "ancestors": [{"id": "D3", "term": "Lung Diseases"}], "browseBranches": [{"abbrev": "BC08", "name": "Respiratory"}, {"name": "no abbreviation"}]},
        "interventionBrowseModule": {"meshes": [{"id": "D9", "term": "Placebo"}], "browseBranches": [{"name": "named"}, {}]},
    }
    pages(tmp_path, "1.json", one, study("N2", "two", []))
    s = r.read_registry_json(spark, str(tmp_path))
    assert sorted(map(tuple, r.flatten_mesh(s).collect())) == [("N1", " Asthma  Severe ", "asthma severe", "mesh-list"), ("N1", "Lung Diseases", "lung diseases", "mesh-ancestor")]
    assert [tuple(x) for x in r.flatten_mesh(s, "intervention").collect()] == [("N1", "Placebo", "placebo", "mesh-list")]
    assert [tuple(x) for x in r.flatten_branches(s).collect()] == [("N1", "BC08", "Respiratory")]
    assert [tuple(x) for x in r.flatten_branches(s, "intervention").collect()] == [("N1", None, "named")]


def test_derived_tables_are_replaced_and_reports_written(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(3, "c, d")], "k int, v string")
    k.write_replace(old, str(tmp_path / "t"))
    assert [tuple(x) for x in k.write_replace(new, str(tmp_path / "t")).collect()] == [(3, "c, d")]
    k.write_csv(new, str(tmp_path / "csv"))
    assert [tuple(x) for x in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("3", "c, d")]


def test_a_callers_views_stay(spark):
    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("orders")
    assert QUERIES["has_results_flag"](spark, "/root/testdata/sf0.001").count() > 1
    assert spark.table("orders").columns == ["mine"]


def test_tables_are_kept(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    once = k.upsert_rows(base, delta, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, k.upsert_rows(once, delta, ["k"], ["v"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, k.replace_children(base, delta, delta.where("k = 3"), ["k"]).collect())) == [(1, "a"), (3, "e")]
    out, change = k.reconcile_schema(base, T.StructType([T.StructField("k", T.LongType()), T.StructField("w", T.StringType())]), ["k"])
    assert change == {"added": ["w"], "dropped": ["v"], "cast": ["k"]} and out.count() == 2
    with pytest.raises(ValueError):
        k.reconcile_schema(base, T.StructType([T.StructField("z", T.LongType())]), ["z"])
    assert k.snapshot(base, "b").first()["checksum"] == k.snapshot(base.repartition(3), "b").first()["checksum"]
    log = k.run_log(base, "r1", "json", {"phase": "2"}).first()
    assert log["row_count"] == 2 and json.loads(log["filters_json"]) == {"phase": "2"}


def test_arriving_pages_refresh_studies(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    pages(folder, "1.json", study("N1", "one", ["m1", "m2"]), study("N2", "two", ["m3"]))
    incremental.land(spark, str(folder), str(target), str(checkpoint))
    pages(folder, "2.json", study("N1", "one again", ["m4"]), study("N3", "three", []))
    incremental.land(spark, str(folder), str(target), str(checkpoint))
    now = incremental.latest(spark, str(target))
    assert sorted((x["nct_id"], x["brief_title"]) for x in now["studies"].collect()) == [("N1", "one again"), ("N2", "two"), ("N3", "three")]
    assert sorted((x["nct_id"], x["measure"]) for x in now["outcomes"].collect()) == [("N1", "m4"), ("N2", "m3")]


def test_of_a_study_that_comes_twice_the_last_record_counts(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    pages(folder, "1.json", study("N1", "first", ["m1", "m2"]), study("N2", "two", ["m3"]), study("N1", "last", ["m9"]))
    incremental.land(spark, str(folder), str(target), str(checkpoint))
    now = incremental.latest(spark, str(target))
    assert sorted((x["nct_id"], x["brief_title"]) for x in now["studies"].collect()) == [("N1", "last"), ("N2", "two")]
    assert sorted((x["nct_id"], x["measure"]) for x in now["outcomes"].collect()) == [("N1", "m9"), ("N2", "m3")]
    # A later page with a smaller title and an older start still replaces it, and only its bucket is written.
    pages(folder, "2.json", study("N1", "a", ["m4"]))
    incremental.land(spark, str(folder), str(target), str(checkpoint))
    now = incremental.latest(spark, str(target))
    assert sorted((x["nct_id"], x["brief_title"]) for x in now["studies"].collect()) == [("N1", "a"), ("N2", "two")]
    assert len(list((target / "studies" / "v=00000002").glob("bucket=*"))) == 1


def bare(nct: str, measures: list[str]) -> dict:
    """A record with a study and its outcomes only."""
    return {"protocolSection": {"identificationModule": {"nctId": nct}, "outcomesModule": {"primaryOutcomes": [{"measure": m} for m in measures]}}}


def full(nct: str, arms: list[str]) -> dict:
    """A record with rows for all tables."""
    one = study(nct, nct, ["m"])
    section = one["protocolSection"]
    section["armsInterventionsModule"] = {"armGroups": [{"label": a, "type": "EXPERIMENTAL"} for a in arms], "interventions": [{"name": "Drug", "type": "DRUG", "otherNames": ["alias"], "armGroupLabels": arms}]}
    section["conditionsModule"] = {"conditions": ["Asthma"]}
    browse = {"meshes": [{"id": "D1", "term": "Asthma"}], "browseBranches": [{"abbrev": "BC08", "name": "Lungs"}]}
    one["derivedSection"] = {"conditionBrowseModule": browse, "interventionBrowseModule": browse}
    values = {"classes": [{"categories": [{"measurements": [{"groupId": "G", "value": "1", "spread": "2"}]}]}], "paramType": "MEAN"}
    groups = {"groups": [{"id": "G", "title": arms[0]}], "denoms": [{"units": "Participants", "counts": [{"groupId": "G", "value": "9"}]}]}
    outcome = {"type": "PRIMARY", "title": "t", "timeFrame": "w", "analyses": [{"groupIds": ["G"], "pValue": "0.1"}], **groups, **values}
    one["resultsSection"] = {"outcomeMeasuresModule": {"outcomeMeasures": [outcome]}, "baselineCharacteristicsModule": {**groups, "measures": [{"title": "age", **values}]}}
    return one


def test_all_tables_of_a_batch_show_together(spark, tmp_path, monkeypatch):
    folder, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    assert all(df.count() == 0 for df in incremental.latest(spark, target).values())  # nothing has landed yet
    pages(folder, "1.json", full("N1", ["A", "B"]), full("N2", ["C"]))
    incremental.land(spark, str(folder), target, checkpoint)
    counts = lambda: {name: df.count() for name, df in incremental.latest(spark, target).items()}
    first = counts()
    assert first == dict.fromkeys(incremental.TABLES, 2) | {"arms": 3, "arm_interventions": 3}
    # A batch that breaks off after some tables shows in none; the next try lands it whole.
    pages(folder, "2.json", full("N1", ["D"]), bare("N3", []))
    made = incremental.TABLES["arms"]
    monkeypatch.setitem(incremental.TABLES, "arms", lambda studies: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        incremental.land(spark, str(folder), target, checkpoint)
    monkeypatch.setitem(incremental.TABLES, "arms", made)
    assert (tmp_path / "out" / "studies" / "v=00000002").exists() and counts() == first
    incremental.land(spark, str(folder), target, checkpoint)
    second = counts()
    assert second == dict.fromkeys(incremental.TABLES, 2) | {"studies": 3}
    assert sorted(x["title"] for x in incremental.latest(spark, target)["arms"].collect()) == ["C", "D"]
    # A batch that is delivered again changes nothing, nor does taking old versions away.
    before = sorted(p.name for p in (tmp_path / "out" / "manifest").iterdir())
    for log in (tmp_path / "state" / "commits").iterdir():
        if log.name.removesuffix(".crc").lstrip(".") == "1":
            log.unlink()
    incremental.land(spark, str(folder), target, checkpoint)
    assert sorted(p.name for p in (tmp_path / "out" / "manifest").iterdir()) == before and counts() == second
    assert incremental.compact(spark, target) > 0 and counts() == second and incremental.compact(spark, target) == 0
    assert len(list((tmp_path / "out" / "studies").glob("v=*/bucket=*"))) == len(incremental.current(spark, target))
    pages(folder, "3.json", bare("N2", ["m1"]))
    incremental.land(spark, str(folder), target, checkpoint)
    assert counts()["outcomes"] == 2 and counts()["measurements"] == 1 and incremental.compact(spark, target, keep=2) > 0


def test_reading_prunes_other_versions(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n in range(2):
        pages(folder, f"{n}.json", full("N1", [f"A{n}"]))
        incremental.land(spark, str(folder), target, str(tmp_path / "state"))
    plan = incremental.latest(spark, target)["arms"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "v#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_a_study_of_many_lines_keeps_all_outcomes(spark, tmp_path, monkeypatch):
    folder = "/root/testdata/sf0.001"
    for name in set(TABLES) - {"lineitem"}:
        (tmp_path / f"{name}.parquet").symlink_to(f"{folder}/{name}.parquet")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    hot = spark.read.parquet(f"{folder}/orders.parquet").agg(F.min("o_orderkey")).first()[0]
    key = F.when(F.col("l_partkey") % 2 == 0, F.lit(hot)).otherwise(F.col("l_orderkey")).cast(lines.schema["l_orderkey"].dataType)
    lines.withColumn("l_orderkey", key).write.parquet(str(tmp_path / "lineitem.parquet"))
    view = landing.Data(spark, str(tmp_path)).view
    planned = view("p_outcomes")
    most = planned.groupBy("nct_id").count().agg(F.max("count")).first()[0]
    assert most > 1001
    for page in (10_000, 100):
        monkeypatch.setattr(landing, "PAGE_LINES", page)
        found = QUERIES["flatten_planned_outcomes"](spark, str(tmp_path))
        assert found.count() == planned.count()
        assert found.where("outcome_type = 'primary'").count() == planned.select("nct_id").distinct().count()
        assert found.select("nct_id", "measure", "time_frame").exceptAll(planned.select("nct_id", "measure", "time_frame")).count() == 0
    arms = QUERIES["flatten_arms"](spark, str(tmp_path))
    assert arms.exceptAll(view("p_arms").select("nct_id", "title")).count() == 0 and arms.count() == view("p_arms").count()
    assert QUERIES["flatten_arm_links"](spark, str(tmp_path)).agg(F.sum("n")).first()[0] == view("p_interventions").count()
    assert landing.records(landing.Data(spark, str(tmp_path))).where("kind = 'study'").count() == view("p_studies").count()


def test_lines_move_before_records_are_made_of_them(spark):
    from spindrift.plans.landing import result_records
    from spindrift.plans.projections import Data

    s = result_records(Data(spark, "/root/testdata/sf0.001"))
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "Participants" in plan and "Participants" not in plan[plan.index("Aggregate [") :].split("\n", 1)[1]
    assert set(r.reported_outcomes(s).columns) == {"nct_id", "ordinal", "outcome_type", "title", "time_frame", "duplicate", "outcome_id"}
