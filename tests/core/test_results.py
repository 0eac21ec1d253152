"""Arm rows of outcomes and baseline characteristics, their denominators and endpoints, and what reports select of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spindrift.operators import reports, results

OUTCOMES = "outcome_id string, nct_id string, outcome_type string, title string, time_frame string, param_type string, dispersion_type string, unit_of_measure string"
PLACE = "nct_id string, group_key string, class_title string, category_title string, param_value_num double, dispersion_value_num double, dispersion_lower_limit double, dispersion_upper_limit double, n int"
BASELINE = f"baseline_id string, title string, unit_of_measure string, group_title string, param_type string, dispersion_type string, {PLACE}"
UNITS, SCALES = [("millilitre", "mL"), ("litre", "L")], [("litre", "litre", 1.0), ("millilitre", "litre", 0.001)]


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    outcomes = make([("o1", "N1", "primary", "FEV1", "Week 4", "Mean", "Standard Error", "mL"), ("o2", "N1", None, "Other", None, None, None, None)], OUTCOMES).withColumn("n", F.lit(-1))
    groups = make([("o1", "A", "Arm A", 16), ("o1", "A", "Arm A again", 9), ("o1", None, "nobody", 3), ("o1", "C", None, None)], "outcome_id string, group_key string, title string, n int")
    m = lambda o, g, c, v, s, n: (o, "N1", g, c, None, v, s, None, None, n)
    measurements = make([m("o1", "A", None, 5.0, 2.0, None), m("o1", "A", None, 4.0, 8.0, 25), m("o1", "B", None, 1.0, 2.0, 25), m("o1", "C", "x", 1.0, 2.0, None), m("o1", None, None, None, None, None), m("o2", "A", None, 1.0, None, 4), m("gone", "A", None, 1.0, 1.0, 1)], f"outcome_id string, {PLACE}")
    b = lambda i, t, g, v, n: (i, t, "L", f"Arm {g}", "Mean", "Standard Deviation", "N2", g, None, None, 10.0, v, None, None, n)
    baseline = make([b("b1", "Lung volume", "A", 3.0, 7), b("b1", "Lung volume", "B", 4.0, None), b("b2", "Lung volume, again", "A", 5.0, 0)], BASELINE)
    return outcomes, groups, measurements, baseline


def test_rows_take_their_own_count_then_their_arms(tables):
    rows = {(r["result_id"], r["group_key"], r["class_title"]): r for r in results.result_rows(*tables).collect()}
    assert set(rows) == {("o1", "A", None), ("o1", "B", None), ("o1", "C", "x"), ("o1", None, None), ("o2", "A", None), ("b1", "A", None), ("b1", "B", None), ("b2", "A", None)}
    kept = rows["o1", "A", None]  # of two rows of one id the larger value
    assert (kept["param_value"], kept["n"], kept["n_source"], kept["group_title"]) == (5.0, 16, "outcome_group", "Arm A")
    assert [(rows[k]["n"], rows[k]["n_source"]) for k in (("o1", "B", None), ("o1", "C", "x"), ("b1", "A", None), ("b1", "B", None), ("b2", "A", None))] == [(25, "measurement"), (None, None), (7, "baseline_row"), (None, None), (0, "baseline_row")]


def test_the_order_and_partitioning_of_rows_change_nothing(tables):
    outcomes, groups, measurements, baseline = tables
    once = results.result_rows(*tables).orderBy("dispersion_id").collect()
    again = results.result_rows(outcomes.repartition(5), groups.repartition(3), measurements.unionByName(measurements).orderBy(F.desc("param_value_num")).repartition(7), baseline.unionByName(baseline).repartition(4))
    assert again.orderBy("dispersion_id").collect() == once


def test_the_job_joins_spread_and_endpoints(spark, tables):
    outcomes, _, _, baseline = tables
    titles = results.result_titles(outcomes, baseline)
    seen = {r["result_id"]: r for r in titles.collect()}
    assert len(seen) == titles.count() == 4 and seen["o2"]["outcome_type"] == "other" and seen["b1"]["time_frame"] is None and seen["b1"]["measure"] == "Lung volume"
    ends = spark.createDataFrame([(seen["o1"]["endpoint_id"], "f", "fev", None, "fixed"), (seen["b1"]["endpoint_id"], "f", "volume", "percent", "unspecified")], "endpoint_id string, form_id string, measurement_id string, derivation_id string, timepoint_pattern string")
    table = results.result_dispersion(results.result_rows(*tables), titles, ends, spark.createDataFrame(UNITS, "scale_id string, synonym string"), spark.createDataFrame(SCALES, "scale_id string, si_equivalent string, factor_to_si double"))
    rows = {(r["result_id"], r["group_key"]): r for r in table.collect()}
    assert len(rows) == 8 and rows["o1", "A"]["sd_value"] == 8.0 and rows["o1", "A"]["si_value"] == pytest.approx(0.008) and rows["o1", "A"]["measurement_id"] == "fev"
    assert rows["o1", "C"]["sd_skip_reason"] == "no_arm_n" and rows["b1", "B"]["sd_value"] == 4.0 and rows["b2", "A"]["measurement_id"] is None
    # What reports select: the derivation 'none', one endpoint, one role.
    roles = spark.createDataFrame([("N1", "Arm A", "control"), ("N2", "Arm A", "experimental"), ("N1", "Arm A", "control")], "nct_id string, arm_title string, arm_role string")
    ids = lambda **k: sorted((r["result_id"], r["group_key"]) for r in reports.selected(table.where("sd_value is not null"), **k).collect())
    assert ids(derivation="none") == [("b2", "A"), ("o1", "A"), ("o1", "B")] and ids(derivation="percent", form="f") == [("b1", "A"), ("b1", "B")]
    assert ids(roles=roles, role="control") == [("o1", "A")] and ids(measurement="nothing") == [] and len(ids()) == 5
    sds = reports.usable_sds(table)
    found = reports.with_histograms(sds.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")), sds, ["unit_id"], {"methods": "sd_method", "points": "timepoint_pattern_id"})
    assert [(r["unit_id"], r["n"], r["methods"], r["points"]) for r in found.collect()] == [("litre", 5, {"from_standard_error": 2, "reported": 3}, {"fixed": 2, "none": 1, "unspecified": 2})]


def test_empty_tables(spark, tables):
    none = [t.limit(0) for t in tables]
    assert results.result_rows(*none).count() == 0 and results.result_titles(none[0], none[3]).count() == 0
    assert results.result_rows(tables[0], none[1], tables[2], none[3]).where("n_source = 'outcome_group'").count() == 0


def test_rows_move_only_for_their_ids(spark, tables):
    """With the labels from the tables that state them, the rows are dealt by their id and by their result, not by label or unit; the rows are the same."""
    outcomes, _, _, baseline = tables
    titles = results.result_titles(outcomes, baseline)
    ends = titles.select("endpoint_id", F.lit("f").alias("form_id"), F.lit("m").alias("measurement_id"), F.lit(None).cast("string").alias("derivation_id"), F.lit("fixed").alias("timepoint_pattern")).distinct()
    units, scales = spark.createDataFrame(UNITS, "scale_id string, synonym string"), spark.createDataFrame(SCALES, "scale_id string, si_equivalent string, factor_to_si double")
    plain, moved_less = (results.result_dispersion(results.result_rows(*tables), titles, ends, units, scales, labels) for labels in (None, results.result_labels(outcomes, baseline)))
    text = lambda df: sorted(str(r) for r in df.collect())
    assert text(plain) == text(moved_less)
    keys = [x.split(")")[0] for x in moved_less._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]]
    assert keys and not any(k.startswith(("unit_raw", "param_type", "dispersion_type", "coalesce(param_type")) for k in keys)


def test_the_spread_at_baseline_reads_no_outcomes(spark, monkeypatch):
    from spindrift.plans import QUERIES, projections, result_tables

    monkeypatch.setattr(projections, "_KEPT", {})
    monkeypatch.setattr(result_tables, "reported", lambda data: pytest.fail("baseline_sd reads no reported outcomes"))
    assert QUERIES["baseline_sd"](spark, "/root/testdata/sf0.001").count() > 0
