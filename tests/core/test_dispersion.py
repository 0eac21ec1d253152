"""Spread to standard deviations: golden rows, and the normal quantile."""

from __future__ import annotations

import math
from statistics import NormalDist

import pytest

from spindrift.functions.numbers import normal_quantile
from spindrift.operators import dispersion as d
from spindrift.operators import reports

COLUMNS = "param_type string, dispersion_type string, dispersion_value double, lower_limit double, upper_limit double, n int"
q = NormalDist().inv_cdf
ROWS = [
    (("Mean", "Standard Deviation", 0.31, None, None, None), (0.31, "reported", None)),
    (("mean", "STANDARD_ERROR", 0.8, None, None, 100), (8.0, "from_standard_error", None)),
    (("mean", "Standard Error", 0.8, None, None, None), (None, None, "no_arm_n")),
    (("mean", "Standard Error", 0.8, None, None, 1), (None, None, "no_arm_n")),
    (("Least Squares Mean", "95% Confidence Interval", None, 0.1, 0.5, 100), (0.4 * 10 / (2 * q(0.975)), "from_confidence_interval", None)),
    (("median", "95% Confidence Interval", None, 15.1, 22.0, 240), (None, None, "confidence_interval_around_a_median")),
    (("median", "Inter-Quartile Range", None, 90.0, 420.0, 150), (330 / (2 * q((0.75 * 150 - 0.125) / 150.25)), "from_inter_quartile_range", None)),
    (("median", "Full Range", None, 1.0, 9.0, 40), (8 / (2 * q((40 - 0.375) / 40.25)), "from_full_range", None)),
    (("Geometric Mean", "Geometric Coefficient of Variation", 45.0, None, None, None), (math.sqrt(math.log(1 + 0.45**2)), "from_geometric_cv", None)),
    (("mean", "Coefficient of Variation", 45.0, None, None, 10), (None, None, "dispersion_type_unsupported")),
    (("mean", "Not Applicable", None, None, None, 10), (None, None, "no_dispersion_reported")),
    (("mean", None, None, None, None, 10), (None, None, "no_dispersion_reported")),
    (("mean", "wobble", 1.0, None, None, 10), (None, None, "dispersion_type_unrecognised")),
    (("Number", "Standard Deviation", 1.0, None, None, 10), (None, None, "param_type_not_continuous")),
    ((None, "Standard Deviation", 1.0, None, None, 10), (None, None, "param_type_unrecognised")),
    (("mean", "Confidence Interval", None, 1.0, 2.0, 10), (None, None, "confidence_level_unstated")),
    (("mean", "40% Confidence Interval", None, 1.0, 2.0, 10), (None, None, "confidence_level_unstated")),
    (("mean", "95% Confidence Interval", None, 1.0, None, 10), (None, None, "no_interval_limits")),
    (("mean", "Standard Deviation", None, None, None, 10), (None, None, "no_dispersion_value")),
]


def test_golden_rows(spark):
    rows = spark.createDataFrame([r for r, _ in ROWS], COLUMNS)
    got = {tuple(r[c] for c in ("param_type", "dispersion_type", "dispersion_value", "lower_limit", "upper_limit", "n")): r for r in d.estimate_sd(rows).collect()}
    for row, (value, method, reason) in ROWS:
        r = got[row]
        assert r["sd_method"] == method and r["sd_skip_reason"] == reason
        assert r["sd_value"] == (None if value is None else pytest.approx(value, rel=1e-7))
    assert got[ROWS[6][0]]["sd_is_approximate"] and got[ROWS[8][0]]["sd_scale"] == "log" and not got[ROWS[0][0]]["sd_is_derived"]


def test_normal_quantile(spark):
    p = [0.001, 0.02, 0.1, 0.5, 0.9, 0.975, 0.999]
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile("p").alias("z")).collect()
    assert all(r["z"] == pytest.approx(q(r["p"]), abs=1e-8) for r in rows)


def test_effects(spark):
    labels = [("Hazard Ratio (HR)", "hazard_ratio", 1.0), ("Odds Ratio (OR)", "odds_ratio", 1.0), ("Mean Difference (Final Values)", "mean_difference", 0.0), ("Cohen's d", "other", None), (None, "unknown", None)]
    rows = spark.createDataFrame([(x[0],) for x in labels], "param_type string").select("param_type", d.effect_kind(d.F.col("param_type")).alias("k"))
    rows = rows.withColumn("v", d.null_value(d.F.col("k"))).collect()
    assert {(r["param_type"], r["k"], r["v"]) for r in rows} == set(labels)


def test_margins(spark):
    texts = [(1, "yes", "margin of -0.10 L"), (2, "yes", "NI margin: 10%"), (3, "yes", "margin of 5, margin of 7"), (4, None, "non-inferiority, no number"), (5, "no", "margin of 3"), (6, "yes", None), (7, "yes", "margin was 5 of the range")]
    rows = spark.createDataFrame([("s", *t) for t in texts], "nct_id string, analysis_id int, non_inferiority string, ni_description string")
    got = {r["analysis_id"]: (r["margin"], r["margin_unit"]) for r in reports.ni_margins(rows).collect()}
    assert got == {1: (-0.1, "L"), 2: (10.0, "%"), 3: (None, None), 4: (None, None), 6: (None, None), 7: (5.0, None)}


def test_quantiles_are_exact(spark, monkeypatch):
    import numpy as np

    from spindrift.operators import reports

    monkeypatch.setattr(reports, "RANGES", 8)
    r = np.random.RandomState(5)
    rows = [("a", None, float(x)) for x in r.randn(997)] + [("b", "u", float(x)) for x in r.randint(0, 3, 400)] + [("c", None, 1.5), (None, None, 2.0), (None, None, 4.0), ("a", None, None), ("d", None, None)]
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(3)
    at = {"median": 0.5, "q1": 0.25, "q3": 0.75, "least": 0.0, "most": 1.0}
    found = {(x["_k"]["g"], x["_k"]["h"]): x for x in reports.quantiles(df, ["g", "h"], "v", at).collect()}
    want: dict = {}
    for g, h, x in rows:
        if x is not None:
            want.setdefault((g, h), []).append(x)
    assert set(found) == set(want)
    for k, values in want.items():
        for name, p in at.items():
            assert abs(found[k][name] - np.quantile(values, p)) < 1e-9, (k, name)
    assert reports.quantiles(df.limit(0), ["g"], "v", at).count() == 0


def test_quantiles_hold_whatever_the_cuts(spark, monkeypatch):
    """An approximation that comes out otherwise each time that it is made, as that of a large table does."""
    import random

    from pyspark.sql import functions as F

    drawn = F.udf(lambda v: sorted(random.uniform(0, v) for _ in range(9)), "array<double>").asNondeterministic()
    monkeypatch.setattr(reports.F, "percentile_approx", lambda column, *_: drawn(F.max(column)))
    df = spark.range(1001).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    for _ in range(3):
        found = {r["_k"]["g"]: (r["median"], r["q1"], r["q3"]) for r in reports.quantiles(df, ["g"], "v", reports.QUARTILES).collect()}
        assert found == {0: (500.0, 250.0, 750.0), 1: (500.0, 250.5, 749.5)}
