"""Tagging: whole tokens, capitals, vetoes, picks, prefixes, units, arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import numbers as n
from spindrift.functions import text as t
from spindrift.operators import axes, matching as m, results, scope


def texts(spark, *values):
    return spark.createDataFrame([(v, v) for v in values], "text_id string, text string")


def test_text_folding(spark):
    rows = spark.createDataFrame([(" a \t b – “c” \\(d\\) ", "Placebo  Comparator-x", "STANDARD_DEVIATION (SD)")], "a string, b string, c string")
    r = rows.select(t.normalised(F.col("a")), t.folded_type(F.col("b")), t.folded(F.col("c")), t.stem(F.lit("drug arm")), t.key(F.lit("  "))).first()
    assert tuple(r) == ('a b - "c" (d)', "placebo_comparator_x", "standard_deviation_sd", "drug", None)


def test_numbers(spark):
    values = ["1,204", " 3.5 ", "-2e3", "NA", "<0.001", "99.9%", "1,20", "", None, ".5"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", n.strict(F.col("v")).alias("x")).collect()
    assert {r["v"]: r["x"] for r in rows} == {"1,204": 1204.0, " 3.5 ": 3.5, "-2e3": -2000.0, "NA": None, "<0.001": None, "99.9%": None, "1,20": None, "": None, None: None, ".5": 0.5}


def test_synonyms_are_whole_tokens(spark):
    synonyms = spark.createDataFrame([("os", "OS"), ("survival", "overall survival"), ("percent", "%"), ("pfs", "progression-free survival"), ("x", "X")], "term_id string, synonym string")
    found = m.tag_synonyms(texts(spark, "the OS rate", "os rate", "overall-survival", "Overall  Survival!", "overallsurvival", "50 %", "progression free survival", "Progression-Free Survival", "X"), synonyms).collect()
    assert {(r["text_id"], r["term_id"]) for r in found} == {("the OS rate", "os"), ("overall-survival", "survival"), ("Overall  Survival!", "survival"), ("50 %", "percent"), ("Progression-Free Survival", "pfs")}


def test_vetoes_and_picks(spark):
    hits = spark.createDataFrame([("1", "a", "xx", 2, "synonym"), ("1", "b", "xxxx", 4, "pattern"), ("1", "c", "xxxx", 4, "synonym"), ("2", "a", "x", 1, "pattern")], "text_id string, term_id string, matched_text string, span int, via string")
    guards = spark.createDataFrame([("2", "a")], "text_id string, term_id string")
    assert {r["text_id"] for r in m.apply_vetoes(hits, guards).collect()} == {"1"}
    rank = spark.createDataFrame([("b", 1), ("a", 2)], "term_id string, rank int")
    assert {(r["text_id"], r["term_id"]) for r in m.pick_first(hits, rank).collect()} == {("1", "b"), ("2", "a")}
    order = spark.createDataFrame([("c", 1), ("b", 2), ("a", 3)], "term_id string, ordinal int")
    assert {(r["text_id"], r["term_id"]) for r in m.pick_longest(hits, order).collect()} == {("1", "c"), ("2", "a")}


def test_semantic_scores(spark):
    terms = spark.createDataFrame([("lung", "forced expiratory volume"), ("one", "cough"), ("none", "of the")], "term_id string, vocabulary string")
    got = {r["text_id"]: (r["term_id"], round(r["score"], 3)) for r in m.semantic_scores(texts(spark, "expiratory volume of air", "volume", "a cough", "nothing"), terms).collect()}
    assert got == {"expiratory volume of air": ("lung", 0.667), "a cough": ("one", 1.0)}


def test_prefixes_and_branches(spark):
    trees = spark.createDataFrame([("C04.588.180",), ("C04",), ("C045.1",), ("D01.2",)], "tree_number string")
    rules = spark.createDataFrame([("C04", "oncology"), ("C04.588", "site")], "prefix string, ta_id string")
    assert {(r["tree_number"], r["ta_id"]) for r in axes.match_longest_prefix(trees, rules).collect()} == {("C04.588.180", "site"), ("C04", "oncology")}
    assert spark.range(1).select(axes.branch_to_prefix(F.lit("BC04")), axes.branch_to_prefix(F.lit("C04"))).first()[:] == ("C04", None)


def test_units(spark):
    synonyms = spark.createDataFrame([("litre", "L"), ("litre", "liters"), ("ml", "mL"), ("percent", "percent")], "scale_id string, synonym string")
    units = spark.createDataFrame([(u,) for u in ("L", "l", "Liters (L)", "ML", "percent change", "stones", " liters ")], "unit_raw string")
    got = {r["unit_raw"]: (r["scale_id"], r["unit_method"]) for r in results.resolve_unit(units, synonyms).collect()}
    assert got == {"L": ("litre", "exact"), "l": ("not_stated", None), "Liters (L)": ("litre", "exact"), "ML": ("ml", "exact"), "percent change": ("percent", "syntactic_rule"), "stones": ("not_stated", None), " liters ": ("litre", "exact")}


def test_arms(spark):
    arms = spark.createDataFrame([("s", "Drug arm", "Experimental"), ("s", "Placebo", "Placebo Comparator"), ("one", "Only", None), ("two", "A", None), ("two", "a", None)], "nct_id string, title string, group_type string")
    groups = spark.createDataFrame([("s", "DRUG"), ("s", "placebo "), ("s", "Total"), ("s", "other"), ("s", None), ("one", "x"), ("none", "x"), ("two", "A")], "nct_id string, group_title string")
    got = {(r["nct_id"], r["group_title"]): (r["arm_title"], r["link_method"], r["link_skip_reason"]) for r in results.link_group_to_arm(groups, arms).collect()}
    assert got == {
        ("s", "DRUG"): ("Drug arm", "title_stem", None), ("s", "placebo "): ("Placebo", "exact_title", None), ("s", "Total"): (None, None, "total_group"), ("s", "other"): (None, None, "no_title_match"),
        ("s", None): (None, None, "no_group_title"), ("one", "x"): ("Only", "sole_arm", None), ("none", "x"): (None, None, "no_protocol_arms"), ("two", "A"): (None, None, "ambiguous_title"),
    }


def test_scope(spark):
    known = spark.createDataFrame([("a",), ("b",)], "ta_id string")
    assert scope.split_ids("a, b ,") == ["a", "b"]
    assert [r["ta_id"] for r in scope.unknown_ids(["a", "z"], known, "ta_id").collect()] == ["z"]


def test_id_ranges_cover_each_study_once():
    from spindrift.sources import registry_relational as rel

    ranges = rel.id_ranges(5, 23, 4)
    inside = lambda k, cond: eval(cond.replace("nct_id", repr(f"NCT{k:08d}")).replace("AND", "and"))  # noqa: E731, S307
    assert all(sum(inside(k, c) for c in ranges) == (5 <= k <= 23) for k in range(0, 30))


def test_relational_columns_may_be_absent(spark):
    from spindrift.sources import registry_relational as rel

    outcomes = spark.createDataFrame([(2, "N1", "Primary", "t", None), (1, "N1", "PRIMARY", "t", None), (3, "N1", "Primary", None, "w")], "id long, nct_id string, outcome_type string, title string, time_frame string")
    keys = rel.outcome_keys(outcomes)
    rows = {r["source_id"]: r for r in keys.collect()}
    assert (rows[1]["duplicate_ordinal"], rows[2]["duplicate_ordinal"], rows[3]["ordinal"], rows[3]["units_analyzed"]) == (0, 1, 2, None)
    assert len({r["outcome_id"] for r in rows.values()}) == 3
    mesh = spark.createDataFrame([("A ", "C01"), ("a", "C01"), (None, "C02"), ("b", None)], "name string, tree string")
    assert [tuple(r) for r in rel.mesh_tree_terms(mesh).select("mesh_term_normalised", "tree_number").collect()] == [("a", "C01")]
    p = spark.createDataFrame([("<", "0.05"), ("=", "0.2"), (None, "0.3"), ("<", None), (None, None), ("", "x")], "m string, v string")
    parts = [tuple(r) for r in p.select(*(c.alias(f"c{k}") for k, c in enumerate(rel.p_value_parts(F.col("m"), F.col("v"))))).collect()]
    assert parts == [("<0.05", 0.05, "<"), ("0.2", 0.2, "="), ("0.3", 0.3, "="), (None, None, "<"), (None, None, None), ("x", None, "=")]


def test_classes_of_interventions(spark):
    from spindrift.plans import classes as c

    make = spark.createDataFrame
    rules = make(c.CLASS_RULES, "layer string, key string, class_id string, ordinal int")
    kinds = make(c.CLASSES, "id string, kind string, parent_id string, precedence int").selectExpr("id as class_id", "kind")
    items = make([("S", 1, "Large  Bolt", "Promo"), ("S", 2, "nut widget", None), ("S", 3, "unknown", "ECONOMY"), ("S", 4, None, None), ("S", 5, "x", None)], "nct_id string, ordinal int, name string, intervention_type string")
    names = make([("S", 5, "BRAND#11"), ("S", 5, "nut"), ("S", 4, " ")], "nct_id string, ordinal int, other_name string")
    found = {(r["ordinal"], r["class_id"], r["layer"]) for r in axes.match_interventions(items, names, rules, kinds).collect()}
    assert found == {(1, "statin", "agent_name"), (1, "enzyme", "agent_name"), (1, "device", "name_pattern"), (2, "placebo", "control_rule"), (3, "device", "modality_rule"), (5, "statin", "agent_name")}
