"""Vocabularies, time frames and the conform job."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spindrift.operators import audits, conforming, timepoints
from spindrift.plans import conform
from spindrift.sources import vocabulary as v

FRAMES = [
    ("As long as it takes", "event_driven"), ("until relapse or month 9", "event_driven"), ("From entry to day 5", "baseline_to_timepoint"), ("3 weeks after baseline", "baseline_to_timepoint"), ("From screening upto week two", "baseline_to_timepoint"), ("as late as week 8", "cumulative_window"),
    ("Month 3", "single_fixed"), ("in the 2nd year", "single_fixed"), ("5 wks", "bare_duration"), ("each of nights 1, 2 and 3", "multi_timepoint"), ("week 1; week 4", "multi_timepoint"), ("2 days past arrival", "anchored_offset"), ("Day 30 ± 4", "visit_window"),
    ("at dialysis", "event_relative"), ("On entry", "baseline_only"), ("as late as 3 days after delivery", "cumulative_window"), ("all through 6 months.", "cumulative_window"), ("", "unspecified"), ("whenever", "unspecified"), ("week", "unspecified"),
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return v.from_rows(spark, conform.TABLE_ROWS)


def test_time_frames(spark, vocabulary):
    frames = spark.createDataFrame(FRAMES, "time_frame string, want string")
    found = {r["time_frame"]: r for r in timepoints.classify(frames, vocabulary).collect()}
    assert {t: found[t]["timepoint_pattern"] for t, _ in FRAMES} == dict(FRAMES)
    assert found["Day 30 ± 4"]["extracted"] == {"value": "30", "window_pm": "4", "unit": "Day"} and found[""]["match_method"] is None
    assert timepoints.classify(spark.createDataFrame([], "time_frame string"), vocabulary).count() == 0
    assert timepoints.classify(spark.createDataFrame([(None,)], "time_frame string"), vocabulary).first()["timepoint_pattern"] == "unspecified"


def test_preparation_steps(spark, vocabulary):
    rules = timepoints.load_rules(vocabulary)
    cases = {
        "Week 24 (Visit 5) (end)": "Week 24", "at the end (Week 24)": "at the end (Week 24)", "(week 2) then week 4 (visit)": "then week 4", "twenty-four wks": "24 weeks", "24-week": "24 week", "Week- 3": "Week 3", "3rd of 12": "3 of 12",
        "90 + / - 7 days.;": "90 ± 7 days", "week 1、week 2": "week 1,week 2", "a – b": "a - b", "basline": "baseline", None: "",
    }
    rows = spark.createDataFrame([(x,) for x in cases], "t string").select("t", timepoints.prepared(F.col("t"), rules).alias("p")).collect()
    assert {r["t"]: r["p"] for r in rows} == cases
    with pytest.raises(ValueError):
        timepoints.prepared(F.lit("x"), rules._replace(steps=["no such step"]))


def test_group_names():
    assert timepoints.numbered(r"a(?P<x>\d)(?:b|(c))[(](?P<x2>d)\(") == (r"a(\d)(?:b|(c))[(](d)\(", [("x", 1), ("x", 3)])


def test_thresholds(spark):
    texts = {
        "at least 75% better": (">=", 75.0, "%"), "PASI75 response": (">=", 75.0, "%"), "no more than 3 points": ("<=", 3.0, "points"), "≥ 2.5 mmHg": (">=", 2.5, "mmHg"), "fewer than 10 percent": ("<", 10.0, "%"), "= 5": ("=", 5.0, None),
        "Week 12": None, "ACR 20": (">=", 20.0, "%"), "": None, "above average": None,
    }
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", conforming.threshold(F.col("t")).alias("x")).collect()
    assert {r["t"]: None if r["x"] is None else tuple(r["x"]) for r in rows} == texts


def planned(spark, *rows):
    """(measure, time_frame, description) of studies N1, N2, ..."""
    return spark.createDataFrame([(f"N{k}", "primary", m, t, d, None) for k, (m, t, d) in enumerate(rows, 1)], "nct_id string, outcome_type string, measure string, time_frame string, description string, population string")


def test_conform_job(spark, vocabulary):
    outcomes = planned(
        spark, ("PFS", "Week 4", None), ("PFS", "3 months past randomisation", None), ("Proportion of participants with adverse events", "from baseline up to week 8", None), ("Proportion of participants with response", "from baseline up to week 8", None),
        ("something else", "Baseline", "nothing known"), (None, None, None), ("Time to hospitalization", "Week 4", None), ("body weight", "from baseline to week 4", None), ("life and quality index", None, None), ("Time to recovery", "1 year", "FEV1"),
    )
    studies = spark.createDataFrame([("N1", "RANDOMIZED"), ("N2", "NA")], "nct_id string, allocation string")
    areas = spark.createDataFrame([("N8", "furniture", True), ("N8", "other", False)], "nct_id string, ta_id string, is_primary boolean")
    rows = conforming.conformed(outcomes.unionByName(outcomes), vocabulary, studies, areas)
    ends = {r["nct_id"]: r for r in conforming.endpoints(rows).collect()}
    queue = {r["nct_id"]: r for r in conforming.review_queue(rows).collect()}
    assert set(ends) == {"N1", "N2", "N3", "N4", "N7", "N8", "N9", "N10"} and set(queue) == {"N5", "N6"}
    pfs = ends["N1"]
    assert (pfs["measurement_id"], pfs["form_id"], pfs["event_id"], pfs["reference_id"], pfs["form_match_method"]) == ("survival", "time_to_event", "progression", "from_randomisation", "named_endpoint")
    assert ends["N2"]["reference_match_method"] == "exact" and ends["N2"]["form_match_method"] == "implied"
    assert (ends["N3"]["form_id"], ends["N4"]["form_id"]) == ("incidence_proportion", "responder_proportion")
    assert (ends["N3"]["timepoint_pattern"], ends["N4"]["timepoint_pattern"]) == ("baseline_to_timepoint", "cumulative_window")
    assert (ends["N7"]["direction_id"], ends["N8"]["direction_id"], ends["N9"]["measurement_match_method"]) == ("longer_is_better", "increase_is_better", "semantic")
    assert (ends["N10"]["event_id"], ends["N10"]["direction_id"], ends["N10"]["measurement_source_field"]) == ("recovery", "shorter_is_better", "description")
    assert queue["N5"]["reason"] == "measurement_unmatched" and queue["N6"]["best_semantic_candidate"] is None
    # The same rows in another layout give the same result; no rows give none.
    again = conforming.conformed(outcomes.repartition(5), vocabulary, studies, areas)
    assert sorted(map(str, conforming.endpoints(again).collect())) == sorted(map(str, ends.values()))
    assert conforming.conformed(outcomes.limit(0), vocabulary, studies, areas).count() == 0


def test_a_table_of_texts_past_the_bound_is_joined_by_shuffle(spark, vocabulary):
    rows = planned(spark, ("PFS", "Week 4", "FEV1"), (None, None, None), ("mean body weight", "from baseline to week 4", None), ("", "", "Cmax")).withColumn("id", F.col("nct_id"))
    rows = conforming.hashed(rows.unionByName(rows.withColumn("id", F.concat("id", F.lit("x")))))
    here, there = (conforming.matched(rows, vocabulary, most) for most in (1 << 40, -1))
    text = lambda df: sorted(str(r.asDict(True)) for r in df.select("id", "in_measure", "in_description", "in_time_frame", "frame").collect())
    assert text(here) == text(there) and here.count() == 8


def test_the_conform_plan_has_no_product_and_few_scans(spark, tmp_path):
    """Over real tables: outcomes are read once, rules are broadcast, and only the studies' two tables are joined by shuffle."""
    from spindrift.plans.projections import Data

    data = Data(spark, "/root/testdata/sf0.001")
    texts = conforming.written(conforming.texts_of(conform.outcomes(data)), "texts")
    for df in (conforming.dimension_hits(texts, conform.vocabulary(data)), conforming.conformed(conform.outcomes(data), conform.vocabulary(data), data.view("p_studies"), data.view("p_study_ta"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("lineitem.parquet") == 0 and plan.count("SortMergeJoin") <= 2


def test_dimensions_are_resolved_once_for_each_case(spark, vocabulary, monkeypatch):
    seen, resolved = [], conforming.resolved
    monkeypatch.setattr(conforming, "resolved", lambda cases, v: seen.append(cases.count()) or resolved(cases, v))
    rows = planned(spark, *[("PFS", f"Week {k % 5}", None) for k in range(40)], *[("PFS", "3 months past randomisation", None)] * 3)
    studies, areas = (spark.createDataFrame([], s) for s in ("nct_id string, allocation string", "nct_id string, ta_id string, is_primary boolean"))
    assert conforming.conformed(rows, vocabulary, studies, areas).count() == 43 and seen == [2]


def test_no_outcome_is_written_with_its_dimensions(spark, vocabulary, monkeypatch):
    """The tables on the way are outcomes as they stand, texts and cases; past the bounds the rows are the same."""
    made = {}
    keep = lambda name, build: made.setdefault(name, None) or made.update({name: conforming.written(build(), f"test-{name}")}) or made[name]
    texts = [("PFS", f"Week {k % 5}", None) for k in range(40)] + [("PFS", "", ""), ("", None, "Cmax"), ("body weight", "3 months past randomisation", None), ("Proportion of participants with response", "from baseline up to week 8", None)]
    studies = spark.createDataFrame([("N1", "RANDOMIZED"), ("N2", ""), ("N3", None)], "nct_id string, allocation string")
    areas = spark.createDataFrame([("N43", "furniture", True), ("N4", "", True), ("N5", None, True)], "nct_id string, ta_id string, is_primary boolean")
    job = lambda *more: conforming.conformed(planned(spark, *texts), vocabulary, studies, areas, *more)
    text = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    here = text(job(keep))
    assert set(made) == {"rows", "found", "cases"} and "measurement" not in made["rows"].columns and made["cases"].count() < 10
    assert text(job(keep)) == here and len(here) == 44
    monkeypatch.setattr(conforming, "in_bounds", lambda *_: False)
    assert text(job()) == here


def test_a_report_makes_only_what_it_reaches(spark, monkeypatch):
    monkeypatch.setattr(conform, "reported", lambda data: pytest.fail("form_breakdown reads no reported outcomes"))
    from spindrift.plans import QUERIES

    assert QUERIES["form_breakdown"](spark, "/root/testdata/sf0.001").count() > 0


def test_cycles_of_walks_need_no_closure(spark, monkeypatch):
    """One parent for each child: rings of several lengths with tails of several lengths, and chains that end."""
    monkeypatch.setattr(audits, "ancestors", lambda edges: pytest.fail("the closure grows with the depth"))
    edges, wanted = [("s", "s"), (None, "a"), ("a", None)], {"s": "s"}
    for n, tail in ((2, 9), (3, 0), (7, 40), (20, 3)):
        ring = [f"r{n:02}-{k * 7 % n if n % 7 else k:02}" for k in range(n)]
        edges += [(x, ring[(k + 1) % n]) for k, x in enumerate(ring)] + [(f"t{n}-{k}", f"t{n}-{k + 1}" if k + 1 < tail else ring[n // 2]) for k in range(tail)]
        wanted |= {x: min(ring) for x in ring}
    edges += [(f"c{k}", f"c{k + 1}") for k in range(50)] + [(f"d{k}", f"d{k + 1}") for k in range(11)]
    found = audits.cycles(spark.createDataFrame(edges, "child string, parent string")).collect()
    assert {r["id"]: r["cycle"] for r in found} == wanted and len(found) == len(wanted)
    chains = [e for e in edges if e[0] and e[0][0] in "cd"]
    assert audits.cycles(spark.createDataFrame(chains, "child string, parent string")).count() == 0


def test_vocabulary_documents_are_flattened_and_kept(spark, tmp_path):
    form = {"dimension": "form", "precedence": ["b", "a"], "fallback": "not_stated", "cascade": [{"field": "measure", "match_method": "exact"}], "terms": [{"id": "a", "label": "A", "synonyms": ["x", "y"]}, {"id": "b", "label": "B", "patterns": ["p1", "p2"], "not_if_matches": ["g"]}]}
    (tmp_path / "form.json").write_text(json.dumps(form))
    tables = v.flattened(v.read_documents(spark, str(tmp_path)))
    rows = lambda name: sorted(map(str, map(tuple, tables[name].collect())))
    assert rows("terms") == sorted(map(str, [("form", "a", "A", 0), ("form", "b", "B", 1)]))
    assert rows("patterns") == sorted(map(str, [("form", "b", "p1", "match", 0), ("form", "b", "p2", "match", 1), ("form", "b", "g", "guard", 0)]))
    assert rows("cascade") == sorted(map(str, [("form", 0, "measure", "exact", None), ("form", 1, None, None, "not_stated")]))
    assert rows("precedence") == sorted(map(str, [("form", "b", 0), ("form", "a", 1)])) and tables["synonyms"].count() == 2
    made = v.Vocabulary(spark, tables)
    v.save(made, str(tmp_path / "kept"))
    back = v.load(spark, str(tmp_path / "kept"), ["terms", "synonyms", "scales"])
    assert back["terms"].count() == 2 and back["scales"].count() == 0 and back.of("synonyms", "form").count() == 2
    with pytest.raises(ValueError):
        v.Vocabulary(spark, {"nothing": tables["terms"]})


def test_audits_are_silent_on_a_sound_vocabulary(spark, vocabulary):
    t = vocabulary
    assert audits.ids(t["terms"].where("dimension <> 'polarity_cue'")).count() == 0
    assert audits.precedence(t["terms"], t["precedence"]).count() == 0
    assert audits.cascades(t["cascade"], t["confidence"], list(conforming.FIELDS)).count() == 0
    assert audits.units(t["scales"]).count() == 0 and audits.concepts(t["concepts"], t["measurements"]).count() == 0
    assert audits.named_endpoints(t["named_endpoints"], t["forms"], t["events"], t["measurements"]).count() == 0
    ring = spark.createDataFrame([("a", "b", "k", 1), ("b", "c", "k", 2), ("c", "a", "k", 3), ("d", "x", "k", 4)], "id string, parent_id string, kind string, precedence int")
    far = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(40)], "child string, parent string")
    found = {(r["child"], r["ancestor"]): r["depth"] for r in audits.ancestors(far).collect()}
    assert found == {(f"n{a:02}", f"n{b:02}"): b - a for a in range(41) for b in range(a + 1, 41)}
    rings = [(f"r{k:02}", f"r{(k + 1) % 20:02}") for k in range(20)] + [("tail", "r03"), ("self", "self"), ("x", "y"), ("y", "x"), (None, "x"), ("x", None)]
    cycles = {r["id"]: r["cycle"] for r in audits.cycles(spark.createDataFrame(rings, "child string, parent string")).collect()}
    assert cycles == {f"r{k:02}": "r00" for k in range(20)} | {"self": "self", "x": "x", "y": "x"}
    assert audits.cycles(spark.createDataFrame([], "child string, parent string")).count() == 0
    assert {(r["rule"], r["key"]) for r in audits.hierarchy(ring).collect()} == {("cycle", "a"), ("cycle", "b"), ("cycle", "c"), ("parent_unknown", "x"), ("not_before_parent", "c")}


def test_ancestors_of_walks_are_never_joined_with_themselves(spark, monkeypatch):
    """Chains, trees and rings of many lengths against walking; what is written grows with the nodes, not with the pairs' ways."""
    parent = {f"c{k}": f"c{k + 1}" for k in range(200)} | {f"t{k}": f"t{k // 3}" for k in range(1, 60)} | {f"r{k}": f"r{(k + 1) % 35}" for k in range(35)}
    parent |= {f"s{k}": f"s{(k + 1) % 3}" for k in range(3)} | {f"i{k}": f"i{k + 1}" for k in range(50)} | {"i50": "r7", "j0": "i3", "u0": "s1", "u1": "u0", "self": "self", "v": "self"}
    want = {}
    for child in parent:
        at, n = parent[child], 1
        while at is not None and (child, at) not in want:
            want[child, at] = n
            at, n = parent.get(at), n + 1
    kept, rows = audits._kept, []
    monkeypatch.setattr(audits, "_kept", lambda df: rows.append((out := kept(df)).count()) or out)
    found = audits.ancestors(spark.createDataFrame(list(parent.items()), "child string, parent string")).collect()
    assert len(found) == len(want) and {(r["child"], r["ancestor"]): r["depth"] for r in found} == want
    assert max(rows) < len(want) / 8


def test_ancestors_of_several_parents_take_the_shortest_way(spark):
    edges = [(f"n{k}", f"n{k + 1}") for k in range(40)] + [("n3", "n30"), ("n40", "n12"), ("n5", "m"), ("m", "n9"), ("n0", "n0")]
    want = {}
    for child in {a for a, _ in edges}:
        seen, level, n = {}, {b for a, b in edges if a == child}, 1
        while level:
            seen |= dict.fromkeys(level, n)
            level, n = {b for a, b in edges if a in level} - set(seen), n + 1
        want |= {(child, b): d for b, d in seen.items()}
    found = audits.ancestors(spark.createDataFrame(edges, "child string, parent string")).collect()
    assert len(found) == len(want) and {(r["child"], r["ancestor"]): r["depth"] for r in found} == want
