"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import re

import pytest

from spindrift.plans import ORACLES, QUERIES
from spindrift.plans.projections import TABLES

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "sd_distribution", "stratify_by_arm_role", "estimate_sd", "resolve_unit", "analysis_distribution", "ni_margins", "tag_synonyms", "pick_longest", "semantic_fallback", "link_reported_to_planned", "link_group_to_arm", "classify_intervention", "scope_filter", "upsert_rows",
    "flatten_planned_outcomes", "flatten_analyses", "flatten_baseline", "form_pairs_across_studies", "conform_outcomes", "disambiguate_timepoint", "derive_direction", "conform_results", "resolve_drug_classes", "resolve_therapeutic_area", "relational_outcome_groups", "relational_analyses",
    "audit_hierarchy", "audit_cascade", "document_variants", "render_parameterised_text", "document_surrogates", "document_selection", "tier_coverage", "registered_not_reported", "build_result_dispersion", "baseline_sd", "sd_distribution_selected",
]


def plain(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.5g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.fixture(scope="module")
def db():
    import duckdb

    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", SOME)
def test_query(spark, db, name):
    sql = db.sql(ORACLES[name])
    assert plain(QUERIES[name](spark, FOLDER).select(*sql.columns).collect()) == plain(sql.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and all(re.fullmatch("[a-z0-9_]+", k) for k in QUERIES)


def test_a_measurement_names_its_forms(spark, db):
    sql = db.sql(ORACLES["same_measurement_other_form"])
    rows = QUERIES["same_measurement_other_form"](spark, FOLDER).select(*sql.columns).collect()
    assert plain(rows) == plain(sql.fetchall())
    assert rows and all(len(seen := r["forms_seen"].split(", ")) == r["forms"] and seen == sorted(set(seen)) for r in rows)


def test_documents_are_made_once_for_their_terms(spark):
    plan = QUERIES["document_surrogates"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
