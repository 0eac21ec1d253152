"""Coverage, comparability and convention reports over the conform job's tables, links and axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import axes, reports, results, scope
from . import classes
from .conform import ALL_VIEWS, REPORT_TABLES, plain
from .matching import _values
from .projections import Data
from .registry import ORACLES, query, report

#: Reported and planned outcomes that agree in study and measurement, as the reports on both sides need them: distinct keys only.
SHARED = {
    "q_planned_keys": "SELECT DISTINCT nct_id, measurement_id FROM e_endpoints", "q_reported_keys": "SELECT DISTINCT nct_id, measurement_id FROM er_endpoints",
    "q_d": "SELECT DISTINCT measurement_id, form_id, nct_id FROM e_endpoints", "q_n": "SELECT measurement_id, form_id, count(*) AS n FROM q_d GROUP BY measurement_id, form_id",
    "q_both": "SELECT x.measurement_id, x.form_id AS form_a, y.form_id AS form_b, count(*) AS n FROM q_d x JOIN q_d y ON x.nct_id = y.nct_id AND x.measurement_id = y.measurement_id AND x.form_id < y.form_id GROUP BY x.measurement_id, x.form_id, y.form_id",
}
#: What reports read besides the conform job's sinks: areas and classes as the resolvers find them, and the same for the oracle.
MADE = REPORT_TABLES | {"r_study_ta": classes.study_areas, "r_study_class": classes.study_classes}
AXES = ALL_VIEWS | classes.ORACLE | {"r_study_ta": "SELECT nct_id, ta_id, is_primary FROM x_area", "r_study_class": "SELECT nct_id, class_id, kind, is_primary FROM x_study"}
#: Reports over what the conform job writes (``e_``) and what it makes of reported titles (``er_``).
REPORTS: dict[str, str] = {
    "conformance_rate": "SELECT planned, conformed, round(CAST(conformed AS DOUBLE) / planned, 6) AS share FROM (SELECT (SELECT count(*) FROM e_endpoints) + (SELECT count(*) FROM e_queue) AS planned, (SELECT count(*) FROM e_endpoints) AS conformed) x",
    "queue_reasons": "SELECT reason, count(*) AS n, count(DISTINCT nct_id) AS studies FROM e_queue WHERE status = 'pending' GROUP BY reason",
    "method_mix": "SELECT match_method, count(*) AS n, round(avg(confidence), 6) AS confidence FROM e_endpoints GROUP BY match_method",
    "near_misses": "SELECT near_miss, count(*) AS n, round(max(near_score), 6) AS best FROM e_queue WHERE near_miss IS NOT NULL GROUP BY near_miss",
    "queue_would_join": "SELECT q.near_miss, count(*) AS n, count(DISTINCT q.nct_id) AS studies FROM e_queue q JOIN (SELECT DISTINCT measurement_id FROM e_endpoints) m ON q.near_miss = m.measurement_id WHERE near_score >= 0.2e0 GROUP BY q.near_miss",
    "form_breakdown": "SELECT form_id, count(*) AS n, count(DISTINCT nct_id) AS studies FROM e_endpoints GROUP BY form_id",
    "top_measurements": "SELECT measurement_id, count(*) AS n FROM e_endpoints GROUP BY measurement_id ORDER BY n DESC, measurement_id LIMIT 5",
    "direction_check": "SELECT form_id, direction_id, count(*) AS n FROM e_endpoints GROUP BY form_id, direction_id",
    "same_measurement_other_form": "SELECT measurement_id, count(DISTINCT form_id) AS forms, count(DISTINCT nct_id) AS studies, array_join(array_sort(collect_list(DISTINCT form_id)), ', ') AS forms_seen FROM e_endpoints GROUP BY measurement_id HAVING count(DISTINCT form_id) > 1 AND count(DISTINCT nct_id) > 1",
    # Pairs of studies that measure the same thing in two forms, counted without forming them.
    "form_pairs_across_studies": """SELECT a.measurement_id, a.form_id AS form_a, b.form_id AS form_b, a.n * b.n - coalesce(c.n, 0) AS study_pairs
        FROM q_n a JOIN q_n b ON a.measurement_id = b.measurement_id AND a.form_id < b.form_id LEFT JOIN q_both c ON c.measurement_id = a.measurement_id AND c.form_a = a.form_id AND c.form_b = b.form_id""",
    "same_concept_other_instrument": "SELECT a.concept_id, a.measurement_id AS instrument_a, b.measurement_id AS instrument_b, a.n AS studies_a, b.n AS studies_b FROM (SELECT concept_id, measurement_id, count(DISTINCT nct_id) AS n FROM e_endpoints GROUP BY 1, 2) a JOIN (SELECT concept_id, measurement_id, count(DISTINCT nct_id) AS n FROM e_endpoints GROUP BY 1, 2) b ON a.concept_id = b.concept_id AND a.measurement_id < b.measurement_id",
    "threshold_conventions": "SELECT measurement_id, form_id, threshold_comparator, threshold_value, threshold_unit, count(DISTINCT nct_id) AS studies, count(*) FILTER (WHERE match_method = 'exact') AS exact_matches, round(avg(confidence), 6) AS confidence FROM e_endpoints WHERE threshold_value IS NOT NULL GROUP BY measurement_id, form_id, threshold_comparator, threshold_value, threshold_unit",
    "timepoint_mix": "SELECT timepoint_pattern_id AS pattern_id, count(*) AS n, count(DISTINCT time_frame) AS frames FROM e_endpoints GROUP BY timepoint_pattern_id",
    "unspecified_timeframes": "SELECT time_frame, count(*) AS n FROM e_endpoints WHERE timepoint_pattern_id = 'unspecified' GROUP BY time_frame",
    "ta_by_form": "SELECT ta_id, form_id, count(*) AS n FROM e_endpoints e JOIN r_study_ta t ON e.nct_id = t.nct_id WHERE is_primary GROUP BY ta_id, form_id",
    "endpoint_landscape": "SELECT ta_id, measurement_id, count(DISTINCT e.nct_id) AS studies FROM e_endpoints e JOIN r_study_ta t ON e.nct_id = t.nct_id WHERE is_primary AND outcome_type = 'primary' GROUP BY ta_id, measurement_id HAVING count(DISTINCT e.nct_id) > 2",
    "study_profile": "SELECT nct_id, outcome_type, form_id, measurement_id, timepoint_pattern_id, direction_id, count(*) AS n FROM e_endpoints GROUP BY nct_id, outcome_type, form_id, measurement_id, timepoint_pattern_id, direction_id",
    "class_endpoint_convention": "SELECT class_id, measurement_id, count(DISTINCT e.nct_id) AS studies FROM e_endpoints e JOIN r_study_class c ON e.nct_id = c.nct_id WHERE is_primary AND outcome_type = 'primary' GROUP BY class_id, measurement_id HAVING count(DISTINCT e.nct_id) > 2",
    "endpoint_adoption_by_year": "SELECT class_id, CAST(year(start_date) AS INT) AS y, count(DISTINCT e.nct_id) AS studies, count(DISTINCT e.nct_id) FILTER (WHERE form_id = 'time_to_event') AS with_time_to_event FROM e_endpoints e JOIN p_studies s ON e.nct_id = s.nct_id JOIN r_study_class c ON c.nct_id = e.nct_id GROUP BY class_id, CAST(year(start_date) AS INT) HAVING count(DISTINCT e.nct_id) > 1",
    "results_posting_coverage": """SELECT (SELECT count(*) FROM p_studies) AS pulled, (SELECT count(*) FROM p_studies WHERE lower(trim(has_results_text)) = 'yes') AS flagged, (SELECT count(DISTINCT nct_id) FROM d_reported) AS landed, (SELECT count(DISTINCT nct_id) FROM e_endpoints) AS conformed,
        (SELECT count(DISTINCT p.nct_id) FROM e_endpoints p LEFT SEMI JOIN d_reported r ON p.nct_id = r.nct_id) AS both_sides""",
    "reported_not_registered": "SELECT r.nct_id, r.endpoint_id, r.measure FROM er_endpoints r LEFT ANTI JOIN q_planned_keys p ON p.nct_id = r.nct_id AND p.measurement_id = r.measurement_id",
    "registered_not_reported": "SELECT p.nct_id, p.endpoint_id FROM e_endpoints p LEFT SEMI JOIN (SELECT DISTINCT nct_id FROM er_endpoints) s ON s.nct_id = p.nct_id LEFT ANTI JOIN q_reported_keys r ON p.nct_id = r.nct_id AND p.measurement_id = r.measurement_id WHERE p.outcome_type = 'primary'",
    "reported_other_form": "SELECT p.form_id AS planned_form, r.form_id AS reported_form, count(*) AS n FROM e_endpoints p JOIN er_endpoints r ON p.nct_id = r.nct_id AND p.measurement_id = r.measurement_id AND p.form_id <> r.form_id GROUP BY p.form_id, r.form_id",
}
for _key, _sql in REPORTS.items():
    report(_key, _sql, MADE, AXES, SHARED)
    ORACLES[_key] = ORACLES[_key].replace("LEFT SEMI JOIN", "SEMI JOIN").replace("LEFT ANTI JOIN", "ANTI JOIN").replace("array_join(array_sort(collect_list(DISTINCT form_id)), ', ')", "string_agg(DISTINCT form_id, ', ' ORDER BY form_id)")

@query("SELECT queue_id, reason FROM e_queue WHERE status = 'pending' AND near_miss = 'quality_of_life' ORDER BY near_score DESC, queue_id LIMIT 20", ALL_VIEWS)
def review_backlog(data: Data) -> DataFrame:
    """The pending rows that come nearest to a term, a page of them."""
    rows = REPORT_TABLES["e_queue"](data).where("near_miss = 'quality_of_life'").withColumn("queued_at", -F.col("near_score"))
    return reports.review_backlog(rows, reason="measurement_unmatched", most=20).select("queue_id", "reason")


_FIELD = "SELECT '{0}' AS field, trim({0}) AS value, count(*) AS n FROM p_outcomes WHERE trim({0}) <> '' GROUP BY trim({0})"


@query(
    f"""SELECT field, value, n, n < 20 AS in_tail FROM (SELECT *, row_number() OVER (PARTITION BY field, n >= 20 ORDER BY md5(value || '|7'), value) AS r
    FROM ({' UNION ALL '.join(_FIELD.format(f) for f in ('measure', 'time_frame', 'description'))}) c) x WHERE n >= 20 OR r <= 15"""
)
def vocab_frequency_sample(data: Data) -> DataFrame:
    return reports.frequency_sample(data.view("p_outcomes"), ["measure", "time_frame", "description"], 20, 15, "7")


@query("SELECT line_id, measure FROM p_outcomes ORDER BY md5(CAST(line_id AS VARCHAR(20)) || '|11'), line_id, measure LIMIT 50")
def vocab_row_sample(data: Data) -> DataFrame:
    rows = data.view("p_outcomes").select("line_id", "measure")
    return rows.orderBy(F.md5(F.concat(F.col("line_id").cast("string"), F.lit("|11"))), "line_id", "measure").limit(50)  # a sampling operator


_LINKED = """SELECT r.nct_id AS nct_id, r.endpoint_id AS outcome_id, r.form_id AS form_id, CASE WHEN t.planned_id IS NOT NULL THEN 'exact_title' WHEN u.nct_id IS NOT NULL THEN 'unconformed_title' WHEN m.planned_id IS NOT NULL THEN 'measurement' ELSE 'unlinked' END AS link_method,
    CASE WHEN t.planned_id IS NOT NULL THEN t.planned_id WHEN u.nct_id IS NULL THEN m.planned_id END AS planned_id, CASE WHEN t.planned_id IS NOT NULL THEN t.form_id WHEN u.nct_id IS NULL THEN m.form_id END AS planned_form
    FROM er_endpoints r LEFT JOIN (SELECT nct_id, lower({key}) AS k, min(endpoint_id) AS planned_id, arg_min(form_id, endpoint_id) AS form_id FROM e_endpoints GROUP BY 1, 2) t ON r.nct_id = t.nct_id AND lower({mine}) = t.k
    LEFT JOIN (SELECT DISTINCT nct_id, lower({key}) AS k FROM e_queue) u ON r.nct_id = u.nct_id AND lower({mine}) = u.k
    LEFT JOIN (SELECT nct_id, measurement_id, derivation_id, min(endpoint_id) AS planned_id, arg_min(form_id, endpoint_id) AS form_id FROM e_endpoints GROUP BY ALL) m ON r.nct_id = m.nct_id AND r.measurement_id = m.measurement_id AND r.derivation_id IS NOT DISTINCT FROM m.derivation_id""".format(key=plain("measure"), mine=plain("r.measure"))
LINK_VIEWS = ALL_VIEWS | {"q_linked": _LINKED}


def links(data: Data) -> DataFrame:
    tables = {n: REPORT_TABLES[n](data) for n in ("e_endpoints", "e_queue", "er_endpoints")}
    mine = tables["er_endpoints"].withColumnsRenamed({"endpoint_id": "outcome_id", "measure": "title"})
    return results.link_reported_to_planned(mine, tables["e_endpoints"], tables["e_queue"])


@query("SELECT nct_id, outcome_id, link_method, planned_id FROM q_linked", LINK_VIEWS)
def link_reported_to_planned(data: Data) -> DataFrame:
    return links(data).select("nct_id", "outcome_id", "link_method", "planned_id")


@query("SELECT link_method, count(*) AS n, count(CASE WHEN form_id = planned_form THEN 1 END) AS agreeing FROM q_linked GROUP BY link_method", LINK_VIEWS)
def title_link_coverage(data: Data) -> DataFrame:
    return links(data).groupBy("link_method").agg(F.count(F.lit(1)).alias("n"), F.count_if("form_agrees").alias("agreeing"))


@query("SELECT 'unlinked_to_planned' AS reason, outcome_id AS id, CAST(NULL AS VARCHAR) AS near_miss FROM q_linked WHERE link_method = 'unlinked' UNION ALL SELECT 'measurement_unmatched', queue_id, near_miss FROM er_queue", LINK_VIEWS)
def results_review(data: Data) -> DataFrame:
    unlinked = links(data).where("link_method = 'unlinked'").select(F.lit("unlinked_to_planned").alias("reason"), F.col("outcome_id").alias("id"), F.lit(None).cast("string").alias("near_miss"))
    return unlinked.unionByName(REPORT_TABLES["er_queue"](data).select("reason", F.col("queue_id").alias("id"), "near_miss"))


GROUPS = {
    "q_groups": "SELECT DISTINCT 'NCT' || lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0') AS nct_id, CASE WHEN l_linenumber = 1 THEN 'Total' WHEN l_linenumber = 2 THEN 'arm  ' || l_returnflag WHEN l_linenumber = 3 THEN 'Arm ' || l_returnflag || ' group' WHEN l_linenumber = 4 THEN 'Somebody' END AS group_title FROM lineitem"
}


_LINKS_SQL = (
    """SELECT g.nct_id, g.group_title, CASE WHEN skip IS NULL THEN CASE WHEN n_exact = 1 THEN x.title WHEN n_stem = 1 THEN s.title ELSE a.title END END AS arm_title,
      CASE WHEN skip IS NULL THEN CASE WHEN n_exact = 1 THEN 'exact_title' WHEN n_stem = 1 THEN 'title_stem' ELSE 'sole_arm' END END AS link_method, skip AS link_skip_reason
    FROM (SELECT g.*, n_exact, n_stem, CASE WHEN k IS NULL THEN 'no_group_title' WHEN n_arms IS NULL THEN 'no_protocol_arms' WHEN k = 'total' THEN 'total_group' WHEN n_exact > 1 THEN 'ambiguous_title' WHEN n_exact = 1 THEN NULL
        WHEN n_stem > 1 THEN 'ambiguous_title' WHEN n_stem = 1 THEN NULL WHEN n_arms = 1 AND n_titles = 1 THEN NULL ELSE 'no_title_match' END AS skip
      FROM q_keys g LEFT JOIN (SELECT nct_id, count(*) AS n_arms FROM p_arms GROUP BY nct_id) n ON n.nct_id = g.nct_id
      LEFT JOIN (SELECT nct_id, lower(title) AS tk, count(*) AS n_exact FROM p_arms GROUP BY 1, 2) e ON e.nct_id = g.nct_id AND e.tk = g.k
      LEFT JOIN (SELECT nct_id, lower(title) AS tk, count(*) AS n_stem FROM p_arms GROUP BY 1, 2) m ON m.nct_id = g.nct_id AND m.tk = g.s
      LEFT JOIN (SELECT nct_id, count(DISTINCT k) AS n_titles FROM q_keys WHERE k <> 'total' GROUP BY nct_id) t ON t.nct_id = g.nct_id) g
    LEFT JOIN p_arms x ON x.nct_id = g.nct_id AND lower(x.title) = g.k LEFT JOIN p_arms s ON s.nct_id = g.nct_id AND lower(s.title) = g.s
    LEFT JOIN (SELECT nct_id, min(title) AS title FROM p_arms GROUP BY nct_id) a ON a.nct_id = g.nct_id"""
)
LINKS_VIEWS = GROUPS | {"q_keys": "SELECT *, regexp_replace(k, '\\s+(arm|group|cohort)$', '') AS s FROM (SELECT nct_id, group_title, lower(regexp_replace(trim(group_title), '\\s+', ' ', 'g')) AS k FROM q_groups) x"}


@query(_LINKS_SQL, LINKS_VIEWS)
def link_group_to_arm(data: Data) -> DataFrame:
    return group_links(data).select("nct_id", "group_title", "arm_title", "link_method", "link_skip_reason")


def group_links(data: Data) -> DataFrame:
    from .projections import with_views

    return results.link_group_to_arm(data.sql(with_views("SELECT * FROM q_groups", GROUPS)), data.view("p_arms"))


@query("SELECT link_method, link_skip_reason, count(*) AS n, count(DISTINCT nct_id) AS studies FROM q_links GROUP BY link_method, link_skip_reason", LINKS_VIEWS | {"q_links": _LINKS_SQL})
def arm_link_coverage(data: Data) -> DataFrame:
    """How result groups met arms, and why others did not."""
    return group_links(data).groupBy("link_method", "link_skip_reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nct_id").alias("studies"))


@query("SELECT coalesce(a.group_type, 'untyped') AS arm_type, count(*) AS n FROM p_measurements m LEFT JOIN p_arms a ON m.nct_id = a.nct_id AND m.group_title = a.title WHERE m.dispersion_value IS NOT NULL GROUP BY 1")
def arm_link_summary(data: Data) -> DataFrame:
    """Rows with a stated spread by the type of their arm, through the arm links."""
    rows = data.view("p_measurements").where("dispersion_value is not null")
    linked = results.link_group_to_arm(rows.select("nct_id", "group_title"), data.view("p_arms")).where("link_method is not null").select("nct_id", "group_title", "arm_title")
    types = data.view("p_arms").select("nct_id", F.col("title").alias("arm_title"), "group_type")
    both = rows.join(linked, ["nct_id", "group_title"], "left").join(types, ["nct_id", "arm_title"], "left")
    return both.groupBy(F.coalesce("group_type", F.lit("untyped")).alias("arm_type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT nct_id, title, CASE WHEN group_type = 'Experimental' THEN 'experimental' WHEN group_type = 'Placebo Comparator' THEN 'control' WHEN all_control THEN 'control' END AS arm_role,
    CASE WHEN group_type IS NOT NULL THEN 'group_type' WHEN all_control THEN 'drug_class' END AS role_source,
    coalesce(group_type = 'Experimental' AND coalesce(all_control, FALSE) OR group_type = 'Placebo Comparator' AND coalesce(any_active, FALSE), FALSE) AS role_conflict
    FROM p_arms a LEFT JOIN (SELECT nct_id AS c_id, group_title, bool_and(kind = 'control') AS all_control, bool_or(kind <> 'control') AS any_active FROM q_classes GROUP BY 1, 2) k ON a.nct_id = c_id AND a.title = k.group_title""",
    {"q_classes": "SELECT DISTINCT nct_id, group_title, CASE WHEN intervention_type = 'ECONOMY' THEN 'control' ELSE 'active' END AS kind FROM p_interventions"},
)
def arm_role(data: Data) -> DataFrame:
    classes = data.view("p_interventions").select("nct_id", F.col("group_title").alias("arm_title"), F.when(F.col("intervention_type") == "ECONOMY", "control").otherwise("active").alias("kind")).distinct()
    links = data.view("p_arms").select("nct_id", F.col("title").alias("arm_title"), results.folded_type(F.col("group_type")).alias("arm_type"))
    return results.arm_role(links, classes).select("nct_id", F.col("arm_title").alias("title"), "arm_role", "role_source", "role_conflict")


PREFIXES = [("C04", "oncology"), ("C04.2", "lung"), ("C08", "respiratory"), ("C08.1.3", "asthma")]
TREES = {"q_trees": "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'C04.' WHEN p_partkey % 3 = 1 THEN 'C08.' ELSE 'D02.' END || CAST(p_size % 4 AS VARCHAR(9)) || '.' || CAST(p_partkey % 5 AS VARCHAR(9)) AS tree_number FROM part"}


@query("SELECT tree_number, arg_max(ta_id, length(prefix)) AS ta_id, arg_max(prefix, length(prefix)) AS prefix FROM q_trees JOIN q_prefixes ON tree_number = prefix OR starts_with(tree_number, prefix || '.') GROUP BY tree_number", TREES | {"q_prefixes": _values(PREFIXES, "prefix, ta_id")})
def match_longest_prefix(data: Data) -> DataFrame:
    from .projections import with_views

    return axes.match_longest_prefix(data.sql(with_views("SELECT * FROM q_trees", TREES)), data.spark.createDataFrame(PREFIXES, "prefix string, ta_id string"))


@query(
    "SELECT nct_id, class_id, row_number() OVER (PARTITION BY nct_id ORDER BY precedence NULLS LAST, n DESC, class_id) = 1 AS is_primary FROM (SELECT nct_id, lower(intervention_type) AS class_id, count(DISTINCT name) AS n FROM p_interventions GROUP BY 1, 2) x LEFT JOIN q_p USING (class_id)",
    {"q_p": _values([("promo", 1), ("economy", 2)], "class_id, precedence")},
)
def pick_primary(data: Data) -> DataFrame:
    hits = data.view("p_interventions").select("nct_id", F.lower("intervention_type").alias("class_id"), F.lit("type").alias("layer"), F.lit(1).alias("layer_rank"), F.col("name").alias("matched_on"))
    rows = axes.strongest_layer(hits)
    return axes.pick_primary(rows, data.spark.createDataFrame([("promo", 1), ("economy", 2)], "class_id string, precedence int")).select("nct_id", "class_id", "is_primary")


@query(
    "SELECT s.nct_id FROM p_studies s WHERE phase IN ('PHASE1', 'PHASE3') AND start_date >= DATE '1996-01-01' AND lower(organization) LIKE '%00%' AND nct_id IN (SELECT nct_id FROM p_study_ta WHERE ta_id IN ('building', 'furniture')) AND nct_id IN (SELECT nct_id FROM p_study_class WHERE class_id IN ('promo'))"
)
def scope_filter(data: Data) -> DataFrame:
    chosen = scope.Scope(areas=scope.split_ids("building, furniture"), classes=["promo"], organization="00", phases=["PHASE1", "PHASE3"], since="1996-01-01")
    return scope.in_scope(data.view("p_studies"), chosen, data.view("p_study_ta"), data.view("p_study_class")).select("nct_id")


@query("SELECT nct_id, CAST(start_date AS VARCHAR) AS start_date FROM p_studies WHERE phase = 'PHASE2' ORDER BY p_studies.start_date DESC NULLS LAST, nct_id LIMIT 25")
def pull_selection(data: Data) -> DataFrame:
    return scope.newest(data.view("p_studies").where("phase = 'PHASE2'"), 25).select("nct_id", F.col("start_date").cast("string").alias("start_date"))
