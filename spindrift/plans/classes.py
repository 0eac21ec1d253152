"""Drug classes and therapeutic areas by layers: parts are interventions and descriptors, their types ancestors, their brands other names and branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import axes
from ..sources.vocabulary import local
from .matching import _values
from .projections import ONCE, VIEWS, Data
from .registry import query

CLASS_RULES = [
    ("control_rule", r"\bnut\b", "placebo", 1), ("term_override", "cold widget", "large_molecule", 0), ("term_override", "cold widget", "antibody", 0), ("agent_name", "small widget", "antibody", 0), ("agent_name", "large bolt", "statin", 0),
    ("agent_name", "large bolt", "enzyme", 0), ("agent_name", "brand#11", "statin", 0), ("name_pattern", "widget", "antibody", 1), ("name_pattern", "(bolt|gear)", "device", 2), ("name_pattern", "cold", "large_molecule", 3), ("name_pattern", "brand#2", "kinase", 4),
    ("modality_rule", "promo", "small_molecule", 0), ("modality_rule", "economy", "device", 0), ("ancestor_rule", "standard", "kinase", 0), ("ancestor_rule", "large", "statin", 0), ("branch_rule", "Brand#3", "kinase", 1), ("branch_rule", "Brand#31", "statin", 2),
]
CLASSES = [
    ("large_molecule", "modality", None, 7), ("antibody", "mechanism", None, 2), ("statin", "mechanism", None, 3), ("enzyme", "mechanism", None, 3), ("device", "modality", None, 6), ("placebo", "control", None, 9), ("kinase", "mechanism", None, 1), ("small_molecule", "modality", None, 8),
]
AREA_RULES = [
    ("intervention_rule", "gizmo|rod", "metabolic", 1), ("term_override", "hot ring", "respiratory", 0), ("tree_prefix", "C04", "oncology", 0), ("tree_prefix", "C04.2", "lung", 0), ("tree_prefix", "C08", "respiratory", 0),
    ("term_pattern", "widget", "cardiology", 1), ("term_pattern", "(blue|red)", "neurology", 2),
]
AREAS = [("oncology", None, 1), ("lung", None, 2), ("respiratory", None, 2), ("cardiology", None, 3), ("metabolic", None, 5)]
_NCT = "'NCT' || lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0')"
_FROM = "FROM lineitem JOIN part ON l_partkey = p_partkey"
VIEWS |= {
    "d_x_interventions": f"SELECT DISTINCT {_NCT} AS nct_id, CAST(l_partkey AS INT) AS ordinal, p_name AS name, p_type AS intervention_type {_FROM} WHERE l_quantity > 3",
    "d_x_other": f"SELECT DISTINCT {_NCT} AS nct_id, CAST(l_partkey AS INT) AS ordinal, p_brand AS other_name {_FROM} WHERE l_quantity > 3 AND l_partkey % 2 = 0",
    "d_x_mesh": f"SELECT DISTINCT {_NCT} AS nct_id, p_name AS mesh_term {_FROM} WHERE l_linenumber = 1 AND p_size > 25",
    "d_x_ancestors": f"SELECT DISTINCT {_NCT} AS nct_id, p_type AS mesh_term {_FROM} WHERE l_linenumber = 2 AND p_size > 30",
    "d_x_branches": f"SELECT DISTINCT {_NCT} AS nct_id, p_brand AS branch_name, 'BC0' || CAST(p_size % 9 AS VARCHAR(9)) AS branch_abbrev {_FROM} WHERE l_linenumber = 3",
    "d_x_conditions": f"SELECT DISTINCT {_NCT} AS nct_id, p_name AS mesh_term, CASE p_size % 5 WHEN 0 THEN 'C04.1' WHEN 1 THEN 'C04.2.7' WHEN 2 THEN 'C08' WHEN 3 THEN 'C040.1' END AS tree_number {_FROM} WHERE l_linenumber = 1 AND l_quantity > 8",
    "d_x_arms": f"SELECT DISTINCT {_NCT} AS nct_id, 'Arm ' || l_returnflag AS group_title, CAST(l_partkey AS INT) AS intervention_ordinal, 'join_table' AS link_method FROM lineitem WHERE l_quantity > 3",
    "d_x_studies": "SELECT 'NCT' || lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0') AS nct_id FROM orders",
}


def x(data: Data, name: str) -> DataFrame:
    return data.view(f"d_x_{name}")


def rules(data: Data) -> DataFrame:
    return local(data.spark, CLASS_RULES, "layer string, key string, class_id string, ordinal int")


def classes(data: Data) -> DataFrame:
    return local(data.spark, CLASSES, "id string, kind string, parent_id string, precedence int")


def area_rules(data: Data) -> DataFrame:
    return local(data.spark, AREA_RULES, "layer string, key string, ta_id string, ordinal int")


def study_areas(data: Data) -> DataFrame:
    areas = local(data.spark, AREAS, "id string, parent_id string, precedence int")
    return data.kept("study-areas", lambda: axes.resolve_areas(x(data, "studies"), x(data, "conditions"), x(data, "mesh"), x(data, "branches"), area_rules(data), areas))


def kinds(data: Data) -> DataFrame:
    return classes(data).select(F.col("id").alias("class_id"), "kind")


def by_intervention(data: Data) -> DataFrame:
    return data.kept("intervention-classes", lambda: axes.match_interventions(x(data, "interventions"), x(data, "other"), rules(data), kinds(data)))


def by_ancestor(data: Data) -> DataFrame:
    return axes.match_ancestors(x(data, "ancestors"), rules(data), kinds(data))


def study_classes(data: Data) -> DataFrame:
    def build() -> DataFrame:
        others = [axes.match_terms(x(data, "mesh"), rules(data), kinds(data)), by_ancestor(data), axes.match_branches(x(data, "branches"), rules(data), kinds(data))]
        return axes.resolve_drug_classes(x(data, "studies"), by_intervention(data), others, x(data, "interventions"), classes(data))

    return data.kept("study-classes", build)


_RANK = " ".join(f"WHEN '{name}' THEN {n}" for n, name in enumerate(axes.CLASS_LAYERS))
_AREA_RANK = " ".join(f"WHEN '{name}' THEN {n}" for n, name in enumerate(axes.AREA_LAYERS))
ORACLE = {
    "x_rules": _values(CLASS_RULES, "layer, key, class_id, ordinal"), "x_classes": _values(CLASSES, "id, kind, parent_id, precedence"),
    "x_cand": "SELECT nct_id, ordinal, lower(name) AS text, 0 AS cand, intervention_type FROM d_x_interventions UNION ALL SELECT nct_id, ordinal, lower(other_name), 1, NULL FROM d_x_other",
    "x_text": "SELECT DISTINCT text FROM (SELECT text FROM x_cand UNION ALL SELECT lower(mesh_term) FROM d_x_mesh) t",
    "x_regex": "SELECT text, layer, class_id, ordinal FROM x_text, x_rules WHERE layer IN ('control_rule', 'name_pattern') AND regexp_matches(text, key, 'i')",
    "x_exact": "SELECT text, layer, class_id, 0 AS ordinal FROM x_text JOIN x_rules ON text = key AND layer IN ('term_override', 'agent_name')",
    "x_hits": f"""{ONCE} SELECT c.nct_id, c.ordinal AS item, c.text, cand, h.layer, h.class_id, h.ordinal AS rule, k.kind, CASE h.layer {_RANK} END AS lr
      FROM x_cand c JOIN (SELECT * FROM x_regex UNION ALL SELECT * FROM x_exact) h ON h.text = c.text JOIN x_classes k ON k.id = h.class_id WHERE h.layer <> 'control_rule' OR cand = 0
      UNION ALL SELECT c.nct_id, c.ordinal, c.intervention_type, 0, r.layer, r.class_id, 0, k.kind, CASE r.layer {_RANK} END FROM x_cand c JOIN x_rules r ON r.layer = 'modality_rule' AND lower(c.intervention_type) = r.key JOIN x_classes k ON k.id = r.class_id WHERE cand = 0""",
    "x_free": "SELECT h.* FROM x_hits h WHERE layer = 'control_rule' OR NOT EXISTS (SELECT 1 FROM x_hits c WHERE c.nct_id = h.nct_id AND c.item = h.item AND c.layer = 'control_rule')",
    "x_int": f"{ONCE} SELECT nct_id, item, class_id, kind, arg_min(layer, lr) AS layer, min(lr) AS lr, min(text) AS matched_on FROM (SELECT *, dense_rank() OVER (PARTITION BY nct_id, item, kind ORDER BY lr, cand, rule) AS r FROM x_free) y WHERE r = 1 GROUP BY nct_id, item, class_id, kind",
    "x_term": f"""SELECT nct_id, class_id, kind, layer, lr, text AS matched_on FROM (SELECT m.nct_id, m.text, h.layer, h.class_id, k.kind, CASE h.layer {_RANK} END AS lr, dense_rank() OVER (PARTITION BY m.nct_id, m.text, k.kind ORDER BY CASE h.layer {_RANK} END, h.ordinal) AS r
      FROM (SELECT DISTINCT nct_id, lower(mesh_term) AS text FROM d_x_mesh) m JOIN (SELECT * FROM x_regex WHERE layer = 'name_pattern' UNION ALL SELECT * FROM x_exact) h ON h.text = m.text JOIN x_classes k ON k.id = h.class_id) y WHERE r = 1""",
    "x_anc": "SELECT a.nct_id, r.class_id, k.kind, r.layer, 4 AS lr, lower(mesh_term) AS matched_on FROM d_x_ancestors a JOIN x_rules r ON r.layer = 'ancestor_rule' AND r.key = lower(mesh_term) JOIN x_classes k ON k.id = r.class_id",
    "x_branch": "SELECT b.nct_id, CASE WHEN branch_name LIKE 'Brand#3%' THEN 'kinase' END AS class_id, 'mechanism' AS kind, 'branch_rule' AS layer, 5 AS lr, branch_name AS matched_on FROM (SELECT DISTINCT nct_id, branch_name FROM d_x_branches) b WHERE branch_name LIKE 'Brand#3%'",
    "x_all": "SELECT nct_id, class_id, kind, layer, lr, matched_on, 0 AS src, item FROM x_int UNION ALL SELECT *, 1, 0 FROM x_term UNION ALL SELECT *, 2, 0 FROM x_anc UNION ALL SELECT *, 3, 0 FROM x_branch",
    "x_best": "SELECT nct_id, class_id, kind, arg_min(layer, (lr, src, item, matched_on)) AS layer, arg_min(matched_on, (lr, src, item, matched_on)) AS matched_on FROM x_all GROUP BY nct_id, class_id, kind",
    "x_rows": """SELECT * FROM x_best UNION ALL SELECT nct_id, CASE WHEN nct_id IN (SELECT nct_id FROM d_x_interventions) THEN 'unclassified_agent' ELSE 'no_interventions_stated' END, NULL, 'default', NULL FROM d_x_studies WHERE nct_id NOT IN (SELECT nct_id FROM x_best)""",
    "x_study": f"""{ONCE} SELECT r.*, row_number() OVER (PARTITION BY r.nct_id ORDER BY k.precedence NULLS LAST, coalesce(n, 0) DESC, r.class_id) = 1 AS is_primary FROM x_rows r LEFT JOIN x_classes k ON k.id = r.class_id
      LEFT JOIN (SELECT nct_id, class_id, count(DISTINCT item) AS n FROM x_int GROUP BY 1, 2) c ON c.nct_id = r.nct_id AND c.class_id = r.class_id""",
    "x_a_rules": _values(AREA_RULES, "layer, key, ta_id, ordinal"), "x_areas": _values(AREAS, "id, parent_id, precedence"),
    "x_cond": f"""SELECT c.nct_id, c.text, arg_min(h.ta_id, (lr, h.ordinal, h.ta_id)) AS ta_id, arg_min(h.layer, (lr, h.ordinal, h.ta_id)) AS layer FROM (SELECT DISTINCT nct_id, lower(mesh_term) AS text, tree_number FROM d_x_conditions) c JOIN (SELECT *, CASE layer {_AREA_RANK} END * 100 - CASE WHEN layer = 'tree_prefix' THEN length(key) ELSE 0 END AS lr FROM x_a_rules) h
      ON h.layer = 'term_override' AND h.key = c.text OR h.layer = 'tree_prefix' AND (c.tree_number = h.key OR starts_with(c.tree_number, h.key || '.')) OR h.layer = 'term_pattern' AND regexp_matches(c.text, h.key, 'i') GROUP BY c.nct_id, c.text""",
    "x_a_hits": """SELECT nct_id, text, layer, ta_id, TRUE AS backs FROM x_cond UNION ALL SELECT DISTINCT nct_id, branch_name, 'tree_prefix', CASE branch_abbrev WHEN 'BC04' THEN 'oncology' ELSE 'respiratory' END, TRUE FROM d_x_branches WHERE branch_abbrev IN ('BC04', 'BC08')
      UNION ALL SELECT nct_id, lower(mesh_term), 'intervention_rule', 'metabolic', FALSE FROM d_x_mesh WHERE regexp_matches(mesh_term, 'gizmo|rod', 'i')""",
    "x_a_best": f"SELECT nct_id, ta_id, arg_min(layer, (CASE layer {_AREA_RANK} END, text)) AS layer, arg_min(text, (CASE layer {_AREA_RANK} END, text)) AS matched_on, count(*) FILTER (WHERE backs) AS n FROM x_a_hits GROUP BY nct_id, ta_id",
    "x_area": """SELECT r.nct_id, r.ta_id, r.layer, r.matched_on, row_number() OVER (PARTITION BY r.nct_id ORDER BY a.precedence NULLS LAST, r.n DESC, r.ta_id) = 1 AS is_primary FROM (SELECT * FROM x_a_best UNION ALL
      SELECT nct_id, CASE WHEN nct_id IN (SELECT nct_id FROM d_x_conditions) THEN 'no_pattern_matched' ELSE 'no_mesh_terms' END, 'default', NULL, 0 FROM d_x_studies WHERE nct_id NOT IN (SELECT nct_id FROM x_a_best)) r LEFT JOIN x_areas a ON a.id = r.ta_id""",
}


@query("SELECT nct_id, CAST(item AS INT) AS ordinal, class_id, kind, layer, matched_on FROM x_int", ORACLE)
def classify_intervention(data: Data) -> DataFrame:
    return by_intervention(data).drop("layer_rank")


@query("SELECT nct_id, class_id, kind, layer, matched_on FROM x_term", ORACLE)
def classify_mesh_descriptors(data: Data) -> DataFrame:
    return axes.match_terms(x(data, "mesh"), rules(data), kinds(data)).drop("layer_rank")


@query("SELECT nct_id, class_id, kind, layer, matched_on FROM x_anc", ORACLE)
def classify_ancestors(data: Data) -> DataFrame:
    return by_ancestor(data).drop("layer_rank")


@query("SELECT nct_id, class_id, kind, layer, matched_on FROM x_branch", ORACLE)
def classify_branches(data: Data) -> DataFrame:
    return axes.match_branches(x(data, "branches"), rules(data), kinds(data)).drop("layer_rank")


@query("SELECT nct_id, class_id, kind, layer, matched_on, is_primary FROM x_study", ORACLE)
def resolve_drug_classes(data: Data) -> DataFrame:
    return study_classes(data)


@query("SELECT DISTINCT l.nct_id, l.group_title, i.class_id, i.kind, i.layer, i.matched_on, l.link_method FROM d_x_arms l JOIN x_int i ON i.nct_id = l.nct_id AND i.item = l.intervention_ordinal", ORACLE)
def arm_drug_classes(data: Data) -> DataFrame:
    return axes.arm_classes(by_intervention(data), x(data, "arms")).distinct()


@query("SELECT nct_id, ordinal, name FROM d_x_interventions i WHERE NOT EXISTS (SELECT 1 FROM x_int m WHERE m.nct_id = i.nct_id AND m.item = i.ordinal)", ORACLE)
def unclassified_interventions(data: Data) -> DataFrame:
    return axes.unclassified(x(data, "interventions"), by_intervention(data))


@query("SELECT name, count(*) AS n, count(DISTINCT nct_id) AS studies FROM d_x_interventions i WHERE NOT EXISTS (SELECT 1 FROM x_int m WHERE m.nct_id = i.nct_id AND m.item = i.ordinal) GROUP BY name ORDER BY n DESC, name LIMIT 10", ORACLE)
def unclassified_names(data: Data) -> DataFrame:
    """The ten most frequent names that no rule knows."""
    found = axes.unclassified(x(data, "interventions"), by_intervention(data))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nct_id").alias("studies")).orderBy(F.desc("n"), "name").limit(10)


@query("SELECT i.name, c.kind, c.class_id AS curated, a.ancestor, count(*) AS n FROM x_int c JOIN (SELECT nct_id, kind, arg_min(class_id, (matched_on, class_id)) AS ancestor FROM x_anc GROUP BY 1, 2) a ON a.nct_id = c.nct_id AND a.kind = c.kind AND a.ancestor <> c.class_id JOIN d_x_interventions i ON i.nct_id = c.nct_id AND i.ordinal = c.item WHERE c.layer IN ('term_override', 'agent_name', 'name_pattern') GROUP BY ALL", ORACLE)
def diff_curated_vs_ancestry(data: Data) -> DataFrame:
    return axes.curated_against_ancestry(x(data, "interventions"), by_intervention(data), by_ancestor(data))


@query("SELECT nct_id, ta_id, layer, matched_on, is_primary FROM x_area", ORACLE)
def resolve_therapeutic_area(data: Data) -> DataFrame:
    return study_areas(data)


def _cond(layers: str) -> str:
    """The first answer of each condition by the rules of some layers, by a nested loop."""
    return f"""SELECT c.nct_id, c.text, arg_min(h.ta_id, (lr, h.ordinal, h.ta_id)) AS ta_id FROM (SELECT DISTINCT nct_id, lower(mesh_term) AS text, tree_number FROM d_x_conditions) c JOIN (SELECT *, CASE layer {_AREA_RANK} END * 100 - CASE WHEN layer = 'tree_prefix' THEN length(key) ELSE 0 END AS lr FROM x_a_rules WHERE layer IN ({layers})) h
      ON h.layer = 'term_override' AND h.key = c.text OR h.layer = 'tree_prefix' AND (c.tree_number = h.key OR starts_with(c.tree_number, h.key || '.')) OR h.layer = 'term_pattern' AND regexp_matches(c.text, h.key, 'i') GROUP BY c.nct_id, c.text"""


@query(
    """SELECT 'condition' AS part, t.ta_id AS a, p.ta_id AS b, count(*) AS n FROM (SELECT DISTINCT nct_id, lower(mesh_term) AS text FROM d_x_conditions) c LEFT JOIN x_by_tree t USING (nct_id, text) LEFT JOIN x_by_pattern p USING (nct_id, text) WHERE t.ta_id IS DISTINCT FROM p.ta_id GROUP BY ALL
    UNION ALL SELECT 'study', b.ta_id, c.ta_id, count(*) FROM (SELECT DISTINCT nct_id, CASE branch_abbrev WHEN 'BC04' THEN 'oncology' ELSE 'respiratory' END AS ta_id FROM d_x_branches WHERE branch_abbrev IN ('BC04', 'BC08')) b
      FULL JOIN (SELECT DISTINCT nct_id, ta_id FROM x_cond) c ON b.nct_id = c.nct_id AND b.ta_id = c.ta_id WHERE b.ta_id IS DISTINCT FROM c.ta_id GROUP BY ALL""",
    ORACLE | {"x_by_tree": _cond("'tree_prefix'"), "x_by_pattern": _cond("'term_pattern'")},
)
def diff_tree_vs_pattern(data: Data) -> DataFrame:
    return axes.tree_against_pattern(x(data, "conditions"), x(data, "branches"), area_rules(data))


@query("SELECT class_id, kind, count(DISTINCT nct_id) AS studies, count(DISTINCT CASE WHEN is_primary THEN nct_id END) AS primary_studies FROM x_study GROUP BY class_id, kind", ORACLE)
def drug_class_distribution(data: Data) -> DataFrame:
    return study_classes(data).groupBy("class_id", "kind").agg(F.count_distinct("nct_id").alias("studies"), F.count_distinct(F.when(F.col("is_primary"), F.col("nct_id"))).alias("primary_studies"))


@query("SELECT ta_id, layer, count(*) AS rows_written, count(DISTINCT nct_id) AS studies, count(*) FILTER (WHERE is_primary) AS primaries FROM x_area GROUP BY ta_id, layer", ORACLE)
def axis_run_summary(data: Data) -> DataFrame:
    return study_areas(data).groupBy("ta_id", "layer").agg(F.count(F.lit(1)).alias("rows_written"), F.count_distinct("nct_id").alias("studies"), F.count_if("is_primary").alias("primaries"))


@query("SELECT (SELECT count(*) FROM d_x_studies) AS studies, (SELECT count(DISTINCT nct_id) FROM x_study WHERE layer <> 'default') AS with_class, (SELECT count(DISTINCT nct_id) FROM x_area WHERE layer <> 'default') AS with_area", ORACLE)
def axis_denominators(data: Data) -> DataFrame:
    """One row: studies, those with a class, those with an area, by one pass over the three."""
    rows = [x(data, "studies").select("nct_id", F.lit("studies").alias("of"))]
    rows += [found.where("layer <> 'default'").select("nct_id", F.lit(name)) for name, found in (("with_class", study_classes(data)), ("with_area", study_areas(data)))]
    distinct = rows[0].union(rows[1]).union(rows[2]).distinct()
    return distinct.agg(*(F.count_if(F.col("of") == n).alias(n) for n in ("studies", "with_class", "with_area")))


@query("SELECT a.class_id AS class_a, b.class_id AS class_b, count(*) AS studies FROM x_study a JOIN x_study b ON a.nct_id = b.nct_id AND b.class_id > a.class_id GROUP BY 1, 2", ORACLE)
def combination_therapy_pairs(data: Data) -> DataFrame:
    """Classes that studies combine: the pairs of a study's own few classes, out of one array for each study."""
    each = study_classes(data).groupBy("nct_id").agg(F.array_sort(F.collect_set("class_id")).alias("all"))
    first = each.select("all", F.explode("all").alias("class_a"))
    return first.select("class_a", F.explode(F.filter("all", lambda b: b > F.col("class_a"))).alias("class_b")).groupBy("class_a", "class_b").agg(F.count(F.lit(1)).alias("studies"))


@query("SELECT (SELECT count(*) FROM d_x_studies) AS studies, (SELECT count(*) FROM d_x_conditions) AS condition_rows, (SELECT count(*) FROM d_x_conditions WHERE tree_number IS NOT NULL) AS with_tree, (SELECT count(DISTINCT nct_id) FROM d_x_branches) AS studies_with_branches")
def signal_availability(data: Data) -> DataFrame:
    return axes.signal_availability(x(data, "studies"), x(data, "conditions"), x(data, "branches"))


@query(
    """SELECT 'studies' AS measure, count(*) AS n FROM d_x_studies UNION ALL SELECT 'studies_with_interventions', count(DISTINCT nct_id) FROM d_x_interventions UNION ALL SELECT 'classified_studies', count(DISTINCT nct_id) FROM x_study WHERE layer <> 'default'
    UNION ALL SELECT 'mechanism_studies', count(DISTINCT nct_id) FROM x_study WHERE kind = 'mechanism' UNION ALL SELECT 'control_studies', count(DISTINCT nct_id) FROM x_study WHERE kind = 'control' UNION ALL SELECT 'ancestor_studies', count(DISTINCT nct_id) FROM d_x_ancestors
    UNION ALL SELECT 'branch_studies', count(DISTINCT nct_id) FROM d_x_branches UNION ALL SELECT 'arm_rows', count(*) FROM (SELECT DISTINCT l.nct_id, l.group_title, i.class_id, i.kind, i.layer, i.matched_on FROM d_x_arms l JOIN x_int i ON i.nct_id = l.nct_id AND i.item = l.intervention_ordinal) a
    UNION ALL SELECT 'review_queue', count(*) FROM d_x_interventions i WHERE NOT EXISTS (SELECT 1 FROM x_int m WHERE m.nct_id = i.nct_id AND m.item = i.ordinal)""",
    ORACLE,
)
def drug_class_coverage(data: Data) -> DataFrame:
    """The axis' denominators, one in a row."""
    study = study_classes(data)
    each = {
        "studies": x(data, "studies").select("nct_id"), "studies_with_interventions": x(data, "interventions").select("nct_id").distinct(), "classified_studies": study.where("layer <> 'default'").select("nct_id").distinct(),
        "mechanism_studies": study.where("kind = 'mechanism'").select("nct_id").distinct(), "control_studies": study.where("kind = 'control'").select("nct_id").distinct(), "ancestor_studies": x(data, "ancestors").select("nct_id").distinct(),
        "branch_studies": x(data, "branches").select("nct_id").distinct(), "arm_rows": axes.arm_classes(by_intervention(data), x(data, "arms")).distinct(), "review_queue": axes.unclassified(x(data, "interventions"), by_intervention(data)),
    }
    out = None
    for name, rows in each.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT link_method, kind, layer, count(*) AS n, count(DISTINCT nct_id || group_title) AS arms FROM (SELECT DISTINCT l.nct_id, l.group_title, i.class_id, i.kind, i.layer, i.matched_on, l.link_method FROM d_x_arms l JOIN x_int i ON i.nct_id = l.nct_id AND i.item = l.intervention_ordinal) a GROUP BY ALL", ORACLE)
def arm_tier_trust(data: Data) -> DataFrame:
    """How far arms' classes can be trusted: rows and arms by link method, kind and layer."""
    rows = axes.arm_classes(by_intervention(data), x(data, "arms")).distinct()
    return rows.groupBy("link_method", "kind", "layer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.concat("nct_id", "group_title")).alias("arms"))
