"""Audits of vocabulary tables that are derived from the test tables, flaws included: parts are measurements and classes, suppliers scales, nations events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits as a
from .projections import VIEWS, Data
from .registry import query

_ID = "replace(lower({0}), ' ', '_')"
V = {
    "v_terms": f"""SELECT 'measurement' AS dimension, CASE WHEN p_size = 1 THEN p_name ELSE {_ID.format('p_name')} || '_' || CAST(p_partkey AS VARCHAR(12)) END AS term_id, CASE WHEN p_size > 2 THEN p_name WHEN p_size = 2 THEN ' ' END AS label, p_size AS size FROM part
      UNION ALL SELECT 'event', {_ID.format('n_name')}, n_name, n_regionkey FROM nation UNION ALL SELECT 'named_endpoint', lower(c_mktsegment), max(c_name), 9 FROM customer GROUP BY c_mktsegment""",
    "v_synonyms": """SELECT 'measurement' AS dimension, lower(p_name) || CAST(p_size AS VARCHAR(12)) AS term_id, CASE WHEN p_size = 3 THEN ' ' WHEN p_size % 4 = 0 THEN upper(p_name) ELSE p_brand || p_type END AS synonym FROM part
      UNION ALL SELECT 'event', lower(n_name), n_name FROM nation UNION ALL SELECT 'event', p_brand, upper(p_brand || p_type) FROM part WHERE p_size < 5 UNION ALL SELECT 'form', p_type, p_name FROM part""",
    "v_precedence": "SELECT dimension, term_id, size AS rank FROM v_terms WHERE dimension = 'measurement' AND size < 30 UNION ALL SELECT dimension, term_id, size FROM v_terms WHERE dimension = 'measurement' AND size = 4 UNION ALL SELECT 'measurement', lower(s_name), 1 FROM supplier WHERE s_suppkey % 5 = 0",
    "v_measurements": "SELECT CAST(p_partkey AS VARCHAR(12)) AS id, CASE WHEN p_size < 6 THEN 'better' WHEN p_size % 2 = 0 THEN 'increase_is_better' END AS default_direction, CASE p_size % 3 WHEN 0 THEN 'harm' WHEN 1 THEN 'benefit' END AS event_polarity, lower(p_type) AS domain, p_brand AS concept_id FROM part",
    "v_concepts": "SELECT DISTINCT p_brand AS id FROM part WHERE p_size > 20 AND p_brand > 'Brand#2' UNION ALL SELECT s_name FROM supplier",
    "v_scales": """SELECT 'u' || CAST(s_suppkey AS VARCHAR(12)) AS id, CASE WHEN s_suppkey % 7 > 0 THEN 'u' || CAST(s_suppkey - s_suppkey % 7 AS VARCHAR(12)) WHEN s_nationkey % 2 = 0 THEN 'u' || CAST(s_suppkey AS VARCHAR(12)) END AS si_equivalent,
      CASE WHEN s_suppkey % 7 = 0 AND s_nationkey < 20 THEN CAST(1 AS DOUBLE) ELSE CAST(s_nationkey AS DOUBLE) / 10 END AS factor_to_si FROM supplier""",
    "v_classes": """SELECT 'k' || CAST(p_partkey AS VARCHAR(12)) AS id, CASE WHEN p_partkey % 100 BETWEEN 40 AND 58 OR p_partkey % 100 BETWEEN 60 AND 88 THEN 'k' || CAST(p_partkey + 1 AS VARCHAR(12)) WHEN p_partkey % 100 = 59 THEN 'k' || CAST(p_partkey - 19 AS VARCHAR(12))
        WHEN p_partkey % 100 = 95 THEN 'k' || CAST(p_partkey + 1000000 AS VARCHAR(12)) WHEN p_partkey > 10 THEN 'k' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS VARCHAR(12)) END AS parent_id,
      CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'control' ELSE 'pharmacologic' END AS kind, CASE WHEN p_size > 2 THEN CAST(100000 - p_partkey AS INT) END AS precedence FROM part""",
    "v_rules": "SELECT CASE p_size % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'branch' ELSE 'agent' END AS layer, p_name AS key, 'k' || CAST(p_partkey + p_size - 10 AS VARCHAR(12)) AS class_id FROM part",
    "v_cascade": """SELECT p_type AS dimension, CAST(p_size AS INT) AS ordinal, CASE WHEN p_size % 3 = 0 THEN 'measure' WHEN p_size % 3 = 1 THEN 'title' END AS field, CASE WHEN p_size % 3 < 2 THEN CASE WHEN p_brand LIKE '%1' THEN 'guess' ELSE 'exact' END END AS match_method,
      CASE WHEN p_size % 3 = 2 AND p_partkey % 40 = 1 THEN 'not_stated' WHEN p_size % 3 = 2 AND p_size > 48 AND p_type = 'PROMO' THEN 'none' END AS fallback FROM part WHERE p_size % 3 < 2 OR p_partkey % 40 = 1 OR p_size > 48 AND p_type = 'PROMO'""",
    "v_confidence": "SELECT CASE WHEN o_orderstatus = 'F' THEN 'exact' WHEN o_orderstatus = 'O' THEN 'syntactic_rule' ELSE 'semantic' END AS match_method, round(min(o_totalprice) / 1000000, 6) AS confidence FROM orders GROUP BY 1",
    "v_events": "SELECT CAST(n_nationkey AS VARCHAR(12)) AS id FROM nation UNION ALL SELECT r_name FROM region", "v_parts": "SELECT r_name AS event_id, CAST(n_nationkey + 3 AS VARCHAR(12)) AS part_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 2",
    "v_event_words": "SELECT 'event' AS dimension, CAST(s_nationkey AS VARCHAR(12)) AS term_id, s_name AS synonym FROM supplier WHERE s_nationkey < 20 UNION ALL SELECT 'event', r_name, r_name FROM region WHERE r_regionkey = 1",
    "v_named": "SELECT 'e' || CAST(c_custkey AS VARCHAR(12)) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'time_to_event' ELSE lower(c_mktsegment) END AS form_id, CAST(c_nationkey + 1 AS VARCHAR(12)) AS event_id, CASE WHEN c_custkey % 2 = 0 THEN 'from_start' END AS reference_id, CAST(c_custkey % 2500 AS VARCHAR(12)) AS measurement_id, CASE WHEN c_acctbal > 0 THEN 'a source' END AS citation FROM customer",
    "v_forms": "SELECT 'time_to_event' AS id UNION ALL SELECT DISTINCT lower(c_mktsegment) FROM customer WHERE c_mktsegment <> 'MACHINERY'",
    "v_templates": "SELECT CASE WHEN p_size < 25 THEN 'time_to_event' WHEN p_size < 40 THEN 'building' ELSE lower(p_type) END AS form_id, CAST(p_partkey AS INT) % 500 AS ordinal, ' ' AS literal, CASE p_size % 4 WHEN 0 THEN 'measure' WHEN 1 THEN 'threshold?' WHEN 2 THEN p_brand END AS field FROM part",
}
VIEWS.update({f"d_{n}": q.replace("v_terms", "d_v_terms") for n, q in V.items()})


def t(data: Data, name: str) -> DataFrame:
    return data.view(f"d_v_{name}")


def _union(*parts: tuple[str, str, str]) -> str:
    """(rule, key, from) as one union of distinct rows."""
    return " UNION ".join(f"SELECT DISTINCT '{rule}' AS rule, CAST({key} AS VARCHAR) AS key FROM {source}" for rule, key, source in parts)


@query(_union(("id_format", "dimension || '/' || term_id", "d_v_terms WHERE NOT regexp_full_match(term_id, '[a-z][a-z0-9_]*')"), ("id_repeated", "dimension || '/' || term_id", "(SELECT dimension, term_id FROM d_v_terms GROUP BY 1, 2 HAVING count(*) > 1) x"), ("label_missing", "dimension || '/' || term_id", "d_v_terms WHERE trim(coalesce(label, '')) = ''")))
def audit_ids(data: Data) -> DataFrame:
    return a.ids(t(data, "terms"))


@query(_union(("two_owners", "dimension || '/' || s", "(SELECT dimension, lower(synonym) AS s FROM d_v_synonyms GROUP BY 1, 2 HAVING min(term_id) <> max(term_id)) x"), ("blank_synonym", "dimension || '/' || term_id", "d_v_synonyms WHERE trim(synonym) = ''")))
def audit_synonym_owner(data: Data) -> DataFrame:
    return a.synonym_owners(t(data, "synonyms"))


@query(_union(("in_several_dimensions", "s", "(SELECT lower(x.synonym) AS s FROM d_v_synonyms x JOIN d_v_synonyms y ON lower(x.synonym) = lower(y.synonym) AND x.dimension = 'event' AND y.dimension = 'measurement') z")))
def audit_cross_dimension_synonyms(data: Data) -> DataFrame:
    return a.shared_synonyms(t(data, "synonyms"), ["event", "measurement", "named_endpoint"])


@query(_union(("event", "event_id", "d_v_named WHERE event_id NOT IN (SELECT id FROM d_v_events)"), ("measurement", "measurement_id", "d_v_named WHERE measurement_id NOT IN (SELECT id FROM d_v_measurements)"), ("concept", "concept_id", "d_v_measurements WHERE concept_id NOT IN (SELECT id FROM d_v_concepts)")))
def audit_foreign_keys(data: Data) -> DataFrame:
    named, measurements = t(data, "named"), t(data, "measurements")
    return a.foreign_keys([("event", named, "event_id", t(data, "events"), "id"), ("measurement", named, "measurement_id", measurements, "id"), ("concept", measurements, "concept_id", t(data, "concepts"), "id")])


@query(_union(("not_listed", "dimension || '/' || term_id", "(SELECT dimension, term_id FROM d_v_terms WHERE dimension IN (SELECT dimension FROM d_v_precedence) EXCEPT SELECT dimension, term_id FROM d_v_precedence) x"), ("unknown", "dimension || '/' || term_id", "(SELECT dimension, term_id FROM d_v_precedence EXCEPT SELECT dimension, term_id FROM d_v_terms) x"),
    ("listed_twice", "dimension || '/' || term_id", "(SELECT p.dimension, p.term_id FROM d_v_precedence p SEMI JOIN d_v_terms USING (dimension, term_id) GROUP BY 1, 2 HAVING count(*) > 1) x")))
def audit_precedence(data: Data) -> DataFrame:
    return a.precedence(t(data, "terms"), t(data, "precedence"))


@query(_union(("direction", "default_direction", "d_v_measurements WHERE default_direction = 'better'"), ("domain", "domain", "d_v_measurements WHERE domain IN ('promo', 'large')")))
def audit_closed_sets(data: Data) -> DataFrame:
    m = t(data, "measurements")
    return a.closed_sets([("direction", m, "default_direction", ["increase_is_better", "decrease_is_better"]), ("polarity", m, "event_polarity", ["harm", "benefit"]), ("domain", m, "domain", ["economy", "small", "medium", "standard"])])


@query(_union(("precedence_missing", "id", "d_v_classes WHERE precedence IS NULL"), ("precedence_repeated", "precedence", "(SELECT precedence FROM d_v_classes WHERE precedence IS NOT NULL GROUP BY 1 HAVING count(*) > 1) x"), ("precedence_repeated", "size", "(SELECT size FROM d_v_terms GROUP BY 1 HAVING count(*) > 1) x WHERE FALSE")))
def audit_unique_precedence(data: Data) -> DataFrame:
    return a.unique_precedence(t(data, "classes"))


@query("""WITH RECURSIVE up(id, node) AS (SELECT id, parent_id FROM (SELECT * FROM d_v_classes) c WHERE parent_id IS NOT NULL UNION SELECT u.id, c.parent_id FROM up u JOIN d_v_classes c ON c.id = u.node WHERE c.parent_id IS NOT NULL)
    SELECT 'cycle' AS rule, id AS key FROM up WHERE id = node UNION SELECT 'parent_unknown', parent_id FROM d_v_classes WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM d_v_classes)
    UNION SELECT 'kind_differs', c.id FROM d_v_classes c JOIN d_v_classes p ON p.id = c.parent_id AND p.kind <> c.kind UNION SELECT 'not_before_parent', c.id FROM d_v_classes c JOIN d_v_classes p ON p.id = c.parent_id AND c.precedence >= p.precedence""")
def audit_hierarchy(data: Data) -> DataFrame:
    return a.hierarchy(t(data, "classes"))


# A walk ends where a class has no parent, or before it would come again to the first class on a ring that it met; a class on a ring comes to itself once.
@query("""WITH RECURSIVE reach(id, node) AS (SELECT id, parent_id FROM (SELECT * FROM d_v_classes) c WHERE parent_id IS NOT NULL UNION SELECT u.id, c.parent_id FROM reach u JOIN d_v_classes c ON c.id = u.node WHERE c.parent_id IS NOT NULL),
    ring AS MATERIALIZED (SELECT id FROM reach WHERE id = node), steps AS MATERIALIZED (SELECT c.id, c.parent_id, r.id AS id_ring, p.id AS parent_ring FROM (SELECT * FROM d_v_classes) c LEFT JOIN ring r ON r.id = c.id LEFT JOIN ring p ON p.id = c.parent_id WHERE c.parent_id IS NOT NULL),
    up(child, ancestor, depth, met) AS (SELECT id, parent_id, 1, coalesce(id_ring, parent_ring) FROM steps UNION ALL SELECT u.child, c.parent_id, u.depth + 1, coalesce(u.met, c.parent_ring) FROM up u JOIN steps c ON c.id = u.ancestor
      WHERE u.ancestor <> u.child AND (u.met IS NULL OR c.parent_id <> u.met OR u.met = u.child))
    SELECT child, ancestor, CAST(min(depth) AS INT) AS depth FROM up GROUP BY child, ancestor""")
def class_rollup(data: Data) -> DataFrame:
    """Every class with its ancestors, however far: rings of 20, chains of 30 and a tree with three children each."""
    return a.ancestors(t(data, "classes").select(F.col("id").alias("child"), F.col("parent_id").alias("parent")))


@query(_union(("canonical_unknown", "si_equivalent", "d_v_scales WHERE si_equivalent NOT IN (SELECT id FROM d_v_scales)"), ("canonical_not_anchored", "id", "d_v_scales WHERE id IN (SELECT si_equivalent FROM d_v_scales WHERE si_equivalent IS NOT NULL) AND (si_equivalent IS NULL OR si_equivalent <> id OR factor_to_si IS NULL OR factor_to_si <> 1)"), ("factor_without_unit", "id", "d_v_scales WHERE factor_to_si IS NOT NULL AND si_equivalent IS NULL")))
def audit_units(data: Data) -> DataFrame:
    return a.units(t(data, "scales"))


@query(_union(("undeclared", "concept_id", "(SELECT concept_id FROM d_v_measurements EXCEPT SELECT id FROM d_v_concepts) x"), ("unused", "id", "(SELECT id FROM d_v_concepts EXCEPT SELECT concept_id FROM d_v_measurements) x")))
def audit_concepts(data: Data) -> DataFrame:
    return a.concepts(t(data, "concepts"), t(data, "measurements"))


@query(_union(("target_unknown", "layer || '/' || key || '/' || class_id", "d_v_rules WHERE class_id NOT IN (SELECT id FROM d_v_classes)"), ("kind_mismatch", "layer || '/' || key || '/' || class_id", "d_v_rules r JOIN d_v_classes c ON c.id = r.class_id WHERE (r.layer = 'control') <> (c.kind = 'control') AND r.layer <> 'agent'")))
def audit_mapping_targets(data: Data) -> DataFrame:
    return a.mapping_targets(t(data, "rules"), t(data, "classes"))


@query(_union(("field_unknown", "dimension || '/' || field", "d_v_cascade WHERE fallback IS NULL AND field = 'title'"), ("method_unknown", "match_method", "d_v_cascade WHERE fallback IS NULL AND match_method NOT IN (SELECT match_method FROM d_v_confidence)"), ("not_one_fallback", "dimension", "(SELECT dimension FROM d_v_cascade GROUP BY 1 HAVING count(fallback) <> 1) x"),
    ("fallback_not_last", "dimension", "(SELECT dimension FROM d_v_cascade GROUP BY 1 HAVING count(fallback) = 1 AND max(ordinal) FILTER (WHERE fallback IS NOT NULL) < max(ordinal)) x"), ("exact_not_above_syntactic", "'confidence'", "(SELECT 1 AS one FROM d_v_confidence e JOIN d_v_confidence s ON e.match_method = 'exact' AND s.match_method = 'syntactic_rule' AND e.confidence <= s.confidence) x")))
def audit_cascade(data: Data) -> DataFrame:
    return a.cascades(t(data, "cascade"), t(data, "confidence"), ["measure", "description", "time_frame"])


@query(_union(("form_unknown", "form_id", "d_v_named WHERE form_id NOT IN (SELECT id FROM d_v_forms)"), ("event_unknown", "event_id", "d_v_named WHERE event_id NOT IN (SELECT id FROM d_v_events)"), ("measurement_unknown", "measurement_id", "d_v_named WHERE measurement_id NOT IN (SELECT id FROM d_v_measurements)"), ("citation_missing", "id", "d_v_named WHERE form_id = 'time_to_event' AND reference_id IS NOT NULL AND citation IS NULL")))
def audit_named_endpoints(data: Data) -> DataFrame:
    return a.named_endpoints(t(data, "named"), t(data, "forms"), t(data, "events"), t(data, "measurements"))


@query(_union(("template_missing", "id", "d_v_forms WHERE id NOT IN (SELECT form_id FROM d_v_templates)"), ("form_unknown", "form_id", "d_v_templates WHERE form_id NOT IN (SELECT id FROM d_v_forms)"), ("field_unknown", "form_id || '/' || field", "d_v_templates WHERE field LIKE 'Brand%'"), ("part_repeated", "form_id || '/' || CAST(ordinal AS VARCHAR)", "(SELECT form_id, ordinal FROM d_v_templates GROUP BY 1, 2 HAVING count(*) > 1) x")))
def audit_templates(data: Data) -> DataFrame:
    return a.templates(t(data, "templates"), t(data, "forms"), ["measure", "threshold", "timepoint"])


@query(_union(("words_and_components", "id", "d_v_events WHERE id IN (SELECT term_id FROM d_v_event_words) AND id IN (SELECT event_id FROM d_v_parts)"), ("neither", "id", "d_v_events WHERE id NOT IN (SELECT term_id FROM d_v_event_words) AND id NOT IN (SELECT event_id FROM d_v_parts)"), ("component_unknown", "part_id", "d_v_parts WHERE part_id NOT IN (SELECT id FROM d_v_events)")))
def audit_event_components(data: Data) -> DataFrame:
    words = t(data, "event_words")
    return a.event_components(t(data, "events"), t(data, "parts"), words, words.limit(0).select("dimension", "term_id"))


@query("SELECT DISTINCT 'synonym_repeated' AS rule, dimension || '/' || s AS key FROM (SELECT dimension, lower(synonym) AS s, count(*) OVER (PARTITION BY dimension, lower(synonym)) AS n FROM d_v_synonyms) x WHERE n > 1")
def audit_unique(data: Data) -> DataFrame:
    """Synonyms that a dimension lists more than once, of whatever term."""
    found = a.repeated(t(data, "synonyms").withColumn("s", F.lower("synonym")), "dimension", "s")
    return a.broken(found, "synonym_repeated", "dimension", "s")
