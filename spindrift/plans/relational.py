"""Landing from a relational mirror, whose tables are made from the test tables: orders are studies, their lines outcomes and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.results import gather_rows
from ..sources import registry_relational as r
from .projections import VIEWS, Data
from .registry import query

_NCT = "'NCT' || lpad(CAST({0} AS VARCHAR(20)), 8, '0')"
_N = _NCT.format("o_orderkey")
_L = _NCT.format("l_orderkey")
MIRROR = {
    "m_studies": f"SELECT {_N} AS nct_id, CAST(o_orderdate AS DATE) AS start_date, o_orderstatus AS overall_status FROM orders",
    "m_designs": f"SELECT {_N} AS nct_id, CASE o_orderstatus WHEN 'F' THEN 'RANDOMIZED' ELSE 'NA' END AS allocation, o_orderpriority AS masking FROM orders WHERE o_orderkey % 3 > 0",
    "m_eligibilities": f"SELECT {_N} AS nct_id, 'All' AS gender, CAST(o_custkey % 80 AS VARCHAR(9)) || ' Years' AS minimum_age FROM orders WHERE o_orderkey % 4 > 0",
    "m_sponsors": f"SELECT {_N} AS nct_id, c_name AS name, 'lead' AS lead_or_collaborator FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 UNION ALL SELECT {_N}, n_name, CASE WHEN c_nationkey % 2 = 0 THEN 'lead' ELSE 'collaborator' END FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "m_outcomes": f"SELECT CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey * 10 + l_linenumber AS id, {_L} AS nct_id, CASE WHEN l_linenumber = 1 THEN 'Primary' ELSE 'Secondary' END AS outcome_type, p_type AS title, p_brand AS units, CASE WHEN l_linenumber > 3 THEN 'Week 4' END AS time_frame FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) x JOIN part ON l_partkey = p_partkey",
    "m_groups": "SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS title FROM supplier WHERE s_suppkey % 7 > 0",
    "m_counts": "SELECT CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey * 10 + l_linenumber AS outcome_id, CAST(l_suppkey % 5 AS BIGINT) + 1 AS result_group_id, CASE WHEN l_returnflag = 'R' THEN 'Measure' ELSE 'Analysis' END AS scope, CASE WHEN l_linestatus = 'O' THEN 'Participants' ELSE 'eyes' END AS units, CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS count, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS id FROM lineitem WHERE l_suppkey % 3 > 0",
    "m_measurements": "SELECT CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey * 10 + l_linenumber AS outcome_id, CAST(l_suppkey % 5 AS BIGINT) + 1 AS result_group_id, CASE WHEN l_partkey % 9 = 0 THEN 'NA' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END AS param_value, CASE WHEN l_partkey % 4 = 0 THEN '1.5' END AS dispersion_value FROM lineitem",
    "m_analyses": "SELECT CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey * 10 + l_linenumber AS outcome_id, CAST(l_orderkey AS BIGINT) * 100000 + l_suppkey * 10 + l_linenumber AS id, 'Mean Difference' AS param_type, CASE l_linenumber % 4 WHEN 0 THEN '<' WHEN 1 THEN '=' WHEN 2 THEN '' END AS p_value_modifier, CASE WHEN l_linenumber % 5 > 0 THEN '0.0' || CAST(l_linenumber AS VARCHAR(9)) END AS p_value, CASE l_returnflag WHEN 'A' THEN 'Non-Inferiority or Equivalence' WHEN 'N' THEN 'Superiority' END AS non_inferiority_type FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_returnflag FROM lineitem WHERE l_partkey % 2 = 0) x",
    "m_analysis_groups": "SELECT DISTINCT CAST(l_orderkey AS BIGINT) * 100000 + l_suppkey * 10 + l_linenumber AS outcome_analysis_id, 'OG00' || CAST(l_partkey % 3 AS VARCHAR(9)) AS ctgov_group_code FROM lineitem WHERE l_partkey % 4 = 0",
    "m_baseline": f"SELECT {_L} AS nct_id, 'characteristic ' || CAST(l_linenumber AS VARCHAR(9)) AS title, CASE WHEN l_linestatus = 'O' THEN 'years' END AS units, CAST(l_suppkey AS BIGINT) AS result_group_id, 'BG00' || l_returnflag AS ctgov_group_code, CAST(l_quantity AS VARCHAR(20)) AS param_value, l_linenumber AS number_analyzed FROM lineitem",
    "m_interventions": f"SELECT CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey AS id, {_L} AS nct_id, p_type AS intervention_type, ' ' || upper(p_name) || ' ' AS name FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) x JOIN part ON l_partkey = p_partkey",
    "m_other_names": "SELECT CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey AS intervention_id, CASE WHEN l_partkey % 6 > 0 THEN p_brand END AS name FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber < 3) x JOIN part ON l_partkey = p_partkey",
    "m_arm_links": "SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber % 3 AS design_group_id, CAST(l_orderkey AS BIGINT) * 1000000 + l_partkey AS intervention_id FROM lineitem",
    "m_arms": "SELECT DISTINCT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber % 3 AS id, CASE WHEN l_orderkey % 8 > 0 THEN 'Arm ' || CAST(l_linenumber % 3 AS VARCHAR(9)) END AS title FROM lineitem",
    "m_mesh": "SELECT p_name AS term, CASE WHEN p_size > 5 THEN p_brand END AS tree_number FROM part",
}
VIEWS.update({f"d_{n}": q for n, q in MIRROR.items()})

_KEYS = """SELECT id AS source_id, nct_id, outcome_type, title, time_frame, units, dup, ord, md5(nct_id || '|' || lower(outcome_type) || '|' || title || '|' || coalesce(time_frame, '') || '|' || CAST(dup AS VARCHAR)) AS outcome_id
  FROM (SELECT *, row_number() OVER (PARTITION BY nct_id, lower(outcome_type), title, time_frame ORDER BY id) - 1 AS dup, row_number() OVER (PARTITION BY nct_id ORDER BY id) - 1 AS ord FROM d_m_outcomes) x"""
K = {"q_keys": _KEYS}


def m(data: Data, name: str) -> DataFrame:
    return data.view(f"d_m_{name}")


def keys(data: Data) -> DataFrame:
    return r.outcome_keys(m(data, "outcomes"))


@query("SELECT s.nct_id, (SELECT min(allocation) FROM d_m_designs d WHERE d.nct_id = s.nct_id) AS allocation, (SELECT min(minimum_age) FROM d_m_eligibilities e WHERE e.nct_id = s.nct_id) AS minimum_age, l.organization FROM d_m_studies s LEFT JOIN (SELECT nct_id, min(name) AS organization FROM d_m_sponsors WHERE lead_or_collaborator = 'lead' GROUP BY nct_id) l ON l.nct_id = s.nct_id")
def assemble_studies_relational(data: Data) -> DataFrame:
    return r.assemble_studies(m(data, "studies"), m(data, "designs"), m(data, "eligibilities"), m(data, "sponsors")).select("nct_id", "allocation", "minimum_age", "organization")


@query("SELECT nct_id, count(*) AS n FROM d_m_outcomes WHERE nct_id IN (SELECT nct_id FROM d_m_studies WHERE overall_status = 'F') GROUP BY nct_id")
def children_for_selected(data: Data) -> DataFrame:
    return r.for_selected(m(data, "outcomes"), m(data, "studies").where("overall_status = 'F'")).groupBy("nct_id").count().withColumnRenamed("count", "n")


@query("SELECT DISTINCT lower(trim(term)) AS mesh_term_normalised, tree_number FROM d_m_mesh WHERE tree_number IS NOT NULL")
def mesh_tree_terms(data: Data) -> DataFrame:
    return r.mesh_tree_terms(m(data, "mesh")).select("mesh_term_normalised", "tree_number")


@query("SELECT outcome_id, nct_id, CAST(ord AS INT) AS ordinal, CAST(dup AS INT) AS duplicate_ordinal, units AS unit_of_measure FROM q_keys", K)
def relational_outcomes(data: Data) -> DataFrame:
    return keys(data).select("outcome_id", "nct_id", "ordinal", "duplicate_ordinal", "unit_of_measure")


@query(
    """SELECT k.outcome_id, CAST(a.g AS VARCHAR) AS group_key, t.title, CAST(c.count AS INT) AS n, c.units AS n_units FROM (SELECT outcome_id AS o, result_group_id AS g FROM d_m_counts UNION SELECT outcome_id, result_group_id FROM d_m_measurements) a JOIN q_keys k ON k.source_id = a.o
    LEFT JOIN d_m_groups t ON t.id = a.g LEFT JOIN (SELECT * FROM d_m_counts QUALIFY row_number() OVER (PARTITION BY outcome_id, result_group_id ORDER BY scope <> 'Measure', units <> 'Participants', id) = 1) c ON c.outcome_id = a.o AND c.result_group_id = a.g""",
    K,
)
def relational_outcome_groups(data: Data) -> DataFrame:
    return r.outcome_groups(keys(data), m(data, "counts"), m(data, "measurements"), m(data, "groups")).drop("nct_id")


@query("SELECT k.outcome_id, CAST(result_group_id AS VARCHAR) AS group_key, TRY_CAST(param_value AS DOUBLE) AS value, CAST(dispersion_value AS DOUBLE) AS spread, count(*) AS n FROM d_m_measurements x JOIN q_keys k ON k.source_id = x.outcome_id GROUP BY ALL", K)
def relational_measurements(data: Data) -> DataFrame:
    rows = r.outcome_measurements(keys(data), m(data, "measurements"))
    return rows.groupBy("outcome_id", "group_key", F.col("param_value_num").alias("value"), F.col("dispersion_value_num").alias("spread")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT k.outcome_id, CAST(row_number() OVER (PARTITION BY k.outcome_id ORDER BY a.id) - 1 AS INT) AS ordinal, coalesce(g.keys, '[]') AS group_keys, CASE WHEN p_value_modifier = '<' THEN '<' || p_value ELSE p_value END AS p_value,
    CASE WHEN p_value IS NULL AND p_value_modifier <> '' THEN p_value_modifier WHEN p_value IS NOT NULL THEN CASE WHEN p_value_modifier = '<' THEN '<' ELSE '=' END END AS p_value_modifier, CASE WHEN non_inferiority_type IS NOT NULL THEN non_inferiority_type LIKE 'Non-%' END AS non_inferiority
    FROM d_m_analyses a JOIN q_keys k ON k.source_id = a.outcome_id LEFT JOIN (SELECT outcome_analysis_id, '["' || string_agg(ctgov_group_code, '","' ORDER BY ctgov_group_code) || '"]' AS keys FROM d_m_analysis_groups GROUP BY 1) g ON g.outcome_analysis_id = a.id""",
    K,
)
def relational_analyses(data: Data) -> DataFrame:
    return r.outcome_analyses(keys(data), m(data, "analyses"), m(data, "analysis_groups")).select("outcome_id", "ordinal", "group_keys", "p_value", "p_value_modifier", "non_inferiority")


@query("SELECT md5(b.nct_id || '|' || b.title || '|' || coalesce(units, '')) AS baseline_id, g.title AS group_title, count(*) AS n, sum(CAST(param_value AS DOUBLE)) AS total FROM d_m_baseline b LEFT JOIN d_m_groups g ON g.id = b.result_group_id GROUP BY ALL")
def relational_baseline(data: Data) -> DataFrame:
    return r.baseline_measurements(m(data, "baseline"), m(data, "groups")).groupBy("baseline_id", "group_title").agg(F.count(F.lit(1)).alias("n"), F.sum("param_value_num").alias("total"))


_I = "SELECT id, nct_id, CAST(row_number() OVER (PARTITION BY nct_id ORDER BY id) - 1 AS INT) AS ordinal, lower(trim(name)) AS name FROM d_m_interventions"


@query(
    f"""SELECT 'intervention' AS kind, nct_id, ordinal, name AS value FROM ({_I}) i UNION ALL SELECT 'other_name', i.nct_id, i.ordinal, lower(o.name) FROM d_m_other_names o JOIN ({_I}) i ON i.id = o.intervention_id WHERE o.name IS NOT NULL
    UNION ALL SELECT DISTINCT 'arm', i.nct_id, i.ordinal, a.title FROM d_m_arm_links l JOIN ({_I}) i ON i.id = l.intervention_id JOIN d_m_arms a ON a.id = l.design_group_id WHERE a.title IS NOT NULL"""
)
def relational_interventions(data: Data) -> DataFrame:
    t = r.interventions(m(data, "interventions"), m(data, "other_names"), m(data, "arm_links"), m(data, "arms"))
    rows = t["interventions"].select(F.lit("intervention").alias("kind"), "nct_id", "ordinal", F.col("name_normalised").alias("value"))
    rows = rows.union(t["intervention_other_names"].select(F.lit("other_name"), "nct_id", "ordinal", "other_name_normalised"))
    return rows.union(t["arm_interventions"].select(F.lit("arm"), "nct_id", "intervention_ordinal", "group_title"))


@query(
    "SELECT 'outcome' AS result_kind, o.nct_id, o.title, o.units AS unit, o.time_frame, count(*) AS n FROM d_m_outcomes o GROUP BY ALL UNION ALL SELECT 'baseline', nct_id, title, unit, NULL, count(*) FROM (SELECT DISTINCT nct_id, title, units AS unit FROM d_m_baseline) b GROUP BY ALL"
)
def gather_result_rows(data: Data) -> DataFrame:
    rows = gather_rows(keys(data), r.baseline_measurements(m(data, "baseline"), m(data, "groups")))
    return rows.groupBy("result_kind", "nct_id", "title", F.col("unit_of_measure").alias("unit"), "time_frame").agg(F.count(F.lit(1)).alias("n"))
