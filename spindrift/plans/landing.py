"""Queries that land and keep tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import registry_json as r
from ..sources import tables as k
from .projections import Data
from .registry import query

BASE = "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag <> 'R'"
DELTA = "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'"
_LAST = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_quantity DESC) AS r FROM q_{0}) x WHERE r = 1"
VIEWS = {"q_base": BASE, "q_delta": DELTA, "q_new": _LAST.format("delta")}


@query("SELECT * FROM q_base b WHERE NOT EXISTS (SELECT 1 FROM q_new n WHERE n.l_orderkey = b.l_orderkey AND n.l_linenumber = b.l_linenumber) UNION ALL SELECT * FROM q_new", VIEWS)
def upsert_rows(data: Data) -> DataFrame:
    return k.upsert_rows(data.sql(BASE), data.sql(DELTA), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity"])


@query("SELECT * FROM q_base WHERE l_orderkey NOT IN (SELECT l_orderkey FROM q_delta) UNION ALL SELECT * FROM q_delta WHERE l_linenumber > 2", VIEWS)
def replace_children(data: Data) -> DataFrame:
    delta = data.sql(DELTA)
    return k.replace_children(data.sql(BASE), delta, delta.where("l_linenumber > 2"), ["l_orderkey"])


@query("SELECT count(*) AS n, count(l_quantity) AS with_quantity, count(note) AS with_note FROM (SELECT l_orderkey, CAST(min(l_quantity) AS INT) AS l_quantity, CAST(NULL AS VARCHAR) AS note FROM q_base GROUP BY l_orderkey) x", VIEWS)
def reconcile_schema(data: Data) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_quantity", T.IntegerType()), T.StructField("note", T.StringType())])
    out, _ = k.reconcile_schema(data.sql(BASE), schema, ["l_orderkey"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("with_quantity"), F.count("note").alias("with_note"))


@query("SELECT l_orderkey, count(*) AS n FROM q_base WHERE NOT (l_orderkey % 4 = 0 AND l_orderkey % 8 <> 0) GROUP BY l_orderkey", VIEWS)
def retain_studies(data: Data) -> DataFrame:
    base = data.sql(BASE)
    pulled, keep = data.table("orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey")), data.table("orders").where("o_orderkey % 8 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return k.retain_studies({"base": base}, pulled, keep, "l_orderkey")["base"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


#: Lines of a study that one record holds, about.
PAGE_LINES = 10_000


def paged(rows: DataFrame) -> DataFrame:
    """``rows`` with a page number, so that a study's rows of one page are ``PAGE_LINES`` or so; equal rows share a page."""
    most = rows.groupBy("nct_id").count().agg(F.max("count")).first()[0] or 1
    return rows.withColumn("page", F.pmod(F.xxhash64(*rows.columns), F.lit(-(-most // PAGE_LINES))))


def records(data: Data) -> DataFrame:
    """Study records built from orders and their lines, read back from JSON text under the fixed schema.

    A study has a record of its own (``kind`` is study) and as many records as needed for its arms and its
    outcomes, each holding a bounded number of lines; the flatteners union them.
    """
    outcome = F.struct("line_id", F.col("measure").alias("measure"), F.col("time_frame").alias("timeFrame"), F.col("description").alias("description"))
    planned = data.view("p_outcomes").select("nct_id", outcome.alias("x"))
    firsts = planned.groupBy("nct_id").agg(F.min("x").alias("first"))
    lines = paged(planned).groupBy("nct_id", "page").agg(F.array_sort(F.collect_list("x")).alias("o")).join(firsts, "nct_id")
    leads = F.col("o")[0].eqNullSafe(F.col("first"))
    item = F.struct("ordinal", F.col("intervention_type").alias("type"), "name", F.array("other_name", F.lit(" ")).alias("otherNames"), F.array("group_title", F.lit("No arm")).alias("armGroupLabels"))
    arms = paged(data.view("p_interventions")).groupBy("nct_id", "page").agg(F.array_sort(F.collect_set("group_title")).alias("labels"), F.array_sort(F.collect_list(item)).alias("i"))

    def record(rows: DataFrame, kind: str, *modules) -> DataFrame:
        title = F.concat(F.lit("Study "), "nct_id").alias("briefTitle")
        section = F.struct(F.struct(F.col("nct_id").alias("nctId"), title).alias("identificationModule"), *modules)
        return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(section.alias("protocolSection"))).alias("j"))

    found = record(
        data.view("p_studies"),
        "study",
        F.struct(F.struct(F.date_format("start_date", "yyyy-MM").alias("date")).alias("startDateStruct")).alias("statusModule"),
        F.struct(F.split("phase", "/").alias("phases"), F.struct("allocation").alias("designInfo")).alias("designModule"),
        F.struct(F.array(F.col("organization"), F.lit("")).alias("conditions")).alias("conditionsModule"),
    )
    found = found.unionByName(record(arms, "arms", F.struct(F.transform("labels", lambda x: F.struct(x.alias("label"))).alias("armGroups"), F.col("i").alias("interventions")).alias("armsInterventionsModule")))
    n, lead = F.size("o"), leads.cast("int")
    outcomes = F.struct(F.slice("o", F.lit(1), lead).alias("primaryOutcomes"), F.slice("o", lead + 1, n).alias("secondaryOutcomes")).alias("outcomesModule")
    found = found.unionByName(record(lines, "outcomes", outcomes))
    return found.select("kind", F.from_json("j", r.STUDY).alias("study"))


def own_records(data: Data) -> DataFrame:
    return records(data).where("kind = 'study'").select("study")


@query("SELECT nct_id, coalesce(phase, '') AS phase, CAST(date_trunc('month', start_date) AS VARCHAR) AS start_date, allocation FROM p_studies".replace("CAST(date_trunc('month', start_date) AS VARCHAR)", "strftime(start_date, '%Y-%m-01')"))
def flatten_studies(data: Data) -> DataFrame:
    out = r.flatten_studies(own_records(data))
    return out.select("nct_id", F.coalesce("phase", F.lit("")).alias("phase"), F.col("start_date").cast("string").alias("start_date"), "allocation")


@query("SELECT nct_id, CASE WHEN row_number() OVER (PARTITION BY nct_id ORDER BY line_id, measure, time_frame, description NULLS FIRST) = 1 THEN 'primary' ELSE 'secondary' END AS outcome_type, measure, time_frame FROM p_outcomes")
def flatten_planned_outcomes(data: Data) -> DataFrame:
    return r.flatten_planned_outcomes(records(data)).select("nct_id", "outcome_type", "measure", "time_frame")


@query("SELECT nct_id, title FROM p_arms")
def flatten_arms(data: Data) -> DataFrame:
    return r.flatten_arms(records(data)).select("nct_id", "title").distinct()  # a label is in each record with its interventions


@query("SELECT nct_id, lower(name) AS name_normalised, intervention_type FROM p_interventions")
def flatten_interventions(data: Data) -> DataFrame:
    return r.flatten_interventions(records(data)).select("nct_id", "name_normalised", "intervention_type")


@query("SELECT nct_id, lower(other_name) AS other_name_normalised FROM p_interventions")
def flatten_aliases(data: Data) -> DataFrame:
    return r.flatten_aliases(records(data)).select("nct_id", "other_name_normalised")


@query("SELECT nct_id, group_title, 'arm_label' AS link_method, count(*) AS n FROM p_interventions GROUP BY ALL")
def flatten_arm_links(data: Data) -> DataFrame:
    return r.flatten_arm_links(records(data)).groupBy("nct_id", "group_title", "link_method").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT nct_id, organization AS name FROM p_studies")
def flatten_conditions(data: Data) -> DataFrame:
    return r.flatten_conditions(own_records(data))


# A line's title is its key as text, so that no two lines share one, however large the keys are.
LINES = "SELECT 'NCT' || lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0') AS nct_id, CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20)) || '-' || CAST(l_partkey AS VARCHAR(20)) AS line, CAST(l_linenumber AS INT) AS n, CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS q, p_type, p_brand FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey) x JOIN part ON l_partkey = p_partkey"
RESULTS = {"q_lines": LINES}


def _groups(*names: str) -> Column:
    return F.array(*(F.struct(F.lit(f"G{k}").alias("id"), F.lit(x).alias("title")) for k, x in enumerate(names)))


def _denoms(a: Column, b: Column) -> Column:
    count = lambda group, value: F.struct(F.lit(group).alias("groupId"), value.alias("value"))
    return F.array(F.struct(F.lit("eyes").alias("units"), F.array(count("G0", F.lit("3"))).alias("counts")), F.struct(F.lit("Participants").alias("units"), F.array(count("G0", a), count("G1", b)).alias("counts")))


def _reported(line: Column) -> Column:
    """The reported outcome and the baseline characteristic that are made of a line."""
    lit, col = F.lit, lambda name: line[name]
    value = lambda group, v, spread: F.struct(lit(group).alias("groupId"), v.alias("value"), spread.alias("spread"))
    categories = F.array(F.struct(lit("all").alias("title"), F.array(value("G0", col("q"), lit("1.5")), value("G1", lit("NA"), lit("NA"))).alias("measurements")))
    analysis = F.struct(
        F.array(lit("G1"), lit("G0")).alias("groupIds"), lit("Mean Difference").alias("paramType"), col("q").alias("paramValue"), F.concat(F.when(col("n") % 2 == 0, "<").otherwise(""), lit("0.0"), col("n").cast("string")).alias("pValue"),
        lit("95").alias("ciPctValue"), F.when(col("n") == 2, "NON_INFERIORITY").when(col("n") == 4, "Superiority").alias("nonInferiorityType"),
    )
    outcome = F.struct(
        F.when(col("n") == 1, "PRIMARY").otherwise("SECONDARY").alias("type"), F.concat(lit("Outcome "), col("line")).alias("title"), lit("Week 4").alias("timeFrame"), lit("MEAN").alias("paramType"), col("p_brand").alias("unitOfMeasure"),
        _groups("Arm A", "Arm N").alias("groups"), _denoms(col("q"), lit("1,204")).alias("denoms"), F.array(F.struct(col("p_type").alias("title"), _denoms(col("q"), lit("7")).alias("denoms"), categories.alias("categories"))).alias("classes"),
        F.when(col("n") <= 4, F.array(analysis)).alias("analyses"),
    )
    measure = F.struct(
        F.concat(lit("Characteristic "), col("line")).alias("title"), lit("years").alias("unitOfMeasure"), _denoms(col("q"), F.when(col("n") % 3 == 0, "0").otherwise("5")).alias("denoms"),
        F.array(F.struct(lit(None).cast("string").alias("title"), _denoms(F.when(col("n") % 2 == 0, "0").otherwise("11"), lit("0")).alias("denoms"), categories.alias("categories"))).alias("classes"),
    )
    return F.struct(outcome.alias("o"), measure.alias("m"))


def result_records(data: Data) -> DataFrame:
    """Study records with reported outcomes and baseline characteristics, one of each for every line, read back from JSON text.

    Lines move to their study's record as they are, and what is made of them, which is some twenty times as large, is made there.
    """
    rows = data.sql(LINES)
    lines = F.collect_list(F.struct("line", "n", "q", "p_type", "p_brand")).alias("lines")
    lists = paged(rows).groupBy("nct_id", "page").agg(lines).select("nct_id", F.array_sort(F.transform("lines", _reported)).alias("x"))
    lit, col = F.lit, F.col
    results = F.struct(
        F.struct(F.transform("x", lambda y: y["o"]).alias("outcomeMeasures")).alias("outcomeMeasuresModule"),
        F.struct(_groups("Arm A", "Arm N").alias("groups"), _denoms(lit("100"), lit("200")).alias("denoms"), F.transform("x", lambda y: y["m"]).alias("measures")).alias("baselineCharacteristicsModule"),
    )
    section = F.struct(F.struct(col("nct_id").alias("nctId")).alias("identificationModule"))
    made = lists.select(F.to_json(F.struct(section.alias("protocolSection"), results.alias("resultsSection"))).alias("j"))
    return made.select(F.from_json("j", r.STUDY).alias("study"))


_OUTCOME_ID = "md5(nct_id || '|' || CASE n WHEN 1 THEN 'PRIMARY' ELSE 'SECONDARY' END || '|Outcome ' || line || '|Week 4|0')"


@query(f"SELECT {_OUTCOME_ID} AS outcome_id, nct_id, CASE n WHEN 1 THEN 'PRIMARY' ELSE 'SECONDARY' END AS outcome_type, 'Outcome ' || line AS title, p_brand AS unit_of_measure FROM q_lines", RESULTS)
def flatten_reported_outcomes(data: Data) -> DataFrame:
    return r.flatten_reported_outcomes(result_records(data)).select("outcome_id", "nct_id", "outcome_type", "title", "unit_of_measure")


@query(f"SELECT {_OUTCOME_ID} AS outcome_id, 'G0' AS group_key, 'Arm A' AS title, CAST(q AS INT) AS n, 'Participants' AS n_units FROM q_lines UNION ALL SELECT {_OUTCOME_ID}, 'G1', 'Arm N', 1204, 'Participants' FROM q_lines", RESULTS)
def flatten_outcome_groups(data: Data) -> DataFrame:
    return r.flatten_outcome_groups(result_records(data)).select("outcome_id", "group_key", "title", "n", "n_units")


@query(f"SELECT {_OUTCOME_ID} AS outcome_id, 'G0' AS group_key, p_type AS class_title, q AS param_value, CAST(q AS DOUBLE) AS param_value_num, 1.5e0 AS dispersion_value_num, CAST(q AS INT) AS n FROM q_lines UNION ALL SELECT {_OUTCOME_ID}, 'G1', p_type, 'NA', NULL, NULL, 7 FROM q_lines", RESULTS)
def flatten_measurements(data: Data) -> DataFrame:
    return r.flatten_measurements(result_records(data)).select("outcome_id", "group_key", "class_title", "param_value", "param_value_num", "dispersion_value_num", "n")


@query(
    f"""SELECT md5({_OUTCOME_ID} || '|0') AS analysis_id, {_OUTCOME_ID} AS outcome_id, '["G1","G0"]' AS group_keys, CAST(q AS DOUBLE) AS param_value_num, CASE WHEN n % 2 = 0 THEN '<' ELSE '' END || '0.0' || CAST(n AS VARCHAR) AS p_value, CAST(n AS DOUBLE) / 100 AS p_value_num,
    CASE WHEN n % 2 = 0 THEN '<' END AS p_value_modifier, 95.0e0 AS ci_percent, CASE n WHEN 2 THEN TRUE WHEN 4 THEN FALSE END AS non_inferiority FROM q_lines WHERE n <= 4""",
    RESULTS,
)
def flatten_analyses(data: Data) -> DataFrame:
    return r.flatten_analyses(result_records(data)).select("analysis_id", "outcome_id", "group_keys", "param_value_num", "p_value", "p_value_num", "p_value_modifier", "ci_percent", "non_inferiority")


@query(
    """SELECT md5(nct_id || '|Characteristic ' || line || '|years') AS baseline_id, 'G0' AS group_key, 'Arm A' AS group_title, CAST(q AS DOUBLE) AS param_value_num, CASE WHEN n % 2 = 1 THEN 11 ELSE CAST(q AS INT) END AS n FROM q_lines
    UNION ALL SELECT md5(nct_id || '|Characteristic ' || line || '|years'), 'G1', 'Arm N', NULL, CASE WHEN n % 3 = 0 THEN 200 ELSE 5 END FROM q_lines""",
    RESULTS,
)
def flatten_baseline(data: Data) -> DataFrame:
    return r.flatten_baseline(result_records(data)).select("baseline_id", "group_key", "group_title", "param_value_num", "n")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_field(data: Data) -> DataFrame:
    rows = data.table("events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'interventions' AS table_name, 'same' AS status, count(*) AS rows_before, count(*) AS rows_after FROM p_interventions
    UNION ALL SELECT 'studies', 'changed', (SELECT count(*) FROM p_studies), (SELECT count(*) FROM p_studies WHERE phase IS NOT NULL)
    UNION ALL SELECT 'areas', 'dropped', count(*), NULL FROM p_study_ta UNION ALL SELECT 'analyses', 'added', NULL, count(*) FROM p_analyses"""
)
def snapshot_compare(data: Data) -> DataFrame:
    """Two logged runs: the second one lands fewer studies, the same interventions in another order, no areas, and analyses."""
    log, at = k.scratch(data.spark, "run-log"), k.scratch(data.spark, "run-tables")
    first = k.Run(data.spark, log, "first", "mirror")
    for name, view in (("studies", "p_studies"), ("interventions", "p_interventions"), ("areas", "p_study_ta")):
        first.write(name, data.view(view), f"{at}/first/{name}")
    first.close()
    second = k.Run(data.spark, log, "second", "mirror", {"phase": "stated"})
    second.write("studies", data.view("p_studies").where("phase is not null"), f"{at}/second/studies")
    second.write("interventions", data.view("p_interventions").orderBy("name"), f"{at}/second/interventions")
    second.write("analyses", data.view("p_analyses"), f"{at}/second/analyses")
    second.close()
    return k.compared(k.read_log(data.spark, log), "first", "second")


@query("SELECT run_id, source, filters_json, table_name, row_count FROM (SELECT 'only' AS run_id, 'mirror' AS source, '{\"phase\": \"PHASE2\"}' AS filters_json, 'studies' AS table_name, count(*) AS row_count FROM p_studies WHERE phase = 'PHASE2' UNION ALL SELECT 'only', 'mirror', '{\"phase\": \"PHASE2\"}', 'arms', count(*) FROM p_arms) x")
def append_run_log(data: Data) -> DataFrame:
    """What a run's log says of the tables that it wrote."""
    log, at = k.scratch(data.spark, "run-log"), k.scratch(data.spark, "run-tables")
    run = k.Run(data.spark, log, "only", "mirror", {"phase": "PHASE2"})
    run.write("studies", data.view("p_studies").where("phase = 'PHASE2'"), f"{at}/studies")
    run.write("arms", data.view("p_arms"), f"{at}/arms")
    run.close()
    return k.read_log(data.spark, log).select("run_id", "source", "filters_json", "table_name", "row_count")
