"""A registry's relational mirror: its tables read over JDBC, and landed under the same schemas as the nested records.

Columns that a mirror lacks come as nulls. Ids are hashes of what identifies a row in the registry, so that a study keeps
its ids whichever way it is landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_id


def read_table(spark: SparkSession, url: str, table: str, properties: dict[str, str], key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, where: list[str] | None = None) -> DataFrame:
    """A table over JDBC: by ranges of a numeric key, or by predicates (one task each, as for ranges of study ids), else by one task.

    Spark sends filters and the columns that are asked for to the database. Predicates must be disjoint and cover what is wanted: a row that
    two of them meet comes twice. With a key, ``bounds`` only tell where the ranges are cut; rows outside come with the first or last.
    """
    if where and key:
        raise ValueError("either predicates or ranges of a key")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if where:
        return spark.read.jdbc(url, table, predicates=where, properties=properties)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def id_ranges(first: int, last: int, parts: int, column: str = "nct_id", width: int = 8) -> list[str]:
    """Predicates that cut the study ids from ``first`` to ``last`` into ranges of equal width; each id is in exactly one."""
    step = -(-(last - first + 1) // parts)
    starts = list(range(first, last + 1, step))
    return [f"{column} >= 'NCT{a:0{width}d}' AND {column} < 'NCT{min(a + step, last + 1):0{width}d}'" for a in starts]


def optional(df: DataFrame, name: str, kind: str = "string", alias: str | None = None) -> Column:
    """A column, or null where the mirror lacks it."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(alias or name)


def assemble_studies(studies: DataFrame, designs: DataFrame, eligibilities: DataFrame, sponsors: DataFrame) -> DataFrame:
    """One row for each study; a design or eligibility row where there is one, and the least name of its lead sponsors."""
    lead = sponsors.where("lead_or_collaborator = 'lead'").groupBy("nct_id").agg(F.min("name").alias("organization"))
    one = lambda df, *columns: df.groupBy("nct_id").agg(*(F.min(c).alias(c) for c in columns))
    return studies.join(one(designs, "allocation", "masking"), "nct_id", "left").join(one(eligibilities, "gender", "minimum_age"), "nct_id", "left").join(lead, "nct_id", "left")


def for_selected(child: DataFrame, selected: DataFrame) -> DataFrame:
    return child.join(selected.select("nct_id"), "nct_id", "left_semi")


def mesh_tree_terms(mesh: DataFrame) -> DataFrame:
    """mesh_term, mesh_term_normalised, tree_number; columns are found by name, rows without either left out, one row of each pair."""
    term = next((c for c in ("mesh_term", "term", "name") if c in mesh.columns), None)
    tree = next((c for c in ("tree_number", "tree") if c in mesh.columns), None)
    if term is None or tree is None:
        raise ValueError("no columns for terms and tree numbers")
    rows = mesh.select(F.col(term).alias("mesh_term"), F.nullif(F.lower(F.trim(term)), F.lit("")).alias("mesh_term_normalised"), F.col(tree).alias("tree_number"))
    kept = rows.where("mesh_term_normalised is not null and tree_number is not null")
    return kept.groupBy("mesh_term_normalised", "tree_number").agg(F.min("mesh_term").alias("mesh_term"))


def outcome_keys(outcomes: DataFrame) -> DataFrame:
    """Outcomes with outcome_id (a hash), their ordinal in the study and among equal titles; ``source_id`` is the mirror's id."""
    same = Window.partitionBy("nct_id", F.lower("outcome_type"), "title", "time_frame").orderBy("id")
    rows = outcomes.select(
        F.col("id").alias("source_id"), "id", "nct_id", *(optional(outcomes, c) for c in ("outcome_type", "title", "description", "time_frame", "population", "param_type", "dispersion_type")),
        optional(outcomes, "units", alias="unit_of_measure"), optional(outcomes, "units_analyzed"),
    )
    rows = rows.withColumn("duplicate_ordinal", F.row_number().over(same) - 1).withColumn("ordinal", F.row_number().over(Window.partitionBy("nct_id").orderBy("id")) - 1)
    return rows.withColumn("outcome_id", content_id(F.col("nct_id"), F.lower("outcome_type"), F.col("title"), F.col("time_frame"), F.col("duplicate_ordinal"))).drop("id")


def outcome_groups(keys: DataFrame, counts: DataFrame, measurements: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each outcome and arm: its count (of the measure first, then of participants, then the lowest id), else an arm that has measurements only.

    counts: id, outcome_id, result_group_id, scope, units, count. groups: id, title.
    """
    order = F.struct(F.when(F.lower("scope") == "measure", 0).otherwise(1).alias("a"), F.when(F.lower("units").contains("participant"), 0).otherwise(1).alias("b"), "id")
    best = counts.groupBy("outcome_id", "result_group_id").agg(F.min_by(F.struct(F.col("count").alias("n"), F.col("units").alias("n_units")), order).alias("c"))
    arms = best.select("outcome_id", "result_group_id").unionByName(measurements.select("outcome_id", "result_group_id")).distinct()
    rows = arms.join(best, ["outcome_id", "result_group_id"], "left").join(groups.select(F.col("id").alias("result_group_id"), F.col("title").alias("group_title")), "result_group_id", "left")
    key = keys.select(F.col("source_id").alias("outcome_id"), F.col("outcome_id").alias("key"), "nct_id")
    return rows.join(key, "outcome_id").select(F.col("key").alias("outcome_id"), "nct_id", F.col("result_group_id").cast("string").alias("group_key"), F.col("group_title").alias("title"), F.col("c.n").try_cast("int").alias("n"), "c.n_units")


def outcome_measurements(keys: DataFrame, measurements: DataFrame) -> DataFrame:
    """Measurements under the outcomes' hashed ids; values that are no numbers stay as texts."""
    key = keys.select(F.col("source_id").alias("outcome_id"), F.col("outcome_id").alias("key"), "nct_id")
    rows = measurements.join(key, "outcome_id")
    number = lambda c: optional(measurements, c, "string").try_cast("double").alias(c if c.endswith("limit") else f"{c}_num")
    return rows.select(
        F.col("key").alias("outcome_id"), F.col("nct_id"), F.col("result_group_id").cast("string").alias("group_key"), optional(measurements, "param_value"), number("param_value"),
        optional(measurements, "dispersion_value"), number("dispersion_value"), number("dispersion_lower_limit"), number("dispersion_upper_limit"),
    )


def p_value_parts(modifier: Column, value: Column) -> tuple[Column, Column, Column]:
    """(text, number, modifier) of a p-value that the mirror splits in two; '=' is left out of the text."""
    sign, text = F.coalesce(modifier.cast("string"), F.lit("=")), value.cast("string")
    whole = F.when(text.isNull(), None).when(sign.isin("", "="), text).otherwise(F.concat(sign, text))
    kept = F.when(text.isNull(), F.nullif(modifier.cast("string"), F.lit(""))).otherwise(F.coalesce(F.nullif(modifier.cast("string"), F.lit("")), F.lit("=")))
    return whole, text.try_cast("double"), kept


def non_inferiority(kind: Column) -> Column:
    """Whether a type of test is one of non-inferiority or equivalence; null without a type."""
    k = F.lower(kind)
    return F.when(kind.isNull(), None).otherwise(k.contains("non-inferiority") | k.contains("noninferiority") | k.contains("equivalence"))


def outcome_analyses(keys: DataFrame, analyses: DataFrame, groups: DataFrame) -> DataFrame:
    """Analyses with a hashed id, their place in the outcome and the compared arms as an ordered JSON array.

    groups: outcome_analysis_id, ctgov_group_code.
    """
    arms = groups.groupBy(F.col("outcome_analysis_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list("ctgov_group_code"))).alias("group_keys"))
    key = keys.select(F.col("source_id").alias("outcome_id"), F.col("outcome_id").alias("key"), "nct_id")
    rows = analyses.join(key, "outcome_id").join(arms, "id", "left").withColumn("ordinal", F.row_number().over(Window.partitionBy("key").orderBy("id")) - 1)
    text, number, modifier = p_value_parts(optional(analyses, "p_value_modifier"), optional(analyses, "p_value"))
    return rows.select(
        content_id(F.col("key"), F.col("ordinal")).alias("analysis_id"), F.col("key").alias("outcome_id"), F.col("nct_id"), "ordinal", F.coalesce("group_keys", F.lit("[]")).alias("group_keys"),
        optional(analyses, "param_type"), optional(analyses, "param_value"), optional(analyses, "param_value").try_cast("double").alias("param_value_num"), text.alias("p_value"), number.alias("p_value_num"), modifier.alias("p_value_modifier"),
        optional(analyses, "ci_percent").try_cast("double").alias("ci_percent"), optional(analyses, "ci_lower_limit").try_cast("double").alias("ci_lower_limit"), optional(analyses, "ci_upper_limit").try_cast("double").alias("ci_upper_limit"),
        optional(analyses, "method"), non_inferiority(optional(analyses, "non_inferiority_type")).alias("non_inferiority"), optional(analyses, "non_inferiority_type"), optional(analyses, "non_inferiority_description"),
    )


def baseline_measurements(baseline: DataFrame, groups: DataFrame) -> DataFrame:
    """Baseline rows under a hash of study, title and unit, with the title of their group (groups: id, title)."""
    rows = baseline.join(groups.select(F.col("id").alias("result_group_id"), F.col("title").alias("group_title")), "result_group_id", "left")
    return rows.select(
        content_id(F.col("nct_id"), F.col("title"), optional(baseline, "units")).alias("baseline_id"), "nct_id", optional(baseline, "ctgov_group_code", alias="group_key"), "title", optional(baseline, "units", alias="unit_of_measure"),
        optional(baseline, "category", alias="category_title"), optional(baseline, "param_type"), optional(baseline, "param_value"), optional(baseline, "param_value").try_cast("double").alias("param_value_num"),
        optional(baseline, "dispersion_type"), optional(baseline, "dispersion_value").try_cast("double").alias("dispersion_value_num"), optional(baseline, "number_analyzed").try_cast("int").alias("n"), "group_title",
    )


def interventions(source: DataFrame, other_names: DataFrame, links: DataFrame, arms: DataFrame) -> dict[str, DataFrame]:
    """interventions, intervention_other_names and arm_interventions.

    source: id, nct_id, intervention_type, name. other_names: intervention_id, name. links: design_group_id, intervention_id. arms: id, title.
    """
    plain = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    rows = source.withColumn("ordinal", (F.row_number().over(Window.partitionBy("nct_id").orderBy("id")) - 1).cast("int"))
    key = rows.select(F.col("id").alias("intervention_id"), "nct_id", "ordinal")
    titled = arms.where("title is not null").select(F.col("id").alias("design_group_id"), F.col("title").alias("group_title"))
    return {
        "interventions": rows.select("nct_id", "ordinal", optional(source, "intervention_type"), "name", plain(F.col("name")).alias("name_normalised"), optional(source, "description")),
        "intervention_other_names": other_names.where("name is not null").join(key, "intervention_id").select("nct_id", "ordinal", F.col("name").alias("other_name"), plain(F.col("name")).alias("other_name_normalised")),
        "arm_interventions": links.join(key, "intervention_id").join(titled, "design_group_id").select("nct_id", "group_title", F.col("ordinal").alias("intervention_ordinal"), F.lit("join_table").alias("link_method")).distinct(),
    }
