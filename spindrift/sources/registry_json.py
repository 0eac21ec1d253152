"""Registry records as nested JSON, flattened into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import month_date, p_modifier, p_number, strict
from ..functions.text import content_id, key

_GROUP_VALUE = "array<struct<groupId: string, value: string>>"
_DENOMS = f"array<struct<units: string, counts: {_GROUP_VALUE}>>"
_MEASUREMENTS = "array<struct<groupId: string, value: string, spread: string, lowerLimit: string, upperLimit: string, comment: string>>"
_CLASSES = f"array<struct<title: string, denoms: {_DENOMS}, categories: array<struct<title: string, measurements: {_MEASUREMENTS}>>>>"
_ANALYSES = (
    "array<struct<groupIds: array<string>, groupDescription: string, paramType: string, paramValue: string, dispersionType: string, dispersionValue: string, pValue: string, pValueComment: string, ciPctValue: string, "
    "ciNumSides: string, ciLowerLimit: string, ciUpperLimit: string, statisticalMethod: string, statisticalComment: string, nonInferiority: boolean, nonInferiorityType: string, nonInferiorityComment: string, estimateComment: string>>"
)
_OUTCOMES = "array<struct<measure: string, timeFrame: string, description: string>>"
_MESH = "struct<meshes: array<struct<id: string, term: string>>, ancestors: array<struct<id: string, term: string>>, browseBranches: array<struct<abbrev: string, name: string>>>"
#: The part of a study record that the tables below read; never inferred.
STUDY = f"""struct<
 protocolSection: struct<
  identificationModule: struct<nctId: string, briefTitle: string, officialTitle: string>,
  statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>, primaryCompletionDateStruct: struct<date: string>>,
  sponsorCollaboratorsModule: struct<leadSponsor: struct<name: string>>,
  designModule: struct<studyType: string, phases: array<string>, enrollmentInfo: struct<count: int, type: string>, designInfo: struct<allocation: string, interventionModel: string, primaryPurpose: string, maskingInfo: struct<masking: string>>>,
  eligibilityModule: struct<sex: string, minimumAge: string, maximumAge: string, healthyVolunteers: boolean>,
  conditionsModule: struct<conditions: array<string>>,
  armsInterventionsModule: struct<armGroups: array<struct<label: string, type: string, description: string>>,
   interventions: array<struct<type: string, name: string, description: string, otherNames: array<string>, armGroupLabels: array<string>>>>,
  outcomesModule: struct<primaryOutcomes: {_OUTCOMES}, secondaryOutcomes: {_OUTCOMES}, otherOutcomes: {_OUTCOMES}>>,
 derivedSection: struct<conditionBrowseModule: {_MESH}, interventionBrowseModule: {_MESH}>,
 resultsSection: struct<outcomeMeasuresModule: struct<outcomeMeasures: array<struct<type: string, title: string, description: string, timeFrame: string, paramType: string, dispersionType: string,
   unitOfMeasure: string, groups: array<struct<id: string, title: string, description: string>>, denoms: {_DENOMS}, classes: {_CLASSES}, analyses: {_ANALYSES}>>>,
  baselineCharacteristicsModule: struct<groups: array<struct<id: string, title: string>>, denoms: {_DENOMS}, measures: array<struct<title: string, description: string, populationDescription: string,
   paramType: string, dispersionType: string, unitOfMeasure: string, denoms: {_DENOMS}, classes: {_CLASSES}>>>>,
 hasResults: boolean>""".replace("\n", "")
PAGE = f"struct<studies: array<{STUDY}>, nextPageToken: string>"
ID = "study.protocolSection.identificationModule.nctId"


def page_schema():
    from pyspark.sql import types as T

    return T._parse_datatype_string(PAGE) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(PAGE.removeprefix("struct<").removesuffix(">"))


def read_registry_json(spark: SparkSession, path: str) -> DataFrame:
    """One row (``study``) for each record of the page files under a path."""
    return studies_of(spark.read.schema(page_schema()).option("multiLine", True).json(path))


def studies_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("studies").alias("study")).where(F.col(ID).isNotNull())


def _each(studies: DataFrame, array: str, as_: str = "x") -> DataFrame:
    return studies.select(F.col(ID).alias("nct_id"), F.posexplode(F.col(f"study.{array}")).alias("ordinal", as_))


def flatten_studies(studies: DataFrame) -> DataFrame:
    p, d = "study.protocolSection", "study.protocolSection.designModule"
    return studies.select(
        F.col(ID).alias("nct_id"), F.array_join(f"{d}.phases", "/").alias("phase"), F.col(f"{p}.statusModule.overallStatus").alias("overall_status"), F.col(f"{d}.studyType").alias("study_type"),
        month_date(F.col(f"{p}.statusModule.startDateStruct.date")).alias("start_date"), month_date(F.col(f"{p}.statusModule.primaryCompletionDateStruct.date")).alias("primary_completion_date"),
        F.col(f"{p}.identificationModule.briefTitle").alias("brief_title"), F.col(f"{p}.identificationModule.officialTitle").alias("official_title"),
        F.col(f"{d}.designInfo.allocation").alias("allocation"), F.col(f"{d}.designInfo.interventionModel").alias("intervention_model"), F.col(f"{d}.designInfo.primaryPurpose").alias("primary_purpose"),
        F.col(f"{d}.designInfo.maskingInfo.masking").alias("masking"), F.col(f"{d}.enrollmentInfo.count").alias("enrollment_count"), F.col(f"{d}.enrollmentInfo.type").alias("enrollment_type"),
        F.col(f"{p}.eligibilityModule.healthyVolunteers").alias("healthy_volunteers"), F.col(f"{p}.eligibilityModule.sex").alias("gender"), F.col(f"{p}.eligibilityModule.minimumAge").alias("minimum_age"),
        F.col(f"{p}.eligibilityModule.maximumAge").alias("maximum_age"), F.col(f"{p}.sponsorCollaboratorsModule.leadSponsor.name").alias("organization"), F.col("study.hasResults").alias("has_results"),
    )


def flatten_arms(studies: DataFrame) -> DataFrame:
    return _each(studies, "protocolSection.armsInterventionsModule.armGroups").select("nct_id", F.col("x.type").alias("group_type"), F.col("x.label").alias("title"), F.col("x.description").alias("description"))


def flatten_planned_outcomes(studies: DataFrame) -> DataFrame:
    m = "study.protocolSection.outcomesModule"
    kinds = F.array(*(F.struct(F.lit(k).alias("outcome_type"), F.col(f"{m}.{k}Outcomes").alias("o")) for k in ("primary", "secondary", "other")))
    rows = studies.select(F.col(ID).alias("nct_id"), F.explode(kinds).alias("k")).select("nct_id", "k.outcome_type", F.explode("k.o").alias("o"))
    return rows.select("nct_id", "outcome_type", "o.measure", F.col("o.timeFrame").alias("time_frame"), "o.description")


def flatten_conditions(studies: DataFrame) -> DataFrame:
    return _each(studies, "protocolSection.conditionsModule.conditions").where("trim(x) <> ''").select("nct_id", F.col("x").alias("name"))


def flatten_mesh(studies: DataFrame, side: str = "condition") -> DataFrame:
    """MeSH terms of the conditions or interventions, with ancestors by type."""
    m = f"study.derivedSection.{side}BrowseModule"
    kinds = F.array(F.struct(F.lit("mesh-list").alias("mesh_type"), F.col(f"{m}.meshes").alias("t")), F.struct(F.lit("mesh-ancestor").alias("mesh_type"), F.col(f"{m}.ancestors").alias("t")))
    rows = studies.select(F.col(ID).alias("nct_id"), F.explode(kinds).alias("k")).select("nct_id", "k.mesh_type", F.explode("k.t").alias("t"))
    return rows.where("t.term is not null").select("nct_id", F.col("t.term").alias("mesh_term"), key(F.col("t.term")).alias("mesh_term_normalised"), "mesh_type")


def flatten_branches(studies: DataFrame, side: str = "condition") -> DataFrame:
    rows = _each(studies, f"derivedSection.{side}BrowseModule.browseBranches")
    stated = F.col("x.abbrev").isNotNull() if side == "condition" else F.coalesce("x.abbrev", "x.name").isNotNull()
    return rows.where(stated).select("nct_id", F.col("x.abbrev").alias("branch_abbrev"), F.col("x.name").alias("branch_name"))


def flatten_interventions(studies: DataFrame) -> DataFrame:
    rows = _each(studies, "protocolSection.armsInterventionsModule.interventions")
    return rows.select("nct_id", "ordinal", F.col("x.type").alias("intervention_type"), "x.name", key(F.col("x.name")).alias("name_normalised"), "x.description")


def flatten_aliases(studies: DataFrame) -> DataFrame:
    rows = _each(studies, "protocolSection.armsInterventionsModule.interventions").select("nct_id", "ordinal", F.explode("x.otherNames").alias("other_name"))
    return rows.where("trim(other_name) <> ''").withColumn("other_name_normalised", key(F.col("other_name")))


def flatten_arm_links(studies: DataFrame) -> DataFrame:
    """Interventions of arms, where the label is one of the study's arms."""
    m = "study.protocolSection.armsInterventionsModule"
    rows = studies.select(F.col(ID).alias("nct_id"), F.col(f"{m}.armGroups.label").alias("labels"), F.posexplode(f"{m}.interventions").alias("ordinal", "x"))
    rows = rows.select("nct_id", "ordinal", "labels", F.explode("x.armGroupLabels").alias("label")).where("array_contains(labels, label)")
    return rows.select("nct_id", F.col("label").alias("group_title"), F.col("ordinal").alias("intervention_ordinal"), F.lit("arm_label").alias("link_method"))


def denominator(denoms: Column) -> Column:
    """The first denominator in participants, else the first: a struct of its units and a map from group to n."""
    participants = F.filter(denoms, lambda d: F.lower(d["units"]).contains("participant"))
    chosen = F.coalesce(F.try_element_at(participants, F.lit(1)), F.try_element_at(denoms, F.lit(1)))
    counts = F.map_from_entries(F.transform(chosen["counts"], lambda c: F.struct(c["groupId"].alias("k"), strict(c["value"]).cast("int").alias("v"))))
    return F.named_struct(F.lit("units"), chosen["units"], F.lit("n"), counts)


def reported_outcomes(studies: DataFrame, *parts: Column) -> DataFrame:
    """Reported outcomes with a content id; equal outcomes of a study are told apart by their order.

    parts: what the caller needs of an outcome ``x``. It is taken before outcomes move, so that the rest of them never does.
    """
    rows = _each(studies, "resultsSection.outcomeMeasuresModule.outcomeMeasures")
    rows = rows.select("nct_id", "ordinal", F.col("x.type").alias("outcome_type"), "x.title", F.col("x.timeFrame").alias("time_frame"), *parts)
    fields = [F.col("nct_id"), F.col("outcome_type"), F.col("title"), F.col("time_frame")]
    from pyspark.sql import Window

    same = F.row_number().over(Window.partitionBy(*fields).orderBy("ordinal")) - 1
    return rows.withColumn("duplicate", same).withColumn("outcome_id", content_id(*fields, F.col("duplicate")))


def flatten_reported_outcomes(studies: DataFrame) -> DataFrame:
    more = {"x.description": "description", "x.paramType": "param_type", "x.dispersionType": "dispersion_type", "x.unitOfMeasure": "unit_of_measure"}
    rows = reported_outcomes(studies, *(F.col(c).alias(name) for c, name in more.items()))
    return rows.select("outcome_id", "nct_id", "ordinal", "outcome_type", "title", "description", "time_frame", "param_type", "dispersion_type", "unit_of_measure")


def flatten_outcome_groups(studies: DataFrame) -> DataFrame:
    rows = reported_outcomes(studies, denominator(F.col("x.denoms")).alias("d"), F.col("x.groups").alias("groups"))
    rows = rows.select("outcome_id", "nct_id", "d", F.posexplode("groups").alias("ordinal", "g"))
    return rows.select("outcome_id", "nct_id", F.col("g.id").alias("group_key"), "ordinal", "g.title", "g.description", F.try_element_at("d.n", F.col("g.id")).alias("n"), F.col("d.units").alias("n_units"))


def flatten_measurements(studies: DataFrame) -> DataFrame:
    rows = reported_outcomes(studies, F.col("x.classes").alias("classes")).select("outcome_id", "nct_id", F.explode("classes").alias("c"))
    rows = rows.select("outcome_id", "nct_id", F.col("c.title").alias("class_title"), denominator(F.col("c.denoms")).alias("d"), F.explode("c.categories").alias("k"))
    rows = rows.select("outcome_id", "nct_id", "class_title", "d", F.col("k.title").alias("category_title"), F.explode("k.measurements").alias("m"))
    return rows.select(
        "outcome_id", "nct_id", F.col("m.groupId").alias("group_key"), "class_title", "category_title", F.col("m.value").alias("param_value"), strict(F.col("m.value")).alias("param_value_num"),
        F.col("m.spread").alias("dispersion_value"), strict(F.col("m.spread")).alias("dispersion_value_num"), strict(F.col("m.lowerLimit")).alias("dispersion_lower_limit"),
        strict(F.col("m.upperLimit")).alias("dispersion_upper_limit"), F.try_element_at("d.n", F.col("m.groupId")).alias("n"), F.col("m.comment").alias("comment"),
    )


def non_inferiority(flag: Column, kind: Column) -> Column:
    """The stated flag, else whether the type of test is one of non-inferiority or equivalence; null without both."""
    k = F.lower(kind)
    typed = F.when(kind.isNotNull(), k.contains("non-inferiority") | k.contains("noninferiority") | k.contains("non_inferiority") | k.contains("equivalence"))
    return F.coalesce(flag, typed)


def flatten_analyses(studies: DataFrame) -> DataFrame:
    """Statistical analyses of reported outcomes: their p-values split, limits as numbers, the compared groups as a JSON array."""
    rows = reported_outcomes(studies, F.col("x.analyses").alias("analyses")).select("outcome_id", "nct_id", F.posexplode("analyses").alias("ordinal", "a"))
    p = F.col("a.pValue")
    return rows.select(
        content_id(F.col("outcome_id"), F.col("ordinal")).alias("analysis_id"), "outcome_id", "nct_id", "ordinal", F.to_json(F.coalesce("a.groupIds", F.array().cast("array<string>"))).alias("group_keys"),
        F.col("a.groupDescription").alias("group_description"), F.col("a.paramType").alias("param_type"), F.col("a.paramValue").alias("param_value"), strict(F.col("a.paramValue")).alias("param_value_num"),
        F.col("a.dispersionType").alias("dispersion_type"), F.col("a.dispersionValue").alias("dispersion_value"), strict(F.col("a.dispersionValue")).alias("dispersion_value_num"),
        p.alias("p_value"), p_number(p).alias("p_value_num"), p_modifier(p).alias("p_value_modifier"), F.col("a.pValueComment").alias("p_value_description"), strict(F.col("a.ciPctValue")).alias("ci_percent"),
        F.col("a.ciNumSides").alias("ci_n_sides"), strict(F.col("a.ciLowerLimit")).alias("ci_lower_limit"), strict(F.col("a.ciUpperLimit")).alias("ci_upper_limit"), F.col("a.statisticalMethod").alias("method"),
        F.col("a.statisticalComment").alias("method_description"), non_inferiority(F.col("a.nonInferiority"), F.col("a.nonInferiorityType")).alias("non_inferiority"), F.col("a.nonInferiorityType").alias("non_inferiority_type"),
        F.col("a.nonInferiorityComment").alias("non_inferiority_description"), F.col("a.estimateComment").alias("estimate_description"),
    )


def flatten_baseline(studies: DataFrame) -> DataFrame:
    """Baseline measurements; n is the first count that is not zero of the class', the measure's and the module's denominators."""
    m = "study.resultsSection.baselineCharacteristicsModule"
    titles = F.map_from_entries(F.transform(f"{m}.groups", lambda g: F.struct(g["id"].alias("k"), g["title"].alias("v"))))
    rows = studies.select(F.col(ID).alias("nct_id"), titles.alias("titles"), denominator(F.col(f"{m}.denoms")).alias("d3"), F.posexplode(f"{m}.measures").alias("ordinal", "x"))
    rows = rows.withColumn("d2", denominator(F.col("x.denoms"))).select("*", F.explode("x.classes").alias("c")).withColumn("d1", denominator(F.col("c.denoms")))
    rows = rows.select("*", F.explode("c.categories").alias("k")).select("*", F.explode("k.measurements").alias("v"))
    group = F.col("v.groupId")
    count = F.coalesce(*(F.nullif(F.try_element_at(f"{d}.n", group), F.lit(0)) for d in ("d1", "d2")), F.try_element_at("d3.n", group))
    return rows.select(
        content_id(F.col("nct_id"), F.col("x.title"), F.col("x.unitOfMeasure")).alias("baseline_id"), "nct_id", group.alias("group_key"), "ordinal", F.col("x.title").alias("title"), F.col("x.description").alias("description"),
        F.col("x.populationDescription").alias("population"), F.col("c.title").alias("class_title"), F.col("k.title").alias("category_title"), F.col("x.unitOfMeasure").alias("unit_of_measure"), F.col("x.paramType").alias("param_type"),
        F.col("v.value").alias("param_value"), strict(F.col("v.value")).alias("param_value_num"), F.col("x.dispersionType").alias("dispersion_type"), F.col("v.spread").alias("dispersion_value"),
        strict(F.col("v.spread")).alias("dispersion_value_num"), strict(F.col("v.lowerLimit")).alias("dispersion_lower_limit"), strict(F.col("v.upperLimit")).alias("dispersion_upper_limit"), count.alias("n"),
        F.try_element_at("titles", group).alias("group_title"),
    )
