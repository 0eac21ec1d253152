"""Reported results: units, links to what was planned, links from result groups to arms, roles of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_id, folded_type, key, normalised, short_capitals, stem, stripped
from .dispersion import estimate_sd
from .matching import checked_broadcast, small

# The role that a registered arm's type gives, and the types that receive nothing active.
ROLES = {"experimental": "experimental", "active_comparator": "control", "placebo_comparator": "control", "sham_comparator": "control", "no_intervention": "control"}
INACTIVE = ("placebo_comparator", "sham_comparator", "no_intervention")
TRAILING_PARENTHETICAL = r"\s*\(([^()]*)\)\s*$"


def resolve_unit(units: DataFrame, synonyms: DataFrame, default: str = "not_stated") -> DataFrame:
    """unit_raw, scale_id, unit_method for the distinct units; synonyms: scale_id, synonym.

    The whole field first, then a closing parenthetical, then what stands before it; capitals of five
    characters at most keep their case. What only holds a synonym among other words is a syntactic match.
    """
    rules = synonyms.select("scale_id", "synonym", short_capitals(F.col("synonym")).alias("caps"))
    lookup = rules.select(F.when(F.col("caps"), F.col("synonym")).otherwise(F.lower("synonym")).alias("name"), "caps", "scale_id")
    lookup = checked_broadcast(lookup.groupBy("name", "caps").agg(F.min("scale_id").alias("scale_id")))
    text = normalised(F.col("unit_raw"))
    forms = units.select("unit_raw").distinct().withColumn("text", text)
    inner, before = F.regexp_extract("text", TRAILING_PARENTHETICAL, 1), F.regexp_replace("text", TRAILING_PARENTHETICAL, "")
    names = forms.select("unit_raw", F.posexplode(F.array("text", stripped(inner), stripped(before))).alias("at", "name"))
    cased = names.join(lookup.where("caps").select("name", "scale_id"), "name").withColumn("way", F.lit(0))
    plain = names.withColumn("name", F.lower("name")).join(lookup.where("not caps").select("name", "scale_id"), "name").withColumn("way", F.lit(1))
    exact = cased.unionByName(plain).where("name <> ''").groupBy("unit_raw").agg(F.min_by("scale_id", F.struct("at", "way", "scale_id")).alias("exact_id"))
    words = forms.select("unit_raw", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), 0))).alias("name"))
    inside = words.join(lookup.where("not caps").select("name", "scale_id"), "name").groupBy("unit_raw").agg(F.min_by("scale_id", F.struct((-F.length("name")).alias("n"), "scale_id")).alias("inside_id"))
    out = forms.join(exact, "unit_raw", "left").join(inside, "unit_raw", "left")
    method = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("inside_id").isNotNull(), "syntactic_rule")
    return out.select("unit_raw", F.coalesce("exact_id", "inside_id", F.lit(default)).alias("scale_id"), method.alias("unit_method"))


def to_canonical_unit(rows: DataFrame, scales: DataFrame, value: str, log_scale: Column | None = None) -> DataFrame:
    """Adds si_scale_id and si_value where the scale (id, si_equivalent, factor_to_si) has a factor; log-scale values stay."""
    out = rows.join(checked_broadcast(scales), "scale_id", "left")
    apply = F.col("factor_to_si").isNotNull() & F.col(value).isNotNull() & ~F.coalesce(log_scale if log_scale is not None else F.lit(False), F.lit(False))
    return out.withColumns({"si_value": F.when(apply, F.col(value) * F.col("factor_to_si")), "si_scale_id": F.when(apply, F.col("si_equivalent"))}).drop("factor_to_si", "si_equivalent")


def build_dispersion(measurements: DataFrame, synonyms: DataFrame, scales: DataFrame) -> DataFrame:
    """Measurements with their unit, standard deviation and a content id; of equal ids the row stays that is the largest by its values."""
    rows = measurements.withColumn("dispersion_id", content_id(*(F.col(c) for c in ("nct_id", "group_title", "class_title", "form_id", "param_type", "dispersion_type"))))
    return with_sd(one_of_each(rows, "dispersion_id", VALUES), synonyms, scales)


#: A measurement's values, in the order in which rows of one id are compared.
VALUES = ["param_value", "dispersion_value", "lower_limit", "upper_limit", "n"]


def one_of_each(rows: DataFrame, key: str, first: list[str]) -> DataFrame:
    """Of rows with the same key the largest by ``first`` and then by all other columns (null is least): a choice that no partitioning changes."""
    rest = [*first, *(c for c in rows.columns if c != key and c not in first)]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_kept")).select(key, "_kept.*")


def with_sd(rows: DataFrame, synonyms: DataFrame, scales: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Adds unit, standard deviation and canonical value.

    labels: param_type, dispersion_type and unit_raw of the rows, where a smaller table has them; they come to the rows, which don't move for them.
    """
    units = resolve_unit(rows, synonyms) if labels is None else checked_broadcast(small(resolve_unit(labels, synonyms)))
    rows = estimate_sd(rows, labels).join(units, "unit_raw", "left")
    return to_canonical_unit(rows, scales, "sd_value", F.col("sd_scale") == "log")


def result_titles(outcomes: DataFrame, baseline: DataFrame) -> DataFrame:
    """What is conformed of results: result_kind, result_id, endpoint_id and the columns that the conform job reads.

    outcomes: outcome_id, nct_id, outcome_type ('other' where null), title, time_frame, description, population; a row for each id. baseline:
    baseline_id, nct_id, title, description, population; a characteristic comes once, however many arms and classes report it, and has no
    time frame. ``endpoint_id`` is the id that the conform job gives the row; equal titles of a study share it.
    """
    columns = ["nct_id", "outcome_type", "measure", "time_frame", "description", "population"]
    none = F.lit(None).cast("string")
    of = lambda df, c: F.col(c) if c in df.columns else none.alias(c)
    mine = outcomes.select(F.lit("outcome").alias("result_kind"), F.col("outcome_id").alias("result_id"), "nct_id", F.coalesce("outcome_type", F.lit("other")).alias("outcome_type"), F.col("title").alias("measure"), "time_frame", of(outcomes, "description"), of(outcomes, "population"))
    first = baseline.groupBy("baseline_id").agg(F.min(F.struct("nct_id", "title", of(baseline, "description").alias("description"), of(baseline, "population").alias("population"))).alias("b"))
    theirs = first.select(F.lit("baseline"), "baseline_id", "b.nct_id", F.lit("other"), F.col("b.title"), none, "b.description", "b.population")
    both = mine.union(theirs)
    return both.select("result_kind", "result_id", content_id(*(F.col(c) for c in columns[:-1])).alias("endpoint_id"), *columns)


def result_rows(outcomes: DataFrame, groups: DataFrame, measurements: DataFrame, baseline: DataFrame) -> DataFrame:
    """One layout for the arm rows of reported outcomes and of baseline characteristics, one row for each dispersion_id.

    outcomes: outcome_id, param_type, dispersion_type, unit_of_measure. groups: outcome_id, group_key, title, n. measurements: outcome_id,
    nct_id, group_key, class_title, category_title, param_value_num, dispersion_value_num, dispersion_lower_limit, dispersion_upper_limit, n.
    baseline: the same with baseline_id, group_title and the outcome's columns. n is the row's own count, else its arm's; n_source says
    which ('measurement', 'outcome_group', 'baseline_row', null). An outcome's arms come to it as a map, so that its
    measurements move once. Rows of one id (source, arm, class, category) leave the largest by their values.
    """
    arm = groups.where("group_key is not null").groupBy("outcome_id", "group_key").agg(F.max("n").alias("n"), F.min("title").alias("title"))
    arms = arm.groupBy("outcome_id").agg(F.map_from_entries(F.collect_list(F.struct("group_key", F.struct("n", "title")))).alias("_arms"))
    of = outcomes.select("outcome_id", "param_type", "dispersion_type", F.col("unit_of_measure").alias("unit_raw")).join(arms, "outcome_id", "left")
    values = [F.col(f"{c}_num" if c.endswith("value") else f"dispersion_{c}").alias(c) for c in VALUES[:4]]
    place = ["nct_id", "group_key", "class_title", "category_title"]
    own = F.col("_arms")[F.col("group_key")]
    source = F.when(F.col("n").isNotNull(), "measurement").when(own["n"].isNotNull(), "outcome_group")
    mine = measurements.select("outcome_id", *place, *values, "n").join(of, "outcome_id")
    mine = mine.select(F.lit("outcome").alias("result_kind"), F.col("outcome_id").alias("result_id"), *place, own["title"].alias("group_title"), "param_type", "dispersion_type", "unit_raw", *VALUES[:4], F.coalesce("n", own["n"]).alias("n"), source.alias("n_source"))
    theirs = baseline.select(
        F.lit("baseline").alias("result_kind"), F.col("baseline_id").alias("result_id"), *place, "group_title", "param_type", "dispersion_type", F.col("unit_of_measure").alias("unit_raw"), *values, "n", F.when(F.col("n").isNotNull(), "baseline_row").alias("n_source")
    )
    rows = mine.unionByName(theirs)
    key = content_id(*(F.col(c) for c in ("result_kind", "result_id", "group_key", "class_title", "category_title")))
    return one_of_each(rows.withColumn("dispersion_id", key), "dispersion_id", VALUES)


def result_labels(outcomes: DataFrame, baseline: DataFrame) -> DataFrame:
    """param_type, dispersion_type and unit_raw of all :func:`result_rows`, from the tables that state them."""
    of = lambda df: df.select("param_type", "dispersion_type", F.col("unit_of_measure").alias("unit_raw"))
    return of(outcomes).union(of(baseline)).distinct()


def result_dispersion(rows: DataFrame, titles: DataFrame, endpoints: DataFrame, synonyms: DataFrame, scales: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The dispersion table: :func:`result_rows` with their SD and the endpoint that their title conformed to (null where it did not).

    titles: :func:`result_titles`. endpoints: the conform job's sink (endpoint_id, form_id, measurement_id, derivation_id, timepoint_pattern).
    Rows without an SD stay, as denominators. labels: :func:`result_labels`, where given the rows are moved for their endpoints only.
    """
    found = endpoints.select("endpoint_id", "form_id", "measurement_id", "derivation_id", F.col("timepoint_pattern").alias("timepoint_pattern_id"))
    named = titles.select("result_kind", "result_id", "endpoint_id").join(found, "endpoint_id", "left")
    return with_sd(rows, synonyms, scales, labels).join(named, ["result_kind", "result_id"], "left")


def link_reported_to_planned(reported: DataFrame, planned: DataFrame, unconformed: DataFrame) -> DataFrame:
    """Adds link_method, planned_id and form_agrees to reported outcomes.

    In turn: the same title in the study (the smallest planned id where several have it), a planned title that
    did not conform (no id), the same measurement and derivation in the study (null equals null).
    """
    r = reported.withColumn("_k", key(normalised(F.col("title"))))
    by_title = planned.select("nct_id", key(normalised(F.col("measure"))).alias("_k"), "endpoint_id", "form_id")
    by_title = by_title.where("_k is not null").groupBy("nct_id", "_k").agg(F.min(F.struct("endpoint_id", "form_id")).alias("_t"))
    loose = unconformed.select("nct_id", key(normalised(F.col("measure"))).alias("_k")).where("_k is not null").distinct().withColumn("_u", F.lit(True))
    by_measure = planned.groupBy("nct_id", "measurement_id", F.coalesce("derivation_id", F.lit("")).alias("_d")).agg(F.min(F.struct("endpoint_id", "form_id")).alias("_m"))
    out = r.withColumn("_d", F.coalesce("derivation_id", F.lit(""))).join(by_title, ["nct_id", "_k"], "left").join(loose, ["nct_id", "_k"], "left").join(by_measure, ["nct_id", "measurement_id", "_d"], "left")
    method = F.when(F.col("_t").isNotNull(), "exact_title").when(F.col("_u"), "unconformed_title").when(F.col("_m").isNotNull(), "measurement").otherwise("unlinked")
    hit = F.when(F.col("_t").isNotNull(), F.col("_t")).when(F.col("_u"), F.lit(None)).otherwise(F.col("_m"))
    return out.withColumns({"link_method": method, "planned_id": hit["endpoint_id"], "form_agrees": hit["form_id"] == F.col("form_id")}).drop("_k", "_d", "_t", "_u", "_m")


def link_group_to_arm(groups: DataFrame, arms: DataFrame) -> DataFrame:
    """nct_id, group_title, arm_title, arm_type, link_method, link_skip_reason for the distinct result groups.

    arms: nct_id, title, group_type. A title, or its stem, links where exactly one arm has it; the only arm of
    a study links to the only group of it.
    """
    g = groups.select("nct_id", "group_title").distinct().withColumn("k", key(F.col("group_title"))).withColumn("s", stem(F.col("k")))
    a = arms.where("title is not null").select("nct_id", F.col("title").alias("arm_title"), folded_type(F.col("group_type")).alias("arm_type"), key(F.col("title")).alias("k"))
    a = a.withColumn("s", stem(F.col("k")))
    arm = F.min(F.struct("arm_title", "arm_type"))
    exact = a.groupBy("nct_id", "k").agg(F.count(F.lit(1)).alias("n_exact"), arm.alias("exact"))
    stems = a.groupBy("nct_id", "s").agg(F.count(F.lit(1)).alias("n_stem"), arm.alias("stemmed"))
    studies = a.groupBy("nct_id").agg(F.count(F.lit(1)).alias("n_arms"), arm.alias("sole"))
    titles = g.where("k <> 'total'").groupBy("nct_id").agg(F.count_distinct("k").alias("n_titles"))
    out = g.join(exact, ["nct_id", "k"], "left").join(stems, ["nct_id", "s"], "left").join(studies, "nct_id", "left").join(titles, "nct_id", "left")
    skip = (
        F.when(F.col("k").isNull(), "no_group_title").when(F.col("n_arms").isNull(), "no_protocol_arms").when(F.col("k") == "total", "total_group")
        .when(F.col("n_exact") > 1, "ambiguous_title").when(F.col("n_exact") == 1, None).when(F.col("n_stem") > 1, "ambiguous_title").when(F.col("n_stem") == 1, None)
        .when((F.col("n_arms") == 1) & (F.col("n_titles") == 1), None).otherwise("no_title_match")
    )
    out = out.withColumn("link_skip_reason", skip)
    linked = F.col("link_skip_reason").isNull()
    method = F.when(F.col("n_exact") == 1, "exact_title").when(F.col("n_stem") == 1, "title_stem").otherwise("sole_arm")
    hit = F.when(F.col("n_exact") == 1, F.col("exact")).when(F.col("n_stem") == 1, F.col("stemmed")).otherwise(F.col("sole"))
    return out.select("nct_id", "group_title", F.when(linked, hit["arm_title"]).alias("arm_title"), F.when(linked, hit["arm_type"]).alias("arm_type"), F.when(linked, method).alias("link_method"), "link_skip_reason")


def arm_role(links: DataFrame, arm_classes: DataFrame) -> DataFrame:
    """Adds arm_role, role_source and role_conflict; arm_classes: nct_id, arm_title, kind."""
    kinds = arm_classes.groupBy("nct_id", "arm_title").agg(F.bool_and(F.col("kind") == "control").alias("all_control"), F.bool_or(F.col("kind") != "control").alias("any_active"))
    out = links.join(kinds, ["nct_id", "arm_title"], "left")
    typed = None
    for kind, role in ROLES.items():
        typed = F.when(F.col("arm_type") == kind, role) if typed is None else typed.when(F.col("arm_type") == kind, role)
    control = F.coalesce("all_control", F.lit(False))
    conflict = ((F.col("arm_type") == "experimental") & control) | (F.col("arm_type").isin(*INACTIVE) & F.coalesce("any_active", F.lit(False)))
    return out.withColumns({
        "arm_role": F.coalesce(typed, F.when(control, "control")),
        "role_source": F.when(typed.isNotNull(), "group_type").when(control, "drug_class"),
        "role_conflict": F.coalesce(conflict, F.lit(False)),
    }).drop("all_control", "any_active")


def gather_rows(outcomes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Reported outcomes, and one row for each baseline characteristic whatever its arms, which has no time frame.

    outcomes: outcome_id, nct_id, title, time_frame, unit_of_measure. baseline: baseline_id, nct_id, title, unit_of_measure.
    """
    first = baseline.groupBy("baseline_id").agg(F.min(F.struct("nct_id", "title", "unit_of_measure")).alias("b"))
    collapsed = first.select(F.lit("baseline").alias("result_kind"), F.col("baseline_id").alias("result_id"), "b.nct_id", "b.title", F.lit(None).cast("string").alias("time_frame"), "b.unit_of_measure")
    return outcomes.select(F.lit("outcome").alias("result_kind"), F.col("outcome_id").alias("result_id"), "nct_id", "title", "time_frame", "unit_of_measure").unionByName(collapsed)


def with_denominators(measurements: DataFrame, groups: DataFrame) -> DataFrame:
    """Measurements with n, their own or their group's, and n_source ('measurement', 'group' or null).

    groups: outcome_id, group_key, n.
    """
    of_group = groups.groupBy("outcome_id", "group_key").agg(F.max("n").alias("_group_n"))
    out = measurements.join(of_group, ["outcome_id", "group_key"], "left")
    source = F.when(F.col("n").isNotNull(), "measurement").when(F.col("_group_n").isNotNull(), "group")
    return out.withColumn("n_source", source).withColumn("n", F.coalesce("n", "_group_n")).drop("_group_n")
