"""Queries on spread, effects and their denominators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import normal_quantile_sql
from ..operators import dispersion as d
from ..operators import reports, results
from .projections import Data
from .registry import query

UNIT_SYNONYMS = [("litre", "L"), ("litre", "liters"), ("litre", "litres"), ("millilitre", "mL"), ("millilitre", "milliliters"), ("score_points", "points on a scale"), ("score_points", "points"), ("percent", "percent"), ("percent", "%")]
SCALES = [("litre", "litre", 1.0), ("millilitre", "litre", 0.001), ("percent", "percent", 1.0)]
_SYNONYMS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in UNIT_SYNONYMS)
_SCALES_SQL = ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE))" for a, b, c in SCALES)


def unit_synonyms(data: Data) -> DataFrame:
    return data.spark.createDataFrame(UNIT_SYNONYMS, "scale_id string, synonym string")


def scales(data: Data) -> DataFrame:
    return data.spark.createDataFrame(SCALES, "scale_id string, si_equivalent string, factor_to_si double")


def dispersion(data: Data) -> DataFrame:
    """The dispersion table, written once for a folder: every report reads it."""
    return data.kept("dispersion", lambda: results.build_dispersion(data.view("p_measurements"), unit_synonyms(data), scales(data)))


def _case(folded: str, markers: list, otherwise: str, empty: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains('_' || {folded} || '_', '{m}')" for m in texts) + f" THEN '{kind}'" for kind, texts in markers)
    return f"CASE {empty} {whens} ELSE '{otherwise}' END"


def _folded(c: str) -> str:
    return f"trim(regexp_replace(lower(trim(coalesce({c}, ''))), '[^a-z0-9]+', '_', 'g'), '_')"


_NONE = ", ".join(f"'{x}'" for x in d.NO_DISPERSION)
_DISPERSION = _case("fd", d.DISPERSION, "unknown", f"WHEN fd IN ({_NONE}) THEN 'none'")
_PARAMETER = _case("fp", d.PARAMETER, "unknown", "WHEN fp = '' THEN 'unknown'")
_EFFECT = _case("fe", d.EFFECT, "other", "WHEN fe = '' THEN 'unknown'")
_MEANS = ", ".join(f"'{x}'" for x in d.MEAN_LIKE)

#: The chain of views that the oracle takes from measurements to standard deviations.
SD_VIEWS = {
    "o_folded": f"SELECT *, {_folded('dispersion_type')} AS fd, {_folded('param_type')} AS fp FROM p_measurements",
    "o_kinds": f"""SELECT *, {_DISPERSION} AS dispersion_kind, {_PARAMETER} AS param_kind,
      CASE WHEN contains(fd, 'confidence') OR regexp_matches(fd, '(^|_)ci($|_)') THEN TRY_CAST(replace(regexp_extract(fd, '(\\d{{2,3}}([._]\\d+)?)', 1), '_', '.') AS DOUBLE) END AS level0,
      abs(upper_limit - lower_limit) AS width FROM o_folded""",
    "o_levels": "SELECT *, CASE WHEN level0 > 50 AND level0 < 100 THEN level0 END AS confidence_percent, coalesce(width, abs(dispersion_value)) AS span FROM o_kinds",
    "o_reasons": f"""SELECT *, CASE WHEN param_kind = 'unknown' THEN 'param_type_unrecognised' WHEN param_kind NOT IN ({_MEANS}, 'median') THEN 'param_type_not_continuous'
      WHEN dispersion_kind = 'none' THEN 'no_dispersion_reported' WHEN dispersion_kind = 'unknown' THEN 'dispersion_type_unrecognised'
      WHEN dispersion_kind = 'coefficient_of_variation' THEN 'dispersion_type_unsupported'
      WHEN dispersion_kind IN ('standard_deviation', 'geometric_cv', 'standard_error') AND dispersion_value IS NULL THEN 'no_dispersion_value'
      WHEN dispersion_kind = 'confidence_interval' AND param_kind NOT IN ({_MEANS}) THEN 'confidence_interval_around_a_median'
      WHEN dispersion_kind = 'confidence_interval' AND width IS NULL OR dispersion_kind IN ('inter_quartile_range', 'full_range') AND span IS NULL THEN 'no_interval_limits'
      WHEN dispersion_kind IN ('standard_error', 'confidence_interval', 'inter_quartile_range', 'full_range') AND NOT coalesce(n >= 2, FALSE) THEN 'no_arm_n'
      WHEN dispersion_kind = 'confidence_interval' AND confidence_percent IS NULL THEN 'confidence_level_unstated' END AS sd_skip_reason FROM o_levels""",
    "o_sd": f"""SELECT *, CASE WHEN sd_skip_reason IS NOT NULL THEN NULL WHEN dispersion_kind = 'standard_deviation' THEN abs(dispersion_value)
      WHEN dispersion_kind = 'geometric_cv' THEN sqrt(ln(1 + dispersion_value / 100 * (dispersion_value / 100))) WHEN dispersion_kind = 'standard_error' THEN abs(dispersion_value) * sqrt(n)
      WHEN dispersion_kind = 'confidence_interval' THEN width * sqrt(n) / (2 * {normal_quantile_sql(d.LEVEL)})
      WHEN dispersion_kind = 'inter_quartile_range' THEN span / (2 * {normal_quantile_sql(d.WAN_QUARTILES)})
      ELSE span / (2 * {normal_quantile_sql(d.WAN_RANGE)}) END AS sd_value,
      CASE WHEN sd_skip_reason IS NOT NULL THEN NULL WHEN dispersion_kind = 'standard_deviation' THEN 'reported' ELSE 'from_' || dispersion_kind END AS sd_method,
      sd_skip_reason IS NULL AND dispersion_kind <> 'standard_deviation' AS sd_is_derived,
      sd_skip_reason IS NULL AND dispersion_kind IN ('inter_quartile_range', 'full_range') AS sd_is_approximate,
      CASE WHEN sd_skip_reason IS NULL AND dispersion_kind = 'geometric_cv' THEN 'log' ELSE 'arithmetic' END AS sd_scale FROM o_reasons""",
}
#: Units: what each distinct unit text of the test data stands for, by the rule in SQL.
UNIT_VIEWS = {
    "o_synonyms": f"SELECT scale_id, synonym, upper(synonym) = synonym AND lower(synonym) <> synonym AND length(synonym) <= 5 AS caps FROM (VALUES {_SYNONYMS_SQL}) v(scale_id, synonym)",
    "o_scales": f"SELECT * FROM (VALUES {_SCALES_SQL}) v(scale_id, si_equivalent, factor_to_si)",
    "o_names": r"""SELECT unit_raw, 0 AS pos, trim(unit_raw) AS name FROM (SELECT DISTINCT unit_raw FROM p_measurements) u
      UNION ALL SELECT unit_raw, 1, trim(regexp_extract(unit_raw, '\s*\(([^()]*)\)\s*$', 1)) FROM (SELECT DISTINCT unit_raw FROM p_measurements) u
      UNION ALL SELECT unit_raw, 2, trim(regexp_replace(unit_raw, '\s*\(([^()]*)\)\s*$', '')) FROM (SELECT DISTINCT unit_raw FROM p_measurements) u""",
    "o_exact": """SELECT unit_raw, arg_min(scale_id, (pos, CASE WHEN caps THEN 0 ELSE 1 END, scale_id)) AS exact_id FROM o_names JOIN o_synonyms
      ON name <> '' AND CASE WHEN caps THEN name = synonym ELSE lower(name) = lower(synonym) END GROUP BY unit_raw""",
    "o_inside": r"""SELECT unit_raw, arg_min(scale_id, (-length(synonym), scale_id)) AS inside_id FROM (SELECT DISTINCT unit_raw FROM p_measurements) u
      JOIN o_synonyms ON NOT caps AND list_contains(regexp_extract_all(lower(unit_raw), '\w+'), lower(synonym)) GROUP BY unit_raw""",
    "o_units": """SELECT u.unit_raw, coalesce(exact_id, inside_id, 'not_stated') AS scale_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN inside_id IS NOT NULL THEN 'syntactic_rule' END AS unit_method
      FROM (SELECT DISTINCT unit_raw FROM p_measurements) u LEFT JOIN o_exact e ON u.unit_raw = e.unit_raw LEFT JOIN o_inside i ON u.unit_raw = i.unit_raw""",
    "o_dispersion": """SELECT s.*, u.scale_id, u.unit_method, c.si_equivalent,
      CASE WHEN factor_to_si IS NOT NULL AND sd_scale <> 'log' THEN sd_value * factor_to_si END AS si_value,
      CASE WHEN factor_to_si IS NOT NULL AND sd_scale <> 'log' AND sd_value IS NOT NULL THEN c.si_equivalent END AS si_scale_id
      FROM o_sd s LEFT JOIN o_units u ON s.unit_raw = u.unit_raw LEFT JOIN o_scales c ON u.scale_id = c.scale_id""",
    "o_usable": """SELECT *, coalesce(si_scale_id, scale_id) AS unit_id, si_value IS NOT NULL AND si_scale_id <> scale_id AS is_converted, coalesce(si_value, sd_value) AS sd
      FROM o_dispersion WHERE sd_value IS NOT NULL""",
}
ALL = SD_VIEWS | UNIT_VIEWS
_Q = "quantile_cont({0}, 0.5) AS median, quantile_cont({0}, 0.25) AS q1, quantile_cont({0}, 0.75) AS q3, min({0}) AS low, max({0}) AS high"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_QROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("median", "q1", "q3", "low", "high"))
_DIST = f"SELECT form_id, derivation_id, unit_id, is_converted, sd_scale, count(DISTINCT nct_id) AS n_studies, count(*) AS n_arms, CAST(sum(n) AS BIGINT) AS participants, {_Q.format('sd')} FROM o_usable GROUP BY ALL"


@query(
    f"""SELECT g.form_id, g.derivation_id, unit_id, is_converted, sd_scale, n_studies, n_arms, participants, {_QROUND}, w.n_studies_of_form FROM ({_DIST}) g
    LEFT JOIN (SELECT form_id, derivation_id, count(DISTINCT nct_id) AS n_studies_of_form FROM p_measurements GROUP BY ALL) w
    ON g.form_id = w.form_id AND g.derivation_id IS NOT DISTINCT FROM w.derivation_id""",
    ALL,
)
def sd_distribution(data: Data) -> DataFrame:
    return _rounded(reports.sd_distribution(dispersion(data)), "median", "q1", "q3", "low", "high")


@query("SELECT dispersion_type, param_type, dispersion_kind, param_kind, confidence_percent, count(*) AS n FROM o_levels GROUP BY ALL", SD_VIEWS)
def classify_dispersion(data: Data) -> DataFrame:
    return d.classified(data.view("p_measurements")).groupBy("dispersion_type", "param_type", "dispersion_kind", "param_kind", "confidence_percent").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT nct_id, group_title, class_title, round(sd_value, 6) AS sd_value, sd_method, sd_is_derived, sd_is_approximate, sd_scale, sd_skip_reason FROM o_sd", SD_VIEWS)
def estimate_sd(data: Data) -> DataFrame:
    out = d.estimate_sd(data.view("p_measurements"))
    return out.select("nct_id", "group_title", "class_title", F.round("sd_value", 6).alias("sd_value"), "sd_method", "sd_is_derived", "sd_is_approximate", "sd_scale", "sd_skip_reason")


@query("SELECT unit_raw, scale_id, unit_method FROM o_units", ALL)
def resolve_unit(data: Data) -> DataFrame:
    return results.resolve_unit(data.view("p_measurements"), unit_synonyms(data))


@query("SELECT nct_id, group_title, class_title, scale_id, round(si_value, 6) AS si_value, si_scale_id FROM o_dispersion", ALL)
def to_canonical_unit(data: Data) -> DataFrame:
    return dispersion(data).select("nct_id", "group_title", "class_title", "scale_id", F.round("si_value", 6).alias("si_value"), "si_scale_id")


@query(
    "SELECT md5(nct_id || '|' || group_title || '|' || class_title || '|' || form_id || '|' || param_type || '|' || dispersion_type) AS dispersion_id, sd_method, scale_id, round(sd_value, 6) AS sd_value FROM o_dispersion",
    ALL,
)
def build_dispersion(data: Data) -> DataFrame:
    return dispersion(data).select("dispersion_id", "sd_method", "scale_id", F.round("sd_value", 6).alias("sd_value"))


@query("SELECT sd_skip_reason, count(*) AS n FROM o_sd WHERE sd_value IS NULL GROUP BY ALL", SD_VIEWS)
def sd_skip_reasons(data: Data) -> DataFrame:
    return dispersion(data).where("sd_value is null").groupBy("sd_skip_reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT form_id, derivation_id, count(DISTINCT nct_id) AS n_studies, grouping(form_id) = 1 AS is_total FROM p_measurements GROUP BY GROUPING SETS ((form_id, derivation_id), ())")
def sd_denominators(data: Data) -> DataFrame:
    return reports.sd_denominators(dispersion(data))


@query("SELECT sd_method, count(*) AS n, count(DISTINCT nct_id) AS studies FROM o_sd WHERE NOT sd_is_approximate AND sd_value IS NOT NULL GROUP BY ALL", SD_VIEWS)
def exclude_estimates(data: Data) -> DataFrame:
    return reports.exclude_estimates(dispersion(data)).where("sd_value is not null").groupBy("sd_method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nct_id").alias("studies"))


@query("SELECT form_id, coalesce(sd_method, 'none') AS sd_method, coalesce(timepoint_pattern_id, 'none') AS timepoint, count(*) AS n FROM o_sd GROUP BY ALL", SD_VIEWS)
def sd_histograms(data: Data) -> DataFrame:
    rows = dispersion(data).withColumn("timepoint", F.coalesce("timepoint_pattern_id", F.lit("none")))
    maps = reports.histogram(rows, ["form_id", "timepoint"], "sd_method", "methods")
    return maps.select("form_id", "timepoint", F.explode("methods").alias("sd_method", "n"))


_EFFECTS = {
    "o_scales": UNIT_VIEWS["o_scales"],
    "o_fe": f"SELECT *, {_folded('param_type')} AS fe FROM p_analyses",
    "o_effect": f"SELECT *, {_EFFECT} AS effect_kind FROM o_fe",
    "o_null": f"""SELECT *, CASE WHEN effect_kind IN ({', '.join(f"'{x}'" for x in d.RATIOS)}) THEN 1.0::DOUBLE WHEN effect_kind IN ({', '.join(f"'{x}'" for x in d.DIFFERENCES)}) THEN 0.0::DOUBLE END AS null_value FROM o_effect""",
    "o_si": """SELECT a.*, CASE WHEN factor_to_si IS NOT NULL AND coalesce(null_value, 0) <> 1 THEN param_value_num * factor_to_si ELSE param_value_num END AS effect,
      CASE WHEN factor_to_si IS NOT NULL AND coalesce(null_value, 0) <> 1 THEN si_equivalent ELSE a.scale_id END AS unit_id FROM o_null a LEFT JOIN o_scales c ON a.scale_id = c.scale_id""",
}


@query("SELECT param_type, effect_kind, null_value, count(*) AS n FROM o_null GROUP BY ALL", _EFFECTS)
def classify_effect(data: Data) -> DataFrame:
    return reports.analysis_effects(data.view("p_analyses"), scales(data)).groupBy("param_type", "effect_kind", "null_value").agg(F.count(F.lit(1)).alias("n"))


# Converted effects have seven decimals, so that many quantiles lie half way between two results: they are rounded as decimals, not as what the binary digits happen to be.
_QSETTLED = ", ".join(f"CAST(round(CAST({c} AS DECIMAL(38, 12)), 6) AS DOUBLE) AS {c}" for c in ("median", "q1", "q3", "low", "high"))


@query(
    f"SELECT effect_kind, derivation_id, unit_id, n_studies, n_analyses, null_value, {_QSETTLED} FROM (SELECT effect_kind, derivation_id, unit_id, count(DISTINCT nct_id) AS n_studies, count(*) AS n_analyses, max(null_value) AS null_value, {_Q.format('effect')} FROM o_si GROUP BY ALL) g",
    _EFFECTS,
)
def analysis_distribution(data: Data) -> DataFrame:
    found = reports.analysis_distribution(data.view("p_analyses"), scales(data))
    return found.withColumns({c: F.round(F.col(c).cast("decimal(38,12)"), 6).cast("double") for c in ("median", "q1", "q3", "low", "high")})


_P = r"'^\s*(<=|>=|<|>|=|≤|≥)?\s*((\d+)?\.?\d+([eE][+-]?\d+)?)\s*$'"


@query(
    f"""SELECT count(p_value) AS stated, count(*) FILTER (p IS NOT NULL AND s NOT IN ('<', '<=', '>', '>=')) AS exact, count(*) FILTER (p IS NOT NULL AND s IN ('<', '<=', '>', '>=')) AS censored,
    count(*) FILTER (p < 0.05 OR p <= 0.05 AND s IN ('<', '<=')) AS below_0_05
    FROM (SELECT p_value, regexp_extract(p_value, {_P}, 1) AS s, TRY_CAST(regexp_extract(p_value, {_P}, 2) AS DOUBLE) AS p FROM p_analyses) x"""
)
def p_value_summary(data: Data) -> DataFrame:
    return reports.p_value_summary(data.view("p_analyses"))


_M = f"'{reports.MARGIN.removeprefix('(?i)')}'"


@query(
    f"""SELECT nct_id, analysis_id, CASE WHEN one THEN CASE WHEN regexp_extract(t, {_M}, 1, 'i') = '-' THEN -num ELSE num END END AS margin,
    CASE WHEN one AND lower(u) NOT IN ({', '.join(f"'{x}'" for x in reports.NO_UNITS)}) AND u <> '' THEN u END AS margin_unit FROM (
      SELECT nct_id, analysis_id, ni_description AS t, len(regexp_extract_all(ni_description, {_M}, 0, 'i')) = 1 AS one, TRY_CAST(regexp_extract(ni_description, {_M}, 2, 'i') AS DOUBLE) AS num,
        regexp_extract(ni_description, {_M}, 3, 'i') AS u FROM p_analyses WHERE lower(non_inferiority) IN ('yes', 'true') OR contains(lower(ni_description), 'non-inferiority')) x"""
)
def ni_margins(data: Data) -> DataFrame:
    return reports.ni_margins(data.view("p_analyses"))


@query(
    f"""SELECT class_id, form_id, derivation_id, unit_id, is_converted, sd_scale, n_studies, n_arms, {_QROUND} FROM (
    SELECT class_id, form_id, derivation_id, unit_id, is_converted, sd_scale, count(DISTINCT u.nct_id) AS n_studies, count(*) AS n_arms, {_Q.format('sd')}
    FROM o_usable u JOIN (SELECT DISTINCT nct_id, class_id FROM p_study_class WHERE kind = 'pharmacologic') b ON u.nct_id = b.nct_id
    WHERE class_id IN (SELECT class_id FROM (SELECT DISTINCT m.nct_id, class_id FROM p_measurements m JOIN p_study_class c ON m.nct_id = c.nct_id WHERE kind = 'pharmacologic') k GROUP BY class_id ORDER BY count(*) DESC, class_id LIMIT 2)
    GROUP BY ALL) g""",
    ALL,
)
def stratify_by_drug_class(data: Data) -> DataFrame:
    bridge = data.view("p_study_class").where("kind = 'pharmacologic'")
    return _rounded(reports.stratified(dispersion(data), bridge, "class_id", 2), "median", "q1", "q3", "low", "high")


@query(
    """SELECT field, value, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value NULLS FIRST) AS r FROM (
      SELECT 'dispersion' AS field, dispersion_type AS value, dispersion_kind AS kind, count(*) AS n FROM o_levels GROUP BY dispersion_type, dispersion_kind
      UNION ALL SELECT 'param', param_type, param_kind, count(*) FROM o_levels GROUP BY param_type, param_kind) x) y WHERE r <= 4""",
    SD_VIEWS,
)
def enumeration_census(data: Data) -> DataFrame:
    return reports.census(d.classified(data.view("p_measurements")), {"dispersion": ("dispersion_type", "dispersion_kind"), "param": ("param_type", "param_kind")}, 4)


@query(
    """SELECT count(*) AS total, count(*) FILTER (scale_id <> 'not_stated') AS resolved, count(*) FILTER (si_scale_id IS NOT NULL) AS convertible, count(DISTINCT unit_raw) FILTER (scale_id = 'not_stated') AS unresolved_units FROM o_dispersion""",
    ALL,
)
def unit_coverage(data: Data) -> DataFrame:
    return dispersion(data).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("scale_id") != "not_stated").alias("resolved"), F.count_if(F.col("si_scale_id").isNotNull()).alias("convertible"),
        F.count_distinct(F.when(F.col("scale_id") == "not_stated", F.col("unit_raw"))).alias("unresolved_units"),
    )


@query("SELECT unit_raw, count(*) AS n, count(DISTINCT nct_id) AS studies FROM o_dispersion WHERE scale_id = 'not_stated' AND unit_raw IS NOT NULL GROUP BY unit_raw ORDER BY n DESC, unit_raw LIMIT 10", ALL)
def unresolved_units(data: Data) -> DataFrame:
    """The ten most frequent units that no scale has."""
    found = dispersion(data).where("scale_id = 'not_stated' and unit_raw is not null")
    return found.groupBy("unit_raw").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nct_id").alias("studies")).orderBy(F.desc("n"), "unit_raw").limit(10)


def sd_medians(sds: DataFrame) -> DataFrame:
    medians = reports.quantiles(sds, ["unit_id"], "sd", {"median": 0.5}).select(F.col("_k.unit_id").alias("unit"), F.round("median", 6).alias("median"))
    return sds.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).join(medians, F.col("unit_id").eqNullSafe(F.col("unit"))).drop("unit")


@query(
    f"""SELECT arm_role, form_id, derivation_id, unit_id, is_converted, sd_scale, n_studies, n_arms, {_QROUND} FROM (SELECT arm_role, form_id, derivation_id, unit_id, is_converted, sd_scale, count(DISTINCT u.nct_id) AS n_studies, count(*) AS n_arms, {_Q.format('sd')}
    FROM o_usable u JOIN (SELECT DISTINCT nct_id AS study, title, CASE group_type WHEN 'Experimental' THEN 'experimental' ELSE 'control' END AS arm_role FROM p_arms WHERE group_type IS NOT NULL) a ON u.nct_id = a.study AND u.group_title = a.title GROUP BY ALL) g""",
    ALL,
)
def stratify_by_arm_role(data: Data) -> DataFrame:
    arms = data.view("p_arms").select("nct_id", F.col("title").alias("arm_title"), results.folded_type(F.col("group_type")).alias("arm_type"))
    roles = results.arm_role(arms, arms.select("nct_id", "arm_title", F.lit("active").alias("kind")).limit(0))
    return _rounded(reports.stratified_by_role(dispersion(data), roles), "median", "q1", "q3", "low", "high")


@query(
    """SELECT nct_id, group_title, class_title, coalesce(n, g) AS n, CASE WHEN n IS NOT NULL THEN 'measurement' WHEN g IS NOT NULL THEN 'group' END AS n_source
    FROM p_measurements m LEFT JOIN (SELECT nct_id AS o, group_title AS k, max(n) AS g FROM p_measurements GROUP BY 1, 2) x ON m.nct_id = x.o AND m.group_title = x.k"""
)
def arm_denominators(data: Data) -> DataFrame:
    """Rows without a count of their own take their group's."""
    rows = data.view("p_measurements").withColumns({"outcome_id": F.col("nct_id"), "group_key": F.col("group_title")})
    out = results.with_denominators(rows, rows.select("outcome_id", "group_key", "n"))
    return out.select("nct_id", "group_title", "class_title", "n", "n_source")


_SIMPLE = {
    "sd_by_unit": ("SELECT unit_id, count(*) AS n, round(quantile_cont(sd, 0.5), 6) AS median FROM o_usable GROUP BY unit_id", lambda x: sd_medians(reports.usable_sds(x))),
    "sd_method_mix": ("SELECT form_id, sd_method, count(*) AS n FROM o_usable GROUP BY ALL", lambda x: reports.usable_sds(x).groupBy("form_id", "sd_method").agg(F.count(F.lit(1)).alias("n"))),
    "dense_endpoints": ("SELECT measurement_id, form_id, count(DISTINCT nct_id) AS studies, count(*) AS n FROM o_usable GROUP BY ALL HAVING count(*) >= 10", lambda x: reports.usable_sds(x).groupBy("measurement_id", "form_id").agg(F.count_distinct("nct_id").alias("studies"), F.count(F.lit(1)).alias("n")).where("n >= 10")),
}
for _name, (_sql, _build) in _SIMPLE.items():
    query(_sql, ALL, _name)(lambda data, build=_build: build(dispersion(data)))
