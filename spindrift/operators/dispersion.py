"""Reported spread becomes a standard deviation, or a stated reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import normal_quantile
from ..functions.text import first_of, folded
from .matching import checked_broadcast, small

# Kinds of spread and the texts that show them, in the order in which they are tried.
DISPERSION = [
    ("standard_error", ("standard_error", "std_error", "_se_", "_sem_")),
    ("standard_deviation", ("standard_deviation", "std_deviation", "_sd_", "stdev", "_std_")),
    ("confidence_interval", ("confidence_interval", "_ci_")),
    ("inter_quartile_range", ("inter_quartile", "interquartile", "_iqr_")),
    ("full_range", ("full_range", "range")),
    ("geometric_cv", ("geometric_coefficient_of_variation", "geometric_cv", "_gcv_")),
    ("coefficient_of_variation", ("coefficient_of_variation", "_cv_")),
]
NO_DISPERSION = ("", "not_applicable", "na", "n_a", "none", "not_reported")
# Kinds of parameter.
PARAMETER = [
    ("geometric_least_squares_mean", ("geometric_least_squares_mean", "geometric_ls_mean")),
    ("least_squares_mean", ("least_squares_mean", "_ls_mean_", "lsmean", "adjusted_mean")),
    ("geometric_mean", ("geometric_mean", "_gmt_", "_gmc_")),
    ("median", ("median",)),
    ("mean", ("mean", "average")),
    ("count_of_participants", ("count_of_participants", "number_of_participants")),
    ("count_of_units", ("count_of_units", "number_of_units", "count_of_events")),
    ("number", ("number", "count", "_n_")),
]
MEAN_LIKE = ("mean", "least_squares_mean", "geometric_mean", "geometric_least_squares_mean")
# Kinds of effect, and those whose null value is 1 or 0.
EFFECT = [
    ("hazard_ratio", ("hazard_ratio", "_hr_", "cox_proportional_hazard")),
    ("odds_ratio", ("odds_ratio", "_or_")),
    ("risk_ratio", ("risk_ratio", "relative_risk", "_rr_")),
    ("risk_difference", ("risk_difference", "_rd_")),
    ("rate_ratio", ("rate_ratio", "incidence_rate_ratio")),
    ("mean_difference", ("mean_difference", "difference_in_means")),
    ("median_difference", ("median_difference",)),
    ("slope", ("slope",)),
]
RATIOS = ("hazard_ratio", "odds_ratio", "risk_ratio", "rate_ratio")
DIFFERENCES = ("mean_difference", "median_difference", "risk_difference", "slope")

# The probabilities whose normal quantiles divide an interval, quartiles and a range (Wan et al., 2014).
LEVEL = "(1 - (1 - confidence_percent / 100) / 2)"
WAN_QUARTILES = "((0.75e0 * n - 0.125e0) / (n + 0.25e0))"
WAN_RANGE = "((n - 0.375e0) / (n + 0.25e0))"


def _padded(c: Column) -> Column:
    return F.concat(F.lit("_"), folded(c), F.lit("_"))


def dispersion_kind(c: Column) -> Column:
    return F.when(folded(c).isin(*NO_DISPERSION), "none").otherwise(first_of(_padded(c), DISPERSION, "unknown"))


def parameter_kind(c: Column) -> Column:
    return F.when(folded(c) == "", "unknown").otherwise(first_of(_padded(c), PARAMETER, "unknown"))


def effect_kind(c: Column) -> Column:
    return F.when(folded(c) == "", "unknown").otherwise(first_of(_padded(c), EFFECT, "other"))


def null_value(kind: Column) -> Column:
    return F.when(kind.isin(*RATIOS), 1.0).when(kind.isin(*DIFFERENCES), 0.0)


def confidence_level(c: Column) -> Column:
    """The percent that a confidence interval's label states, if it lies between 50 and 100."""
    label = folded(c)
    percent = F.replace(F.regexp_extract(label, r"(\d{2,3}([._]\d+)?)", 1), F.lit("_"), F.lit(".")).try_cast("double")
    stated = label.contains("confidence") | label.rlike("(^|_)ci($|_)")
    return F.when(stated & (percent > 50) & (percent < 100), percent)


def classified(df: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Adds param_kind, dispersion_kind and confidence_percent from param_type and dispersion_type.

    The distinct labels are classified and joined back: they are few, and later expressions then refer to
    columns instead of repeating the classification. ``labels`` holds those of the rows, and maybe others, where
    a smaller table than ``df`` has them: they are read first, so that the rows needn't move for them.
    """
    of = (df if labels is None else labels).select(F.col("param_type").alias("_p"), F.col("dispersion_type").alias("_d")).distinct()
    kinds = (of if labels is None else small(of)).select("_p", "_d", parameter_kind(F.col("_p")).alias("param_kind"), dispersion_kind(F.col("_d")).alias("dispersion_kind"), confidence_level(F.col("_d")).alias("confidence_percent"))
    kinds = kinds if labels is None else checked_broadcast(kinds)
    return df.join(kinds, df["param_type"].eqNullSafe(kinds["_p"]) & df["dispersion_type"].eqNullSafe(kinds["_d"])).drop("_p", "_d")


def estimate_sd(df: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Adds sd_value, sd_method, sd_is_derived, sd_is_approximate, sd_scale and sd_skip_reason; ``labels`` as in :func:`classified`.

    From param_type, dispersion_type, dispersion_value, lower_limit, upper_limit and n. Standard errors and
    intervals need n >= 2; quartiles and ranges go by Wan et al. (2014) and count as approximate.
    """
    df = classified(df, labels).withColumn("_width", F.abs(F.col("upper_limit") - F.col("lower_limit")))
    df = df.withColumn("_span", F.coalesce("_width", F.abs("dispersion_value")))
    kind, param, value, n = (F.col(c) for c in ("dispersion_kind", "param_kind", "dispersion_value", "n"))
    spans = kind.isin("inter_quartile_range", "full_range")
    needs_value = kind.isin("standard_deviation", "geometric_cv", "standard_error")
    interval = kind == "confidence_interval"
    reason = (
        F.when(param == "unknown", "param_type_unrecognised")
        .when(~param.isin(*MEAN_LIKE, "median"), "param_type_not_continuous")
        .when(kind == "none", "no_dispersion_reported")
        .when(kind == "unknown", "dispersion_type_unrecognised")
        .when(kind == "coefficient_of_variation", "dispersion_type_unsupported")
        .when(needs_value & value.isNull(), "no_dispersion_value")
        .when(interval & ~param.isin(*MEAN_LIKE), "confidence_interval_around_a_median")
        .when((interval & F.col("_width").isNull()) | (spans & F.col("_span").isNull()), "no_interval_limits")
        .when(kind.isin("standard_error", "confidence_interval", "inter_quartile_range", "full_range") & ~F.coalesce(n >= 2, F.lit(False)), "no_arm_n")
        .when(interval & F.col("confidence_percent").isNull(), "confidence_level_unstated")
    )
    df = df.withColumn("sd_skip_reason", reason)
    estimate = (
        F.when(kind == "standard_deviation", F.abs(value))
        .when(kind == "geometric_cv", F.sqrt(F.log(1 + value / 100 * (value / 100))))
        .when(kind == "standard_error", F.abs(value) * F.sqrt(n))
        .when(interval, F.col("_width") * F.sqrt(n) / (2 * normal_quantile(LEVEL)))
        .when(kind == "inter_quartile_range", F.col("_span") / (2 * normal_quantile(WAN_QUARTILES)))
        .when(kind == "full_range", F.col("_span") / (2 * normal_quantile(WAN_RANGE)))
    )
    usable = F.col("sd_skip_reason").isNull()
    method = F.when(kind == "standard_deviation", F.lit("reported")).otherwise(F.concat(F.lit("from_"), kind))
    return df.withColumns(
        {
            "sd_value": F.when(usable, estimate),
            "sd_method": F.when(usable, method),
            "sd_is_derived": usable & (kind != "standard_deviation"),
            "sd_is_approximate": usable & spans,
            "sd_scale": F.when(usable & (kind == "geometric_cv"), "log").otherwise("arithmetic"),
        }
    ).drop("_width", "_span")
