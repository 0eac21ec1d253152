"""Distributions, denominators, coverage and audits over conformed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import p_modifier, p_number
from .conforming import written
from .dispersion import effect_kind, null_value
from .matching import checked_broadcast

GROUP = ["form_id", "derivation_id", "unit_id", "is_converted", "sd_scale"]
# The pattern of a stated margin, and words that follow its number and are no unit.
MARGIN = r"(?i)margin[^0-9+\-]{0,24}([+-])?\s*(\d+(?:\.\d+)?)\s*(%|[A-Za-z/·µ]{1,12})?"
NO_UNITS = ("the", "of", "to", "and", "was", "is", "a", "in", "for")


QUARTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}
#: Into how many ranges of values a group is cut to find its quantiles.
RANGES = 64


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and the exact quantiles of each group, interpolated between neighbours; null values are left out.

    A group may hold most rows, so none is ever ordered in one task: equal values are counted first, the group is cut at
    approximate quantiles into ``RANGES`` ranges, the ranges' counts tell in which of them each wanted rank lies, and only
    those ranges are ordered, each for itself. How good the approximation is decides the sizes of the ranges, not the result;
    but the counts and the ranges must be of the same cuts, which come out otherwise each time that they are made: they are written.
    """
    return _quantiles(_counted(df, keys, value), at)


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """_k, _v, _n: each group's distinct values and how often they occur, written as they are read several times."""
    rows = df.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v"))
    return written(rows.agg(F.count(F.lit(1)).alias("_n")), "counted")


def _quantiles(counted: DataFrame, at: dict[str, float]) -> DataFrame:
    cuts = written(counted.groupBy("_k").agg(F.percentile_approx("_v", F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), F.lit(1000)).alias("_cuts")), "cuts")
    ranged = counted.join(cuts, "_k").select("_k", "_v", "_n", F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))).alias("_r"))
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    sizes = ranged.groupBy("_k", "_r").agg(F.sum("_n").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    totals = sizes.groupBy("_k").agg(F.sum("_size").alias("_all"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("_all") - 1)).alias("place")) for name, p in at.items()))
    ranks = totals.select("_k", F.explode(wanted).alias("w")).select("_k", "w.name", "w.place", F.explode(F.array_distinct(F.array(F.floor("w.place"), F.ceil("w.place")))).alias("rank"))
    spots = ranks.join(sizes, "_k").where("rank >= _before and rank < _before + _size").select("_k", "_r", "name", "place", "rank", (F.col("rank") - F.col("_before")).alias("inside"))
    running = Window.partitionBy("_k", "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    some = ranged.join(spots.select("_k", "_r").distinct(), ["_k", "_r"], "left_semi").withColumn("_from", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    found = some.join(spots, ["_k", "_r"]).where("inside >= _from and inside < _from + _n")
    weight = F.when(F.col("rank") == F.floor("place"), 1 - (F.col("place") - F.floor("place"))).otherwise(F.col("place") - F.floor("place"))
    each = found.groupBy("_k", "name").agg(F.sum(F.col("_v") * weight).alias("q"))
    return each.groupBy("_k").agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in at))


def with_quartiles(found: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A grouped result with the quartiles and the range of a column of the rows that it was grouped from."""
    counted = _counted(rows, keys, value)
    ends = counted.groupBy(F.col("_k").alias("_e")).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    out = found.withColumn("_g", F.struct(*keys)).join(_quantiles(counted, QUARTILES), F.col("_g") == F.col("_k"), "left").join(ends, F.col("_g") == F.col("_e"), "left")
    return out.drop("_g", "_k", "_e")


def usable_sds(dispersion: DataFrame) -> DataFrame:
    """Rows with an SD, in the canonical unit where there is one: unit_id, is_converted, sd."""
    return dispersion.where("sd_value is not null").withColumns({
        "unit_id": F.coalesce("si_scale_id", "scale_id"), "is_converted": F.col("si_value").isNotNull() & (F.col("si_scale_id") != F.col("scale_id")),
        "sd": F.coalesce("si_value", "sd_value"),
    })


def exclude_estimates(dispersion: DataFrame, approximate: bool = True, derived: bool = False) -> DataFrame:
    """Without rows whose SD is an approximation, or derived at all."""
    out = dispersion.where(~F.coalesce("sd_is_approximate", F.lit(False))) if approximate else dispersion
    return out.where(~F.coalesce("sd_is_derived", F.lit(False))) if derived else out


def sd_distribution(dispersion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each form, derivation, unit and scale (and ``by``): studies, arms, participants, quartiles, range and the denominator.

    The denominator counts the studies of the form and derivation with or without an SD.
    """
    keys = [*(by or []), *GROUP]
    sds = usable_sds(dispersion)
    found = sds.groupBy(*keys).agg(
        F.count_distinct("nct_id").alias("n_studies"), F.count(F.lit(1)).alias("n_arms"), F.sum("n").cast("long").alias("participants")
    )
    found = with_quartiles(found, sds, keys, "sd")
    whole = dispersion.groupBy("form_id", F.col("derivation_id").alias("_d")).agg(F.count_distinct("nct_id").alias("n_studies_of_form"))
    return found.join(whole, (found["form_id"] == whole["form_id"]) & found["derivation_id"].eqNullSafe(whole["_d"]), "left").drop(whole["form_id"]).drop("_d")


def selected(dispersion: DataFrame, measurement: str | None = None, form: str | None = None, derivation: str | None = None, roles: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """Rows of one endpoint and arm role; what is not given is not asked. The derivation 'none' stands for rows without one.

    roles: nct_id, arm_title, arm_role; a row's arm is its group_title.
    """
    out = dispersion
    for column, wanted in (("measurement_id", measurement), ("form_id", form), ("derivation_id", derivation)):
        if wanted is not None:
            out = out.where(F.col(column).isNull() if wanted == "none" else F.col(column) == wanted)
    if role is not None:
        of = roles.where(F.col("arm_role") == role).select(F.col("nct_id").alias("_study"), F.col("arm_title").alias("_arm")).distinct()
        out = out.join(of, (F.col("nct_id") == F.col("_study")) & (F.col("group_title") == F.col("_arm")), "left_semi")
    return out


def with_histograms(found: DataFrame, rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds to a grouped result a map from value to count for each of ``columns`` (name: column; null counts as 'none').

    All maps come from one pass: rows are counted by the values together, of which a group has few, and each map adds up its own.
    """
    values = [F.coalesce(F.col(c), F.lit("none")).alias(f"_{name}") for name, c in columns.items()]
    counts = rows.groupBy(F.struct(*keys).alias("_h"), *values).agg(F.count(F.lit(1)).alias("_n"))
    lists = counts.groupBy("_h").agg(F.collect_list(F.struct(*(f"_{name}" for name in columns), "_n")).alias("_all"))

    def tally(name: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform("_all", lambda x: x[f"_{name}"])))
        of = lambda v: F.aggregate(F.filter("_all", lambda x: x[f"_{name}"] == v), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
        return F.map_from_arrays(names, F.transform(names, of)).alias(name)

    maps = lists.select("_h", *(tally(name) for name in columns))
    return found.withColumn("_g", F.struct(*keys)).join(maps, F.col("_g") == F.col("_h"), "left").drop("_g", "_h")


def histogram(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A map value -> count for each group."""
    counts = df.groupBy(*keys, F.coalesce(F.col(value), F.lit("none")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias(name))


def sd_denominators(dispersion: DataFrame) -> DataFrame:
    """Distinct studies by form and derivation, and in all (is_total)."""
    spark = dispersion.sparkSession
    return spark.sql(
        "SELECT form_id, derivation_id, count(DISTINCT nct_id) AS n_studies, grouping(form_id) = 1 AS is_total FROM {d} GROUP BY GROUPING SETS ((form_id, derivation_id), ())",
        d=dispersion,
    )


def stratified(dispersion: DataFrame, bridge: DataFrame, member: str, top: int) -> DataFrame:
    """:func:`sd_distribution` for the ``top`` members of a study bridge with most studies, in one grouped pass."""
    counts = dispersion.select("nct_id").distinct().join(bridge.select("nct_id", member).distinct(), "nct_id").groupBy(member).agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.orderBy(F.desc("n"), member).limit(top).select(member)  # the top-k is the feature
    rows = dispersion.join(bridge.select("nct_id", member).distinct().join(F.broadcast(chosen), member), "nct_id")
    return _spread(usable_sds(rows), [member, *GROUP])


def _spread(sds: DataFrame, keys: list[str]) -> DataFrame:
    return with_quartiles(sds.groupBy(*keys).agg(F.count_distinct("nct_id").alias("n_studies"), F.count(F.lit(1)).alias("n_arms")), sds, keys, "sd")


def stratified_by_role(dispersion: DataFrame, roles: DataFrame) -> DataFrame:
    """:func:`sd_distribution` for experimental and control arms apart; arms without a role (roles: nct_id, arm_title, arm_role) are in neither."""
    known = roles.where(F.col("arm_role").isin("experimental", "control")).select("nct_id", F.col("arm_title").alias("group_title"), "arm_role").distinct()
    return _spread(usable_sds(dispersion.join(known, ["nct_id", "group_title"])), ["arm_role", *GROUP])


def analysis_effects(analyses: DataFrame, scales: DataFrame) -> DataFrame:
    """Adds effect_kind, null_value and effect (converted to the canonical unit unless it is a ratio)."""
    out = analyses.withColumn("effect_kind", effect_kind(F.col("param_type"))).withColumn("null_value", null_value(F.col("effect_kind")))
    out = out.join(checked_broadcast(scales), "scale_id", "left")
    apply = F.col("factor_to_si").isNotNull() & (F.coalesce("null_value", F.lit(0.0)) != 1.0)
    return out.withColumns({"effect": F.when(apply, F.col("param_value_num") * F.col("factor_to_si")).otherwise(F.col("param_value_num")), "unit_id": F.when(apply, F.col("si_equivalent")).otherwise(F.col("scale_id"))})


def analysis_distribution(analyses: DataFrame, scales: DataFrame) -> DataFrame:
    rows = analysis_effects(analyses, scales).where("effect is not null")
    keys = ["effect_kind", "derivation_id", "unit_id"]
    found = rows.groupBy(*keys).agg(F.count_distinct("nct_id").alias("n_studies"), F.count(F.lit(1)).alias("n_analyses"), F.max("null_value").alias("null_value"))
    return with_quartiles(found, rows, keys, "effect")


def p_value_summary(analyses: DataFrame) -> DataFrame:
    """How many p-values are stated, exact, censored, and below 0.05 (where a censored bound counts as below)."""
    p, sign = p_number(F.col("p_value")), p_modifier(F.col("p_value"))
    stated, censored = F.col("p_value").isNotNull(), F.coalesce(sign.isin("<", "<=", ">", ">=", "≤", "≥"), F.lit(False))
    below = F.coalesce((p < 0.05) | ((p <= 0.05) & sign.isin("<", "<=", "≤")), F.lit(False))
    return analyses.agg(
        F.count_if(stated).alias("stated"), F.count_if(p.isNotNull() & ~censored).alias("exact"), F.count_if(p.isNotNull() & censored).alias("censored"), F.count_if(below).alias("below_0_05")
    )


def ni_margins(analyses: DataFrame) -> DataFrame:
    """Non-inferiority analyses with the margin that their description states, where 'margin' introduces exactly one number."""
    text = F.col("ni_description")
    one = F.regexp_count(text, F.lit(MARGIN)) == 1
    number = F.regexp_extract(text, MARGIN, 2).try_cast("double")
    unit = F.nullif(F.regexp_extract(text, MARGIN, 3), F.lit(""))
    flagged, named = F.lower("non_inferiority").isin("yes", "true"), F.lower(text).contains("non-inferiority")
    rows = analyses.where(F.coalesce(flagged, F.lit(False)) | F.coalesce(named, F.lit(False)))
    return rows.select(
        "nct_id", "analysis_id",
        F.when(one, F.when(F.regexp_extract(text, MARGIN, 1) == "-", -number).otherwise(number)).alias("margin"),
        F.when(one & ~F.lower(unit).isin(*NO_UNITS), unit).alias("margin_unit"),
    )


def census(df: DataFrame, fields: dict[str, tuple[str, str]], top: int) -> DataFrame:
    """field, value, kind, n: the ``top`` values of each field (name -> value and kind columns)."""
    long = None
    for name, (value, kind) in fields.items():
        part = df.select(F.lit(name).alias("field"), F.col(value).alias("value"), F.col(kind).alias("kind"))
        long = part if long is None else long.unionByName(part)
    counts = long.groupBy("field", "value", "kind").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), F.col("value").asc_nulls_first())
    return counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def frequency_sample(df: DataFrame, fields: list[str], least: int, tail: int, seed: str) -> DataFrame:
    """field, value, n, in_tail: all trimmed values that occur ``least`` times, and a seeded sample of the rarer ones."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in fields))).alias("x")).select("x.*")
    counts = long.where("value is not null and value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field", F.col("n") >= least).orderBy(F.md5(F.concat("value", F.lit(f"|{seed}"))), "value")
    return counts.withColumn("_r", F.row_number().over(w)).where((F.col("n") >= least) | (F.col("_r") <= tail)).select("field", "value", "n", (F.col("n") < least).alias("in_tail"))


def review_backlog(queue: DataFrame, status: str = "pending", reason: str | None = None, most: int = 50) -> DataFrame:
    out = queue.where(F.col("status") == status)
    out = out.where(F.col("reason") == reason) if reason else out
    return out.orderBy("queued_at", "queue_id").limit(most)
