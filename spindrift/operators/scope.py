"""Study scope: any of the values within a flag, all flags together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Scope:
    areas: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    organization: str | None = None
    phases: list[str] = field(default_factory=list)
    since: str | None = None


def split_ids(values: str) -> list[str]:
    """'a, b' -> ['a', 'b']."""
    return [v.strip() for v in values.split(",") if v.strip()]


def unknown_ids(requested: list[str], known: DataFrame, column: str) -> DataFrame:
    """The requested ids that a table does not have."""
    asked = known.sparkSession.createDataFrame([(v,) for v in requested], f"{column} string")
    return asked.join(known.select(column).distinct(), column, "left_anti")


def in_scope(studies: DataFrame, scope: Scope, study_ta: DataFrame, study_class: DataFrame) -> DataFrame:
    """The studies of a scope, by semi-joins to the bridges; an empty scope keeps all."""
    out = studies
    if scope.areas:
        out = out.join(study_ta.where(F.col("ta_id").isin(*scope.areas)), "nct_id", "left_semi")
    if scope.classes:
        out = out.join(study_class.where(F.col("class_id").isin(*scope.classes)), "nct_id", "left_semi")
    if scope.organization:
        out = out.where(F.lower("organization").contains(scope.organization.lower()))
    if scope.phases:
        out = out.where(F.col("phase").isin(*scope.phases))
    if scope.since:
        out = out.where(F.col("start_date") >= F.lit(scope.since).cast("date"))
    return out


def newest(studies: DataFrame, most: int) -> DataFrame:
    """The newest studies; filters come before the limit."""
    return studies.orderBy(F.col("start_date").desc_nulls_last(), "nct_id").limit(most)
