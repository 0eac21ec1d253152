"""Controlled vocabularies as tables: every rule that matching reads is a row, none is code.

A vocabulary is a folder with one table for each name of :data:`TABLES` (Parquet or JSON lines), or is flattened from
nested dimension documents (one JSON object for each dimension). It is configuration of a few thousand rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables and their columns. A term's key is (dimension, term_id).
TABLES = {
    "terms": "dimension string, term_id string, label string, ordinal int",
    "synonyms": "dimension string, term_id string, synonym string",
    "patterns": "dimension string, term_id string, pattern string, role string, ordinal int",
    "precedence": "dimension string, term_id string, rank int",
    "cascade": "dimension string, ordinal int, field string, match_method string, fallback string",
    "confidence": "match_method string, confidence double",
    "forms": "id string, direction_rule string, event_family boolean, expects_threshold boolean, analysable boolean",
    "form_pairs": "ordinal int, first string, second string",
    "measurements": "id string, default_direction string, event_polarity string, domain string, implies_event string, default_scale string, concept_id string",
    "events": "id string, polarity string",
    "event_parts": "event_id string, part_id string",
    "reference_forms": "reference_id string, form_id string, ordinal int",
    "named_endpoints": "id string, form_id string, event_id string, reference_id string, measurement_id string, citation string",
    "concepts": "id string, label string",
    "scales": "id string, kind string, si_equivalent string, factor_to_si double",
    "direction_by_area": "measurement_id string, ta_id string, direction_id string",
    "timepoint_patterns": "id string, priority int",
    "timepoint_words": "kind string, word string, value string",
    "timepoint_steps": "ordinal int, step string",
    "timepoint_choices": "ordinal int, otherwise string, prefer string, form_id string",
    "templates": "form_id string, ordinal int, unit string, literal string, field string",
    "template_defaults": "form_id string, reference_id string",
    "areas": "id string, parent_id string, precedence int",
    "area_rules": "layer string, key string, ta_id string, ordinal int",
    "classes": "id string, kind string, parent_id string, precedence int",
    "class_rules": "layer string, key string, class_id string, ordinal int",
}
#: What a nested dimension document holds; other fields of a term are read by the tables above.
DOCUMENT = (
    "dimension string, precedence array<string>, fallback string, cascade array<struct<field: string, match_method: string>>, "
    "terms array<struct<id: string, label: string, synonyms: array<string>, patterns: array<string>, not_if_matches: array<string>>>"
)


class Vocabulary:
    """The tables by name; those that are not given are empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"no vocabulary tables: {', '.join(sorted(unknown))}")
        self.spark, self._tables = spark, tables

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        return local(self.spark, [], TABLES[name])

    def of(self, name: str, dimension: str) -> DataFrame:
        """A table's rows of one dimension."""
        return self[name].where(F.col("dimension") == dimension).drop("dimension")


def from_rows(spark: SparkSession, rows: dict[str, list[tuple]]) -> Vocabulary:
    return Vocabulary(spark, {name: local(spark, r, TABLES[name]) for name, r in rows.items()})


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a local table: the optimizer knows its size, which it doesn't for one made of Python rows."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(fields)}))


def load(spark: SparkSession, folder: str, names: list[str], kind: str = "parquet") -> Vocabulary:
    """The named tables of a folder (``<folder>/<name>``), cast to their schemas; a missing column is null."""
    tables = {}
    for name in names:
        wanted = spark.createDataFrame([], TABLES[name]).schema
        found = spark.read.format(kind).load(f"{folder}/{name}")
        tables[name] = found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))
    return Vocabulary(spark, tables)


def save(vocabulary: Vocabulary, folder: str) -> None:
    for name in TABLES:
        vocabulary[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The nested dimension documents of a path, one JSON object in a file."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def flattened(documents: DataFrame) -> dict[str, DataFrame]:
    """The terms, synonyms, patterns, precedence and cascade tables of nested documents."""
    terms = documents.select("dimension", F.posexplode("terms").alias("ordinal", "t"))
    of_term = terms.select("dimension", F.col("t.id").alias("term_id"), "ordinal", "t.*")
    patterns = [
        of_term.select("dimension", "term_id", F.posexplode(F.col(column)).alias("ordinal", "pattern"), F.lit(role).alias("role"))
        for column, role in (("patterns", "match"), ("not_if_matches", "guard"))
    ]
    steps = documents.select("dimension", F.posexplode("cascade").alias("ordinal", "c")).select("dimension", "ordinal", "c.field", "c.match_method", F.lit(None).cast("string").alias("fallback"))
    last = documents.where("fallback is not null").select("dimension", F.coalesce(F.size("cascade"), F.lit(0)).alias("ordinal"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("match_method"), "fallback")
    return {
        "terms": of_term.select("dimension", "term_id", "label", "ordinal"),
        "synonyms": of_term.select("dimension", "term_id", F.explode("synonyms").alias("synonym")),
        "patterns": patterns[0].unionByName(patterns[1]).select("dimension", "term_id", "pattern", "role", "ordinal"),
        "precedence": documents.select("dimension", F.posexplode("precedence").alias("rank", "term_id")).select("dimension", "term_id", "rank"),
        "cascade": steps.unionByName(last),
    }
