"""Free text is tagged with the terms of a controlled vocabulary.

The jobs work on distinct texts (``text_id``, ``text``). A synonym's candidates come from an equi-join of the
texts' word n-grams with the synonyms', a pattern's from the literals that each of its matches contains
(:mod:`.literals`); only candidates meet the exact expression. Vocabulary tables are configuration of a few thousand
rows; :func:`checked_broadcast` broadcasts one only below a size bound, and :func:`small` makes one's size known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, short_capitals, stripped
from . import literals

#: Bytes, as Spark estimates them, up to which a vocabulary table is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20
#: Rows of a rule table that may be read into a plan: as literals or a local table, and by the index of patterns.
MOST_RULES, MOST_PATTERNS = 2_000, 100_000
# Words that say nothing about a term, and the confidence of each way of matching.
STOPWORDS = ("the", "of", "a", "an", "in", "at", "to", "for", "with", "and", "or", "from", "on", "is", "are", "by", "as", "this", "that", "was", "were")
CONFIDENCE = {"exact": 1.0, "named_endpoint": 0.9, "implied": 0.8, "syntactic_rule": 0.7, "semantic": 0.5}


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast where the optimizer's estimate of its size is in bounds; runs no job."""
    return F.broadcast(df) if known_size(df) <= most else df


def known_size(df: DataFrame) -> int:
    """Bytes, as the optimizer estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded(df: DataFrame, most: int = MOST_RULES) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules for one plan")
    return rows


def small(df: DataFrame, most: int = MOST_PATTERNS) -> DataFrame:
    """A table derived from rules, read once into a local table, whose size the optimizer knows; as it is where it has more rows."""
    rows = df.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= most else df


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """text_id and text of the distinct non-empty texts of a column."""
    texts = df.select(F.col(column).alias("text")).where(F.coalesce(F.col(column), F.lit("")) != "").distinct()
    return texts.select(F.md5("text").alias("text_id"), "text")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)


def _literal(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def synonym_pattern(synonym: Column) -> Column:
    """Whole tokens; inner white space matches white space or hyphens; short capitals keep their case."""
    tokens = F.transform(F.split(stripped(collapsed(synonym)), " "), _literal)
    body = F.concat(F.lit(r"(?<!\w)"), F.array_join(tokens, r"[\s\-]+"), F.lit(r"(?!\w)"))
    return F.when(short_capitals(synonym), F.concat(F.lit("(?U)"), body)).otherwise(F.concat(F.lit("(?iuU)"), body))


def tag_synonyms(texts: DataFrame, synonyms: DataFrame, least_length: int = 2) -> DataFrame:
    """text_id, term_id, matched_text, span, via: every synonym that a text holds as whole tokens.

    synonyms: term_id, synonym. Capitals shorter than ``least_length`` are left out.
    """
    usable = synonyms.where(~(short_capitals(F.col("synonym")) & (F.length("synonym") < least_length)))
    usable = usable.select("term_id", "synonym", synonym_pattern(F.col("synonym")).alias("pattern"), _words(F.col("synonym")).alias("w"))
    usable = usable.select("term_id", "synonym", "pattern", F.array_join("w", " ").alias("gram"), F.size("w").alias("n"))
    sizes = [r["n"] for r in usable.select("n").distinct().collect()]  # a handful of lengths
    words = texts.select("text_id", "text", _words(F.col("text")).alias("w"))
    lengths = sorted(n for n in sizes if n > 0) or [1]

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("w") - F.lit(n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))

    per_size = [F.when(F.size("w") >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    candidates = words.select("text_id", "text", F.explode(F.array_distinct(F.concat(*per_size))).alias("gram"))
    hits = candidates.join(checked_broadcast(usable.where("n > 0")), "gram").select("text_id", "text", "term_id", "synonym", "pattern")
    if 0 in sizes:  # synonyms without a word character are looked for as they are
        signs = checked_broadcast(usable.where("n = 0"))
        hits = hits.unionByName(texts.join(signs, F.col("text").contains(F.col("synonym"))).select("text_id", "text", "term_id", "synonym", "pattern"))
    found = hits.withColumn("matched_text", F.expr("regexp_substr(text, pattern)")).where("matched_text is not null")
    return found.select("text_id", "term_id", "matched_text", F.length("matched_text").alias("span"), F.lit("synonym").alias("via"))


def matching(texts: DataFrame, column: str, rules: DataFrame, pattern: str) -> DataFrame:
    """``texts`` with the columns of each rule whose pattern is found in the text, and ``matched_text``.

    Candidates are sorted by pattern within a partition, so that each is compiled once there and not for each pair.
    """
    patterns = [r[0] for r in bounded(rules.select(pattern).where(F.col(pattern).isNotNull()).distinct(), MOST_PATTERNS)]
    met = literals.candidates(texts, column, patterns).sortWithinPartitions("pattern")
    found = met.withColumn("matched_text", F.regexp_substr(F.col(column), F.concat(F.lit("(?iu)"), F.col("pattern")))).where("matched_text is not null")
    return found.join(checked_broadcast(rules.withColumnRenamed(pattern, "pattern")), "pattern").withColumnRenamed("pattern", pattern)


def tag_patterns(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, term_id, matched_text, span, via: every pattern (term_id, pattern) that a text matches."""
    found = matching(texts, "text", patterns.select("term_id", "pattern"), "pattern")
    return found.select("text_id", "term_id", "matched_text", F.length("matched_text").alias("span"), F.lit("pattern").alias("via"))


def apply_vetoes(hits: DataFrame, guards: DataFrame) -> DataFrame:
    """Hits without those whose term has a guard hit on the same text."""
    return hits.join(guards.select("text_id", "term_id").distinct(), ["text_id", "term_id"], "left_anti")


def pick_first(hits: DataFrame, precedence: DataFrame) -> DataFrame:
    """Of each text the term of the lowest rank; synonyms before patterns. Terms without a rank never match."""
    order = F.struct("rank", F.when(F.col("via") == "synonym", 0).otherwise(1).alias("how"), "matched_text")
    ranked = hits.join(checked_broadcast(precedence), "term_id")
    return ranked.groupBy("text_id").agg(F.min_by(F.struct("term_id", "matched_text", "span", "via"), order).alias("w")).select("text_id", "w.*")


def pick_longest(hits: DataFrame, file_order: DataFrame) -> DataFrame:
    """Of each text the longest match; ties go by the vocabulary's order, id, and synonyms before patterns."""
    placed = hits.join(checked_broadcast(file_order), "term_id", "left")
    order = F.struct((-F.col("span")).alias("s"), F.coalesce("ordinal", F.lit(1_000_000_000)).alias("o"), "term_id", F.when(F.col("via") == "synonym", 0).otherwise(1).alias("how"), "matched_text")
    return placed.groupBy("text_id").agg(F.min_by(F.struct("term_id", "matched_text", "span", "via"), order).alias("w")).select("text_id", "w.*")


def semantic_tokens(c: Column) -> Column:
    """The distinct tokens of three characters or more that are not stopwords."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS)))


def semantic_scores(texts: DataFrame, terms: DataFrame, least_score: float = 0.6, least_overlap: int = 2) -> DataFrame:
    """text_id, term_id, score: the term (term_id, vocabulary) that most of whose tokens a text holds."""
    tokens = terms.select("term_id", semantic_tokens(F.col("vocabulary")).alias("t")).where(F.size("t") > 0)
    index = tokens.select("term_id", F.size("t").alias("of"), F.explode("t").alias("token"))
    words = texts.select("text_id", F.explode(semantic_tokens(F.col("text"))).alias("token"))
    overlap = words.join(checked_broadcast(index), "token").groupBy("text_id", "term_id").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of"))
    scored = overlap.where(F.col("n") >= F.least(F.lit(least_overlap), F.col("of"))).withColumn("score", F.col("n") / F.col("of")).where(F.col("score") >= least_score)
    best = scored.groupBy("text_id").agg(F.min_by(F.struct("term_id", "score"), F.struct((-F.col("score")).alias("s"), "term_id")).alias("b"))
    return best.select("text_id", "b.*")


def cascade(rows: DataFrame, row_id: str, fields: list[tuple[str, str]], winners: dict[str, DataFrame], fallback: str | None) -> DataFrame:
    """row_id, term_id, match_method, confidence, source_field, matched_text.

    fields: (column, method) in order; winners: for each column the winner of each text. The first field with
    a winner decides.
    """
    out, found = rows, []
    for column, method in fields:
        w = winners[column].select(F.col("text_id").alias("_id"), F.struct("term_id", F.lit(method).alias("match_method"), F.lit(CONFIDENCE[method]).alias("confidence"), F.lit(column).alias("source_field"), "matched_text").alias(f"_w_{column}"))
        out = out.join(w, F.md5(F.col(column)) == F.col("_id"), "left").drop("_id")
        found.append(F.col(f"_w_{column}"))
    none = F.struct(F.lit(fallback).cast("string").alias("term_id"), F.lit(None).cast("string").alias("match_method"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source_field"), F.lit(None).cast("string").alias("matched_text"))
    return out.select(row_id, F.coalesce(*found, none).alias("w")).select(row_id, "w.*")
