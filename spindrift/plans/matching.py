"""Queries that tag texts with vocabulary terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import numbers as n
from ..operators import matching as m
from .projections import Data
from .registry import query

SYNONYMS = [
    ("survival", "overall survival"), ("survival", "OS"), ("progression", "progression free survival"), ("adverse_events", "adverse events"), ("adverse_events", "AE"),
    ("fev1", "FEV1"), ("quality_of_life", "quality of life"), ("response", "response"), ("volume", "volume in litres"), ("widget", "small widget"), ("bolt", "bolt"), ("license", "under the"),
]
#: Patterns with a text that each match contains.
PATTERNS = [("change", r"change\s+from\s+baseline", "change"), ("proportion", r"\b(proportion|percentage)\s+of\b", ""), ("time_to", r"\btime\s+to\b", "time"), ("count", r"\bnumber\s+of\b", "number")]
GUARDS = [("survival", r"progression[\s\-]*free", ""), ("count", r"adverse", "adverse")]
PRECEDENCE = ["adverse_events", "progression", "survival", "change", "proportion", "time_to", "count", "fev1", "quality_of_life", "response", "volume"]
ORDER = ["fev1", "survival", "progression", "adverse_events", "quality_of_life", "response", "volume", "widget", "bolt", "license", "change", "proportion", "time_to", "count"]
LABELS = {"lung_function": "forced expiratory volume FEV1", "survival_time": "overall survival time", "safety": "adverse events", "widget_score": "small widget score", "life": "quality life total"}


def _values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


def _frame(data: Data, rows: list[tuple], schema: str) -> DataFrame:
    return data.spark.createDataFrame(rows, schema)


def outcome_texts(data: Data) -> DataFrame:
    out = data.view("p_outcomes").select(t.normalised(F.col("measure")).alias("measure"))
    return m.distinct_texts(out, "measure")


def synonyms(data: Data) -> DataFrame:
    return _frame(data, SYNONYMS, "term_id string, synonym string")


def patterns(data: Data, rows: list[tuple]) -> DataFrame:
    return _frame(data, rows, "term_id string, pattern string, literal string")


_PLAIN = "-" * len(t.DASHES) + "''" * len(t.SINGLE_QUOTES) + '"' * len(t.DOUBLE_QUOTES)
_NORM = (
    rf"regexp_replace(translate(trim(regexp_replace(measure, '[\s\x{{00a0}}]+', ' ', 'g')), '{t.DASHES}{t.SINGLE_QUOTES}{t.DOUBLE_QUOTES}', '{_PLAIN}'), "
    r"'\\([<>\[\]()*_`~\\])', '\1', 'g')"
)
TEXT_VIEWS = {
    "o_texts": f"SELECT md5(text) AS text_id, text FROM (SELECT DISTINCT {_NORM} AS text FROM p_outcomes) x WHERE text <> ''",
    "o_syn": _values(SYNONYMS, "term_id, synonym"),
    "o_pat": _values(PATTERNS, "term_id, pattern, literal"),
    "o_guard": _values(GUARDS, "term_id, pattern, literal"),
    "o_rank": _values([(x, i) for i, x in enumerate(PRECEDENCE)], "term_id, rank"),
    "o_order": _values([(x, i) for i, x in enumerate(ORDER)], "term_id, ordinal"),
    "o_caps": "SELECT *, upper(synonym) = synonym AND lower(synonym) <> synonym AND length(synonym) <= 5 AS caps, replace(synonym, ' ', '[\\s\\-]+') AS body FROM o_syn",
    "o_synhits": r"""SELECT text_id, term_id, matched_text, CAST(length(matched_text) AS INTEGER) AS span, 'synonym' AS via FROM (
      SELECT text_id, term_id, regexp_extract(text, '(^|[^0-9A-Za-z_])(' || body || ')($|[^0-9A-Za-z_])', 2, 'c') AS matched_text FROM o_texts, o_caps WHERE caps
      UNION ALL SELECT text_id, term_id, regexp_extract(text, '(^|[^0-9A-Za-z_])(' || body || ')($|[^0-9A-Za-z_])', 2, 'i') FROM o_texts, o_caps WHERE NOT caps) x WHERE matched_text <> ''""",
    "o_pathits": "SELECT text_id, term_id, regexp_extract(text, pattern, 0, 'i') AS matched_text, CAST(length(regexp_extract(text, pattern, 0, 'i')) AS INTEGER) AS span, 'pattern' AS via FROM o_texts, o_pat WHERE regexp_matches(text, pattern, 'i')",
    "o_vetoes": "SELECT DISTINCT text_id, term_id FROM o_texts, o_guard WHERE regexp_matches(text, pattern, 'i')",
    "o_hits": "SELECT * FROM (SELECT * FROM o_synhits UNION ALL SELECT * FROM o_pathits) h WHERE NOT EXISTS (SELECT 1 FROM o_vetoes v WHERE v.text_id = h.text_id AND v.term_id = h.term_id)",
}


def hits(data: Data) -> DataFrame:
    texts = outcome_texts(data)
    found = m.tag_synonyms(texts, synonyms(data)).unionByName(m.tag_patterns(texts, patterns(data, PATTERNS)))
    return m.apply_vetoes(found, m.tag_patterns(texts, patterns(data, GUARDS)))


def precedence(data: Data) -> DataFrame:
    return _frame(data, [(x, i) for i, x in enumerate(PRECEDENCE)], "term_id string, rank int")


def file_order(data: Data) -> DataFrame:
    return _frame(data, [(x, i) for i, x in enumerate(ORDER)], "term_id string, ordinal int")


@query("SELECT text_id, text FROM o_texts", TEXT_VIEWS)
def normalise_text(data: Data) -> DataFrame:
    return outcome_texts(data)


@query("SELECT text_id, term_id, matched_text, span, via FROM o_synhits", TEXT_VIEWS)
def tag_synonyms(data: Data) -> DataFrame:
    return m.tag_synonyms(outcome_texts(data), synonyms(data))


@query("SELECT text_id, term_id, matched_text, span, via FROM o_pathits", TEXT_VIEWS)
def tag_patterns(data: Data) -> DataFrame:
    return m.tag_patterns(outcome_texts(data), patterns(data, PATTERNS))


@query("SELECT text_id, term_id, via FROM o_hits", TEXT_VIEWS)
def apply_vetoes(data: Data) -> DataFrame:
    return hits(data).select("text_id", "term_id", "via")


@query("SELECT text_id, arg_min(term_id, (rank, via = 'pattern', matched_text)) AS term_id, arg_min(via, (rank, via = 'pattern', matched_text)) AS via FROM o_hits JOIN o_rank USING (term_id) GROUP BY text_id", TEXT_VIEWS)
def pick_first_by_precedence(data: Data) -> DataFrame:
    return m.pick_first(hits(data), precedence(data)).select("text_id", "term_id", "via")


@query(
    "SELECT text_id, arg_min(term_id, (-span, ordinal, term_id, via = 'pattern', matched_text)) AS term_id, max(span) AS span FROM o_hits LEFT JOIN o_order USING (term_id) GROUP BY text_id",
    TEXT_VIEWS,
)
def pick_longest(data: Data) -> DataFrame:
    return m.pick_longest(hits(data), file_order(data)).select("text_id", "term_id", "span")


_STOP = ", ".join(f"'{w}'" for w in m.STOPWORDS)
SEMANTIC_VIEWS = {
    "o_texts": TEXT_VIEWS["o_texts"],
    "o_labels": _values(list(LABELS.items()), "term_id, vocabulary"),
    "o_term": f"SELECT DISTINCT term_id, token FROM (SELECT term_id, unnest(regexp_extract_all(lower(vocabulary), '[a-z0-9]+')) AS token FROM o_labels) x WHERE length(token) >= 3 AND token NOT IN ({_STOP})",
    "o_word": f"SELECT DISTINCT text_id, token FROM (SELECT text_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM o_texts) x WHERE length(token) >= 3 AND token NOT IN ({_STOP})",
    "o_score": """SELECT w.text_id, t.term_id, count(*) AS n, any_value(s.of_n) AS of_n FROM o_word w JOIN o_term t USING (token)
      JOIN (SELECT term_id, count(*) AS of_n FROM o_term GROUP BY term_id) s ON s.term_id = t.term_id GROUP BY 1, 2""",
}


@query(
    "SELECT text_id, arg_min(term_id, (-score, term_id)) AS term_id, max(score) AS score FROM (SELECT text_id, term_id, CAST(n AS DOUBLE) / of_n AS score FROM o_score WHERE n >= least(2, of_n)) x WHERE score >= 0.6 GROUP BY text_id",
    SEMANTIC_VIEWS,
)
def semantic_fallback(data: Data) -> DataFrame:
    return m.semantic_scores(outcome_texts(data), _frame(data, list(LABELS.items()), "term_id string, vocabulary string"))


def resolved(data: Data) -> DataFrame:
    """Every outcome's term by measure, then by description; else not stated."""
    rows = data.view("p_outcomes").withColumn("measure", t.normalised(F.col("measure"))).withColumn("description", t.normalised(F.col("description")))
    winners = {}
    for column in ("measure", "description"):
        texts = m.distinct_texts(rows, column)
        found = m.tag_synonyms(texts, synonyms(data)).unionByName(m.tag_patterns(texts, patterns(data, PATTERNS)))
        winners[column] = m.pick_first(m.apply_vetoes(found, m.tag_patterns(texts, patterns(data, GUARDS))), precedence(data))
    return m.cascade(rows, "line_id", [("measure", "exact"), ("description", "syntactic_rule")], winners, "not_stated")


@query(
    f"""SELECT line_id, coalesce(w.term_id, 'not_stated') AS term_id, CASE WHEN w.term_id IS NOT NULL THEN 'exact' END AS match_method, CASE WHEN w.term_id IS NOT NULL THEN 1.0::DOUBLE END AS confidence
    FROM (SELECT line_id, {_NORM} AS text FROM p_outcomes) r LEFT JOIN (SELECT text_id, arg_min(term_id, (rank, via = 'pattern', matched_text)) AS term_id FROM o_hits JOIN o_rank USING (term_id) GROUP BY text_id) w ON md5(r.text) = w.text_id""",
    TEXT_VIEWS,
)
def cascade_match(data: Data) -> DataFrame:
    return resolved(data).select("line_id", "term_id", "match_method", "confidence")


@query("SELECT line_id, md5(nct_id || '|' || outcome_type || '|' || measure || '|' || time_frame || '|' || coalesce(description, '')) AS endpoint_id FROM p_outcomes")
def content_id(data: Data) -> DataFrame:
    return data.view("p_outcomes").select("line_id", t.content_id(*(F.col(c) for c in ("nct_id", "outcome_type", "measure", "time_frame", "description"))).alias("endpoint_id"))


@query(
    r"""SELECT analysis_id, CASE WHEN s <> '' THEN s END AS modifier, TRY_CAST(v AS DOUBLE) AS p FROM (SELECT analysis_id, regexp_extract(p_value, '^\s*(<=|>=|<|>|=|≤|≥)?\s*((\d+)?\.?\d+([eE][+-]?\d+)?)\s*$', 1) AS s,
    regexp_extract(p_value, '^\s*(<=|>=|<|>|=|≤|≥)?\s*((\d+)?\.?\d+([eE][+-]?\d+)?)\s*$', 2) AS v FROM p_analyses) x"""
)
def p_value_split(data: Data) -> DataFrame:
    return data.view("p_analyses").select("analysis_id", n.p_modifier(F.col("p_value")).alias("modifier"), n.p_number(F.col("p_value")).alias("p"))


@query("SELECT nct_id, CASE WHEN lower(trim(has_results_text)) IN ('yes', 'true', 't', 'y', '1') THEN TRUE WHEN lower(trim(has_results_text)) IN ('no', 'false', 'f', 'n', '0') THEN FALSE END AS has_results FROM p_studies")
def has_results_flag(data: Data) -> DataFrame:
    return data.view("p_studies").select("nct_id", n.truth(F.col("has_results_text")).alias("has_results"))


@query("SELECT lower(outcome_type) AS level, CASE lower(outcome_type) WHEN 'primary' THEN 1 WHEN 'secondary' THEN 2 ELSE 3 END AS rank, count(*) AS n FROM p_outcomes GROUP BY ALL".replace("lower(outcome_type) AS level", "CASE WHEN lower(outcome_type) = 'other' THEN 'exploratory' ELSE lower(outcome_type) END AS level"))
def outcome_level(data: Data) -> DataFrame:
    kind = F.lower("outcome_type")
    level = F.when(kind == "primary", "primary").when(kind == "secondary", "secondary").when(kind.isin("other", "exploratory"), "exploratory").otherwise(F.raise_error(F.concat(F.lit("unknown outcome type: "), kind)))
    rows = data.view("p_outcomes").select(level.alias("level"))
    return rows.groupBy("level", F.when(F.col("level") == "primary", 1).when(F.col("level") == "secondary", 2).otherwise(3).alias("rank")).agg(F.count(F.lit(1)).alias("n"))
