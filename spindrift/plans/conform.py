"""The vocabulary that the queries conform outcomes to, the outcomes, and the queries of the conform job's steps.

The expected rows are stated apart from the operators: by hand for time frames and thresholds (of each shape of text),
and as SQL over nested loops of rules and texts for the rest.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import conforming, timepoints
from ..sources.vocabulary import Vocabulary, from_rows
from .matching import _STOP, _values
from .projections import ONCE, VIEWS, Data
from .registry import query

UNIT = "(?:minute|hour|day|night|week|month|year)"
#: Time frame patterns: (term, priority, guards, patterns), for the shapes of FRAME_SHAPES.
FRAMES = [
    ("event_driven", 10, [], [r"\bas long as it takes\b(?:\D*(?P<estimated_max_value>\d+) (?P<estimated_max_unit>%U))?", r"\buntil (?:relapse|withdrawal)\b"]),
    ("visit_window", 20, [], [r"(?P<unit>%U) (?P<value>\d+) ?± ?(?P<window_pm>\d+)", r"(?P<window_pm2>\d+) %Us? either side of (?P<unit2>%U) (?P<value2>\d+)"]),
    ("multi_timepoint", 35, [], [r"\beach of (?P<unit>%U)s? (?P<values>\d+(?:, \d+)* and \d+)", r"(?P<unit2>%U) \d+[,;] ?%U \d+"]),
    ("baseline_to_timepoint", 40, [], [r"^from (?:entry|baseline|screening) (?:up )?to (?P<unit>%U) (?P<value>\d+)", r"(?P<value2>\d+) (?P<unit2>%U)s? after (?:entry|baseline)$"]),
    ("anchored_offset", 45, [r"\bas late as\b"], [r"(?P<value>\d+) (?P<unit>%U)s? (?:after|past|since) (?P<anchor>\w+)$"]),
    ("single_fixed", 50, [], [r"^(?:(?:on|in) (?:the )?)?(?P<unit>%U) (?P<value>\d+)$"]),
    ("bare_duration", 60, [], [r"^(?:(?P<approximate>roughly|some) )?(?P<value>\d+) (?P<unit>%U)s?$"]),
    ("cumulative_window", 70, [], [r"\b(?:until|as late as|all through) (?P<end_value>\d+) (?P<end_unit>%U)s?", r"\b(?:until|as late as|all through) (?P<end_unit2>%U) (?P<end_value2>\d+)"]),
    ("event_relative", 80, [], [r"^(?:during|at) (?P<anchor>surgery|delivery|dialysis)$", r"^(?P<anchor2>end of treatment)$"]),
    ("baseline_only", 90, [], [r"^(?:on entry|baseline)$"]),
]
FRAMES = [(name, priority, guards, [p.replace("%U", UNIT) for p in patterns]) for name, priority, guards, patterns in FRAMES]
WORDS = {
    "unit": [(w, w) for x in ("minute", "hour", "day", "night", "week", "month", "year") for w in (x, f"{x}s")],
    "numeral": [("two", "2"), ("four", "4"), ("twenty-four", "24"), ("twelve", "12")],
    "typo": [("basline", "baseline")],
    "abbreviation": [("wk", "week"), ("wks", "weeks"), ("mos", "months"), ("eot", "end of treatment"), ("upto", "up to")],
}
STEPS = [
    "drop_uninformative_parentheticals", "split_hyphenated_units", "normalise_ordinal_timepoints", "collapse_whitespace", "normalise_unicode_dashes", "normalise_plus_minus",
    "normalise_list_separators", "strip_trailing_punctuation", "expand_numeral_words", "expand_abbreviations", "match_case_insensitively",
]
#: The terms of each dimension, in order: label, synonyms, patterns, guards.
TERMS = {
    "measurement": [
        ("lung_function", "Forced expiratory volume", ["FEV1", "forced expiratory volume"], [], []), ("adverse_events", "Adverse events", ["adverse events", "AE"], [], []),
        ("survival", "Survival", ["overall survival", "OS", "survival"], [], [r"progression[- ]*free"]), ("response", "Response", ["response"], [r"PASI\s?\d+"], []),
        ("body_weight", "Body weight", ["body weight"], [], []), ("pain", "Pain intensity", ["pain score"], [], []), ("quality_of_life", "Quality life index", ["QoL"], [], []),
        ("hospital_stay", "Hospital stay", [], [r"hospitali[sz]ation"], []), ("volume", "Volume", ["volume"], [], []), ("exposure", "Exposure", ["Cmax"], [], []),
    ],
    "form": [
        ("change_from_baseline", "Change", [], [r"change\s+from\s+baseline"], []), ("responder_proportion", "Responders", [], [r"\b(?:proportion|percentage)\s+of\b"], []),
        ("incidence_proportion", "Incidence", [], [r"\b(?:proportion|percentage)\s+of\b", r"\bincidence\b"], []), ("time_to_event", "Time to event", [], [r"\btime\s+to\b"], []),
        ("event_count", "Count", [], [r"\bnumber\s+of\b"], [r"number\s+of\s+days"]), ("concentration", "Concentration", ["Cmax"], [], []), ("mean_value", "Mean", ["mean"], [], []),
    ],
    "event": [("death", "Death", ["death"], [], []), ("progression", "Progression", ["disease progression"], [], []), ("recovery", "Recovery", ["recovery"], [], []), ("adverse_event", "Adverse event", ["adverse events"], [], [])],
    "reference": [("from_randomisation", "Randomisation", [], [r"randomi[sz]ation"], []), ("from_baseline", "Baseline", ["baseline"], [], [])],
    "derivation": [("percent", "Percent", ["percent"], [], []), ("maximum", "Maximum", [], [r"\b(?:maximum|peak)\b"], [])],
    "named_endpoint": [("pfs", "Progression-free survival", ["PFS", "progression free survival"], [], []), ("orr", "Objective response", ["ORR"], [], [])],
    "polarity_cue": [("benefit", "", [], [r"recovery", r"improvement"], []), ("harm", "", [], [r"death", r"hospitali[sz]ation", r"worsening"], [])],
}
PRECEDENCE = {
    "form": ["time_to_event", "change_from_baseline", "responder_proportion", "incidence_proportion", "event_count", "concentration", "mean_value"],
    "polarity_cue": ["benefit", "harm"],
}
CASCADE = {
    "measurement": ([("measure", "exact"), ("description", "syntactic_rule")], "review_queue"), "form": ([("measure", "exact"), ("description", "syntactic_rule"), ("time_frame", "implied")], "not_stated"),
    "event": ([("measure", "exact"), ("description", "syntactic_rule")], "not_stated"), "reference": ([("time_frame", "exact"), ("measure", "syntactic_rule")], "not_stated"),
    "derivation": ([("measure", "exact"), ("description", "syntactic_rule")], "none"), "named_endpoint": ([("measure", "exact"), ("description", "exact")], "none"), "timepoint": ([], "unspecified"),
}
TABLE_ROWS: dict[str, list[tuple]] = {
    "terms": [(d, x[0], x[1], n) for d, terms in TERMS.items() for n, x in enumerate(terms)],
    "synonyms": [(d, x[0], s) for d, terms in TERMS.items() for x in terms for s in x[2]],
    "patterns": [(d, x[0], p, role, n) for d, terms in TERMS.items() for x in terms for role, of in (("match", x[3]), ("guard", x[4])) for n, p in enumerate(of)]
    + [("timepoint", x[0], p, role, n) for x in FRAMES for role, of in (("match", x[3]), ("guard", x[2])) for n, p in enumerate(of)],
    "precedence": [(d, x, n) for d, terms in PRECEDENCE.items() for n, x in enumerate(terms)],
    "cascade": [(d, n, f, m, None) for d, (steps, _) in CASCADE.items() for n, (f, m) in enumerate(steps)] + [(d, 99, None, None, last) for d, (_, last) in CASCADE.items()],
    "confidence": [("exact", 1.0), ("named_endpoint", 0.9), ("implied", 0.8), ("syntactic_rule", 0.7), ("semantic", 0.5)],
    "forms": [
        ("change_from_baseline", "inherit_measurement", False, False, True), ("responder_proportion", "higher_count_better", False, True, True), ("incidence_proportion", "inherit_event_polarity", False, True, True),
        ("time_to_event", "time_polarity", True, False, True), ("event_count", "inherit_event_polarity", True, False, True), ("concentration", "neutral", False, False, False), ("mean_value", "inherit_measurement", False, False, True),
    ],
    "form_pairs": [(0, "responder_proportion", "incidence_proportion")],
    "measurements": [
        ("lung_function", "increase_is_better", "benefit", "efficacy", None, "litre", "breathing"), ("adverse_events", None, "harm", "safety", "adverse_event", "count", "harms"), ("survival", None, None, "efficacy", "death", "month", "life"),
        ("response", "increase_is_better", "benefit", "efficacy", None, "percent", "life"), ("body_weight", "decrease_is_better", None, "efficacy", None, "kilogram", "body"), ("pain", "decrease_is_better", "harm", "efficacy", None, "points", "feeling"),
        ("quality_of_life", "increase_is_better", None, "efficacy", None, "points", "feeling"), ("hospital_stay", None, "harm", "efficacy", None, "day", "harms"), ("volume", None, None, "efficacy", None, "litre", "breathing"), ("exposure", None, None, "pk", None, None, "drug"),
    ],
    "events": [("death", "harm"), ("progression", "harm"), ("recovery", "benefit"), ("adverse_event", "harm")],
    "event_parts": [("progression", "death")],
    "reference_forms": [("from_baseline", "change_from_baseline", 0), ("from_baseline", "mean_value", 1), ("from_randomisation", "time_to_event", 0)],
    "named_endpoints": [("pfs", "time_to_event", "progression", "from_randomisation", "survival", "a guideline"), ("orr", "responder_proportion", None, None, "response", "a guideline")],
    "concepts": [(x, x) for x in ("breathing", "harms", "life", "body", "feeling", "drug")],
    "scales": [("litre", "volume", "litre", 1.0), ("millilitre", "volume", "litre", 0.001), ("day", "time", "day", 1.0), ("month", "time", "day", 30.4375), ("kilogram", "mass", "kilogram", 1.0), ("percent", "ratio", None, None), ("points", "score", None, None), ("count", "count", None, None)],
    "direction_by_area": [("body_weight", "furniture", "increase_is_better")],
    "timepoint_patterns": [(x[0], x[1]) for x in FRAMES],
    "timepoint_words": [(kind, a, b) for kind, pairs in WORDS.items() for a, b in pairs],
    "timepoint_steps": list(enumerate(STEPS)),
    "timepoint_choices": [(0, "baseline_to_timepoint", "cumulative_window", "responder_proportion"), (1, "baseline_to_timepoint", "cumulative_window", "event_count")],
}

#: Shapes of measures by number, with {p} for the part's name: the measure, the description, and the threshold that is stated for forms that expect one.
SHAPES = [
    ("Change from baseline in FEV1 of the {p}", None, None), ("Proportion of participants with {p} response of at least 75%", None, (">=", 75.0, "%")), ("Proportion of participants with adverse events: {p}", None, (None, None, None)),
    ("Time to first {p} recovery", None, None), ("Overall  Survival (OS)", None, None), ("Progression-free survival", None, None), ("PFS by {p}", "Time to disease progression", None), ("Number of adverse events: {p}", None, None),
    ("Mean body weight ({p})", None, None), ("Maximum pain score with {p}", None, None), ("Life and quality index of {p}", None, None), ("Percent change from baseline in volume", "{p}", None),
    ("Time to hospitalization after {p}", None, None), ("{p} of unknown kind", None, None), ("", "Incidence of pain score above 4 points", (">", 4.0, "points")), ("Cmax of the {p}", None, None),
    ("ORR of {p}", None, (None, None, None)), ("Number of days with {p} and pain score", None, None), ("PASI75 response, percentage of all", None, (">=", 75.0, "%")), ("Time to death or {p}", "Overall survival", None),
    ("{p} worsening", "Number of hospitalisations", None), ("FEV1", "{p}", None), ("Quality of the {p}", None, None), ("volume of \\(total\\) {p}", "mean of visits", None),
]
#: Shapes of time frames, with {q} for a number: the text, and what it is read as.
FRAME_SHAPES = [
    ("From baseline to week {q}", "baseline_to_timepoint", {"unit": "week", "value": "{q}"}), ("All through month {q}", "cumulative_window", {"end_unit": "month", "end_value": "{q}"}), ("On the {q}th day", "single_fixed", {"unit": "day", "value": "{q}"}),
    ("Night-{q}", "single_fixed", {"unit": "Night", "value": "{q}"}), ("roughly {q} years", "bare_duration", {"approximate": "roughly", "value": "{q}", "unit": "year"}), ("Each of days 2, 9 and {q}", "multi_timepoint", {"unit": "day", "values": "2, 9 and {q}"}),
    ("{q} hours past randomisation", "anchored_offset", {"unit": "hour", "value": "{q}", "anchor": "randomisation"}), ("Month 6 +/- {q} days", "visit_window", {"unit": "Month", "value": "6", "window_pm": "{q}"}), ("During delivery", "event_relative", {"anchor": "delivery"}),
    ("At surgery.", "event_relative", {"anchor": "surgery"}), ("basline", "baseline_only", None), ("Day 1 (arrival) until day {q} (leaving)", "cumulative_window", {"end_unit": "day", "end_value": "{q}"}),
    ("As long as it takes, {q} years at most", "event_driven", {"estimated_max_value": "{q}", "estimated_max_unit": "year"}), ("day 3、day {q}", "multi_timepoint", {"unit": "day"}), ("until {q} mos", "cumulative_window", {"end_value": "{q}", "end_unit": "month"}),
    ("EOT", "event_relative", {"anchor": "end of treatment"}), ("From baseline up to week {q}", "baseline_to_timepoint", {"unit": "week", "value": "{q}"}), ("In week twelve", "single_fixed", {"unit": "week", "value": "12"}),
    ("some {q} minutes", "bare_duration", {"approximate": "some", "value": "{q}", "unit": "minute"}), ("whenever it happens", "unspecified", None), ("From screening \u2013 day {q}", "unspecified", None), ("{q} days either side of month 3", "visit_window", {"window_pm": "{q}", "unit": "month", "value": "3"}),
]


def _case(of: str, texts: list[str | None]) -> str:
    """A CASE over a shape's number, with the part's name and the quantity put in."""
    def lit(x: str | None) -> str:
        if x is None:
            return "NULL"
        parts = [f"'{p.replace(chr(39), chr(39) * 2)}'" if p not in ("{p}", "{q}") else ("p_name" if p == "{p}" else "q") for p in re.split(r"(\{p\}|\{q\})", x) if p]
        return " || ".join(p.replace("\\", "' || chr(92) || '") for p in parts) or "''"

    return f"CASE {of} " + " ".join(f"WHEN {n} THEN {lit(x)}" for n, x in enumerate(texts)) + " END"


VIEWS["d_outcomes"] = f"""
SELECT nct_id, outcome_type, {_case('k', [s[0] for s in SHAPES])} AS measure, {_case('j', [f[0] for f in FRAME_SHAPES])} AS time_frame, {_case('k', [s[1] for s in SHAPES])} AS description,
  CASE WHEN q > 40 THEN 'adults' END AS population, k, j, q FROM (
  SELECT DISTINCT 'NCT' || lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0') AS nct_id, CASE WHEN l_linenumber = 1 THEN 'primary' WHEN l_linenumber <= 3 THEN 'secondary' ELSE 'other' END AS outcome_type,
    p_name, (l_partkey * 7 + l_linenumber) % {len(SHAPES)} AS k, (l_suppkey + l_linenumber) % {len(FRAME_SHAPES)} AS j, CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) AS q, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey) x""".replace("WHEN q > 40", "WHEN CAST(q AS INT) > 40")


def vocabulary(data: Data) -> Vocabulary:
    return from_rows(data.spark, TABLE_ROWS)


def outcomes(data: Data) -> DataFrame:
    return data.view("d_outcomes")


def conform(data: Data, name: str, rows: DataFrame) -> DataFrame:
    """The conform job over ``rows``, whose tables are written once under ``name`` for a state of the folder."""
    keep = lambda part, build: data.kept(f"{name}-{part}", build)
    return conforming.conformed(rows, vocabulary(data), data.view("p_studies"), data.view("p_study_ta"), keep)


def conformed(data: Data) -> DataFrame:
    return conform(data, "conformed", outcomes(data))


def endpoints(data: Data) -> DataFrame:
    return conforming.endpoints(conformed(data))


def review_queue(data: Data) -> DataFrame:
    return conforming.review_queue(conformed(data))


def plain(column: str) -> str:
    """A text's normal form, in DuckDB."""
    dashes, quotes = t.DASHES, t.SINGLE_QUOTES + t.DOUBLE_QUOTES
    signs = "-" * len(dashes) + "''" * len(t.SINGLE_QUOTES) + '"' * len(t.DOUBLE_QUOTES)
    return rf"regexp_replace(translate(trim(regexp_replace(coalesce({column}, ''), '[\s\x{{00a0}}]+', ' ', 'g')), '{dashes}{quotes}', '{signs}'), '\\([<>\[\]()*_`~\\])', '\1', 'g')"


# Reported outcomes of the studies that have results: titles as planned, in capitals, with an addition, or others.
VIEWS["d_reported"] = """
SELECT DISTINCT nct_id, outcome_type, CASE k % 4 WHEN 0 THEN measure WHEN 1 THEN upper(measure) WHEN 2 THEN measure || ' (as reported)' ELSE 'Forced expiratory volume, ' || measure END AS measure, time_frame,
  CAST(NULL AS VARCHAR(9)) AS description, population, k, j, q FROM d_outcomes
WHERE measure <> '' AND CAST(q AS INT) <= 40 AND nct_id IN (SELECT nct_id FROM p_studies WHERE lower(trim(has_results_text)) = 'yes')"""


def reported(data: Data) -> DataFrame:
    """Reported titles, conformed like planned ones (their outcome type is 'other' where they have none)."""
    rows = data.view("d_reported").withColumn("outcome_type", F.coalesce("outcome_type", F.lit("other")))
    return conform(data, "reported", rows)


def report_view(rows: DataFrame) -> DataFrame:
    """The endpoints that the reports read, with the names they use."""
    return conforming.endpoints(rows).withColumnsRenamed({"form_match_method": "form_method", "measurement_match_method": "match_method", "measurement_confidence": "confidence", "timepoint_pattern": "timepoint_pattern_id"})


def queue_view(rows: DataFrame) -> DataFrame:
    return conforming.review_queue(rows).withColumnsRenamed({"review_id": "queue_id", "best_semantic_candidate": "near_miss", "best_semantic_score": "near_score"})


#: What a report's text may name, and how the library makes it.
REPORT_TABLES = {
    "e_endpoints": lambda data: report_view(conformed(data)), "e_queue": lambda data: queue_view(conformed(data)),
    "er_endpoints": lambda data: report_view(reported(data)), "er_queue": lambda data: queue_view(reported(data)),
}


def _rules(kind: str) -> list[tuple]:
    if kind == "synonym":
        return [(d, term, s) for d, term, s in TABLE_ROWS["synonyms"]]
    return [(d, term, p) for d, term, p, role, _ in TABLE_ROWS["patterns"] if role == kind and d != "timepoint"]


_EXPECTED = [(n, x[1], "{" + ",".join(f'"{k}":"{v}"' for k, v in sorted(x[2].items())) + "}" if x[2] else None) for n, x in enumerate(FRAME_SHAPES)]
_THRESHOLDS = [(n, *(x[2] or (None, None, None))) for n, x in enumerate(SHAPES)]
#: The same job as SQL over all texts and rules: what a nested loop finds, then one row for each outcome.
ORACLE_VIEWS = {
    "c_rows": f"""SELECT any_value(o) AS o, md5(concat_ws('|', nct_id, outcome_type, coalesce(measure, ''), coalesce(time_frame, ''), coalesce(description, ''))) AS id,
      {plain('any_value(measure)')} AS mk, {plain('any_value(description)')} AS dk, {plain('any_value(time_frame)')} AS tk FROM d_outcomes o GROUP BY nct_id, outcome_type, measure, time_frame, description""",
    "c_texts": "SELECT DISTINCT text FROM (SELECT mk AS text FROM c_rows UNION ALL SELECT dk FROM c_rows UNION ALL SELECT tk FROM c_rows) x WHERE text <> ''",
    "c_syn": _values(_rules("synonym"), "dimension, term_id, synonym"), "c_pat": _values(_rules("match"), "dimension, term_id, pattern"), "c_guard": _values(_rules("guard"), "dimension, term_id, pattern"),
    "c_terms": _values([(d, x, n) for d, x, _, n in TABLE_ROWS["terms"]], "dimension, term_id, ordinal"), "c_rank": _values(TABLE_ROWS["precedence"], "dimension, term_id, rank"),
    "c_word": "SELECT dimension, term_id, upper(synonym) = synonym AND lower(synonym) <> synonym AND length(synonym) <= 5 AS caps, CASE WHEN upper(synonym) = synonym AND lower(synonym) <> synonym AND length(synonym) <= 5 THEN '' ELSE '(?i)' END || '(^|[^0-9A-Za-z_])(' || replace(synonym, ' ', '[\\s\\-]+') || ')($|[^0-9A-Za-z_])' AS body FROM c_syn",
    "c_found": """SELECT text, dimension, term_id, length(regexp_extract(text, body, 2)) AS span FROM c_texts, c_word WHERE regexp_matches(text, body)
      UNION ALL SELECT text, dimension, term_id, length(regexp_extract(text, pattern, 0, 'i')) FROM c_texts, c_pat WHERE regexp_matches(text, pattern, 'i')""",
    "c_hits": """SELECT f.text, f.dimension, f.term_id, max(span) AS span, any_value(rank) AS rank, any_value(ordinal) AS ordinal FROM c_found f JOIN c_terms USING (dimension, term_id) LEFT JOIN c_rank USING (dimension, term_id)
      WHERE NOT EXISTS (SELECT 1 FROM c_guard g WHERE g.dimension = f.dimension AND g.term_id = f.term_id AND regexp_matches(f.text, g.pattern, 'i')) GROUP BY ALL""",
    "c_win": "SELECT text, dimension, arg_min(term_id, (coalesce(rank, -span), CASE WHEN rank IS NULL THEN ordinal ELSE 0 END, term_id)) AS term FROM c_hits GROUP BY text, dimension",
    "c_text": "SELECT text, " + ", ".join(f"max(CASE WHEN dimension = '{d}' THEN term END) AS {d}" for d in TERMS) + " FROM c_win GROUP BY text",
    "c_both": "SELECT text FROM c_hits WHERE term_id IN ('responder_proportion', 'incidence_proportion') GROUP BY text HAVING count(DISTINCT term_id) = 2",
    "c_bag": f"SELECT term_id, token, count(*) OVER (PARTITION BY term_id) AS of_n FROM (SELECT DISTINCT term_id, token FROM (SELECT term_id, unnest(regexp_extract_all(lower(words), '[a-z0-9]+')) AS token FROM (SELECT term_id, synonym AS words FROM c_syn WHERE dimension = 'measurement' UNION ALL SELECT * FROM c_label) x) y WHERE length(token) >= 3 AND token NOT IN ({_STOP})) z",
    "c_label": _values([(x, label) for d, x, label, _ in TABLE_ROWS["terms"] if d == "measurement"], "term_id, words"),
    "c_near": f"""SELECT text, arg_min(term_id, (-score, term_id)) AS near_id, max(score) AS near_score, arg_min(term_id, (-score, term_id)) FILTER (WHERE score >= 0.6 AND n >= least(2, of_n)) AS semantic_id
      FROM (SELECT w.text, b.term_id, count(*) AS n, any_value(of_n) AS of_n, CAST(count(*) AS DOUBLE) / any_value(of_n) AS score FROM (SELECT DISTINCT text, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM c_texts) w JOIN c_bag b USING (token) GROUP BY 1, 2) s GROUP BY text""",
    "c_m": _values(TABLE_ROWS["measurements"], "measurement_id, default_direction, event_polarity, domain, implies_event, default_scale, concept_id"), "c_f": _values(TABLE_ROWS["forms"], "form_id, rule, event_family, expects, analysable").replace("True", "TRUE").replace("False", "FALSE"),
    "c_e": _values(TABLE_ROWS["events"], "event_id, side"), "c_n": _values(TABLE_ROWS["named_endpoints"], "named_id, form_id, event_id, reference_id, measurement_id, citation"), "c_frames": _values(_EXPECTED, "j, pattern, extracted"), "c_limits": _values(_THRESHOLDS, "k, comparator, value, unit"),
    # Which terms each outcome's fields hold, and what follows step by step.
    "c_1": """SELECT r.id, r.o, r.mk, r.dk, m AS m, d AS d, w AS w, coalesce(m.named_endpoint, d.named_endpoint) AS named_endpoint_id, mb.text IS NOT NULL AS m_both, db.text IS NOT NULL AS d_both, mn.semantic_id AS m_sem, dn.semantic_id AS d_sem,
      CASE WHEN r.mk <> '' THEN mn.near_id ELSE dn.near_id END AS near_id, CASE WHEN r.mk <> '' THEN mn.near_score ELSE dn.near_score END AS near_score
      FROM c_rows r LEFT JOIN c_text m ON m.text = r.mk LEFT JOIN c_text d ON d.text = r.dk LEFT JOIN c_text w ON w.text = r.tk LEFT JOIN c_both mb ON mb.text = r.mk LEFT JOIN c_both db ON db.text = r.dk LEFT JOIN c_near mn ON mn.text = r.mk LEFT JOIN c_near dn ON dn.text = r.dk""",
    "c_2": """SELECT x.*, n.form_id AS n_form, n.event_id AS n_event, n.reference_id AS n_reference, coalesce(m.measurement, d.measurement, m_sem, d_sem, n.measurement_id) AS measurement_id,
      CASE WHEN m.measurement IS NOT NULL THEN 'exact' WHEN d.measurement IS NOT NULL THEN 'syntactic_rule' WHEN coalesce(m_sem, d_sem) IS NOT NULL THEN 'semantic' WHEN n.measurement_id IS NOT NULL THEN 'named_endpoint' END AS measurement_method,
      coalesce(m.derivation, d.derivation) AS derivation_id FROM c_1 x LEFT JOIN c_n n ON n.named_id = x.named_endpoint_id""",
    "c_3": """SELECT x.*, c_m.default_direction, c_m.event_polarity, c_m.implies_event, c_m.default_scale, c_m.concept_id, s.allocation, ta.ta_id,
      CASE WHEN m.form IN ('responder_proportion', 'incidence_proportion') AND m_both OR m.form IS NULL AND d.form IN ('responder_proportion', 'incidence_proportion') AND d_both
        THEN CASE WHEN c_m.event_polarity = 'harm' OR c_m.domain = 'safety' THEN 'incidence_proportion' ELSE 'responder_proportion' END
        ELSE coalesce(m.form, d.form, CASE w.reference WHEN 'from_baseline' THEN 'change_from_baseline' WHEN 'from_randomisation' THEN 'time_to_event' END, CASE WHEN x.measurement_id IS NOT NULL THEN n_form END, 'not_stated') END AS form_id,
      CASE WHEN m.form IS NOT NULL THEN 'exact' WHEN d.form IS NOT NULL THEN 'syntactic_rule' WHEN w.reference IS NOT NULL THEN 'implied' WHEN x.measurement_id IS NOT NULL AND n_form IS NOT NULL THEN 'named_endpoint' END AS form_method,
      coalesce(w.reference, m.reference, CASE WHEN lower(s.allocation) LIKE 'random%' THEN n_reference END, 'not_stated') AS reference_id
      FROM c_2 x LEFT JOIN c_m ON c_m.measurement_id = x.measurement_id LEFT JOIN p_studies s ON s.nct_id = x.o.nct_id LEFT JOIN (SELECT nct_id, min(ta_id) AS ta_id FROM p_study_ta WHERE is_primary GROUP BY nct_id) ta ON ta.nct_id = x.o.nct_id""",
    "c_4": """SELECT x.*, f.rule, f.event_family, f.expects, coalesce(f.analysable, TRUE) AS analysable, CASE WHEN f.event_family THEN coalesce(n_event, m.event, d.event, implies_event, 'not_stated') END AS event_id,
      CASE WHEN mk <> '' THEN m.polarity_cue ELSE d.polarity_cue END AS cue FROM c_3 x LEFT JOIN c_f f ON f.form_id = x.form_id""",
    "c_5": "SELECT x.*, coalesce(CASE WHEN measurement_id IS NOT NULL THEN e.side END, cue, event_polarity) AS side FROM c_4 x LEFT JOIN c_e e ON e.event_id = x.event_id",
    "c_all": """SELECT x.*, CASE rule WHEN 'higher_count_better' THEN 'increase_is_better' WHEN 'neutral' THEN 'neutral' WHEN 'inherit_event_polarity' THEN CASE side WHEN 'harm' THEN 'decrease_is_better' WHEN 'benefit' THEN 'increase_is_better' ELSE 'not_stated' END
        WHEN 'time_polarity' THEN CASE side WHEN 'harm' THEN 'longer_is_better' WHEN 'benefit' THEN 'shorter_is_better' ELSE 'not_stated' END
        ELSE CASE WHEN measurement_id = 'body_weight' AND ta_id = 'furniture' THEN 'increase_is_better' ELSE coalesce(default_direction, 'not_stated') END END AS direction_id,
      CASE WHEN form_id IN ('responder_proportion', 'event_count') AND t.pattern = 'baseline_to_timepoint' AND (lower(o.time_frame) LIKE '%up to%' OR lower(o.time_frame) LIKE '%through%') THEN 'cumulative_window' ELSE t.pattern END AS timepoint_pattern,
      replace(t.extracted, '{q}', o.q) AS timepoint_extracted, CASE WHEN expects THEN h.comparator END AS threshold_comparator, CASE WHEN expects THEN h.value END AS threshold_value, CASE WHEN expects THEN h.unit END AS threshold_unit
      FROM c_5 x JOIN c_frames t ON t.j = x.o.j JOIN c_limits h ON h.k = x.o.k""",
}
for _name in ("c_texts", "c_found", "c_hits", "c_win", "c_near", "c_all"):  # read more than once
    ORACLE_VIEWS[_name] = f"{ONCE} {ORACLE_VIEWS[_name]}"
ORACLE_VIEWS["e_endpoints"] = """SELECT o.nct_id AS nct_id, o.outcome_type AS outcome_type, id AS endpoint_id, o.measure AS measure, o.time_frame AS time_frame, form_id, form_method, measurement_id, measurement_method AS match_method,
  CASE measurement_method WHEN 'exact' THEN 1.0e0 WHEN 'syntactic_rule' THEN 0.7e0 WHEN 'semantic' THEN 0.5e0 ELSE 0.9e0 END AS confidence, concept_id, derivation_id, direction_id, reference_id, event_id,
  threshold_comparator, threshold_value, threshold_unit, timepoint_pattern AS timepoint_pattern_id FROM c_all WHERE measurement_id IS NOT NULL"""
ORACLE_VIEWS["e_queue"] = """SELECT id AS queue_id, o.nct_id AS nct_id, o.measure AS measure, 'measurement_unmatched' AS reason, 'pending' AS status, near_id AS near_miss, near_score, form_id AS candidate_form_id FROM c_all WHERE measurement_id IS NULL"""


def _again(name: str, mark: str = "r") -> str:
    """The name of a view of the chain, for other rows."""
    return re.sub(r"\b([ce])_(?=(?:rows|texts|found|hits|win|text|both|near|1|2|3|4|5|all|endpoints|queue)\b)", rf"\1{mark}_", name)


def chain(mark: str, view: str) -> dict[str, str]:
    """The same chain over another view's rows; what is of the vocabulary is shared."""
    return {_again(n, mark): _again(q, mark).replace("FROM d_outcomes o", f"FROM {view} o") for n, q in ORACLE_VIEWS.items() if _again(n, mark) != n}


REPORTED_VIEWS = chain("r", "d_reported")
ALL_VIEWS = ORACLE_VIEWS | REPORTED_VIEWS


@query("SELECT id, measurement_id, measurement_method FROM c_all WHERE measurement_id IS NOT NULL", ORACLE_VIEWS)
def resolve_measurement(data: Data) -> DataFrame:
    return endpoints(data).select(F.col("endpoint_id").alias("id"), "measurement_id", F.col("measurement_match_method").alias("measurement_method"))


@query("SELECT named_endpoint_id, count(*) AS n, count(DISTINCT o.nct_id) AS studies FROM c_all WHERE measurement_id IS NOT NULL GROUP BY 1", ORACLE_VIEWS)
def resolve_named_endpoint(data: Data) -> DataFrame:
    return endpoints(data).groupBy("named_endpoint_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nct_id").alias("studies"))


@query("SELECT id, measurement_id, form_id, reference_id FROM c_all WHERE named_endpoint_id IS NOT NULL AND measurement_id IS NOT NULL", ORACLE_VIEWS)
def fill_from_named_endpoint(data: Data) -> DataFrame:
    return endpoints(data).where("named_endpoint_id is not null").select(F.col("endpoint_id").alias("id"), "measurement_id", "form_id", "reference_id")


@query("SELECT id, form_id, form_method FROM c_all WHERE measurement_id IS NOT NULL", ORACLE_VIEWS)
def resolve_form(data: Data) -> DataFrame:
    return endpoints(data).select(F.col("endpoint_id").alias("id"), "form_id", F.col("form_match_method").alias("form_method"))


@query("SELECT form_id, measurement_id, count(*) AS n FROM c_all WHERE form_id IN ('responder_proportion', 'incidence_proportion') AND measurement_id IS NOT NULL GROUP BY 1, 2", ORACLE_VIEWS)
def disambiguate_form(data: Data) -> DataFrame:
    return endpoints(data).where("form_id in ('responder_proportion', 'incidence_proportion')").groupBy("form_id", "measurement_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, reference_id FROM c_all WHERE measurement_id IS NOT NULL", ORACLE_VIEWS)
def resolve_reference(data: Data) -> DataFrame:
    return endpoints(data).select(F.col("endpoint_id").alias("id"), "reference_id")


@query("SELECT id, derivation_id FROM c_all WHERE measurement_id IS NOT NULL", ORACLE_VIEWS)
def resolve_derivation(data: Data) -> DataFrame:
    return endpoints(data).select(F.col("endpoint_id").alias("id"), "derivation_id")


@query("SELECT id, form_id, event_id FROM c_all WHERE measurement_id IS NOT NULL", ORACLE_VIEWS)
def resolve_event(data: Data) -> DataFrame:
    return endpoints(data).select(F.col("endpoint_id").alias("id"), "form_id", "event_id")


@query("SELECT id, side AS polarity, direction_id FROM c_all WHERE measurement_id IS NOT NULL", ORACLE_VIEWS)
def derive_direction(data: Data) -> DataFrame:
    return endpoints(data).select(F.col("endpoint_id").alias("id"), F.col("event_polarity_used").alias("polarity"), "direction_id")


@query("SELECT id, default_scale AS scale_id, analysable FROM c_all WHERE measurement_id IS NOT NULL", ORACLE_VIEWS)
def assign_default_scale(data: Data) -> DataFrame:
    return endpoints(data).select(F.col("endpoint_id").alias("id"), "scale_id", "analysable")


@query("SELECT id, threshold_comparator, threshold_value, threshold_unit FROM c_all WHERE measurement_id IS NOT NULL", ORACLE_VIEWS)
def extract_threshold(data: Data) -> DataFrame:
    return endpoints(data).select(F.col("endpoint_id").alias("id"), "threshold_comparator", "threshold_value", "threshold_unit")


@query("SELECT DISTINCT time_frame, pattern AS timepoint_pattern, replace(extracted, '{q}', q) AS extracted FROM d_outcomes o JOIN c_frames t ON t.j = o.j", ORACLE_VIEWS)
def classify_timepoint(data: Data) -> DataFrame:
    found = timepoints.classify(outcomes(data), vocabulary(data))
    return found.select("time_frame", "timepoint_pattern", F.to_json("extracted").alias("extracted"))


@query("SELECT id, timepoint_pattern, timepoint_extracted FROM c_all WHERE measurement_id IS NOT NULL", ORACLE_VIEWS)
def disambiguate_timepoint(data: Data) -> DataFrame:
    return endpoints(data).select(F.col("endpoint_id").alias("id"), "timepoint_pattern", "timepoint_extracted")


_BOTH = """SELECT 'endpoints' AS sink, id, form_id, direction_id, measurement_id AS term, CAST(NULL AS DOUBLE) AS score FROM c_all WHERE measurement_id IS NOT NULL
UNION ALL SELECT 'review_queue', id, form_id, direction_id, near_id, near_score FROM c_all WHERE measurement_id IS NULL"""


@query(_BOTH, ORACLE_VIEWS)
def conform_outcomes(data: Data) -> DataFrame:
    kept = endpoints(data).select(F.lit("endpoints").alias("sink"), F.col("endpoint_id").alias("id"), "form_id", "direction_id", F.col("measurement_id").alias("term"), F.lit(None).cast("double").alias("score"))
    queued = review_queue(data).select(F.lit("review_queue"), "review_id", "candidate_form_id", "candidate_direction_id", "best_semantic_candidate", "best_semantic_score")
    return kept.union(queued)
