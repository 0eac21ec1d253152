"""Planned outcomes conformed to a vocabulary: one plan from texts to ``endpoints`` and ``review_queue``.

The outcomes meet their studies, and are written as they stand. All dimensions are matched at once on the
distinct texts of all fields, and what is found in each text, and what each time frame is, are written once. What the dimensions imply for each
other depends on the texts of measure and description, the terms of the time frame, the study's allocation and its area only: it is resolved once for each
distinct case of these, and written. Where the tables of texts and cases are in bounds, an outcome meets its time frame and its case by broadcast when it is
read, so that a reader makes only the columns that it uses and no outcome is written with all its dimensions; beyond, texts are met in a single
join of (row, field, hash) rows, which a field without text never enters. Named hits are structs of (term_id, match_method, confidence, source_field).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_id, normalised
from ..sources.vocabulary import Vocabulary
from . import timepoints
from ..sources.tables import scratch
from .matching import BROADCAST_BYTES, checked_broadcast, known_size, semantic_tokens, small, tag_patterns, tag_synonyms

FIELDS = ("measure", "description", "time_frame")
DIMENSIONS = ("measurement", "form", "event", "reference", "derivation", "named_endpoint", "polarity_cue")
# Comparators in words and signs, and what they mean.
COMPARATORS = {
    "≥": ">=", ">=": ">=", "at least": ">=", "no less than": ">=", "or more": ">=", "or better": ">=", "≤": "<=", "<=": "<=", "at most": "<=", "no more than": "<=", "or less": "<=", "or worse": "<=",
    ">": ">", "greater than": ">", "more than": ">", "above": ">", "<": "<", "less than": "<", "fewer than": "<", "below": "<", "=": "=", "exactly": "=",
}
# The patterns of a threshold in words (behind a comparator) and in a score's name.
STATED_THRESHOLD, NAMED_THRESHOLD = r"\s*(\d+(?:\.\d+)?)\s*(%|percent|points?|mmhg|mg/dl|mmol/l)?", r"\b[A-Z]{2,6}\s?-?(\d{2,3})\b"
#: About how many bytes of a broadcast table a row of facts takes.
ROW_BYTES = 200
#: Least share of a term's tokens and least number of them for a semantic match.
LEAST_SCORE, LEAST_OVERLAP = 0.6, 2
_HIT = "struct<term_id:string,match_method:string,confidence:double,source_field:string>"


def hit(term: Column, method: Column | str, confidence: Column | float, field: str | None = None) -> Column:
    """A hit, or null where the term is null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(term.alias("term_id"), lit(method).cast("string").alias("match_method"), lit(confidence).cast("double").alias("confidence"), F.lit(field).cast("string").alias("source_field"))
    return F.when(term.isNotNull(), made).cast(_HIT)


def dimension_hits(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """text_id, dimension, term_id, matched_text, span, via: all terms of all dimensions in the texts, without the vetoed ones."""
    key = F.concat_ws("\u0001", "dimension", "term_id").alias("term_id")
    patterns = vocabulary["patterns"].where(F.col("dimension").isin(*DIMENSIONS))
    synonyms = vocabulary["synonyms"].where(F.col("dimension").isin(*DIMENSIONS)).select(key, "synonym")
    matches, guards = (patterns.where(F.col("role") == role).select(key, "pattern") for role in ("match", "guard"))
    found = tag_synonyms(texts, synonyms).unionByName(tag_patterns(texts, matches))
    vetoed = tag_patterns(texts, guards).select("text_id", "term_id").distinct()
    kept = found.join(vetoed, ["text_id", "term_id"], "left_anti")
    parts = F.split("term_id", "\u0001")
    return kept.select("text_id", parts[0].alias("dimension"), parts[1].alias("term_id"), "matched_text", "span", "via")


def winners(hits: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """text_id, won (a map dimension -> term) and forms (all forms found): one row for each text with a hit.

    Dimensions with a precedence take the lowest rank (terms without one never match), the others the longest match,
    then the vocabulary's order.
    """
    ranked = vocabulary["precedence"].select("dimension").distinct().withColumn("by_rank", F.lit(True))
    placed = (
        hits.join(checked_broadcast(ranked), "dimension", "left")
        .join(checked_broadcast(vocabulary["precedence"]), ["dimension", "term_id"], "left")
        .join(checked_broadcast(vocabulary["terms"].select("dimension", "term_id", "ordinal")), ["dimension", "term_id"], "left")
    )
    late = F.lit(1_000_000_000)
    order = F.struct(
        F.when(F.col("by_rank"), F.col("rank")).otherwise(-F.col("span")).alias("first"),
        F.when(F.col("by_rank"), F.lit(0)).otherwise(F.coalesce("ordinal", late)).alias("then"), "term_id",
    )
    best = placed.where("by_rank is null or rank is not null").groupBy("text_id", "dimension").agg(F.min_by("term_id", order).alias("term"), F.collect_set("term_id").alias("all"))
    return best.groupBy("text_id").agg(
        F.map_from_entries(F.collect_list(F.struct("dimension", "term"))).alias("won"),
        F.flatten(F.collect_list(F.when(F.col("dimension") == "form", F.col("all")))).alias("forms"),
    )


def near_terms(texts: DataFrame, vocabulary: Vocabulary, dimension: str = "measurement") -> DataFrame:
    """text_id, semantic_id (a match), near_id and near_score (the best, however weak): shares of a term's tokens in a text."""
    of_term = vocabulary.of("terms", dimension).select("term_id", F.coalesce("label", F.lit("")).alias("words")).unionByName(vocabulary.of("synonyms", dimension).select("term_id", F.col("synonym").alias("words")))
    bag = of_term.groupBy("term_id").agg(F.concat_ws(" ", F.collect_list("words")).alias("words")).select("term_id", semantic_tokens(F.col("words")).alias("t"))
    index = bag.where(F.size("t") > 0).select("term_id", F.size("t").alias("of"), F.explode("t").alias("token"))
    words = texts.select("text_id", F.explode(semantic_tokens(F.col("text"))).alias("token"))
    overlap = words.join(checked_broadcast(small(index)), "token").groupBy("text_id", "term_id").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("of"))
    scored = overlap.withColumn("score", F.col("n") / F.col("of"))
    order = F.struct((-F.col("score")).alias("s"), "term_id")
    match = (F.col("score") >= LEAST_SCORE) & (F.col("n") >= F.least(F.lit(LEAST_OVERLAP), F.col("of")))
    return scored.groupBy("text_id").agg(
        F.min_by(F.when(match, F.col("term_id")), F.when(match, order)).alias("semantic_id"), F.min_by("term_id", order).alias("near_id"), F.max("score").alias("near_score")
    )


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed(rows: DataFrame) -> DataFrame:
    """Rows with ``key_<field>``: the hash of the field's text as it stands, null for none; and that of the time frame as a frame."""
    keys = {f"key_{f}": F.when(F.coalesce(f, F.lit("")) != "", F.md5(f)) for f in FIELDS}
    return rows.withColumns(keys).withColumn("key_frame", F.concat(F.lit("frame:"), "key_time_frame"))


def raw_texts(rows: DataFrame) -> DataFrame:
    """raw and text of the distinct texts of the fields: as they stand and normalised, which may be empty."""
    each = rows.select(F.explode(F.array(*FIELDS)).alias("raw")).where("raw <> ''").distinct()
    return each.select("raw", normalised(F.col("raw")).alias("text"))


def texts_of(rows: DataFrame) -> DataFrame:
    """text_id and text of the distinct non-empty normalised texts of the fields."""
    return raw_texts(rows).where("text <> ''").select("text").distinct().select(F.md5("text").alias("text_id"), "text")


def facts(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """_key, raw, in_text and frame: what the vocabulary finds in each distinct text of the fields (the normalised text, its threshold,
    won, forms, semantic_id, near_id, near_score), and what each time frame is (prepared, timepoint_pattern, extracted, match_method, won, and won as text in
    terms). An absent time frame is the empty text, under the key of that text."""
    raw = written(raw_texts(rows).select(F.md5("raw").alias("_key"), "raw", "text", F.when(F.col("text") != "", F.md5("text")).alias("text_id")), "conform-texts")
    texts = raw.where("text_id is not null").select("text_id", "text").distinct()
    hits = winners(dimension_hits(texts, vocabulary), vocabulary).join(near_terms(texts, vocabulary), "text_id", "full")
    won = F.struct(*(F.col("won")[d].alias(d) for d in DIMENSIONS)).alias("won")
    terms = raw.join(hits.withColumn("_met", F.lit(True)), "text_id", "left").select("_key", "raw", "text", threshold(F.col("raw")).alias("threshold"), F.when(F.col("_met"), won).alias("won"), "forms", "semantic_id", "near_id", "near_score")
    terms = written(terms, "conform-terms")
    blank = rows.sparkSession.createDataFrame([("",)], "time_frame string")
    frames = timepoints.classify(rows.where("time_frame <> ''").select("time_frame").distinct().unionByName(blank), vocabulary).withColumn("_of", F.md5("time_frame"))
    frames = frames.join(terms.select(F.col("_key").alias("_of"), "won"), "_of", "left")
    frames = frames.select(F.concat(F.lit("frame:"), "_of").alias("_key"), F.col("time_frame").alias("raw"), F.struct("prepared", "timepoint_pattern", "extracted", "match_method", "won", F.to_json("won").alias("terms")).alias("frame"))
    found = terms.select("_key", "raw", F.struct(*(c for c in terms.columns if c not in ("_key", "raw"))).alias("in_text"))
    return found.unionByName(frames, allowMissingColumns=True)


def matched(rows: DataFrame, vocabulary: Vocabulary, most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (id, the fields, and what :func:`hashed` adds) with ``in_<field>`` and ``frame``, the :func:`facts` on each field's text."""
    back = looked_up(rows, written(facts(rows, vocabulary), "conform-found"), [*(f"in_{f}" for f in FIELDS), "frame"], most)
    return with_blank_frame(back, vocabulary).drop(*(f"key_{f}" for f in (*FIELDS, "frame")))


def with_blank_frame(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """An absent time frame is an empty text to the patterns; all rows without one take the same answer."""
    blank = timepoints.classify(small(rows.sparkSession.createDataFrame([("",)], "time_frame string")), vocabulary).first()
    empty = F.struct(
        F.lit(blank["prepared"]).alias("prepared"), F.lit(blank["timepoint_pattern"]).alias("timepoint_pattern"), F.lit(None).cast("map<string,string>").alias("extracted"),
        F.lit(blank["match_method"]).cast("string").alias("match_method"), F.lit(None).cast(rows.schema["frame"].dataType["won"].dataType).alias("won"), F.lit(None).cast("string").alias("terms"),
    )
    return rows.withColumn("frame", F.coalesce("frame", empty))


def in_bounds(table: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast: by its files' size, and by its rows, which are larger in memory."""
    return known_size(table) <= most and table.count() * ROW_BYTES <= most


def looked_up(rows: DataFrame, found: DataFrame, names: list[str], most: int = BROADCAST_BYTES) -> DataFrame:
    return (by_broadcast if in_bounds(found, most) else by_shuffle)(rows, found, names)


def by_broadcast(rows: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """Each field looks its key up in what was found, which is small enough to be everywhere; no row moves."""
    for n in names:
        side = F.broadcast(found.select(F.col("_key").alias("_of"), F.col("frame" if n == "frame" else "in_text").alias(n)))
        rows = rows.join(side, F.col(f"key_{n.removeprefix('in_')}") == F.col("_of"), "left").drop("_of")
    return rows


def by_shuffle(rows: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """The same by one join of (id, field, key) rows, which a field without text never enters, turned back to one row for each id."""
    each = F.filter(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"key_{n.removeprefix('in_')}").alias("_key")) for n in names)), lambda x: x["_key"].isNotNull())
    met = rows.select("id", F.explode(each).alias("x")).select("id", "x.*").join(found, "_key")
    side = lambda n: F.first(F.when(F.col("field") == n, F.col("frame" if n == "frame" else "in_text")), ignorenulls=True).alias(n)
    return rows.join(met.groupBy("id").agg(*map(side, names)), "id", "left")


class Cascades:
    """The order of fields of each dimension, from the vocabulary, as expressions over :func:`matched` rows."""

    def __init__(self, vocabulary: Vocabulary):
        self.confidence = {r["match_method"]: r["confidence"] for r in timepoints.bounded(vocabulary["confidence"])}
        self.steps: dict[str, list[tuple[str, str]]] = {}
        self.fallback: dict[str, str | None] = {}
        for r in timepoints.bounded(vocabulary["cascade"].orderBy("dimension", "ordinal")):
            if r["fallback"] is None:
                self.steps.setdefault(r["dimension"], []).append((r["field"], r["match_method"]))
            else:
                self.fallback[r["dimension"]] = r["fallback"]

    def of(self, method: str) -> float:
        return self.confidence.get(method, 0.0)

    def resolve(self, dimension: str) -> Column:
        """The hit of the first field that has one, else null."""
        hits = [hit(F.col(f"in_{field}.won")[dimension], method, self.of(method), field) for field, method in self.steps.get(dimension, [])]
        return F.coalesce(*hits, F.lit(None).cast(_HIT))

    def stated(self, dimension: str, found: Column) -> Column:
        """The hit, or the dimension's fallback term, which has no method."""
        return F.coalesce(found, hit(F.lit(self.fallback.get(dimension, "not_stated")), F.lit(None), 0.0))


def resolve_named_endpoint(rows: DataFrame, vocabulary: Vocabulary, c: Cascades) -> DataFrame:
    """Adds named_endpoint_id and ``named``, its definition."""
    definition = vocabulary["named_endpoints"].select(F.col("id").alias("_n"), F.struct("form_id", "event_id", "reference_id", "measurement_id").alias("named"))
    out = rows.withColumn("named_endpoint_id", c.resolve("named_endpoint")["term_id"])
    return out.join(checked_broadcast(definition), F.col("named_endpoint_id") == F.col("_n"), "left").drop("_n")


def resolve_measurement(rows: DataFrame, vocabulary: Vocabulary, c: Cascades) -> DataFrame:
    """Adds ``measurement``: the cascade, then a semantic match field by field, then the named endpoint's; and ``m``, its attributes.

    Null where all are silent, unless the vocabulary names a fallback other than the review queue.
    """
    fallback = c.fallback.get("measurement", "review_queue")
    found = c.resolve("measurement")
    if fallback == "review_queue":
        near = [hit(F.col(f"in_{field}.semantic_id"), "semantic", c.of("semantic"), field) for field, _ in c.steps.get("measurement", [])]
        found = F.coalesce(found, *near, hit(F.col("named.measurement_id"), "named_endpoint", c.of("named_endpoint")))
    else:
        found = c.stated("measurement", found)
    attributes = vocabulary["measurements"].select(F.col("id").alias("_m"), F.struct("default_direction", "event_polarity", "domain", "implies_event", "default_scale", "concept_id").alias("m"))
    return rows.withColumn("measurement", found).join(checked_broadcast(attributes), F.col("measurement.term_id") == F.col("_m"), "left").drop("_m")


def randomised(allocation: Column) -> Column:
    return F.coalesce(F.lower(F.ltrim(allocation)).startswith("random"), F.lit(False))


def resolve_reference(rows: DataFrame, c: Cascades) -> DataFrame:
    """Adds ``reference``; a named endpoint's fills in on randomised studies (column ``allocation``) only."""
    named = F.when(randomised(F.col("allocation")), hit(F.col("named.reference_id"), "named_endpoint", c.of("named_endpoint")))
    return rows.withColumn("reference", c.stated("reference", F.coalesce(c.resolve("reference"), named)))


def resolve_derivation(rows: DataFrame, c: Cascades) -> DataFrame:
    """Adds ``derivation``, null where none is named."""
    return rows.withColumn("derivation", c.resolve("derivation"))


def form_choices(vocabulary: Vocabulary) -> DataFrame:
    """candidate, choices: for each form the pairs that it is in, as (other, the one for harms, the other one).

    Of a pair the member that inherits the event's polarity is taken for harms, the one that counts for the rest.
    """
    pairs, forms = vocabulary["form_pairs"], vocabulary["forms"].select("id", "direction_rule")
    both = pairs.select("ordinal", F.col("first").alias("candidate"), F.col("second").alias("other")).unionByName(pairs.select("ordinal", F.col("second").alias("candidate"), F.col("first").alias("other")))
    ruled = both.join(forms.select(F.col("id").alias("candidate"), F.col("direction_rule").alias("r1")), "candidate").join(forms.select(F.col("id").alias("other"), F.col("direction_rule").alias("r2")), "other")
    inherits, counts = "inherit_event_polarity", "higher_count_better"
    usable = ruled.where(((F.col("r1") == inherits) & (F.col("r2") == counts)) | ((F.col("r1") == counts) & (F.col("r2") == inherits)))
    harm = F.when(F.col("r1") == inherits, F.col("candidate")).otherwise(F.col("other"))
    rest = F.when(F.col("r1") == inherits, F.col("other")).otherwise(F.col("candidate"))
    return usable.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("ordinal", "other", harm.alias("harm"), rest.alias("rest")))).alias("choices"))


def disambiguate_form(found: Column, forms: Column, harm: Column) -> Column:
    """The hit with the term that a pair prefers, where the text has the pair's other member too; ``choices`` is a column."""
    winner = lambda x: F.when(harm, x["harm"]).otherwise(x["rest"])
    turned = F.filter(F.col("choices"), lambda x: F.array_contains(forms, x["other"]) & (winner(x) != found["term_id"]))
    first = F.when(F.size(turned) > 0, winner(F.get(turned, F.lit(0))))
    return F.when(first.isNotNull(), found.withField("term_id", first)).otherwise(found)


def resolve_form(rows: DataFrame, vocabulary: Vocabulary, c: Cascades) -> DataFrame:
    """Adds ``form`` and ``f``, its attributes: the cascade with its pairs settled, a reference's usual form, the named endpoint's."""
    implied = vocabulary["reference_forms"].groupBy("reference_id").agg(F.min_by("form_id", "ordinal").alias("_implied"))
    steps = c.steps.get("form", [])
    texts = [hit(F.col(f"in_{field}.won")["form"], method, c.of(method), field) for field, method in steps if field != "time_frame"]
    by_text = F.coalesce(*texts, F.lit(None).cast(_HIT))
    out = rows.withColumn("_form", by_text).join(checked_broadcast(small(form_choices(vocabulary))), F.col("_form.term_id") == F.col("candidate"), "left").drop("candidate")
    out = out.join(checked_broadcast(small(implied)), F.col("in_time_frame.won")["reference"] == F.col("reference_id"), "left").drop("reference_id")
    where = F.when(F.col("_form.source_field") == "measure", F.col("in_measure.forms")).otherwise(F.col("in_description.forms"))
    harm = F.coalesce((F.col("m.event_polarity") == "harm") | (F.col("m.domain") == "safety"), F.lit(False))
    settled = F.when(F.col("choices").isNotNull(), disambiguate_form(F.col("_form"), where, harm)).otherwise(F.col("_form"))
    by_frame = [hit(F.col("_implied"), method, c.of(method), field) for field, method in steps if field == "time_frame"]
    named = F.when(F.col("measurement").isNotNull(), hit(F.col("named.form_id"), "named_endpoint", c.of("named_endpoint")))
    out = out.withColumn("form", c.stated("form", F.coalesce(settled, *by_frame, named))).drop("_form", "choices", "_implied")
    attributes = vocabulary["forms"].select(F.col("id").alias("_f"), F.struct("direction_rule", "event_family", "expects_threshold", "analysable").alias("f"))
    return out.join(checked_broadcast(attributes), F.col("form.term_id") == F.col("_f"), "left").drop("_f")


def resolve_event(rows: DataFrame, vocabulary: Vocabulary, c: Cascades) -> DataFrame:
    """Adds ``event`` for forms of the event family: named endpoint's, cascade's, what the measurement implies, not stated; and its polarity."""
    named = hit(F.col("named.event_id"), "named_endpoint", c.of("named_endpoint"))
    implied = hit(F.col("m.implies_event"), "implied", c.confidence.get("implied", 0.8))
    stated = F.coalesce(named, c.resolve("event"), implied, hit(F.lit("not_stated"), F.lit(None), 0.0))
    polarity = vocabulary["events"].select(F.col("id").alias("_e"), F.col("polarity").alias("event_side"))
    out = rows.withColumn("event", F.when(F.coalesce("f.event_family", F.lit(False)), stated))
    return out.join(checked_broadcast(polarity), F.col("event.term_id") == F.col("_e"), "left").drop("_e")


def cue(text: str = "measure", other: str = "description") -> Column:
    """The side that words of the measure, or of the description where there is no measure, take."""
    return F.when(F.coalesce(F.col(f"in_{text}.text"), F.lit("")) != "", F.col(f"in_{text}.won")["polarity_cue"]).otherwise(F.col(f"in_{other}.won")["polarity_cue"])


def derive_direction(rows: DataFrame, vocabulary: Vocabulary, default: str = "not_stated") -> DataFrame:
    """Adds direction_id and event_polarity_used: the event's side, the text's words, the measurement's; then the form's rule.

    A row without measurement has no event either: its direction is a guess by words.
    """
    by_area = vocabulary["direction_by_area"].select(F.col("measurement_id").alias("_m"), F.col("ta_id").alias("_t"), F.col("direction_id").alias("_by_area"))
    out = rows.join(checked_broadcast(by_area), (F.col("measurement.term_id") == F.col("_m")) & (F.col("ta_id") == F.col("_t")), "left").drop("_m", "_t")
    side = F.coalesce(F.when(F.col("measurement").isNotNull(), F.col("event_side")), cue(), F.col("m.event_polarity"))
    out = out.withColumn("event_polarity_used", side)
    side, rule = F.col("event_polarity_used"), F.col("f.direction_rule")
    direction = (
        F.when(rule == "higher_count_better", "increase_is_better").when(rule == "neutral", "neutral")
        .when(rule == "inherit_event_polarity", F.when(side == "harm", "decrease_is_better").when(side == "benefit", "increase_is_better"))
        .when(rule == "time_polarity", F.when(side == "harm", "longer_is_better").when(side == "benefit", "shorter_is_better"))
        .otherwise(F.coalesce("_by_area", F.col("m.default_direction")))
    )
    return out.withColumn("direction_id", F.coalesce(direction, F.lit(default))).drop("_by_area", "event_side")


def threshold(text: Column) -> Column:
    """(comparator, value, unit) of the first stated threshold; 'PASI75' is '>= 75 %'; null without one."""
    words = "|".join(sorted(COMPARATORS, key=lambda w: (-len(w), w)))
    explicit = f"(?iu)({words}){STATED_THRESHOLD}"
    signs = F.create_map(*(F.lit(x) for pair in COMPARATORS.items() for x in pair))
    unit = F.regexp_extract(text, explicit, 3)
    unit = F.when(F.lower(unit).startswith("percent"), "%").when(unit != "", unit)
    stated = F.struct(F.element_at(signs, F.lower(F.regexp_extract(text, explicit, 1))).alias("comparator"), F.regexp_extract(text, explicit, 2).try_cast("double").alias("value"), unit.alias("unit"))
    scored = F.struct(F.lit(">=").alias("comparator"), F.regexp_extract(text, NAMED_THRESHOLD, 1).try_cast("double").alias("value"), F.lit("%").alias("unit"))
    return F.when(text.rlike(explicit), stated).when(text.rlike(NAMED_THRESHOLD), scored)


def extract_threshold(rows: DataFrame) -> DataFrame:
    """Adds ``threshold``, from the measure, else the description, for forms that expect one."""
    found = F.coalesce("in_measure.threshold", "in_description.threshold")
    return rows.withColumn("threshold", F.when(F.coalesce("f.expects_threshold", F.lit(False)), found))


def assign_default_scale(rows: DataFrame) -> DataFrame:
    """Adds scale_id, the measurement's usual one, and analysable, the form's flag (true where it has none)."""
    return rows.withColumns({"scale_id": F.col("m.default_scale"), "analysable": F.coalesce("f.analysable", F.lit(True))})


def row_id() -> Column:
    return content_id(*(F.col(c) for c in ("nct_id", "outcome_type", "measure", "time_frame", "description")))


def planned(outcomes: DataFrame, studies: DataFrame, areas: DataFrame) -> DataFrame:
    """id, the outcomes' columns, allocation and ta_id: of rows of one id one, with the first population by order.

    ``study`` comes first in all keys: a number that sorts by its bytes, where the ids of studies have their first characters in common.
    """
    study = F.xxhash64("nct_id").alias("study")
    none = F.lit(None).cast("string")
    of = studies.select(study, "nct_id", "allocation", none.alias("ta_id")).unionByName(areas.where("is_primary").select(study, "nct_id", none.alias("allocation"), "ta_id"))
    of = of.groupBy("study", "nct_id").agg(F.min("allocation").alias("allocation"), F.min("ta_id").alias("ta_id"))
    rows = outcomes.select(study, "nct_id", "outcome_type", "measure", "time_frame", "description", "population")
    rows = rows.join(of, ["study", "nct_id"], "left").withColumn("id", row_id())
    one = Window.partitionBy("study", "nct_id", "id").orderBy("population", "measure", "time_frame", "description")  # under the partitioning by study
    return rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "study")


def case_keys() -> dict[str, Column]:
    """What makes a case, of rows with their frame, without nulls: an empty text is none, and an allocation that isn't stated is not random; an area is marked."""
    texts = {c: F.coalesce(c, F.lit("")) for c in ("measure", "description", "allocation")}
    return texts | {"area": F.coalesce(F.concat(F.lit("="), "ta_id"), F.lit("")), "terms": F.coalesce("frame.terms", F.lit(""))}


def framed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with their ``frame``, by broadcast of the :func:`facts` on time frames."""
    frames = F.broadcast(found.where("frame is not null").select(F.col("raw").alias("_frame"), "frame"))
    return rows.join(frames, F.coalesce("time_frame", F.lit("")) == F.col("_frame")).drop("_frame")


def conformed(outcomes: DataFrame, vocabulary: Vocabulary, studies: DataFrame, areas: DataFrame, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> DataFrame:
    """Every planned outcome with all its dimensions; ``measurement`` is null for those that go to review.

    outcomes: nct_id, outcome_type, measure, time_frame, description, population. studies: nct_id, allocation.
    areas: nct_id, ta_id, is_primary. Of rows that are equal in what makes the id one stays, with the first population by order.
    ``keep`` writes a table that is made on the way under a name, or returns the one that it has by that name.
    """
    keep = keep or (lambda name, build: written(build(), f"conform-{name}"))
    rows = keep("rows", lambda: planned(outcomes, studies, areas))
    found = keep("found", lambda: facts(rows, vocabulary))
    bounded = in_bounds(found)
    if bounded:
        rows = framed(rows, found)
    else:
        rows = keep("framed", lambda: with_blank_frame(looked_up(hashed(rows), found, ["frame"]), vocabulary))
    keys = case_keys()

    def cases() -> DataFrame:
        distinct = rows.select("ta_id", *(c.alias(n) for n, c in keys.items())).distinct()
        distinct = written(hashed(distinct.withColumns({"id": F.monotonically_increasing_id(), "time_frame": F.lit(None).cast("string")})), "conform-cases")
        won = found.schema["frame"].dataType["won"].dataType
        rest = looked_up(distinct.withColumn("in_time_frame", F.struct(F.from_json(F.nullif(F.col("terms"), F.lit("")), won).alias("won"))), found, ["in_measure", "in_description"])
        return resolved(rest, vocabulary).join(distinct.select(F.col("id").alias("case"), *keys), "case").drop("case")

    of = keep("cases", cases).withColumnsRenamed({n: f"_{n}" for n in keys})
    whole = bounded and in_bounds(of)
    met = F.lit(True)
    for n, c in keys.items():
        met = met & (c == F.col(f"_{n}"))
    out = rows.join(F.broadcast(of) if whole else of, met)
    out = out.select("*", "frame.prepared", "frame.timepoint_pattern", "frame.extracted", F.col("frame.match_method").alias("timepoint_match_method"), F.col("form.term_id").alias("form_id"))
    out = timepoints.disambiguated(out, vocabulary["timepoint_choices"]).select(
        "id", "nct_id", "outcome_type", "measure", "description", "time_frame", "population", "named_endpoint_id", "measurement", "form", "derivation", "reference", "event", "direction_id", "event_polarity_used", "scale_id", "analysable",
        "threshold", "timepoint_pattern", "timepoint_match_method", "extracted", "concept_id", "near",
    )
    return out if whole else keep("outcomes", lambda: out)


def resolved(cases: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What follows from in_measure, in_description, in_time_frame, allocation and ta_id, for each ``id``, now called case."""
    c = Cascades(vocabulary)
    rows = resolve_measurement(resolve_named_endpoint(cases, vocabulary, c), vocabulary, c)
    rows = resolve_form(resolve_reference(resolve_derivation(rows, c), c), vocabulary, c)
    rows = derive_direction(resolve_event(rows, vocabulary, c), vocabulary)
    near = F.when(F.coalesce("in_measure.text", F.lit("")) != "", F.col("in_measure")).otherwise(F.col("in_description"))
    return assign_default_scale(extract_threshold(rows)).select(
        F.col("id").alias("case"), "named_endpoint_id", "measurement", "form", "derivation", "reference", "event", "direction_id", "event_polarity_used", "scale_id", "analysable", "threshold",
        F.col("m.concept_id").alias("concept_id"), F.when(F.col("measurement").isNull(), F.struct(near["near_id"].alias("near_id"), near["near_score"].alias("near_score"))).alias("near"),
    )


def endpoints(rows: DataFrame) -> DataFrame:
    """The sink of what has a measurement."""
    flat = []
    for name in ("form", "measurement", "derivation", "reference", "event"):
        flat += [F.col(f"{name}.term_id").alias(f"{name}_id"), *(F.col(f"{name}.{x}").alias(f"{name}_{x}") for x in ("match_method", "confidence", "source_field"))]
    return rows.where("measurement is not null").select(
        F.col("id").alias("endpoint_id"), "nct_id", "outcome_type", "measure", "description", "time_frame", "population", *flat, "named_endpoint_id", "direction_id", "event_polarity_used",
        "scale_id", "concept_id", "timepoint_pattern", "timepoint_match_method", F.to_json("extracted").alias("timepoint_extracted"),
        F.col("threshold.comparator").alias("threshold_comparator"), F.col("threshold.value").alias("threshold_value"), F.col("threshold.unit").alias("threshold_unit"), "analysable",
    )


def review_queue(rows: DataFrame) -> DataFrame:
    """The sink of what has none: with the form and direction that it would get, and the nearest term."""
    return rows.where("measurement is null").select(
        F.col("id").alias("review_id"), "nct_id", "outcome_type", "measure", "description", "time_frame", "population", F.lit("measurement_unmatched").alias("reason"),
        F.col("form.term_id").alias("candidate_form_id"), F.col("direction_id").alias("candidate_direction_id"), F.col("near.near_id").alias("best_semantic_candidate"), F.col("near.near_score").alias("best_semantic_score"), F.lit("pending").alias("status"),
    )
