"""Time frames: prepared step by step, then classified by patterns in the order of their priority.

Jobs work on distinct texts. The patterns, words and the order of the steps are vocabulary tables; they are read once
into the plan (a few dozen rows), so that every expression is a literal that Spark compiles once.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, plain_signs, stripped
from ..sources.vocabulary import Vocabulary
from .matching import bounded, checked_broadcast, small


class Rules(NamedTuple):
    steps: list[str]
    units: list[str]
    words: dict[str, list[tuple[str, str]]]
    #: term, guards, patterns; by priority
    terms: list[tuple[str, list[str], list[str]]]
    fallback: str


def load_rules(vocabulary: Vocabulary) -> Rules:
    words: dict[str, list[tuple[str, str]]] = {}
    for r in bounded(vocabulary["timepoint_words"]):
        words.setdefault(r["kind"], []).append((r["word"], r["value"]))
    patterns: dict[tuple[str, str], list[str]] = {}
    for r in bounded(vocabulary.of("patterns", "timepoint").orderBy("term_id", "ordinal")):
        patterns.setdefault((r["term_id"], r["role"]), []).append(r["pattern"])
    order = [r["id"] for r in bounded(vocabulary["timepoint_patterns"].orderBy("priority", "id"))]
    fallback = [r["fallback"] for r in bounded(vocabulary.of("cascade", "timepoint").where("fallback is not null"))]
    return Rules(
        [r["step"] for r in bounded(vocabulary["timepoint_steps"].orderBy("ordinal"))],
        [word for word, _ in words.get("unit", [])],
        words,
        [(t, patterns.get((t, "guard"), []), patterns.get((t, "match"), [])) for t in order],
        fallback[0] if fallback else "unspecified",
    )


def _any_of(words: list[str]) -> str:
    """Longest first; a literal alternative each."""
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def without_parentheticals(c: Column, units: list[str]) -> Column:
    """Brackets go, one after the other from the left, as long as a number with a unit is left outside of them."""
    u = _any_of(units)
    dated = rf"(?i)\d+\s*(?:{u})|(?:{u})\s*\d+"
    step = lambda text: stripped(collapsed(F.regexp_replace(text, r"^(.*?)\s*\([^()]*\)(.*)$", "$1 $2")))

    def fold(text: Column, _: Column) -> Column:
        shorter = step(text)
        return F.when(text.rlike(r"\([^()]*\)") & shorter.rlike(dated), shorter).otherwise(text)

    # As many rounds as there are opening brackets.
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - F.length(F.replace(c, F.lit("("), F.lit("")))))
    return F.aggregate(rounds, c, fold)


def split_hyphens(c: Column, units: list[str]) -> Column:
    """'Week-24' and '24-week' get a space for their hyphen."""
    u = _any_of(units)
    return F.regexp_replace(F.regexp_replace(c, rf"(?i)\b({u})-\s*(\d)", "$1 $2"), rf"(?i)(\d)\s*-\s*({u})\b", "$1 $2")


def plain_ordinals(c: Column, units: list[str]) -> Column:
    """'12th week' -> 'week 12'; other ordinals lose their ending."""
    turned = F.regexp_replace(c, rf"(?i)(\d+)(?:st|nd|rd|th)\s+({_any_of(units)})\b", "$2 $1")
    return F.regexp_replace(turned, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")


def expanded(c: Column, words: list[tuple[str, str]]) -> Column:
    """Whole words give way to their values, longest first."""
    for word, value in sorted(words, key=lambda x: (-len(x[0]), x[0])):
        c = F.regexp_replace(c, rf"(?i)\b{re.escape(word)}\b", value.replace("\\", "\\\\").replace("$", r"\$"))
    return c


def prepared(c: Column, rules: Rules) -> Column:
    """The text after all steps, in the vocabulary's order."""
    steps = {
        "drop_uninformative_parentheticals": lambda x: without_parentheticals(x, rules.units),
        "split_hyphenated_units": lambda x: split_hyphens(x, rules.units),
        "normalise_ordinal_timepoints": lambda x: plain_ordinals(x, rules.units),
        "collapse_whitespace": lambda x: stripped(collapsed(x)),
        "normalise_unicode_dashes": plain_signs,
        "normalise_plus_minus": lambda x: F.regexp_replace(x, r"\+\s*/?\s*-", "±"),
        "normalise_list_separators": lambda x: F.translate(x, "、，\\", ",,,"),
        "strip_trailing_punctuation": lambda x: stripped(F.regexp_replace(x, r"[.;]+$", "")),
        "expand_numeral_words": lambda x: expanded(x, rules.words.get("numeral", [])),
        "expand_abbreviations": lambda x: expanded(expanded(x, rules.words.get("typo", [])), rules.words.get("abbreviation", [])),
        "match_case_insensitively": lambda x: x,
    }
    out = F.coalesce(c, F.lit(""))
    for step in rules.steps:
        if step not in steps:
            raise ValueError(f"unknown preparation step: {step}")
        out = steps[step](out)
    return out


def numbered(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """A pattern with its groups' names taken off, and (name without closing digits, group's number) in order."""
    names, number, out, at = [], 0, [], 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?P<(\w+)>", pattern):
        if m.group().startswith("("):
            number += 1
            if m.group(1):
                names.append((re.sub(r"\d+$", "", m.group(1)) or m.group(1), number))
                out.append(pattern[at : m.start()] + "(")
                at = m.end()
    return "".join(out) + pattern[at:], names


def classify(frames: DataFrame, vocabulary: Vocabulary, column: str = "time_frame") -> DataFrame:
    """The distinct texts of a column with timepoint_pattern, prepared, extracted (a map) and match_method ('exact' or null).

    The first term by priority none of whose guards and one of whose patterns is found decides. Of its first
    pattern's named groups those that took part are extracted, in the order of their names, the first of those whose
    names differ in closing digits only.
    """
    rules = load_rules(vocabulary)
    texts = frames.select(F.coalesce(column, F.lit("")).alias(column)).distinct().withColumn("prepared", prepared(F.col(column), rules))
    text, hits = F.col("prepared"), []
    none = F.lit(None).cast("struct<id:string,groups:map<string,string>>")
    for term, guards, patterns in rules.terms:
        free = F.lit(True)
        for g in guards:
            free = free & ~text.rlike(f"(?iu){g}")
        for p in patterns:
            plain, names = numbered(p)
            pairs = [F.struct(F.lit(name).alias("key"), F.regexp_extract(text, f"(?iu){plain}", k).alias("value")) for name, k in names]
            found = F.filter(F.array(*pairs), lambda x: x["value"] != "") if pairs else F.array().cast("array<struct<key:string,value:string>>")
            # The first value of each name: of doubles the later ones are left out.
            firsts = F.aggregate(
                found, F.array().cast("array<struct<key:string,value:string>>"),
                lambda kept, x: F.when(F.exists(kept, lambda y: y["key"] == x["key"]), kept).otherwise(F.array_append(kept, x)),
            )
            hit = F.struct(F.lit(term).alias("id"), F.map_from_entries(F.array_sort(firsts)).alias("groups")).cast("struct<id:string,groups:map<string,string>>")
            hits.append(F.when(free & text.rlike(f"(?iu){plain}"), hit).otherwise(none))
    won = texts.withColumn("w", F.coalesce(*hits, none))
    return won.select(
        column, "prepared", F.coalesce("w.id", F.lit(rules.fallback)).alias("timepoint_pattern"),
        F.when(F.size("w.groups") > 0, F.col("w.groups")).alias("extracted"), F.when(F.col("w").isNotNull(), "exact").alias("match_method"),
    )


def disambiguated(rows: DataFrame, choices: DataFrame, form: str = "form_id") -> DataFrame:
    """Rows (timepoint_pattern, prepared, form) with the preferred pattern where the form asks for it and the text says 'through' or 'up to'."""
    window = F.col("prepared").rlike(r"(?i)\bthrough\b|\bup to\b")
    rule = choices.groupBy(F.col("otherwise").alias("_from"), F.col("form_id").alias("_form")).agg(F.min_by("prefer", "ordinal").alias("_prefer"))
    out = rows.join(checked_broadcast(small(rule)), (F.col("timepoint_pattern") == F.col("_from")) & (F.col(form) == F.col("_form")), "left")
    return out.withColumn("timepoint_pattern", F.when(F.col("_prefer").isNotNull() & window, F.col("_prefer")).otherwise(F.col("timepoint_pattern"))).drop("_from", "_form", "_prefer")
