"""The literals that a pattern's matches contain: by hand, and that the index never loses a match."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import literals, matching


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"\bgreen\s+apple\b", ["green"]), (r"(?:red|yellow)\s+pear", ["pear"]), (r"\b(?:crimson|yellow)\s+of\b", ["crimson", "yellow"]), (r"colou?r(?:ed|ing)", ["colo"]), (r"a|b", []), (r"abc*", []), (r"abc+d", ["abc"]), (r"(abc)?defg", ["defg"]),
        (r"(?:abcd){0}xyz", ["xyz"]), (r"(?x)a b c d", []), (r"\Qa.b.c\E", ["a.b.c"]), (r"foo(?=quux)", ["foo"]), (r"foo(?!quux)bar", ["foobar"]), (r"[abc]+def[^x\]y]ghij", ["ghij"]), (r"(a)\1bcd", []), (r"STRAẞE|gasse", ["gasse", "stra"]), (r"(?<n>plum)s?", ["plum"]), (r"x{2,}yzw", ["yzw"]),
        (r"(?i)KIWI", ["kiwi"]), (r"un(closed", []), (r"ab\.cd", ["ab.cd"]), (r"", []), (r"p(?:each|lum|ear)", ["each", "ear", "lum"]),
    ],
)
def test_need(pattern, want):
    assert literals.need(pattern) == want


def random_pattern(r, depth=0) -> str:
    kind = r.randint(9 if depth < 3 else 4)
    word = "".join(r.choice(list("abkisKS")) for _ in range(r.randint(1, 5)))
    if kind < 3:
        return word
    if kind == 3:
        return r.choice([r"\s", ".", "[abk]", "[^s]", r"\b", r"\w", "ß", "k\\."])
    inner = "".join(random_pattern(r, depth + 1) for _ in range(r.randint(1, 4)))
    if kind == 4:
        return f"(?:{inner}|{random_pattern(r, depth + 1)})"
    if kind == 5:
        return f"({inner})" + r.choice(["", "?", "*", "+", "{2}", "{0,1}", "{1}", "+?"])
    if kind == 6:
        return word + r.choice(["?", "*", "+", "{1,2}", "{0}"]) + inner
    if kind == 7:
        return r.choice(["(?=", "(?!", "(?<=a)(?:"]) + inner + ")" + word
    return inner


def test_the_index_never_loses_a_match(spark):
    """Random patterns and texts (with the letters that match others where case is ignored): the same pairs as all against all."""
    r = np.random.RandomState(3)
    patterns = sorted({random_pattern(r) for _ in range(400)})
    texts = sorted({"".join(r.choice(list("abkisABKIS \u017f\u0131\u0130\u212aß.")) for _ in range(r.randint(0, 14))) for _ in range(250)} | {"", "ab", "KIS", "abkis" * 3})
    t = spark.createDataFrame([(str(k), x) for k, x in enumerate(texts)], "text_id string, text string")
    rules = spark.createDataFrame([(str(k), p) for k, p in enumerate(patterns)], "term_id string, pattern string")
    every = t.join(rules).where(F.expr("regexp_substr(text, concat('(?iu)', pattern)) is not null"))
    want = {(x["text_id"], x["term_id"]) for x in every.collect()}
    found = [(x["text_id"], x["term_id"]) for x in matching.tag_patterns(t, rules).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 2000
    with_need = [p for p in patterns if literals.need(p)]
    assert len(with_need) > 60
    met = literals.candidates(t, "text", with_need).count()
    assert met < 0.2 * len(with_need) * len(texts)


def test_no_patterns_and_no_texts(spark):
    t = spark.createDataFrame([("1", "abc")], "text_id string, text string")
    none = spark.createDataFrame([], "term_id string, pattern string")
    assert matching.tag_patterns(t, none).count() == 0
    assert matching.tag_patterns(t.limit(0), spark.createDataFrame([("x", "abc"), ("y", "a"), ("z", None)], none.schema)).count() == 0
