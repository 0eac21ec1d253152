"""What every match of a regular expression must contain: literals from the pattern's syntax tree, for a prefilter by index.

A pattern's *need* is a set of lower-case literals one of which is in every match, whatever the case. Texts are folded the
same way (:func:`folded_text`). What the parser does not understand makes the need unknown, never wrong.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a literal at least, and of the grams that the index is made of.
GRAM = 3
#: Characters outside of ASCII that match an ASCII letter where case is ignored, and that letter.
ODD, PLAIN = "\u017f\u0131\u0130\u212a", "siik"
_ZERO_WIDTH, _LITERAL_SIGNS = "bBAzZG", set("\\.[]{}()*+?^$|/-_&%#@!~\"'=<>,:; ")


class _Unknown(ValueError):
    pass


class _Parser:
    """A node is (exact, need): the text that it matches and nothing else, or None; and its need, or None."""

    def __init__(self, pattern: str):
        self.s, self.at = pattern, 0

    def peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.s):
            raise _Unknown
        self.at += 1
        return self.s[self.at - 1]

    def alternatives(self) -> tuple[str | None, frozenset[str] | None]:
        found = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            found.append(self.sequence())
        if len(found) == 1:
            return found[0]
        needs = [need for _, need in found]
        return None, (None if None in needs else frozenset().union(*needs))

    def sequence(self) -> tuple[str | None, frozenset[str] | None]:
        run, only, needs = "", True, []

        def close() -> None:
            nonlocal run
            if len(run) >= GRAM:
                needs.append(frozenset([run]))
            run = ""

        while self.peek() not in ("", "|", ")"):
            exact, need = self.atom()
            least, most = self.quantifier()
            if (least, most) == (1, 1) and exact is not None:
                run += exact
                continue
            only = False
            if least and exact is not None:  # once more at least, beside what is before it
                run += exact
            close()
            if least and need is not None:
                needs.append(need)
        whole = run if only else None
        close()
        return whole, max(needs, key=lambda n: (min(map(len, n)), -len(n), sorted(n)), default=None)

    def quantifier(self) -> tuple[int, int]:
        c, out = self.peek(), (1, 1)
        if c and c in "*+?":
            self.at += 1
            out = {"*": (0, 2), "+": (1, 2), "?": (0, 1)}[c]
        elif c == "{":
            inner, _, rest = self.s[self.at + 1 :].partition("}")
            low, _, high = inner.partition(",")
            if not low.isdigit() or (high and not high.isdigit()):
                raise _Unknown
            self.at = len(self.s) - len(rest)
            out = (int(low), 1 if inner == "1" else 2)
        else:
            return out
        if self.peek() and self.peek() in "+?":  # possessive or lazy
            self.at += 1
        return out

    def atom(self) -> tuple[str | None, frozenset[str] | None]:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            self.classes()
            return None, None
        if c in "^$":
            return "", None
        if c == ".":
            return None, None
        if c == "\\":
            return self.escape()
        if c in "*+?{":
            raise _Unknown
        return (c.lower() if c.isascii() else None), None

    def escape(self) -> tuple[str | None, frozenset[str] | None]:
        c = self.take()
        if c in _ZERO_WIDTH:
            return "", None
        if c == "Q":
            text, _, _ = self.s[self.at :].partition("\\E")
            self.at = min(len(self.s), self.at + len(text) + 2)
            # A quantifier behind it would be the last letter's alone.
            return None, (frozenset([text.lower()]) if text.isascii() and len(text) >= GRAM and not (self.peek() and self.peek() in "*?{") else None)
        if c in _LITERAL_SIGNS:
            return c, None
        if c in "dDsSwWhHvVRXtnrfae":
            return None, None
        raise _Unknown

    def classes(self) -> None:
        """Over a character class, with the ones inside it."""
        if self.peek() == "^":
            self.at += 1
        if self.peek() == "]":
            self.at += 1
        while (c := self.take()) != "]":
            if c == "\\":
                if self.take() == "Q":
                    raise _Unknown
            elif c == "[":
                self.classes()

    def group(self) -> tuple[str | None, frozenset[str] | None]:
        zero_width = False
        if self.peek() == "?":
            self.at += 1
            c = self.take()
            if c in "=!":
                zero_width = True
            elif c == "<":
                if self.peek() and self.peek() in "=!":
                    self.at, zero_width = self.at + 1, True
                else:
                    while self.take() != ">":
                        pass
            elif c not in ":>":
                flags = c
                while (c := self.take()) not in ":)":
                    flags += c
                if set(flags) - set("iu-sm"):
                    raise _Unknown
                if c == ")":
                    return "", None
        out = self.alternatives()
        if self.take() != ")":
            raise _Unknown
        return ("", None) if zero_width else out


def need(pattern: str) -> list[str]:
    """The literals one of which every match contains, sorted; none where that isn't known."""
    parser = _Parser(pattern)
    try:
        found = parser.alternatives()[1]
        if parser.at < len(pattern):
            raise _Unknown
    except _Unknown:
        return []
    return sorted(found) if found and min(map(len, found)) >= GRAM else []


def folded_text(text: Column) -> Column:
    return F.lower(F.translate(text, ODD, PLAIN))


def grams(text: Column) -> Column:
    """The distinct grams of a folded text."""
    each = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda k: F.substring(text, k, GRAM))
    return F.when(F.length(text) >= GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def index_of(patterns: list[str]) -> tuple[pa.Table, list[str]]:
    """(gram, literal, before, pattern), a row for each literal of each pattern's need; and the patterns without one.

    A literal stands under the one of its grams that fewest literals have; ``before`` are the pattern's literals that are listed before it.
    """
    needs = {p: need(p) for p in patterns}
    of = lambda x: {x[i : i + GRAM] for i in range(len(x) - GRAM + 1)}
    common = Counter(g for literals in needs.values() for x in literals for g in of(x))
    rows = [(min(of(x), key=lambda g: (common[g], g)), x, literals[:k], p) for p, literals in needs.items() for k, x in enumerate(literals)]
    kinds = {"gram": pa.string(), "literal": pa.string(), "before": pa.list_(pa.string()), "pattern": pa.string()}
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)}), [p for p, x in needs.items() if not x]


def candidates(texts: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """``texts`` with ``pattern``: each pattern that may match the text, once.

    The texts' grams meet the index by equality; only the patterns without a known literal, which are few, meet all texts.
    """
    spark = texts.sparkSession
    table, bare = index_of(patterns)
    out = None
    if table.num_rows:
        keyed = texts.withColumn("_folded", folded_text(F.col(column)))
        met = keyed.withColumn("gram", F.explode(grams(F.col("_folded")))).join(F.broadcast(spark.createDataFrame(table)), "gram")  # its rows are bounded by the caller
        first = ~F.exists("before", lambda x: F.contains(F.col("_folded"), x))
        out = met.where(F.contains("_folded", "literal") & first).select(*texts.columns, "pattern")
    if bare or out is None:
        left = texts.join(F.broadcast(spark.createDataFrame(pa.table({"pattern": pa.array(bare, pa.string())}))))
        out = left if out is None else out.unionByName(left)
    return out
