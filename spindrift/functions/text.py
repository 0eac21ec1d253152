"""Text as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as a dash or as a quote.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"


def collapsed(c: Column) -> Column:
    """Runs of any white space become one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_signs(c: Column) -> Column:
    """Unicode dashes become hyphens, curly quotes straight ones."""
    signs = DASHES + SINGLE_QUOTES + DOUBLE_QUOTES
    plain = "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES)
    return F.translate(c, signs, plain)


def unescaped(c: Column) -> Column:
    """Markdown escapes lose their backslash."""
    return F.regexp_replace(c, r"\\([<>\[\]()*_`~\\])", "$1")


def normalised(c: Column) -> Column:
    """The steps above in order; null becomes the empty text; case is kept."""
    return unescaped(plain_signs(stripped(collapsed(F.coalesce(c, F.lit(""))))))


def key(c: Column) -> Column:
    """For comparisons: lower case, white space collapsed; empty becomes null."""
    return F.nullif(F.lower(stripped(collapsed(c))), F.lit(""))


def folded(c: Column) -> Column:
    """An enumeration's value: lower case, runs of other characters than a-z and 0-9 become one underscore; null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def folded_type(c: Column) -> Column:
    """An arm's or intervention's type: lower case, runs of white space and hyphens become one underscore; empty becomes null."""
    return F.nullif(F.regexp_replace(F.lower(stripped(c)), r"(?U)[\s\-]+", "_"), F.lit(""))


def stem(title_key: Column) -> Column:
    """A title's key without a closing 'arm', 'group' or 'cohort'."""
    return F.regexp_replace(title_key, r"\s+(arm|group|cohort)$", "")


def short_capitals(c: Column) -> Column:
    """Whether a term is of capitals, with a letter, and five characters at most."""
    return (F.upper(c) == c) & (F.lower(c) != c) & (F.length(c) <= 5)


def content_id(*columns: Column) -> Column:
    """The MD5 of the columns' texts joined by bars; null counts as empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def first_of(c: Column, markers: list[tuple[str, tuple[str, ...]]], otherwise: str) -> Column:
    """The first kind one of whose markers the text contains."""
    out = None
    for kind, texts in markers:
        hit = F.lit(False)
        for text in texts:
            hit = hit | c.contains(text)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(otherwise)
