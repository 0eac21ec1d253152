"""Numbers as Column expressions: strict parsing, p-values, the normal distribution's quantiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

# The coefficients of Acklam's rational approximation to the inverse normal distribution function.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = "0.02425e0"


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def normal_quantile_sql(p: str) -> str:
    """SQL for the normal quantile of ``p`` in (0, 1), good to about 1e-9; the same text for any engine."""
    q, r = f"({p} - 0.5e0)", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda x: f"({_horner(x, C)} / {_horner(x, (*D, 1.0))})"
    return (
        f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {LOW} THEN {tail(low)} "
        f"WHEN {p} > 1 - {LOW} THEN -{tail(high)} ELSE {q} * {_horner(r, A)} / {_horner(r, (*B, 1.0))} END)"
    )


def normal_quantile(p: str) -> Column:
    """The same as a Column of an expression's text."""
    return F.expr(normal_quantile_sql(p))


def strict(c: Column) -> Column:
    """A number only where the whole text is one; thousands may have commas ("1,204"; not "NA", "<0.001" or "99.9%")."""
    text = stripped(c)
    return F.when(text.rlike(r"^[+-]?(\d{1,3}(,\d{3})+|\d+)?(\.\d+)?([eE][+-]?\d+)?$") & text.rlike(r"\d"), F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


P_VALUE = r"^\s*(<=|>=|<|>|=|≤|≥)?\s*((\d+)?\.?\d+([eE][+-]?\d+)?)\s*$"


def p_modifier(c: Column) -> Column:
    """The sign in front of a p-value, if any."""
    return F.nullif(F.regexp_extract(c, P_VALUE, 1), F.lit(""))


def p_number(c: Column) -> Column:
    return F.regexp_extract(c, P_VALUE, 2).try_cast("double")


def truth(c: Column) -> Column:
    """yes, true, t, y, 1 and no, false, f, n, 0, in any case; null otherwise."""
    token = F.lower(stripped(c))
    return F.when(token.isin("yes", "true", "t", "y", "1"), True).when(token.isin("no", "false", "f", "n", "0"), False)


def share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of)


def month_date(c: Column) -> Column:
    """A date; 'YYYY-MM' is its first day."""
    return F.when(F.length(c) == 7, F.concat(c, F.lit("-01"))).otherwise(c).try_cast("date")
