"""Column expressions: text folding, numbers as text, normal quantiles."""
