"""Column-expression helpers (dates, text, rounding and money formatting)."""
