"""Tokenising and small text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(col, unicode: bool = True) -> Column:
    """Whitespace tokens with empties removed (an empty line has no tokens).

    ``unicode=True`` uses Java's Unicode whitespace class, which is what a
    Python ``str.split()`` sees for ordinary text; ``False`` keeps the ASCII
    class, which equals DuckDB/RE2's ``\\s``.
    """
    rx = "(?U)\\s+" if unicode else "[ \\t\\n\\r\\f\\x0B]+"
    return F.filter(F.split(_c(col), rx), lambda t: t != F.lit(""))


def pattern_key(tokens) -> Column:
    """Whitespace-normalised text of a token array (the mined pattern)."""
    return F.array_join(_c(tokens), " ")


def word_count(col, unicode: bool = True) -> Column:
    return F.size(tokenize(col, unicode))


def char_count(col, ch: str) -> Column:
    """Number of occurrences of a literal character."""
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def has_digit(col, unicode: bool = True) -> Column:
    return _c(col).rlike("\\p{Nd}" if unicode else "[0-9]")


def jaccard_sets(a, b) -> Column:
    """Set Jaccard similarity of two token arrays (1.0 when both are empty)."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / union)
