"""Template normalisers used before scoring.

The two sides are deliberately not symmetric: only the prediction side drops
backslashes and ``(.*?)``; only the label side drops ``<*>`` and its quotes.
Convert ``<*>`` predictions to regex form first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normaliser rules, applied in this order.
TRUTH_RULES = [
    (r"\s+", ""),
    (r"'<\*>'", "<*>"),
    (r"<\*>", ""),
    (r",", ""),
    (r":", ""),
    (r"\$", ""),
    (r"\+", ""),
    (r"\[\s*\]", ""),
    (r"\(\)", ""),
]
PRED_RULES = [
    (r"\s+", ""),
    (r"\(\.\*\?\)", ""),
    (r"\\", ""),
    (r",", ""),
    (r":", ""),
    (r"\$", ""),
    (r"\+", ""),
    (r"\[\s*\]", ""),
    (r"\(\)", ""),
]
# Runs of two or more dots become an ellipsis; a token tail of dots and digits
# ("...12") and a "+0x..(/0x..)" offset are normalised the same way.
ELLIPSIS = (r"\.{2,}", "...")
ELLIPSIS_DIGITS = (r"\.{2,}\d+$", "...")
HEX_OFFSET = (r"\+0x[0-9a-fA-F]+(?:/0x[0-9a-fA-F]+)?", "+")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _chain(col: Column, rules) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, F.lit("(?U)" + r[0]), F.lit(r[1])), rules, col)


def normalise_truth(col) -> Column:
    return _chain(_c(col), TRUTH_RULES)


def normalise_pred(col) -> Column:
    return _chain(_c(col), PRED_RULES)


def normalise_ellipsis(col) -> Column:
    return _chain(_c(col), [ELLIPSIS])


def normalise_token(col) -> Column:
    return _chain(_c(col), [ELLIPSIS_DIGITS, HEX_OFFSET])
