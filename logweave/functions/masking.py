"""Variable masking: replace variable parts of a line with ``<*>``."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def combined_mask_pattern(masks: Sequence[str], unicode: bool = True) -> str:
    """All masks as one alternation, leftmost alternative first."""
    body = "|".join(f"(?:{m})" for m in masks)
    return ("(?U)" if unicode else "") + body


def mask_variables(col, masks: Sequence[str], unicode: bool = True) -> Column:
    """One pass with every mask joined by alternation (the default)."""
    if not masks:
        return _c(col)
    return F.regexp_replace(_c(col), F.lit(combined_mask_pattern(masks, unicode)), F.lit(WILDCARD))


def mask_sequential(col, masks: Sequence[str], unicode: bool = True) -> Column:
    """One mask after another; later masks see earlier ``<*>`` output."""
    prefix = "(?U)" if unicode else ""
    return reduce(lambda acc, m: F.regexp_replace(acc, F.lit(prefix + m), F.lit(WILDCARD)),
                  masks, _c(col))


def mask_data(masks, unicode: bool = True) -> Column:
    """``combined_mask_pattern`` of an array column of masks (null: no masks)."""
    body = F.array_join(F.transform(_c(masks), lambda m: F.concat(F.lit("(?:"), m, F.lit(")"))), "|")
    return F.when(F.size(_c(masks)) > 0, F.concat(F.lit("(?U)" if unicode else ""), body))


def mask_by_data(col, pattern) -> Column:
    """``mask_variables`` with the pattern in a column; a null pattern masks nothing.  Spark keeps the compiled pattern
    from row to row while it stays the same."""
    return F.when(_c(pattern).isNull(), _c(col)).otherwise(F.regexp_replace(_c(col), _c(pattern), F.lit(WILDCARD)))
