"""Template-table operators: repair and collapse wildcards until no row changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.templates import QUOTED_WILDCARD, _rx, collapse_pass, fix_wildcards
from logweave.session import cut_lineage


#: Collapse passes on a row before it is written.
PASSES = 16


def _passes(col: str, unicode: bool) -> Column:
    """``struct(cur, prev)`` after up to ``PASSES`` passes; both are equal once a pass changes nothing."""
    def step(at, _):
        return F.when(at["cur"].eqNullSafe(at["prev"]), at).otherwise(F.struct(collapse_pass(at["cur"], unicode).alias("cur"), at["cur"].alias("prev")))
    first = F.struct(collapse_pass(col, unicode).alias("cur"), F.col(col).alias("prev"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(PASSES)), first, step)


def collapse_to_fixpoint(templates: DataFrame, col: str = "template", unicode: bool = True) -> DataFrame:
    """Apply the collapse rules to a template table until no row changes.

    Only distinct templates are processed.  A round runs up to ``PASSES`` passes on a row, until one changes nothing, and a further
    round only has the rows that still change.  Every rule shortens the text, so the rounds end; there is no limit to them.
    """
    moving = templates.select(col).distinct().withColumn("__cur", F.col(col))
    settled = None
    while True:
        step = cut_lineage(moving.select(col, _passes("__cur", unicode).alias("__at")).select(col, F.col("__at.cur").alias("__cur"),
                                         F.col("__at.cur").eqNullSafe(F.col("__at.prev")).alias("__same")))
        still = step.filter("__same").select(col, "__cur")
        settled = still if settled is None else settled.unionByName(still)
        moving = step.filter("not __same").select(col, "__cur")
        if moving.isEmpty():
            break
    final = settled.select(F.col(col).alias("__key"), _rx(F.col("__cur"), QUOTED_WILDCARD[0], QUOTED_WILDCARD[1], unicode).alias("__out"))
    joined = templates.join(final, templates[col].eqNullSafe(final["__key"]), "left")
    return joined.withColumn(col, F.col("__out")).drop("__key", "__out")


def repair_templates(templates: DataFrame, col: str = "template", **kw) -> DataFrame:
    """Wildcard repair (once) followed by collapse to a fixpoint."""
    fixed = templates.withColumn(col, fix_wildcards(F.col(col)))
    return collapse_to_fixpoint(fixed, col, **kw)
