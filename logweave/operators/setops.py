"""Set operations and grouping helpers: common tokens, small-group flags,
parameter extraction by template."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.matching import PY_FLAGS
from logweave.functions.text import tokenize


def common_tokens(lines: DataFrame, group_cols: Sequence[str], unicode: bool = False) -> DataFrame:
    """Tokens present in every line of a group (intersection of token sets)."""
    g = list(group_cols)
    toks = lines.select(*g, "line_id", F.explode(F.array_distinct(tokenize("content", unicode))).alias("token"))
    n = lines.groupBy(*g).agg(F.count(F.lit(1)).alias("n_lines"))
    per = toks.groupBy(*g, "token").agg(F.count(F.lit(1)).alias("c"))
    return per.join(n, g).filter(F.col("c") == F.col("n_lines")).select(*g, "token")


def flag_small_groups(rows: DataFrame, group_col: str, min_rows: int = 5) -> DataFrame:
    """Adds ``group_rows`` and ``small`` (fewer than ``min_rows`` lines).

    Sizes come from an aggregate joined back (skew-safe), not a window that
    would sort a whole group in one task.
    """
    sizes = rows.groupBy("dataset", group_col).agg(F.count(F.lit(1)).alias("group_rows"))
    return rows.join(sizes, ["dataset", group_col]).withColumn("small", F.col("group_rows") < min_rows)


def split_small_groups(rows: DataFrame, group_col: str, min_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    f = flag_small_groups(rows, group_col, min_rows)
    return f.filter(~F.col("small")).drop("small"), f.filter(F.col("small")).drop("small")


#: Fixed value: a placeholder is one to five characters in angle brackets.
PLACEHOLDER = "<.{1,5}>"


def template_pattern(template) -> F.Column:
    """The anchored pattern of a template: a lazy group for each placeholder, any
    white space for spaces, every other piece literal; null without a placeholder."""
    pieces = F.split(template, PLACEHOLDER, -1)
    literal = F.transform(pieces, lambda x: F.regexp_replace(F.regexp_replace(x, r"([\p{Punct}\n])", r"\\$1"), " +", r"\\s+"))
    return F.when(F.size(pieces) > 1, F.concat(F.lit(PY_FLAGS + "^"), F.array_join(literal, "(.*?)"), F.lit("$")))


def extract_parameters(df: DataFrame, content_col: str = "content", template_col: str = "template") -> DataFrame:
    """Adds ``parameters``: what each placeholder of the line's template stands for; empty if the
    template has none or does not fit the line."""
    pattern, content = template_pattern(F.col(template_col)), F.col(content_col)
    n = F.size(F.split(F.col(template_col), PLACEHOLDER, -1)) - 1
    values = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.call_function("regexp_extract", content, pattern, i))
    return df.withColumn("parameters", F.when(F.regexp_like(content, pattern), values).otherwise(F.array().cast("array<string>")))
