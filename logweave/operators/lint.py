"""Table-level lints: the failure report for a template, prompt rows for a
template proposer, and the changing-unit finder."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions import lints as lt
from logweave.operators.sampling import diverse_sample

# Units, and an anchor word, a number and a unit.
UNIT = "(?:B|KB|MB|GB|TB|PB|G|K|M)"
NUMBER_UNIT = r"[0-9]+(?:\.[0-9]+)?\s+(" + UNIT + r")\b"
UNIT_AFTER_NUMBER = r"([a-zA-Z]{3,})[^a-zA-Z]*?[0-9]+(?:\.[0-9]+)?\s+(" + UNIT + r")\b"


def lint_report(pairs: DataFrame) -> DataFrame:
    """One report row per (template, line) pair: foreign words, partly
    abstracted paths, hard-coded parameters, assembled to text.

    ``pairs``: dataset, line_id, content, template_regex.
    """
    return with_report(pairs.select("dataset", "line_id", "content", "template_regex"))


def with_report(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``content, template_regex`` and any others) with ``foreign_words, untreated_paths, hardcoded, report``."""
    fw = lt.foreign_words("content", "template_regex")
    up = lt.untreated_paths("content", "template_regex")
    hc = F.when(F.col("content").contains("=") | F.col("content").contains(":"),
                lt.hardcoded_params("template_regex")).otherwise(F.array().cast("array<string>"))
    r = pairs.select("*", fw.alias("foreign_words"), up.alias("untreated_paths"), hc.alias("hardcoded"))
    parts = F.concat_ws("\n", F.lit("The template does not fit the line."),
                        F.when(F.size("foreign_words") > 0,
                               F.concat(F.lit("Not in the line: "), F.array_join("foreign_words", ", "))),
                        F.when(F.size("untreated_paths") > 0,
                               F.concat(F.lit("Abstract whole paths: "), F.array_join("untreated_paths", ", "))),
                        F.when(F.size("hardcoded") > 0,
                               F.concat(F.lit("Values kept as constants: "), F.array_join("hardcoded", ", "))))
    return r.withColumn("report", parts)


def prompt_table(groups: DataFrame, sample_size: int = 5, group_col: str = "template",
                 similarity: str = "jaccard") -> DataFrame:
    """Prompt rows per group (no model is called): task text with tips chosen by
    the key=value and path finders over a diverse sample, then the sample.

    Returns ``dataset, group_id, messages ARRAY<STRUCT<role, content>>``.
    """
    s = diverse_sample(groups.select("dataset", F.col(group_col).alias("group_id"), "line_id", "content"),
                       k=sample_size, similarity=similarity, group_cols=("dataset", "group_id"))
    agg = s.groupBy("dataset", "group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "content"))), lambda x: x["content"])
        .alias("sample"))
    kv = F.exists("sample", lambda c: F.size(lt.kv_pairs(c)) > 0)
    path = F.array_join("sample", " ").rlike("(?U)" + lt.PATH_TRIGGER)
    tips = F.concat_ws(" ",
                       F.when(kv, F.lit("Abstract the value of every key=value pair as <*>.")),
                       F.when(path, F.lit("Abstract file paths as <*>.")))
    system = F.concat(F.lit("Abstract all dynamic variables in the logs with <*> and output one template. "), tips)
    user = F.concat(F.lit("Log list: "), F.to_json("sample"))
    msgs = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
    return agg.select("dataset", "group_id", msgs.alias("messages"))


def dynamic_units(lines: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Anchor words whose unit (after a number) changes within a group, over every
    unit of all lines.  Returns group cols + anchor, units, dynamic."""
    g = list(group_cols)
    found = lambda k: F.regexp_extract_all("content", F.lit(UNIT_AFTER_NUMBER), k)
    u = lines.select(*g, F.inline(F.arrays_zip(found(1).alias("anchor"), found(2).alias("unit"))))
    return u.groupBy(*g, "anchor").agg(F.count_distinct("unit").alias("units")) \
        .withColumn("dynamic", F.col("units") > 1)


def leading_units(lines: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Whether the first unit of a line (after a number, commas and dollars removed) changes within a group: for
    units that no word of three letters leads in.  Returns group cols + units, dynamic; groups without units are left out."""
    g = list(group_cols)
    unit = F.regexp_extract(F.translate("content", ",$", ""), NUMBER_UNIT, 1)
    return lines.select(*g, unit.alias("unit")).filter(F.col("unit") != "").groupBy(*g) \
        .agg(F.count_distinct("unit").alias("units")).withColumn("dynamic", F.col("units") > 1)


def abstract_dynamic_units(templates: DataFrame, lines: DataFrame, group_cols: Sequence[str],
                           template_col: str = "template") -> DataFrame:
    """Replace the unit behind an anchor word in a template by ``<*>``, for those
    anchors only whose unit changes within the group; units before the first word of three letters go where the
    first unit of the group's lines changes."""
    g = list(group_cols)
    dyn = dynamic_units(lines, g).filter("dynamic").groupBy(*g).agg(F.sort_array(F.collect_set("anchor")).alias("__anchors"))
    number = r"(?:<\*>|\(\.\*\?\)|\d+(?:\.\d+)?)(?:\.\*)?\s+)" + UNIT + r"\b"
    after = r"\b[^a-zA-Z]*?" + number
    # From the start, or where the last such unit ended, over no word of three letters.
    leading = r"(\G(?:(?!\b[a-zA-Z]{3,}\b).)*?" + number

    def one(text, anchor):
        return F.regexp_replace(text, F.concat(F.lit(r"(\b"), anchor, F.lit(after)), F.lit("$1<*>"))

    anchors = F.coalesce("__anchors", F.array().cast("array<string>"))
    first = leading_units(lines, g).filter("dynamic").select(*g, F.lit(True).alias("__leading"))
    led = F.when(F.col("__leading"), F.regexp_replace(template_col, leading, "$1<*>")).otherwise(F.col(template_col))
    return templates.join(dyn, g, "left").join(first, g, "left").withColumn(template_col, led) \
        .withColumn(template_col, F.aggregate(anchors, F.col(template_col), one)).drop("__anchors", "__leading")
