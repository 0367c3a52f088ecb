"""Scoring against labels: grouping accuracy (GA), parsing accuracy (PA),
F1 of groups (FGA) and of templates (FTA), and the predicted event count.

Everything is two aggregations and one join of aggregates:

* per predicted template: lines, distinct labels, the (only) label;
* per label: lines;
* a predicted group is correct when it has exactly one label and that label
  has the same number of lines; template-correct when the strings also agree.

F1 = 2a / (n_pred + n_truth) because precision = a/n_pred, recall = a/n_truth.
Predictions and labels are normalised first (asymmetric rules, see
``logweave.functions.normalise``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.normalise import normalise_pred, normalise_truth
from logweave.functions.templates import template_to_regex


def align_labels(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = ("dataset", "line_id")) -> DataFrame:
    """Full outer join of predictions and labels on the line key.

    ``pred``: keys + content + pred_template (regex form); ``truth``: keys +
    content + event_template.  Adds ``content_ok`` (both sides present and equal).
    """
    p = pred.select(*keys, F.col("content").alias("p_content"), "pred_template")
    t = truth.select(*keys, F.col("content").alias("t_content"), "event_template")
    j = p.join(t, list(keys), "full_outer")
    return j.withColumn("content_ok", F.coalesce(F.col("p_content") == F.col("t_content"), F.lit(False)))


def alignment_report(aligned: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Counts that the reference asserts on: rows per side and content mismatches."""
    return aligned.groupBy(*by).agg(
        F.count("p_content").alias("pred_rows"),
        F.count("t_content").alias("truth_rows"),
        F.sum(F.when(~F.col("content_ok"), 1).otherwise(0)).alias("content_mismatch"))


def semi_align(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = ("dataset", "line_id")):
    """Keep only keys present on both sides (two semi-joins)."""
    k = list(keys)
    return pred.join(truth.select(*k), k, "left_semi"), truth.join(pred.select(*k), k, "left_semi")


def normalised_pairs(aligned: DataFrame) -> DataFrame:
    """``pred``/``truth`` normalised template strings per line."""
    return aligned.withColumn("pred", normalise_pred("pred_template")) \
        .withColumn("truth", normalise_truth("event_template"))


def accuracy_from_pairs(pairs: DataFrame, by: Sequence[str] = ("dataset",),
                        pred_col: str = "pred", truth_col: str = "truth",
                        weight_col: str | None = None) -> DataFrame:
    """GA, PA, FGA, FTA and event count per ``by`` from (pred, truth) rows.

    Rows are lines, or distinct (pred, truth) pairs with a line count in
    ``weight_col``; every formula only needs these counts.
    """
    by = list(by)
    w = F.col(weight_col) if weight_col else F.lit(1)
    ev = pairs.select(*by, F.col(pred_col).alias("p"), F.col(truth_col).alias("g"), w.cast("long").alias("w"))
    pg = ev.filter(F.col("p").isNotNull()).groupBy(*by, "p").agg(
        F.sum("w").alias("n"), F.count_distinct("g").alias("k"), F.min("g").alias("g1"))
    tg = ev.filter(F.col("g").isNotNull()).groupBy(*by, "g").agg(F.sum("w").alias("n_t"))
    j = pg.join(tg.withColumnRenamed("g", "g1"), by + ["g1"], "left")
    ok = (F.col("k") == 1) & (F.col("n") == F.col("n_t"))
    s = j.groupBy(*by).agg(
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("ae"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("ag"),
        F.sum(F.when(ok & (F.col("p") == F.col("g1")), 1).otherwise(0)).alias("att"),
        F.count(F.lit(1)).alias("np"))
    nt = tg.groupBy(*by).agg(F.count(F.lit(1)).alias("nt"))
    c = ev.groupBy(*by).agg(F.sum("w").alias("n_lines"),
                            F.sum(F.when(F.col("p") == F.col("g"), F.col("w")).otherwise(0)).alias("m"))
    r = c.join(s, by, "left").join(nt, by, "left").fillna(0, subset=["ae", "ag", "att", "np", "nt"])
    denom = F.col("np") + F.col("nt")
    return r.select(
        *by,
        (F.col("ae") / F.col("n_lines")).alias("ga"),
        (F.col("m") / F.col("n_lines")).alias("pa"),
        F.when(denom > 0, 2.0 * F.col("ag") / denom).otherwise(F.lit(0.0)).alias("fga"),
        F.when(denom > 0, 2.0 * F.col("att") / denom).otherwise(F.lit(0.0)).alias("fta"),
        F.col("np").cast("long").alias("event_count"))


def evaluate(parsed: DataFrame, labels: DataFrame, by: Sequence[str] = ("dataset",),
             template_col: str = "template", regex_form: bool = False) -> DataFrame:
    """Score parsed lines against labels.

    ``parsed``: dataset, line_id, content, template (``<*>`` form unless
    ``regex_form``); ``labels``: dataset, line_id, content, event_template.
    One pass over the lines: align on the line key, count lines per distinct
    (predicted template, label template) pair (map-side partial aggregation),
    then convert and normalise only those pairs.
    """
    pred = parsed.select("dataset", "line_id", "content", F.col(template_col).alias("pred_template"))
    counts = align_labels(pred, labels).groupBy(*by, "pred_template", "event_template") \
        .agg(F.count(F.lit(1)).alias("lines"))
    pt = F.col("pred_template") if regex_form else template_to_regex(F.col("pred_template"))
    pairs = counts.withColumn("pred", normalise_pred(pt)).withColumn("truth", normalise_truth("event_template"))
    return accuracy_from_pairs(pairs, by, weight_col="lines")
