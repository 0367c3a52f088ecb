"""End-to-end plan per dataset: read -> mine -> parse -> score -> summary row.

All datasets of a run are one Spark job keyed by ``dataset``; per-phase
wall-clock times are measured around the actions that finish each phase.
"""

from __future__ import annotations

import time
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import accuracy as acc
from logweave.operators import mining, verify
from logweave.sources import sinks

SUMMARY_COLUMNS = ["Dataset", "Total_time", "Parse_time", "Mining_time", "Matching_time",
                   "Split_time", "GA", "PA", "FGA", "FTA", "Event_count"]


def run_dataset(spark: SparkSession, lines: DataFrame, labels: DataFrame, dataset: str,
                masks: Sequence[str], depth: int, st: float = 0.5, proposer=None,
                out_path: str | None = None) -> DataFrame:
    """Mine, parse and score one dataset; returns its summary row."""
    t0 = time.time()
    groups = mining.mine_templates(lines, masks, depth=depth, st=st).persist(StorageLevel.MEMORY_AND_DISK)
    groups.count()
    t_mine = time.time() - t0
    t1 = time.time()
    parsed = verify.parse_logs(groups, masks, proposer=proposer).persist(StorageLevel.MEMORY_AND_DISK)
    parsed.count()
    t_parse = time.time() - t1
    if out_path:
        sinks.write_results(parsed.drop("history"), out_path)
    scores = acc.evaluate(parsed.select("dataset", "line_id", "content", "template_regex"), labels,
                          template_col="template_regex", regex_form=True).first()
    total = time.time() - t0
    row = [(dataset, float(total), float(t_parse), float(t_mine), 0.0, 0.0,
            float(scores["ga"]), float(scores["pa"]), float(scores["fga"]), float(scores["fta"]),
            int(scores["event_count"]))]
    groups.unpersist()
    parsed.unpersist()
    return spark.createDataFrame(row, "Dataset string, Total_time double, Parse_time double, Mining_time double, "
                                      "Matching_time double, Split_time double, GA double, PA double, FGA double, "
                                      "FTA double, Event_count long")


def scores_table(parsed: DataFrame, labels: DataFrame) -> DataFrame:
    """Accuracy of already parsed lines (regex-form templates) per dataset."""
    return acc.evaluate(parsed.select("dataset", "line_id", "content", "template_regex"), labels,
                        template_col="template_regex", regex_form=True)


def upsert_summary(existing: DataFrame | None, new_rows: DataFrame, order: Sequence[str]) -> DataFrame:
    seq = F.lit(int(time.time() * 1000))
    new = new_rows.withColumn("seq", seq)
    if existing is None:
        existing = new.limit(0)
    return sinks.summary_upsert(existing, new, order)
