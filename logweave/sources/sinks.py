"""Writers: parse results, group files with counts, the per-dataset summary."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def valid_results(df: DataFrame, id_col: str = "line_id") -> DataFrame:
    """Keep rows whose id is an integer, typed as LONG."""
    return df.withColumn(id_col, F.expr(f"try_cast(`{id_col}` as long)")).filter(F.col(id_col).isNotNull())


def write_results(df: DataFrame, path: str, fmt: str = "parquet", sort: bool = True,
                  mode: str = "overwrite") -> None:
    """One write per job, partitioned by dataset; range-sorted by id if asked."""
    out = valid_results(df)
    if sort:
        out = out.repartitionByRange("dataset", "line_id").sortWithinPartitions("dataset", "line_id")
    writer = out.write.mode(mode).partitionBy("dataset")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def dedup_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows with their multiplicity as ``count``."""
    cols = list(columns) if columns else [c for c in df.columns if c != "count"]
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def append_counted(df: DataFrame, path: str, write_id: str, columns: Sequence[str] | None = None) -> bool:
    """Add the counted rows of ``df`` (``dedup_count``) to the table of counted rows at ``path``.

    Each write has a folder of its own, named by ``write_id``, and counts once its job has ended: a write that
    failed half-way is not read and is replaced when the job runs again, and a write that has ended is not made twice.
    Earlier rows are neither read nor rewritten.  Returns whether rows were written now.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", write_id):
        raise ValueError(f"not a write id: {write_id!r}")
    folder = f"{path.rstrip('/')}/write-{write_id}"
    if folder.rsplit("/", 1)[1] in _ended_writes(df.sparkSession, path):
        return False
    dedup_count(df, columns).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
    return True


def read_counted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all ended writes at ``path``, each once, with its counts added up as ``count``."""
    names = _ended_writes(spark, path)
    if not names:
        raise FileNotFoundError(f"no ended write in {path}")
    rows = spark.read.parquet(*[f"{path.rstrip('/')}/{name}" for name in sorted(names)])
    return rows.groupBy(*[c for c in rows.columns if c != "count"]).agg(F.sum("count").alias("count"))


def _ended_writes(spark: SparkSession, path: str) -> set[str]:
    """Names of the write folders that hold the mark of an ended job, in whatever store ``path`` is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "write-*/_SUCCESS"))
    return {f.getPath().getParent().getName() for f in (found or [])}


def summary_upsert(existing: DataFrame, new_rows: DataFrame, order: Sequence[str],
                   seq_col: str = "seq") -> DataFrame:
    """Append summary rows, keep the last per dataset, order by a fixed list and
    drop datasets not in it.  Rows need a ``seq`` giving insertion order."""
    spark = new_rows.sparkSession
    both = existing.unionByName(new_rows, allowMissingColumns=True)
    w = Window.partitionBy("Dataset").orderBy(F.col(seq_col).desc())
    last = both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    ranks = spark.createDataFrame([(d, i) for i, d in enumerate(order)], "Dataset string, __rank int")
    return last.join(F.broadcast(ranks), "Dataset").orderBy("__rank").drop("__rank")
