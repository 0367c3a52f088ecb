"""Log corpora derived from the driver's parquet tables.

Every corpus has the log schema ``dataset STRING, line_id LONG, content STRING``
(plus optional label columns) and grows with the tables it is read from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Lines per document are numbered doc_id * DOC_LINE_STRIDE + position (0-based).
DOC_LINE_STRIDE = 1_000_000
# Masks for the rendered event log, in order: IPv4, decimal, integer.
EVENT_MASKS = [r"([0-9]+\.){3}[0-9]+", r"[0-9]+\.[0-9]+", r"[0-9]+"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` rendered as log lines, with the true template as label.

    content = ``user <user_id> <event_type> value=<value> from 10.0.<u%256>.<e%256> props <props>``
    """
    return render_events(_table(spark, sf_dir, "events"))


def render_events(events: DataFrame) -> DataFrame:
    """Render an ``events`` frame (batch or stream) as labelled log lines."""
    ev = events.select("event_id", "user_id", "event_type", "value", "props")
    value = F.col("value").cast("decimal(18,2)").cast("string")
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                  (F.col("event_id") % 256).cast("string"))
    content = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"),
                       F.lit(" value="), value, F.lit(" from "), ip, F.lit(" props "), F.col("props"))
    label = F.concat(F.lit("user <*> "), F.col("event_type"), F.lit(' value=<*> from <*> props {"k": <*>}'))
    return ev.select(F.lit("events").alias("dataset"), F.col("event_id").cast("long").alias("line_id"),
                     content.alias("content"), label.alias("event_template"), "event_type", "user_id")


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of ``event_logs`` in the label schema."""
    return event_logs(spark, sf_dir).select("dataset", "line_id", "content", "event_template")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents.text`` split on newline; one row per line, whole texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.select(
        F.lit("documents").alias("dataset"), "doc_id", "lang",
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "content"),
    ).select("dataset", (F.col("doc_id") * DOC_LINE_STRIDE + F.col("pos")).cast("long").alias("line_id"),
             "content", "doc_id", "lang")


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as log lines keyed by role."""
    cv = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return cv.select(F.concat(F.lit("conversations:"), F.col("role")).alias("dataset"),
                     (F.col("conv_id") * DOC_LINE_STRIDE + F.col("turn")).cast("long").alias("line_id"),
                     F.col("text").alias("content"), "role")


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("dataset"), F.col("page_id").cast("long").alias("line_id"),
        F.col("url").alias("content"))


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rendered as shipping log lines (the large corpus at sf0.1)."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    content = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" line "),
                       F.col("l_linenumber").cast("string"), F.lit(" part "), F.col("l_partkey").cast("string"),
                       F.lit(" qty="), F.col("l_quantity").cast("decimal(18,2)").cast("string"),
                       F.lit(" status "), F.col("l_returnflag"), F.col("l_linestatus"))
    return li.select(F.lit("lineitem").alias("dataset"),
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("line_id"),
                     content.alias("content"))
