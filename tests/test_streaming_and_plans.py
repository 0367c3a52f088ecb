import pyspark.sql.functions as F

from logweave.operators import pool as pl
from logweave.plans import benchmark as bm
from logweave.sources import corpora
from logweave.streaming import start_matcher
from tests.conftest import SF


def test_stream_matches_like_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = corpora.render_events(spark.readStream.schema(events.schema)
                                    .option("pathGlobFilter", "events.parquet").parquet(SF))
    labels = corpora.event_logs(spark, SF)
    from logweave.functions.templates import template_to_regex
    props = labels.select("dataset", template_to_regex("event_template").alias("template"),
                          F.col("line_id").alias("seq"))
    pool = pl.template_pool(props).cache()
    seen = []

    def sink(df, batch_id):
        seen.append((batch_id, df.filter(F.col("template_regex").isNotNull()).count(), df.count()))

    q = start_matcher(stream, pool, corpora.EVENT_MASKS, sink, str(tmp_path / "ckpt"),
                      trigger={"availableNow": True})
    q.awaitTermination(300)
    total = sum(s[2] for s in seen)
    matched = sum(s[1] for s in seen)
    assert total == events.count()
    assert matched == total


def test_run_dataset_summary(spark):
    ev = corpora.event_logs(spark, SF)
    row = bm.run_dataset(spark, ev.select("dataset", "line_id", "content"), corpora.event_labels(spark, SF),
                         "events", corpora.EVENT_MASKS, depth=4).first()
    assert (row["GA"], row["PA"], row["FGA"], row["FTA"], row["Event_count"]) == (1.0, 1.0, 1.0, 1.0, 5)
    assert row["Total_time"] >= row["Mining_time"]
