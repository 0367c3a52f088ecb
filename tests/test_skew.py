"""One key holding a third of all rows: results stay whole and exact."""

from pyspark.sql import functions as F

from logweave.operators import accuracy as acc, mining, pool as pl, sampling as smp


def _skewed(spark, n=3000):
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append(("d", i, "heartbeat ok from node 7"))
        else:
            rows.append(("d", i, f"job {i} finished in {i % 50} ms on node {i % 11}"))
    return spark.createDataFrame(rows, "dataset string, line_id long, content string").repartition(6)


def test_mining_and_matching_with_hot_key(spark):
    lines = _skewed(spark)
    g = mining.mine_templates(lines, [r"[0-9]+"], depth=2)
    counts = {r["template"]: r["occurrences"] for r in mining.event_counts(g).collect()}
    assert counts["heartbeat ok from node <*>"] == 1000
    assert counts["job <*> finished in <*> ms on node <*>"] == 2000
    from logweave.functions.templates import template_to_regex
    props = mining.event_counts(g).select("dataset", template_to_regex("template").alias("template"),
                                          F.lit(1).cast("long").alias("seq"))
    matched = pl.match_templates(lines, pl.template_pool(props))
    assert matched.count() == 3000
    assert matched.filter(F.col("template_regex").isNull()).count() == 0


def test_top_k_and_scores_with_hot_key(spark):
    lines = _skewed(spark)
    capped = smp.group_cap(lines.withColumn("g", F.col("content").startswith("heartbeat")), ["g"], 10,
                           smp.hash_order(0))
    assert capped.groupBy("g").count().orderBy("g").collect()[0]["count"] == 10
    pairs = lines.select("dataset", F.col("content").alias("pred"), F.col("content").alias("truth"))
    r = acc.accuracy_from_pairs(pairs).first()
    assert r["pa"] == 1.0 and r["ga"] == 1.0
