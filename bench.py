"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is forced to run completely with a ``noop`` write.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from logweave.operators import accuracy as acc  # noqa: E402
from logweave.operators import mining, pool, verify  # noqa: E402
from logweave.plans import catalog as C  # noqa: E402
from logweave.session import get_session  # noqa: E402
from logweave.sources import corpora  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ORDER_MASKS = [r"[0-9]+\.[0-9]+", r"[0-9]+"]


def q_pattern_counts(spark, sf):
    return mining.pattern_counts(corpora.doc_lines(spark, sf), C.EVENT_MASKS)


def q_mine_events(spark, sf):
    return mining.event_counts(mining.mine_templates(corpora.event_logs(spark, sf), C.EVENT_MASKS, depth=4))


def q_mine_documents(spark, sf):
    return mining.mine_templates(corpora.doc_lines(spark, sf), [r"[0-9]+"], depth=3)


def q_mine_orders(spark, sf):
    return mining.event_counts(mining.mine_templates(corpora.order_logs(spark, sf), ORDER_MASKS, depth=4))


def q_accuracy(spark, sf):
    ev = corpora.event_logs(spark, sf)
    return acc.evaluate(mining.mine_templates(ev, C.EVENT_MASKS, depth=4), corpora.event_labels(spark, sf))


def q_match_templates(spark, sf):
    return C.QUERIES["match_templates"](spark, sf)


def q_parse_events(spark, sf):
    g = mining.mine_templates(corpora.event_logs(spark, sf), C.EVENT_MASKS, depth=4)
    return verify.parse_logs(g, C.EVENT_MASKS)


def q_parse_documents(spark, sf):
    g = mining.mine_templates(corpora.doc_lines(spark, sf), [r"[0-9]+"], depth=3)
    return verify.parse_logs(g, [r"[0-9]+"])


HEADLINE = {
    "pattern_counts": q_pattern_counts,
    "mine_events": q_mine_events,
    "mine_documents": q_mine_documents,
    "mine_orders": q_mine_orders,
    "accuracy": q_accuracy,
    "match_templates": q_match_templates,
    "parse_events": q_parse_events,
    "parse_documents": q_parse_documents,
}


def main():
    spark = get_session(f"local[{CPUS}]", app="logweave-bench", shuffle_partitions=int(CPUS) * 2,
                        extra={"spark.driver.memory": "16g"})
    only = sys.argv[1:]
    # Warm-up: JVM, Python workers, parquet footers.
    C.QUERIES["read_logs"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in HEADLINE.items():
        if only and name not in only:
            continue
        t0 = time.time()
        fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else SF_DIR,
        "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
