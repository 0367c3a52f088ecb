"""Plan checks: column pruning at the scan, size-checked broadcasts, no
cross products in the matching join."""

from logweave.operators import mining, pool as pl
from logweave.plans import catalog as C
from logweave.sources import corpora
from tests.conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_scan_reads_only_needed_columns(spark):
    csv = _plan(C.QUERIES["read_logs"](spark, SF))
    assert "struct<LineId:string,Content:string>" in csv  # the label column is never read
    plan = _plan(C._events(spark, SF).select("dataset", "line_id", "content"))
    assert "ts:" not in plan  # the timestamp column is never read
    assert "event_id" in plan


def test_mining_maps_templates_with_broadcast(spark):
    df = mining.mine_templates(corpora.event_logs(spark, SF), corpora.EVENT_MASKS, depth=4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    df.count()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_matching_has_no_cartesian_product(spark):
    pool = pl.template_pool(C._proposals(spark, SF))
    lines = corpora.event_logs(spark, SF).select("dataset", "line_id", "content")
    plan = _plan(pl.match_templates(lines, pool))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
