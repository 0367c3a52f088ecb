import pytest

from logweave.operators import accuracy as acc
from logweave.sources import corpora
from logweave.operators import mining
from tests.conftest import SF


def test_scoring_fixture(spark):
    data = [(1, "A", "A"), (2, "A", "A"), (3, "B", "Bx"), (4, "C", "D"), (5, "D", "D"),
            (6, "E", "E1"), (7, "E", "E2")]
    df = spark.createDataFrame([("d", i, p, t) for i, t, p in data],
                               "dataset string, line_id long, pred string, truth string")
    r = acc.accuracy_from_pairs(df).first()
    assert r["ga"] == pytest.approx(3 / 7)
    assert r["pa"] == pytest.approx(3 / 7)
    assert r["fga"] == pytest.approx(0.4)
    assert r["fta"] == pytest.approx(0.2)
    assert r["event_count"] == 5


def test_perfect_prediction_scores_one(spark):
    ev = corpora.event_logs(spark, SF)
    parsed = ev.select("dataset", "line_id", "content", "event_template").withColumnRenamed("event_template", "template")
    r = acc.evaluate(parsed, corpora.event_labels(spark, SF)).first()
    assert (r["ga"], r["pa"], r["fga"], r["fta"]) == (1.0, 1.0, 1.0, 1.0)


def test_mined_events_depth4_are_exact(spark):
    ev = corpora.event_logs(spark, SF)
    r = acc.evaluate(mining.mine_templates(ev, corpora.EVENT_MASKS, depth=4), corpora.event_labels(spark, SF)).first()
    assert (r["ga"], r["pa"], r["fga"], r["fta"], r["event_count"]) == (1.0, 1.0, 1.0, 1.0, 5)


def test_alignment_report_counts_mismatches(spark):
    p = spark.createDataFrame([("d", 1, "x", "a"), ("d", 2, "y", "b")],
                              "dataset string, line_id long, content string, pred_template string")
    t = spark.createDataFrame([("d", 1, "x", "a"), ("d", 3, "z", "c")],
                              "dataset string, line_id long, content string, event_template string")
    r = acc.alignment_report(acc.align_labels(p, t)).first()
    assert (r["pred_rows"], r["truth_rows"], r["content_mismatch"]) == (2, 2, 2)
    a, b = acc.semi_align(p, t)
    assert a.count() == 1 and b.count() == 1
