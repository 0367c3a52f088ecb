"""Appending counted rows safely, and reports that reach the proposer on a retry."""

import pytest
from pyspark.sql import functions as F

from logweave.operators import lint as lop, sampling as smp, verify as vf
from logweave.sources import sinks


def _counts(spark, path):
    return {r["k"]: r["count"] for r in sinks.read_counted(spark, path).collect()}


def test_append_twice_once_after_a_failure(spark, tmp_path):
    path = str(tmp_path / "counted")
    with pytest.raises(FileNotFoundError):
        sinks.read_counted(spark, path)
    one = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string").repartition(3)
    two = spark.createDataFrame([("b",), ("c",)], "k string")
    assert sinks.append_counted(one, path, "day1")
    assert _counts(spark, path) == {"a": 2, "b": 1, None: 1}
    broken = two.select(F.when(F.col("k") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("k")).cast("string").alias("k"))
    with pytest.raises(Exception, match="lost"):
        sinks.append_counted(broken, path, "day2")
    assert _counts(spark, path) == {"a": 2, "b": 1, None: 1}
    assert sinks.append_counted(two, path, "day2")
    assert not sinks.append_counted(two, path, "day2")  # the job ran again
    assert not sinks.append_counted(one, path, "day1")
    assert _counts(spark, path) == {"a": 2, "b": 2, "c": 1, None: 1}
    with pytest.raises(ValueError):
        sinks.append_counted(two, path, "../x")


def test_half_written_appends_do_not_count(spark, tmp_path):
    path = tmp_path / "counted"
    rows = spark.createDataFrame([("a",)], "k string")
    sinks.append_counted(rows, str(path), "w1")
    sinks.append_counted(rows, str(path), "w2")
    (path / "write-w2" / "_SUCCESS").unlink()  # as if the job had died before its end
    assert _counts(spark, str(path)) == {"a": 1}
    assert sinks.append_counted(rows, str(path), "w2")
    assert _counts(spark, str(path)) == {"a": 2}


def _groups(spark, rows):
    return spark.createDataFrame([("d", i, c, t) for i, (c, t) in enumerate(rows)], "dataset string, line_id long, content string, template string")


def test_proposer_mends_its_template_when_the_report_names_the_word(spark):
    def mend(sample, reports, history):
        if not history:
            return "close <*> gates" if sample[0].startswith("close") else "open <*> doors"
        named = any("Not in the line: gates" in r for r in reports)
        return "close <*> ports" if named and history == ["close (.*?) gates"] else "still <*> wrong"

    rows = [("close 5 ports", "C <*>"), ("close 6 ports", "C <*>"), ("open 7 doors", "O <*>"), ("odd 1 line", "X <*>")]
    out = {r["line_id"]: r for r in vf.parse_logs(_groups(spark, rows), [], proposer=vf.grouped_proposer(mend), feedback=True, rounds=2, use_pool=False).collect()}
    assert [out[i]["source"] for i in range(4)] == ["round1", "round1", "round0", "unverified"]
    assert out[0]["history"] == ["close (.*?) gates", "close (.*?) ports"]
    assert out[3]["history"][0] == "open (.*?) doors" and set(out[3]["history"][1:]) == {"still (.*?) wrong"}


def test_feedback_rows(spark):
    todo = _groups(spark, [("set a=1 in /var/x/log", "T"), ("zap", "T")]).select("dataset", F.col("template").alias("group_key"), "line_id", "content")
    todo = todo.withColumn("history", F.when(F.col("content") == "zap", F.array().cast("array<string>")).otherwise(F.array(F.lit("first"), F.lit("set a=1 on (.*?)"))))
    got = {r["content"]: r for r in vf.with_feedback(todo.drop("history"), todo).collect()}
    assert got["zap"]["report"] is None and got["zap"]["history"] == []
    told = got["set a=1 in /var/x/log"]
    assert told["template_regex"] == "set a=1 on (.*?)"
    assert told["report"].split("\n") == ["The template does not fit the line.", "Values kept as constants: a=1"]


def test_lint_report_text(spark):
    pairs = spark.createDataFrame([("d", 1, "user bob read /srv/data/one.txt", "user (.*?) wrote /srv/(.*?)"), ("d", 2, "x y", "x y")],
                                  "dataset string, line_id long, content string, template_regex string")
    got = {r["line_id"]: r for r in lop.lint_report(pairs).collect()}
    assert got[1]["foreign_words"] == ["wrote"] and got[1]["untreated_paths"] == ["/srv/data/one.txt"] and got[1]["hardcoded"] == []
    assert got[1]["report"] == "The template does not fit the line.\nNot in the line: wrote\nAbstract whole paths: /srv/data/one.txt"
    assert got[2]["report"] == "The template does not fit the line."


def test_cosine_distance_and_sample():
    assert smp._cosine_distance("disk full", "Disk FULL") == pytest.approx(0.0)
    assert smp._cosine_distance("disk full", "net down") == 1.0
    assert smp._cosine_distance("disk disk full", "disk full") == pytest.approx(1 - 3 / (5 ** 0.5 * 2 ** 0.5))
    assert smp.diverse_pick(["a1 b1 c1", "a1 b1 c1", "zz yy", "a1 b1"], 2, "cosine") == [0, 2]
    assert smp.diverse_pick(["a1 b1 c1", "zz yy", "a1 b1"], 2, "cosine", nearest=True) == [0, 2]
