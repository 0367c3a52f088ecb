"""The parse loop: groups by whole template, shared templates, second rounds, history."""

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from logweave.functions.templates import template_to_regex
from logweave.operators import pool as pl
from logweave.operators import verify as vf


def _groups(spark, rows):
    return spark.createDataFrame([("d", i, c, t) for i, (c, t) in enumerate(rows)], "dataset string, line_id long, content string, template string") \
        .withColumn("event_id", F.substring(F.md5("template"), 1, 8))


def _proposer(by_round):
    """Replies with the template that ``by_round`` lists for a group, one further each round."""
    asked = []

    def propose(rows: DataFrame) -> DataFrame:
        k = len(asked)
        asked.append(rows.columns)
        replies = rows.sparkSession.createDataFrame([(g, t[min(k, len(t) - 1)]) for g, t in by_round.items()], "group_key string, template string")
        return rows.select("dataset", "group_key").distinct().join(replies, "group_key").select("dataset", "group_key", "template")
    return propose


def test_templates_are_shared_and_tried_again(spark):
    rows = [("open file 1 now", "A <*>"), ("open file 2 now", "A <*>"),  # right at once
            ("open file 77 now", "B <*>"),  # its own proposal is wrong; group A's template fits
            ("close 5 ports", "C <*>"), ("close 6 ports", "C <*>"),  # right in the second round
            ("never 1 fits", "D <*>"), (None, None)]
    replies = {"A <*>": ["open file <*> now"], "B <*>": ["wrong"], "C <*>": ["close <*> gates", "close <*> ports"], "D <*>": ["other", "another", "more", "last"]}
    out = {r["line_id"]: r for r in vf.parse_logs(_groups(spark, rows), [], proposer=_proposer(replies)).collect()}
    assert len(out) == len(rows)
    assert out[0]["template_regex"] == out[1]["template_regex"] == out[2]["template_regex"] == "open file (.*?) now"
    assert [out[i]["source"] for i in range(7)] == ["round0", "round0", "pool", "round1", "round1", "unverified", "unverified"]
    assert out[3]["history"] == ["close (.*?) gates", "close (.*?) ports"] and out[5]["history"] == ["other", "another", "more", "last"]
    assert [out[i]["verified"] for i in range(7)] == [True] * 5 + [False] * 2
    assert out[6]["template_regex"] is None and out[5]["event_id"] == "u5"


def test_groups_with_one_short_id_stay_apart(spark):
    """Two templates whose 8-character ids clash are two groups, each right in the first round."""
    rows = [("alpha 1 x", "alpha <*> x"), ("alpha 2 x", "alpha <*> x"), ("beta 1 y", "beta <*> y"), ("beta 2 y", "beta <*> y")]
    groups = _groups(spark, rows).withColumn("event_id", F.lit("deadbeef"))
    out = vf.parse_logs(groups, [r"[0-9]+"]).collect()
    assert {(r["template_regex"], r["source"]) for r in out} == {("alpha (.*?) x", "round0"), ("beta (.*?) y", "round0")}


def test_key_value_templates_have_anchors(spark):
    templates = ["uid=<*> euid=<*>", "gid=<*> egid=<*>", "port <*> uid=<*>"]
    proposals = spark.createDataFrame([("d", t, i) for i, t in enumerate(templates)], "dataset string, t string, seq long") \
        .select("dataset", template_to_regex("t").alias("template"), "seq")
    pool = pl.template_pool(proposals)
    anchors = {r["template_regex"]: r["anchor"] for r in pl.template_anchors(pool).collect()}
    assert anchors == {"uid=(.*?) euid=(.*?)": "euid", "gid=(.*?) egid=(.*?)": "egid", "port (.*?) uid=(.*?)": "port"}
    lines = spark.createDataFrame([("d", i, c) for i, c in enumerate(["uid=0 euid=1", "gid=5 egid=6", "port 80 uid=3", "none"])], "dataset string, line_id long, content string")
    got = {r["line_id"]: r["template_regex"] for r in pl.match_templates(lines, pool).collect()}
    assert got == {0: "uid=(.*?) euid=(.*?)", 1: "gid=(.*?) egid=(.*?)", 2: "port (.*?) uid=(.*?)", 3: None}


def test_anchors_never_lose_a_match(spark):
    """Every pair that the strict matcher takes is found, whatever stands next to the wildcards."""
    import itertools
    import random
    rnd = random.Random(6)
    words = ["load", "x=<*>", "a<*>", "<*>b", "(<*>)", "key:", "über", "_v", "<*>", "end."]
    templates = list({" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 4))) for _ in range(25)})
    lines = list({t.replace("<*>", rnd.choice(["1", "q r", "ab", ""])) for t in templates for _ in range(3)})
    proposals = spark.createDataFrame([("d", t, i) for i, t in enumerate(templates)], "dataset string, t string, seq long") \
        .select("dataset", template_to_regex("t").alias("template"), "seq")
    pool = pl.template_pool(proposals).filter("candidate").cache()
    logs = spark.createDataFrame([("d", i, c) for i, c in enumerate(lines)], "dataset string, line_id long, content string")
    got = {r["content"]: r["template_regex"] for r in pl.match_templates(logs, pool).collect()}
    every = pool.crossJoin(logs.select("content", F.size(F.filter(F.split("content", "\\s+"), lambda w: w != "")).alias("n")))
    hits = every.filter("word_count <= n").filter(pl.match_strict("content", "template_regex")).orderBy(F.desc("word_count"), "seq").collect()
    want = {}
    for r in hits:
        want.setdefault(r["content"], r["template_regex"])
    assert got == {c: want.get(c) for c in lines}
    assert list(itertools.chain(want)) != []


def test_band_is_an_equi_join(spark):
    pool = spark.createDataFrame([("d", k, f"t{k}", k, True) for k in range(1, 30)], "dataset string, template_id long, template_regex string, word_count int, candidate boolean")
    lengths = spark.createDataFrame([("d", 4), ("d", 20)], "dataset string, n_tokens int")
    band = pl.templates_in_band(lengths, pool)
    assert "NestedLoop" not in band._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["n_tokens"], r["word_count"]) for r in band.collect()) == [(4, k) for k in range(1, 6)] + [(20, k) for k in range(12, 22)]


def test_mined_lines_send_no_texts_of_what_fits(spark, monkeypatch):
    """The first check writes a row a group and the contents that fail; a rest too large to be broadcast gives the same."""
    written = []
    real = vf.cut_lineage
    monkeypatch.setattr(vf, "cut_lineage", lambda d: written.append(real(d)) or written[-1])
    rows = [(f"open file {i} now", "open file <*> now") for i in range(400)] + [
        ("open file 7 now", "open file <*> now"), ("no variables", "no variables"), ("no  variables", "no variables"), ("alone here", "alone here"),
        ("user=ann left 3", "user=ann left <*>"), ("user=ann left 4", "user=ann left <*>"), ("odd name", "wrong <*>"), ("open file x now", "wrong <*>"), (None, None)]
    groups = _groups(spark, rows).unionByName(spark.createDataFrame([(None, 900, "open file 1 now", "open file <*> now", "x")], "dataset string, line_id long, content string, template string, event_id string"))
    out = {r["line_id"]: r for r in vf.parse_logs(groups, [r"[0-9]+"]).collect()}
    assert len(out) == len(rows) + 1
    assert all("content" not in d.columns or d.count() < 10 for d in written)
    assert {out[i]["template_regex"] for i in range(401)} == {"open file (.*?) now"} and out[0]["history"] == ["open file (.*?) now"]
    assert [out[i]["source"] for i in (0, 401, 402, 403, 408, 900)] == ["round0", "round0", "unverified", "static", "unverified", "unverified"]
    assert out[403]["template_regex"] == "alone here" and out[900]["template_regex"] is None and out[407]["source"] in ("pool", "unverified", "round1")
    assert out[404]["verified"] is False and out[404]["history"][0] == "user=ann left (.*?)"
    monkeypatch.setattr(vf, "BROADCAST_LATE_BYTES", -1)
    assert {r["line_id"]: r for r in vf.parse_logs(groups, [r"[0-9]+"]).collect()} == out
    short = vf.parse_logs(groups, [r"[0-9]+"], rounds=0).filter("line_id = 407").first()
    assert (short["source"], short["template_regex"], short["history"]) == ("unverified", "wrong (.*?)", ["wrong (.*?)"])
