import re

import pyspark.sql.functions as F

from logweave.operators import mining, sampling as smp, verify as vf
from logweave.sources import corpora, logs as lg, sinks
from tests.conftest import SF


def test_logformat_regex():
    rx, headers = lg.logformat_to_regex(r"<Date> <Time>  <Level> \[<Comp>\]: <Content>")
    assert headers == {"Date": 1, "Time": 2, "Level": 3, "Comp": 4, "Content": 5}
    assert rx == r"^(.*?)\s+(.*?)\s+(.*?)\s+\[(.*?)\]:\s+(.*?)$"
    _, headers = lg.logformat_to_regex(r"<A>(\[<PID>\])?(?: \((<User>)\))?: [(]<Content>")
    assert headers == {"A": 1, "PID": 3, "User": 5, "Content": 6}


def test_parse_raw_logs_file(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_text("2024 10:00 INFO [x]: hello world\nbroken line\n2024 10:01 WARN [y]: bye\n")
    parsed, rejected = lg.parse_raw_logs(spark, str(p), r"<Date> <Time> <Level> \[<Comp>\]: <Content>", "t")
    got = sorted((r["line_id"], r["content"]) for r in parsed.collect())
    assert got == [(1, "hello world"), (3, "bye")]
    assert [r["line_id"] for r in rejected.collect()] == [2]
    dense, _ = lg.parse_raw_logs(spark, str(p), r"<Date> <Time> <Level> \[<Comp>\]: <Content>", "t", dense=True)
    assert sorted(r["line_id"] for r in dense.collect()) == [1, 2]


def test_dense_ids_many_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumnRenamed("id", "v")
    out = lg.dense_line_ids(df.repartition(5, "v"), start=1, order_col="v", id_col="rid")
    assert sorted((r["v"] + 1, r["rid"]) for r in out.collect()) == [(i, i) for i in range(1, 1001)]
    out2 = lg.dense_line_ids(df, start=1)
    assert sorted(r["line_id"] for r in out2.collect()) == list(range(1, 1001))


def test_group_cap_exact_top_k_with_hot_group(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, line_id long")
    capped = smp.group_cap(df, ["g"], 50, smp.hash_order(1), salts=16)
    import hashlib
    exp = sorted(((hashlib.md5(f"{i}:1".encode()).hexdigest(), i) for i in range(3000)))[:50]
    got = sorted(r["line_id"] for r in capped.filter("g = 'hot'").collect())
    assert got == sorted(i for _, i in exp)
    assert capped.filter("g = 'cold'").count() == 10


def test_group_row_number_matches_window(spark):
    rows = [("a", i) for i in range(500)] + [("b", i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, line_id long")
    out = smp.group_row_number(df, ["g"], ["line_id"])
    assert all(r["rn"] == r["line_id"] + 1 for r in out.collect())


def test_diverse_pick_farthest_first():
    lines = ["a b c d", "a b c d", "x y", "a b c e"]
    idx = smp.diverse_pick(lines, 3)
    assert idx[0] == 0 and idx[1] == 2


def test_parse_logs_preserves_rows(spark):
    d = corpora.doc_lines(spark, SF)
    g = mining.mine_templates(d, [r"[0-9]+"], depth=3)
    p = vf.parse_logs(g, [r"[0-9]+"])
    assert p.count() == d.count()
    assert p.select("line_id").distinct().count() == d.count()


def test_summary_upsert_keeps_last_and_orders(spark):
    old = spark.createDataFrame([("B", 1.0, 1), ("A", 2.0, 1), ("Z", 3.0, 1)], "Dataset string, GA double, seq int")
    new = spark.createDataFrame([("A", 9.0, 2)], "Dataset string, GA double, seq int")
    out = sinks.summary_upsert(old, new, ["A", "B"]).collect()
    assert [(r["Dataset"], r["GA"]) for r in out] == [("A", 9.0), ("B", 1.0)]


def test_split_rules(spark):
    from logweave.operators import splitting as spl
    rows = []
    i = 0
    for t in ["alpha", "beta", "gamma", "delta", "eps", "zeta"]:
        for _ in range(3):
            i += 1
            rows.append(("d", "g1", i, f"[svc worker] {t} finished job"))
    for w in ["opened", "closed"]:
        for _ in range(2):
            i += 1
            rows.append(("d", "g2", i, f"socket {w} now"))
    df = spark.createDataFrame(rows, "dataset string, event_id string, line_id long, content string")
    out = {(r["event_id"], r["split_key"]) for r in spl.split_groups(df, "event_id").collect()}
    g1 = {k for g, k in out if g == "g1"}
    assert len(g1) == 5 and "<OTHER_BRANCHES>" in g1
    assert {k for g, k in out if g == "g2"} == {"opened", "closed"}


def test_group_row_number_on_filtered_shuffled_input(spark):
    """Filters pushed into one read and AQE coalescing must not change ranks."""
    rows = [("a" if i % 3 else "b", i, i % 2 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v long, keep boolean").repartition(9, "v")
    ranked = smp.group_row_number(df, ["g"], ["v"]).filter("keep")
    got = sorted((r["g"], r["v"], r["rn"]) for r in ranked.collect())
    exp = {}
    for g_ in ("a", "b"):
        vs = sorted(v for gg, v, _ in rows if gg == g_)
        exp.update({(g_, v): i + 1 for i, v in enumerate(vs)})
    assert got == sorted((g_, v, exp[(g_, v)]) for g_, v, k in rows if k)


def test_split_unit_rule(spark):
    from logweave.operators import splitting as spl
    texts = ["cache flush 10 KB to disk", "cache flush 20 KB to disk", "cache drop 30 KB to disk",
             "cache drop 40 KB to disk", "queue flush 5 MB now"]
    df = spark.createDataFrame([("d", "g", i, t) for i, t in enumerate(texts)],
                               "dataset string, event_id string, line_id long, content string")
    out = {r["line_id"]: (r["split_rule"], r["split_key"]) for r in spl.split_groups(df, "event_id").collect()}
    assert {r for r, _ in out.values()} == {"d"}
    assert out[0][1] == "flush" and out[2][1] == "drop"
    assert out[4][1] == "queue_len_5"


def render(log_format, optional):
    """A line of the format and its fields; optional groups are kept or left out."""
    text = re.sub(r"\(([^()]*(?:\\[()][^()]*)*)\)\?", r"\1" if optional else "", log_format)
    names = re.findall("<([^<>]+)>", text)
    values = {n: f"v{i}" for i, n in enumerate(names)}
    line = re.sub("<([^<>]+)>", lambda m: values[m[1]], text)
    return re.sub(r"\\(.)", r"\1", line), values


def test_every_profile_parses_its_own_lines(spark):
    from logweave.sources.profiles import PROFILES
    for dataset, log_format, *_ in PROFILES:
        lines = [render(log_format, o) for o in (True, False)]
        raw = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lines)], "line_id long, line string")
        parsed, rejected = lg.parse_raw_lines(raw, log_format, dataset)
        rows = {r["line_id"]: r.asDict() for r in parsed.collect()}
        assert rejected.count() == 0, dataset
        for i, (_, values) in enumerate(lines):
            got = {k: rows[i]["content" if k == "Content" else k] for k in values}
            assert got == values, (dataset, lines[i][0])


def test_dots_and_spaces_of_formats(spark):
    raw = spark.createDataFrame([(1, "a\u00a0b\u2028c"), (2, None), (3, "")], "line_id long, line string")
    parsed, rejected = lg.parse_raw_lines(raw, r"<A>\s<Content>", "d")
    assert [(r["A"], r["content"]) for r in parsed.collect()] == [("a", "b\u2028c")]
    assert {r["line_id"] for r in rejected.collect()} == {2, 3}


def test_ids_follow_the_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("x first\n")
    (tmp_path / "b.log").write_text("".join(f"x second{i}\n" for i in range(5)))
    (tmp_path / "c.log").write_text("".join(f"x third{i}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        parsed, _ = lg.parse_raw_logs(spark, str(tmp_path), "<A> <Content>", "d")
        got = [r["content"] for r in parsed.orderBy("line_id").collect()]
        ids = sorted(r["line_id"] for r in parsed.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == ["first"] + [f"second{i}" for i in range(5)] + [f"third{i}" for i in range(4000)]
    assert ids == list(range(1, 4007))


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "l.csv").write_text('LineId,Content,EventTemplate\n1,"a ""b""\nc",<*>\n2,d,d\n')
    got = [tuple(r) for r in lg.read_logs(spark, str(tmp_path), "d").orderBy("line_id").collect()]
    assert got == [("d", 1, 'a "b"\nc'), ("d", 2, "d")]
    assert [r["content"] for r in lg.read_logs(spark, str(tmp_path), "d", id_col=None).orderBy("line_id").collect()] == ['a "b"\nc', "d"]
    assert [r["event_template"] for r in lg.read_labels(spark, str(tmp_path), "d").orderBy("line_id").collect()] == ["<*>", "d"]


def test_results_are_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("d", "2", "b"), ("d", "x", "bad"), ("e", "1", "a")], "dataset string, line_id string, content string")
    for fmt in ("parquet", "csv"):
        sinks.write_results(rows, str(tmp_path / fmt), fmt)
        back = spark.read.option("header", True).format(fmt).load(str(tmp_path / fmt))
        assert sorted((r["dataset"], int(r["line_id"]), r["content"]) for r in back.collect()) == [("d", 2, "b"), ("e", 1, "a")]


def test_rule_order_and_marker_flags(spark):
    from logweave.operators import splitting as spl
    lines = ["[worker] open", "[worker] open", "[worker] shut", "[worker] wait", "[worker] loop", "[worker] exit", "[worker] idle", "[worker] idle"]
    df = spark.createDataFrame([("d", "g", i, c) for i, c in enumerate(lines)], "dataset string, event_id string, line_id long, content string")
    out = spl.split_groups(df, "event_id").collect()
    assert {r["split_rule"] for r in out} == {"e"}  # the rule of brackets comes before that of two words
    assert {r["split_key"] for r in out} == {"open", "idle", "exit", "loop", "<OTHER_BRANCHES>"}
    marks = [("m", i, f"ERROR DataNode IOp a-b x{i} started") for i in range(40)] + [("m", 99, "ERROR DataNode IOp a-b x0 halted")]
    m = spark.createDataFrame([("d", *r) for r in marks], "dataset string, event_id string, line_id long, content string")
    got = {r["token"] for r in spl.static_markers(m, "event_id").collect()}
    assert {"ERROR", "a-b"} <= got and "started" not in got  # counted over all lines
    assert "DataNode" not in got and "IOp" not in got  # two capitals


def test_word_keys(spark):
    from logweave.operators import splitting as spl
    cases = [("connection closed by peer", "closed", "connection"), ("(job started) done", "<NO_ED>", "job"), ("state: job is now started", "<NO_ED>", "state"),
             ("x=opened then it was just moved away", "moved", "x"), ("moved from 10.0.0.1 to b", "<NO_ED>", "moved"), ("used-up opened", "opened", "used-up"), ("FAILED red seed", "<NO_ED>", "FAILED"),
             ("/a/b/c.log was removed", "removed", "was"), ("Jan deadbeef a.b word", "<NO_ED>", "word"), ("12 34", "<NO_ED>", "<UNKNOWN>"), ("", "<NO_ED>", "<UNKNOWN>"), (None, "<NO_ED>", "<UNKNOWN>")]
    df = spark.createDataFrame([(c,) for c, _, _ in cases], "content string")
    got = [tuple(r) for r in df.select("content", spl.ed_key("content"), spl.first_key("content")).collect()]
    assert got == cases


def test_lines_of_a_large_group_stay_where_they_are(spark):
    """Lines meet their group's decision without a sort by group, and first lines are found without a sort of all lines."""
    from logweave.operators import splitting as spl
    df = spark.range(4000).select(F.lit("d").alias("dataset"), F.lit("g").alias("event_id"), F.when(F.col("id") > 2, F.col("id")).alias("line_id"),
                                  F.concat(F.lit("job "), F.when(F.col("id") % 2 == 0, "opened").otherwise("closed"), F.lit(" by user "), F.col("id").cast("string")).alias("content"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16KB")
    try:
        out = spl.split_groups(df, "event_id")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["split_rule"], r["split_key"]): r["n"] for r in out.groupBy("split_rule", "split_key").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [x for x in plan.splitlines() if "SortMergeJoin" in x and "line_id" not in x] == []
    assert got == {("b", "opened"): 2000, ("b", "closed"): 2000}
    rows = df.select("*", F.lit("x").alias("dc"), F.lit(None).cast("string").alias("ed"), F.lit("job").alias("first"), F.lit(5).alias("n_words"),
                     (F.col("line_id") % 3).cast("string").alias("second")).cache()
    line = F.struct("line_id", "content", "n_words", "first")
    by = ["dataset", "event_id", "dc", "ed", "first", "n_words", "second"]
    expected = rows.groupBy(*by).agg(F.min(line).alias("at"), F.min(F.when(F.col("line_id").isNotNull(), line)).alias("known"))
    keys = spl._distinct_keys(rows, ["dataset", "event_id"])
    assert sorted(map(str, keys.drop("plain").collect())) == sorted(map(str, expected.collect()))
