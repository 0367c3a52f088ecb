"""Many profiles in one job, ranks on skewed order keys, defaults of grouping."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.operators import lint as lop, mining, sampling as smp
from prefix_tree_model import mine

SF = "/root/testdata/sf0.001"


def _lines(spark, rows):
    return spark.createDataFrame(rows, "dataset string, line_id long, content string")


def test_datasets_with_their_own_profiles_are_mined_in_one_job(spark):
    texts = [f"{verb} {what} {i} of {i % 7} at 10.0.0.{i % 5} {tail}" for i, (verb, what, tail) in enumerate(
        (v, w, t) for v in ("open", "close", "7up", "read") for w in ("file", "port", "x9") for t in ("now", "later ok", "", "now"))]
    profiles = {"a": ([r"(\d+\.){3}\d+", r"\d+"], 1, 0.5), "b": ([r"\d+"], 3, 0.7), "c": ([], 5, 0.5), "d": ([r"o\w+"], 4, 0.9)}
    lines = _lines(spark, [(d, i, t) for d in [*profiles, "unknown"] for i, t in enumerate(texts)] + [("a", 10_000, None)])
    table = spark.createDataFrame([(d, m, depth, st) for d, (m, depth, st) in profiles.items()], "dataset string, masks array<string>, depth int, st double")
    got = {}
    for r in mining.mine_with_profiles(lines, table).collect():
        got.setdefault(r["dataset"], {})[r["line_id"]] = r["template"]
    assert got["a"].pop(10_000) is None
    assert set(got) == set(profiles)
    for d, (masks, depth, st) in profiles.items():
        assert got[d] == {i: t for i, t in mine(texts, masks, depth, st).items()}, d


def test_profiles_need_one_scan(spark):
    lines = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.coalesce("lang", F.lit("none")).alias("dataset"), F.col("doc_id").alias("line_id"), F.col("text").alias("content"))
    names = [r["dataset"] for r in lines.select("dataset").distinct().collect()]
    table = spark.createDataFrame([(d, [r"\d+"], 1 + i % 4, 0.5) for i, d in enumerate(names)], "dataset string, masks array<string>, depth int, st double")
    plans = [mining.mine_with_profiles(lines, table), mining.profile_changes(lines, [(f"p{i}", [rf"\d{{{i + 1}}}"]) for i in range(9)])]
    for df in plans:
        assert df._jdf.queryExecution().optimizedPlan().toString().count("text#") > 0
        assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("documents.parquet") == 1


def test_profile_changes_counts_lines(spark):
    lines = _lines(spark, [("d", 1, "a 1"), ("d", 2, "b"), ("d", 3, None), ("d", 4, "")])
    got = mining.profile_changes(lines, [("digits", [r"\d"]), ("letters", ["[a-z]"]), ("none", [])]).collect()
    assert {r["profile"]: r["changed"] for r in got} == {"digits": 1, "letters": 2, "none": 0}


def test_ranks_on_equal_and_null_order_keys(spark):
    """Most rows share one order value or have none: ranks stay exact and no piece holds over twice the mean."""
    n = 20_000
    df = spark.range(n).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 50 == 1, F.col("id")).otherwise(5).alias("v"), "id") \
        .unionByName(spark.range(40).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("v"), "id"))
    sizes = [r["count"] for r in smp._dealt_by_rank(df, ["g", "v"], 16).groupBy("__bk").count().collect()]
    assert sum(sizes) == n + 40 and max(sizes) <= 2 * (n + 40) / 16
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    got = smp.group_row_number(df, ["g"], ["v", "id"], pieces=16)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    loose = smp.group_row_number(df, ["g"], ["v"], pieces=16).groupBy("g").agg(F.count_distinct("rn").alias("n"), F.max("rn").alias("top")).collect()
    assert {r["g"]: (r["n"], r["top"]) for r in loose} == {"g": (n, n), None: (40, 40)}
    assert smp.group_row_number(df.limit(0), ["g"], ["v"]).count() == 0


def test_groups_are_whole_templates_by_default(spark):
    """Two templates with one short id are two groups in samples, prompts and the order of groups."""
    df = spark.createDataFrame([("d", "deadbeef", t, i, c) for i, (t, c) in enumerate([("a <*>", "a 1"), ("a <*>", "a 2 x"), ("b <*>", "b 1"), ("b <*>", "b=3 /tmp/x")])],
                               "dataset string, event_id string, template string, line_id long, content string")
    assert smp.diverse_sample(df, k=1).count() == smp.centre_sample(df, k=1, min_threshold=0.0).select("template").distinct().count() == 2
    assert {(r["template"], r["content"]) for r in smp.longest_line(df).collect()} == {("a <*>", "a 2 x"), ("b <*>", "b 1")}
    assert smp.group_order(df).count() == 2
    prompts = {r["group_id"]: r["messages"] for r in lop.prompt_table(df, sample_size=2).collect()}
    assert set(prompts) == {"a <*>", "b <*>"}
    assert prompts["a <*>"][1]["content"] == 'Log list: ["a 2 x","a 1"]'
    assert "key=value" in prompts["b <*>"][0]["content"] and "paths" in prompts["b <*>"][0]["content"] and "key=value" not in prompts["a <*>"][0]["content"]


def test_units_without_an_anchor_word(spark):
    rows = [("g", "1,024 KB read of 5 MB"), ("g", "$3 MB read of 7 MB"), ("h", "9 KB to 3 KB read"), ("h", "7 KB to 3 GB read"), ("i", "read nothing")]
    lines = spark.createDataFrame(rows, "grp string, content string")
    assert {r["grp"]: r["dynamic"] for r in lop.leading_units(lines, ["grp"]).collect()} == {"g": True, "h": False}
    templates = spark.createDataFrame([("g", "<*> KB read of <*> MB"), ("h", "<*> KB to 3 KB read"), ("i", "<*> KB")], "grp string, template string")
    got = {r["grp"]: r["template"] for r in lop.abstract_dynamic_units(templates, lines, ["grp"]).collect()}
    assert got == {"g": "<*> <*> read of <*> MB", "h": "<*> KB to 3 KB read", "i": "<*> KB"}
