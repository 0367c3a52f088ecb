import re

from pyspark.sql import functions as F

from logweave.functions import matching as mf
from logweave.functions import templates as tf
from logweave.operators import pool as pl

POOL = [
    ("mod_jk child workerEnv in error state (.*?)", 1),
    ("Found child (.*?) in scoreboard slot (.*?)", 2),
    ("uid=(.*?) euid=(.*?)", 3),
    ("ready (.*?)", 4),
    ("(.*?) (.*?)", 5),
]
LINES = [
    ("mod_jk child workerEnv in error state 6", "mod_jk child workerEnv in error state (.*?)",
     "mod_jk child workerEnv in error state (.*?)"),
    ("Found child 1,234 in scoreboard slot 10", "Found child (.*?) in scoreboard slot (.*?)",
     "Found child (.*?) in scoreboard slot (.*?)"),
    ("uid=0 euid=0", "uid=(.*?) euid=(.*?)", "uid=(.*?) euid=(.*?)"),
    ("uid=0 euid=0 tty=x", "uid=(.*?) euid=(.*?)", None),
    ("ready 7", None, None),
]


def test_pool_candidates_and_counts(spark):
    props = spark.createDataFrame([("d", t, s) for t, s in POOL], "dataset string, template string, seq long")
    pool = {r["template_regex"]: r for r in pl.template_pool(props).collect()}
    assert pool["mod_jk child workerEnv in error state (.*?)"]["word_count"] == 7
    assert pool["mod_jk child workerEnv in error state (.*?)"]["static_tokens"] == 6
    assert pool["Found child (.*?) in scoreboard slot (.*?)"]["static_tokens"] == 5
    assert pool["uid=(.*?) euid=(.*?)"]["static_tokens"] == 2
    assert pool["ready (.*?)"]["candidate"] is False
    assert "(.*?) (.*?)" not in pool  # rejected: only punctuation


def test_lenient_and_strict_per_line(spark):
    rows = []
    for line, lenient, strict in LINES:
        for t, _ in POOL[:3]:
            rows.append((line, t, t == lenient, t == strict))
    df = spark.createDataFrame(rows, "content string, template_regex string, exp_l boolean, exp_s boolean")
    out = df.select("*", mf.match_lenient("content", "template_regex").alias("l"),
                    mf.match_strict("content", F.col("template_regex")).alias("s"),
                    mf.match_strict_jvm("content", "template_regex").alias("sj")).collect()
    for r in out:
        assert r["l"] == r["exp_l"], r
        assert r["s"] == r["exp_s"], r
        assert r["sj"] == r["exp_s"], r


def test_match_templates_first_hit(spark):
    props = spark.createDataFrame([("d", t, s) for t, s in POOL], "dataset string, template string, seq long")
    pool = pl.template_pool(props)
    lines = spark.createDataFrame([("d", i, l) for i, (l, _, _) in enumerate(LINES)],
                                  "dataset string, line_id long, content string")
    got = {r["content"]: r["template_regex"] for r in pl.match_templates(lines, pool).collect()}
    for line, _, strict in LINES:
        assert got[line] == strict


def plain_strict(line, template):
    """The rule of the strict matcher, sentence by sentence."""
    line, template = line.replace(",", ""), template.replace(",", "")
    allowed = {line.count("="), re.sub(r"\{[^}]*\}", "", re.sub(r"\([^)]*\)", "", line)).count("=")}
    if line.count(":") > 1:
        allowed.add(":".join(line.split(":")[:2]).count("="))
    try:
        fit = re.search(("" if template.startswith("^") else "^") + template + ("" if template.endswith("$") else "$"), line)
    except re.error:
        fit = None
    return bool(fit) and template.count("=") in allowed and "=" not in "".join(x or "" for x in fit.groups()[:-1])


def test_strict_group_rule(spark):
    pairs = [("x=1 y", "x=(.*?) (.*?)", True),
             ("p=a=b q", "p=(.*?) (.*?)", False),  # one '=' more than the template
             ("a (x=1) b=2: c: d=3", "a (.*?) b=(.*?)", False),  # the first group would hold the bracketed '='
             ("b=2 (x=1)", "b=(.*?) (.*?)", True),  # outside brackets, and the last group may hold one
             ("k=1: a: z=2 y=3", "k=(.*?): (.*?): (.*?)", True),  # before the second colon
             ("k=1 z", "k=([0-9]+) (z)", True), ("k=1 k=2", "k=([0-9]) (k.2)", False), ("k=1 (k=2)", "k=([0-9]) (.k.2.)", True),
             ("k=1 (k=2) e", "k=([0-9]) (.k.2.) (e)", False), (None, "a", False)]
    df = spark.createDataFrame(pairs, "content string, template_regex string, want boolean")
    for r in df.select("*", mf.match_strict("content", "template_regex").alias("got")).collect():
        assert r["got"] == r["want"], r
        assert r["content"] is None or plain_strict(r["content"], r["template_regex"]) == r["want"], r


def test_escape_equals_python(spark):
    samples = ["a.b(c)[d]{e}?*+-|^$\\&~# f", "naïve ünïcode 1.2", "tab\there", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(tf.literal_template("s")).collect()]
    assert got == [re.escape(s).replace("\\ ", " ") for s in samples]


def test_template_to_regex_rules(spark):
    cases = {
        "a <*> <*> b": "a (.*?) (.*?) b",
        "x<*><*>y": "x(.*?)y",
        "'<*>' done": "(.*?) done",
        " x ".join(["<*>"] * 40) + " end": " x ".join(["(.*?)"] * 40) + " end",
        "<*> <*> " * 12 + "end": "(.*?) (.*?) " * 12 + "end",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", tf.template_to_regex("t")).collect()}
    assert got == cases


def test_cap_wildcards(spark):
    t = "x".join(["(.*?)"] * 35)
    df = spark.createDataFrame([(t,), ("a (.*?) b",)], "t string")
    got = [r[0] for r in df.select(tf.cap_wildcards("t")).collect()]
    assert got[0] == "x".join(["(.*?)"] * 30)
    assert got[1] == "a (.*?) b"


def test_clean_template_rules(spark):
    cases = {
        "moved from /a/b to /c/d": "moved from (.*?) to (.*?)",
        "_(.*?) started": "(.*?) started",
        "(.*?)://(.*?) uplink": "(.*?) uplink",
        "(.*?)://(.*?) up": None,
        "(.*?) : (.*?)": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", tf.clean_template("t")).collect()}
    assert got == cases


def test_unicode_mask(spark):
    from logweave.functions.masking import mask_variables
    df = spark.createDataFrame([("naïve Überlänge straße123.foo.bar ٣٤ items",)], "s string")
    u = df.select(mask_variables("s", [r"\d+"], unicode=True)).first()[0]
    a = df.select(mask_variables("s", [r"\d+"], unicode=False)).first()[0]
    assert u == "naïve Überlänge straße<*>.foo.bar <*> items"
    assert a == "naïve Überlänge straße<*>.foo.bar ٣٤ items"


def test_segment_matcher_equals_python_regex(spark):
    import random
    rnd = random.Random(11)
    alphabet = ["a", "b", "=", " ", ".", ",", "x=1", "k", "$", "(", "]"]
    pairs = []
    for _ in range(400):
        lits = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 3))) for _ in range(rnd.randint(1, 4))]
        tpl = "(.*?)".join(re.escape(x).replace("\\ ", " ") for x in lits)
        line = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8)))
        if rnd.random() < 0.5:  # a line built from the template
            line = "".join(l + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 2))) for l in lits)
        pairs.append((line, tpl))
    df = spark.createDataFrame(pairs, "content string, template_regex string")
    out = df.select("content", "template_regex",
                    mf.match_lenient("content", "template_regex").alias("l"),
                    mf.match_strict("content", "template_regex").alias("s"),
                    mf.segment_lenient("content", "template_regex").alias("sl"),
                    mf.segment_strict("content", "template_regex").alias("ss"),
                    mf.is_simple_template(F.translate("template_regex", ",$", "")).alias("simple_l"),
                    mf.is_simple_template(F.translate("template_regex", ",", "")).alias("simple_s")).collect()
    for r in out:
        c, t = r["content"], r["template_regex"]
        lc, lt_ = c.replace(",", "").replace("$", ""), t.replace(",", "").replace("$", "")
        try:
            exp_l = re.fullmatch(lt_, lc) is not None
        except re.error:
            exp_l = False
        assert r["l"] == exp_l, (c, t)
        exp_s = plain_strict(c, t)
        if r["simple_l"]:
            assert r["sl"] == exp_l, (c, t)
        if r["simple_s"]:
            assert r["ss"] == exp_s, (c, t)
        assert r["s"] == exp_s, (c, t)


def test_templates_with_many_wildcards_stay_apart(spark):
    from logweave.operators.accuracy import evaluate
    head = " ".join(f"w{i} <*>" for i in range(31))
    rows = [("d", i, "line", f"{head} {w}") for i, w in enumerate(["alpha", "alpha", "omega"])]
    truth = spark.createDataFrame(rows, "dataset string, line_id long, content string, event_template string")
    r = evaluate(truth.withColumnRenamed("event_template", "template"), truth).first().asDict()
    assert [r[k] for k in ("ga", "pa", "fga", "fta")] == [1.0] * 4


def test_collapse_has_no_round_limit(spark):
    from logweave.operators.templates import collapse_to_fixpoint
    import string
    long = "-".join(string.ascii_lowercase) + "-<*>"
    df = spark.createDataFrame([(long,), ("a-b-c-d-e-f-g-<*>",), (None,), ("plain",)], "template string")
    got = sorted(r[0] or "" for r in collapse_to_fixpoint(df).collect())
    assert got == ["", "<*>", "<*>", "plain"]


def test_parameters(spark):
    from logweave.operators.setops import extract_parameters
    rows = [("a  1 b 2", "a <*> b <num>", ["1", "2"]), ("a.b", "a.<x>", ["b"]), ("axb", "a.<x>", []), ("no", "no", []), (None, "<*>", None), ("x\ty", "x <*>", ["y"])]
    df = spark.createDataFrame([r[:2] for r in rows], "content string, template string")
    for (c, _, want), r in zip(rows, extract_parameters(df).collect()):
        assert (r["parameters"] or None) == (want or None), r


def test_units_change_for_their_own_anchor_only(spark):
    from logweave.operators.lint import abstract_dynamic_units, dynamic_units
    lines = spark.createDataFrame([("g", "sent 5 KB in 2 s used 7 MB"), ("g", "sent 5 MB in 2 s used 9 MB"), ("h", "read 1 GB wrote 2 KB"), ("h", "read 1 GB wrote 2 MB")], "grp string, content string")
    assert {(r.grp, r.anchor) for r in dynamic_units(lines, ["grp"]).filter("dynamic").collect()} == {("g", "sent"), ("h", "wrote")}
    t = spark.createDataFrame([("g", "sent <*> KB in <*> s used <*> MB"), ("h", "read <*> GB wrote <*> KB"), ("x", "sent <*> KB")], "grp string, template string")
    got = {r.grp: r.template for r in abstract_dynamic_units(t, lines, ["grp"]).collect()}
    assert got == {"g": "sent <*> <*> in <*> s used <*> MB", "h": "read <*> GB wrote <*> <*>", "x": "sent <*> KB"}


def test_anchor_is_the_rarest_among_the_lines(spark):
    """Templates that share their longest word are looked up by a word that few lines hold (every pair was made before)."""
    from logweave.operators import pool as pl
    lines = spark.createDataFrame([("d", i, f"performance w{chr(97 + i % 20)}{chr(97 + i // 20)} done {i}") for i in range(200)], "dataset string, line_id long, content string")
    proposals = spark.createDataFrame([("d", f"performance w{chr(97 + i % 20)}{chr(97 + i // 20)} done <*>", i) for i in range(200)], "dataset string, template string, seq long")
    index = pl.index_templates(pl.template_pool(proposals, rank=False))
    keyed = lines.selectExpr("dataset", r"explode(array_distinct(regexp_extract_all(content, '(?U)\\w+', 0))) AS key")
    chosen = pl._rarest_in(index.withColumn("keys", index["runs"]), keyed)
    assert chosen.count() == 200
    assert chosen.join(keyed, ["dataset", "key"]).count() == 200
    out = {r["line_id"]: r["template_regex"] for r in pl.match_indexed(lines, index).collect()}
    assert out == {i: f"performance w{chr(97 + i % 20)}{chr(97 + i // 20)} done (.*?)" for i in range(200)}
    # A template with a word that no line holds is not tried.
    other = lines.selectExpr("dataset", "'done' AS key")
    assert pl._rarest_in(index.withColumn("keys", index["runs"]), other).count() == 0


def test_collapse_runs_its_passes_in_one_round(spark, monkeypatch):
    """Rows that need several passes are written once (a round had one pass before), and those with more than a round has go on."""
    from logweave.functions.templates import collapse_pass
    from logweave.operators import templates as top
    texts = ["<*>-<*>-<*>-<*>-<*>-<*>-<*>-<*>-<*>", "<*>-a-<*>_b c-<*>:d:<*>", "plain", "", None, "<*>-<*>-<*>-<*>-<*>-<*>-<*>-<*>-<*>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_id long, template string")
    plain = df
    for _ in range(12):
        plain = spark.createDataFrame(plain.select("line_id", collapse_pass("template").alias("template")).collect(), df.schema)
    want = {r["line_id"]: r["template"] for r in plain.collect()}
    writes = []
    real = top.cut_lineage
    monkeypatch.setattr(top, "cut_lineage", lambda d: writes.append(1) or real(d))
    assert {r["line_id"]: r["template"] for r in top.collapse_to_fixpoint(df).collect()} == want
    assert len(writes) == 1
    monkeypatch.setattr(top, "PASSES", 2)
    assert {r["line_id"]: r["template"] for r in top.collapse_to_fixpoint(df).collect()} == want
