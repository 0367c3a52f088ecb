import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import mining
from tests.conftest import rows
from tests.prefix_tree_model import event_id, mine

MASKS = [r"([0-9]+\.){3}[0-9]+", r"[0-9]+"]
LINES = [
    "Connection from 10.0.0.1 closed",
    "Connection from 10.0.0.2 closed",
    "Connection from 10.0.0.2 opened",
    "jk2_init() Found child 6725 in scoreboard slot 10",
    "jk2_init() Found child 6726 in scoreboard slot 8",
    "workerEnv.init() ok",
    "workerEnv.init() ok",
    "ready",
    "ready 7",
    "1 2 abc",
    "3 4 abc",
    "1 2 abd",
    "",
    "   ",
    "Disk sda full now",
    "Disk sdb full now",
]


def _lines(spark, texts):
    return spark.createDataFrame([("t", i + 1, t) for i, t in enumerate(texts)],
                                 "dataset string, line_id long, content string")


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["template"], set()).add(r["line_id"])
    return out


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_fixture_groups(spark, depth):
    g = _groups(mining.mine_templates(_lines(spark, LINES), MASKS, depth=depth, st=0.5))
    assert g["jk<*>_init() Found child <*> in scoreboard slot <*>"] == {4, 5}
    assert g["workerEnv.init() ok"] == {6, 7}
    assert g["ready"] == {8}
    assert g["ready <*>"] == {9}
    assert g["<*> <*> abc"] == {10, 11}
    assert g["<*> <*> abd"] == {12}
    assert g[""] == {13, 14}
    if depth in (1, 3):
        assert g["Connection from <*> <*>"] == {1, 2, 3}
    else:
        assert g["Connection from <*> closed"] == {1, 2}
        assert g["Connection from <*> opened"] == {3}
    if depth == 1:
        assert g["Disk <*> full now"] == {15, 16}
    else:
        assert g["Disk sda full now"] == {15}
        assert g["Disk sdb full now"] == {16}


def test_event_ids_are_md5_prefix(spark):
    df = mining.mine_templates(_lines(spark, LINES), MASKS, depth=3)
    for r in df.collect():
        assert r["event_id"] == event_id(r["template"])


def test_patterns_are_taken_in_order_of_their_first_line(spark):
    texts = ["a b b a", "a c b b", "c b b a", "a b b a"]
    collapsed = _groups(mining.mine_templates(_lines(spark, texts), [], depth=1, st=0.5))
    assert collapsed == {"a <*> b <*>": {1, 2, 4}, "c b b a": {3}}


@pytest.mark.parametrize("depth,max_child", [(1, 100), (2, 3), (3, 3), (4, 100), (4, 4)])
@pytest.mark.parametrize("parts", ["1", "200"])
def test_thousands_of_patterns_give_the_templates_of_one_tree(spark, depth, max_child, parts):
    """Branches dealt to many tasks give what the plain model gives, at any number of partitions."""
    rnd = random.Random(depth)
    heads, others = ["get", "put", "drop", "x1", "scan"], ["key", "val", "row", "7", "end", "<*>", "cell"]
    texts = list(dict.fromkeys(" ".join([rnd.choice(heads[:2] if i % 2 else heads), rnd.choice(others[:3]), *(rnd.choice(others) + rnd.choice("abcd") for _ in range(3))])
                               for i in range(2500)))
    model = mine(texts, [], depth=depth, st=0.5, max_child=max_child)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["line_id"]: r["template"] for r in mining.mine_templates(_lines(spark, texts), [], depth=depth, st=0.5, max_child=max_child).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(texts) > 1500 and got == {i + 1: t for i, t in model.items()}


def test_collapsed_mode_equals_model_on_first_occurrences(spark):
    rnd = random.Random(7)
    words = ["get", "put", "key", "val", "1", "2"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 5))) for _ in range(200)]
    seen, firsts = set(), []
    for t in texts:
        p = " ".join(t.split())
        if p not in seen:
            seen.add(p)
            firsts.append(t)
    model = mine(firsts, [r"[0-9]+"], depth=2, st=0.5)
    by_pattern = {" ".join(firsts[i].replace("1", "<*>").replace("2", "<*>").split()): tpl
                  for i, tpl in model.items()}
    got = mining.mine_templates(_lines(spark, texts), [r"[0-9]+"], depth=2, st=0.5).collect()
    for r in got:
        p = " ".join(r["content"].replace("1", "<*>").replace("2", "<*>").split())
        assert r["template"] == by_pattern[p]


def test_partition_count_does_not_change_result(spark):
    texts = LINES * 5
    base = _lines(spark, texts)
    a = rows(mining.mine_templates(base.repartition(1), MASKS, depth=3), "line_id", "template")
    b = rows(mining.mine_templates(base.repartition(13), MASKS, depth=3), "line_id", "template")
    assert a == b


def test_assignment_equals_comparing_with_every_template(spark):
    rnd = random.Random(9)
    templates = list({" ".join(rnd.choice(["a", "b", "c", "<*>"]) for _ in range(rnd.randint(1, 4))) for _ in range(40)})
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 4))) for _ in range(120)]
    clusters = spark.createDataFrame([("t", t) for t in templates], "dataset string, template string")
    lines = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "dataset string, line_id long, content string")
    got = {r["line_id"]: (r["template"], r["similarity"]) for r in mining.assign_clusters(lines, clusters, []).collect()}
    for i, x in enumerate(texts):
        toks, options = x.split(), []
        for t in templates:
            own = t.split()
            if len(own) == len(toks) and toks:
                same = sum(p == q != "<*>" for p, q in zip(own, toks))
                if same and same / len(toks) >= 0.5:
                    options.append((-same, -own.count("<*>"), t, same / len(toks)))
        assert got[i] == ((min(options)[2], min(options)[3]) if options else (None, None)), x


def test_consensus_equals_pairwise_fold(spark):
    rnd = random.Random(3)
    data = []
    for g in range(20):
        n = rnd.randint(2, 6)
        for _ in range(rnd.randint(1, 5)):
            data.append((g, " ".join(rnd.choice("pq") for _ in range(n))))
    df = spark.createDataFrame(data, "g int, pattern string")
    got = {r["g"]: r["template"] for r in mining.consensus_template(df, "g", "pattern").collect()}
    for g in got:
        members = [p.split() for gg, p in data if gg == g]
        acc = members[0]
        for m in members[1:]:
            acc = [a if a == b else "<*>" for a, b in zip(acc, m)]
        assert got[g] == " ".join(acc)


def test_every_line_matches_own_template(spark):
    from logweave.functions.matching import match_lenient
    from logweave.functions.templates import template_to_regex
    texts = [t for t in LINES if t.strip()]
    df = mining.mine_templates(_lines(spark, texts), MASKS, depth=3)
    norm = df.withColumn("norm", F.array_join(F.filter(F.split("content", "\\s+"), lambda x: x != ""), " "))
    bad = norm.filter(~match_lenient("norm", template_to_regex("template"))).count()
    assert bad == 0


def test_leaf_compares_few_templates():
    """A large leaf makes the templates of a plain scan, and a sequence is compared with few of them (it was compared with all)."""
    import random

    from logweave.operators.mining import PrefixClusterer
    draw = random.Random(3)

    def rows(n, words):
        return [["<*>" if draw.random() < 0.1 else "w" + "abcdefghij"[int(x) % 10] + "klmnopqrst"[int(x) // 10 % 10] + "uvwxyz"[int(x) // 100 % 6]
                 for x in (words * draw.random() ** 2 for _ in range(n))] for _ in range(1500)]

    def scanned(sequences, st):  # one leaf without levels: the first best template takes a sequence
        made, chosen = [], []
        for s in sequences:
            score = [(sum(a == b != "<*>" for a, b in zip(t, s)), t.count("<*>")) for t in made]
            best = max(range(len(made)), key=lambda i: (score[i], -i), default=None)
            if best is not None and score[best][0] / len(s) >= st:
                made[best] = [a if a == b else "<*>" for a, b in zip(made[best], s)]
            else:
                best = len(made)
                made.append(list(s))
            chosen.append(best)
        return [" ".join(t) for t in made], chosen

    for n, st, words in ((11, 0.5, 600), (4, 0.5, 400), (7, 0.3, 600), (5, 0.9, 30), (3, 1.0, 20)):
        sequences = rows(n, words)
        clusterer = PrefixClusterer(1, st, 100)
        chosen = [clusterer.add(s) for s in sequences]
        assert ([clusterer.template(g, n) for g in range(len(clusterer.where))], chosen) == scanned(sequences, st)
    clusterer = PrefixClusterer(1, 0.5, 100)
    for s in rows(11, 600):
        clusterer.add(s)
    leaf = clusterer.where[-1][0]
    assert leaf.size > 500
    compared = [len(leaf.near(clusterer._ids(s))) for s in rows(11, 600)[:200]]
    assert sum(compared) / len(compared) < leaf.size / 20


def test_only_wildcards_come_back_and_both_joins_agree(spark, monkeypatch):
    """What clustering writes holds digests and places, no texts, for the patterns that change; lines joined by a shuffle get the same templates."""
    from logweave.operators import mining
    written = []
    real = mining.cut_lineage
    monkeypatch.setattr(mining, "cut_lineage", lambda d: written.append(real(d)) or written[-1])
    texts = [f"unit {w} went to {v}" for w in ("a", "b", "c") for v in ("x", "y", "z")] + ["never seen before at all", "a b", "", None, "went <*> 5 there too", "went <*> 6 there two"]
    rows = [("d", i % 4, t) for i, t in enumerate(texts)] + [("d", None, "unit d went to w"), (None, 3, "unit a went to x")]
    lines = spark.createDataFrame(rows, "dataset string, line_id long, content string")
    sent = mining.mine_templates(lines, [r"[0-9]+"], depth=3)
    got = sorted(map(tuple, sent.collect()), key=str)
    changed = written[-1]
    assert changed.columns == ["dataset", "key", "wild"] and dict(changed.dtypes)["key"] == "binary"
    assert 0 < changed.count() < 12
    assert next(r for r in got if r[2] == "never seen before at all")[3] == "never seen before at all"
    assert [r[3] for r in got if r[0] is None] == [None] and [r[3] for r in got if r[2] == ""] == [""]
    monkeypatch.setattr(mining, "BROADCAST_MAPPING_BYTES", -1)
    monkeypatch.setattr(mining, "SURE_BYTES", -1)
    other = mining.mine_templates(lines, [r"[0-9]+"], depth=3)
    assert sorted(map(tuple, other.collect()), key=str) == got


def test_index_of_a_leaf_takes_little_memory_beside_its_arrays(monkeypatch):
    import random

    from logweave.operators import mining
    rnd = random.Random(4)
    rows = [[f"w{rnd.randrange(3000)}" for _ in range(24)] for _ in range(3000)]

    def clusters():
        clusterer = mining.PrefixClusterer(1, 0.5, 100)
        return [clusterer.add(r) for r in rows], clusterer
    chosen, clusterer = clusters()
    leaf = clusterer.where[0][0]
    assert leaf.next.itemsize == leaf.head.itemsize == 4
    monkeypatch.setattr(mining, "_ENTERED", 64)  # the index built a few rows at a time holds the same chains
    other, small = clusters()
    assert other == chosen and small.where[0][0].head == leaf.head and small.where[0][0].next == leaf.next
