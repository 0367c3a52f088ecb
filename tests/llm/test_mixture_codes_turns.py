"""Mixing sources, vector codes and conversation repair against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from llm_data import CLASHING, frame, odd_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm import alignment, cover_tree, mixture, totals, turn_repair, vector_codes


# -- groups' totals ------------------------------------------------------------------

def test_attach_heavy_and_light(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").otherwise((F.col("id") % 900).cast("string")).alias("k"))
    sums = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    out = totals.attach(rows, sums, "k", "n", share=10)  # light groups have 300 rows at most
    want = defaultdict(int)
    plain = [(r.id, r.k) for r in rows.collect()]
    for i, k in plain:
        want[k] += i
    assert Counter((r.id, r.k, r.s) for r in out.collect()) == Counter((i, k, want[k]) for i, k in plain)


# -- mixing --------------------------------------------------------------------------

def mixed(spark, rows):
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in [*CLASHING, "size", "copies", "doc", "rate"])
    return spark.createDataFrame([(*r, *[None] * (len(CLASHING) + 4)) for r in rows], schema).repartition(5)


def plain_targets(sizes):
    """Source -> target, by filling up round after round with exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {s: Fraction(0) for s in order}, list(order), Fraction(sum(sizes.values()))
    while left and free:
        share = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        left, full = Fraction(0), [s for s in free if target[s] > 3 * sizes[s]]
        for s in full:
            left += target[s] - 3 * sizes[s]
            target[s] = Fraction(3 * sizes[s])
        free = [s for s in free if s not in full]
    return {s: float(t) for s, t in target.items()}


def test_mixture(spark):
    rng = random.Random(4)
    names = ["a", "B", "é", "zz", "\U0001F600", None, "", "c", "d", "tiny"]
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 40]))), rng.choice(names[:4] * 3 + names)) for i in range(400)]
    rows += [(500, None, "a"), (None, "x y", "a"), (501, "x " * 60_000, "c"), (502, " \t\n", "empty"), (7, "again", "a"), (7, "again", "a"), (503, "one", "tiny2")]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = plain_targets(sizes)
    out = mixture.report(mixed(spark, rows)).collect()
    want = Counter()
    for i, text, source in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"mixture:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2 ** 52
        copies = int(rate) + (draw < rate - int(rate))
        assert copies <= 3
        want[i, size, sizes[source], targets[source], size * copies, copies] += 1
    assert Counter(tuple(r) for r in out) == want
    again = mixture.report(mixed(spark, rows).repartition(2)).collect()
    assert Counter(map(tuple, again)) == want
    # The documents themselves come as often as counted, with their own columns.
    docs = mixture.mix(mixed(spark, rows))
    assert docs.columns == mixed(spark, rows).columns
    seen = Counter(r.doc_id for r in docs.collect())
    assert seen == Counter({i: n for i, n in ((k, sum(r.copies for r in out if r.doc_id == k)) for k in {r.doc_id for r in out}) if n})


def test_mixture_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{(i * i) % 11}") for i in range(6000)]
    docs = mixed(spark, rows)
    source = {i: s for i, _, s in rows}
    taken, target = defaultdict(int), {}
    for r in mixture.report(docs).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] / target[s] - 1) < 0.1 for s in target)


def test_mixture_of_nothing(spark, empty):
    assert mixture.report(empty).count() == 0
    assert mixture.mix(empty).count() == 0
    blank = mixed(spark, [(1, None, None), (2, "", "a")])
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixture.report(blank).collect()] == [(0, 0, 0.0, 0)] * 2


def test_mixture_odd_rows(odd):
    out = mixture.report(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _, _ in odd_rows())
    assert {r.target for r in out} == {float(sum(r.size for r in out))} and all(r.taken == r.size for r in out)  # one source takes all


# -- vector codes ----------------------------------------------------------------------

@pytest.mark.parametrize("n,trees,width,entries", [(1, 1, 1, 1), (7, 3, 2, 4), (400, 4, 4, 64), (5000, 2, 3, 20)])
def test_cover_trees(n, trees, width, entries):
    rng = np.random.default_rng(n)
    points = rng.integers(-40, 40, (n * trees, width))
    points[: n // 3] = points[0]
    forest = cover_tree.build(points, trees)
    # Covering and separation, and every point once under each depth.
    assert sorted(forest.order) == list(range(len(points)))
    for node in range(len(forest.start)):
        own = points[forest.order[forest.start[node]:forest.end[node]]]
        assert ((own - points[forest.centre[node]]) ** 2).sum(1).max() == forest.reach[node]
        kids = np.arange(forest.child[node], forest.child[node] + forest.children[node])
        if len(kids):
            assert forest.start[kids[0]] == forest.start[node] and forest.end[kids[-1]] == forest.end[node]
            assert (forest.start[kids[1:]] == forest.end[kids[:-1]]).all()
            cover = 4.0 ** (np.ceil(np.log2(forest.reach[node]) / 2) - 1)
            assert (forest.reach[kids] <= cover).all()
            centres = points[forest.centre[kids]]
            apart = ((centres[:, None] - centres[None]) ** 2).sum(2)
            assert (apart[~np.eye(len(kids), dtype=bool)] > cover).all()
    books = rng.integers(-40, 40, (trees, entries, width))
    books[:, -1] = books[:, 0]  # ties
    (start, end, entry), (place, single) = cover_tree.assign(forest, points, books)
    code = np.full(len(points), -1)
    code[forest.order[place]] = single
    code[forest.order[cover_tree.ranges(start, end)]] = np.repeat(entry, end - start)
    want = np.concatenate([((points[t * n:(t + 1) * n, None] - books[t][None]) ** 2).sum(2).argmin(1) for t in range(trees)])
    assert (code == want).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = -(-max(len(v) for _, v, _ in good) // parts)
    x = np.array([[int(np.floor(256 * e)) for e in v] + [0] * (parts * wide - len(v)) for _, v, _ in good]).reshape(len(good), parts, wide)
    books = x[:entries].copy()
    nearest = lambda: ((x[:, None] - books[None]) ** 2).sum(3).argmin(1)
    for _ in range(rounds):
        code, new = nearest(), books.copy()
        for p in range(parts):
            for e in range(len(books)):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    new[e, p] = mine.sum(0) // len(mine)
        books = new
    code = nearest()
    error = [sum(((x[i, p] - books[code[i, p], p]) ** 2).sum() for p in range(parts)) for i in range(len(x))]
    by_label = Counter()
    for (_, _, g), e in zip(good, error):
        by_label[g] += int(e)
    digest = hashlib.sha256(",".join(str(v) for p in range(parts) for e in range(len(books)) for v in books[e, p]).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in code[k]), int(error[k]), by_label[g], digest) for k, (i, _, g) in enumerate(good))


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                        T.StructField("code", T.StringType()), T.StructField("points", T.StringType()), T.StructField("lkey", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, "own", "own", "own") for i, v, g in rows], VECTORS).repartition(3)


def floats(v):
    return [float(np.float32(x)) for x in v]


def test_vector_codes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), floats(rng.normal(0, 0.1, 32) + (i % 5) * 0.05), int(i % 3)) for i in range(700)]
    rows += [(800 + i, rows[5][1], None) for i in range(150)] + [(3, rows[9][1], 1), (3, rows[9][1], 1), (None, rows[11][1], 2)]
    rows += [(900, None, 1), (901, floats([float("nan")] * 32), 1), (902, rows[0][1][:31] + [None], 0), (903, rows[0][1][:31] + [float("-inf")], 0)]
    want = plain_codes(rows)
    got = lambda: Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.report(vectors(spark, rows)).collect())
    assert got() == want


def test_vector_codes_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), floats(rng.normal(0, 0.2, 16)), None) for i in range(500)]
    one = vector_codes.kept(vectors(spark, rows))
    sizes = [r.n for r in vector_codes.blocks(one, 16, block=60).select("n").collect()]
    assert sum(sizes) == 500 and max(sizes) <= 60 and len(sizes) > 8


def test_vector_codes_few_wide_and_odd_vectors(spark):
    rows = [(4, floats([0.5] * 5), 1), (2, floats([1, 2, 3]), 1), (9, [], None), (7, floats(range(20)), 2)]
    out = vector_codes.report(vectors(spark, rows)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out) == plain_codes(rows)
    assert vector_codes.report(vectors(spark, [(5, floats([1e38, -1e38]), 1)])).count() == 1
    assert vector_codes.report(vectors(spark, [(1, [], 1), (2, None, 1)])).select("code", "error").collect() == [("00" * 16, 0)]
    assert vector_codes.report(vectors(spark, [])).count() == 0


# -- conversations ---------------------------------------------------------------------

def plain_repair(symbols):
    """(cost, audit) by the least (cost, audit) of every grammar state after every turn."""
    def inserts(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                t = 3 if s == 2 else 2
                best[t] = min(best.get(t, (1 << 60, "")), (c + 5, a + "I"))
        return best
    best = inserts({0: (0, "")})
    for code in (ord(s) - 65 for s in symbols):
        role, fault = code // 4, code % 4
        new = {}
        put = lambda s, v: new.update({s: min(new.get(s, v), v)})
        for s, (c, a) in best.items():
            put(s, (c + 2, a + "D"))
            if fault in (1, 2):
                continue
            c += 5 * (fault == 3)
            due, then = (2, 3) if s == 2 else (1, 2)
            put(then, (c + 1, a + "R"))
            if role == due:
                put(then, (c, a + "K"))
            if s == 0 and role == 0:
                put(1, (c, a + "K"))
        best = inserts(new)
    return min(best[s] for s in (0, 3) if s in best)


def letters(rng, n):
    loose = rng.random()
    return "".join(alignment.symbol(1 + i % 2 if rng.random() > loose else rng.randrange(4), rng.choice([0, 0, 0, 0, 0, 1, 2, 3])) for i in range(n))


def test_alignment_of_whole_conversations_and_pieces():
    rng = random.Random(11)
    for _ in range(600):
        symbols = letters(rng, rng.randint(1, 16))
        for size in (99, 1, 2, 5):
            parts = [symbols[i:i + size] for i in range(0, len(symbols), size)]
            cost, path = alignment.chain([alignment.piece_table(p, i == 0, i == len(parts) - 1) for i, p in enumerate(parts)])
            assert (cost, "".join(a for _, a in path)) == plain_repair(symbols)


def test_alignment_of_long_pieces():
    rng = random.Random(12)
    for n in (300, 700):
        symbols = letters(rng, n)
        assert alignment.piece_table(symbols)[min(alignment.piece_table(symbols), key=alignment.piece_table(symbols).get)] == plain_repair(symbols)


def plain_report(rows):
    """The contract, conversation by conversation."""
    space = lambda v: " " if v is None else str(v)
    ids, turns = {r[0] for r in rows}, defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        turns[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = Counter()
    for conv in ids:
        mine = sorted(turns[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, symbols = set(), ""
        for _, role, text in mine:
            body = text.strip(" \t\n\v\f\r")
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            symbols += alignment.symbol({"s": 0, "u": 1, "a": 2}.get(role[:1], 3), fault)
        cost, audit = plain_repair(symbols) if symbols else (0, "")
        lines, state, at = [], 0, 0
        for edit in audit:
            _, role, text = mine[at] if edit != "I" else (None, "", "")
            at += edit != "I"
            if edit == "D":
                continue
            role = role if edit == "K" else "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        numbers = [t for t, _, _ in mine if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        faults = [(ord(s) - 65) % 4 for s in symbols]
        out[conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def conversations(spark, rows):
    schema = "conv_id long, turn long, role string, text string, conv string, at long, piece string, symbols string, audit string, fate int"
    return spark.createDataFrame([(*r, "x", 1, "x", "x", "x", 3) for r in rows], schema).repartition(4)


def talk(rng):
    end = rng.choice([".", "!", "?", "", ". \n", ""])
    return rng.choice(["", " \t", "same words.", f"hello {rng.randint(0, 40)}{end}", f"größe {rng.randint(0, 9)}\nnext{end}"])


def test_turn_repair(spark):
    rng = random.Random(21)
    roles = ["user", "assistant", "user", "assistant", "system", "agent", "User", "", None]
    rows = [(c, t, ["user", "assistant"][t % 2] if rng.random() < 0.7 else rng.choice(roles), talk(rng)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, rng.randint(0, 900) if rng.random() < 0.95 else None, rng.choice(roles), talk(rng)) for _ in range(1500)]  # several pieces, many ties
    rows += [(101, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(1300)]
    rows += [(None, 1, "user", "a."), (None, None, None, None), (102, None, "user", "x."), (102, None, "assistant", None), (103, 5, "user", "long " * 200_000 + "."),
             (104, 3, "user", "twice."), (104, 3, "user", "twice."), (-7, -9, "assistant", "minus.")]
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    out = turn_repair.report(conversations(spark, rows))
    assert out.columns == cols
    assert Counter(map(tuple, out.collect())) == plain_report(rows)
    assert turn_repair.report(conversations(spark, [])).count() == 0


def test_conversation_that_loses_every_row(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    (row,) = turn_repair.report(conversations(spark, [(5, turn, "user", "gone.")])).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_mended_turns_are_legal(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "bot"]), talk(rng)) for c in range(40) for t in range(rng.randint(1, 8))]
    stored, found = turn_repair.mend(conversations(spark, rows))
    said = defaultdict(list)
    for r in sorted(turn_repair.repaired_turns(stored, found).collect(), key=lambda r: (r.conv, r.at, r.nth)):
        said[r.conv].append(r.role[0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in said.values())
