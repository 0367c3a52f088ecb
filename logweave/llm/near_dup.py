"""Near-duplicate documents: a chosen-path set similarity join.

A document is its set of distinct 5-word shingles (lower-cased words).  Equal sets
are one point.  A point's sketch holds ``COORDINATES`` minwise tokens.  In each of
``trees`` independent trees a point follows ``branches`` chosen coordinates from
every node: the points that agree in the chosen token meet in the child.  A node of
at most ``leaf`` points is compared exhaustively by sketches; a larger one branches
on, up to ``depth`` times; whatever still is larger then holds points that agree in
``depth`` tokens and is joined as a whole.  With similarity s, a pair meets in a
tree with chance r(d) = 1 - (1 - s r(d-1))**branches, r(0) = 1: at 0.75, two
branches and three levels 0.90 in a tree, so six trees miss a pair with a chance of
about 1e-6 (``recall``).

These joins only propose loose groups (sketch similarity of at least ``loose``).
Links are confirmed on the full sets, each set going to its one loose group: a
search outwards from a point compares it with all points not yet reached, so that a
group of copies costs one comparison a copy and no pair is left out that could join
two parts.  A large loose group is dealt over blocks which all receive its first
point; points not joined to that one are compared with every block.

Defined results: null text, empty text and text without words have the empty set
and are linked with nothing; so are rows with a null doc_id (component null, kept).
Repeated doc_ids and rows are points like any other.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import SPACES, Words, byte_class, id_column, map_arrow, window_hashes, written
from logweave.llm.components import components

SHINGLE = 5
COORDINATES = 64
TREES, BRANCHES, DEPTH, LEAF = 6, 2, 3, 48
LOOSE = 0.5
#: Intersection to union, in hundredths.
SIMILAR = 75
BLOCK = 512

WORD, LOWER = byte_class(SPACES, lower=True)
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)


def recall(similarity: float = 0.75, trees: int = TREES, branches: int = BRANCHES, depth: int = DEPTH) -> float:
    """The chance that a pair of this similarity meets in a leaf of some tree."""
    r = 1.0
    for _ in range(depth):
        r = 1 - (1 - similarity * r) ** branches
    return 1 - (1 - r) ** trees


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(column, WORD, LOWER)
    all_ = window_hashes(words.hash, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(all_[a:b - SHINGLE + 1]))
        else:
            out.append(window_hashes(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def sketch(values: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 8192):
            out = np.minimum(out, ((values[at:at + 8192, None] * _FACTORS) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, *, id_col="doc_id", text_col="text", copies: bool = False) -> DataFrame:
    """doc_id, n_shingles, point (digest of the set; null if it is empty) and sketch; with ``copies`` also the digest ``txt`` of the text."""

    def run(batch):
        sets = shingle_sets(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        points = [hashlib.md5(s.tobytes()).digest() if len(s) and i is not None else None for s, i in zip(sets, ids)]
        more = ["txt"] if copies else []
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(points, pa.binary()),
            pa.array([sketch(s) if p else None for s, p in zip(sets, points)], pa.list_(pa.int32())), *[batch.column(c) for c in more]],
            names=["doc_id", "n_shingles", "point", "sketch", *more])

    slim = id_column(docs, id_col, text_col)
    if copies:
        slim = slim.withColumn("txt", _text_digest("text"))
    return map_arrow(slim, run, "doc_id long, n_shingles long, point binary, sketch array<int>" + (", txt string" if copies else ""))


def _text_digest(col):
    return F.coalesce(F.md5(F.col(col).cast("string")), F.lit(""))


def _sized(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, point) with the number of points of its node, without nodes of one point.  The rows are written
    before they are counted and joined, so that they are made once and hot nodes can be split in the join."""
    nodes = written(nodes, "nodes")
    sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return written(nodes.join(sizes, "node"), "paths")


def loose_edges(points: DataFrame, *, trees=TREES, branches=BRANCHES, depth=DEPTH, leaf=LEAF, loose=LOOSE) -> DataFrame:
    """Edges (a, b) whose components hold all pairs that meet in some node and look similar."""
    coordinates = np.random.default_rng(21).permutation(COORDINATES)[:trees * branches].tolist()
    roots = F.array(*[F.struct(F.lit(k // branches).alias("tree"), F.lit(c).alias("c")) for k, c in enumerate(coordinates)])
    level = points.select("point", "sketch", F.explode(roots).alias("to")).select(
        F.xxhash64("to.tree", "to.c", F.element_at("sketch", F.col("to.c") + 1)).alias("node"), "point")
    small, rest = [], None
    for d in range(1, depth + 1):
        sized = _sized(level)
        small.append(sized.where(F.col("n") <= leaf).select("node", "point"))
        rest = sized.where(F.col("n") > leaf).select("node", "point")
        if d < depth:
            chosen = F.array(*[F.pmod(F.xxhash64("node", F.lit(j)), F.lit(COORDINATES)).cast("int") for j in range(branches)])
            level = rest.withColumn("c", F.explode(F.array_distinct(chosen))).join(points.select("point", "sketch"), "point").select(
                F.xxhash64("node", "c", F.element_at("sketch", F.col("c") + 1)).alias("node"), "point")
    leaves = small[0]
    for more in small[1:]:
        leaves = leaves.unionByName(more)
    # A leaf holds at most ``leaf`` points, so its list is bounded; equal leaves of several trees are compared once.
    members = leaves.groupBy("node").agg(F.sort_array(F.collect_set("point")).alias("points")).select("points").distinct()
    members = written(members.select(F.xxhash64("points").alias("leaf"), F.explode("points").alias("point")), "leaves")
    full = members.join(points.select("point", "sketch"), "point").groupBy("leaf").agg(F.collect_list(F.struct("point", "sketch")).alias("own"))
    near = map_arrow(full, lambda batch: _compare_leaves(batch, loose), "a binary, b binary")
    first = rest.groupBy("node").agg(F.min("point").alias("a"))
    whole = rest.join(first, "node").select("a", F.col("point").alias("b"))
    return near.unionByName(whole).where("a != b").distinct()


def _compare_leaves(batch: pa.RecordBatch, loose: float) -> pa.RecordBatch:
    a, b = [], []
    column = batch.column("own")
    own = column.flatten()
    keys = own.field("point").to_pylist()
    sketches = own.field("sketch").flatten().to_numpy().reshape(-1, COORDINATES)
    offsets = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    for s, e in zip(offsets[:-1], offsets[1:]):
        at = sketches[s:e]
        like = (at[:, None, :] == at[None, :, :]).mean(axis=2) >= loose
        for i, j in _spanning(e - s, lambda q, left: left[like[q, left]]):
            a.append(keys[s + i])
            b.append(keys[s + j])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _spanning(n: int, linked, first: int | None = None):
    """Edges of a spanning forest.  ``linked(q, left)`` gives those of ``left`` that are linked with q."""
    left = np.arange(n)
    while len(left):
        start = first if first is not None and first in left else int(left[0])
        first = None
        left = left[left != start]
        queue = [start]
        while queue and len(left):
            q = queue.pop()
            near = linked(q, left)
            for x in near.tolist():
                yield q, x
            queue.extend(near.tolist())
            left = left[~np.isin(left, near)]


class Sets:
    """Full sets side by side; compares one with all others exactly."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        unique, self.value = np.unique(values, return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.has = np.zeros(len(unique), bool)

    def linked(self, q: int, left: np.ndarray) -> np.ndarray:
        own = self.value[self.begin[q]:self.begin[q + 1]]
        self.has[own] = True
        common = np.bincount(self.owner[self.has[self.value]], minlength=len(self.sizes))
        self.has[own] = False
        union = self.sizes + len(own) - common
        return left[100 * common[left] >= SIMILAR * union[left]]


def confirmed_edges(docs: DataFrame, groups: DataFrame, *, id_col="doc_id", text_col="text", block=BLOCK) -> DataFrame:
    """Edges (a, b), each between sets that are similar enough, whose components are those of all such pairs
    within each group.  ``groups``: point, doc_id (of one row with this set), root."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"), F.min("point").alias("first")).where("n > 1")
    dealt = groups.join(sizes, "root").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn(
        "block", F.when(F.col("point") == F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))))
    texts = id_column(docs, id_col, text_col).join(dealt.select("doc_id", "root", "point", "block", "blocks", F.lit(True).alias("used")), "doc_id")

    def sets(batch):
        own = shingle_sets(batch.column("text"))
        right = [hashlib.md5(s.tobytes()).digest() == p for s, p in zip(own, batch.column("point").to_pylist())]  # a doc_id may have several rows
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "point", "block", "blocks")), pa.array([s.tobytes() for s in own], pa.binary())],
                                         names=["root", "point", "block", "blocks", "values"])
        return out.filter(pa.array(right, pa.bool_()))

    full = map_arrow(texts, sets, "root binary, point binary, block array<int>, blocks int, values binary").dropDuplicates(["point"])
    full = written(full, "sets")

    def search(table: pa.Table) -> pa.Table:
        keys = table.column("point").to_pylist()
        many = table.column("blocks")[0].as_py() > 1
        root = table.column("root")[0].as_py()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        store = Sets([np.frombuffer(table.column("values")[i].as_py(), np.uint64) for i in order])
        star = np.arange(len(order))
        for i, j in _spanning(len(order), store.linked, 0):  # the group's first point has the least key
            star[j] = star[i]
        alone = star != 0 if many else np.zeros(len(order), bool)  # not joined to the first point in this block
        return pa.table({"a": pa.array([keys[order[i]] for i in star], pa.binary()), "b": pa.array([keys[i] for i in order], pa.binary()),
                         "root": pa.array([root] * len(order), pa.binary()), "alone": pa.array(alone)})

    spread = full.withColumn("block", F.explode("block"))
    found = written(spread.groupBy("root", "block").applyInArrow(search, "a binary, b binary, root binary, alone boolean"), "links")

    # Points apart from the first one are queries against all blocks of their group, ``block`` queries at a time.
    alone = found.where("alone").select(F.col("b").alias("point"), "root")
    asked = alone.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    queries = full.drop("block").join(alone.select("point"), "point").join(asked, "root").withColumn("chunk", F.pmod(F.xxhash64("point", F.lit(1)), F.col("chunks")).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("star", F.lit(None).cast("binary"))
    stars = found.select(F.col("b").alias("point"), F.col("a").alias("star"), "root").join(asked, "root").dropDuplicates(["point"])
    others = spread.where("blocks > 1").join(stars.drop("root"), "point").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def ask(table: pa.Table) -> pa.Table:
        keys, stars = table.column("point").to_pylist(), table.column("star").to_pylist()
        store = Sets([np.frombuffer(v.as_py(), np.uint64) for v in table.column("values")])
        every = np.array([i for i, x in enumerate(stars) if x is not None], np.int64)
        edges = {(stars[x], keys[q]) for q, x_ in enumerate(stars) if x_ is None for x in store.linked(q, every).tolist()}  # one for each star it touches
        return pa.table({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})

    columns = ["root", "block", "chunk", "point", "values", "star"]
    across = queries.select(*columns).unionByName(others.select(*columns)).groupBy("root", "block", "chunk").applyInArrow(ask, "a binary, b binary")
    return found.where("a != b").select("a", "b").unionByName(across.where("a != b"))


def cluster(docs: DataFrame, *, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept, for every row.  Rows of one id are
    clustered by their own texts; other columns of ``docs`` play no part."""
    out = _labelled(written(signatures(docs, id_col=id_col, text_col=text_col), "signatures"), docs, id_col, text_col, **kw)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _labelled(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """``rows`` (of ``signatures``) with component_id and the least point ``chosen`` of the component among those with that id (null for no point)."""
    points = written(rows.where("point is not null").groupBy("point").agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch")), "points")
    loose = components(loose_edges(points, **kw), "loose")
    grouped = loose.withColumnRenamed("node", "point").unionByName(loose.select(F.col("root").alias("point"), "root").distinct())
    groups = grouped.join(points.select("point", "doc_id"), "point")
    links = components(confirmed_edges(docs, groups, id_col=id_col, text_col=text_col), "linked")
    # Points linked with another; all others are their own component.
    least = links.withColumnRenamed("node", "point").unionByName(links.select(F.col("root").alias("point"), "root").distinct())
    least = least.join(points.select("point", "doc_id"), "point")
    ids = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = points.select("point", "doc_id").join(least.select("point", "root").join(ids, "root").select("point", "component_id"), "point", "left").select(
        "point", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.drop("sketch").join(named, "point", "left")


def keep_one(docs: DataFrame, *, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """One row of ``docs`` for each component: that with its least id, then the least digest of its text, then the least
    by its other columns in their order.  Rows with a null id and rows without words stay, each as it is."""
    rows = written(signatures(docs, id_col=id_col, text_col=text_col, copies=True), "signatures")
    named = written(_labelled(rows, docs, id_col, text_col, **kw).where("point is not null").select("doc_id", "txt", "component_id"), "labels")
    pair = F.struct("doc_id", "txt")
    least = named.groupBy("component_id").agg(F.min(pair).alias("least"))
    pairs = named.groupBy("doc_id", "txt").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    judged = written(pairs.join(least, "component_id").select(F.col("doc_id").alias("__id"), F.col("txt").alias("__txt"), "n", (pair == F.col("least")).alias("__kept"))
                     .where("not __kept or n > 1"), "gone")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # packed, so that no name of the caller's clashes
    keyed = docs.select(own.alias("__row"), F.col(id_col).cast("long").alias("__id"), _text_digest(text_col).alias("__txt"))
    # The same join at every size: texts are shuffled once, also where a small table would be broadcast.
    once = keyed.join(judged.hint("shuffle_hash"), ["__id", "__txt"], "left_anti").select("__row.*")
    if judged.where("__kept").isEmpty():  # no two rows of one id and text
        return once
    # Equal ids with equal texts: the least row of each, by an aggregate, so a hot one is cut down map-side.
    several = keyed.join(judged.where("__kept").select("__id", "__txt"), ["__id", "__txt"]).groupBy("__id", "__txt").agg(F.min("__row").alias("__row"))
    return once.unionByName(several.select("__row.*"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 75 * (na.n + nb.n - both_)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, doc_id = m.c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
