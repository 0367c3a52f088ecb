"""Template mining: fixed-depth prefix routing + greedy similarity clustering.

Plan (all JVM until step 3):

1. mask and tokenise every line;
2. collapse lines to distinct masked patterns per dataset (map-side combine);
3. patterns shorter than ``depth`` tokens are their own group (exact text);
4. the rest are written once and clustered per ``(dataset, n)``
   over **patterns only**, in first-occurrence order: prefix routing on the
   first ``depth-1`` tokens, best template by similarity (ties: more
   wildcards, then the older cluster), merge when similarity >= ``st``;
   parts of the tree that provably never meet (by the tokens' first ids, at
   every size) are dealt to different tasks, which stream them;
5. a template is its pattern with some tokens replaced, so only the places of
   those come back, for patterns that have any, and join the lines on a digest of
   the pattern; the event id is the 8-hex md5 prefix of the template, grouping is
   by the full template text.
"""

from __future__ import annotations

from array import array
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.masking import mask_by_data, mask_data, mask_variables
from logweave.functions.text import tokenize
from logweave.session import cut_lineage, sent, spread

WILD = "<*>"
_WILD_ID = 0


# ---------------------------------------------------------------------------
# In-group clustering (runs inside one task on one bounded group)
# ---------------------------------------------------------------------------
class _Node:
    __slots__ = ("kids", "leaf", "elsewhere")

    def __init__(self, elsewhere: int = 0):
        self.kids: dict = {}
        self.leaf = None
        self.elsewhere = elsewhere  # children whose branches are held by other tasks


#: Templates of a leaf that are compared one by one before they are indexed.
_SCAN = 512
#: Pairs of tokens that are put into an index at once.
_ENTERED = 1 << 18
_ODD, _MIX, _SALT, _BITS = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


class _Leaf:
    """Templates of one tree leaf as a growing token-id matrix.

    A sequence only joins a template that shares ``need`` of its tokens outside the ``fixed`` positions, which all
    sequences of the leaf share.  With those positions dealt into ``need`` - 1 sets, two of the shared ones fall into
    the same set, so the templates that have a pair of tokens within a set in common hold every one that it could join: only these are
    compared.  Templates lose tokens and never gain any, so a pair once entered is at worst an idle candidate.
    """

    __slots__ = ("mat", "wild", "gid", "size", "width", "fixed", "st", "need", "pairs", "head", "next", "mask")

    def __init__(self, width: int, fixed: Sequence[int] = (), st: float = 0.0):
        self.mat = np.zeros((8, max(width, 1)), dtype=np.int32)
        self.wild = np.zeros(8, dtype=np.int64)
        self.gid = np.zeros(8, dtype=np.int64)
        self.size = 0
        self.width, self.fixed, self.st = width, fixed, st
        self.need, self.pairs = 1, None
        self.head = None

    def add(self, ids: np.ndarray, gid: int) -> None:
        if self.size == len(self.gid):
            cap = 2 * len(self.gid)
            self.mat = np.resize(self.mat, (cap, self.mat.shape[1]))
            self.wild = np.resize(self.wild, cap)
            self.gid = np.resize(self.gid, cap)
        self.mat[self.size, :len(ids)] = ids
        self.wild[self.size] = int((ids == _WILD_ID).sum())
        self.gid[self.size] = gid
        self.size += 1
        if self.size > _SCAN and self.need > 0:
            if self.pairs is None:
                self._choose()
            if self.need <= 0:
                return
            if self.head is None or self.size * len(self.pairs) > 2 * self.mask:
                self._index()
            else:
                self._enter(self.size - 1, self._hashes(ids))

    def _choose(self) -> None:
        """``need`` and the pairs of positions that are indexed."""
        n = max(self.width, 1)
        self.need = next((k for k in range(self.width + 1) if k / n >= self.st), self.width + 1) - len(self.fixed)
        free = sorted(set(range(self.width)) - set(self.fixed))
        pairs = []
        if 2 <= self.need <= len(free) <= 8 * (self.need - 1):
            pairs = [(a, b) for part in np.array_split(free, self.need - 1) for i, a in enumerate(part) for b in part[i + 1:]]
        if not pairs:  # a token that is shared is among any len(free) - need + 1 positions
            pairs = [(a, a) for a in free[:max(len(free) - self.need + 1, 0)]]
        self.pairs = [(int(a), int(b), i * _SALT & _BITS) for i, (a, b) in enumerate(pairs)]

    def _hashes(self, ids: np.ndarray) -> list[int]:
        """A hash of every pair of a sequence (0 for one with a wildcard): that of ``_index``, cheaper for a single one."""
        t = ids.tolist()
        out = []
        for a, b, salt in self.pairs:
            x, y = t[a], t[b]
            h = ((x * _ODD + y) * _MIX + salt) & _BITS
            out.append(h ^ h >> 29 | 1 if x != _WILD_ID and y != _WILD_ID else 0)
        return out

    def _enter(self, row: int, hashes: list[int]) -> None:
        at = row * len(self.pairs)
        head, follow, mask = self.head, self.next, self.mask
        for i, h in enumerate(hashes):
            slot = h >> 20 & mask
            if h:
                follow.append(head[slot])
                head[slot] = at + i
            else:
                follow.append(-1)

    def _index(self) -> None:
        """All pairs chained by hash in flat arrays, of twice as many chains as before; they are entered a block of rows at a
        time, so that what this takes beside the arrays is bounded."""
        width = len(self.pairs)
        n = self.size * width
        self.mask = (1 << max(n.bit_length(), 4)) - 1
        kind = "i" if n < 1 << 29 else "q"  # until the next index there are four times as many
        self.head = self.next = None
        self.head, self.next = (array(kind, [-1]) * size for size in (self.mask + 1, n))
        head, follow = (np.frombuffer(x, np.int32 if kind == "i" else np.int64) for x in (self.head, self.next))
        one, two = (np.array([p[i] for p in self.pairs], dtype=np.int64) for i in (0, 1))
        salt = np.array([p[2] for p in self.pairs], dtype=np.uint64)
        step = max(1, _ENTERED // max(width, 1))
        for a in range(0, self.size, step):
            rows = self.mat[a:min(a + step, self.size), :self.width]
            x, y = rows[:, one].astype(np.uint64), rows[:, two].astype(np.uint64)
            h = (x * np.uint64(_ODD) + y) * np.uint64(_MIX) + salt
            slots = ((h ^ (h >> np.uint64(29))) >> np.uint64(20) & np.uint64(self.mask)).astype(np.int64)
            slots = np.where((x == _WILD_ID) | (y == _WILD_ID), -1, slots).ravel()
            order = np.argsort(slots, kind="stable")
            own = slots[order]
            order, own = order[own >= 0] + a * width, own[own >= 0]
            if not len(own):
                continue
            opens = np.concatenate([[True], own[1:] != own[:-1]])
            follow[order[opens]] = head[own[opens]]
            follow[order[1:][~opens[1:]]] = order[:-1][~opens[1:]]
            last = np.append(opens[1:], True)
            head[own[last]] = order[last]
        del head, follow  # a buffer that is looked into could not grow

    def near(self, ids: np.ndarray) -> list[int]:
        """Rows that share an indexed pair with a sequence, oldest first: every template that it could join, and few others."""
        found, head, follow, mask, width = set(), self.head, self.next, self.mask, len(self.pairs)
        for h in self._hashes(ids):
            if h:
                e = head[h >> 20 & mask]
                while e >= 0:
                    found.add(e // width)
                    e = follow[e]
        return sorted(found)

    def best(self, ids: np.ndarray) -> tuple[int, int]:
        """(row, tokens in common) of the closest template (ties: more wildcards, then the older one), if any is close enough;
        row -1 if there is none."""
        n = len(ids)
        if self.head is None:
            mat, wild, rows = self.mat[:self.size, :n], self.wild[:self.size], None
        else:
            rows = np.array(self.near(ids), dtype=np.int64)
            if not len(rows):
                return -1, 0
            mat, wild = self.mat[rows, :n], self.wild[rows]
        same = ((mat == ids) & (mat != _WILD_ID)).sum(axis=1)
        b = int(np.argmax(same * (n + 1) + wild))
        return (b if rows is None else int(rows[b])), int(same[b])


def _has_digit(tok: str) -> bool:
    return any(ch.isdigit() for ch in tok)


class PrefixClusterer:
    """Greedy clustering of equal-length token sequences (one ``n``).

    A part of a tree: all sequences share the path to the node of level ``rest``, which has ``elsewhere`` further children
    that none of them can reach (``rest`` under 0: the whole tree, or one of its leaves).
    """

    def __init__(self, depth: int, st: float, max_child: int, rest: int = -1, elsewhere: int = 0):
        self.levels = max(depth - 1, 0)
        self.st = st
        self.max_child = max_child
        self.rest, self.elsewhere = rest, elsewhere
        self.root = _Node(elsewhere if rest == 0 else 0)
        self.vocab = {WILD: _WILD_ID}
        self.templates: list[np.ndarray] = []
        self.leaves: list[_Leaf] = []  # of every cluster, and its row there
        self.rows = array("i")

    def _ids(self, tokens: Sequence[str]) -> np.ndarray:
        v = self.vocab
        return np.fromiter((v.setdefault(t, len(v)) for t in tokens), dtype=np.int32, count=len(tokens))

    def _find_leaf(self, tokens):
        node = self.root
        for tok in tokens[:self.levels]:
            nxt = node.kids.get(tok)
            if nxt is None:
                nxt = node.kids.get(WILD)
            if nxt is None:
                return None
            node = nxt
        return node.leaf

    def _child(self, level: int) -> _Node:
        return _Node(self.elsewhere if level + 1 == self.rest else 0)

    def _insert_leaf(self, tokens, width: int) -> _Leaf:
        node, fixed = self.root, []
        for level, tok in enumerate(tokens[:self.levels]):
            kids = node.kids
            nxt, name = kids.get(tok), tok
            if nxt is None:
                many = len(kids) + node.elsewhere
                if _has_digit(tok):
                    room = False
                elif WILD in kids:
                    room = many < self.max_child
                else:
                    room = many + 1 < self.max_child
                name = tok if room else WILD
                nxt = kids.get(name)
                if nxt is None:
                    nxt = kids[name] = self._child(level)
            node = nxt
            if name != WILD:
                fixed.append(level)
        if node.leaf is None:
            node.leaf = _Leaf(width, fixed, self.st)
        return node.leaf

    def add(self, tokens: Sequence[str]) -> int:
        """Route one sequence; returns its cluster number."""
        n = len(tokens)
        ids = self._ids(tokens)
        leaf = self._find_leaf(tokens)
        if leaf is not None and leaf.size:
            b, same = leaf.best(ids)
            if b >= 0 and float(same) / n >= self.st:
                row = leaf.mat[b, :n]
                merged = np.where(row == ids, row, _WILD_ID)
                leaf.mat[b, :n] = merged
                leaf.wild[b] = int((merged == _WILD_ID).sum())
                return int(leaf.gid[b])
        gid = len(self.leaves)
        target = self._insert_leaf(tokens, n)
        target.add(ids, gid)
        self.leaves.append(target)
        self.rows.append(target.size - 1)
        return gid

    @property
    def where(self) -> list[tuple[_Leaf, int]]:
        return list(zip(self.leaves, self.rows))

    def template(self, gid: int, n: int) -> str:
        inv = self._inverse()
        return " ".join(inv[i] for i in self.leaves[gid].mat[self.rows[gid], :n])

    def wild(self, gid: int, n: int) -> np.ndarray:
        """Which tokens of a template are wildcards; the others are those of every pattern in its cluster."""
        return self.leaves[gid].mat[self.rows[gid], :n] == _WILD_ID

    def wildcards(self, gid: int) -> int:
        return int(self.leaves[gid].wild[self.rows[gid]])

    def _inverse(self):
        if getattr(self, "_inv_len", -1) != len(self.vocab):
            self._inv = [None] * len(self.vocab)
            for t, i in self.vocab.items():
                self._inv[i] = t
            self._inv_len = len(self.vocab)
        return self._inv


# ---------------------------------------------------------------------------
# Spark operators
# ---------------------------------------------------------------------------
def masked_tokens(lines: DataFrame, masks: Sequence[str], unicode: bool = True,
                  content_col: str = "content") -> DataFrame:
    """Add ``masked``, ``pattern`` (whitespace-normalised masked text) and ``n_tokens``."""
    # Each step reads the previous column by name, so the masking regex and the
    # split run once per line (the optimizer keeps a non-cheap alias that is
    # used twice instead of inlining it).
    return _tokens_of(lines.withColumn("masked", mask_variables(F.col(content_col), masks, unicode)), unicode)


def _tokens_of(masked: DataFrame, unicode: bool) -> DataFrame:
    return masked.withColumn("__toks", tokenize(F.col("masked"), unicode)) \
        .withColumn("pattern", F.array_join("__toks", " ")) \
        .withColumn("n_tokens", F.size("__toks")).drop("__toks")


def pattern_counts(lines: DataFrame, masks: Sequence[str], unicode: bool = True) -> DataFrame:
    """Distinct masked patterns per dataset: ``dataset, pattern, n_tokens, n, first_id``."""
    m = masked_tokens(spread(lines.select("dataset", "line_id", "content")), masks, unicode).filter(F.col("content").isNotNull())
    return m.groupBy("dataset", "pattern").agg(
        F.first("n_tokens").alias("n_tokens"),
        F.count(F.lit(1)).alias("n"),
        F.min("line_id").alias("first_id"))


#: What the rows of one part of a tree share.
_PART = ["dataset", "n_tokens", "subtree", "rest", "elsewhere", "depth", "st"]
#: Rows that a task takes, and tokens that it gives back, at once.
_BATCH, _TOKENS = 1024, 1 << 20


def _cluster_parts(rows: DataFrame, max_child: int, tie: str) -> DataFrame:
    """Cluster the patterns of every part (``_PART``) in the order of (first_id, ``tie``); returns ``dataset, key, wild`` of
    the patterns that are not their own template: which of their tokens become wildcards.

    A task streams its parts one after another, so a part costs no more than its patterns.  Few bytes but
    much work a row: a stated number of partitions, which are not merged by size.
    """
    key_type = rows.schema["key"].dataType.simpleString()

    def batch_of(dataset, keys, wild):
        offsets = pa.array(np.cumsum([0, *map(len, wild)]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([dataset] * len(keys), pa.string()), pa.array(keys, pa.binary() if key_type == "binary" else pa.string()),
                                           pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(wild)))], names=["dataset", "key", "wild"])

    def batches_of(dataset, keys, gids, own, clusterer, n):
        held, wild = [], []
        for key, gid, wildcards in zip(keys, gids, own):
            if clusterer.wildcards(gid) > wildcards:
                held.append(key)
                wild.append(clusterer.wild(gid, n))
                if len(held) * n >= _TOKENS:
                    yield batch_of(dataset, held, wild)
                    held, wild = [], []
        if held:
            yield batch_of(dataset, held, wild)

    def run(batches):
        current, clusterer, keys, gids, own = None, None, [], array("i"), array("i")
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                for *part, key, pattern in zip(*(batch.column(c).to_pylist() for c in [*_PART, "key", "pattern"])):
                    if part != current:
                        if keys:
                            yield from batches_of(current[0], keys, gids, own, clusterer, current[1])
                        current, keys, gids, own = part, [], array("i"), array("i")
                        rest, elsewhere, depth, st = part[3:]
                        clusterer = PrefixClusterer(depth, st, max_child, rest, elsewhere)
                    tokens = pattern.split(" ") if pattern else []
                    keys.append(key)
                    gids.append(clusterer.add(tokens))
                    own.append(tokens.count(WILD))
        if keys:
            yield from batches_of(current[0], keys, gids, own, clusterer, current[1])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *_PART).sortWithinPartitions(*_PART, "first_id", tie)
    return dealt.select(*_PART, "key", "pattern").mapInArrow(run, f"dataset string, key {key_type}, wild array<boolean>")


#: Written bytes of the sure children of a level that are sent to every task.
SURE_BYTES = 8 << 20


def _subtrees(patterns: DataFrame, levels: int, max_child: int, tie: str) -> DataFrame:
    """Adds ``subtree, rest, elsewhere``: the part of the prefix tree that a pattern surely stays in.  A dataset's tree
    has ``depth`` - 1 of the ``levels`` levels.

    A node gives tokens a child of their own in the order in which they first come, until a token with a digit
    or a wildcard comes or the node is full; from then on a wildcard child may catch others.  The tokens from before (``max_child`` - 1 at most)
    surely have their own child, and every pattern with one of them goes there.  All other patterns of the node
    may meet: they are a part of their own (``rest`` is its level), which only has to know the number of sure children (``elsewhere``).  All
    this is read off the first ids of tokens, so the parts make the templates of the one tree.

    The sure children of a level, at most ``max_child`` - 1 a node, go to the patterns, which are not shuffled for it
    while those are few bytes.
    """
    start = {"subtree": F.lit(""), "rest": F.lit(-1), "elsewhere": F.lit(0)}
    rows = patterns.withColumn("heads", F.slice(F.split("pattern", " ", levels + 1), F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))))
    # The levels are settled on the distinct leading tokens.  Patterns that part at a token, which others follow, are in the order of the tokens.
    at = F.min("first_id" if tie == "pattern" else F.struct("first_id", tie)).alias("first")
    out = cut_lineage(rows.groupBy("dataset", "n_tokens", "heads", "depth").agg(at)).withColumns(start)
    rows = rows.withColumns(start)
    node = ["dataset", "n_tokens", "subtree"]

    def here(level: int):
        return (F.col("rest") < 0) & (F.col("depth") - 1 > level)

    def placed(df: DataFrame, sure: DataFrame, level: int) -> DataFrame:
        df = df.join(sure, node, "left")
        own = F.coalesce(F.array_contains("sure", F.get("heads", F.lit(level))), F.lit(False))
        return df.withColumns({"elsewhere": F.when(here(level) & ~own, F.coalesce(F.array_size("sure"), F.lit(0))).otherwise(F.col("elsewhere")),
                               "subtree": F.when(here(level) & own, F.concat_ws(" ", "subtree", F.get("heads", F.lit(level)))).otherwise(F.col("subtree")),
                               "rest": F.when(here(level) & ~own, level).otherwise(F.col("rest"))}).drop("sure")

    for level in range(levels):
        seen = out.filter(here(level)).groupBy(*node, F.get("heads", F.lit(level)).alias("token")).agg(F.min("first").alias("first"))
        mixed = F.col("token").rlike(r"\p{N}") | (F.col("token") == WILD)
        # No more than the first max_child tokens matter; Spark cuts every partition to them before the shuffle.
        place = F.row_number().over(Window.partitionBy(*node).orderBy("first", F.concat("token", F.lit(" "))))
        heads = seen.withColumn("place", place).filter(F.col("place") <= max_child).groupBy(*node).agg(
            F.array_sort(F.collect_list(F.struct("place", "token", mixed.alias("mixed")))).alias("heads_of"))
        until = F.array_position(F.col("heads_of.mixed"), F.lit(True)) - 1
        sure = cut_lineage(heads.select(*node, F.slice("heads_of", 1, F.when(until >= 0, until).otherwise(max_child - 1).cast("int"))["token"].alias("sure")))
        sure = sent(sure, SURE_BYTES)
        out, rows = placed(out, sure, level), placed(rows, sure, level)
    return rows.drop("heads")


def _mapping_bytes(wild: DataFrame) -> int:
    """Bytes of the wildcards of all patterns and a row's overhead."""
    r = wild.agg(F.count(F.lit(1)), F.sum(F.size("wild"))).first()
    return int(r[1] or 0) + 96 * int(r[0])


# Broadcast the wildcards of the patterns when they are below this many bytes.
BROADCAST_MAPPING_BYTES = 64 * 1024 * 1024


def _template(pattern: Column, wild: Column) -> Column:
    """A pattern with its ``wild`` tokens replaced (null: none)."""
    return F.when(wild.isNull(), pattern).otherwise(
        F.array_join(F.zip_with(F.split(pattern, " "), wild, lambda token, w: F.when(w, F.lit(WILD)).otherwise(token)), " "))


def _wild_tokens(patterns: DataFrame, max_depth: int, max_child: int, tie: str) -> DataFrame:
    """``dataset, key, wild`` of the rows of at least ``depth`` tokens that are not their own template."""
    long = _subtrees(patterns.filter(F.col("n_tokens") >= F.col("depth")), max(max_depth - 1, 0), max_child, tie)
    return _cluster_parts(long.select(*_PART, "key", "first_id", "pattern"), max_child, tie)


def cluster_patterns(patterns: DataFrame, depth: int = 4, st: float = 0.5, max_child: int = 100) -> DataFrame:
    """Cluster rows ``dataset, key, pattern, n_tokens, first_id``; returns ``dataset, key, template``.

    Rows shorter than ``depth`` tokens keep their own pattern as template.  The
    others are dealt by branches of the prefix tree that stand apart, so that the
    templates are those of one tree per length at every size.
    """
    one = patterns.withColumn("depth", F.lit(depth)).withColumn("st", F.lit(float(st)))
    return cluster_profiled(one, depth, max_child)


def cluster_profiled(patterns: DataFrame, max_depth: int, max_child: int = 100) -> DataFrame:
    """``cluster_patterns`` with ``depth`` (int, at most ``max_depth``) and ``st`` as columns that hold one value a dataset."""
    wild = _wild_tokens(patterns, max_depth, max_child, "key")
    return patterns.join(wild, ["dataset", "key"], "left").select("dataset", "key", _template(F.col("pattern"), F.col("wild")).alias("template"))


def event_id(template) -> Column:
    t = F.col(template) if isinstance(template, str) else template
    return F.substring(F.md5(F.coalesce(t, F.lit(""))), 1, 8)


def mine_templates(lines: DataFrame, masks: Sequence[str], depth: int = 4, st: float = 0.5,
                   max_child: int = 100, unicode: bool = True) -> DataFrame:
    """Mine templates for ``dataset, line_id, content`` lines.

    Returns ``dataset, line_id, content, template, event_id``; a null line keeps
    a null template.  Patterns are distinct ones in the order of their first line; the
    lines are read again for the final join on the pattern.
    """
    own = spread(lines.select("dataset", "line_id", "content")).withColumn("depth", F.lit(depth)).withColumn("st", F.lit(float(st)))
    return _mined(own, lambda df: masked_tokens(df, masks, unicode), depth, max_child)


def _mined(lines: DataFrame, tokens: Callable[[DataFrame], DataFrame], max_depth: int, max_child: int) -> DataFrame:
    """Mine lines (``dataset, line_id, content, depth, st``), to which ``tokens`` adds ``pattern`` and ``n_tokens``: one shuffle
    of the patterns to tell the distinct ones and one to the tasks that cluster them."""
    digest = F.unhex(F.md5("pattern"))
    m = tokens(lines)
    # A line of fewer tokens is its own template.
    long = m.filter(F.col("content").isNotNull() & F.col("dataset").isNotNull() & (F.col("n_tokens") >= F.col("depth")))
    rows = cut_lineage(long.groupBy("dataset", "pattern", "depth", "st").agg(F.first("n_tokens").alias("n_tokens"), F.min("line_id").alias("first_id")))
    # Written once: callers read the mined lines more than once.
    wild = cut_lineage(_wild_tokens(rows.withColumn("key", digest), max_depth, max_child, "pattern"))
    if _mapping_bytes(wild) <= BROADCAST_MAPPING_BYTES:
        # Size checked above: the line side is not shuffled at all.
        out = m.withColumn("key", digest).join(F.broadcast(wild), ["dataset", "key"], "left")
    else:
        # A line travels with its text and its key; masking it again costs less than sending its pattern too.
        out = tokens(m.select(*lines.columns, digest.alias("key")).join(wild, ["dataset", "key"], "left"))
    template = F.when(F.col("content").isNotNull() & F.col("dataset").isNotNull(), _template(F.col("pattern"), F.col("wild")))
    return out.select("dataset", "line_id", "content", template.alias("template")) \
        .withColumn("event_id", F.when(F.col("template").isNotNull(), event_id("template")))


def mine_with_profiles(lines: DataFrame, profiles: DataFrame, max_child: int = 100, unicode: bool = True) -> DataFrame:
    """Mine many datasets in one job, each by its own profile row.

    ``profiles``: ``dataset, masks, depth, st``, one row a dataset.  A line takes its masks from the
    row of its dataset (an equi-join on the dataset, in which Spark broadcasts a profile table that is
    small), so the lines are scanned by one plan whatever the number of profiles, and the distinct
    patterns of all datasets go through one mining shuffle.  Lines of a dataset without a profile are left out.
    """
    deepest = profiles.agg(F.max("depth")).first()[0] or 0
    data = profiles.select("dataset", mask_data("masks", unicode).alias("mask"), F.col("depth").cast("int").alias("depth"),
                           F.col("st").cast("double").alias("st"))
    own = spread(lines.select("dataset", "line_id", "content")).join(data, "dataset")
    return _mined(own, lambda df: _tokens_of(df.withColumn("masked", mask_by_data("content", "mask")), unicode), int(deepest), max_child)


def profile_changes(lines: DataFrame, profiles: Sequence[tuple[str, Sequence[str]]], unicode: bool = True) -> DataFrame:
    """``profile, changed``: the lines that each profile's masks would change, over all lines.  One scan and one
    aggregate for all profiles (``(name, masks)`` pairs)."""
    masked = [F.count_if(mask_variables("content", masks, unicode) != F.col("content")).alias(f"p{i}") for i, (_, masks) in enumerate(profiles)]
    names = [F.struct(F.lit(name).alias("profile"), F.col(f"p{i}").alias("changed")) for i, (name, _) in enumerate(profiles)]
    return lines.agg(*masked).select(F.inline(F.array(*names)))


# ---------------------------------------------------------------------------
# Consensus, event counts, assignment
# ---------------------------------------------------------------------------
def consensus_template(df: DataFrame, group_col: str, text_col: str = "pattern",
                       unicode: bool = True) -> DataFrame:
    """Position-wise consensus of equal-length token lists: the token where all
    members agree, else ``<*>``.  Returns ``group_col, n_tokens, template``.
    """
    toks = df.select(group_col, tokenize(F.col(text_col), unicode).alias("t"))
    exploded = toks.select(group_col, F.size("t").alias("n_tokens"), F.posexplode("t").alias("pos", "tok"))
    per_pos = exploded.groupBy(group_col, "n_tokens", "pos").agg(
        F.min("tok").alias("lo"), F.max("tok").alias("hi"))
    per_pos = per_pos.select(group_col, "n_tokens", "pos",
                             F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(WILD)).alias("tok"))
    return per_pos.groupBy(group_col, "n_tokens").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda s: s["tok"]), " ")
        .alias("template"))


def event_counts(groups: DataFrame) -> DataFrame:
    """Occurrences per template: ``dataset, event_id, template, occurrences``."""
    return groups.filter(F.col("template").isNotNull()).groupBy("dataset", "template").agg(
        F.count(F.lit(1)).alias("occurrences")).withColumn("event_id", event_id("template")) \
        .select("dataset", "event_id", "template", "occurrences")


def assign_clusters(lines: DataFrame, clusters: DataFrame, masks: Sequence[str], st: float = 0.5,
                    unicode: bool = True) -> DataFrame:
    """Assign new lines to an existing cluster table by best similarity >= ``st``.

    ``clusters``: ``dataset, template``.  Similarity is the share of positions where line
    and template hold the same constant, so only templates that share a constant
    at a position with a pattern can count.  Distinct patterns and templates meet in an
    equi-join on (dataset, length, position, token), are counted map-side per pair, and the
    best pair per pattern is kept.  A line of no tokens or with no such
    template gets null.  Ties: higher similarity, then more wildcards, then the
    smaller template text.
    """
    m = masked_tokens(lines, masks, unicode)
    patterns = m.filter(F.col("pattern") != "").select("dataset", "n_tokens", "pattern").distinct()
    known = clusters.select("dataset", "template").distinct().withColumn("toks", F.split("template", " ")) \
        .withColumn("n_tokens", F.size("toks"))
    wild = F.size(F.filter("toks", lambda t: t == WILD))
    spots = known.select("dataset", "n_tokens", "template", wild.alias("wild"), F.posexplode("toks").alias("pos", "tok")).filter(F.col("tok") != WILD)
    seen = patterns.select("dataset", "n_tokens", "pattern", F.posexplode(F.split("pattern", " ")).alias("pos", "tok"))
    pairs = seen.join(spots, ["dataset", "n_tokens", "pos", "tok"]).groupBy("dataset", "n_tokens", "pattern", "template", "wild").agg(F.count(F.lit(1)).alias("same"))
    best = pairs.filter(F.col("same") / F.col("n_tokens") >= st).groupBy("dataset", "pattern").agg(
        F.min_by(F.struct("template", (F.col("same") / F.col("n_tokens")).alias("similarity")),
                 F.struct((-F.col("same")).alias("a"), (-F.col("wild")).alias("b"), F.col("template").alias("c"))).alias("best"))
    return m.join(best, ["dataset", "pattern"], "left").select("dataset", "line_id", "content", F.col("best.template").alias("template"), F.col("best.similarity").alias("similarity"))
