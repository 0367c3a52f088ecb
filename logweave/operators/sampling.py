"""Per-group sampling, ranking and ordering.

All group-wise ranks are computed so that one huge group never lands in one
task: ``group_cap`` salts the group before a first top-k, and
``group_row_number`` deals rows by range over group and order and adds the sizes
of earlier pieces.  Random choices use a seeded hash order (md5 of the line id and a
seed), so results do not depend on partitioning.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.normalise import normalise_ellipsis
from logweave.functions.text import tokenize
from logweave.session import cut_lineage

DEFAULT_SALTS = 64


def hash_order(seed: str | int = 0, id_col: str = "line_id") -> Column:
    """Seeded pseudo-random order key (same value in Spark and DuckDB)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def group_cap(df: DataFrame, group_cols: Sequence[str], k: int, order: Column,
              salts: int = DEFAULT_SALTS) -> DataFrame:
    """Keep the first ``k`` rows of every group by ``order`` (exact top-k).

    Two levels: top-k inside ``(group, salt)`` pieces, then top-k of the at most
    ``k * salts`` survivors per group, so a hot group is split across tasks.
    """
    g = list(group_cols)
    keyed = df.withColumn("__o", order).withColumn("__salt", F.pmod(F.xxhash64("__o"), F.lit(salts)))
    w1 = Window.partitionBy(*g, "__salt").orderBy("__o")
    first = keyed.withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= k)
    w2 = Window.partitionBy(*g).orderBy("__o")
    return first.withColumn("__r", F.row_number().over(w2)).filter(F.col("__r") <= k) \
        .drop("__salt", "__r").withColumnRenamed("__o", "sample_order")


def group_row_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                     out: str = "rn", pieces: int | None = None) -> DataFrame:
    """Exact 1-based row number within each group without sorting a whole group
    in one task.

    Rows are dealt by range over (group, order columns, a seeded random tie-break) into ``pieces``
    partitions (the session's shuffle partitions if None).  The borders are quantiles of
    that key by row count, so neither a hot group nor an order value that most rows share
    fills a partition; nulls come first, as in Spark's ascending order.  The dealt rows are
    written once, with the number of their piece, so that all reads agree; rows are numbered inside each (group,
    piece) and the sizes of the earlier pieces of the group are added.  Rows that are equal in group and
    order columns are numbered in any order among themselves.
    """
    g, o = list(group_cols), list(order_cols)
    keyed = cut_lineage(_dealt_by_rank(df, [*g, *o], pieces))
    local = keyed.withColumn("__lr", F.row_number().over(Window.partitionBy(*g, "__bk").orderBy(*o)))
    sizes = keyed.groupBy(*g, "__bk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*g).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    # One short row a piece and group; null-safe, as a group key may be null.
    offs = sizes.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], F.col("__bk").alias("__piece"),
                        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    same = F.col("__bk") == F.col("__piece")
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return local.join(offs, same).withColumn(out, F.col("__off") + F.col("__lr")).select(*df.columns, out)


def _dealt_by_rank(df: DataFrame, keys: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``df`` dealt by quantiles of its keys, ties by a seeded random number, and ``__bk``, the number of a row's piece."""
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__tie", F.rand(7)).repartitionByRange(n, *keys, "__tie")
    return dealt.withColumn("__bk", F.spark_partition_id()).drop("__tie")


def spaced_rows(df: DataFrame, group_cols: Sequence[str], order_col: str = "line_id",
                max_check: int = 1000) -> DataFrame:
    """Evenly spaced rows per group: index ``i*step`` for ``i < min(max_check, n)``
    with ``step = max(1, n // max_check)``, plus the last row (0-based index)."""
    g = list(group_cols)
    ranked = group_row_number(df, g, [order_col], "rn")
    sizes = df.groupBy(*g).agg(F.count(F.lit(1)).alias("group_rows"))
    r = ranked.join(sizes, g)
    step = F.greatest(F.lit(1), F.floor(F.col("group_rows") / max_check))
    idx = F.col("rn") - 1
    keep = ((F.pmod(idx, step) == 0) & (F.floor(idx / step) < F.least(F.lit(max_check), F.col("group_rows")))) \
        | (idx == F.col("group_rows") - 1)
    return r.filter(keep).withColumn("row_index", idx).drop("rn")


def group_order(groups: DataFrame, group_col: str = "template") -> DataFrame:
    """Order of groups: word count of the group's first line, ties by group key.

    Returns ``dataset, group_col, first_line, first_words, group_rank``.
    """
    first = groups.groupBy("dataset", group_col).agg(
        F.min_by(F.struct("line_id", "content"), F.col("line_id")).alias("f"))
    first = first.select("dataset", group_col, F.col("f.line_id").alias("first_line"),
                         F.size(tokenize(F.col("f.content"))).alias("first_words"))
    return group_row_number(first, ["dataset"], ["first_words", group_col], "group_rank")


def longest_line(groups: DataFrame, group_col: str = "template", unicode: bool = True) -> DataFrame:
    """Longest line (most words, then smallest id) per group."""
    n = F.size(tokenize(F.col("content"), unicode))
    return groups.groupBy("dataset", group_col).agg(
        F.max_by(F.struct("line_id", "content"), F.struct(n.alias("n"), (-F.col("line_id")).alias("i"))).alias("l")) \
        .select("dataset", group_col, F.col("l.line_id").alias("line_id"), F.col("l.content").alias("content"))


# ---------------------------------------------------------------------------
# Diverse sample (farthest-point on at most ``max_logs`` lines per group)
# ---------------------------------------------------------------------------
def _bag_jaccard_distance(a: list[str], b: list[str]) -> float:
    from collections import Counter
    ca, cb = Counter(a), Counter(b)
    inter = sum((ca & cb).values())
    union = sum((ca | cb).values())
    return 1.0 - (inter / union if union else 1.0)


def _cosine_distance(x: str, y: str) -> float:
    import re
    from collections import Counter
    tok = re.compile(r"(?u)\b\w\w+\b")
    vx = Counter(t.lower() for t in tok.findall(x))
    vy = Counter(t.lower() for t in tok.findall(y) if t.lower() in vx)
    nx = np.sqrt(sum(v * v for v in vx.values()))
    ny = np.sqrt(sum(v * v for v in vy.values()))
    if nx == 0 or ny == 0:
        return 1.0
    return 1.0 - sum(vx[t] * vy[t] for t in vy) / (nx * ny)


def diverse_pick(contents: list[str], k: int, similarity: str = "jaccard", nearest: bool = False) -> list[int]:
    """Indices of a diverse sample: the longest line first, then repeatedly the
    line whose minimum distance to the chosen set is largest (smallest when
    ``nearest``)."""
    n = len(contents)
    k = min(k, n)
    if k == 0:
        return []
    if similarity == "random":
        return list(range(k))
    toks = [c.split() for c in contents]
    if similarity == "jaccard":
        dist = lambda i, j: _bag_jaccard_distance(toks[i], toks[j])
    elif similarity == "cosine":
        dist = lambda i, j: _cosine_distance(contents[i], contents[j])
    else:
        raise ValueError(similarity)
    first = max(range(n), key=lambda i: len(toks[i]))
    chosen = [first]
    remaining = [i for i in range(n) if i != first]
    mind = {i: dist(i, first) for i in remaining}
    while len(chosen) < k and remaining:
        pick = (min if nearest else max)(remaining, key=lambda i: mind[i])
        chosen.append(pick)
        remaining.remove(pick)
        for i in remaining:
            d = dist(i, pick)
            if d < mind[i]:
                mind[i] = d
    return chosen


def diverse_sample(groups: DataFrame, k: int = 5, max_logs: int = 200, similarity: str = "jaccard",
                   nearest: bool = False, group_cols: Sequence[str] = ("dataset", "template"),
                   seed: str | int = 0) -> DataFrame:
    """Diverse sample of ``k`` lines per group.

    Each group is first capped to ``max_logs`` lines by seeded hash order
    (skew-safe ``group_cap``); the greedy farthest-point pass then runs in a
    grouped pandas function on at most ``max_logs`` rows.
    Returns group cols + ``line_id, content, sample_rank``.
    """
    g = list(group_cols)
    capped = group_cap(groups.select(*g, "line_id", "content"), g, max_logs, hash_order(seed))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_order", kind="stable").reset_index(drop=True)
        idx = diverse_pick(pdf["content"].fillna("").tolist(), k, similarity, nearest)
        out = pdf.iloc[idx][g + ["line_id", "content"]].copy()
        out["sample_rank"] = np.arange(1, len(idx) + 1, dtype=np.int64)
        return out

    schema = ", ".join(f"{c} {t}" for c, t in capped.select(*g, "line_id", "content").dtypes) + \
        ", sample_rank long"
    return capped.groupBy(*g).applyInPandas(fn, schema)


def centre_sample(groups: DataFrame, k: int = 30, min_threshold: float = 0.6, cap: int = 500,
                  group_cols: Sequence[str] = ("dataset", "template"), seed: str | int = 0) -> DataFrame:
    """Lines similar to the group's centre line.

    Groups of at most ``k`` lines are returned whole.  Larger groups are capped
    to ``cap`` lines by hash order; the centre is the middle line in that order;
    lines with set-Jaccard in ``[min_threshold, 0.99]`` to it come first (hash
    order), exact-like copies (> 0.99) fill up to ``k``.  Empty lines are skipped.
    """
    g = list(group_cols)
    base = groups.select(*g, "line_id", "content")
    sizes = base.groupBy(*g).agg(F.count(F.lit(1)).alias("group_rows"))
    capped = group_cap(base, g, cap, hash_order(seed))
    capped = capped.withColumn("pos", F.row_number().over(Window.partitionBy(*g).orderBy("sample_order")) - 1)
    capped = capped.join(sizes, g)
    n_capped = F.least(F.col("group_rows"), F.lit(cap))
    centre = capped.filter(F.col("pos") == F.floor(n_capped / 2)).select(
        *g, F.array_distinct(F.split(normalise_ellipsis(F.col("content")), "(?U)\\s+")).alias("centre_words"))
    words = F.array_distinct(F.filter(F.split(normalise_ellipsis(F.col("content")), "(?U)\\s+"), lambda w: w != ""))
    cw = F.filter(F.col("centre_words"), lambda w: w != "")
    union = F.size(F.array_union(words, cw))
    sim = F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words, cw)) / union)
    scored = capped.join(centre, g).withColumn("sim", sim) \
        .filter(F.trim(F.col("content")) != "")
    kind = F.when(F.col("sim") > 0.99, F.lit(2)).when(F.col("sim") >= min_threshold, F.lit(1))
    scored = scored.withColumn("kind", kind).filter(F.col("kind").isNotNull()) \
        .withColumn("o2", hash_order(f"{seed}:shuffle"))
    w = Window.partitionBy(*g).orderBy("kind", "o2")
    picked = scored.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= k) \
        .select(*g, "line_id", "content", "sample_rank", "group_rows")
    small = base.join(sizes.filter(F.col("group_rows") <= k), g).select(
        *g, "line_id", "content", F.lit(None).cast("int").alias("sample_rank"), "group_rows")
    return picked.filter(F.col("group_rows") > k).unionByName(small).drop("group_rows")
