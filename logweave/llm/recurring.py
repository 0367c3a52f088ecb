"""Where texts repeat one another: anchors, copies and candidate regions.

A text is a sequence of symbols (words or bytes).  Among the ``width - k + 1`` k-grams
of every ``width`` consecutive symbols the one with the least hash, the last of equal
ones, is the window's anchor.  It depends on the window's content alone, so equal
windows have equal anchors, and about two k-grams in ``width - k + 2`` are anchors.  A
window can occur in two texts only if its anchor does; the regions around such
anchors hold every repeated window, and only they need exact work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import map_arrow, window_hashes, written

#: Windows whose anchors are found at once.
BLOCK = 1 << 15


def window_anchors(values: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the k-gram hashes, the place of every window's anchor); neighbouring blocks overlap by a window, and so are small arrays."""
    if len(values) <= BLOCK + width:
        return _block_anchors(values, k, width)
    hashes, places = [], []
    for a in range(0, len(values) - width + 1, BLOCK):
        h, at = _block_anchors(values[a:a + BLOCK + width - 1], k, width)
        hashes.append(h[:BLOCK] if a + BLOCK < len(values) - width + 1 else h)
        places.append(at + a)
    return np.concatenate(hashes), np.concatenate(places)


def _block_anchors(values: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    h = window_hashes(values, k)
    w = width - k + 1
    n = len(h) - w + 1
    if n <= 0:
        return h, np.zeros(0, np.int64)
    least, size = h, 1
    while size < w:
        step = min(size, w - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    # A window's anchor is the k-gram that enters with it, or that of the window before; where neither holds, which one is looked up.
    enters = h[w - 1:] == least
    at = np.where(enters, np.arange(w - 1, w - 1 + n), 0)
    changed = np.flatnonzero(np.concatenate([[not enters[0]], (least[1:] > least[:-1]) & ~enters[1:]]))
    same = h[changed[:, None] + np.arange(w - 1, -1, -1)] == least[changed][:, None]
    at[changed] = changed + w - 1 - np.argmax(same, axis=1)
    return h, np.maximum.accumulate(at)


def inside(first: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of those of the first n windows of joined texts that are within one text; text i begins at first[i]."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    start = np.flatnonzero(np.arange(width, n + width) <= first[text + 1])
    return start, text[start]


def text_anchors(values: np.ndarray, first: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in its text, text) of the distinct anchors of many texts, whose windows are looked at together."""
    h, at = window_anchors(values, k, width)
    start, text = inside(first, len(at), width)
    at = at[start]
    heads = np.concatenate([[True], at[1:] != at[:-1]])[:len(at)]  # an anchor is within its window's text
    at, text = at[heads], text[heads]
    return h[at], at - first[text], text


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty) and txt, a digest of the text."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn(
        "txt", F.unhex(F.md5(F.encode("text", "UTF-8"))))


def copies(rows: DataFrame) -> DataFrame:
    """(doc_id, txt) of the texts that occur under a smaller doc_id."""
    short = rows.select("doc_id", "txt").where("doc_id is not null")
    first = short.groupBy("txt").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return short.join(first.select("txt", "first"), "txt").where("doc_id > first").select("doc_id", "txt").distinct()


def occurrences(rows: DataFrame, symbols: Callable, k: int, width: int) -> DataFrame:
    """(h, doc_id, txt, at) of the anchors that occur in two different texts.  ``symbols(column)`` gives the
    values of all texts of a batch and the offset of each text's first value."""

    def run(batch):
        values, first = symbols(batch.column("text"))
        h, at, row = text_anchors(values, first, k, width)
        row = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("doc_id").take(row), batch.column("txt").take(row), pa.array(at)],
                                          names=["h", "doc_id", "txt", "at"])

    found = map_arrow(rows.where("doc_id is not null").select("doc_id", "txt", "text"), run, "h long, doc_id long, txt binary, at long")
    found = written(found, "anchors")
    # Eight bytes of the digest tell two texts with one anchor apart.
    tag = F.xxhash64("txt")
    again = found.groupBy("h").agg(F.min(tag).alias("least"), F.max(tag).alias("most")).where("least < most").select("h")
    again = written(again, "again")  # a join of two plain exchanges, whose hot anchors can be split
    return written(found.join(again, "h"), "recurring")


def regions(rows: DataFrame, found: DataFrame, gone: DataFrame, cut: Callable, k: int, width: int) -> DataFrame:
    """(doc_id, start, body) of the stretches of symbols that windows with a recurring anchor cover, of one row of
    every text.  ``cut(text, stretches)`` gives the bodies; ``gone`` are copies."""
    own = found.join(gone, ["doc_id", "txt"], "left_anti").groupBy("doc_id", "txt").agg(F.sort_array(F.collect_set("at")).alias("at"))
    joined = rows.join(own, ["doc_id", "txt"]).select("doc_id", "text", "at")

    def run(batch):
        ids, starts, bodies = [], [], []
        for doc, text, at in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("at").to_pylist()):
            at = np.array(at)
            lo, hi = at - (width - k), at + width
            opens = np.concatenate([[True], lo[1:] > hi[:-1]])
            stretches = list(zip(np.maximum(0, lo[opens]).tolist(), np.append(hi[:-1][opens[1:]], hi[-1]).tolist()))
            ids += [doc] * len(stretches)
            starts += [s for s, _ in stretches]
            bodies += cut(text, stretches)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "start", "body"])

    return written(map_arrow(joined, run, "doc_id long, start long, body binary"), "regions")
