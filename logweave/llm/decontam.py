"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The benchmark is the stated query set.  Its windows (13 consecutive words of an
item; the whole of a shorter, non-empty item) are collected in blocks of about
``block_windows`` windows at most, each block is broadcast as a hash set, and the
training texts are scanned once per block; a larger benchmark means more blocks,
not a larger broadcast.  A hash hit is verified on the words themselves.

Defined results: null or empty text has no words, no hits and is not contaminated;
an item without words (or with null text) has no window; a null item_id is the
string ``null``; repeated rows of one item count once; with an empty benchmark
nothing is hit, with empty documents the result is empty.  Only the id and text
columns are read by name, and the carried row travels as one struct, so other
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import Words, byte_class, map_arrow, window_hashes, written

WIDTH = 13
BLOCK_WINDOWS = 500_000

#: Words are runs of ASCII letters (lower-cased), ASCII digits and all non-ASCII characters.
_OTHERS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
WORD, LOWER = byte_class(_OTHERS, lower=True)

_LOW = np.uint64((1 << 20) - 1)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_windows: int):
    """The benchmark in parts of about ``block_windows`` words at most, one at a time on the driver."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                             F.col(text_col).cast("string").alias("text")).where("text is not null")
    # A window starts at a word, and a word takes a byte and a separator.
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    n = int(size // block_windows) + 1
    for i in range(n):
        yield items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()


def grams_of(rows, width: int) -> dict[int, dict[int, dict[bytes, list[str]]]]:
    """window length -> hash -> its words -> items with it."""
    out: dict = {}
    words = Words(pa.array([r["text"] for r in rows], pa.large_string()), WORD, LOWER)
    for i, r in enumerate(rows):
        a, b = int(words.first[i]), int(words.first[i + 1])
        k = min(width, b - a)
        if k:
            for j, h in enumerate(window_hashes(words.hash[a:b], k).tolist()):
                found = out.setdefault(k, {}).setdefault(h, {}).setdefault(words.text(a + j, a + j + k), [])
                if r["item"] not in found:
                    found.append(r["item"])
    return out


class Scan:
    """Finds the verified windows of one block in a batch of texts."""

    def __init__(self, grams):
        self.grams, self.sets = grams, {}
        for k, by_hash in grams.items():
            keys = np.array(sorted(by_hash), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[keys & _LOW] = True
            self.sets[k] = keys, seen

    def __call__(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Indexes of the hit words, and the items found by row."""
        hit, items = [np.zeros(0, np.int64)], {}
        for k, (keys, seen) in self.sets.items():
            h = window_hashes(words.hash, k)
            at = np.flatnonzero(seen[h & _LOW])
            at = at[words.doc[at] == words.doc[at + k - 1]]
            at = at[np.isin(h[at], keys)]
            good = []
            for a in at.tolist():
                if found := self.grams[k][int(h[a])].get(words.text(a, a + k)):
                    good.append(a)
                    items.setdefault(int(words.doc[a]), set()).update(found)
            hit.append((np.array(good, np.int64)[:, None] + np.arange(k)).ravel())
        return np.unique(np.concatenate(hit)), items


def find_hits(docs: DataFrame, benchmark: DataFrame, *, carry=("doc_id",), text_col="text", item_col="item_id",
              item_text_col="text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(row: the carried columns, text, n_words, hits: positions of the hit words, items: sorted ids) per row."""
    spark = docs.sparkSession
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).cast("string").alias("text"),
                        F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<int>").alias("hits"),
                        F.lit(None).cast("array<string>").alias("items"))
    schema = state.schema
    for k, rows in enumerate(_blocks(benchmark, item_col, item_text_col, block_windows)):
        if k:
            state = written(state, "decontam")
        grams = spark.sparkContext.broadcast(grams_of(rows, width))

        def scan(batch, grams=grams, held=[]):
            if not held:
                held.append(Scan(grams.value))
            words = Words(batch.column("text"), WORD, LOWER)
            hit, items = held[0](words)
            old_hits, old_items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            doc = words.doc[hit]
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            hits, names = [], []
            for i in range(batch.num_rows):
                own = hit[cut[i]:cut[i + 1]] - words.first[i]
                hits.append(own if not old_hits[i] else np.union1d(own, old_hits[i]))
                names.append(sorted(items.get(i, set()) | set(old_items[i] or ())))
            return pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("text"), pa.array(np.diff(words.first), pa.int64()),
                pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=schema.names)

        state = map_arrow(state, scan, schema)
    return state


def contaminated():
    """The rule: at least one hit word, and hit words at least a twentieth of all."""
    return (F.size("hits") > 0) & (20 * F.size("hits") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    return find_hits(docs, benchmark, **kw).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col="text", **kw) -> DataFrame:
    """``docs`` without its contaminated rows; from the others the hit words are cut out, up to the next word that stays."""
    found = find_hits(docs, benchmark, carry=docs.columns, text_col=text_col, **kw).where(~contaminated())

    def cut(batch):
        hits = batch.column("hits").to_pylist()
        texts = batch.column("text").to_pylist()
        if any(hits):
            words = Words(batch.column("text"), WORD, LOWER)
            for i, own in enumerate(hits):
                if own:
                    raw, a, n = texts[i].encode(), int(words.first[i]), int(words.first[i + 1] - words.first[i])
                    gone = np.zeros(n + 1, bool)
                    gone[own] = True
                    begins = np.append(words.starts[a:a + n], words.offsets[i + 1]) - words.offsets[i]
                    out, at = [], 0
                    for j in np.flatnonzero(gone & ~np.roll(gone, 1)).tolist():
                        out.append(raw[at:begins[j]])
                        at = int(begins[j + int(np.argmin(gone[j:]))])
                    texts[i] = (b"".join(out) + raw[at:]).decode()
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "cleaned"])

    slim = found.select("row", "text", "hits")
    schema = slim.select("row", F.col("text").alias("cleaned")).schema
    out = map_arrow(slim, cut, schema)
    return out.select(*[(F.col("cleaned") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH it AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
it2 AS (SELECT item, w, least(13, len(w)) AS k FROM it WHERE len(w) > 0),
win AS (SELECT DISTINCT k, array_to_string(w[s : s + k - 1], ' ') AS g, item FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM it2)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, s, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks)),
hit AS (SELECT DISTINCT dw.doc_id, dw.k, dw.s, win.item FROM dw JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
