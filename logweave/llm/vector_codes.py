"""Vector code compression: product codebooks by Lloyd rounds over partition-local cover trees.

A component x becomes the whole number floor(256 * x), and a vector is cut into ``parts`` equal stretches.  Each
stretch has a codebook, which starts as that stretch of the vectors with the smallest ids.  A round assigns every stretch to the nearest
entry (squared distance, ties to the lower index) and moves each entry to the componentwise floor of the mean of its stretches.

Tasks cut their vectors into blocks and build one cover tree per block and stretch (``cover_tree``), which are written
once to the shared folder.  A round reads the trees, gives whole subtrees to an entry by the triangle inequality with
cumulative sums, and compares only the points of ambiguous leaves.  Between tasks and driver go the codebooks alone:
``parts * entries`` rows of sums a round, summed by Spark.

Odd rows: vectors that are null or hold a null or non-finite component are dropped.  If widths differ or are no multiple of ``parts``, vectors
are filled with zeros up to the next multiple that holds the widest.  Whole numbers are held to +-2**26, so that every
squared distance fits 64 bits.  Null ids come last in the order of the first vectors, equal ids are ordered by their vectors, and
null labels are a label.  With fewer vectors than entries the codebooks have as many entries as vectors.  An empty table gives no rows.
Other columns of the caller play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import written
from logweave.llm.cover_tree import Forest, assign, build, ranges
from logweave.llm.totals import attach, group_key

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of a block, for which a task holds trees at once.
BLOCK = 8192
LIMIT = 1 << 26


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, vector, lkey): usable vectors with the key of their label."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), group_key(label_col).alias("lkey"))
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("vector").isNotNull() & ~F.exists("vector", infinite))


def whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _grid(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of whole numbers, filled with zeros."""
    flat = whole(np.asarray(column.flatten()))
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


_FOREST = ", ".join(f"{f} binary" for f in Forest.FIELDS)
BLOCKS = f"n int, ids binary, nulls binary, labels array<string>, points binary, {_FOREST}"


def blocks(rows: DataFrame, width: int, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """The cover trees of every block of every partition."""
    def one(ids, labels, grid) -> pa.RecordBatch:
        n = len(grid)
        points = np.ascontiguousarray(grid.reshape(n, parts, width // parts).transpose(1, 0, 2)).reshape(parts * n, -1)
        packed = build(points, parts).pack()
        row = {"n": n, "ids": np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), "nulls": np.asarray(ids.is_null()).tobytes(),
               "labels": labels.to_pylist(), "points": points.astype("<i4").tobytes(), **packed}
        schema = pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("labels", pa.list_(pa.string())),
                            ("points", pa.binary())] + [(f, pa.binary()) for f in Forest.FIELDS])
        return pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                if size + piece.num_rows > block and held:
                    yield one(*_joined(held))
                    held, size = [], 0
                held.append((piece.column("vec_id"), piece.column("lkey"), _grid(piece.column("vector"), width)))
                size += piece.num_rows
        if held:
            yield one(*_joined(held))

    return rows.select("vec_id", "lkey", "vector").mapInArrow(run, BLOCKS)


def _joined(held):
    ids, labels, grids = zip(*held)
    return pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(grids)


def _loaded(batches: Iterator[pa.RecordBatch], parts: int, wide: int):
    """(row, forest, points) of every block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            forest = Forest.unpack({f: row[f].as_py() for f in Forest.FIELDS}, parts)
            yield row, forest, np.frombuffer(row["points"].as_py(), "<i4").reshape(-1, wide).astype(np.int64)


def moved(stored: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, wide = books.shape

    def run(batches):
        for _, forest, points in _loaded(batches, parts, wide):
            sums, counts = np.zeros((parts * entries, wide), np.int64), np.zeros(parts * entries, np.int64)
            n = len(points) // parts
            (start, end, entry), (place, single) = assign(forest, points, books)
            cumulative = np.zeros((len(points) + 1, wide), np.int64)
            np.cumsum(points[forest.order], axis=0, out=cumulative[1:])
            to = start // n * entries + entry
            np.add.at(sums, to, cumulative[end] - cumulative[start])
            np.add.at(counts, to, end - start)
            to = place // n * entries + single
            np.add.at(sums, to, points[forest.order[place]])
            np.add.at(counts, to, 1)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]),
                                              *[pa.array(sums[used, j]) for j in range(wide)]],
                                             names=["entry", "count", *[f"s{j}" for j in range(wide)]])

    columns = [f"s{j}" for j in range(wide)]
    found = stored.mapInArrow(run, "entry int, count long, " + ", ".join(f"{c} long" for c in columns))
    found = found.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ["count", *columns]])
    out = books.copy().reshape(parts * entries, wide)
    for row in found.collect():  # parts * entries rows at most
        out[row["entry"]] = [row[c] // row["count"] for c in columns]
    return out.reshape(books.shape)


def coded(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, lkey, code, error) of every vector by the given codebooks."""
    parts, entries, wide = books.shape

    def run(batches):
        for row, forest, points in _loaded(batches, parts, wide):
            n = len(points) // parts
            (start, end, entry), (place, single) = assign(forest, points, books)
            code = np.empty(len(points), np.int64)
            code[forest.order[place]] = single
            code[forest.order[ranges(start, end)]] = np.repeat(entry, end - start)
            tree = np.arange(len(points)) // n
            d = points - books.reshape(-1, wide)[tree * entries + code]
            error = np.einsum("ij,ij->i", d, d).reshape(parts, n).sum(axis=0)
            digits = np.frombuffer("".join(f"{e:02x}" for e in range(entries)).encode(), np.uint8).reshape(entries, 2)
            text = digits[code.reshape(parts, n).T].reshape(n, 2 * parts).tobytes()
            codes = pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * 2 * parts).tobytes()), pa.py_buffer(text))
            ids = pa.array(np.frombuffer(row["ids"].as_py(), "<i8"), mask=np.frombuffer(row["nulls"].as_py(), bool))
            yield pa.RecordBatch.from_arrays([ids, row["labels"].values, codes, pa.array(error)], names=["vec_id", "lkey", "code", "error"])

    return stored.mapInArrow(run, "vec_id long, lkey string, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, lkey, code, error), codebooks: parts x entries x width of a part)."""
    rows = kept(vectors, id_col, vector_col, label_col)
    wide = -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    if not first or not wide:
        zero = np.zeros((parts, min(len(first), entries), wide), np.int64)
        return rows.select("vec_id", "lkey", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error")), zero
    grid = np.zeros((len(first), parts * wide), np.int64)
    for to, row in zip(grid, first):
        to[:len(row[0])] = whole(np.asarray(row[0], dtype=float))
    books = np.ascontiguousarray(grid.reshape(len(first), parts, wide).transpose(1, 0, 2))
    stored = written(blocks(rows, parts * wide, parts), "cover-trees")
    for _ in range(rounds):
        books = moved(stored, books)
    return written(coded(stored, books), "vector-codes"), books


def report(vectors: DataFrame) -> DataFrame:
    """One row a kept vector: vec_id, code, error, label_error (errors of equal labels), codebooks_sha256."""
    rows, books = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    totals = rows.groupBy("lkey").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("members"))
    return attach(rows, totals, "lkey", "members").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _lloyd() -> str:
    """The rounds as SQL: each compares every stretch with every entry."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
n{i} AS (
  SELECT d.vec, d.part, min(dist * 64 + c.entry) AS best FROM (
    SELECT p.vec, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x)) AS dist FROM p JOIN c{i} c ON p.part = c.part AND p.pos = c.pos GROUP BY ALL) d
  JOIN (SELECT DISTINCT part, entry FROM c{i}) c ON c.part = d.part AND c.entry = d.entry GROUP BY ALL)""")
        if i < ROUNDS:
            steps.append(f"""
c{i + 1} AS (
  SELECT c.part, c.entry, c.pos, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT p.part, n.best % 64 AS entry, p.pos, (sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM p JOIN n{i} n ON p.vec = n.vec AND p.part = n.part GROUP BY ALL) m
  ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos)""")
    return ",".join(steps)


ORACLE = f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS vec, * FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec, unnest(embedding) AS e, unnest(range(len(embedding))) AS i, len(embedding) // {PARTS} AS wide FROM k),
p AS MATERIALIZED (SELECT vec, i // wide AS part, i % wide AS pos, floor({SCALE} * e::DOUBLE)::BIGINT AS x FROM u),
c0 AS (SELECT part, vec AS entry, pos, x FROM p WHERE vec < {ENTRIES}),{_lloyd()},
e AS (
  SELECT vec, string_agg(printf('%02x', (best % 64)::INT), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM n{ROUNDS} GROUP BY vec),
b AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT k.vec_id, e.code, e.error, (sum(e.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, b.codebooks_sha256
FROM k JOIN e USING (vec), b
"""
