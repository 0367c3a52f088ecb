"""Conversation structure repair: find faulty turns and mend conversations by the cheapest edits.

``mend`` takes conversations of any length.  Turns are range partitioned and sorted by (conversation, turn, role, text), numbered
and written once.  From then on a turn is one letter (``alignment.symbol``), and the turns of a conversation come in pieces: those whose
numbers share a stretch of ``PIECE``.  Pieces are aligned in parallel for every grammar state at their ends and
chained, which takes a row a piece.  The edits of a piece then travel to its turns.  No task holds the texts of a conversation:
one that lies in one piece is digested there, the lines of a longer one are streamed in order, as a digest of the whole demands.

Odd rows: nulls in role and text, and in the key of the damage, stand for one space; a null id is a conversation of its own, null turns come first; turns
of one number are taken by role, then text.  A conversation without rows has zeros, an empty audit and the digest of the empty
string.  Empty tables give no rows.  Other columns of the caller play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import alignment
from logweave.llm.common import written
from logweave.llm.totals import attach

SPACE = r"\x20\x09-\x0D"
#: Turns whose numbers share a stretch of 2**PIECE are aligned together.
PIECE = 9
#: Letters of lines that travel in one row.
BODY = 1 << 20


def damage(conversations: DataFrame) -> DataFrame:
    """The table with the stated damage by crc32(``conv_id:turn``) % 20: (conv_id, turn, role, text)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def numbered(turns: DataFrame) -> DataFrame:
    """Turns in order, with ``at`` (rising through a conversation), their key ``conv`` and what the faults need; written once."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    ordered = turns.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    whole = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    initial = F.substring("role", 1, 1)
    role_class = F.when(initial == "s", alignment.S).when(initial == "u", alignment.U).when(initial == "a", alignment.A).otherwise(alignment.OTHER)
    same = F.md5(F.concat_ws(":", conv, F.length("role").cast("string"), "role", "text"))
    return written(ordered.select(F.monotonically_increasing_id().alias("at"), conv.alias("conv"), "conv_id", "turn", "role", "text",
                                  role_class.alias("class"), blank.alias("blank"), whole.alias("whole"), same.alias("same")), "turns")


def pieces(turns: DataFrame) -> DataFrame:
    """(conv, piece, symbols, first_at): the turns of a piece as letters, at most 2**PIECE of them."""
    small = turns.select("conv", "at", "class", "blank", "whole", "same")
    firsts = small.groupBy("same").agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("equal"))
    fault = F.when(F.col("blank"), alignment.BLANK).when(F.col("at") > F.col("earliest"), alignment.DUPLICATE) \
        .when(~F.col("whole"), alignment.TRUNCATED).otherwise(0)
    marked = attach(small, firsts, "same", "equal").select("conv", "at", F.char(65 + 4 * F.col("class") + fault).alias("symbol"))
    held = marked.groupBy("conv", F.shiftright("at", PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "symbol"))).alias("turns"))
    return held.select("conv", "piece", F.array_join("turns.symbol", "").alias("symbols"), F.col("turns")[0]["at"].alias("first_at"))


def _aligned(parts: DataFrame) -> DataFrame:
    """Pieces with their tables; ``lone`` is a whole conversation."""
    ends = parts.groupBy("conv").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"), F.count(F.lit(1)).alias("members"))
    marked = attach(parts, ends, "conv", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = lru_cache(20_000)(alignment.piece_table)
        for batch in batches:
            tables = []
            for symbols, piece, lo, hi in zip(*[batch.column(c).to_pylist() for c in ("symbols", "piece", "lo", "hi")]):
                table = (align if len(symbols) <= 32 else alignment.piece_table)(symbols, piece == lo, piece == hi)
                tables.append([{"entry": e, "leave": x, "cost": c, "audit": a} for (e, x), (c, a) in table.items()])
            keep = [batch.column(c) for c in ("conv", "piece", "symbols", "first_at")]
            table_type = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays([*keep, pa.array(tables, table_type)], names=["conv", "piece", "symbols", "first_at", "options"])

    return marked.select("conv", "piece", "symbols", "first_at", "lo", "hi").mapInArrow(
        run, "conv string, piece long, symbols string, first_at long, options array<struct<entry int, leave int, cost long, audit string>>")


_EDITS = "array<struct<first_at: long, entry: int, audit: string>>"


def _chained(tables: DataFrame) -> DataFrame:
    """(conv, blank, duplicate, truncated, illegal, cost, audit, edits): a row a conversation."""
    whole = tables.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "symbols", "first_at", "options"))).alias("pieces"))

    def run(batches):
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column("conv").to_pylist(), batch.column("pieces").to_pylist()):
                cost, path = alignment.chain([{(o["entry"], o["leave"]): (o["cost"], o["audit"]) for o in p["options"]} for p in parts])
                blank, duplicate, truncated, illegal = alignment.counts("".join(p["symbols"] for p in parts))
                out.append({"conv": conv, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": cost,
                            "audit": "".join(a for _, a in path),
                            "edits": [{"first_at": p["first_at"], "entry": e, "audit": a} for p, (e, a) in zip(parts, path)]})
            schema = pa.schema([("conv", pa.string())] + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")] + [
                ("audit", pa.string()), ("edits", pa.list_(pa.struct([("first_at", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())])))])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return whole.mapInArrow(run, f"conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits {_EDITS}")


def _lines(turns: DataFrame, found: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(conv, lone, first_at, lines)`` for every piece, with an iterator of its repaired (role, text): the edits of a
    piece are sorted in front of its turns, and both are streamed."""
    edits = found.select("conv", (F.size("edits") == 1).alias("lone"), F.explode("edits").alias("e")).select(
        F.shiftright("e.first_at", PIECE).alias("piece"), F.col("e.first_at").alias("at"), F.lit(0).alias("kind"), "conv", "lone",
        F.col("e.entry").alias("entry"), F.col("e.audit").alias("role"), F.lit(None).cast("string").alias("text"))
    own = turns.select(F.shiftright("at", PIECE).alias("piece"), "at", F.lit(1).alias("kind"), "conv", F.lit(False).alias("lone"), F.lit(0).alias("entry"), "role", "text")
    both = edits.unionByName(own).repartition("piece").sortWithinPartitions("at", "kind").drop("piece")

    def rows(batches):
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("at", "kind", "conv", "lone", "entry", "role", "text")])

    def run(batches):
        stream = rows(batches)
        for at, _, conv, lone, entry, audit, _ in stream:
            turns_of = ((role, text) for _, (_, _, _, _, _, role, text) in zip(range(len(audit) - audit.count("I")), stream))
            yield from emit(conv, lone, at, alignment.repaired(entry, audit, turns_of))

    return both.mapInArrow(_batched(run, schema), schema)


def _batched(run, schema: str, rows: int = 1000, size: int = 8 * BODY):
    """``run``, which yields rows as dicts, with its rows in batches of bounded rows and letters."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def out(batches):
        held, letters = [], 0
        for row in run(batches):
            held.append(dict(zip(names, row)))
            letters += len(row[-1] or "")
            if len(held) >= rows or letters >= size:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, letters = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return out


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, at, nth, role, text): the turns of the mended conversations in order (at of their piece, number in it)."""
    def emit(conv, lone, at, lines):
        for nth, (role, text) in enumerate(lines):
            yield conv, at, nth, role, text

    return _lines(turns, found, emit, "conv string, at long, nth long, role string, text string")


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the lines ``role:text``, joined by newlines."""
    def emit(conv, lone, at, lines):
        if lone:
            h = hashlib.sha256()
            for i, (role, text) in enumerate(lines):
                h.update(f"{chr(10) if i else ''}{role}:{text}".encode())
            yield conv, None, None, h.hexdigest()
            return
        held, size, nth = [], 0, 0
        for role, text in lines:
            held.append(f"{role}:{text}")
            size += len(held[-1])
            if size >= BODY:
                yield conv, at, nth, "\n".join(held)
                held, size, nth = [], 0, nth + 1
        if held:
            yield conv, at, nth, "\n".join(held)

    said = written(_lines(turns, found, emit, "conv string, at long, nth long, body string"), "turn-digests")
    # Conversations of several pieces: a digest of the whole is sequential, so their lines are streamed in order.
    long = said.where("at is not null").repartition("conv").sortWithinPartitions("conv", "at", "nth")

    def stream(batches):
        last, h = None, None
        for batch in batches:
            for conv, body in zip(batch.column("conv").to_pylist(), batch.column("body").to_pylist()):
                if h is None or conv != last:
                    if h is not None:
                        yield last, h.hexdigest()
                    last, h = conv, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(body.encode())
        if h is not None:
            yield last, h.hexdigest()

    joined = long.mapInArrow(_batched(stream, "conv string, repaired_sha256 string"), "conv string, repaired_sha256 string")
    return said.where("at is null").select("conv", F.col("body").alias("repaired_sha256")).unionByName(joined)


def mend(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns as numbered, findings): findings have a row a conversation with its fault counts, the cost, the audit and its edits."""
    stored = numbered(turns)
    return stored, written(_chained(_aligned(pieces(stored))), "turn-edits")


def report(conversations: DataFrame) -> DataFrame:
    """One row a conversation of the table: its gaps and faults after the damage, and the cheapest repair."""
    stored, found = mend(damage(conversations))
    key = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(""))
    gaps = stored.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [conversations.select(key.alias("conv")).distinct(), gaps, found.drop("edits"), digests(stored, found)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    out = both.groupBy("conv").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                   F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return out.select(F.when(F.col("conv") != "", F.col("conv")).cast("long").alias("conv_id"), *counts, "audit", "repaired_sha256")


ORACLE = r"""
WITH RECURSIVE
o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
-- CRC-32: every byte is mixed in, then eight times a bit goes out.
f AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(octet_length(key)),
      lambda i: [ord(chr(('0x' || substr(hex(key), 2 * i::INT + 1, 2))::INT))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS fate FROM o),
g AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fate <> 0),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS c FROM g),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM h),
x AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
-- Grammar states: 0 nothing, 1 after s, 2 after u, 3 after a.  Between two turns at most one insert is worth its cost, or two from
-- nothing; a state has its least cost, then least audit, with the lines it leaves.
step(conv_id, i, state, cost, audit, said) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, s.state, s.cost, s.audit, s.said FROM x,
    (VALUES (0, 0, '', NULL::VARCHAR), (2, 5, 'I', 'user:'), (3, 10, 'II', 'user:' || chr(10) || 'assistant:')) s(state, cost, audit, said)
  UNION ALL
  SELECT conv_id, i, state, least_of[1], least_of[2], least_of[3] FROM (
    SELECT conv_id, i, state, arg_min((cost, audit, said), (cost, audit)) AS least_of FROM (
      SELECT conv_id, i, CASE WHEN ins = 0 THEN state WHEN state = 2 THEN 3 ELSE 2 END AS state, cost + 5 * ins AS cost, audit || repeat('I', ins) AS audit,
        CASE WHEN ins = 0 THEN said ELSE concat_ws(chr(10), said, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END) END AS said
      FROM (
        SELECT s.conv_id, x.i, m.state, s.cost + m.cost AS cost, s.audit || m.edit AS audit, nullif(concat_ws(chr(10), s.said, m.line), '') AS said
        FROM step s JOIN x ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = s.i + 1, LATERAL (
          SELECT s.state AS state, 2 AS cost, 'D' AS edit, NULL::VARCHAR AS line
          UNION ALL SELECT CASE WHEN x.c = 's' THEN 1 WHEN s.state = 2 THEN 3 ELSE 2 END, CASE WHEN x.fault = 3 THEN 5 ELSE 0 END, 'K', x.role || ':' || x.text
            WHERE x.fault IN (0, 3) AND (x.c = 's' AND s.state = 0 OR x.c = 'u' AND s.state <> 2 OR x.c = 'a' AND s.state = 2)
          UNION ALL SELECT CASE WHEN s.state = 2 THEN 3 ELSE 2 END, CASE WHEN x.fault = 3 THEN 6 ELSE 1 END, 'R', CASE WHEN s.state = 2 THEN 'assistant:' ELSE 'user:' END || x.text
            WHERE x.fault IN (0, 3)) m) y, (VALUES (0), (1)) v(ins)) z
    GROUP BY conv_id, i, state) w),
e AS (
  SELECT s.conv_id, arg_min((s.cost, s.audit, s.said), (s.cost, s.audit)) AS best FROM step s JOIN (SELECT DISTINCT conv_id, n FROM x) l
  ON s.conv_id IS NOT DISTINCT FROM l.conv_id AND s.i = l.n WHERE s.state IN (0, 3) GROUP BY s.conv_id),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best[1], 0)::BIGINT AS cost, coalesce(best[2], '') AS audit,
  sha256(coalesce(best[3], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
