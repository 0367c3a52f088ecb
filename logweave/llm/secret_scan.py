"""Secret scans with multipart credential linking.

Every text is searched for three strong kinds (an assignment to a secret's name, an
access key id, a long hexadecimal run), which are always reported, and for weak
parts: an account identifier, an unlabelled random-looking string or a short secret,
and a service endpoint.  A weak part alone means nothing; it is reported only when
the parts that complement it lie near by.  That is an interval join: two parts meet
if they are in the same scope (the same block of lines, blank lines part blocks) and
start at most ``reach`` code points apart.  With buckets of width ``reach`` a part
meets all parts of its own bucket and can meet those of both neighbours, so least
and greatest start per bucket decide it and no pairs are made.

An identifier needs a secret; a weak secret needs an identifier; an endpoint needs
both.  Strong spans count as parts: access keys as identifiers, assignments and
hexadecimal runs as secrets.

Defined results: null text is an empty one and has no spans; a null doc_id is kept;
repeated rows each get the same result; empty tables give empty results; parts that
tie in their start are ordered by kind.  Only id and text are read by name.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import map_arrow, written

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
IDENTIFIERS, SECRETS = (1, 3), (0, 2, 4)
REACH = 300

#: Fixed patterns of the strong kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Weak parts.  A label may follow an underscore (DB_USER, AWS_ACCESS_KEY_ID), but not a letter or a digit.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A)
SHORT = re.compile(r"""(?<![A-Za-z0-9])(?:pass|pwd|pw|(?:secret_?(?:access_?)?)?key|auth|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", re.I | re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])", re.A)
ENDPOINT = re.compile(r"""(?<![A-Za-z0-9])(?:(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@-]+|host["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}|\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}\b)""", re.I | re.A)
BLANK = re.compile(r"\n[\x20\t\r]*\n")

_MAY_BE_LONG = re.compile(r"[A-Za-z0-9+/_-]{20}", re.A)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strong kinds, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _MAY_BE_LONG.search(text):
        out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def _random(word: str) -> bool:
    if not (re.search(r"\d", word) and re.search("[a-z]", word) and re.search("[A-Z]", word)):
        return False
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values()) >= 3.5


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that overlap neither a strong span nor one another (the first kind listed wins)."""
    found = []
    labelled = ":" in text or "=" in text
    if labelled:
        found += [(3, m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
        found += [(4, m.start(), m.end()) for m in SHORT.finditer(text)]
    if _MAY_BE_LONG.search(text):
        found += [(4, m.start(), m.end()) for m in RANDOM.finditer(text) if _random(m[0])]
    if ":" in text or "=" in text:
        found += [(5, m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if not found:
        return []
    # Both lists by start, walked together: a part overlaps a strong span if one that starts before its end goes on behind its start.
    starts = [s for _, s, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    out = []
    for kind, s, e in sorted(found, key=lambda x: (x[1], x[0])):
        before = bisect_left(starts, e)
        if out and s < out[-1][2] or before and reach[before - 1] > s:
            continue
        out.append((kind, s, e))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_PART = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())])


def _found(texts) -> tuple[list, list, list, list, list]:
    spans, parts, digests, counts = [], [], [], []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        weak = weak_parts(text, base)
        spans.append([{"start": s, "kind": k, "end": e} for k, s, e in base])
        digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
        counts.append(Counter(k for k, _, _ in base))
        if weak:
            blanks, own, at = [m.start() for m in BLANK.finditer(text)], [], 0
            for k, s, e in sorted(base + weak, key=lambda x: x[1]):
                while at < len(blanks) and blanks[at] < s:
                    at += 1
                own.append({"kind": k, "start": s, "end": e, "scope": at})
            parts.append(own)
        else:
            parts.append([])
    return spans, parts, digests, [c[0] for c in counts], [(c[1], c[2]) for c in counts]


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak rows of ``parts`` (row_key, kind, start, end, scope) whose complements lie within reach: row_key and their spans."""
    of = lambda kinds: F.when(F.col("kind").isin(*kinds), F.col("start"))
    parts = parts.withColumn("bucket", F.floor(F.col("start") / reach))
    near = parts.groupBy("row_key", "scope", "bucket").agg(
        F.min(of(IDENTIFIERS)).alias("id_min"), F.max(of(IDENTIFIERS)).alias("id_max"),
        F.min(of(SECRETS)).alias("sec_min"), F.max(of(SECRETS)).alias("sec_max"))
    weak = parts.where("kind >= 3").dropDuplicates(["row_key", "kind", "start", "end"])
    sides = weak.withColumn("own", F.col("bucket")).withColumn("bucket", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])))

    def meets(name):
        return ((F.col("bucket") == F.col("own")) & F.col(f"{name}_min").isNotNull()
                | (F.col("bucket") < F.col("own")) & (F.col(f"{name}_max") >= F.col("start") - reach)
                | (F.col("bucket") > F.col("own")) & (F.col(f"{name}_min") <= F.col("start") + reach))

    met = (sides.join(near, ["row_key", "scope", "bucket"])
           .groupBy("row_key", "kind", "start", "end")
           .agg(F.max(F.coalesce(meets("id"), F.lit(False))).alias("identifier"), F.max(F.coalesce(meets("sec"), F.lit(False))).alias("secret")))
    kept = met.where("kind = 3 and secret or kind = 4 and identifier or kind = 5 and identifier and secret")
    return kept.groupBy("row_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def scan(docs: DataFrame, *, id_col="doc_id", text_col="text", carry=(), reach: int = REACH) -> DataFrame:
    """Per row: row (struct of the carried columns and the id), text (only if something is carried), n_assign,
    n_access, n_hex, base_sha256 and spans (all, by start, then kind)."""
    row = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, *carry])])
    slim = docs.select(row.alias("row"), F.md5(F.concat_ws("\0", F.col(f"`{id_col}`").cast("string"), F.col(text_col).cast("string"))).alias("row_key"),
                       F.col(text_col).cast("string").alias("text"))
    keep = bool(carry)

    def run(batch):
        texts = batch.column("text").to_pylist()
        spans, parts, digests, assign, rest = _found(texts)
        return pa.RecordBatch.from_arrays([
            batch.column("row"), batch.column("row_key"), batch.column("text") if keep else pa.nulls(len(texts), pa.string()),
            pa.array(assign, pa.int64()), pa.array([a for a, _ in rest], pa.int64()), pa.array([h for _, h in rest], pa.int64()),
            pa.array(digests, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(parts, pa.list_(_PART))],
            names=["row", "row_key", "text", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "parts"])

    schema = slim.selectExpr("row", "row_key", "text", "0L n_assign", "0L n_access", "0L n_hex", "'' base_sha256",
                             "cast(null as array<struct<start: bigint, kind: int, end: bigint>>) spans",
                             "cast(null as array<struct<kind: int, start: bigint, end: bigint, scope: bigint>>) parts").schema
    for f in schema:
        f.nullable = True
    found = written(map_arrow(slim, run, schema), "secrets")
    weak = found.where(F.size("parts") > 0)
    more = linked(weak.select("row_key", F.inline("parts")), reach)
    out = weak.join(more, "row_key", "left").withColumn("spans", F.array_sort(F.concat("spans", F.coalesce("linked", F.expr("array()").cast(schema["spans"].dataType)))))
    plain = found.where(F.size("parts") == 0)
    columns = ["row", "text", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    return plain.select(*columns).unionByName(out.select(*columns))


def span_text():
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **kw) -> DataFrame:
    return scan(docs, **kw).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", span_text().alias("spans"))


def redact(docs: DataFrame, *, id_col="doc_id", text_col="text", mark: str = "[secret]", **kw) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark`` (overlapping spans by one); all rows stay."""
    found = scan(docs, id_col=id_col, text_col=text_col, carry=docs.columns, **kw).select("row", "text", "spans")

    def run(batch):
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            if spans:
                out, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        out += [texts[i][at:s["start"]], mark]
                    at = max(at, s["end"])
                texts[i] = "".join(out) + texts[i][at:]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "cleaned"])

    out = map_arrow(found, run, found.selectExpr("row", "text cleaned").schema)
    return out.select(*[(F.col("cleaned") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
