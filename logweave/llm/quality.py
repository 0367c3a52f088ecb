"""Quality rules in a short-circuit cascade, in DataFrame expressions only.

``statistics`` adds the counts of a text as columns; ``rules`` names rejection rules
as conditions on them and on the text.  ``ordered`` runs every rule alone over a
bounded sample (``sample_rows`` rows as they come, so only speed depends on them),
measures what it costs beyond the bare scan, the statistics that it needs included, and how much
it rejects, and puts the
rules in the order of rejections per cost.  ``cascade`` applies them in that order as
one conditional expression, which Spark evaluates branch by branch: a row rejected by
an early rule never computes a later one, and the verdict is the same in any order.

Repeated three-word windows are found by sorting: one long a window, the upper bits
a hash of its words and the lower ones its place, so that equal windows become
neighbours; neighbours of equal hash are compared word by word.

Defined results: null text is an empty one: all counts 0, no words and thus failed.
Texts of any length are counted whole; repeated rows get equal results; with an
empty table the rules stay in their listed order.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 500

#: Fixed sets of characters: white space that parts words, and symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row``, ``text`` (null: empty), ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (with a
    word), ``n_dup_lines`` and ``n_repeat_words``."""
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    two = one.select("row", "text", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
                     F.filter(F.split("text", "\n"), lambda line: _removed(line, SPACE) != "").alias("lines"))
    bits = F.ceil(F.log2(F.size("w") + 2)).cast("int")
    three = two.select("row", "text", "w", F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), bits.alias("bits"),
                       F.length(_removed(F.col("text"), SPACE)).alias("word_chars"), (F.length("text") - F.length(_removed(F.col("text"), SYMBOLS))).alias("n_symbols"))
    # SQL text, as shifts by a column are SQL functions.
    four = three.withColumn("grams", F.expr("sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> "
                                            "(shiftleft(xxhash64(x, w[i + 1], w[i + 2]), bits) | cast(i as bigint))))"))
    five = four.withColumn("places", F.expr("transform(grams, (g, i) -> struct(shiftrightunsigned(g, bits) as h, cast(g & (shiftleft(1L, bits) - 1) as int) as p))"))
    same = "(get(places, i {0}).h = x.h and w[get(places, i {0}).p] = w[x.p] and w[get(places, i {0}).p + 1] = w[x.p + 1] and w[get(places, i {0}).p + 2] = w[x.p + 2])"
    six = five.withColumn("found", F.expr(f"sort_array(transform(filter(places, (x, i) -> coalesce({same.format('- 1')}, false) or coalesce({same.format('+ 1')}, false)), x -> x.p))"))
    return six.select("row", "text", F.size("w").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
                      F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
                      F.expr("aggregate(transform(found, (p, i) -> least(3, coalesce(get(found, i + 1) - p, 3))), 0L, (a, x) -> a + x)").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))




def rules() -> dict[str, Column]:
    """The rules by name; columns can be built only while a session runs."""
    text = F.col("text")
    return {
        "few_words": F.col("n_words") < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words")),
        "symbols": 100 * F.col("n_symbols") > 30 * F.col("n_words"),
        "repeated_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "exclamations": 100 * (F.length(text) - F.length(_removed(text, "!"))) > 50 * F.col("n_words"),
        "few_letters": 100 * _letters(text) < 50 * F.col("word_chars"),
        "capitals": 100 * F.length(F.regexp_replace(text, r"\P{Lu}+", "")) > 60 * _letters(text),
    }


def ordered(df: DataFrame, conditions: dict[str, Column], sample_rows: int = SAMPLE_ROWS, prepare: Callable[[DataFrame], DataFrame] | None = None) -> list[dict]:
    """The rules by falling rejections per cost on a sample: name, cost (microseconds a row) and share rejected.
    ``prepare`` adds the columns that the conditions need to the held sample: not being held themselves, those that a
    rule needs, and no others, are computed when it is timed."""
    held = df.limit(sample_rows).cache()
    counted = prepare(held) if prepare else held
    try:
        n = held.count()
        if not n:
            return [{"name": k, "cost": 0.0, "rejects": 0.0} for k in conditions]

        def run(condition: Column) -> tuple[float, int]:
            began = time.perf_counter()
            hits = counted.agg(F.count_if(condition)).first()[0]
            return time.perf_counter() - began, hits

        run(F.lit(False))
        bare = min(run(F.lit(False))[0] for _ in range(2))
        out = []
        for name, condition in conditions.items():
            run(condition)  # the first run compiles it
            took, hits = run(condition)
            out.append({"name": name, "cost": max(took - bare, 1e-4) * 1e6 / n, "rejects": hits / n})
    finally:
        held.unpersist()
    return sorted(out, key=lambda r: -r["rejects"] / r["cost"])


def cascade(df: DataFrame, conditions: dict[str, Column], order: list[dict]) -> DataFrame:
    """``df`` with ``rejected_by``: the first rule in this order that rejects the row, null for rows to keep."""
    first = None
    for rule in order:
        hit = F.lit(rule["name"])
        first = F.when(conditions[rule["name"]], hit) if first is None else first.when(conditions[rule["name"]], hit)
    return df.withColumn("rejected_by", first)


def judged(docs: DataFrame, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    counted = statistics(docs, text_col)
    conditions = rules()
    return cascade(counted, conditions, ordered(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), conditions, sample_rows, statistics))


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row."""
    return judged(docs, **kw).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     base_failed().alias("base_failed"), (F.col("rejected_by").isNull() & ~base_failed()).alias("kept"))


def keep_good(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that no rule rejects."""
    return judged(docs, **kw).where("rejected_by is null").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d)),
again AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p FROM g JOIN again USING (doc_id, g)) GROUP BY doc_id),
c AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n, 0) AS n_repeat_words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, length(regexp_replace(t, '\PL+', '', 'g')) AS letters
      FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * len(l)
            OR 100 * (length(t) - length(replace(t, '!', ''))) > 50 * n_words OR 100 * letters < 50 * word_chars
            OR 100 * length(regexp_replace(t, '\P{Lu}+', '', 'g')) > 60 * letters) AS kept
FROM f
"""
