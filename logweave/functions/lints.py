"""Template lints: key=value finders, path checks, foreign words, coverage.

Each returns a Column (array of findings or boolean) so lints run over a whole
template table or a joined (template, sample line) table in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.matching import PY_FLAGS

# Lint patterns.
KV_PATTERN = r"\b(\w+)\s*=\s*([\w./:-]+)"
HARDCODED_KV_PATTERN = r"\b(\w+)\s*=\s*([\w./:-]+)(?!\s*=)"
COLON_LIST_PATTERN = r"\b(\w+)\s*:\s*([^,\s]+)\s*,\s*\b(\w+)\s*:\s*([^,\s\)\]]+)"
PATH_TRIGGER = r"""(?:^|[\s:='"\[\(])(?:/|https?://|www\.)[a-zA-Z0-9._/-]+"""
PATH_PATTERN = r"((?:https?://|www\.|/)[a-zA-Z0-9._/+-]+)"
WORD_PATTERN = r"([a-zA-Z0-9_\-\.]{3,})"
VAR = "<VAR>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _u(p: str) -> Column:
    return F.lit("(?U)" + p)


def kv_pairs(col) -> Column:
    """``key=value`` pairs in a raw line, numeric keys skipped, as ``k=v`` strings."""
    c = _c(col)
    pairs = F.arrays_zip(F.regexp_extract_all(c, _u(KV_PATTERN), 1).alias("k"),
                         F.regexp_extract_all(c, _u(KV_PATTERN), 2).alias("v"))
    kept = F.filter(pairs, lambda p: ~p["k"].rlike(r"^\d+$"))
    return F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"]))


def has_path(col) -> Column:
    return _c(col).rlike("(?U)" + PATH_TRIGGER)


def hardcoded_params(template_regex) -> Column:
    """Constants where a parameter is expected: ``k=v`` and ``k:v, k:v`` lists."""
    t = F.replace(F.replace(_c(template_regex), F.lit("(.*?)"), F.lit(VAR)), F.lit("\\"), F.lit(""))
    kv = F.arrays_zip(F.regexp_extract_all(t, _u(HARDCODED_KV_PATTERN), 1).alias("k"),
                      F.regexp_extract_all(t, _u(HARDCODED_KV_PATTERN), 2).alias("v"))
    kv = F.transform(F.filter(kv, lambda p: ~p["k"].rlike(r"^\d+$") & (p["v"] != F.lit(VAR))),
                     lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    cl = F.arrays_zip(*[F.regexp_extract_all(t, _u(COLON_LIST_PATTERN), i).alias(f"g{i}") for i in (1, 2, 3, 4)])
    first = F.transform(F.filter(cl, lambda p: p["g2"] != F.lit(VAR)),
                        lambda p: F.concat(p["g1"], F.lit(":"), p["g2"]))
    second = F.transform(F.filter(cl, lambda p: p["g4"] != F.lit(VAR)),
                         lambda p: F.concat(p["g3"], F.lit(":"), p["g4"]))
    return F.concat(kv, first, second)


def _pseudo(template_regex) -> Column:
    return F.replace(_c(template_regex), F.lit("(.*?)"), F.lit("<*>"))


def foreign_words(log, template_regex) -> Column:
    """Template words (3+ chars) absent from the line, case-insensitive."""
    text = F.replace(F.replace(F.replace(_pseudo(template_regex), F.lit("<*>"), F.lit(" ")),
                               F.lit("\\."), F.lit(".")), F.lit("\\-"), F.lit("-"))
    low = F.lower(_c(log))
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), 1)

    def absent(w):
        stripped = F.regexp_replace(w, r"^[.,=:]+|[.,=:]+$", "")
        return (~w.rlike(r"^[0-9]+$") & (w != F.lit("..."))
                & ~F.contains(low, F.lower(w))
                & (F.length(stripped) > 2) & ~F.contains(low, F.lower(stripped)))
    return F.array_sort(F.array_distinct(F.filter(words, absent)))


def untreated_paths(log, template_regex) -> Column:
    """Paths of the line only partly abstracted in the template."""
    t = F.replace(F.replace(_pseudo(template_regex), F.lit("\\-"), F.lit("-")), F.lit("\\."), F.lit("."))
    paths = F.regexp_extract_all(_c(log), F.lit(PATH_PATTERN), 1)

    def part_hit(part):
        suffix = F.try_element_at(F.split(part, "-"), F.lit(-1))
        return (F.length(part) >= 2) & (
            F.contains(t, part)
            | (F.contains(part, F.lit("-")) & (F.length(suffix) > 0)
               & F.contains(t, F.concat(F.lit("-"), suffix))))

    def untreated(p):
        return (F.length(p) >= 3) & ~F.contains(t, p) & F.exists(F.split(p, "/"), part_hit)
    found = F.filter(paths, untreated)
    return F.when(_c(log).rlike("(?U)" + PATH_TRIGGER), F.array_sort(F.array_distinct(found))) \
        .otherwise(F.array().cast("array<string>"))


def coverage_issues(log, template_regex) -> Column:
    """Uncovered head / tail text when the template matches only part of the line.

    Null when the anchored-at-end template already matches or nothing matches.
    """
    c = F.replace(_c(log), F.lit(","), F.lit(""))
    r = F.replace(_c(template_regex), F.lit(","), F.lit(""))
    strict = F.when(r.endswith("$"), r).otherwise(F.concat(r, F.lit("$")))
    loose = F.regexp_replace(r, r"\$+$", "")
    loose_rx = F.concat(F.lit(PY_FLAGS), loose)
    start = F.regexp_instr(c, loose_rx)
    matched = F.regexp_substr(c, loose_rx)
    head = F.trim(F.substring(c, F.lit(1), start - 1))
    tail = F.trim(F.substring(c, start + F.length(matched), F.length(c) + 1))
    issues = F.filter(F.array(
        F.when(F.length(head) > 1, F.concat(F.lit("beginning text: '"), head, F.lit("'"))),
        F.when(F.length(tail) > 1, F.concat(F.lit("ending text: '"), tail, F.lit("'")))),
        lambda x: x.isNotNull())
    return F.when(F.regexp_like(c, F.concat(F.lit(PY_FLAGS), strict)), F.lit(None)) \
        .when(start == 0, F.lit(None)).otherwise(issues)
