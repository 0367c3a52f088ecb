"""Template text <-> template regex, wildcard repair and template cleaning.

Two notations are used for a template:

* canonical text with ``<*>`` wildcards (what mining produces), and
* an escaped regular expression with ``(.*?)`` wildcards (what matching uses).

All functions return Spark Columns built from ``regexp_replace`` /
``replace`` chains, so they run inside whole-stage codegen.  Patterns are
compiled with ``(?U)`` so ``\\w``, ``\\d``, ``\\s`` and ``\\b`` are Unicode-aware,
like Python's ``re``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WILD = "<*>"
WILD_RX = "(.*?)"
WILD_RX_PATTERN = r"\(\.\*\?\)"

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour for identical results)
# ---------------------------------------------------------------------------
# Characters escaped by Python's re.escape (3.7+), in its own order:
#   ( ) [ ] { } ? * + - | ^ $ \ . & ~ # space \t \n \r \v \f
# A literal space is left unescaped afterwards ("\ " becomes " ").
ESCAPED_CHARS_CLASS = r"([()\[\]{}?*+\-|^$\\.&~#\t\n\r\x0B\f])"

# Wildcard repair rules applied once, in this order (pattern, replacement).
FIX_RULES = [
    (r"<\*>(?:##<\*>)+", "<*>"),
    (r"<\*>\s*\+\s*<\*>", "<*>"),
    (r"(^|[\s:;=\(\)\[\],])[-+]?\d+(?:\.\d+)?(?:%|[a-zA-Z]{1,5})?(?=[\s:;=\(\)\[\],]|$)", "$1<*>"),
    (r"<\*\d+\*>", "<*>"),
    (r"<\*\d+\*", "<*>"),
    (r"<\*\d+", "<*>"),
    (r"<\*\d+\*>", "<*>"),
]
# Literal replacements applied after the rules above, in this order.
FIX_LITERALS = [
    ("*<>", "<*>"), ("*<*>", "<*>"), ("<*>*", "<*>"), ("<>*", "<*>"),
    ("<*|*>", "<*>"), ("<*1*>", "<*>"), ("<>", "<*>"), ("<*>.*", "<*>"),
]
# Final repair rules, in this order.
FIX_TAIL_RULES = [
    (r"\b(\w+)\s*=\s*\[\]", "$1=<*>"),
    (r"\(\s*\*\s*\)", "(<*>)"),
    (r"<(\*)(?!>)", "<*>"),
    (r"(?<!<)(\*)>", "<*>"),
]
# Wildcard collapse rules; one pass applies all of them in this order, and
# passes repeat until nothing changes.
COLLAPSE_RULES = [
    (r"<\*>_[a-zA-Z0-9\-]+_<\*>", "<*>"),
    (r"<\*>\-[a-zA-Z0-9\-]+\-<\*>", "<*>"),
    (r"\b[a-zA-Z0-9]+_<\*>", "<*>"),
    (r"\b[a-zA-Z0-9]+\-<\*>", "<*>"),
    (r"<\*>_[a-zA-Z0-9]+\b", "<*>"),
    (r"<\*>\-[a-zA-Z0-9]+\b", "<*>"),
    (r"<\*>_<\*>", "<*>"),
    (r"<\*>\s*<\*>", "<*>"),
    (r"<\*>\-<\*>", "<*>"),
    (r"\(\s*<\*>\s*\)\s*\(\s*<\*>\s*\)", "(<*>)"),
    (r"<\*>:[a-zA-Z0-9\-]+:<\*>", "<*>"),
]
# After collapsing: a quoted wildcard loses its quotes.
QUOTED_WILDCARD = (r"'<\*>'?", "<*>")
# Wildcards kept in a template regex; text after the 30th is cut.
MAX_WILDCARDS = 30
# Characters that do not count as content when rejecting a template
# (Python's string.punctuation plus space); fewer than 3 others -> rejected.
PUNCT_OR_SPACE_CLASS = r"""[ !"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
MIN_CONTENT_CHARS = 3
# Template cleaning rules (pattern, replacement).
CLEAN_FROM_TO = (r"\bfrom\s+\S+\s+to\s+\S+", "from (.*?) to (.*?)")
CLEAN_LOOP_RULES = [
    (r"\(\.\*\?\)+://\(\.\*\?\)", "(.*?)"),
    (r"www\.\(\.\*\?\)", "(.*?)"),
    (r"^_(?=\(\.\*\?\))", ""),
]
CLEAN_LOOP_ROUNDS = 2
# A static token: two or more ASCII word characters between word boundaries.
STATIC_TOKEN = r"\b[a-zA-Z0-9_]{2,}\b"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _rx(col: Column, pattern: str, repl: str, unicode: bool = True) -> Column:
    return F.regexp_replace(col, F.lit(("(?U)" if unicode else "") + pattern), F.lit(repl))


def escape_literal(col) -> Column:
    """Escape a literal string like Python's ``re.escape``, keeping spaces bare."""
    return F.regexp_replace(_c(col), F.lit(ESCAPED_CHARS_CLASS), F.lit("\\\\$1"))


def literal_template(col) -> Column:
    """A whole line as its own template regex (static groups)."""
    return F.replace(escape_literal(col), F.lit("\\ "), F.lit(" "))


def cap_wildcards(col, max_wildcards: int = MAX_WILDCARDS) -> Column:
    """Cut a template regex after its ``max_wildcards``-th wildcard.

    One ``regexp_replace`` (the input is referenced once): keep the shortest
    prefix holding ``max_wildcards`` wildcards when another one follows.  The
    repeated group is atomic, so a template with fewer wildcards fails fast.
    """
    rx = (f"(?s)^((?>.*?{WILD_RX_PATTERN}){{{max_wildcards}}})"
          f"(?=.*?{WILD_RX_PATTERN}).*$")
    return F.regexp_replace(_c(col), F.lit(rx), F.lit("$1"))


def template_to_regex(col) -> Column:
    """Canonical ``<*>`` template to its matching regex: escape, wildcards to
    ``(.*?)``, merge adjacent wildcards.  Nothing is cut, however many wildcards
    there are; ``cap_wildcards`` is an operator of its own."""
    c = _rx(_c(col), QUOTED_WILDCARD[0], QUOTED_WILDCARD[1])
    c = literal_template(c)
    c = F.replace(c, F.lit("<\\*>"), F.lit(WILD_RX))
    return F.regexp_replace(c, F.lit(f"(?:{WILD_RX_PATTERN})+"), F.lit(WILD_RX))


def regex_to_template(col) -> Column:
    """Template regex back to ``<*>`` text: wildcards to ``<*>``, escapes removed."""
    c = F.replace(_c(col), F.lit(WILD_RX), F.lit(WILD))
    return F.regexp_replace(c, F.lit(r"\\(.)"), F.lit("$1"))


def fix_wildcards(col) -> Column:
    """Repair malformed wildcards in proposed ``<*>`` templates (one pass)."""
    c = F.regexp_replace(_c(col), F.lit(r"(?U)^\s+|\s+$"), F.lit(""))
    c = F.regexp_replace(c, F.lit(r"^`+|`+$"), F.lit(""))
    c = F.regexp_replace(c, F.lit(r"<\*$"), F.lit("<*>"))
    c = F.regexp_replace(c, F.lit(r"<$"), F.lit("<*>"))
    c = F.regexp_replace(c, F.lit(r"\\+$"), F.lit(""))
    c = reduce(lambda acc, r: _rx(acc, r[0], r[1]), FIX_RULES, c)
    c = reduce(lambda acc, r: F.replace(acc, F.lit(r[0]), F.lit(r[1])), FIX_LITERALS, c)
    c = reduce(lambda acc, r: _rx(acc, r[0], r[1]), FIX_TAIL_RULES, c)
    return c


def collapse_pass(col, unicode: bool = True) -> Column:
    """One pass of every collapse rule, in order."""
    return reduce(lambda acc, r: _rx(acc, r[0], r[1], unicode), COLLAPSE_RULES, _c(col))


def clean_template(col, unicode: bool = True) -> Column:
    """Clean a template (``<*>`` or regex form) into regex form; null when rejected.

    Rejected when fewer than three characters remain after dropping ASCII
    punctuation and spaces.
    """
    c = _rx(_c(col), r"<\s*\*\s*>", WILD_RX, unicode)
    content = F.length(F.regexp_replace(c, F.lit(PUNCT_OR_SPACE_CLASS), F.lit("")))
    c2 = _rx(c, CLEAN_FROM_TO[0], CLEAN_FROM_TO[1], unicode)
    for _ in range(CLEAN_LOOP_ROUNDS):
        c2 = reduce(lambda acc, r: _rx(acc, r[0], r[1], unicode), CLEAN_LOOP_RULES, c2)
    c2 = _rx(c2, r"^\s+|\s+$", "", unicode)
    return F.when(content < MIN_CONTENT_CHARS, F.lit(None).cast("string")).otherwise(c2)


def static_token_count(col, unicode: bool = True) -> Column:
    """Static words (two or more ASCII word characters) outside wildcards."""
    c = F.replace(_c(col), F.lit(WILD_RX), F.lit(" "))
    return F.regexp_count(c, F.lit(("(?U)" if unicode else "") + STATIC_TOKEN))


def regex_word_count(col) -> Column:
    """Word count of a template regex: spaces + 1."""
    c = _c(col)
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) + 1
