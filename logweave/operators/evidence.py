"""Evidence on tokens: scores, unstable positions, variable ``A::B`` parts, and the weights of a first-word split.

Everything is an aggregate with map-side combine over (group, token) or (group, position), or a column
expression on one representative line a key; no group's lines are collected.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
MARKER_SPLIT = r"""[\s=:;,()\[\]{}+/"']+"""
PAIR = r"([a-zA-Z0-9_]+)::([a-zA-Z0-9_]+)"
PLAIN_WORD = r"\b[a-zA-Z_][a-zA-Z0-9_\-\.]*"
#: Lines of more tokens than this have columns that may be unstable; a column is with more values than that.
LONG_LINE, STABLE_VALUES = 7, 2
#: Weights of a split key, a later one in this order wins: a partner of like context, an -ing word behind a bracket,
#: the start of the line in a slot of several keys or alone, a shared context elsewhere.
PARTNER, ING_BEHIND_BRACKET, SLOT_AT_START, AT_START, SHARED_CONTEXT = 7.0, 1000.0, 110.0, 20.0, 40.0
KEY_LENGTHS = (2, 20)
#: Lines of at most so many plain words are split whatever the scores.
FEW_WORDS = 2
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def marker_words(col) -> Column:
    return F.filter(F.split(_c(col), MARKER_SPLIT), lambda t: t != "")


def token_scores(lines: DataFrame, group_cols: Sequence[str], corpus_cols: Sequence[str] = ("dataset",)) -> DataFrame:
    """How surely a token is a constant of its group: ``group cols, token, lines_with, stability, corpus_lines, score``.

    ``stability`` is the share of the group's lines with the token that hold it at its commonest position, and the
    score is that times ln(1 + corpus lines with the token) / ln(1 + corpus lines), to six places.
    """
    g, corpus = list(group_cols), list(corpus_cols)
    first = F.array_distinct(F.transform(marker_words("content"), lambda t: t))
    words = lines.select(*dict.fromkeys([*g, *corpus]), marker_words("content").alias("__w"), first.alias("__d")).select(
        *dict.fromkeys([*g, *corpus]), F.explode("__d").alias("token"), "__w")
    at = words.select("*", F.array_position("__w", F.col("token")).alias("__at")).drop("__w") \
        .groupBy(*dict.fromkeys([*g, *corpus]), "token", "__at").agg(F.count(F.lit(1)).alias("__n"))
    own = at.groupBy(*dict.fromkeys([*g, *corpus]), "token").agg(F.sum("__n").alias("lines_with"), F.max("__n").alias("__top"))
    everywhere = own.groupBy(*corpus, "token").agg(F.sum("lines_with").alias("corpus_lines"))
    size = lines.filter(F.col("content").isNotNull()).groupBy(*corpus).agg(F.count(F.lit(1)).alias("__lines"))
    share = F.log(F.col("corpus_lines") + 1.0) / F.log(F.col("__lines") + 1.0)
    stability = F.col("__top") / F.col("lines_with")
    return own.join(everywhere, [*corpus, "token"]).join(size, corpus).select(
        *g, "token", "lines_with", F.round(stability, 6).alias("stability"), "corpus_lines", F.round(stability * share, 6).alias("score"))


def unstable_tokens(lines: DataFrame, group_cols: Sequence[str], order_col: str = "line_id") -> DataFrame:
    """``group cols, token``: values of columns with more than two values, among the lines that are as long as the
    group's first one, when that has more than seven tokens."""
    g = list(group_cols)
    words = lines.select(*g, order_col, marker_words("content").alias("__w")).withColumn("__n", F.size("__w"))
    first = words.groupBy(*g).agg(F.min_by("__n", order_col).alias("__n")).filter(F.col("__n") > LONG_LINE)
    cells = words.join(first, [*g, "__n"]).select(*g, F.posexplode("__w").alias("pos", "token")).groupBy(*g, "pos", "token").agg(F.lit(1).alias("__one"))
    many = cells.groupBy(*g, "pos").agg(F.count(F.lit(1)).alias("__values")).filter(F.col("__values") > STABLE_VALUES)
    return cells.join(many, [*g, "pos"]).select(*g, "token").distinct()


def variable_parts(col) -> Column:
    """Parts of ``A::B`` pairs that are variable: pairs with digits on both sides, and whatever shares a pair with one."""
    c = _c(col)
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(PAIR), 1).alias("a"), F.regexp_extract_all(c, F.lit(PAIR), 2).alias("b"))

    def parts(chosen):
        return F.array_distinct(F.flatten(F.transform(chosen, lambda p: F.array(p["a"], p["b"]))))

    seeds = parts(F.filter(pairs, lambda p: p["a"].rlike(r"\d") & p["b"].rlike(r"\d")))
    # A part is reached in no more steps than there are pairs.
    return F.aggregate(pairs, seeds, lambda known, _: F.array_union(known, parts(F.filter(
        pairs, lambda p: F.array_contains(known, p["a"]) | F.array_contains(known, p["b"])))))


def plain_words(col) -> Column:
    """Words of two or more characters that are not hexadecimal."""
    words = F.regexp_extract_all(_c(col), F.lit(PLAIN_WORD), 0)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike(r"^x[0-9a-fA-F]+$") & ~((F.length(w) > 3) & w.rlike(r"^[0-9a-fA-F]+$")))


def split_weights(reps: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Weight of every split key: ``reps`` has group cols, key and the key's first line ``content``.

    Adds ``partner, ing_behind_bracket, at_start, before_colon, shared_context, slot_at_start, weight``; keys of one or of
    more than twenty characters and the key for lines without a word have no weight.
    """
    from logweave.operators.splitting import partial_context, signature_counts
    g = list(group_cols)
    real = reps.filter(F.col("key") != "<UNKNOWN>").select(*g, "key", "content")
    partner = partial_context(real, g).withColumn("partner", F.lit(True))
    r = signature_counts(real, g).join(partner, [*g, "key"], "left").withColumn("partner", F.coalesce("partner", F.lit(False)))
    at, bracket = F.instr("content", F.col("key")), F.instr("content", F.lit("]"))
    r = r.withColumn("ing_behind_bracket", F.lower("key").endswith("ing") & (F.length("key") > 4) & (bracket > 0) & (at > bracket)) \
        .withColumn("at_start", F.ltrim("content").startswith(F.col("key"))) \
        .withColumn("before_colon", F.call_function("substring", F.col("content"), at + F.length("key"), F.lit(1)) == ":") \
        .withColumn("shared_context", F.col("signature_count") > 1)
    slot = r.groupBy(*g).agg(F.max(F.col("at_start") & F.col("shared_context")).alias("slot_at_start"))
    r = r.join(slot, g)
    plain = F.when(F.col("ing_behind_bracket"), ING_BEHIND_BRACKET).when(F.col("partner"), PARTNER).otherwise(1.0)
    weight = F.when(F.col("at_start"), F.when((F.col("shared_context") | F.col("slot_at_start")) & ~F.col("before_colon"), SLOT_AT_START).otherwise(AT_START)) \
        .when(F.col("shared_context"), SHARED_CONTEXT).otherwise(plain)
    return r.withColumn("weight", F.when(F.length("key").between(*KEY_LENGTHS), weight)).drop("signature", "signature_count")


def with_scores(reps: DataFrame, scores: DataFrame, token_col: str = "key") -> DataFrame:
    """``reps`` with ``score`` of their token; ``scores`` holds token, score and any of the columns that tell groups
    apart (a table by token alone counts everywhere).  Tokens without one score 0."""
    on = [c for c in scores.columns if c in reps.columns and c not in ("token", "score")]
    known = scores.groupBy(*on, "token").agg(F.max("score").alias("score")).withColumnRenamed("token", token_col)
    return reps.join(known, [*on, token_col], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def accepted_splits(reps: DataFrame, scores: DataFrame, few_words: DataFrame, group_cols: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """``group cols, keys, evidence, accepted``: a group's split stands when its lines have few plain words, or when
    the best score times weight of its keys, at most 1, reaches the threshold.

    ``few_words``: group cols, ``max_words``, the most plain words of a line of the group.
    """
    g = list(group_cols)
    value = F.least(F.col("score") * F.col("weight"), F.lit(1.0))
    best = with_scores(split_weights(reps, g), scores).groupBy(*g).agg(F.round(F.max(value), 6).alias("evidence"))
    keys = reps.groupBy(*g).agg(F.count(F.lit(1)).alias("keys"))
    return keys.join(best, g, "left").join(few_words, g, "left").select(
        *g, "keys", F.coalesce("evidence", F.lit(0.0)).alias("evidence"),
        ((F.col("keys") >= 2) & (F.coalesce(F.col("max_words") <= FEW_WORDS, F.lit(False)) | F.coalesce(F.col("evidence") >= threshold, F.lit(False)))).alias("accepted"))
