"""Template pool and matching lines against it.

Pool (per dataset): cleaned regex templates, deduplicated (first insertion
wins), strict-checked against their source line when one is given, ranked by
word count (descending) then insertion order.  Templates with at most one
static token are remembered but are not match candidates.

Matching (first hit in pool order, strict matcher) is a theta join.  It is
run as an equi-join on an *anchor*: a run of word characters that a template
holds between other literal characters, of its longest such runs the one that the fewest lines hold.  A line can
only match a template if that run is one of its own, so the join emits only plausible
pairs; these are verified within the join and the best one per distinct line kept with ``min_by``.
Templates without a whole run (every word touches a wildcard) have a rare gram of their literal
text as key instead; only those with neither join on (dataset, word count).
Lines are matched as distinct contents and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.matching import is_simple_template, line_parts, match_strict, match_strict_parts, regex_is_valid_udf, strict_parts
from logweave.functions.templates import (
    clean_template, regex_word_count, static_token_count,
)
from logweave.session import cut_lineage, sent

def template_pool(proposals: DataFrame, check_col: str | None = None, rank: bool = True) -> DataFrame:
    """Build the pool from proposals ``dataset, template, seq[, check line]``.

    Returns ``dataset, template_id, template_regex, word_count, static_tokens,
    candidate, seq, rank`` (rank over candidates only).
    """
    if not check_col:
        # Cleaning depends on the text only: clean each distinct proposal once.
        proposals = proposals.groupBy("dataset", "template").agg(F.min("seq").alias("seq"))
    # Rejected (null) and empty templates are dropped by the validity check
    # below, after de-duplication; a plain filter here would be pushed below
    # the aggregation and clean every proposal row.
    p = proposals.withColumn("template_regex", clean_template("template"))
    if check_col:
        checks = p.select("dataset", "template_regex", check_col).distinct()
        checks = checks.filter(match_strict(check_col, "template_regex"))
        p = p.join(checks, ["dataset", "template_regex", check_col], "left_semi")
    first = p.groupBy("dataset", "template_regex").agg(F.min("seq").alias("seq"))
    # (null and empty templates are invalid)
    # Invalid patterns never match; checked once per distinct template, and only where there is
    # more to a template than literals and wildcards.
    bare = F.replace(F.col("template_regex"), F.lit(","), F.lit(""))
    simple = F.coalesce(is_simple_template(bare), F.lit(False)) & (F.col("template_regex") != "")
    first = first.withColumn("__simple", simple) \
        .filter(F.col("__simple") | regex_is_valid_udf(F.when(~F.col("__simple"), bare))).drop("__simple")
    first = first.withColumn("word_count", regex_word_count("template_regex")) \
        .withColumn("static_tokens", static_token_count("template_regex")) \
        .withColumn("candidate", F.col("static_tokens") > 1) \
        .withColumn("template_id", F.xxhash64("dataset", "template_regex"))
    if not rank:
        # Matching only needs (word_count, seq); the explicit rank is optional.
        return first.withColumn("rank", F.lit(None).cast("int")) \
            .select("dataset", "template_id", "template_regex", "word_count", "static_tokens",
                    "candidate", "seq", "rank")
    # Rank in pool order without sorting a whole dataset's pool in one task.
    from logweave.operators.sampling import group_row_number
    ranked = group_row_number(first.withColumn("__neg_wc", -F.col("word_count")),
                              ["dataset", "candidate"], ["__neg_wc", "seq"], "__rank")
    return ranked.withColumn("rank", F.when(F.col("candidate"), F.col("__rank"))) \
        .select("dataset", "template_id", "template_regex", "word_count", "static_tokens",
                "candidate", "seq", "rank")


#: Largest anchor table that is broadcast.
BROADCAST_BYTES = 32 << 20
#: Stands for a wildcard while the literal text of a template is read.
_GAP = "\x01"
#: A whole run of word characters: bounded by other literal characters or the ends.
_RUN = r"(?U)(?<![\w\x01])\w+(?![\w\x01])"
#: An anchor is the rarest of a template's longest runs, so many of them; any run would do, as every matching line holds all.
_LONGEST = 4
#: Of so many of its longest keys an indexed template takes the one that the fewest lines hold.
_LOOKED_UP = 8
#: Literal text of a template in grams of so many characters, the key of templates without a whole run.
GRAM = 3


def _literal(regex) -> F.Column:
    r = F.replace(regex, F.lit(","), F.lit(""))
    return F.regexp_replace(F.replace(r, F.lit("(.*?)"), F.lit(_GAP)), r"(?s)\\(.)", "$1")


def _grams(text) -> F.Column:
    """The distinct grams of each piece of a literal text, none across a wildcard."""
    def of(piece):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(piece) - (GRAM - 1), F.lit(1))), lambda i: F.substring(piece, i, F.lit(GRAM)))
    return F.array_distinct(F.filter(F.flatten(F.transform(F.split(text, _GAP), of)), lambda g: F.length(g) == GRAM))


def template_anchors(pool: DataFrame) -> DataFrame:
    """A run of word characters that every matching line holds as a whole run: of a
    template's longest runs the one that the fewest templates share (null when it has none)."""
    c = pool.filter("candidate").select("dataset", "template_id", "template_regex", "word_count", "seq")
    return _rarest(c.withColumn("keys", _runs_of(F.col("template_regex"))), "anchor")


def _runs_of(regex) -> F.Column:
    simple = is_simple_template(F.replace(regex, F.lit(","), F.lit("")))
    runs = F.array_distinct(F.regexp_extract_all(_literal(regex), F.lit(_RUN), 0))
    return F.when(simple, runs).otherwise(F.array().cast("array<string>"))


def _longest(keys, most: int = _LONGEST) -> F.Column:
    by_length = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("l"), k.alias("k"))))
    return F.slice(by_length, 1, most)["k"]


def _rarest(c: DataFrame, name: str) -> DataFrame:
    """``c`` without its ``keys`` but with the one of the longest of them that the fewest templates have."""
    runs = c.select("dataset", "template_id", F.explode(_longest(F.col("keys"))).alias(name))
    shared = runs.groupBy("dataset", name).agg(F.count(F.lit(1)).alias("n"))
    best = runs.join(shared, ["dataset", name]).groupBy("dataset", "template_id").agg(
        F.min_by(name, F.struct("n", (-F.length(name)).alias("l"), name)).alias(name))
    return c.drop("keys").join(best, ["dataset", "template_id"], "left")


#: Written bytes of a table of words or digests that is sent to every task.
SENT_BYTES = 2 << 20


def with_runs(templates: DataFrame) -> DataFrame:
    """Rows with a ``template``, its ``digest`` and the longest whole ``runs`` of word characters of its cleaned form (null: rejected)."""
    clean = templates.withColumn("__clean", clean_template("template"))
    runs = F.when(F.col("__clean").isNotNull(), _longest(_runs_of(F.col("__clean"))))
    return clean.withColumn("runs", runs).withColumn("digest", F.unhex(F.md5("template"))).drop("__clean")


def possible_templates(templates: DataFrame, lines: DataFrame) -> DataFrame:
    """Of the written rows of ``with_runs`` those whose template could match one of ``lines`` (dataset, content): every
    whole run of word characters of a template must be a run of some line, and the longest ones are looked up.

    A pool of many templates for few lines is cut to what matters before anything dear is done with it.  The runs of a
    template travel with its digest, its text stays where it is while few are possible.
    """
    bare = F.replace(F.col("content"), F.lit(","), F.lit(""))
    said = cut_lineage(lines.select("dataset", F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?U)\w+"), 0))).alias("run")).distinct())
    runs = templates.filter(F.col("runs").isNotNull()).select("dataset", "digest", F.explode_outer("runs").alias("run"))
    absent = F.col("run").isNotNull() & F.col("__said").isNull()
    able = cut_lineage(runs.join(sent(said, SENT_BYTES).withColumn("__said", F.lit(1)), ["dataset", "run"], "left").groupBy("dataset", "digest")
                       .agg(F.max(absent).alias("__absent")).filter(~F.col("__absent")).drop("__absent"))
    return templates.join(sent(able, SENT_BYTES), ["dataset", "digest"], "left_semi").drop("digest", "runs")


def index_templates(pool: DataFrame) -> DataFrame:
    """The candidates of a pool, written once with all that matching needs of a template: ``runs`` (its longest whole runs
    of word characters), else ``grams`` (pieces of its literal text), and ``parts`` (its segments and ``=`` count).

    Indexes of several pools are united as they are, so a growing pool indexes only what it gains.
    """
    c = cut_lineage(pool.filter("candidate").select("dataset", "template_id", "template_regex", "word_count", "seq",
                                                    strict_parts("template_regex").alias("parts"), _runs_of(F.col("template_regex")).alias("runs")))
    loose = (F.size("runs") == 0) & F.col("parts.plain")
    grams = F.when(loose, _longest(_grams(_literal(F.col("template_regex"))), _LOOKED_UP)).otherwise(F.array().cast("array<string>"))
    return cut_lineage(c.withColumn("grams", grams).withColumn("runs", _longest(F.col("runs"), _LOOKED_UP)))


def match_indexed(lines: DataFrame, index: DataFrame) -> DataFrame:
    """First indexed template (by word count desc, insertion order) that strictly matches each line, for lines with
    at least its word count.  Returns the lines with ``template_id, template_regex`` (null when nothing matches).

    A template's anchor is the one of its keys that the fewest of these lines hold; without a line that holds it the template is left out.
    Lines meet the anchors by short rows (key and digest).  Then a line's text goes to each of its anchors and pairs are
    verified where they arise, so only those that match are passed on.
    """
    distinct = lines.select("dataset", "content").where(F.col("content").isNotNull()).distinct() \
        .withColumn("n_tokens", F.size(F.filter(F.split("content", "(?U)\\s+"), lambda t: t != ""))) \
        .withColumn("digest", F.unhex(F.md5("content")))
    kinds = index.agg(F.count(F.when(F.size("runs") > 0, 1)), F.count(F.when(F.size("grams") > 0, 1)),
                      F.count(F.when((F.size("runs") == 0) & (F.size("grams") == 0), 1))).first()
    bare = F.replace(F.col("content"), F.lit(","), F.lit(""))
    text = distinct.select("dataset", "digest", "n_tokens", "content", line_parts("content").alias("line"))
    found = None
    for n, where, keys, own in (
            (kinds[0], F.size("runs") > 0, F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?U)\w+"), 0)), F.col("runs")),
            (kinds[1], F.size("grams") > 0, _grams(bare), F.col("grams")),
            # No literal text to speak of: any line with their words.
            (kinds[2], (F.size("runs") == 0) & (F.size("grams") == 0), F.sequence(F.lit(1), F.greatest("n_tokens", F.lit(1))), F.array("word_count"))):
        if not n:
            continue
        keyed = distinct.select("dataset", "digest", "n_tokens", F.explode(keys).alias("key"))
        anchored = _rarest_in(index.filter(where).withColumn("keys", own), keyed)
        # Sent to every task only below a checked number of bytes.
        size = anchored.agg(F.sum(2 * F.octet_length("template_regex") + 128)).first()[0] or 0
        send = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
        # The anchors alone are few bytes where their templates are many: keys that are none are not shuffled.
        least = anchored.groupBy("dataset", "key").agg(F.min("word_count").alias("least"))
        if (least.agg(F.sum(F.octet_length("key") + 128)).first()[0] or 0) <= BROADCAST_BYTES:
            least = F.broadcast(least)
        near = keyed.join(least, ["dataset", "key"]).filter(F.col("least") <= F.col("n_tokens")).select("dataset", "key", "digest")
        pairs = near.join(text, ["dataset", "digest"]).join(send(anchored), ["dataset", "key"]).filter(F.col("word_count") <= F.col("n_tokens"))
        hits = pairs.filter(match_strict_parts("content", "template_regex", F.col("line"), F.col("parts"))) \
            .select("dataset", "content", "template_id", "template_regex", "word_count", "seq")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        none = F.lit(None)
        return lines.withColumn("template_id", none.cast("long")).withColumn("template_regex", none.cast("string"))
    best = found.groupBy("dataset", "content").agg(
        F.min_by(F.struct("template_id", "template_regex"),
                 F.struct((-F.col("word_count")).alias("w"), F.col("seq").alias("s"))).alias("m"))
    best = best.select("dataset", "content", "m.template_id", "m.template_regex")
    return lines.join(best, ["dataset", "content"], "left")


def _rarest_in(templates: DataFrame, keyed: DataFrame) -> DataFrame:
    """``templates`` with the one of their ``keys`` that the fewest rows of ``keyed`` (dataset, key) have as ``key``; those with
    a key that no row has are left out.  Written once."""
    spots = templates.select("dataset", "template_id", F.explode("keys").alias("key"))
    held = keyed.groupBy("dataset", "key").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("key").alias("key"))
    best = spots.join(held, ["dataset", "key"], "left").groupBy("dataset", "template_id").agg(F.min(rarest).alias("m")) \
        .filter(F.col("m.n") > 0).select("dataset", "template_id", "m.key")
    return cut_lineage(templates.join(best, ["dataset", "template_id"])
                       .select("dataset", "key", "template_id", "template_regex", "word_count", "seq", "parts"))


def match_templates(lines: DataFrame, pool: DataFrame) -> DataFrame:
    """``match_indexed`` against a pool that is indexed for this one use (``lines``: dataset, content and any other columns)."""
    return match_indexed(lines, index_templates(pool))


def templates_in_band(lengths: DataFrame, pool: DataFrame, below: int = 8, above: int = 1) -> DataFrame:
    """Candidate templates whose word count is within ``[n-below, n+above]`` of
    each distinct line length ``n`` (``lengths``: dataset, n_tokens): an equi-join on the word counts of the band."""
    c = pool.filter("candidate").select("dataset", "template_id", "template_regex", "word_count")
    band = lengths.withColumn("word_count", F.explode(F.sequence(F.col("n_tokens") - below, F.col("n_tokens") + above)))
    return band.join(c, ["dataset", "word_count"]).select("dataset", "n_tokens", "template_id", "template_regex", "word_count")


def unmatched(lines: DataFrame, matched: DataFrame, keys=("dataset", "line_id")) -> DataFrame:
    """Lines not yet matched (anti-join on the line key)."""
    return lines.join(matched.select(*keys), list(keys), "left_anti")


def merge_templates(groups: DataFrame, key_col: str = "normalised") -> DataFrame:
    """Merge events whose normalised templates are equal."""
    return groups.groupBy("dataset", key_col).agg(
        F.sum("count").alias("count"), F.min("first_line").alias("first_line"),
        F.min("template").alias("template"))
