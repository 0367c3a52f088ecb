"""Template assignment: static groups, proposals, verification, retries.

``parse_logs`` turns mined groups into verified template regexes:

1. static groups (one distinct line with no variable-looking characters) use
   the escaped line itself;
2. every other group gets a proposal from a *proposer* (default: the
   position-wise consensus of the group's masked lines, i.e. no model);
3. a proposal is verified on every distinct line of its group with the lenient
   matcher; a proposal with hard-coded ``key=value`` constants fails the
   whole group (``lint=True``);
4. lines that fail are matched against the pool of all templates verified so far
   (strict matcher, first hit by word count then order), and those without a
   hit get a new proposal, up to ``rounds`` more times, while progress is made;
5. the rest keep their last proposal with ``verified = false``.

Each round is a set-based Spark job over all groups at once; state between
rounds is cut with a reliable checkpoint in the cluster's checkpoint folder.
"""

from __future__ import annotations

from typing import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.lints import hardcoded_params
from logweave.functions.matching import lenient_line, lenient_parts, match_lenient_parts, regex_is_valid_udf
from logweave.functions.masking import mask_variables
from logweave.functions.text import tokenize
from logweave.functions.templates import clean_template, literal_template, template_to_regex
from logweave.operators.lint import with_report
from logweave.operators.mining import consensus_template
from logweave.operators.pool import SENT_BYTES, index_templates, match_indexed, possible_templates, template_pool, with_runs
from logweave.operators.sampling import diverse_sample
from logweave.operators.templates import repair_templates
from logweave.session import cut_lineage, sent

# A one-line group is static unless it holds one of these.
STATIC_BREAKERS = [" is ", "=", " to ", "_", "-", ":", "."]


def _is_plain(content) -> F.Column:
    """A line free of variable-looking text."""
    breaker = F.lit(False)
    for s in STATIC_BREAKERS:
        breaker = breaker | content.contains(s)
    return ~(breaker | content.rlike("\\p{Nd}"))


def static_groups(groups: DataFrame, group_col: str = "template") -> DataFrame:
    """Groups with exactly one distinct content free of variable-looking text.

    Returns ``dataset, group_col, content, template_regex`` (escaped line).
    """
    agg = groups.groupBy("dataset", group_col).agg(F.min("content").alias("content"), F.max("content").alias("__last"))
    return agg.filter((F.col("content") == F.col("__last")) & _is_plain(F.col("content"))).select(
        "dataset", group_col, "content", literal_template("content").alias("template_regex"))


Proposer = Callable[[DataFrame], DataFrame]

#: Lines a group that a proposer with feedback sees, if no number is given.
FEEDBACK_SAMPLE = 5


def grouped_proposer(fn: Callable[[list[str], list[str], list[str]], str | None]) -> Proposer:
    """A proposer for ``parse_logs(feedback=True)`` that calls ``fn(sample, reports, history)`` once a group.

    ``sample``: its sampled lines that still fail; ``reports``: the lint report of the last template on each of
    them (empty in the first round); ``history``: the template regexes tried, in order.  ``fn`` returns a template (``<*>``
    form) or None.  The call gets the sampled rows of one group, which their number bounds.
    """
    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_id", "content"], kind="stable")
        history = max((list(h) for h in pdf["history"]), key=len)
        reports = [r for r in pdf["report"] if isinstance(r, str)]
        template = fn(pdf["content"].tolist(), reports, history)
        return pdf.iloc[:1][["dataset", "group_key"]].assign(template=template)

    def propose(rows: DataFrame) -> DataFrame:
        return rows.select("dataset", "group_key", "line_id", "content", "history", "report") \
            .groupBy("dataset", "group_key").applyInPandas(call, "dataset string, group_key string, template string")
    return propose


def with_feedback(rows: DataFrame, todo: DataFrame) -> DataFrame:
    """Sampled rows (dataset, group_key, line_id, content) with ``history`` (templates tried), the last one as
    ``template_regex`` and its lint ``report`` on the line (null before the first try)."""
    key = ["dataset", "group_key", "content"]
    told = rows.join(todo.select(*key, "history"), key)
    return with_report(told.withColumn("template_regex", clean_template(F.try_element_at("history", F.lit(-1))))) \
        .withColumn("report", F.when(F.col("template_regex").isNotNull(), F.col("report")))


def consensus_proposer(masks: Sequence[str], unicode: bool = True) -> Proposer:
    """Default proposer: consensus of the masked lines of each group.

    Input rows ``dataset, group_key, line_id, content``; output
    ``dataset, group_key, template`` (``<*>`` form).  Groups whose lines differ
    in word count get the consensus of their most common length.
    """
    def propose(rows: DataFrame) -> DataFrame:
        # Consensus depends only on the distinct masked patterns of a group.
        m = rows.withColumn("pattern", mask_variables("content", masks, unicode)) \
            .withColumn("__key", F.concat_ws("\u0001", "dataset", "group_key")) \
            .groupBy("__key", "dataset", "group_key", "pattern").agg(F.count(F.lit(1)).alias("lines"))
        cons = consensus_template(m, "__key", "pattern", unicode)
        sizes = m.groupBy("__key", F.size(tokenize("pattern", unicode)).alias("n_tokens")) \
            .agg(F.sum("lines").alias("count"))
        best = cons.join(sizes, ["__key", "n_tokens"], "left")
        best = best.groupBy("__key").agg(F.max_by("template", F.struct(F.coalesce("count", F.lit(0)),
                                                                         (-F.col("n_tokens")))).alias("template"))
        keys = m.select("__key", "dataset", "group_key").distinct()
        return best.join(keys, "__key").select("dataset", "group_key", "template")
    return propose


def verify_templates(rows: DataFrame, proposals: DataFrame, lint: bool = True,
                     with_rate: bool = False, validate: bool = True) -> DataFrame:
    """Check a proposal on every line of its group.

    ``rows``: dataset, group_key, line_id, content; ``proposals``: dataset,
    group_key, template_regex.  Adds ``matched`` per line and
    ``group_match_rate``.
    """
    p = _prepared(proposals, lint, validate)
    j = _judged(rows.withColumn("__line", lenient_line("content")).join(p, ["dataset", "group_key"], "left"))
    if not with_rate:
        return j
    rate = j.groupBy("dataset", "group_key").agg(F.avg(F.col("matched").cast("double")).alias("group_match_rate"))
    return j.join(rate, ["dataset", "group_key"])


def _prepared(proposals: DataFrame, lint: bool, validate: bool) -> DataFrame:
    """What belongs to a proposal alone: ``cleaned, hardcoded, valid, __parts``."""
    p = proposals.withColumn("cleaned", clean_template("template_regex"))
    if lint:
        bad = (F.col("cleaned").contains("=") | F.col("cleaned").contains(":")) & \
            (F.size(hardcoded_params("cleaned")) > 0)
    else:
        bad = F.lit(False)
    # Proposals from an outside proposer are checked once per template; the
    # built-in proposer only emits escaped templates (``validate=False``).
    valid = regex_is_valid_udf(F.translate("cleaned", ",$", "")) if validate \
        else F.col("cleaned").isNotNull() & (F.col("cleaned") != "")
    return p.withColumn("hardcoded", F.coalesce(bad, F.lit(False))).withColumn("valid", valid).withColumn("__parts", lenient_parts("cleaned"))


def _judged(j: DataFrame) -> DataFrame:
    """``matched`` of rows with a ``content``, its ``__line`` and what ``_prepared`` adds."""
    ok = F.col("cleaned").isNotNull() & ~F.col("hardcoded") & \
        F.when(F.col("valid"), match_lenient_parts("content", F.col("cleaned"), F.col("__line"), F.col("__parts"))).otherwise(F.lit(False))
    return j.withColumn("matched", F.coalesce(ok, F.lit(False))).drop("__parts", "__line")


#: Counted bytes of what the first check does not settle, below which it goes to every task.
BROADCAST_LATE_BYTES = 64 << 20


class _Mined:
    """The first check of mined lines, whose proposal is the template that they carry: it is read off every line, so
    only groups (a row each), the lines that fail, and digests are written or shuffled.

    ``groups``: dataset, group_key, words (of the first line), matched (a line fits), literal (of a static group), and the digest and runs of their template;
    ``wrong``: the distinct contents that fail, but for static groups.
    """

    def __init__(self, lines: DataFrame, lint: bool):
        self.lines, self.lint = lines, lint
        self.g, self.d = F.unhex(F.md5("group_key")).alias("g"), F.unhex(F.md5("content")).alias("d")
        self.known = F.col("content").isNotNull() & F.col("group_key").isNotNull() & F.col("dataset").isNotNull()
        known = lines.filter(self.known)
        value = F.xxhash64("content")  # tells whether a group has a single content
        plain = F.min(F.when(_is_plain(F.col("content")), F.col("content")))
        groups = self._told(known).groupBy("dataset", "group_key").agg(
            F.min_by(F.size(tokenize("content")), "line_id").alias("words"), F.max("matched").alias("matched"), F.min("matched").alias("all"),
            F.when(F.min(value) == F.max(value), plain).alias("content"))
        groups = groups.withColumn("literal", literal_template("content"))
        self.groups = cut_lineage(with_runs(groups.withColumn("template", self._template())).select(
            "dataset", "group_key", "words", "matched", "all", self.g, self.d, "literal", "digest", "runs"))
        self.static = cut_lineage(self.groups.filter(F.col("literal").isNotNull()).select("dataset", "g", "d"))
        failing = cut_lineage(self.groups.filter(~F.col("all") & F.col("literal").isNull()).select("dataset", "g"))
        told = self._told(known.withColumn("g", self.g).join(sent(failing, SENT_BYTES), ["dataset", "g"], "left_semi"))
        # A row number, though it never counts, keeps the filter above all that ``matched`` is made of; below, each step would be worked out many times.
        wrong = told.filter(~(F.col("matched") | F.col("never"))).groupBy("dataset", "group_key", "content", "template_regex")
        self.wrong = cut_lineage(wrong.agg(F.min("line_id").alias("line_id")).withColumn("mined", F.col("group_key")))

    def _told(self, lines: DataFrame) -> DataFrame:
        """Lines with their proposal (``template_regex``) and whether it is right (``matched``)."""
        p = lines.withColumn("template_regex", template_to_regex("group_key")).withColumn("__line", lenient_line("content"))
        return _judged(_prepared(p, self.lint, False)).withColumn("never", F.monotonically_increasing_id() < 0).drop("hardcoded", "valid", "cleaned")

    @staticmethod
    def _template() -> F.Column:
        return F.coalesce("literal", F.when(F.col("matched"), clean_template(template_to_regex("group_key"))))

    def templates(self) -> DataFrame:
        """The groups that are static or have a line that their proposal fits, as ``possible_templates`` takes them."""
        return self.groups.filter(F.col("literal").isNotNull() | F.col("matched")).select("dataset", "group_key", "literal", "matched", "digest", "runs")

    def words(self, keys: DataFrame) -> DataFrame:
        """(dataset, group_key, words) of some groups."""
        return keys.withColumn("g", self.g).join(self.groups.select("dataset", "g", "words"), ["dataset", "g"]).drop("g")

    def possible(self, unsolved: DataFrame) -> DataFrame:
        """(dataset, group_key, template) of the templates that could match an unsolved content."""
        return possible_templates(self.templates(), unsolved).select("dataset", "group_key", self._template().alias("template"))

    def settled(self, late: DataFrame) -> DataFrame:
        """All lines with template_regex, verified, source and history; ``late`` has them for each of the contents that failed."""
        answers = ["template_regex", "verified", "source", "history"]
        late = cut_lineage(late.select("dataset", self.g, self.d, F.struct(*answers).alias("late")))
        texts = F.octet_length("late.template_regex") * (F.size("late.history") + 1)
        size = 200 * self.static.count() + (late.agg(F.sum(texts + 200)).first()[0] or 0)
        others = late.unionByName(self.static.withColumn("late", F.lit(None).cast(late.schema["late"].dataType))) \
            .withColumn("static", F.col("late").isNull())
        if size <= BROADCAST_LATE_BYTES:
            others = F.broadcast(others)
        out = self.lines.withColumn("g", self.g).withColumn("d", self.d).join(others, ["dataset", "g", "d"], "left")
        static, failed = F.coalesce("static", F.lit(False)), F.col("late").isNotNull()
        right = ~static & ~failed & self.known
        # The proposal of a line that is right, before and after it is cleaned.
        out = out.withColumn("own", F.when(static, literal_template("content")).when(right, template_to_regex("group_key")))
        regex = F.when(static, F.col("own")).when(failed, F.col("late.template_regex")).when(right, clean_template("own"))
        source = F.when(static, "static").when(failed, F.col("late.source")).when(right, "round0")
        return out.select("dataset", "line_id", "content", regex.alias("template_regex"), F.coalesce("late.verified", static | right).alias("verified"),
                          source.alias("source"), F.coalesce("late.history", F.when(static | right, F.array("own"))).alias("history"))


def parse_logs(groups: DataFrame, masks: Sequence[str], proposer: Proposer | None = None,
               rounds: int = 3, lint: bool = True, use_pool: bool = True,
               group_col: str = "template", sample_size: int | None = None, feedback: bool = False) -> DataFrame:
    """Assign a verified template regex to every mined line.

    ``groups``: dataset, line_id, content, template (from mining); a group is the
    whole template text.  All rounds work on the distinct contents of a group and the
    lines are joined once at the end.  Before each proposal the failing contents are tried
    against the pool of templates verified so far, whichever group they come from.  An
    outside ``proposer`` gets a diverse sample of ``sample_size`` lines a group (all lines if
    None) and its templates are repaired first.  With ``feedback`` its rows also hold the group's history and
    the lint report of the last template on the line (``with_feedback``), on a sample of ``sample_size`` or ``FEEDBACK_SAMPLE``
    lines a group; ``grouped_proposer`` hands all of it to a function at once.

    Returns ``dataset, line_id, content, event_id, template_regex, verified, source,
    history`` (the templates tried, in order) with the same row count as the input;
    null lines have no template.
    """
    key = ["dataset", "group_key"]
    lines = groups.select("dataset", "line_id", "content", F.col("template").alias("mined"), F.col(group_col).alias("group_key"))
    columns = [*key, "content", "template_regex", "verified", "source", "history"]
    first = _Mined(lines, lint) if proposer is None and group_col == "template" else None
    if first:
        # The first round is read off the lines.
        fresh, words_of = first.templates(), first.words
        wrong = first.wrong.withColumn("history", F.array("template_regex"))
        done = wrong.filter(F.lit(rounds < 1)).withColumn("verified", F.lit(False)).withColumn("source", F.lit("unverified")).select(*columns)
        todo = wrong.drop("template_regex")
    else:
        base = cut_lineage(lines.filter(F.col("content").isNotNull() & F.col("group_key").isNotNull())
                           .groupBy(*key, "content").agg(F.min("line_id").alias("line_id"), F.min("mined").alias("mined")))
        static = static_groups(base, "group_key")
        base = cut_lineage(base.join(static.withColumnRenamed("template_regex", "literal"), [*key, "content"], "left"))
        literal = base.filter(F.col("literal").isNotNull()).withColumnRenamed("literal", "template_regex")
        done = literal.withColumn("verified", F.lit(True)).withColumn("source", F.lit("static")) \
            .withColumn("history", F.array("template_regex")).select(*columns)
        todo = base.filter(F.col("literal").isNull()).drop("literal").withColumn("history", F.array().cast("array<string>"))
        fresh = literal.select(*key, F.col("template_regex").alias("template"))

        def words_of(keys: DataFrame) -> DataFrame:
            return base.join(keys, key, "left_semi").groupBy(*key).agg(F.min_by("content", "line_id").alias("first")).select(*key, F.size(tokenize(F.col("first"))).alias("words"))

    def index_of(templates: DataFrame | None, unsolved: DataFrame) -> DataFrame:
        """The templates (key, template; None: those of the mined groups) that could match an unsolved content, indexed.  Pool
        insertion order: word count of the first line of the template's group, then the group key."""
        possible = cut_lineage(first.possible(unsolved) if templates is None else possible_templates(cut_lineage(with_runs(templates)), unsolved).distinct())
        order = words_of(possible.select(*key).distinct()).select(*key, F.struct("words", F.col("group_key").alias("key")).alias("seq"))
        proposals = possible.join(order, key).groupBy("dataset", "template").agg(F.min("seq").alias("seq"))
        return index_templates(template_pool(proposals, rank=False))

    def unsolved() -> DataFrame:
        return todo.select("dataset", "content").unionByName(done.filter(~F.col("verified")).select("dataset", "content"))

    # Verified since the failing contents were last tried: older templates have failed on them already.
    # Each round's templates are cleaned, checked and indexed once; ``later`` are the indexes since the first round.
    later: DataFrame | None = None
    r = 0
    for r in range(1 if first else 0, rounds + 1 if not (first and todo.isEmpty()) else 0):
        if use_pool and r and not fresh.isEmpty():
            index = index_of(None if first and r == 1 else fresh, unsolved())
            if r > 1:
                later = index if later is None else later.unionByName(index)
            fresh = None
            tried = cut_lineage(match_indexed(todo, index))
            hit = tried.filter(F.col("template_regex").isNotNull())
            done = done.unionByName(hit.withColumn("verified", F.lit(True)).withColumn("source", F.lit("pool")).select(*columns))
            todo = tried.filter(F.col("template_regex").isNull()).select(*todo.columns)
            if todo.isEmpty():
                break
        if proposer is None:
            # The mined template is the consensus of its group; later ones are that of what is left of it.
            prop = todo.select(*key, F.col("mined").alias("template")).dropDuplicates(key) if r == 0 \
                else consensus_proposer(masks)(todo.select(*key, "line_id", "content"))
        else:
            rows = todo.select(*key, "line_id", "content")
            size = sample_size or (FEEDBACK_SAMPLE if feedback else None)
            if size:
                rows = diverse_sample(rows, k=size, group_cols=key).select(*key, "line_id", "content")
            if feedback:
                rows = with_feedback(rows, todo)
            prop = repair_templates(proposer(rows).select(*key, "template"))
        prop = prop.withColumn("template_regex", template_to_regex("template")).select(*key, "template_regex")
        checked = verify_templates(todo, prop, lint, validate=proposer is not None) \
            .withColumn("repeated", F.array_contains("history", F.col("template_regex"))) \
            .withColumn("history", F.array_append("history", F.col("template_regex")))
        checked = cut_lineage(checked)
        new = checked.filter("matched").select(*key, F.col("cleaned").alias("template"))
        fresh = new if fresh is None or r else fresh.unionByName(new)
        done = done.unionByName(checked.filter("matched").select(
            *key, "content", F.col("cleaned").alias("template_regex"), F.lit(True).alias("verified"), F.lit(f"round{r}").alias("source"), "history"))
        wrong = checked.filter(~F.col("matched"))
        # Another round for groups whose proposal was new and, after the first check, fixed nothing.
        state = checked.groupBy(*key).agg(F.max("matched").alias("fixed"), F.max(F.coalesce("repeated", F.lit(False))).alias("repeated"))
        again = state.filter(~F.col("repeated") & (F.lit(r == 0) | ~F.col("fixed"))).select(*key)
        last = r == rounds
        stop = wrong if last else wrong.join(again, key, "left_anti")
        done = done.unionByName(stop.withColumn("verified", F.lit(False)).withColumn("source", F.lit("unverified")).select(*columns))
        todo = wrong.join(again, key).select(*todo.columns)
        if last or todo.isEmpty():
            break
    if use_pool and r and fresh is not None and not fresh.isEmpty():
        index = index_of(fresh, unsolved())
        later = index if later is None else later.unionByName(index)
    if later is not None:
        # What is left over may fit a template that was verified after its group had stopped.
        rest = done.filter(~F.col("verified"))
        tried = match_indexed(rest.withColumnRenamed("template_regex", "own"), later)
        found = F.col("template_regex").isNotNull()
        tried = tried.withColumn("verified", found).withColumn("source", F.when(found, "pool").otherwise("unverified")) \
            .withColumn("template_regex", F.coalesce("template_regex", "own"))
        done = done.filter("verified").unionByName(tried.select(*columns))
    out = first.settled(done) if first else lines.join(done, [*key, "content"], "left")
    event = F.when(F.col("verified"), F.substring(F.md5(F.col("template_regex")), 1, 8)) \
        .otherwise(F.concat(F.lit("u"), F.col("line_id").cast("string")))
    return out.withColumn("verified", F.coalesce("verified", F.lit(False))).withColumn("source", F.coalesce("source", F.lit("unverified"))) \
        .withColumn("history", F.coalesce("history", F.array().cast("array<string>"))) \
        .select("dataset", "line_id", "content", event.alias("event_id"), "template_regex", "verified", "source", "history")
