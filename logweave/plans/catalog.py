"""Registered queries: each binds library operators to the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB SQL
over the same parquet tables) when the result is SQL-expressible.  Every query
reads whole tables (or corpora Spark derives from them).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions import masking, text
from logweave.operators import accuracy as acc
from logweave.operators import mining
from logweave.plans import sql as S
from logweave.session import shared_folder
from logweave.sources import corpora

QUERIES: dict = {}
ORACLE: dict = {}

EVENT_MASKS = corpora.EVENT_MASKS


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.event_logs(spark, sf)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.doc_lines(spark, sf)


# ---------------------------------------------------------------------------
# Sources
# ---------------------------------------------------------------------------
def _event_csv(spark, sf) -> str:
    """The labelled event log as CSV files in the shared folder."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    corpora.event_labels(spark, sf).select(F.col("line_id").alias("LineId"), F.col("content").alias("Content"), F.col("event_template").alias("EventTemplate")) \
        .write.option("header", True).option("escape", '"').csv(path)
    return path


@register("read_logs", f"WITH {S.EV} SELECT dataset, line_id, content FROM ev")
def q_read_logs(spark, sf):
    return lg.read_logs(spark, _event_csv(spark, sf), "events")


@register("doc_lines", f"WITH {S.DL} SELECT dataset, line_id, content FROM dl")
def q_doc_lines(spark, sf):
    return _docs(spark, sf).select("dataset", "line_id", "content")


# ---------------------------------------------------------------------------
# Masking and tokens
# ---------------------------------------------------------------------------
@register("mask_variables", f"WITH {S.DL} SELECT line_id, {S.masked('content')} AS masked FROM dl")
def q_mask_variables(spark, sf):
    return _docs(spark, sf).select("line_id", masking.mask_variables("content", EVENT_MASKS).alias("masked"))


@register("mask_sequential", f"""WITH {S.DL} SELECT line_id,
  regexp_replace(regexp_replace(regexp_replace(content, '([0-9]+\\.){{3}}[0-9]+', '<*>', 'g'),
  '[0-9]+\\.[0-9]+', '<*>', 'g'), '[0-9]+', '<*>', 'g') AS masked FROM dl""")
def q_mask_sequential(spark, sf):
    return _docs(spark, sf).select("line_id", masking.mask_sequential("content", EVENT_MASKS).alias("masked"))


@register("tokenize", f"""WITH {S.DL} SELECT line_id, len({S.tokens('content')}) AS n_tokens,
  {S.pattern('content')} AS tokens FROM dl""")
def q_tokenize(spark, sf):
    t = text.tokenize("content", unicode=False)
    return _docs(spark, sf).select("line_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("pattern_counts", f"""WITH {S.EV}, m AS (SELECT dataset, line_id, {S.pattern(S.masked('content'))} AS pattern FROM ev)
SELECT dataset, pattern, count(*) AS n, min(line_id) AS first_id FROM m GROUP BY dataset, pattern""")
def q_pattern_counts(spark, sf):
    return mining.pattern_counts(_events(spark, sf), EVENT_MASKS, unicode=False) \
        .select("dataset", "pattern", "n", "first_id")


# ---------------------------------------------------------------------------
# Mining
# ---------------------------------------------------------------------------
@register("mine_templates", f"""WITH {S.EV}
SELECT dataset, line_id, event_template AS template, substr(md5(event_template), 1, 8) AS event_id FROM ev""")
def q_mine_templates(spark, sf):
    return mining.mine_templates(_events(spark, sf), EVENT_MASKS, depth=4) \
        .select("dataset", "line_id", "template", "event_id")


_D1 = 'user <*> <*> value=<*> from <*> props {"k": <*>}'


@register("mine_templates_depth1", f"""WITH {S.EV}
SELECT dataset, line_id, '{_D1}' AS template, substr(md5('{_D1}'), 1, 8) AS event_id FROM ev""")
def q_mine_templates_depth1(spark, sf):
    return mining.mine_templates(_events(spark, sf), EVENT_MASKS, depth=1) \
        .select("dataset", "line_id", "template", "event_id")


@register("mine_doc_lines")
def q_mine_doc_lines(spark, sf):
    return mining.mine_templates(_docs(spark, sf), [r"[0-9]+"], depth=3) \
        .select("dataset", "line_id", "template", "event_id")


@register("event_counts", f"""WITH {S.EV}
SELECT dataset, substr(md5(event_template), 1, 8) AS event_id, event_template AS template, count(*) AS occurrences
FROM ev GROUP BY dataset, event_template""")
def q_event_counts(spark, sf):
    return mining.event_counts(mining.mine_templates(_events(spark, sf), EVENT_MASKS, depth=4))


@register("consensus_template", f"""WITH {S.EV},
m AS (SELECT event_type, {S.tokens(S.masked('content'))} AS t FROM ev),
x AS (SELECT event_type, len(t) AS n_tokens, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM m),
p AS (SELECT event_type, n_tokens, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '<*>' END AS tok
      FROM x GROUP BY event_type, n_tokens, pos)
SELECT event_type, n_tokens, string_agg(tok, ' ' ORDER BY pos) AS template FROM p GROUP BY event_type, n_tokens""")
def q_consensus_template(spark, sf):
    ev = _events(spark, sf)
    m = ev.select("event_type", masking.mask_variables("content", EVENT_MASKS).alias("pattern"))
    return mining.consensus_template(m, "event_type", "pattern", unicode=False)


@register("assign_clusters", f"""WITH {S.EV}
SELECT dataset, line_id, content, event_template AS template, CAST(7 AS DOUBLE) / 9 AS similarity FROM ev""")
def q_assign_clusters(spark, sf):
    ev = _events(spark, sf)
    clusters = mining.event_counts(mining.mine_templates(ev, EVENT_MASKS, depth=4)).select("dataset", "template")
    return mining.assign_clusters(ev, clusters, EVENT_MASKS, st=0.5, unicode=False)


# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------
@register("accuracy", f"""WITH {S.EV},
e AS (SELECT dataset, {S.norm_pred(S.to_regex('event_template'))} AS p, {S.norm_truth('event_template')} AS g FROM ev),
{S.accuracy_sql('e')}""")
def q_accuracy(spark, sf):
    ev = _events(spark, sf)
    parsed = mining.mine_templates(ev, EVENT_MASKS, depth=4)
    return acc.evaluate(parsed, corpora.event_labels(spark, sf))


@register("accuracy_depth1", f"""WITH {S.EV},
e AS (SELECT dataset, {S.norm_pred(S.to_regex("'" + _D1 + "'"))} AS p, {S.norm_truth('event_template')} AS g FROM ev),
{S.accuracy_sql('e')}""")
def q_accuracy_depth1(spark, sf):
    ev = _events(spark, sf)
    parsed = mining.mine_templates(ev, EVENT_MASKS, depth=1)
    return acc.evaluate(parsed, corpora.event_labels(spark, sf))


_MIXED_SQL = """CASE WHEN event_type IN ('click', 'view') THEN event_template
     WHEN event_type = 'error' AND user_id % 2 = 0 THEN event_template || ' even'
     WHEN event_type IN ('signup', 'purchase') THEN 'user <*> <*> value=<*> from <*> props {"k": <*>}'
     ELSE event_template END"""


@register("accuracy_mixed", f"""WITH {S.EV},
e AS (SELECT dataset, {S.norm_pred(S.to_regex(_MIXED_SQL))} AS p, {S.norm_truth('event_template')} AS g FROM ev),
{S.accuracy_sql('e')}""")
def q_accuracy_mixed(spark, sf):
    ev = _events(spark, sf)
    et = F.col("event_type")
    pred = (F.when(et.isin("click", "view"), F.col("event_template"))
            .when((et == "error") & (F.col("line_id").isNotNull()) & (F.col("content").contains(" ")) &
                  (F.split("content", " ").getItem(1).cast("long") % 2 == 0),
                  F.concat(F.col("event_template"), F.lit(" even")))
            .when(et.isin("signup", "purchase"), F.lit(_D1))
            .otherwise(F.col("event_template")))
    parsed = ev.select("dataset", "line_id", "content", pred.alias("template"))
    return acc.evaluate(parsed, corpora.event_labels(spark, sf))


# ---------------------------------------------------------------------------
# Template text and regex forms
# ---------------------------------------------------------------------------
from logweave.functions import templates as tf  # noqa: E402
from logweave.functions import matching as mf  # noqa: E402
from logweave.operators import pool as pl  # noqa: E402


def _urls(spark, sf):
    return corpora.page_urls(spark, sf)


@register("literal_template", f"WITH {S.DL} SELECT line_id, {S.escape('content')} AS template_regex FROM dl")
def q_literal_template(spark, sf):
    return _docs(spark, sf).select("line_id", tf.literal_template("content").alias("template_regex"))


@register("template_to_regex", f"""WITH {S.DL},
m AS (SELECT line_id, {S.pattern(S.masked('content'))} AS template FROM dl)
SELECT line_id, {S.to_regex('template', full=True)} AS template_regex FROM m""")
def q_template_to_regex(spark, sf):
    m = mining.masked_tokens(_docs(spark, sf), EVENT_MASKS, unicode=False)
    return m.select("line_id", tf.template_to_regex("pattern").alias("template_regex"))


@register("cap_wildcards", f"""WITH {S.DL},
m AS (SELECT line_id, replace(regexp_replace(content, '[^ ]+', '<*>', 'g'), '<*>', '(.*?)') AS r FROM dl)
SELECT line_id, {S.cap30('r')} AS template_regex FROM m""")
def q_cap_wildcards(spark, sf):
    r = F.replace(masking.mask_variables("content", ["[^ ]+"]), F.lit("<*>"), F.lit("(.*?)"))
    return _docs(spark, sf).select("line_id", tf.cap_wildcards(r).alias("template_regex"))


_URL_MASKS = ["https?", "[0-9]+", "[a-z]+\\.example"]
_URL_MASK_SQL = "(?:https?)|(?:[0-9]+)|(?:[a-z]+\\.example)"


def _url_templates(spark, sf):
    u = _urls(spark, sf)
    return u.select("dataset", "line_id", "content",
                    tf.template_to_regex(masking.mask_variables("content", _URL_MASKS)).alias("template_regex"))


_URL_TPL_SQL = f"""{S.PU},
ut AS (SELECT dataset, line_id, content,
       {S.to_regex(f"regexp_replace(content, '{_URL_MASK_SQL}', '<*>', 'g')", full=True)} AS template_regex FROM pu)"""


@register("clean_templates", f"""WITH {_URL_TPL_SQL},
{S.clean_steps('ut', 'template_regex')}
SELECT line_id, cleaned FROM c6""")
def q_clean_templates(spark, sf):
    return _url_templates(spark, sf).select("line_id", tf.clean_template("template_regex", unicode=False)
                                            .alias("cleaned"))


@register("clean_doc_templates", f"""WITH {S.DL},
m AS (SELECT line_id, {S.to_regex(S.pattern(S.masked('content')), full=True)} AS template_regex FROM dl),
{S.clean_steps('m', 'template_regex')}
SELECT line_id, cleaned FROM c6""")
def q_clean_doc_templates(spark, sf):
    m = mining.masked_tokens(_docs(spark, sf), EVENT_MASKS, unicode=False)
    return m.select("line_id", tf.clean_template(tf.template_to_regex("pattern"), unicode=False).alias("cleaned"))


@register("static_token_count", f"""WITH {_URL_TPL_SQL}
SELECT line_id, {S.static_tokens('template_regex')} AS static_tokens, {S.word_count('template_regex')} AS word_count
FROM ut""")
def q_static_token_count(spark, sf):
    t = _url_templates(spark, sf)
    return t.select("line_id", tf.static_token_count("template_regex", unicode=False).alias("static_tokens"),
                    tf.regex_word_count("template_regex").alias("word_count"))


#: Words become wildcards but for single letters, so that rules need several rounds.
_COLLAPSE_MASK = "[A-Za-z0-9]{2,}"


@register("collapse_wildcards", f"""WITH RECURSIVE {S.DL},
m AS (SELECT line_id, regexp_replace(replace(replace(regexp_replace(content, '[^\\x20-\\x7E]', 'x', 'g'), ' ', '-'), '.', '_'), '{_COLLAPSE_MASK}', '<*>', 'g') AS template FROM dl),
{S.collapsed('m')}
SELECT line_id, collapsed FROM m JOIN done USING (template)""")
def q_collapse_wildcards(spark, sf):
    from logweave.operators.templates import collapse_to_fixpoint
    text = F.translate(F.regexp_replace("content", r"[^\x20-\x7E]", "x"), " .", "-_")
    m = _docs(spark, sf).select("line_id", masking.mask_variables(text, [_COLLAPSE_MASK], unicode=False).alias("template"))
    return collapse_to_fixpoint(m, unicode=False).select("line_id", F.col("template").alias("collapsed"))


@register("fix_wildcards")
def q_fix_wildcards(spark, sf):
    return _docs(spark, sf).select("line_id", tf.fix_wildcards("content").alias("fixed"))


@register("regex_to_template", f"""WITH {_URL_TPL_SQL}
SELECT line_id, regexp_replace(replace(template_regex, '(.*?)', '<*>'), '\\\\(.)', '\\1', 'g') AS template FROM ut""")
def q_regex_to_template(spark, sf):
    return _url_templates(spark, sf).select("line_id", tf.regex_to_template("template_regex").alias("template"))


# ---------------------------------------------------------------------------
# Matchers, pool, matching join
# ---------------------------------------------------------------------------
_EV_RX = f"""{S.EV},
er AS (SELECT *, {S.to_regex('event_template', full=True)} AS own_regex,
       {S.to_regex("'user <*> click value=<*> from <*> props {\"k\": <*>}'", full=True)} AS click_regex FROM ev)"""


def _event_regex(spark, sf):
    ev = _events(spark, sf)
    click = F.lit('user <*> click value=<*> from <*> props {"k": <*>}')
    return ev.withColumn("own_regex", tf.template_to_regex("event_template")) \
        .withColumn("click_regex", tf.template_to_regex(click))


_LEN_EQ = "(length({0}) - length(replace({0}, '=', '')))"


def _strict_sql(c: str, r: str) -> str:
    cc, rr = f"replace({c}, ',', '')", f"replace({r}, ',', '')"
    eq_ok = f"{_LEN_EQ.format(rr)} = {_LEN_EQ.format(cc)}"
    return f"({eq_ok} AND regexp_full_match({cc}, {rr}))"


def _lenient_sql(c: str, r: str) -> str:
    return f"regexp_full_match(translate({c}, ',$', ''), translate({r}, ',$', ''))"


@register("match_lenient", f"""WITH {_EV_RX}
SELECT line_id, {_lenient_sql('content', 'own_regex')} AS m_own, {_lenient_sql('content', 'click_regex')} AS m_click
FROM er""")
def q_match_lenient(spark, sf):
    e = _event_regex(spark, sf)
    return e.select("line_id", mf.match_lenient("content", F.col("own_regex")).alias("m_own"),
                    mf.match_lenient("content", F.col("click_regex")).alias("m_click"))


@register("match_strict", f"""WITH {_EV_RX}
SELECT line_id, {_strict_sql('content', 'own_regex')} AS m_own, {_strict_sql('content', 'click_regex')} AS m_click
FROM er""")
def q_match_strict(spark, sf):
    e = _event_regex(spark, sf)
    return e.select("line_id", mf.match_strict("content", F.col("own_regex")).alias("m_own"),
                    mf.match_strict("content", F.col("click_regex")).alias("m_click"))


def _proposals(spark, sf):
    """Every event line proposes its label template (seq 2*id) and the
    all-types template (seq 2*id+1)."""
    e = _events(spark, sf)
    own = e.select("dataset", tf.template_to_regex("event_template").alias("template"),
                   (F.col("line_id") * 2).alias("seq"))
    gen = e.select("dataset", tf.template_to_regex(F.lit(_D1)).alias("template"),
                   (F.col("line_id") * 2 + 1).alias("seq"))
    return own.unionByName(gen)


_POOL_SQL = f"""{S.EV},
prop AS (SELECT dataset, {S.to_regex('event_template', full=True)} AS template, line_id * 2 AS seq FROM ev
         UNION ALL
         SELECT dataset, {S.to_regex("'" + _D1 + "'", full=True)} AS template, line_id * 2 + 1 AS seq FROM ev),
{S.clean_steps('prop', 'template', 'template_regex')},
pf AS (SELECT dataset, template_regex, min(seq) AS seq FROM c6 WHERE template_regex IS NOT NULL AND template_regex <> ''
       GROUP BY dataset, template_regex),
pool AS (SELECT *, {S.word_count('template_regex')} AS word_count, {S.static_tokens('template_regex')} AS static_tokens,
                {S.static_tokens('template_regex')} > 1 AS candidate FROM pf),
ranked AS (SELECT *, CASE WHEN candidate THEN row_number() OVER (PARTITION BY dataset, candidate
                  ORDER BY word_count DESC, seq) END AS rank FROM pool)"""


@register("template_pool", f"""WITH {_POOL_SQL}
SELECT dataset, template_regex, word_count, static_tokens, candidate, seq, rank FROM ranked""")
def q_template_pool(spark, sf):
    return pl.template_pool(_proposals(spark, sf)).drop("template_id")


@register("match_templates", f"""WITH {_POOL_SQL},
cand AS (SELECT e.dataset, e.line_id, r.template_regex, r.word_count, r.seq FROM ev e JOIN ranked r
         ON e.dataset = r.dataset AND r.candidate
         AND r.word_count <= len({S.tokens('e.content')}) AND {_strict_sql('e.content', 'r.template_regex')}),
best AS (SELECT *, row_number() OVER (PARTITION BY dataset, line_id ORDER BY word_count DESC, seq) AS rn FROM cand)
SELECT e.dataset, e.line_id, b.template_regex FROM ev e LEFT JOIN best b
  ON e.dataset = b.dataset AND e.line_id = b.line_id AND b.rn = 1""")
def q_match_templates(spark, sf):
    pool = pl.template_pool(_proposals(spark, sf))
    lines = _events(spark, sf).select("dataset", "line_id", "content")
    return pl.match_templates(lines, pool).select("dataset", "line_id", "template_regex")


@register("templates_in_band", f"""WITH {_POOL_SQL}, {S.DL},
lens AS (SELECT DISTINCT 'events' AS dataset, len({S.tokens('content')}) AS n_tokens FROM dl)
SELECT l.dataset, l.n_tokens, r.template_regex, r.word_count FROM lens l JOIN ranked r
  ON l.dataset = r.dataset AND r.candidate AND r.word_count BETWEEN l.n_tokens - 8 AND l.n_tokens + 1""")
def q_templates_in_band(spark, sf):
    pool = pl.template_pool(_proposals(spark, sf))
    lens = _docs(spark, sf).select(F.lit("events").alias("dataset"),
                                   F.size(text.tokenize("content", unicode=False)).alias("n_tokens")).distinct()
    return pl.templates_in_band(lens, pool).drop("template_id")


@register("unmatched", f"""WITH {_EV_RX}
SELECT dataset, line_id, content FROM er WHERE NOT {_lenient_sql('content', 'click_regex')}""")
def q_unmatched(spark, sf):
    e = _event_regex(spark, sf)
    matched = e.filter(mf.match_lenient("content", F.col("click_regex")))
    return pl.unmatched(e, matched).select("dataset", "line_id", "content")


@register("merge_templates", f"""WITH {S.DL},
pc AS (SELECT dataset, {S.pattern(S.masked('content'))} AS template, count(*) AS count, min(line_id) AS first_line
       FROM dl GROUP BY 1, 2),
nm AS (SELECT *, {S.norm_pred(S.to_regex('template', full=True))} AS normalised FROM pc)
SELECT dataset, normalised, sum(count) AS count, min(first_line) AS first_line, min(template) AS template
FROM nm GROUP BY dataset, normalised""")
def q_merge_templates(spark, sf):
    from logweave.functions.normalise import normalise_pred
    pc = mining.pattern_counts(_docs(spark, sf), EVENT_MASKS, unicode=False).select(
        "dataset", F.col("pattern").alias("template"), F.col("n").alias("count"), F.col("first_id").alias("first_line"))
    nm = pc.withColumn("normalised", normalise_pred(tf.template_to_regex("template")))
    return pl.merge_templates(nm)


# ---------------------------------------------------------------------------
# Sampling, ordering, verification, the parse loop
# ---------------------------------------------------------------------------
from logweave.operators import sampling as smp  # noqa: E402
from logweave.operators import verify as vf  # noqa: E402

_MD5_ORDER = "md5(CAST(line_id AS VARCHAR) || ':0')"


@register("group_cap", f"""WITH {S.EV},
r AS (SELECT event_type, line_id, {_MD5_ORDER} AS sample_order,
      row_number() OVER (PARTITION BY event_type ORDER BY {_MD5_ORDER}) AS rn FROM ev)
SELECT event_type, line_id, sample_order FROM r WHERE rn <= 100""")
def q_group_cap(spark, sf):
    ev = _events(spark, sf).select("event_type", "line_id")
    return smp.group_cap(ev, ["event_type"], 100, smp.hash_order(0))


@register("group_order", f"""WITH {S.EV},
g AS (SELECT dataset, substr(md5(event_template), 1, 8) AS event_id, min(line_id) AS first_line FROM ev GROUP BY 1, 2),
f AS (SELECT g.*, len({S.tokens('e.content')}) AS first_words FROM g JOIN ev e ON e.line_id = g.first_line)
SELECT dataset, event_id, first_line, first_words,
       row_number() OVER (PARTITION BY dataset ORDER BY first_words, event_id) AS group_rank FROM f""")
def q_group_order(spark, sf):
    g = mining.mine_templates(_events(spark, sf), EVENT_MASKS, depth=4)
    return smp.group_order(g, "event_id")


@register("longest_line", f"""WITH {S.DL},
r AS (SELECT dataset, doc_id, line_id, content,
      row_number() OVER (PARTITION BY dataset, doc_id ORDER BY len({S.tokens('content')}) DESC, line_id) AS rn FROM dl)
SELECT dataset, doc_id, line_id, content FROM r WHERE rn = 1""")
def q_longest_line(spark, sf):
    return smp.longest_line(_docs(spark, sf), "doc_id", unicode=False)


@register("spaced_rows", f"""WITH {S.DL},
r AS (SELECT lang, line_id, row_number() OVER (PARTITION BY lang ORDER BY line_id) - 1 AS idx,
      count(*) OVER (PARTITION BY lang) AS group_rows FROM dl),
s AS (SELECT *, greatest(1, group_rows // 1000) AS step FROM r)
SELECT lang, line_id, idx AS row_index, group_rows FROM s
WHERE (idx % step = 0 AND idx // step < least(1000, group_rows)) OR idx = group_rows - 1""")
def q_spaced_rows(spark, sf):
    d = _docs(spark, sf).select("lang", "line_id")
    return smp.spaced_rows(d, ["lang"], "line_id", 1000).select("lang", "line_id", "row_index", "group_rows")


def _centre_words(col: str) -> str:
    return (f"list_distinct(list_filter(regexp_split_to_array(regexp_replace({col}, '\\.{{2,}}', '...', 'g'), "
            f"'\\s+'), lambda w: w <> ''))")


@register("centre_sample", f"""WITH {S.EV},
sz AS (SELECT event_type, count(*) AS group_rows FROM ev GROUP BY 1),
c AS (SELECT event_type, line_id, content, row_number() OVER (PARTITION BY event_type ORDER BY {_MD5_ORDER}) - 1 AS pos
      FROM ev QUALIFY pos < 500),
cz AS (SELECT c.*, sz.group_rows, least(sz.group_rows, 500) AS n_capped FROM c JOIN sz USING (event_type)),
ctr AS (SELECT event_type, {_centre_words('content')} AS cw FROM cz WHERE pos = n_capped // 2),
sc AS (SELECT cz.*, {_centre_words('content')} AS w, ctr.cw FROM cz JOIN ctr USING (event_type)
       WHERE trim(content) <> ''),
sm AS (SELECT *, CASE WHEN len(list_distinct(list_concat(w, cw))) = 0 THEN 0.0
       ELSE len(list_intersect(w, cw)) / len(list_distinct(list_concat(w, cw))) END AS sim FROM sc),
k AS (SELECT *, CASE WHEN sim > 0.99 THEN 2 WHEN sim >= 0.3 THEN 1 END AS kind FROM sm),
p AS (SELECT event_type, line_id, content, group_rows, row_number() OVER (PARTITION BY event_type
      ORDER BY kind, md5(CAST(line_id AS VARCHAR) || ':0:shuffle')) AS sample_rank FROM k WHERE kind IS NOT NULL)
SELECT event_type, line_id, content, sample_rank FROM p WHERE sample_rank <= 30 AND group_rows > 30""")
def q_centre_sample(spark, sf):
    ev = _events(spark, sf).select("event_type", "line_id", "content")
    return smp.centre_sample(ev, k=30, min_threshold=0.3, cap=500, group_cols=["event_type"])


@register("diverse_sample")
def q_diverse_sample(spark, sf):
    ev = _events(spark, sf).select("event_type", "line_id", "content")
    return smp.diverse_sample(ev, k=5, group_cols=["event_type"])


@register("static_groups", f"""WITH {S.DL},
g AS (SELECT dataset, {S.pattern(S.masked('content'))} AS event_id, count(DISTINCT content) AS n_distinct,
      min(content) AS content FROM dl GROUP BY 1, 2)
SELECT dataset, event_id, content, {S.escape('content')} AS template_regex FROM g
WHERE n_distinct = 1 AND NOT (contains(content, ' is ') OR contains(content, '=') OR contains(content, ' to ')
  OR contains(content, '_') OR contains(content, '-') OR contains(content, ':') OR contains(content, '.')
  OR regexp_matches(content, '[0-9]'))""")
def q_static_groups(spark, sf):
    m = mining.masked_tokens(_docs(spark, sf), EVENT_MASKS, unicode=False) \
        .select("dataset", "line_id", "content", F.col("pattern").alias("event_id"))
    return vf.static_groups(m, "event_id")


_PROPOSE_SQL = """CASE WHEN event_type = 'error' THEN 'user <*> error value=6.55 from <*> props {"k": <*>}'
  ELSE 'user <*> ' || event_type || ' value=<*> from 10.0.1<*> props {"k": <*>}' END"""


def _event_proposals(spark, sf):
    ev = _events(spark, sf)
    t = F.when(F.col("event_type") == "error", F.lit('user <*> error value=6.55 from <*> props {"k": <*>}')) \
        .otherwise(F.concat(F.lit("user <*> "), F.col("event_type"), F.lit(' value=<*> from 10.0.1<*> props {"k": <*>}')))
    return ev.select("dataset", F.col("event_type").alias("group_key"), t.alias("template")).distinct() \
        .withColumn("template_regex", tf.template_to_regex("template")).drop("template")


@register("verify_templates", f"""WITH {S.EV},
pr AS (SELECT DISTINCT dataset, event_type, {S.to_regex(_PROPOSE_SQL, full=True)} AS template_regex FROM ev),
hc AS (SELECT *, (contains(template_regex, '=') OR contains(template_regex, ':'))
       AND regexp_matches(replace(replace(template_regex, '(.*?)', '<VAR>'), '\\', ''),
                          '\\b(\\w+)\\s*=\\s*([\\w./:-]+)') AS hardcoded FROM pr)
SELECT e.dataset, e.event_type AS group_key, e.line_id,
       (NOT hc.hardcoded AND {_lenient_sql('e.content', 'hc.template_regex')}) AS matched
FROM ev e JOIN hc ON e.dataset = hc.dataset AND e.event_type = hc.event_type""")
def q_verify_templates(spark, sf):
    rows = _events(spark, sf).select("dataset", F.col("event_type").alias("group_key"), "line_id", "content")
    return vf.verify_templates(rows, _event_proposals(spark, sf)).select("dataset", "group_key", "line_id", "matched")


@register("parse_logs", f"""WITH {S.EV},
r AS (SELECT *, {S.to_regex('event_template', full=True)} AS template_regex FROM ev)
SELECT dataset, line_id, substr(md5(template_regex), 1, 8) AS event_id, template_regex,
       true AS verified, 'round0' AS source FROM r""")
def q_parse_logs(spark, sf):
    g = mining.mine_templates(_events(spark, sf), EVENT_MASKS, depth=4)
    return vf.parse_logs(g, EVENT_MASKS).select("dataset", "line_id", "event_id", "template_regex",
                                                "verified", "source")


@register("parse_doc_lines")
def q_parse_doc_lines(spark, sf):
    g = mining.mine_templates(_docs(spark, sf), [r"[0-9]+"], depth=3)
    return vf.parse_logs(g, [r"[0-9]+"]).select("dataset", "line_id", "event_id", "template_regex",
                                                "verified", "source")


# ---------------------------------------------------------------------------
# Raw logs, ids, windows, writers' logic, summary
# ---------------------------------------------------------------------------
from logweave.sources import logs as lg  # noqa: E402
from logweave.sources import sinks as sk  # noqa: E402

RAW_FORMAT = r"<Seq> <Level> \[<Component>\]: <Content>"


def _raw_event_lines(spark, sf):
    ev = _events(spark, sf)
    comp = F.when(F.col("event_type") == "error", F.lit("")) \
        .otherwise(F.concat(F.lit("[u"), (F.col("line_id") % 7).cast("string"), F.lit("]")))
    line = F.concat(F.lpad(F.col("line_id").cast("string"), 8, "0"), F.lit("  "), F.upper("event_type"),
                    F.lit(" "), comp, F.lit(": "), F.col("content"))
    return ev.select("line_id", line.alias("line"))


_RAW_SQL = f"""{S.EV},
raw AS (SELECT line_id, lpad(CAST(line_id AS VARCHAR), 8, '0') || '  ' || upper(event_type) || ' ' ||
        CASE WHEN event_type = 'error' THEN '' ELSE '[u' || CAST(line_id % 7 AS VARCHAR) || ']' END || ': ' || content
        AS line FROM ev)"""
_RAW_RX = r"^(.*?)\s+(.*?)\s+\[(.*?)\]:\s+(.*?)$"


@register("parse_raw_logs", f"""WITH {_RAW_SQL}
SELECT 'events' AS dataset, line_id, regexp_extract(line, '{_RAW_RX}', 1) AS Seq,
       regexp_extract(line, '{_RAW_RX}', 2) AS Level, regexp_extract(line, '{_RAW_RX}', 3) AS Component,
       regexp_extract(line, '{_RAW_RX}', 4) AS content
FROM raw WHERE regexp_full_match(line, '{_RAW_RX}')""")
def q_parse_raw_logs(spark, sf):
    parsed, _ = lg.parse_raw_lines(_raw_event_lines(spark, sf), RAW_FORMAT, "events")
    return parsed


@register("parse_linux_logs", f"""WITH {S.EV}
SELECT 'Linux' AS dataset, row_number() OVER (ORDER BY line_id) AS line_id, 'Jun' AS Month, CAST(1 + line_id % 28 AS VARCHAR) AS "Date", '10:00:00' AS "Time",
       'combo' AS Level, event_type AS Component, CASE WHEN line_id % 3 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS PID, content FROM ev""")
def q_parse_linux_logs(spark, sf):
    """Event lines in the format with an optional ``[PID]``, written as text files and parsed from them."""
    from logweave.sources.profiles import PROFILES
    ev = _events(spark, sf)
    pid = F.when(F.col("line_id") % 3 == 0, "").otherwise(F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")))
    line = F.concat(F.lit("Jun "), (F.col("line_id") % 28 + 1).cast("string"), F.lit(" 10:00:00 combo "), "event_type", pid, F.lit(": "), "content")
    path = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    ev.select("line_id", line.alias("value")).repartitionByRange("line_id").sortWithinPartitions("line_id").select("value").write.text(path)
    log_format = next(f for d, f, *_ in PROFILES if d == "Linux")
    return lg.parse_raw_logs(spark, path, log_format, "Linux")[0]


@register("raw_rejects", f"""WITH {_RAW_SQL}
SELECT line_id, line FROM raw WHERE NOT regexp_full_match(line, '{_RAW_RX}')""")
def q_raw_rejects(spark, sf):
    _, rejected = lg.parse_raw_lines(_raw_event_lines(spark, sf), RAW_FORMAT, "events")
    return rejected


@register("line_ids", f"""WITH {S.DL}
SELECT row_number() OVER (ORDER BY line_id) AS dense_id, line_id FROM dl""")
def q_line_ids(spark, sf):
    d = _docs(spark, sf).select("line_id")
    return lg.dense_line_ids(d, start=1, order_col="line_id", id_col="dense_id").select("dense_id", "line_id")


@register("line_window", f"""WITH {S.EV},
n AS (SELECT count(*) AS total FROM ev),
b AS (SELECT CAST(floor(total * 10 / 100) AS BIGINT) AS s,
             least(CAST(floor((total - floor(total * 10 / 100)) * 50 / 100) AS BIGINT), 3000) AS r, total FROM n),
d AS (SELECT row_number() OVER (ORDER BY line_id) AS dense_id, line_id FROM ev)
SELECT d.dense_id, d.line_id FROM d, b WHERE d.dense_id >= b.s + 1 AND d.dense_id < least(b.s + b.r, b.total) + 1""")
def q_line_window(spark, sf):
    d = lg.dense_line_ids(_events(spark, sf).select("line_id"), start=1, order_col="line_id", id_col="dense_id")
    return lg.line_window(d, start_line_percent=10, first_lines_percent=50, max_lines=3000, id_col="dense_id") \
        .select("dense_id", "line_id")


@register("read_labels", f"WITH {S.EV} SELECT dataset, line_id, content, event_template FROM ev")
def q_read_labels(spark, sf):
    return lg.read_labels(spark, _event_csv(spark, sf), "events")


@register("valid_results", f"""WITH {S.EV},
r AS (SELECT CASE WHEN event_type = 'error' THEN 'x' || CAST(line_id AS VARCHAR) ELSE CAST(line_id AS VARCHAR) END
      AS line_id, content FROM ev)
SELECT try_cast(line_id AS BIGINT) AS line_id, content FROM r WHERE try_cast(line_id AS BIGINT) IS NOT NULL""")
def q_valid_results(spark, sf):
    ev = _events(spark, sf)
    sid = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("line_id").cast("string"))) \
        .otherwise(F.col("line_id").cast("string"))
    return sk.valid_results(ev.select(sid.alias("line_id"), "content"))


@register("dedup_count", f"""WITH {S.DL}
SELECT dataset, content, count(*) AS count FROM dl GROUP BY dataset, content""")
def q_dedup_count(spark, sf):
    return sk.dedup_count(_docs(spark, sf).select("dataset", "content"))


@register("append_counted", f"""WITH {S.EV}
SELECT event_type, user_id, count(*) AS count FROM ev GROUP BY event_type, user_id""")
def q_append_counted(spark, sf):
    """Two appends, one made twice as a repeated job would."""
    ev = _events(spark, sf).select("event_type", "user_id")
    path = f"{shared_folder(spark).rstrip('/')}/counted-{uuid.uuid4().hex}"
    seen = F.col("event_type").isin("click", "view")
    for write, rows in (("seen", seen), ("rest", ~F.coalesce(seen, F.lit(False))), ("seen", seen)):
        sk.append_counted(ev.filter(rows), path, write)
    return sk.read_counted(spark, path)


_ORDER = ["view", "click", "error", "signup", "purchase"]


@register("summary_upsert", f"""WITH {S.EV},
old AS (SELECT event_type AS "Dataset", count(*) AS "Lines", 1 AS seq FROM ev GROUP BY 1),
new AS (SELECT event_type AS "Dataset", count(DISTINCT user_id) AS "Lines", 2 AS seq FROM ev
        WHERE event_type IN ('click', 'view') GROUP BY 1),
u AS (SELECT * FROM old UNION ALL SELECT * FROM new),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY "Dataset" ORDER BY seq DESC) = 1)
SELECT "Dataset", "Lines", seq FROM l""")
def q_summary_upsert(spark, sf):
    ev = _events(spark, sf)
    old = ev.groupBy(F.col("event_type").alias("Dataset")).agg(F.count(F.lit(1)).alias("Lines")) \
        .withColumn("seq", F.lit(1))
    new = ev.filter(F.col("event_type").isin("click", "view")).groupBy(F.col("event_type").alias("Dataset")) \
        .agg(F.count_distinct("user_id").alias("Lines")).withColumn("seq", F.lit(2))
    return sk.summary_upsert(old, new, _ORDER)


def _profile_masks_sql() -> str:
    """A line is changed where a mask matches it.  DuckDB's patterns know no look-behind and read ``\\w``, ``\\d`` and
    ``\\b`` as ASCII, so these are written out; whether a line matches is the same when the neighbour is consumed."""
    from logweave.sources.profiles import PROFILES
    rows = []
    for name, _, masks, _, _ in PROFILES:
        any_of = masking.combined_mask_pattern(masks, unicode=False).replace(r"((?<=\s)|(?<=^))", r"(?:^|\s)")
        any_of = any_of.replace(r"\b", r"(?:^|$|[^\w])").replace(r"\w", r"\p{L}\p{M}\p{Nd}_").replace(r"\d", r"\p{Nd}").replace("'", "''")
        rows.append(f"SELECT '{name}' AS profile, count(*) FILTER (WHERE regexp_matches(content, '{any_of}')) AS changed FROM dl")
    return f"WITH {S.DL} " + " UNION ALL ".join(rows)


@register("profile_masks", _profile_masks_sql())
def q_profile_masks(spark, sf):
    from logweave.sources.profiles import PROFILES
    return mining.profile_changes(_docs(spark, sf).select("content"), [(name, masks) for name, _, masks, _, _ in PROFILES])


# ---------------------------------------------------------------------------
# Set operations, grouping helpers, parameters
# ---------------------------------------------------------------------------
@register("union_all", f"""WITH {S.EV}, {S.DL}
SELECT dataset, line_id, content FROM ev UNION ALL SELECT dataset, line_id, content FROM dl""")
def q_union_all(spark, sf):
    return _events(spark, sf).select("dataset", "line_id", "content").unionByName(
        _docs(spark, sf).select("dataset", "line_id", "content"))


@register("distinct_templates", f"""WITH {S.DL}
SELECT DISTINCT {S.pattern(S.masked('content'))} AS template FROM dl""")
def q_distinct_templates(spark, sf):
    m = mining.masked_tokens(_docs(spark, sf), EVENT_MASKS, unicode=False)
    return m.select(F.col("pattern").alias("template")).distinct()


@register("common_tokens", f"""WITH {S.EV},
t AS (SELECT DISTINCT event_type, line_id, unnest({S.tokens('content')}) AS token FROM ev),
n AS (SELECT event_type, count(*) AS n_lines FROM ev GROUP BY 1)
SELECT t.event_type, token FROM t JOIN n USING (event_type) GROUP BY t.event_type, token, n.n_lines
HAVING count(*) = n.n_lines""")
def q_common_tokens(spark, sf):
    from logweave.operators import setops
    ev = _events(spark, sf).select("event_type", "line_id", "content")
    return setops.common_tokens(ev, ["event_type"])


@register("intersect_ids", f"""WITH {S.EV}, {S.DL}
SELECT line_id FROM ev INTERSECT SELECT line_id FROM dl""")
def q_intersect_ids(spark, sf):
    return _events(spark, sf).select("line_id").intersect(_docs(spark, sf).select("line_id"))


@register("small_groups", f"""WITH {S.DL},
g AS (SELECT dataset, {S.pattern(S.masked('content'))} AS event_id, line_id FROM dl),
c AS (SELECT dataset, event_id, count(*) AS group_rows FROM g GROUP BY 1, 2)
SELECT g.dataset, g.event_id, g.line_id, c.group_rows < 5 AS small FROM g JOIN c USING (dataset, event_id)""")
def q_small_groups(spark, sf):
    from logweave.operators import setops
    m = mining.masked_tokens(_docs(spark, sf), EVENT_MASKS, unicode=False) \
        .select("dataset", F.col("pattern").alias("event_id"), "line_id")
    return setops.flag_small_groups(m, "event_id", 5).select("dataset", "event_id", "line_id", "small")


@register("extract_parameters", f"""WITH {S.EV}
SELECT line_id, CAST(user_id AS VARCHAR) || '|' || CAST(CAST(regexp_extract(content, 'value=([0-9.]+)', 1) AS VARCHAR)
       AS VARCHAR) || '|' || regexp_extract(content, 'from ([0-9.]+)', 1) || '|' ||
       regexp_extract(content, '"k": ([0-9]+)', 1) AS params FROM ev""")
def q_extract_parameters(spark, sf):
    from logweave.operators import setops
    ev = _events(spark, sf)
    p = setops.extract_parameters(ev, "content", "event_template")
    return p.select("line_id", F.array_join("parameters", "|").alias("params"))


# ---------------------------------------------------------------------------
# Lints, normalisers, prompt rows
# ---------------------------------------------------------------------------
from logweave.functions import lints as lt  # noqa: E402
from logweave.functions import normalise as nz  # noqa: E402
from logweave.operators import lint as lop  # noqa: E402

_KV = r"\b(\w+)\s*=\s*([\w./:-]+)"
_PATH_TRIGGER = lt.PATH_TRIGGER.replace("'", "''")


@register("kv_pairs", f"""WITH {S.PU}
SELECT line_id, array_to_string(list_transform(list_filter(list_zip(regexp_extract_all(content, '{_KV}', 1),
       regexp_extract_all(content, '{_KV}', 2)), lambda p: NOT regexp_full_match(p[1], '[0-9]+')),
       lambda p: p[1] || '=' || p[2]), ',') AS kv FROM pu""")
def q_kv_pairs(spark, sf):
    return _urls(spark, sf).select("line_id", F.array_join(lt.kv_pairs("content"), ",").alias("kv"))


@register("has_path", f"""WITH {S.DL}
SELECT line_id, regexp_matches(content, '{_PATH_TRIGGER}') AS has_path FROM dl""")
def q_has_path(spark, sf):
    return _docs(spark, sf).select("line_id", lt.has_path("content").alias("has_path"))


@register("lint_hardcoded", f"""WITH {_URL_TPL_SQL},
v AS (SELECT line_id, replace(replace(template_regex, '(.*?)', '<VAR>'), '\\', '') AS t FROM ut)
SELECT line_id, array_to_string(list_transform(list_filter(list_zip(regexp_extract_all(t, '{_KV}', 1),
       regexp_extract_all(t, '{_KV}', 2)), lambda p: NOT regexp_full_match(p[1], '[0-9]+') AND p[2] <> '<VAR>'),
       lambda p: p[1] || '=' || p[2]), ',') AS hardcoded FROM v""")
def q_lint_hardcoded(spark, sf):
    return _url_templates(spark, sf).select("line_id", F.array_join(lt.hardcoded_params("template_regex"), ",")
                                            .alias("hardcoded"))


def _foreign_sql(log: str, rx: str) -> str:
    text = f"replace(replace(replace(replace({rx}, '(.*?)', '<*>'), '<*>', ' '), '\\.', '.'), '\\-', '-')"
    strip = "regexp_replace(w, '^[.,=:]+|[.,=:]+$', '', 'g')"
    cond = (f"NOT regexp_full_match(w, '[0-9]+') AND w <> '...' AND NOT contains(lower({log}), lower(w)) "
            f"AND length({strip}) > 2 AND NOT contains(lower({log}), lower({strip}))")
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all({text}, '([a-zA-Z0-9_\\-\\.]{{3,}})', 1), "
            f"lambda w: {cond})))")


@register("lint_foreign_words", f"""WITH {_EV_RX}
SELECT line_id, array_to_string({_foreign_sql('content', 'click_regex')}, ',') AS foreign_words FROM er""")
def q_lint_foreign_words(spark, sf):
    e = _event_regex(spark, sf)
    return e.select("line_id", F.array_join(lt.foreign_words("content", "click_regex"), ",").alias("foreign_words"))


_UNTREATED_SQL = """list_sort(list_distinct(list_filter(regexp_extract_all(content, '((?:https?://|www\\.|/)[a-zA-Z0-9._/+-]+)', 1),
  lambda p: length(p) >= 3 AND NOT contains(t, p) AND len(list_filter(string_split(p, '/'), lambda part:
    length(part) >= 2 AND (contains(t, part) OR (contains(part, '-') AND length(string_split(part, '-')[-1]) > 0
      AND contains(t, '-' || string_split(part, '-')[-1]))))) > 0)))"""


@register("lint_paths", f"""WITH {_URL_TPL_SQL},
v AS (SELECT line_id, content, replace(replace(replace(template_regex, '(.*?)', '<*>'), '\\-', '-'), '\\.', '.') AS t
      FROM ut)
SELECT line_id, CASE WHEN regexp_matches(content, '{_PATH_TRIGGER}') THEN array_to_string({_UNTREATED_SQL}, ',')
       ELSE '' END AS untreated FROM v""")
def q_lint_paths(spark, sf):
    return _url_templates(spark, sf).select(
        "line_id", F.array_join(lt.untreated_paths("content", "template_regex"), ",").alias("untreated"))


@register("lint_coverage")
def q_lint_coverage(spark, sf):
    e = _event_regex(spark, sf)
    part = F.regexp_replace(F.col("click_regex"), r"^user \(\.\*\?\) ", "")
    return e.select("line_id", F.array_join(lt.coverage_issues("content", part), " | ").alias("issues"))


@register("lint_report")
def q_lint_report(spark, sf):
    return lop.lint_report(_url_templates(spark, sf).select("dataset", "line_id", "content", "template_regex"))


@register("prompt_table")
def q_prompt_table(spark, sf):
    g = mining.mine_templates(_events(spark, sf), EVENT_MASKS, depth=1)
    return lop.prompt_table(g, sample_size=5)


@register("norm_truth", f"""WITH {S.EV} SELECT DISTINCT event_template, {S.norm_truth('event_template')} AS normalised FROM ev""")
def q_norm_truth(spark, sf):
    return _events(spark, sf).select("event_template").distinct() \
        .withColumn("normalised", nz.normalise_truth("event_template"))


@register("norm_pred", f"""WITH {_URL_TPL_SQL} SELECT line_id, {S.norm_pred('template_regex')} AS normalised FROM ut""")
def q_norm_pred(spark, sf):
    return _url_templates(spark, sf).select("line_id", nz.normalise_pred("template_regex").alias("normalised"))


@register("normalise_ellipsis", f"""WITH {S.DL}
SELECT line_id, regexp_replace(content, '\\.{{2,}}', '...', 'g') AS normalised FROM dl""")
def q_normalise_ellipsis(spark, sf):
    return _docs(spark, sf).select("line_id", nz.normalise_ellipsis("content").alias("normalised"))


_UNIT_SQL = """ul AS (SELECT l_linestatus AS grp, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS line_id,
  'flushed ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' ' ||
  CASE l_returnflag WHEN 'A' THEN 'KB' WHEN 'N' THEN 'MB' ELSE 'GB' END || ' done' AS content FROM lineitem)"""


@register("dynamic_units", f"""WITH {_UNIT_SQL},
u AS (SELECT grp, regexp_extract(content, '([a-zA-Z]{{3,}})[^a-zA-Z]*?[0-9]+(?:\\.[0-9]+)?\\s+([A-Z]{{1,2}})\\b', 1) AS anchor,
      regexp_extract(content, '([a-zA-Z]{{3,}})[^a-zA-Z]*?[0-9]+(?:\\.[0-9]+)?\\s+([A-Z]{{1,2}})\\b', 2) AS unit FROM ul)
SELECT grp, anchor, count(DISTINCT unit) > 1 AS dynamic FROM u WHERE unit <> '' GROUP BY grp, anchor""")
def q_dynamic_units(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    unit = F.when(F.col("l_returnflag") == "A", "KB").when(F.col("l_returnflag") == "N", "MB").otherwise("GB")
    lines = li.select(F.col("l_linestatus").alias("grp"),
                      (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("line_id"),
                      F.concat(F.lit("flushed "), F.col("l_quantity").cast("long").cast("string"), F.lit(" "),
                               unit, F.lit(" done")).alias("content"))
    return lop.dynamic_units(lines, ["grp"]).select("grp", "anchor", "dynamic")


@register("leading_units", """WITH u AS (SELECT l_linestatus || CAST(l_linenumber AS VARCHAR) AS grp, CASE WHEN l_returnflag = 'A' OR l_linenumber = 1 THEN 'KB'
  WHEN l_returnflag = 'N' THEN 'MB' ELSE 'GB' END AS unit FROM lineitem)
SELECT grp, count(DISTINCT unit) AS units, count(DISTINCT unit) > 1 AS dynamic FROM u GROUP BY grp""")
def q_leading_units(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    unit = F.when((F.col("l_returnflag") == "A") | (F.col("l_linenumber") == 1), "KB").when(F.col("l_returnflag") == "N", "MB").otherwise("GB")
    content = F.concat(F.format_number("l_extendedprice", 2), F.lit(" "), unit, F.lit(" in "), F.col("l_quantity").cast("long").cast("string"), F.lit(" MB parts"))
    return lop.leading_units(li.select(F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("grp"), content.alias("content")), ["grp"])


# ---------------------------------------------------------------------------
# Splitting and markers
# ---------------------------------------------------------------------------
from logweave.operators import splitting as spl  # noqa: E402


@register("context_signature", f"""WITH {S.EV}
SELECT line_id, array_to_string(regexp_extract_all(replace(content, event_type, ' '), '\\b[a-zA-Z]{{2,}}\\b'), ' ')
       AS signature FROM ev""")
def q_context_signature(spark, sf):
    ev = _events(spark, sf)
    return ev.select("line_id", spl.context_signature("content", "event_type").alias("signature"))


@register("top_branches", f"""WITH {S.DL},
k AS (SELECT lang, line_id, coalesce({S.tokens('content')}[1], '') AS key FROM dl),
s AS (SELECT lang, key, count(*) AS n FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, key) AS rk,
      count(*) OVER (PARTITION BY lang) AS keys FROM s)
SELECT k.lang, k.line_id, CASE WHEN r.keys > 4 AND r.rk > 4 THEN '<OTHER_BRANCHES>' ELSE k.key END AS key
FROM k JOIN r USING (lang, key)""")
def q_top_branches(spark, sf):
    d = _docs(spark, sf).select("lang", "line_id", F.coalesce(F.try_element_at(text.tokenize("content", False), F.lit(1)),
                                                              F.lit("")).alias("key"))
    return spl.top_branches(d, ["lang"], "key").select("lang", "line_id", "key")


@register("signature_counts", f"""WITH {S.EV},
r AS (SELECT event_type AS key, arg_min(content, line_id) AS content FROM ev GROUP BY 1),
s AS (SELECT key, array_to_string(regexp_extract_all(replace(content, key, ' '), '\\b[a-zA-Z]{{2,}}\\b'), ' ')
      AS signature FROM r)
SELECT key, signature, count(*) OVER (PARTITION BY signature) AS signature_count FROM s""")
def q_signature_counts(spark, sf):
    ev = _events(spark, sf)
    reps = ev.groupBy(F.lit("events").alias("dataset"), F.col("event_type").alias("key")).agg(
        F.min_by("content", "line_id").alias("content"))
    return spl.signature_counts(reps, ["dataset"]).select("key", "signature", "signature_count")


@register("partial_context", f"""WITH {S.EV}
SELECT DISTINCT dataset, event_type || 'ed' AS key FROM ev""")
def q_partial_context(spark, sf):
    ev = _events(spark, sf)
    lines = ev.select("dataset", "line_id", "event_type", F.concat(
        F.lit("request "), F.col("event_type"), F.lit("ed for user "), F.col("user_id").cast("string")).alias("content"))
    reps = lines.groupBy("dataset", F.concat(F.col("event_type"), F.lit("ed")).alias("key")).agg(
        F.min_by("content", "line_id").alias("content"))
    return spl.partial_context(reps, ["dataset"])


def _ed_lines(spark, sf):
    ev = _events(spark, sf)
    return ev.select("dataset", F.lit("g").alias("event_id"), "line_id",
                     F.concat(F.lit("request "), F.col("event_type"), F.lit("ed for user "),
                              F.col("user_id").cast("string")).alias("content"))


@register("split_groups", f"""WITH {S.EV}
SELECT dataset, 'g' AS event_id, line_id, 'b' AS split_rule, event_type || 'ed' AS split_key,
       'g|' || event_type || 'ed' AS new_group FROM ev""")
def q_split_groups(spark, sf):
    return spl.split_groups(_ed_lines(spark, sf), "event_id").drop("content")


@register("split_mined_groups")
def q_split_mined_groups(spark, sf):
    g = mining.mine_templates(_events(spark, sf), EVENT_MASKS, depth=1)
    return spl.split_groups(g.select("dataset", "event_id", "line_id", "content"), "event_id").drop("content")


@register("token_features")
def q_token_features(spark, sf):
    return spl.token_features(_events(spark, sf).select("event_type", "line_id", "content"), ["event_type"])


from logweave.operators import evidence as evd  # noqa: E402

# Marker words of a line, as DuckDB states them.
_MARKERS = "list_filter(regexp_split_to_array({}, '[\\s=:;,()\\[\\]{{}}+/\"'']+'), lambda t: t <> '')"
# Three words in turning order behind an event line: every line holds them, in columns that vary.
_TURNS = "CASE event_id % 3 WHEN 0 THEN 'red green blue' WHEN 1 THEN 'green blue red' ELSE 'blue red green' END"
_SCORED = f"""
w AS (SELECT event_type, line_id, {_MARKERS.format('content')} AS words FROM lines),
p AS (SELECT event_type, line_id, token, list_position(words, token) AS place FROM (SELECT *, unnest(list_distinct(words)) AS token FROM w)),
n AS (SELECT event_type, token, count(*) AS lines_with FROM p GROUP BY 1, 2),
top AS (SELECT event_type, token, max(c) AS c FROM (SELECT event_type, token, place, count(*) AS c FROM p GROUP BY ALL) GROUP BY 1, 2),
e AS (SELECT token, sum(lines_with)::BIGINT AS corpus_lines FROM n GROUP BY 1),
sc AS (SELECT n.event_type, n.token, n.lines_with, round(top.c / n.lines_with, 6) AS stability, e.corpus_lines,
  round(top.c / n.lines_with * (ln(e.corpus_lines + 1.0) / ln((SELECT count(*) FROM lines) + 1.0)), 6) AS score
  FROM n JOIN top USING (event_type, token) JOIN e USING (token)),
u AS (
  SELECT DISTINCT event_type, token FROM (
    SELECT event_type, pos, token, count(DISTINCT token) OVER (PARTITION BY event_type, pos) AS vals FROM (
      SELECT event_type, unnest(words) AS token, unnest(range(len(words))) AS pos FROM w JOIN (
        SELECT event_type, arg_min(len(words), line_id) AS first_len FROM w GROUP BY 1) f USING (event_type)
      WHERE first_len > 7 AND len(words) = first_len)) WHERE vals > 2)"""


def _turning_lines(spark, sf):
    ev = _events(spark, sf)
    turn = F.col("line_id") % 3
    return ev.select("dataset", "event_type", "line_id", F.concat("content", F.lit(" "), F.when(turn == 0, "red green blue").when(turn == 1, "green blue red")
                                                                   .otherwise("blue red green")).alias("content"))


_TURNING = f"""WITH {S.EV}, lines AS (SELECT event_type, line_id, content || ' ' || {_TURNS.replace('event_id', 'line_id')} AS content FROM ev),{_SCORED}"""


@register("token_scores", f"""{_TURNING}
SELECT event_type, token, lines_with, stability, corpus_lines, score FROM sc""")
def q_token_scores(spark, sf):
    return evd.token_scores(_turning_lines(spark, sf), ["event_type"])


@register("unstable_tokens", f"""{_TURNING}
SELECT event_type, token FROM u""")
def q_unstable_tokens(spark, sf):
    return evd.unstable_tokens(_turning_lines(spark, sf), ["event_type"])


@register("static_markers", f"""{_TURNING}
SELECT 'events' AS dataset, event_type, token, t AS threshold, score FROM (
  SELECT sc.*, CASE WHEN token IN ('user', 'from') THEN 0.001::DOUBLE ELSE 0.1::DOUBLE END AS t FROM sc
  JOIN (SELECT event_type, count(*) AS lines FROM lines GROUP BY 1) USING (event_type)
  WHERE lines_with = lines AND (event_type, token) NOT IN (SELECT (event_type, token) FROM u)
    AND token <> 'value' AND length(token) > 1 AND NOT regexp_matches(token, '[0-9]')) WHERE score > t""")
def q_static_markers(spark, sf):
    return spl.static_markers(_turning_lines(spark, sf), "event_type")


@register("double_colon_keys", f"""WITH RECURSIVE {S.EV},
lines AS (SELECT line_id, 'a' || user_id % 5 || '::b' || line_id % 4 || ' b' || line_id % 3 || '::' || event_type || ' Node::' || event_type || ' done' AS content FROM ev),
pairs AS (SELECT line_id, unnest(regexp_extract_all(content, '([a-zA-Z0-9_]+)::([a-zA-Z0-9_]+)', 1)) AS a,
  unnest(regexp_extract_all(content, '([a-zA-Z0-9_]+)::([a-zA-Z0-9_]+)', 2)) AS b FROM lines),
r AS (
  SELECT line_id, unnest([a, b]) AS part FROM pairs WHERE regexp_matches(a, '[0-9]') AND regexp_matches(b, '[0-9]')
  UNION
  SELECT p.line_id, unnest([p.a, p.b]) FROM r JOIN pairs p ON p.line_id = r.line_id AND (p.a = r.part OR p.b = r.part)),
k AS (SELECT line_id, regexp_extract(content, '([a-zA-Z_]+)::([a-zA-Z_]+)', 2) AS key FROM lines)
SELECT line_id, CASE WHEN (line_id, key) IN (SELECT (line_id, part) FROM r) THEN '<NO_DC>' ELSE key END AS dc FROM k""")
def q_double_colon_keys(spark, sf):
    def numbered(name, col, n):
        return F.concat(F.lit(name), (F.col(col) % n).cast("string"))
    ev = _events(spark, sf)
    lines = ev.select("line_id", F.concat(numbered("a", "user_id", 5), F.lit("::"), numbered("b", "line_id", 4), F.lit(" "), numbered("b", "line_id", 3), F.lit("::"),
                                          "event_type", F.lit(" Node::"), "event_type", F.lit(" done")).alias("content"))
    return lines.select("line_id", spl.dc_key("content").alias("dc"))


@register("split_acceptance", f"""WITH {S.EV}, t AS (SELECT DISTINCT event_type AS w FROM ev),
-- One split for every weight, in the order of the layouts of the lines, and the score of a word is its length in thousandths.
layouts(grp, weight, suffix) AS (VALUES ('slot at start', 110.0, ''), ('start and colon', 20.0, ''), ('shared context', 40.0, ''), ('partner', 7.0, ''),
  ('ing behind bracket', 1000.0, 'ing'), ('none', 1.0, '')),
e AS (SELECT grp, count(*) AS keys, max(least((length(w || suffix) * weight / 1000)::DOUBLE, 1.0::DOUBLE)) AS evidence FROM layouts, t GROUP BY 1)
SELECT grp, keys, round(evidence, 6) AS evidence, evidence >= 0.1 AS accepted FROM e""")
def q_split_acceptance(spark, sf):
    ev = _events(spark, sf)
    w, back = F.col("event_type"), F.reverse("event_type")
    tail = F.lit(" served by node alpha")
    layouts = F.array(*[F.struct(F.lit(grp).alias("grp"), F.concat(w, F.lit(end)).alias("key"), content.alias("content")) for grp, end, content in [
        ("slot at start", "", F.concat(w, tail)), ("start and colon", "", F.concat(w, F.lit(":"), tail)),
        ("shared context", "", F.concat(F.lit("request "), w, tail)), ("partner", "", F.concat(F.lit("request "), w, tail, F.lit(" beta "), back)),
        ("ing behind bracket", "ing", F.concat(F.lit("[main] "), w, F.lit("ing "), back, F.lit(" "), back)),
        ("none", "", F.concat(F.lit("x "), w, F.lit(" "), back, F.lit(" "), back))]])
    lines = ev.select("line_id", F.inline(layouts))
    reps = lines.groupBy("grp", "key").agg(F.min_by("content", "line_id").alias("content"))
    scores = lines.select(F.col("key").alias("token"), (F.length("key") / 1000.0).alias("score")).distinct()
    words = lines.groupBy("grp").agg(F.lit(9).alias("max_words"))
    return evd.accepted_splits(reps, scores, words, ["grp"])


# ---------------------------------------------------------------------------
# End-to-end
# ---------------------------------------------------------------------------
from logweave.plans import benchmark as bm  # noqa: E402


@register("parse_scores", f"""WITH {S.EV},
e AS (SELECT dataset, {S.norm_pred(S.to_regex('event_template', full=True))} AS p, {S.norm_truth('event_template')} AS g
      FROM ev),
{S.accuracy_sql('e')}""")
def q_parse_scores(spark, sf):
    ev = _events(spark, sf)
    parsed = vf.parse_logs(mining.mine_templates(ev, EVENT_MASKS, depth=4), EVENT_MASKS)
    return bm.scores_table(parsed, corpora.event_labels(spark, sf))


# ---------------------------------------------------------------------------
# Alignment, ordering, fixpoint collapse, multi-dataset mining
# ---------------------------------------------------------------------------
from logweave.operators import templates as top  # noqa: E402


def _pred_vs_labels(spark, sf):
    """Predictions for all event lines but 'error'; labels for all lines but 'view'."""
    ev = _events(spark, sf)
    pred = ev.filter(F.col("event_type") != "error").select(
        "dataset", "line_id", "content", tf.template_to_regex("event_template").alias("pred_template"))
    lab = ev.filter(F.col("event_type") != "view").select(
        "dataset", "line_id", F.upper("content").alias("content"), "event_template")
    return pred, lab


@register("align_labels", f"""WITH {S.EV},
p AS (SELECT dataset, line_id, content FROM ev WHERE event_type <> 'error'),
t AS (SELECT dataset, line_id, upper(content) AS content FROM ev WHERE event_type <> 'view'),
j AS (SELECT coalesce(p.dataset, t.dataset) AS dataset, p.content AS pc, t.content AS tc
      FROM p FULL OUTER JOIN t ON p.dataset = t.dataset AND p.line_id = t.line_id)
SELECT dataset, count(pc) AS pred_rows, count(tc) AS truth_rows,
       sum(CASE WHEN coalesce(pc = tc, false) THEN 0 ELSE 1 END) AS content_mismatch FROM j GROUP BY dataset""")
def q_align_labels(spark, sf):
    pred, lab = _pred_vs_labels(spark, sf)
    return acc.alignment_report(acc.align_labels(pred, lab))


@register("semi_align", f"""WITH {S.EV}
SELECT dataset, line_id FROM ev WHERE event_type NOT IN ('error', 'view')""")
def q_semi_align(spark, sf):
    pred, lab = _pred_vs_labels(spark, sf)
    p, _ = acc.semi_align(pred, lab)
    return p.select("dataset", "line_id")


@register("sorted_results", f"""WITH {S.EV}
SELECT dataset, line_id, content FROM ev ORDER BY line_id""")
def q_sorted_results(spark, sf):
    ev = sk.valid_results(_events(spark, sf).select("dataset", F.col("line_id").cast("string").alias("line_id"),
                                                    "content"))
    return ev.repartitionByRange("dataset", "line_id").sortWithinPartitions("dataset", "line_id")


@register("collapse_fixpoint", f"""WITH RECURSIVE {S.DL},
m AS (SELECT DISTINCT regexp_replace(content, '[A-Za-z0-9]+', '<*>', 'g') AS template FROM dl),
{S.collapsed('m')}
SELECT template, collapsed FROM done""")
def q_collapse_fixpoint(spark, sf):
    m = _docs(spark, sf).select(masking.mask_variables("content", ["[A-Za-z0-9]+"], unicode=False)
                                .alias("template")).distinct()
    out = top.collapse_to_fixpoint(m.withColumn("orig", F.col("template")), "template", unicode=False)
    return out.select(F.col("orig").alias("template"), F.col("template").alias("collapsed"))


@register("mine_profiles")
def q_mine_profiles(spark, sf):
    lines = _events(spark, sf).select("dataset", "line_id", "content").unionByName(
        _docs(spark, sf).select("dataset", "line_id", "content"))
    prof = spark.createDataFrame([("events", list(EVENT_MASKS), 4, 0.5), ("documents", [r"[0-9]+"], 3, 0.5)],
                                 "dataset string, masks array<string>, depth int, st double")
    return mining.mine_with_profiles(lines, prof).select("dataset", "line_id", "template", "event_id")


# ---------------------------------------------------------------------------
# Companions with a DuckDB statement for results that SQL cannot state
# (greedy mining, farthest-point samples, the parse loop)
# ---------------------------------------------------------------------------
_DOC_MASKED_SQL = f"""{S.DL},
dm AS (SELECT dataset, line_id, regexp_replace(content, '[0-9]+', '<*>', 'g') AS masked FROM dl)"""


@register("mine_doc_lines_checks", f"""WITH {_DOC_MASKED_SQL}
SELECT dataset, count(*) AS lines, count(DISTINCT line_id) AS distinct_ids, count(*) AS self_matched FROM dm
GROUP BY dataset""")
def q_mine_doc_lines_checks(spark, sf):
    """Every line keeps its row and matches its own template (masked,
    whitespace-normalised), whatever the greedy grouping chose."""
    g = mining.mine_templates(_docs(spark, sf), [r"[0-9]+"], depth=3, unicode=False)
    norm = F.array_join(text.tokenize(masking.mask_variables("content", [r"[0-9]+"], unicode=False), False), " ")
    ok = mf.match_lenient(norm, tf.template_to_regex("template")) | (norm == F.col("template"))
    return g.groupBy("dataset").agg(F.count(F.lit(1)).alias("lines"),
                                    F.count_distinct("line_id").alias("distinct_ids"),
                                    F.sum(ok.cast("long")).alias("self_matched"))


@register("diverse_sample_sizes", f"""WITH {S.EV}
SELECT event_type, least(count(*), 5) AS sampled, true AS has_longest FROM ev GROUP BY event_type""")
def q_diverse_sample_sizes(spark, sf):
    """A diverse sample has min(k, group size) lines and starts with a line of
    the group's largest word count among the capped candidates."""
    ev = _events(spark, sf).select("event_type", "line_id", "content")
    s = smp.diverse_sample(ev, k=5, group_cols=["event_type"])
    words = F.size(text.tokenize("content", False))
    first = s.filter(F.col("sample_rank") == 1).select("event_type", words.alias("w1"))
    most = s.groupBy("event_type").agg(F.count(F.lit(1)).alias("sampled"), F.max(words).alias("wmax"))
    return most.join(first, "event_type").select("event_type", "sampled", (F.col("w1") == F.col("wmax"))
                                                 .alias("has_longest"))


@register("parse_doc_lines_checks", f"""WITH {S.DL}
SELECT dataset, count(*) AS lines, count(DISTINCT line_id) AS distinct_ids FROM dl GROUP BY dataset""")
def q_parse_doc_lines_checks(spark, sf):
    """The parse loop keeps every line exactly once."""
    g = mining.mine_templates(_docs(spark, sf), [r"[0-9]+"], depth=3)
    p = vf.parse_logs(g, [r"[0-9]+"])
    return p.groupBy("dataset").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("line_id").alias("distinct_ids"))
