"""DuckDB statements that state each registered query independently (the
correctness oracle).  Shared corpus definitions come first."""

# Event log rendered from ``events`` (same text as logweave.sources.corpora.event_logs).
EV = """ev AS (
  SELECT 'events' AS dataset, CAST(event_id AS BIGINT) AS line_id,
         'user ' || CAST(user_id AS VARCHAR) || ' ' || event_type || ' value=' ||
         CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' from 10.0.' || CAST(user_id % 256 AS VARCHAR) ||
         '.' || CAST(event_id % 256 AS VARCHAR) || ' props ' || props AS content,
         'user <*> ' || event_type || ' value=<*> from <*> props {"k": <*>}' AS event_template,
         event_type, user_id
  FROM events)"""

# documents.text split on newline, line_id = doc_id * 1000000 + position.
DL = """dl AS (
  SELECT 'documents' AS dataset, CAST(doc_id * 1000000 + pos AS BIGINT) AS line_id, content, doc_id, lang
  FROM (SELECT doc_id, lang, unnest(parts) AS content, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents))
)"""

EVENT_MASK = r"(?:([0-9]+\.){3}[0-9]+)|(?:[0-9]+\.[0-9]+)|(?:[0-9]+)"
WS = r"[ \t\n\r\f\x0B]+"


def _q(s: str) -> str:
    return s.replace("'", "''")


def masked(col: str) -> str:
    return f"regexp_replace({col}, '{EVENT_MASK}', '<*>', 'g')"


def tokens(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{WS}'), lambda x: x <> '')"


def pattern(col: str) -> str:
    return f"array_to_string({tokens(col)}, ' ')"


PU = """pu AS (SELECT 'pages' AS dataset, CAST(page_id AS BIGINT) AS line_id, url AS content FROM pages)"""

ESC_CLASS = r"([()\[\]{}?*+\-|^$\\.&~#\t\n\r\x0B\f])"


def escape(col: str) -> str:
    """Python re.escape character set, then a backslash-space back to a space."""
    esc = f"regexp_replace({col}, '{ESC_CLASS}', '\\\\\\1', 'g')"
    return f"replace({esc}, '\\ ', ' ')"


def cap30(x: str) -> str:
    n = f"((length({x}) - length(replace({x}, '(.*?)', ''))) // 5)"
    return (f"CASE WHEN {n} > 30 THEN array_to_string(string_split({x}, '(.*?)')[1:30], '(.*?)') || '(.*?)' "
            f"ELSE {x} END")


QUOTED_WILD = r"'<\*>'?".replace("'", "''")


def to_regex(col: str, full: bool = False) -> str:
    c = f"regexp_replace({col}, '{QUOTED_WILD}', '<*>', 'g')" if full else col
    esc = f"replace({escape(c)}, '<\\*>', '(.*?)')"
    esc = f"regexp_replace({esc}, '(?:\\(\\.\\*\\?\\))+', '(.*?)', 'g')"
    return esc


def norm_truth(col: str) -> str:
    e = col
    for p, r in [(r"\s+", ""), (r"'<\*>'", "<*>"), (r"<\*>", ""), (",", ""), (":", ""), (r"\$", ""),
                 (r"\+", ""), (r"\[\s*\]", ""), (r"\(\)", "")]:
        e = f"regexp_replace({e}, '{_q(p)}', '{_q(r)}', 'g')"
    return e


def norm_pred(col: str) -> str:
    e = col
    for p, r in [(r"\s+", ""), (r"\(\.\*\?\)", ""), (r"\\", ""), (",", ""), (":", ""), (r"\$", ""),
                 (r"\+", ""), (r"\[\s*\]", ""), (r"\(\)", "")]:
        e = f"regexp_replace({e}, '{_q(p)}', '{_q(r)}', 'g')"
    return e


def accuracy_sql(ev_rel: str, by: str = "dataset") -> str:
    """GA/PA/FGA/FTA/event_count from a relation with columns by, p, g."""
    return f"""
p AS (SELECT {by}, p, count(*) n, count(DISTINCT g) k, min(g) g1 FROM {ev_rel} WHERE p IS NOT NULL GROUP BY {by}, p),
t AS (SELECT {by}, g, count(*) n_t FROM {ev_rel} WHERE g IS NOT NULL GROUP BY {by}, g),
j AS (SELECT p.*, (p.k = 1 AND p.n = t.n_t) AS ok FROM p LEFT JOIN t ON p.{by} = t.{by} AND p.g1 = t.g),
s AS (SELECT {by}, sum(CASE WHEN ok THEN n ELSE 0 END) ae, sum(CASE WHEN ok THEN 1 ELSE 0 END) ag,
             sum(CASE WHEN ok AND p = g1 THEN 1 ELSE 0 END) att, count(*) np FROM j GROUP BY {by}),
nt AS (SELECT {by}, count(*) nt FROM t GROUP BY {by}),
c AS (SELECT {by}, count(*) n_lines, sum(CASE WHEN p = g THEN 1 ELSE 0 END) m FROM {ev_rel} GROUP BY {by})
SELECT c.{by}, coalesce(s.ae, 0) / c.n_lines AS ga, c.m / c.n_lines AS pa,
       CASE WHEN coalesce(s.np, 0) + coalesce(nt.nt, 0) > 0
            THEN 2.0 * coalesce(s.ag, 0) / (coalesce(s.np, 0) + coalesce(nt.nt, 0)) ELSE 0.0 END AS fga,
       CASE WHEN coalesce(s.np, 0) + coalesce(nt.nt, 0) > 0
            THEN 2.0 * coalesce(s.att, 0) / (coalesce(s.np, 0) + coalesce(nt.nt, 0)) ELSE 0.0 END AS fta,
       CAST(coalesce(s.np, 0) AS BIGINT) AS event_count
FROM c LEFT JOIN s ON c.{by} = s.{by} LEFT JOIN nt ON c.{by} = nt.{by}"""


PUNCT = r"""[ !"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def clean_steps(src: str, col: str, out: str = "cleaned") -> str:
    """CTE chain that cleans template regexes of ``src.col``; adds ``out``."""
    lp = [(r"\(\.\*\?\)+://\(\.\*\?\)", "(.*?)"), (r"www\.\(\.\*\?\)", "(.*?)")]

    def loop(x: str) -> str:
        y = x
        for p, r in lp:
            y = f"regexp_replace({y}, '{p}', '{r}', 'g')"
        return y
    return f"""c0 AS (SELECT *, regexp_replace({col}, '<\\s*\\*\\s*>', '(.*?)', 'g') AS c_a FROM {src}),
c1 AS (SELECT *, length(regexp_replace(c_a, '{_q(PUNCT)}', '', 'g')) AS c_n,
       regexp_replace(c_a, '\\bfrom\\s+\\S+\\s+to\\s+\\S+', 'from (.*?) to (.*?)', 'g') AS c_b FROM c0),
c2 AS (SELECT *, {loop('c_b')} AS c_c FROM c1),
c3 AS (SELECT *, CASE WHEN starts_with(c_c, '_(.*?)') THEN substr(c_c, 2) ELSE c_c END AS c_d FROM c2),
c4 AS (SELECT *, {loop('c_d')} AS c_e FROM c3),
c5 AS (SELECT *, CASE WHEN starts_with(c_e, '_(.*?)') THEN substr(c_e, 2) ELSE c_e END AS c_f FROM c4),
c6 AS (SELECT * EXCLUDE (c_a, c_b, c_c, c_d, c_e, c_f, c_n),
       CASE WHEN c_n < 3 THEN NULL ELSE regexp_replace(c_f, '^\\s+|\\s+$', '', 'g') END AS {out} FROM c5)"""


def static_tokens(col: str) -> str:
    return f"len(regexp_extract_all(replace({col}, '(.*?)', ' '), '\\b[a-zA-Z0-9_]{{2,}}\\b'))"


def word_count(col: str) -> str:
    return f"(length({col}) - length(replace({col}, ' ', '')) + 1)"


#: The collapse rules as the survey words them, stated here anew.
_PART, _WORD = "[a-zA-Z0-9\\-]+", "[a-zA-Z0-9]+"
_COLLAPSE = [(f"<\\*>_{_PART}_<\\*>", "<*>"), (f"<\\*>-{_PART}-<\\*>", "<*>"), (f"\\b{_WORD}_<\\*>", "<*>"), (f"\\b{_WORD}-<\\*>", "<*>"),
             (f"<\\*>_{_WORD}\\b", "<*>"), (f"<\\*>-{_WORD}\\b", "<*>"), ("<\\*>_<\\*>", "<*>"), ("<\\*>\\s*<\\*>", "<*>"), ("<\\*>-<\\*>", "<*>"),
             ("\\(\\s*<\\*>\\s*\\)\\s*\\(\\s*<\\*>\\s*\\)", "(<*>)"), (f"<\\*>:{_PART}:<\\*>", "<*>")]


def collapsed(src: str) -> str:
    """Recursive CTE ``done(template, collapsed)`` over the distinct templates of ``src``."""
    step = "x"
    for p, r in _COLLAPSE:
        step = f"regexp_replace({step}, '{p}', '{r}', 'g')"
    return f"""walk AS (SELECT DISTINCT template, template AS x, 0 AS n FROM {src}
  UNION ALL SELECT template, {step}, n + 1 FROM walk WHERE {step} <> x),
done AS (SELECT template, regexp_replace(arg_max(x, n), '{QUOTED_WILD}', '<*>', 'g') AS collapsed FROM walk GROUP BY template)"""
