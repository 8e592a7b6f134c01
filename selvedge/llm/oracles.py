"""DuckDB SQL for the corpus queries that SQL can express, written apart from the operators.

Of the operators only tables of rules are read: patterns, thresholds, words. Retrieval by singular vectors, a
trained network, eigenvectors, merging and cutting of symbols and license rules with look-around have none; tests hold them against
brute force, held-out labels and the tokenizer's library.
"""

from __future__ import annotations

from selvedge.llm import quality_rules, secrets

SPACE = "[ \\t\\n\\x0b\\f\\r]+"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}'), lambda w: w <> '')"


NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(FOLD.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN list_extract([array_to_string(w, ' ')], 1)
    ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS r(i)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
),
e AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
),
walk AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT walk.x, e.y FROM walk JOIN e ON walk.y = e.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.y AS component_id, d.doc_id = low.y AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS y FROM walk GROUP BY ALL) low ON low.x = d.doc_id
"""


def _spans(order: int, rule: secrets.SecretRule) -> str:
    """All spans of one rule as a list of (s, o, e, k)."""
    found = f"regexp_extract_all(text, {quoted(rule.pattern)}, 0)"
    values = f"regexp_extract_all(text, {quoted(rule.pattern)}, {rule.value})"
    gaps = f"string_split_regex(text, {quoted(rule.pattern)})"
    start = (
        "coalesce(list_sum(list_transform(g[1 : i], lambda x: length(x))), 0)"
        " + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0)"
    )
    return f"""SELECT rid, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: length(v[i]) >= {rule.least}),
  lambda i: {{'s': CAST({start} AS BIGINT), 'o': {order}, 'e': CAST({start} + length(m[i]) AS BIGINT), 'k': '{rule.kind}'}})) AS x
  FROM (SELECT rid, {found} AS m, {values} AS v, {gaps} AS g FROM t)"""


def secret_scan() -> str:
    rules = "\n  UNION ALL ".join(_spans(k, r) for k, r in enumerate(secrets.RULES))
    base = ", ".join(quoted(r.kind) for r in secrets.BASE_RULES)
    text = "x.k || ':' || x.s || ':' || x.e"
    counts = ", ".join(f"count(*) FILTER (x.k = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
h AS ({rules})
SELECT doc_id, {counts},
  sha256(coalesce(string_agg({text}, ',' ORDER BY x.s, x.o) FILTER (x.k IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({text}, ',' ORDER BY x.s, x.o) FILTER (x.k IS NOT NULL), '') AS spans
FROM t LEFT JOIN h USING (rid) GROUP BY rid, doc_id
"""


def quality() -> str:
    measure = {
        "mean_word_length": "word_chars / n_words",
        "symbol_ratio": "n_symbols / n_words",
        "mark_ratio": "n_marks / n_words",
        "letter_ratio": "n_letters / word_chars",
        "stop_ratio": "n_stop / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines",
    }
    base = {"letter_ratio": "word_chars", "dup_line_ratio": "n_lines"}
    broken = []
    for rule in quality_rules.RULES:
        value = f"({measure[rule.measure]})"
        sides = [f"{value} < {rule.least}"] * (rule.least is not None) + [f"{value} > {rule.most}"] * (rule.most is not None)
        broken.append(f"({base.get(rule.measure, 'n_words')} > 0 AND ({' OR '.join(sides)}))")
    stops = ", ".join(quoted(w) for w in sorted(set(quality_rules.STOP_WORDS)))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {words("text")} AS w,
  list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '{SPACE}', '', 'g') <> '') AS l FROM t),
g AS (SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
r AS (SELECT rid, count(DISTINCT i + j) AS n FROM m, unnest([0, 1, 2]) AS u(j) WHERE c > 1 GROUP BY ALL),
f AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(text, '[^!?|#$%&*=~^<>]', '', 'g')) AS n_marks,
    length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS n_letters,
    len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop
  FROM t JOIN w USING (rid) LEFT JOIN r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR {" OR ".join(broken)}) AS kept
FROM f
"""


SAID = "'\\### Assistant: </turn> ok'"
CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {SAID} UNION ALL SELECT -7, 1, 'assistant', {SAID}
),
p AS (
  SELECT *, 15 + length(regexp_replace(role, '([\\\\#<:])', '\\\\\\1', 'g')) - 1 + length(regexp_replace(text, '([\\\\#<])', '\\\\\\1', 'g')) AS size FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

_BIT = "CAST(substr(b, i + {}, 1) AS INTEGER)"
_FIVE = " + ".join(f"{16 >> k} * {_BIT.format(k + 1)}" for k in range(5))
WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS b FROM pages
),
d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
  CASE WHEN page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < owner THEN owner END AS refers_to
FROM d
"""

MIX = f"""
WITH t AS (SELECT doc_id, source, len({words("coalesce(text, '')")}) AS n_tokens FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL),
x AS (SELECT max(tokens) / min(tokens) AS ratio FROM s WHERE tokens > 0),
a AS (SELECT min(a) AS a FROM x, range(0, 1000001) AS r(a) WHERE pow(ratio, 1 - a / 1000000.0) <= 3),
p AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens, a.a / 1000000.0) ELSE 0 END AS power FROM s, a),
z AS (SELECT max(tokens / power) AS scale FROM p WHERE power > 0),
q AS (
  SELECT source, tokens, CAST(round(power * scale) AS BIGINT) AS quota,
    CASE WHEN tokens > 0 THEN CAST(round(power * scale) AS BIGINT) // tokens ELSE 1 END AS passes FROM p, z
),
k AS (
  SELECT t.*, passes, CASE WHEN tokens > 0 THEN quota - passes * tokens ELSE 0 END AS rest,
    md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source
),
f AS (SELECT k.*, u.pass FROM k, unnest(range(1, passes + 1)) AS u(pass)),
l AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5('7|' || pass || '|' || d[1:3]),
    md5('7|' || pass || '|' || d[1:3] || '|' || d[4:6]), md5('7|' || pass || '|' || d), doc_id, n_tokens
    ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT *, passes + 1 AS pass FROM k WHERE rest > 0)
),
e AS (
  SELECT doc_id, source, pass, n_tokens, d FROM f
  UNION ALL SELECT doc_id, source, pass, n_tokens, d FROM l WHERE upto <= rest
)
SELECT doc_id, source, CAST(pass AS BIGINT) AS pass, n_tokens, CAST('0x' || d[1:3] AS BIGINT) AS block,
  md5('7|' || pass || '|' || d[1:3]) || md5('7|' || pass || '|' || d) AS place
FROM e
"""


EXACT = f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY size DESC, doc_id NULLS LAST)
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op2_near_duplicates": NEAR_DUPLICATES,
        "op3_secret_scan": secret_scan(),
        "op4_quality_rules": quality(),
        "op5_chat_format": CHAT,
        "op6_warc": WARC,
        "op7_mix_sources": MIX,
        "op12_exact_duplicates": EXACT,
    }
