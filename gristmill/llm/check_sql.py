"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .quality_rules import MEASURES, RULES, STOP_WORDS
from .url_filter import BOUND_WIDTH, LOWER, MIN_GOOD, PRIOR_RANGE, UPPER, parse_rules

_STOP_LIST = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_BROKEN = " OR ".join(
    f"{rule.measure} {sign} {bound}"
    for rule in RULES
    for sign, bound in (("<", rule.low), (">", rule.high))
    if bound is not None
)
_RATIOS = ", ".join(f"CAST({m.expression.replace(' / ', ' AS DOUBLE) / ')} AS {m.name}" for m in MEASURES)

QUALITY_RULES_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
s AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM s WHERE len(words) > 2),
v AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM g),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM v),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT s.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(list_filter(words, lambda w: lower(w) IN ({_STOP_LIST}))) AS BIGINT) AS n_stop_words,
             CAST(len(lines) AS BIGINT) AS n_lines,
             len(list_filter(lines, lambda l: regexp_matches(ltrim(l), '^[-*•]'))) AS n_bullet_lines,
             len(list_filter(lines, lambda l: regexp_matches(rtrim(l), '(\.\.\.|…)$'))) AS n_ellipsis_lines
      FROM s LEFT JOIN c ON s.r = c.r),
x AS (SELECT *, {_RATIOS}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_BROKEN}) AS kept,
       n_stop_words, n_lines FROM x
"""


def _strength(level: str) -> str:
    low, high = PRIOR_RANGE
    return (
        f"(SELECT CASE WHEN spread <= sampling THEN {high} ELSE least({high}, greatest({low}, weighted / (spread - sampling) - 1)) END FROM "
        f"(SELECT sum(n * pow(k / n - prior, 2)) AS spread, sum(prior * (1 - prior)) AS sampling, sum(n * prior * (1 - prior)) AS weighted FROM {level}))"
    )


def url_filter_sql(rules: str) -> str:
    chosen = sorted(parse_rules(rules), key=lambda r: (-len(r.pattern), r.pattern))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in chosen]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.pattern}'" for f, r in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in fits)
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
v AS (SELECT host, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*|<[^>]*>', ' ', 'g'),
             '&[a-z]+;', '&', 'g'), '[ \t\n\r]+', ' ', 'g')) AS seen FROM p),
o AS (SELECT host, CASE WHEN length(seen) - length(replace(seen, ' ', '')) + 1 >= 20
                         AND length(seen) - length(regexp_replace(seen, '[#*$%&|!]+', '', 'g')) <= length(seen) * 0.02e0 THEN 1 ELSE 0 END AS good FROM v),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS k, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix FROM o GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT sum(k) / sum(n) FROM h) AS prior FROM h GROUP BY suffix),
s1 AS (SELECT suffix, (k + w * prior) / (n + w) AS mean FROM (SELECT *, {_strength('s0')} AS w FROM s0)),
d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, min(s1.mean) AS prior FROM h JOIN s1 USING (suffix) GROUP BY domain),
d1 AS (SELECT domain, (k + w * prior) / (n + w) AS mean FROM (SELECT *, {_strength('d0')} AS w FROM d0)),
h0 AS (SELECT host, n, k, d1.mean AS prior FROM h JOIN d1 USING (domain)),
h1 AS (SELECT host, n, k + w * prior AS a, n - k + w * (1 - prior) AS b FROM (SELECT *, {_strength('h0')} AS w FROM h0)),
h2 AS (SELECT host, CAST(n AS BIGINT) AS n_labelled, least(1e0, a / (a + b) + {BOUND_WIDTH} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS upper FROM h1)
SELECT page_id, host, path, {rule} AS rule, {verdict} WHEN upper < {MIN_GOOD} THEN 'block' ELSE 'allow' END AS verdict,
       n_labelled, round(upper, 6) AS upper FROM p JOIN h2 USING (host)
"""


JACCARD_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 3, 2))) AS i, words FROM t WHERE len(words) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS gram FROM s),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.size + y.size - shared)),
r(doc_id, least) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.doc_id WHERE r.least < l.b)
SELECT t.doc_id, CAST(coalesce(max(n.size), 0) AS BIGINT) AS n_shingles, coalesce(min(r.least), t.doc_id) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY t.doc_id
"""


def _leaf_sql(n_chars: str) -> str:
    parts = [
        f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
        for c in ("doc_id", "source", "lang", n_chars, "text")
    ]
    return f"sha256({' || '.join(parts)})"


# The CRC-32 of a text of ASCII characters, bit by bit: the reflected polynomial 0xEDB88320.
CRC32_SQL = r"""
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, list_transform(range(8), lambda x: CAST(x AS BIGINT))),
               lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)
"""


def crc32_sql(text: str) -> str:
    """The CRC-32 of a text of code points up to U+00FF in UTF-8."""
    codes = (
        f"flatten(list_transform(list_filter(string_split({text}, ''), lambda ch: ch <> ''), lambda ch: "
        "CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [192 + (ord(ch) >> 6), 128 + (ord(ch) & 63)] END))"
    )
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


MERKLE_SQL = rf"""
WITH RECURSIVE {CRC32_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, lang, n_chars, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('(n_chars + 1)')} AS changed,
             {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 AND n_chars IS NOT NULL AS hit FROM documents, crc),
l AS (SELECT *, coalesce('+' || lang, '!') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t(tree, height, i, h) AS (
  SELECT tree, 0, i, leaf FROM l
  UNION ALL
  SELECT tree, height + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM t) WHERE n > 1 GROUP BY tree, height, i // 2),
s AS (SELECT tree, h AS subroot, height AS top FROM t QUALIFY row_number() OVER (PARTITION BY tree ORDER BY height DESC) = 1),
g AS (SELECT *, row_number() OVER (ORDER BY encode(tree)) - 1 AS k FROM s),
u(height, i, h) AS (
  SELECT 0, k, subroot FROM g
  UNION ALL
  SELECT height + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY height, i // 2),
root AS (SELECT h AS root, height AS top FROM u ORDER BY height DESC LIMIT 1),
f AS (SELECT r, tree, i, k, s.top AS low, s.top + root.top AS steps, CASE WHEN hit THEN changed ELSE leaf END AS start
      FROM l JOIN g USING (tree) JOIN s USING (tree), root),
p AS (
  SELECT r, height AS step, t.i < f.i >> height AS before, t.h AS side FROM f JOIN t ON t.tree = f.tree AND t.i = xor(f.i >> height, 1)
  UNION ALL
  SELECT r, low + height, u.i < k >> height, u.h FROM f, u WHERE u.i = xor(k >> height, 1)),
q AS (SELECT r, sha256(string_agg(side, '' ORDER BY step)) AS proof FROM p GROUP BY r),
w(r, step, steps, h) AS (
  SELECT r, 0, steps, start FROM f
  UNION ALL
  SELECT w.r, w.step + 1, steps, sha256(CASE WHEN before THEN side || h WHEN NOT before THEN h || side ELSE h END)
  FROM w LEFT JOIN p ON p.r = w.r AND p.step = w.step WHERE w.step < steps),
z AS (SELECT r, h AS folded_root FROM w WHERE step = steps)
SELECT l.doc_id, l.leaf, s.subroot, root.root, coalesce(q.proof, sha256('')) AS proof_sha256, z.folded_root, z.folded_root = root.root AS verified
FROM l JOIN s USING (tree) JOIN z ON z.r = l.r LEFT JOIN q ON q.r = l.r, root
"""


SPELLING_SQL = rf"""
WITH RECURSIVE {CRC32_SQL},
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM t GROUP BY 1, 2),
h AS (SELECT run, k, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM c, crc),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
i AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
m AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM i),
p AS (SELECT a.word, b.word AS near FROM m a JOIN m b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT m.word, w.word FROM m JOIN w ON w.word = m.rest
      UNION SELECT w.word, m.word FROM m JOIN w ON w.word = m.rest),
b AS (SELECT p.word, count(*) AS n_near, first(p.near ORDER BY v.n DESC, encode(p.near)) AS near, max(v.n) AS near_n FROM p JOIN w v ON v.word = p.near GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
      FROM w LEFT JOIN b ON b.word = w.word),
r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word
"""
