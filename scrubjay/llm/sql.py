"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from scrubjay.llm.ranked_search import LOWER, TERM, UPPER

_SEARCH = f"""
WITH occ AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM occ GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
tot AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM len),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM benchmark)),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), tot WHERE t IN (SELECT t FROM q)),
m AS (SELECT doc_id, 10 + (90 * n * nd) // l AS m FROM len, tot),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
               FROM s WHERE score > 0) WHERE rank <= 10
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: [CAST(i AS VARCHAR), array_to_string(w[i:i + 19], ' ')])) AS x
        FROM d WHERE len(w) >= 20),
later AS (SELECT doc_id, s FROM (SELECT doc_id, CAST(x[1] AS BIGINT) AS s,
          row_number() OVER (PARTITION BY x[2] ORDER BY doc_id, CAST(x[1] AS BIGINT)) AS k FROM win) WHERE k > 1),
cut AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
gone AS (SELECT doc_id, unnest(ps) AS p FROM cut),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS k,
                  sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
h AS (SELECT *, len(k) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(k[1:a], '') AS pre, array_to_string(k[a + 1:b], '') AS mid, array_to_string(k[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


_NEAR = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                          WHEN len(w) = 1 THEN w ELSE [] END AS s FROM d),
x AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, s FROM l),
-- equal sets are one node
r AS (SELECT min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM x WHERE n > 0 GROUP BY list_sort(s)),
t AS (SELECT rep, n, unnest(s) AS sh FROM r),
e AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.sh = b.sh AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
lab AS (SELECT node, min(c) AS c FROM (WITH RECURSIVE g(node, c) AS (SELECT rep, rep FROM r UNION
        SELECT u.b, least(g.c, u.b) FROM g JOIN u ON g.node = u.a) SELECT node, c FROM g) GROUP BY node),
m AS (SELECT doc_id, n, CASE WHEN n > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(s)) ELSE doc_id END AS rep FROM x)
SELECT doc_id, n AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM m LEFT JOIN lab ON lab.node = m.rep AND n > 0
"""

_URLS = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT DISTINCT host, path, h || p AS rule, v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
b AS (SELECT host, path, rule, v FROM (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC) AS k FROM f) WHERE k = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN b USING (host, path)
"""

# A conversation is written again with escapes when one of its texts would end a turn early or be unescaped; then its conflicting texts are.
_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, CAST(max(CASE WHEN contains(text, '</s>') OR contains(text, '\p') OR contains(text, '\e') THEN 1 ELSE 0 END)
                     OVER (PARTITION BY conv_id) AS INTEGER) AS level,
      regexp_matches(text, '<s>|</s>|\[INST\]|\[/INST\]|\\p|\\e|(<|</|</s|\[|\[/|\[I[0-9A-Za-z_]*|\[/I[0-9A-Za-z_]*)$') AS conflict FROM c),
w AS (SELECT *, CASE WHEN level = 1 AND conflict THEN length(text) + length(text) - length(replace(text, '\', ''))
                          + 2 * len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]')) ELSE length(text) END AS written FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[INST] ') + length(role) + length(' [/INST]') + written + length('</s>')) AS BIGINT) AS formatted_chars,
       max(level) AS level, true AS identical
FROM w GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": _NEAR, "op5_url_rules": _URLS, "op8_chat_format": _CHAT,
            "op11_ranked_search": _SEARCH, "op12_repeats": _REPEATS, "op13_fill_middle": _MIDDLE}
