"""One registered query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglattice.llm import chunk_dedup, curriculum, html_extract, line_rules, piece_codec, simhash_golay, suffix_dedup, surrogates, token_transducer, toxicity, turn_repair, turn_trie, url_cascade
from loglattice.llm.common import table
from loglattice.llm.registry import query

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DUCK_WORD = r"[^\x20\x09-\x0D]+"

OP3_SQL = f"""
WITH n AS (SELECT doc_id, {ASCII_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@query("op3_chunk_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_dedup(table(spark, sf_dir, "documents"))


_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in line_rules.BOILERPLATE)
_SEPARATORS = ", ".join(f"'{s}'" for s in line_rules.SEPARATORS)
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{DUCK_WORD}') AS w FROM documents),
c AS (
  SELECT doc_id, t, w, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(8) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, line, len(regexp_extract_all(line, '{DUCK_WORD}')) AS n, regexp_extract_all(line, '{DUCK_WORD}') AS lw
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE n > 0 GROUP BY doc_id),
judged AS (
  SELECT doc_id, line, n, len(list_filter(lw, lambda x: x IN ({_SEPARATORS}))) AS seps, len(regexp_extract_all(line, '[#*$%&|<>]')) AS syms,
         ({_PHRASES}) AS furniture, regexp_matches(line, '[.!?:;,"'')\]…。！？][\x20\x09-\x0D]*$') AS ends FROM lines WHERE n > 0),
kept AS (
  SELECT doc_id, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS kept_chars FROM judged
  WHERE NOT ((seps >= 2 AND seps * 4 >= n) OR (syms >= 3 AND syms * 2 > n) OR (n <= 3 AND NOT ends) OR (n <= 40 AND furniture)) GROUP BY doc_id),
j AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(kept_chars, 0) AS kept_chars FROM c LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN kept USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND kept_chars > 0 AND kept_chars * 2 >= word_chars AS kept, CAST(kept_chars AS BIGINT) AS kept_chars
FROM b
"""


@query("op10_line_rules", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality(table(spark, sf_dir, "documents"))


OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{DUCK_WORD}')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o, sha256(coalesce(text, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT source, CAST(source_size AS DOUBLE) AS source_size, rk, [5, 2, 1][rk % 3 + 1] AS weight FROM s),
total AS (SELECT 1.5 * sum(source_size) AS b FROM w),
levels AS (
  SELECT 0 AS round, CAST(0 AS DOUBLE) AS lev
  UNION ALL
  SELECT l.round + 1, (SELECT (b - (SELECT coalesce(sum(CASE WHEN 2 * source_size < l.lev * weight THEN 2 * source_size END), 0) FROM w))
                              / (SELECT sum(CASE WHEN NOT 2 * source_size < l.lev * weight THEN weight END) FROM w) FROM total)
  FROM levels l WHERE l.round < 60),
top AS (SELECT max(lev) AS lev FROM levels),
t AS (SELECT source, rk, source_size, CASE WHEN 2 * source_size < lev * weight THEN 2 * source_size ELSE lev * weight END AS target FROM w, top),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rk,
         coalesce(sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.o, d.doc_id, d.size, d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (
  SELECT *, greatest(0, least(size, floor(target) - a)) AS k0, greatest(0, least(size, floor(target) - a - source_size)) AS k1,
         [1.5, 1.0, 0.5][rk % 3 + 1] AS f, [-1.0, 0.0, 1.0][rk % 3 + 1] AS m FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(k0 + k1 AS BIGINT) AS taken,
       CASE WHEN k0 > 0 THEN CASE WHEN m = 0 THEN a / target ELSE (sqrt(CAST(f AS DOUBLE) * f + m * (a / target) * 2) - f) / m END END AS first_position,
       CASE WHEN k1 > 0 THEN CASE WHEN m = 0 THEN (a + source_size) / target
            ELSE (sqrt(CAST(f AS DOUBLE) * f + m * ((a + source_size) / target) * 2) - f) / m END END AS second_position
FROM y
"""


@query("op5_curriculum_mix", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mixture(table(spark, sf_dir, "documents"))


@query("op9_simhash_golay")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_piece_codec")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_token_transducer")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.token_counts(table(spark, sf_dir, "documents"))


@query("op8_html_extract")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


@query("op6_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


# Rules of the registered query: (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
OP11_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(v, h, pa) AS (VALUES {_RULE_ROWS}),
fit AS (
  SELECT r, max_by(h || pa, length(h || pa)) AS rule, max_by(v, length(h || pa)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa) GROUP BY r),
hosts AS (
  SELECT DISTINCT host AS h FROM p WHERE len(list_filter(regexp_split_to_array(host, '[.-]'), lambda w: w IN {url_cascade.BLOCKED_WORDS})) > 0),
hit AS (SELECT DISTINCT r FROM p JOIN hosts ON host = h OR ends_with(host, '.' || h))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN hit.r IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fit USING (r) LEFT JOIN hit USING (r)
"""


@query("op11_url_cascade", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_cascade.judge_urls(pages, url_cascade.rule_table(spark, URL_RULES), url_cascade.listed_hosts(pages))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL: one step per bit, the lowest bit of each byte first."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda p: list_transform(range(8), lambda b: (ascii(({text})[p]) >> b) & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"


_NAMED = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
OP12_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_NAMED)} % 20 AS kind FROM conversations),
e AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM e),
f AS (
  SELECT conv_id, turn, role, text, i, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
edit(q, initial, letter, cost, q2, name) AS (VALUES
  (0, 's', 'K', 0, 1, NULL), (0, 'u', 'K', 0, 2, NULL), (1, 'u', 'K', 0, 2, NULL), (3, 'u', 'K', 0, 2, NULL), (2, 'a', 'K', 0, 3, NULL),
  (0, NULL, 'R', 3, 2, 'user'), (1, NULL, 'R', 3, 2, 'user'), (3, NULL, 'R', 3, 2, 'user'), (2, NULL, 'R', 3, 3, 'assistant'),
  (0, NULL, 'D', 4, 0, NULL), (1, NULL, 'D', 4, 1, NULL), (2, NULL, 'D', 4, 2, NULL), (3, NULL, 'D', 4, 3, NULL)),
ins(q, n, q1, lines) AS (VALUES
  (0, 0, 0, CAST([] AS VARCHAR[])), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']),
  (3, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 2, 3, ['user:', 'assistant:'])),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS way FROM f
  UNION ALL
  SELECT dp.conv_id, f.i, edit.q2,
         min({{'cost': way.cost + 3 * ins.n + edit.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END, 'audit': way.audit || repeat('I', ins.n) || letter,
               'lines': list_concat(list_concat(way.lines, ins.lines), CASE letter WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [edit.name || ':' || f.text] ELSE [] END)}})
  FROM dp JOIN ins ON ins.q = dp.q JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
       JOIN edit ON edit.q = ins.q1 AND (edit.initial IS NULL OR edit.initial = f.initial) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY dp.conv_id, f.i, edit.q2),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
         count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
best AS (
  SELECT dp.conv_id, min({{'cost': way.cost + 3 * ins.n, 'audit': way.audit || repeat('I', ins.n), 'lines': list_concat(way.lines, ins.lines)}}) AS w
  FROM dp JOIN sums ON dp.conv_id IS NOT DISTINCT FROM sums.conv_id AND dp.i = sums.n JOIN ins ON ins.q = dp.q AND ins.q1 IN (0, 3) GROUP BY dp.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost,
       coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
     LEFT JOIN sums ON c.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
"""


@query("op12_turn_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))


OP13_SQL = rf"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations),
k AS (SELECT c, {crc32_sql("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM o)),
heads AS (SELECT k.c, list({{'role': o.role, 'text': o.text}} ORDER BY pos) AS s FROM k JOIN o ON o.c = k.c - k.c % 20 AND o.pos < k.h GROUP BY k.c),
tails AS (SELECT k.c, list({{'role': o.role, 'text': o.text}} ORDER BY pos) AS s FROM k JOIN o ON o.c = k.c AND o.pos >= k.h GROUP BY k.c),
r AS (SELECT k.c, list_concat(coalesce(heads.s, []), coalesce(tails.s, [])) AS s FROM k LEFT JOIN heads USING (c) LEFT JOIN tails USING (c)),
p AS (SELECT c, s[1:d] AS node, d, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ends FROM p GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (
  SELECT n.node, d, n_children IS NULL AS leaf, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.node[d].text, '{DUCK_WORD}')) ELSE 0 END AS saved
  FROM n LEFT JOIN kids USING (node)),
sub AS (SELECT node[1:e] AS node, count_if(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n LEFT JOIN kids USING (node) JOIN sub USING (node) LEFT JOIN n up ON n.d > 0 AND up.node = n.node[1:n.d - 1]
"""


@query("op13_turn_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))
