"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"'[^\x20\x09-\x0D]+'"

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS h FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.h AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


#: Documents in order of hash while they fit, then of the largest size that fits, as many as fit, and so on downwards.
MIXING = f"""
WITH RECURSIVE d AS (SELECT doc_id, source IS NULL AS n, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS sz,
  cast('0x' || substr(md5(cast(doc_id AS varchar)), 1, 15) AS bigint) AS h FROM documents),
a AS (SELECT n, s, sum(sz)::bigint AS ss, (row_number() OVER (ORDER BY n, s) - 1) % 3 + 1.0::double AS w FROM d GROUP BY n, s),
b AS (SELECT *, 3.0::double * ss AS cap, sum(ss) OVER () ::double AS total,
  coalesce(sum(3.0::double * ss) OVER (ORDER BY 3.0::double * ss / w, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3.0::double * ss / w, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ow FROM a),
c AS (SELECT *, (total - capped) / ow AS lev FROM b),
e AS (SELECT *, (SELECT arg_min(lev, cap / w) FROM c WHERE lev * w <= cap) AS l FROM c),
f AS (SELECT n, s, ss, round(least(cap, coalesce(l * w, cap)), 6) AS tgt FROM e),
st AS (SELECT *, CASE WHEN ss > 0 THEN floor(tgt / ss)::bigint ELSE 0 END AS cp, tgt - CASE WHEN ss > 0 THEN floor(tgt / ss)::bigint ELSE 0 END * ss AS lft FROM f),
p AS (SELECT doc_id, n, s, h, sz, lft, lft > 0 AND sum(sz) OVER (PARTITION BY n, s ORDER BY h) <= lft AS tk FROM d JOIN st USING (n, s)),
z AS (SELECT n, s, sz, count(*) AS docs FROM p WHERE NOT tk AND sz > 0 GROUP BY n, s, sz),
g AS (SELECT n, s, any_value(lft) - coalesce(sum(sz) FILTER (tk), 0) AS l, (SELECT max(sz) + 1 FROM d) AS sz, 0::bigint AS m FROM p GROUP BY n, s
  UNION ALL SELECT n, s, l - m * sz, sz, m FROM (
    SELECT g.n, g.s, g.l, z.sz, least(z.docs, floor(g.l / z.sz)::bigint) AS m, row_number() OVER (PARTITION BY g.n, g.s ORDER BY z.sz DESC) AS k FROM g JOIN z ON g.n = z.n AND g.s = z.s AND z.sz < g.sz AND z.sz <= g.l) x WHERE k = 1),
k AS (SELECT doc_id, n, s, sz, row_number() OVER (PARTITION BY n, s, sz ORDER BY h) AS k FROM p WHERE NOT tk)
SELECT p.doc_id, p.sz AS size, st.ss AS source_size, st.tgt AS target, (st.cp + (p.tk OR coalesce(k.k <= g.m, false))::int * (st.lft > 0)::int) * p.sz AS taken
FROM p JOIN st USING (n, s) LEFT JOIN k USING (doc_id) LEFT JOIN g ON g.n = p.n AND g.s = p.s AND g.sz = p.sz AND g.m > 0
"""


RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, i, CASE WHEN lead(i, 4) OVER (PARTITION BY r ORDER BY i) IS NOT NULL THEN concat_ws(' ', word, lead(word) OVER x, lead(word, 2) OVER x, lead(word, 3) OVER x, lead(word, 4) OVER x) END AS gram FROM u WINDOW x AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) >= 2 AS twice FROM g),
k AS (SELECT r, sum(covered::int)::bigint AS n FROM (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM c) GROUP BY r),
m AS (SELECT doc_id, coalesce(source, '') AS host, source IS NULL AS hn, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS}))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS})))) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN k USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT hn, host, count(*) AS docs, sum((base_failed OR 10 * n_symbols > word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * n_words)::int) AS failed FROM f GROUP BY hn, host),
p AS (SELECT sum(failed) / sum(docs) AS mean, sum(failed * failed / docs) / sum(docs) - (sum(failed) / sum(docs)) ** 2 AS spread FROM h),
s AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1e6) ELSE 1e6 END AS strength FROM p),
v AS (SELECT hn, host, (failed + mean * strength) / (docs + strength) > 0.5 AS bad FROM h CROSS JOIN s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM f JOIN v USING (hn, host)
"""

#: Phrases of two and three words by places inside of pieces; products as 128-bit integers.
COLLOCATIONS = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT d, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM t),
w AS (SELECT d, lang, k, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
u AS (SELECT d, lang, k, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM w),
x AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY d, k ORDER BY i)),
n AS (SELECT lang, count(*)::bigint AS n FROM x GROUP BY lang),
f1 AS (SELECT lang, w1, count(*)::hugeint AS f FROM x GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*)::hugeint AS f FROM x WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*)::hugeint AS f FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, a.f AS l, b.f AS r FROM f2 JOIN f1 a ON a.lang = f2.lang AND a.w1 = f2.w1 JOIN f1 b ON b.lang = f2.lang AND b.w1 = f2.w2
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, a.f, b.f FROM f3 JOIN f1 a ON a.lang = f3.lang AND a.w1 = f3.w1 JOIN f2 b ON b.lang = f3.lang AND b.w1 = f3.w2 AND b.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, a.f, b.f FROM f3 JOIN f2 a ON a.lang = f3.lang AND a.w1 = f3.w1 AND a.w2 = f3.w2 JOIN f1 b ON b.lang = f3.lang AND b.w1 = f3.w3),
s AS (SELECT *, 1000000::hugeint * a * a // (l * r) AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN g USING (lang, phrase) WHERE g.f IS NULL OR 100 * g.f < 50 * a)
SELECT r.lang, rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n, score::bigint AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op11_collocations": COLLOCATIONS, "op6_quality_rules": RULES, "op7_mixing": MIXING, "op10_exact_dedup": EXACT}
