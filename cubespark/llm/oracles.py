"""SQL for DuckDB that gives the rows of those corpus queries that SQL can express."""

from __future__ import annotations

OP3 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1) AS chars
  FROM said GROUP BY 1
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars FROM told
"""

OP9 = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS key FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS at_ FROM docs
), sizes AS (
  SELECT key, CAST(ceil(count(*) / 2) AS HUGEINT) AS parts, power(count(*), 0.7) AS weight FROM docs GROUP BY 1
), whole AS (
  SELECT key, parts, CAST(greatest(1, round(weight / max(weight) OVER () * 2147483648)) AS HUGEINT) AS w FROM sizes
), ordered AS (
  SELECT *, row_number() OVER o AS i, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w,
    sum(parts) OVER o - parts AS gone, sum(w) OVER () AS all_w FROM whole WINDOW o AS (ORDER BY CAST(parts AS DOUBLE) / CAST(w AS DOUBLE), key)
), ends AS (
  SELECT *, CAST(gone + parts * rest_w // w AS BIGINT) AS until, i * 648056 % 1048576 AS u FROM ordered
), total AS (
  SELECT CAST(sum(parts) AS BIGINT) AS slots FROM whole
), marks AS (
  SELECT unnest(range(0, slots, 256)) AS at_ FROM total UNION SELECT slots FROM total UNION SELECT until FROM ends, total WHERE until < slots
    AND (w * 64 >= rest_w OR rest_w * 64 // all_w <> (rest_w - w) * 64 // all_w)
), spans AS (
  SELECT at_ AS start_, lead(at_) OVER (ORDER BY at_) - at_ AS n FROM marks QUALIFY n IS NOT NULL
), shares AS (
  SELECT at_, CAST(0 AS BIGINT) AS i, CAST(at_ AS HUGEINT) AS rest, CAST(0 AS HUGEINT) AS got FROM marks
  UNION ALL
  SELECT s.at_, o.i, s.rest - least(o.parts, (s.rest * o.w * 1048576 + o.u * o.rest_w) // (o.rest_w * 1048576)),
    least(o.parts, (s.rest * o.w * 1048576 + o.u * o.rest_w) // (o.rest_w * 1048576))
  FROM shares s JOIN ends o ON o.i = s.i + 1
), active AS (
  SELECT p.start_, p.n, o.key, CAST(a.got AS BIGINT) AS before_, CAST(b.got - a.got AS BIGINT) AS q
  FROM spans p JOIN shares a ON a.at_ = p.start_ JOIN shares b ON b.at_ = p.start_ + p.n AND b.i = a.i JOIN ordered o ON o.i = a.i
  WHERE b.got > a.got
), lists AS (
  SELECT start_, n, list(key ORDER BY key) AS ks, list(q ORDER BY key) AS qs, list(before_ ORDER BY key) AS bs FROM active GROUP BY 1, 2
), edf AS (
  SELECT start_, CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, [CAST(0 AS BIGINT) FOR x IN ks] AS done FROM lists
  UNION ALL
  SELECT start_, t, pick, [done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END FOR i IN range(1, len(qs) + 1)] FROM (
    SELECT e.start_, e.t + 1 AS t, e.done, l.qs, list_min([CAST(ceil((e.done[i] + 1) * l.n / l.qs[i]) AS BIGINT) * 100000 + i
      FOR i IN range(1, len(l.qs) + 1) IF e.done[i] < l.qs[i] AND floor(e.done[i] * l.n / l.qs[i]) <= e.t + 1]) % 100000 AS pick
    FROM edf e JOIN lists l USING (start_) WHERE e.t + 1 < l.n)
), plan AS (
  SELECT start_, l.ks[pick] AS key, l.bs[pick] + done[pick] - 1 AS part, done[pick] - 1 AS nth, l.qs[pick] AS q, l.n, start_ + t AS slot
  FROM edf JOIN lists l USING (start_) WHERE t >= 0
), horizon AS (
  SELECT until AS horizon FROM ends WHERE i = 1
)
SELECT p.doc_id, p.source, CAST(p.at_ // 8 AS BIGINT) AS block, CAST(p.at_ // 2 AS BIGINT) AS part,
  CAST(s.start_ + floor(s.nth * s.n / s.q) AS BIGINT) AS release, CAST(s.start_ + ceil((s.nth + 1) * s.n / s.q) AS BIGINT) AS deadline,
  CAST(s.slot AS BIGINT) AS slot, CAST(s.slot * 2 + p.at_ % 2 AS BIGINT) AS position, s.slot < horizon AS within_target
FROM placed p JOIN plan s ON s.key = p.key AND s.part = p.at_ // 2, horizon
"""

OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM words
), classes AS (
  SELECT min(doc_id) AS cid, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), items AS (
  SELECT cid, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.cid AS a, b.cid AS b FROM items a JOIN items b ON a.x = b.x AND a.cid < b.cid
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), either AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT cid AS a, cid AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN either e ON e.a = r.b
), comps AS (
  SELECT a AS cid, min(b) AS comp FROM reach GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(k.comp, d.doc_id) AS component_id,
  d.doc_id = coalesce(k.comp, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON len(d.s) > 0 AND c.n = len(d.s) AND c.s = list_sort(d.s) LEFT JOIN comps k ON k.cid = c.cid
"""

OP12 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words
), classes AS (
  SELECT min(doc_id) AS cid, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), items AS (
  SELECT cid, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.cid AS a, b.cid AS b FROM items a JOIN items b ON a.x = b.x AND a.cid < b.cid
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), either AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT cid AS a, cid AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN either e ON e.a = r.b
), comps AS (
  SELECT a AS cid, min(b) AS comp FROM reach GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(k.comp, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON len(d.s) > 0 AND c.n = len(d.s) AND c.s = list_sort(d.s) LEFT JOIN comps k ON k.cid = c.cid
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM lists WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM lists WHERE len(w) > 2
), f AS (
  SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1
), candidates AS (
  SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND c >= 10
), cuts AS (
  SELECT lang, k, phrase, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM candidates
  UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE k = 3
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.c AS l, r.c AS r,
    CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE k = 3) GROUP BY 1, 2
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

SQL = {"op3_chat_format": OP3, "op9_mixing": OP9, "op10_near_duplicates": OP10, "op12_ngram_join": OP12, "op13_collocations": OP13}
