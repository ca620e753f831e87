"""DuckDB SQL for the operators that SQL can express."""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, 'null'))), 1, 8))::BIGINT AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w WHERE cap > 0),
g AS (SELECT w.source, w.source_size, CASE WHEN w.cap > 0 THEN least(w.cap, (SELECT max(lev) FROM l) * w.weight) ELSE 0.0::DOUBLE END AS target FROM w),
r AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes FROM g),
x AS (SELECT d.*, r.source_size, r.target, r.passes, round(r.target)::BIGINT - r.passes * r.source_size
             - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, rest)))::BIGINT AS taken FROM x
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
             length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS role_chars,
             length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(text_chars + CASE WHEN before = role THEN 8 WHEN before IS NULL THEN 16 + role_chars ELSE 23 + role_chars END) + 7)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

URLS = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b(domain) AS (SELECT n || CASE WHEN i > 0 THEN i::VARCHAR ELSE '' END || '.example.' || t FROM range(3000) r(i), (VALUES ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) x(n), (VALUES ('com'), ('net'), ('org')) y(t)),
f AS (SELECT h.*, (SELECT max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) FROM r
                   WHERE (h.host = rhost OR h.host LIKE '%.' || rhost) AND starts_with(h.path, rpath)) AS hit,
             EXISTS (SELECT 1 FROM b WHERE h.host = domain OR ends_with(h.host, '.' || domain)) AS listed FROM h)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""

#: The rules of quality.RULES with their bits, the base rules first.
QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(range(1, len(w) - 6)) AS p, w FROM w WHERE len(w) >= 8),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, list_slice(w, p, p + 7)) AS n FROM p),
c AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM g WHERE n >= 2) GROUP BY r),
s AS (SELECT r, count(*) AS n FROM (SELECT r, unnest(range(2, len(w) + 1)) AS i, w FROM w) WHERE w[i] = w[i - 1] GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, coalesce(s.n, 0) AS n_stutters,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations
      FROM w LEFT JOIN c USING (r) LEFT JOIN s USING (r)),
f AS (SELECT *, ((n_words < 20)::INT * 1 + (100 * n_repeat_words > 30 * n_words)::INT * 2 + (100 * n_symbols > 30 * n_words)::INT * 4 + (100 * n_dup_lines > 50 * n_lines)::INT * 8
              + (100 * n_stutters > 40 * n_words)::INT * 16 + (n_letters >= 40 AND 100 * n_upper > 60 * n_letters)::INT * 32 + (100 * n_exclamations > 50 * n_words)::INT * 64
              + (n_words > 0 AND 10 * word_chars < 15 * n_words)::INT * 128 + (word_chars > 40 * n_words)::INT * 256)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
