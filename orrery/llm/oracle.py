"""SQL, for another engine, that gives the rows of the operators that SQL can express."""

_WHITE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to, true AS intact
FROM p JOIN f USING (h)
"""

OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WHITE}') AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 12)) AS i) t),
     least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
     gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM win JOIN least USING (k) WHERE m < doc_id),
     per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
     word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
     kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
     win AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS l FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) t WHERE len(w) > 0),
     lens AS (SELECT DISTINCT l FROM win),
     occ AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS k FROM d, lens, LATERAL (SELECT unnest(generate_series(1, len(w) - l + 1)) AS i) t),
     hit AS (SELECT doc_id, i, occ.l, item FROM occ JOIN win ON occ.k = win.k AND occ.l = win.l),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM hit) t GROUP BY doc_id),
     own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) t GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN own ON d.doc_id = own.doc_id
"""

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WHITE}') AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 4)) AS i) t),
     rep AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM win JOIN rep USING (doc_id, k)) t GROUP BY doc_id),
     c AS (SELECT d.doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
                  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WHITE}')) AS lines, coalesce(pos.n, 0) AS n_repeat_words,
                  len(list_filter(range(3, len(w) + 1), lambda i: w[i] = w[i - 1] AND w[i] = w[i - 2])) AS runs,
                  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered,
                  len(list_filter(w, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[a-z]|[^\x00-\x7F]'))) AS loud
           FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id),
     e AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(greatest(n_words, 1) AS DOUBLE) AS n FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > CAST(0.1 AS DOUBLE) * n_words OR (n_lines > 3 AND n_dup_lines > CAST(0.4 AS DOUBLE) * n_lines) OR word_chars / n > 20 OR word_chars / n < 2
            OR runs / n > CAST(0.1 AS DOUBLE) OR lettered / n < CAST(0.5 AS DOUBLE) OR loud / n > CAST(0.6 AS DOUBLE)) AS kept
FROM e
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WHITE}') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i) t WHERE len(w) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
     link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
     reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
     least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id FROM documents JOIN least ON documents.doc_id = x LEFT JOIN n ON documents.doc_id = n.doc_id
"""

ORACLE_SQL = {"op1_warc": OP1, "op2_substrings": OP2, "op5_decontamination": OP5, "op8_rules": OP8, "op9_neighbours": OP9}
