"""The operators that plain SQL can state, for DuckDB on the same tables."""

from __future__ import annotations

SUFFIX_DEDUP = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS w FROM d, unnest(range(0, len(h) // 2 - 399)) AS t(i)),
    r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY w) > 1),
    marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 400, true) AS starts FROM r),
    numbered AS (SELECT doc_id, i, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, span),
    gaps AS (
        SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM spans
        UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM spans)),
    kept AS (
        SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a, b NULLS LAST) AS k
        FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, len(h) // 2 AS n_bytes, (len(h) - len(k)) // 2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
    FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) USING (doc_id)"""

NGRAM_JOIN = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS words FROM documents),
    s AS (
        SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
    e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
    p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS n FROM e l JOIN e r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM p JOIN s l ON l.doc_id = a JOIN s r ON r.doc_id = b
        WHERE n >= 0.8 * (len(l.shingles) + len(r.shingles) - n) - 1e-9
        UNION ALL SELECT l.doc_id, r.doc_id FROM s l JOIN s r ON len(l.shingles) = 0 AND len(r.shingles) = 0 AND l.doc_id <> r.doc_id),
    reach(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id)
    SELECT doc_id, class_id, coalesce(n, 0) AS n_links, len(shingles) AS n_shingles
    FROM s JOIN (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) USING (doc_id)"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
DECONTAMINATE = rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
    w AS (
        SELECT DISTINCT item_id, least(10, len(words)) AS length, words[i:i + least(10, len(words)) - 1] AS win
        FROM b, unnest(generate_series(1, greatest(1, len(words) - 9))) AS t(i) WHERE len(words) > 0),
    lengths AS (SELECT DISTINCT length FROM w),
    p AS (
        SELECT doc_id, i, length, words[i:i + length - 1] AS win
        FROM d, lengths, unnest(generate_series(1, len(words) - length + 1)) AS t(i)),
    h AS (SELECT doc_id, i, p.length, item_id FROM p JOIN w ON p.length = w.length AND p.win = w.win),
    covered AS (
        SELECT doc_id, count(DISTINCT k) AS n FROM h, unnest(generate_series(i, i + length - 1)) AS t(k) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
           sha256(coalesce(listed, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
COLLOCATIONS = rf"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\n\v\f\r]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM p),
    o AS (
        SELECT lang, unnest(flatten(list_transform(range(1, len(words) + 1), lambda i: list_transform(
            range(1, least(6, len(words) - i + 2)), lambda m: array_to_string(words[i:i + m - 1], ' '))))) AS phrase FROM w),
    t AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
    g AS MATERIALIZED (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS words FROM o GROUP BY lang, phrase HAVING count(*) >= 100),
    c AS (SELECT lang, phrase, len(words) AS m, f, words FROM g WHERE len(words) >= 2),
    k AS (SELECT lang, phrase, f, words, unnest(range(1, m)) AS k FROM c),
    x AS (SELECT lang, phrase, f, k, array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1:], ' ') AS rest FROM k),
    cuts AS (
        SELECT x.lang, x.phrase, x.f AS a, k, l.f AS l, r.f AS r, n, (1000 * x.f::HUGEINT * n) // (l.f::HUGEINT * r.f) AS score
        FROM x JOIN g l ON l.lang = x.lang AND l.phrase = first JOIN g r ON r.lang = x.lang AND r.phrase = rest JOIN t ON t.lang = x.lang),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
        SELECT lang, f, unnest(list_distinct(flatten(list_transform(range(2, m), lambda q: list_transform(
            range(1, m - q + 2), lambda i: array_to_string(words[i:i + q - 1], ' ')))))) AS phrase FROM c WHERE m > 2),
    longer AS (SELECT lang, phrase, max(f) AS longer FROM inside GROUP BY ALL),
    kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE coalesce(longer < a, true)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""

MINHASH_DEDUP = rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM documents),
    s AS (
        SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w),
    e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
    p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS n FROM e l JOIN e r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM p JOIN s l ON l.doc_id = a JOIN s r ON r.doc_id = b
        WHERE 100 * n >= 85 * (len(l.shingles) + len(r.shingles) - n)),
    reach(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id)
    SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""
