"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# Every run of lines with 50 words is the union of its shortest windows, forward from a line and backward from it;
# a window whose text stands at an earlier place marks its lines. Written out by self-join inside each document.
LINE_DEDUP = r"""
WITH raw AS (
  SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM documents
), l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM raw
), w AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS n,
         sum(len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l
), spans AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY 1, 3
), body AS (
  SELECT p.doc_id, p.s, p.e, md5(list_aggregate(list_slice(r.ls, p.s, p.e), 'string_agg', chr(10))) AS h FROM spans p JOIN raw r USING (doc_id)
), firsts AS (
  SELECT h, min((doc_id, s)) AS first FROM body GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM body JOIN firsts USING (h) WHERE (doc_id, s) > first
), dropped AS (
  SELECT doc_id, list(i) AS g FROM gone GROUP BY 1
)
SELECT r.doc_id,
       CASE WHEN g IS NULL THEN r.text
            ELSE coalesce(list_aggregate(list_transform(list_filter(range(1, len(ls) + 1), lambda x: NOT list_contains(g, x)), lambda x: ls[x]), 'string_agg', chr(10)), '') END AS text,
       len(ls)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed
FROM raw r LEFT JOIN dropped USING (doc_id)
"""


# The same templates as the operator's, written out here; grams of three words, votes by diagonal, spans by window.
LICENSES = r"""
WITH templates(template, label, exact, phrase) AS (VALUES
  (0, 'mit', true, 'under the mit license'),
  (1, 'apache-2', true, 'apache license version 2'),
  (2, 'cc-by-nc', true, 'cc by nc'),
  (3, 'mit', false, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
  (4, 'apache-2', false, 'you may not use this file except in compliance with the license you may obtain a copy of the license at'),
  (5, 'apache-2', false, 'licensed under the apache license version 2 0'),
  (6, 'bsd', false, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  (7, 'gpl', false, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license'),
  (8, 'gpl-3', false, 'licensed under the gnu general public license version 3'),
  (9, 'gpl-2', false, 'licensed under the gnu general public license version 2'),
  (10, 'lgpl', false, 'under the terms of the gnu lesser general public license'),
  (11, 'mpl', false, 'this source code form is subject to the terms of the mozilla public license'),
  (12, 'isc', false, 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted'),
  (13, 'unlicense', false, 'this is free and unencumbered software released into the public domain'),
  (14, 'cc-by', false, 'licensed under a creative commons attribution 4 0 international license'),
  (15, 'cc-by-sa', false, 'licensed under a creative commons attribution sharealike 4 0 international license'),
  (16, 'cc-by-nc', false, 'licensed under cc by nc 4 0'),
  (17, 'mit', false, 'released under the mit license')
), tw AS (SELECT *, string_split(phrase, ' ') AS ws FROM templates
), tg AS (
  SELECT template, label, exact, len(ws) AS length, i AS t_at, ws[i + 1] AS a, ws[i + 2] AS b, ws[i + 3] AS c
  FROM (SELECT *, unnest(range(len(ws) - 2)) AS i FROM tw)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), g AS (
  SELECT doc_id, i AS pos, ws[i + 1] AS a, ws[i + 2] AS b, ws[i + 3] AS c FROM (SELECT *, unnest(range(len(ws) - 2)) AS i FROM d)
), votes AS (
  SELECT doc_id, template, any_value(label) AS label, any_value(exact) AS exact, any_value(length) AS length, pos - t_at AS diagonal,
         list(DISTINCT t_at) AS hit, min(pos) AS from_at
  FROM g JOIN tg USING (a, b, c) GROUP BY doc_id, template, pos - t_at
), opened AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= CASE WHEN exact THEN 0 ELSE 3 END THEN 0 ELSE 1 END AS opens
  FROM votes WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM opened
), spans AS (
  SELECT doc_id, template, any_value(label) AS label, any_value(exact) AS exact,
         len(list_distinct(flatten(list(hit)))) / (any_value(length) - 2) AS share, min(from_at) AS start
  FROM numbered GROUP BY doc_id, template, span
), judged AS (
  SELECT *, CASE WHEN exact THEN share = 1 ELSE share >= 0.8 END AS ok FROM spans
), found AS (
  SELECT doc_id, count(*) FILTER (ok AND exact) AS n_base, min(start) FILTER (ok AND exact) AS first_word, max(start) FILTER (ok AND exact) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (ok AND exact)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (ok)), ',') AS labels, max(share) AS score
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)
"""

# The jump function walks by list_reduce over as many steps as there are shards; the CRC goes byte by byte.
SHARDS = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), d AS (
  SELECT doc_id, coalesce(text, '') AS body, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT AS key FROM documents
), walked AS (
  SELECT *, list_transform([16, 17], lambda n: list_reduce(
    list_prepend({'key': key, 'shard': -1::BIGINT, 'next': 0::BIGINT}, list_transform(range(n), lambda i: {'key': 0::HUGEINT, 'shard': 0::BIGINT, 'next': 0::BIGINT})),
    lambda s, x: CASE WHEN s['next'] >= n THEN s ELSE {
      'key': (s['key'] * 2862933555777941757 + 1) % 18446744073709551616,
      'shard': s['next'],
      'next': trunc((s['next'] + 1) * (2147483648.0::DOUBLE / ((((s['key'] * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592) + 1)::DOUBLE))::BIGINT
    } END)['shard']) AS shards
  FROM d
), sized AS (
  SELECT doc_id, octet_length(encode(body))::BIGINT + 1 AS size, shards[1]::INTEGER AS shard, shards[2]::INTEGER AS grown_shard,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(body), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM walked, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM sized
"""

# Placeholders by regular expressions, windows of five, votes by diagonal, spans by window, slots compared as sets.
DECONTAMINATION = r"""
WITH source AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', min(item_id), coalesce(text, '') FROM benchmark GROUP BY coalesce(text, '')
), marked AS (
  SELECT side, id, regexp_replace(
    regexp_replace(regexp_replace(text, '([0-9])[.,]([0-9])', '\1' || chr(183) || '\2', 'g'), '([0-9])[.,]([0-9])', '\1' || chr(183) || '\2', 'g'),
    '([\p{L}\p{N},;:] )(\p{Lu})', '\1' || chr(57344) || '\2', 'g') AS m FROM source
), named AS (
  SELECT side, id, m, regexp_replace(translate(
      regexp_replace(m, chr(57344) || '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', chr(57344), 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9][0-9' || chr(183) || ']*', chr(57345), 'g') AS n FROM marked
), words AS (
  SELECT side, id, regexp_extract_all(m, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS r,
    regexp_extract_all(regexp_replace(n, '(' || chr(57345) || ' ?)(?:mm|cm|km|m|mg|kg|g|ml|l|mph|s|min|h|hours|minutes|seconds|days|years|usd|eur|dollars|euros|meters|metres|miles|feet|inches|grams|pounds|percent)([^a-z]|$)',
      '\1' || chr(57346) || '\2', 'g'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS c
  FROM named
), grams AS (
  SELECT side, id, i AS pos, c[i + 1 : i + 5] AS c, r[i + 1 : i + 5] AS r FROM (SELECT *, unnest(range(len(c) - 4)) AS i FROM words)
), windows AS (
  SELECT *, array_to_string(c, ' ') AS k, list_transform(c, lambda x: regexp_matches(x, '[' || chr(57344) || chr(57345) || chr(57346) || ']')) AS slot FROM grams
), used AS (
  SELECT * FROM windows WHERE len(list_filter(slot, lambda x: NOT x)) >= 3
), items AS (
  SELECT id AS item_id, pos AS t_at, k, r AS t, slot, count(*) OVER (PARTITION BY id) AS n FROM used WHERE side = 'b'
), matched AS (
  SELECT d.id AS doc_id, item_id, n, d.pos, t_at, d.pos - t_at AS diagonal,
    list_filter(list_transform(range(1, 6), lambda i: CASE WHEN b.slot[i] THEN {'at': t_at + i, 'item': t[i], 'doc': d.r[i]} END), lambda x: x IS NOT NULL) AS slots
  FROM used d JOIN items b ON d.side = 'd' AND d.k = b.k
), votes AS (
  SELECT doc_id, item_id, n, diagonal, list(DISTINCT t_at) AS hit, list_distinct(flatten(list(slots))) AS slots, min(pos) AS start, max(pos) AS stop
  FROM matched GROUP BY ALL
), opened AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, item_id ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS opens FROM votes
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, item_id ORDER BY diagonal) AS span FROM opened
), spans AS (
  SELECT doc_id, item_id, span, len(list_distinct(flatten(list(hit)))) / any_value(n) AS coverage, list_distinct(flatten(list(slots))) AS slots,
    min(start)::BIGINT AS start, (max(stop) + 5)::BIGINT AS stop FROM numbered GROUP BY ALL
), judged AS (
  SELECT * FROM spans WHERE coverage >= 0.8
    AND len(list_distinct(list_transform(slots, lambda s: s['item']))) = len(list_distinct(list_transform(slots, lambda s: {'i': s['item'], 'd': s['doc']})))
)
SELECT doc_id, item_id, coverage, start, stop AS "end", len(slots)::BIGINT AS slots
FROM judged QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY coverage DESC, start, stop DESC) = 1
"""

# One ordered look back over all records of a URL; the operator's time buckets must not change the result.
REVISITS = r"""
WITH p AS (
  SELECT page_id, url, html, substr(md5(coalesce(html, '')), 1, 16) AS tag, (page_id % 40000) AS minute, regexp_replace(url, '#.*$', '') AS plain FROM pages
), records AS (
  SELECT page_id * 3 AS record_id, true AS is_response, url, minute AS pos, tag AS etag, html,
         [{'name': 'cache-control', 'value': 'max-age=60'}, {'name': 'content-length', 'value': strlen(html)::VARCHAR}, {'name': 'content-type', 'value': 'text/html'}, {'name': 'etag', 'value': tag}] AS h FROM p
  UNION ALL
  SELECT page_id * 3 + k, false, plain || frag, minute + CASE k WHEN 1 THEN 1 + page_id % 300 ELSE -1 END, CASE WHEN page_id % 5 = 0 THEN 'other' ELSE tag END, NULL,
         [{'name': 'cache-control', 'value': 'max-age=' || (page_id % 7)}, {'name': 'content-length', 'value': '0'}, {'name': 'etag', 'value': 'W/' || CASE WHEN page_id % 5 = 0 THEN 'other' ELSE tag END}]
  FROM p, (VALUES (1, '#again'), (2, '#before')) AS v(k, frag)
), bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM records
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(b, '^([^/?]*)', 1), '^[^@]*@', '')), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|gclid|fbclid|ref)(=.*)?$'))), '&') AS query
  FROM bare
), keyed AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM parts
), looked AS (
  SELECT *, last_value(CASE WHEN is_response THEN {'id': record_id, 'etag': etag, 'h': h, 'html': html} END IGNORE NULLS) OVER (
    PARTITION BY url_key ORDER BY pos, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM keyed
), judged AS (
  SELECT *, CASE WHEN r IS NULL THEN 'missing' WHEN r['etag'] = etag THEN 'resolved' ELSE 'changed' END AS status FROM looked WHERE NOT is_response
), merged AS (
  SELECT *, CASE WHEN status = 'resolved' THEN [h[1], r['h'][2], r['h'][3], h[3]] ELSE h END AS headers FROM judged
)
SELECT record_id, url_key, r['id'] AS response_id, status, array_to_string(list_transform(headers, lambda x: x['name'] || ': ' || x['value']), chr(10)) AS headers,
       CASE WHEN status = 'resolved' THEN md5(r['html']) END AS payload_md5, CASE WHEN status = 'resolved' THEN strlen(r['html'])::BIGINT END AS payload_bytes
FROM merged
"""


# Words cut by one letter and joined: at the same place with another word, or with the whole of a shorter one.
SPELLING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{5,}')) AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS times FROM runs GROUP BY id, run
), hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(id || ':' || run), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)::BIGINT AS crc
  FROM counted, crc_table
), typed AS (
  SELECT times, CASE WHEN crc % 97 = 0 THEN substr(run, 1, (crc % length(run))::INTEGER) || substr(run, (crc % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM words)
), shorter AS MATERIALIZED (
  SELECT cut.word, cut.n, words.word AS other, words.n AS other_n FROM cut JOIN words ON cut.rest = words.word
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, n, other, other_n FROM shorter
  UNION SELECT other, other_n, word, n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, min({'m': -other_n, 'other': other}) AS b FROM near GROUP BY word
), judged AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b['m'] >= 2 * n THEN b['other'] END AS form, CASE WHEN -b['m'] >= 2 * n THEN -b['m'] END AS form_n
  FROM words LEFT JOIN best USING (word)
), climbed AS (
  SELECT word, word AS root FROM judged
  UNION ALL
  SELECT climbed.word, judged.form AS root FROM climbed JOIN judged ON climbed.root = judged.word WHERE judged.form IS NOT NULL
)
SELECT j.word, j.form, c.root, j.n, j.n_near::BIGINT AS n_near, j.form_n::BIGINT AS form_n
FROM judged j JOIN climbed c ON c.word = j.word JOIN judged e ON e.word = c.root WHERE e.form IS NULL
"""


# Prefixes named by the digests of their turns; subtree sums over every node's ancestors.
PREFIX_TRIE = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS lender,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(conv_id::VARCHAR), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)::BIGINT % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc_table
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, o, role, text FROM ids i JOIN own ON own.conv_id = i.lender AND o <= h
  UNION ALL SELECT i.conv_id, 1 AS part, o, role, text FROM ids i JOIN own ON own.conv_id = i.conv_id AND o > h
), seqs AS (
  SELECT conv_id, list(sha256(role) || sha256(text) ORDER BY part, o) AS turns, list(length(text) ORDER BY part, o) AS sizes FROM rebuilt GROUP BY conv_id
), whole AS (
  SELECT conv_id, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes FROM ids LEFT JOIN seqs USING (conv_id)
), prefixes AS (
  SELECT conv_id, depth, depth = len(turns) AS ends, list_slice(turns, 1, depth) AS path, CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM whole)
), nodes AS (
  SELECT array_to_string(path, '') AS node, CASE WHEN depth > 0 THEN array_to_string(list_slice(path, 1, depth - 1), '') END AS parent, any_value(path) AS path, depth,
         min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM prefixes GROUP BY 1, 2, depth
), kids AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1
), told AS (
  SELECT array_to_string(list_slice(path, 1, up), '') AS node, (n_convs - 1) * chars AS saved, n_children IS NULL AS leaf
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes LEFT JOIN kids USING (node))
), sums AS (
  SELECT node, sum(saved) AS saved, count(*) FILTER (leaf) AS n_leaves FROM told GROUP BY node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.parent
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": LICENSES,
        "op5_jump_sharding": SHARDS,
        "op6_decontamination": DECONTAMINATION,
        "op7_line_dedup": LINE_DEDUP,
        "op9_warc_revisits": REVISITS,
        "op11_prefix_trie": PREFIX_TRIE,
        "op12_spelling_variants": SPELLING,
    }
