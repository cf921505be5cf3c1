"""DuckDB formulations of the operators that SQL can express on whole tables."""

LINE_DEDUP = r"""
WITH l AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (
    SELECT doc_id, lines, list_transform(lines, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM l),
e AS (SELECT DISTINCT doc_id, unnest(keys) AS key FROM k),
r AS (
    SELECT key, max(doc_id) AS owner FROM e WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (
    SELECT e.doc_id, list(e.key) AS gone FROM e JOIN r ON e.key = r.key AND e.doc_id <> r.owner GROUP BY e.doc_id),
f AS (
    SELECT k.doc_id, lines, list_transform(list_filter(list_zip(lines, keys), lambda z: NOT list_contains(coalesce(gone, []), z[2])), lambda z: z[1]) AS kept
    FROM k LEFT JOIN d ON k.doc_id = d.doc_id)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM f
"""

CHAT_FORMAT = r"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
           '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS piece
    FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
p AS (
    SELECT conv_id, place, string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM t),
w AS (
    SELECT conv_id, max(place) + 1 AS n_turns, max_by(prefix, place) AS whole FROM p GROUP BY conv_id),
m AS (
    SELECT a.conv_id, a.n_turns FROM w a
    WHERE NOT EXISTS (SELECT 1 FROM p JOIN w b ON b.conv_id = p.conv_id
                      WHERE p.prefix = a.whole AND p.place + 1 = a.n_turns AND b.conv_id <> a.conv_id
                        AND (b.n_turns > a.n_turns OR b.conv_id < a.conv_id)))
SELECT conv_id, n_turns::BIGINT AS n_turns, (place // 512)::BIGINT AS part, string_agg(piece, '' ORDER BY place) AS rendered
FROM t JOIN m USING (conv_id) GROUP BY conv_id, n_turns, place // 512
"""

SHARDING = r"""
WITH c AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
s AS (
    SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
            regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)),
            lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32
    FROM documents, c),
p AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before,
           sum(size) OVER ()::BIGINT AS total FROM s),
h AS (SELECT *, ((2 * before + size) * 16 // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM h
"""

MERKLE_MANIFEST = r"""
WITH RECURSIVE c AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
framed AS (
    SELECT row_number() OVER () AS rid, doc_id, lang,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS front,
        coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS chars,
        coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS more_chars,
        coalesce(strlen(text) || ':' || text, '-') AS body,
        coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
            regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda b: ('0x' || b)::BIGINT)),
            lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) % 7 = 0, false) AS tampered
    FROM documents, c),
leaves AS (
    SELECT rid, doc_id, lang, sha256(front || chars || body) AS leaf,
        sha256(front || CASE WHEN tampered THEN more_chars ELSE chars END || body) AS claimed
    FROM framed),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i,
        count(*) OVER (PARTITION BY lang) AS n
    FROM leaves),
up(lang, lvl, i, h, n) AS (
    SELECT lang, 0, i, leaf, n FROM placed
    UNION ALL
    SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2
    FROM up WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
named AS (
    SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
    FROM up WHERE n = 1),
crown(lvl, i, h, n) AS (
    SELECT 0, i, subroot, n FROM named
    UNION ALL
    SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2
    FROM crown WHERE n > 1 GROUP BY lvl, i // 2, n),
climb(rid, lang, lvl, i, n, h, proof) AS (
    SELECT rid, lang, 0, i, n, claimed, '' FROM placed
    UNION ALL
    SELECT a.rid, a.lang, a.lvl + 1, a.i // 2, (a.n + 1) // 2,
        sha256(CASE WHEN a.i % 2 = 1 THEN s.h || a.h ELSE a.h || coalesce(s.h, '') END), a.proof || coalesce(s.h, '')
    FROM climb a LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM a.lang AND s.lvl = a.lvl AND s.i = xor(a.i, 1)
    WHERE a.n > 1),
climb_crown(rid, lvl, i, n, h, proof) AS (
    SELECT a.rid, 0, s.i, s.n, a.h, a.proof FROM climb a JOIN named s ON s.lang IS NOT DISTINCT FROM a.lang WHERE a.n = 1
    UNION ALL
    SELECT a.rid, a.lvl + 1, a.i // 2, (a.n + 1) // 2,
        sha256(CASE WHEN a.i % 2 = 1 THEN s.h || a.h ELSE a.h || coalesce(s.h, '') END), a.proof || coalesce(s.h, '')
    FROM climb_crown a LEFT JOIN crown s ON s.lvl = a.lvl AND s.i = xor(a.i, 1)
    WHERE a.n > 1),
top AS (SELECT h AS root FROM crown WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, top.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = top.root AS verified
FROM placed p JOIN climb_crown f ON f.rid = p.rid AND f.n = 1 JOIN named s ON s.lang IS NOT DISTINCT FROM p.lang, top
"""

_WORDS = r"""
w AS (
    SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, len(words) AS n FROM w)"""

NEAR_DUPLICATES = "WITH RECURSIVE" + _WORDS.format(
    text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + """,
windows AS (
    SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM p),
sets AS (SELECT DISTINCT doc_id, s FROM windows WHERE i + 4 <= n OR (n < 5 AND i = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, origin) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT y, origin FROM reached JOIN ways ON x = doc_id WHERE origin < y),
least AS (SELECT doc_id, min(origin) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l USING (doc_id)
"""

REPEATED_WINDOWS = "WITH" + _WORDS.format(text="coalesce(text, '')") + """,
windows AS (
    SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s FROM p),
places AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place FROM windows WHERE i + 19 <= n),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM places WHERE place > 1),
kept AS (
    SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text FROM p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

ORACLE = {"op1_line_dedup": LINE_DEDUP, "op2_chat_format": CHAT_FORMAT, "op4_sharding": SHARDING,
          "op8_minhash_dedup": NEAR_DUPLICATES, "op9_substring_dedup": REPEATED_WINDOWS, "op13_merkle_manifest": MERKLE_MANIFEST}
