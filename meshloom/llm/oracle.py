"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc CROSS JOIN sizes WHERE len(w) >= size)
),
met AS (SELECT d.doc_id, d.size, d.i, n.item_id FROM doc_window d JOIN item_window n USING (size, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM met)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _escaped(text: str, control: tuple[str, ...]) -> str:
    out = f"replace({text}, '\\', '\\e')"
    for c in control:
        out = f"replace({out}, '{c}', '{c[0]}\\c{c[1:]}')"
    return out


def op3(probe: str) -> str:
    from .chat import DEFAULT as t

    marks = " ".join(f"WHEN '{n}' THEN {len(r.before) + len(r.after)}" for n, r in t.roles.items())
    text, role = _escaped("text", t.control), _escaped("role", t.control)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{probe}' UNION ALL SELECT -1, 1, 'assistant', '{probe}'
),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    {len(t.begin)} + sum(length({text}) + CASE role {marks} ELSE {sum(map(len, t.other))} + length({role}) END) AS formatted_chars,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM turns GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid
FROM g
"""


OP5 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w, source_size * 3 AS cap FROM s),
c AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all,
    sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS cap_to,
    sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS w_to FROM w
),
k AS (SELECT *, CAST(total - (cap_to - cap) AS DOUBLE) / CAST(w_all - (w_to - w) AS DOUBLE) * w > cap AS stops FROM c),
t AS (
  SELECT source, source_size, coalesce(CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE
    CAST(total - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER () AS DOUBLE) / nullif(CAST(sum(CASE WHEN stops THEN 0 ELSE w END) OVER () AS DOUBLE), 0) * w END, 0.0) AS target FROM k
),
r AS (
  SELECT *, CAST(least(3145728, coalesce(floor(target / nullif(source_size, 0) * 1048576 + 0.5), 0)) AS BIGINT) AS rate,
    CAST('0x' || substr(md5('42|' || coalesce('s' || source, 'null')), 1, 8) AS BIGINT) % 1048576 AS o FROM t
),
p AS (
  SELECT d.doc_id, size, source_size, target, rate, o,
    row_number() OVER (PARTITION BY d.source ORDER BY size, ((coalesce(doc_id, 0) % 1024) + 1024) % 1024, doc_id NULLS FIRST) AS n
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(size * (((n * rate + o) // 1048576) - (((n - 1) * rate + o) // 1048576)) AS BIGINT) AS taken FROM p
"""

OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, upper(sha1(html)) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, CAST(1 + 5 * g AS BIGINT), 5) AS BIGINT) >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII string, a bit at a time."""
    bits = f"flatten(list_transform(range(1, len({text}) + 1), lambda i: [CAST(ascii(substr({text}, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


# Runs of a period q hold equal 5-grams q apart; consecutive such places are one run.
OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents
),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
t AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) END AS w FROM a
),
g AS (SELECT r, n, unnest(range(0, n - 4)) AS i, w FROM t WHERE n > 5),
gram AS (SELECT r, n, i, array_to_string(w[i + 1 : i + 5], ' ') AS five FROM g),
met AS (SELECT x.r, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.r = y.r AND x.five = y.five AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM met),
stretch AS (SELECT r, q, min(i) AS s, max(i) - min(i) + 5 + q AS size FROM island GROUP BY r, q, k),
run AS (SELECT r, s, size, min(q) AS q FROM stretch WHERE size >= greatest(6, 4 * q) GROUP BY r, s, size),
best AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    min({{'a': -size, 'b': s, 'c': q}}) AS b, list({{'s': s, 'e': s + size, 'q': q}}) AS runs
  FROM run GROUP BY r
),
gone AS (SELECT r, list(DISTINCT p) AS p FROM (SELECT r, unnest(range(s + q, s + size)) AS p FROM run) GROUP BY r),
kept AS (
  SELECT t.r, array_to_string(CASE WHEN gone.p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone.p, i - 1)) END, ' ') AS text
  FROM t LEFT JOIN gone USING (r)
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b['b'] AS BIGINT) AS start, CAST(-b['a'] AS BIGINT) AS length, CAST(b['c'] AS BIGINT) AS period,
  CAST(1000 * -b['a'] // b['c'] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(kept.text) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM t LEFT JOIN best USING (r) JOIN kept USING (r)
"""


def _more(path: str, cost: str, edits: str) -> str:
    """A path, its cost in nine digits before its edits, with more of both; so the least string is the cheapest path, ties ASCII-least."""
    return f"(lpad(CAST(CAST(substr({path}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({path}, 10) || '{edits}')"


_SPACE = r"[\x20\x09-\x0D]"
OP13 = rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h FROM conversations
),
rows AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM base WHERE h <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, regexp_replace(text, '{_SPACE}+$', '') AS said FROM rows
),
turns AS (
  SELECT *, said = '' AS blank, said <> '' AND pos > min(pos) OVER (PARTITION BY conv_id, role, text) AS dup, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed
),
kinds AS (SELECT *, NOT blank AND NOT dup AND right(said, 1) NOT IN ('.', '!', '?') AS cut FROM turns),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM kinds GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, {_more("k0", "4", "D")},
    least({_more("k1", "4", "D")}, CASE WHEN NOT gone AND initial = 's' THEN {_more("k0", "3 * t", "K")} END),
    least({_more("k2", "4", "D")}, CASE WHEN NOT gone AND initial = 'u' THEN {_more("ku", "3 * t", "K")} END, CASE WHEN NOT gone THEN {_more("ku", "(3 + 3 * t)", "R")} END),
    least({_more("k3", "4", "D")}, CASE WHEN NOT gone AND initial = 'a' THEN {_more("k2", "3 * t", "K")} END, CASE WHEN NOT gone THEN {_more("k2", "(3 + 3 * t)", "R")} END)
  FROM (
    SELECT *, least(k0, k1, k3) AS ku FROM (
      SELECT k.conv_id, k.pos, k.initial, k.blank OR k.dup AS gone, CAST(k.cut AS INT) AS t, s0 AS k0, s1 AS k1,
        least(s2, {_more("s0", "3", "I")}, {_more("s1", "3", "I")}, {_more("s3", "3", "I")}) AS k2,
        least(s3, {_more("s2", "3", "I")}, {_more("s0", "6", "II")}, {_more("s1", "6", "II")}) AS k3
      FROM path p JOIN kinds k ON p.conv_id = k.conv_id AND k.pos = p.pos + 1
    )
  )
),
best AS (
  SELECT p.conv_id, least(s0, s3, {_more("s2", "3", "I")}, {_more("s1", "6", "II")}) AS b
  FROM path p JOIN (SELECT conv_id, max(pos) AS n FROM kinds GROUP BY conv_id) m ON p.conv_id = m.conv_id AND p.pos = m.n
),
edit AS (SELECT conv_id, substr(b, 10) AS audit, unnest(range(1, CAST(length(b) - 8 AS BIGINT))) AS i, length(replace(substr(b, 10), 'D', '')) % 2 AS lead FROM best),
letter AS (SELECT conv_id, i, lead, audit[i] AS e, length(replace(audit[1:i], 'I', '')) AS pos, length(replace(audit[1:i - 1], 'D', '')) AS k FROM edit),
line AS (
  SELECT l.conv_id, l.i, CASE WHEN e = 'K' THEN role WHEN (k + lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line
  FROM letter l LEFT JOIN kinds k ON l.conv_id = k.conv_id AND l.pos = k.pos WHERE e <> 'D'
),
text AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS text FROM line GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
    count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM kinds GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(substr(b, 1, 9) AS INT), 0) AS BIGINT) AS cost,
  coalesce(substr(b, 10), '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN text USING (conv_id)
"""

OP11 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM d),
c AS (SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) ELSE 'none ' || r END AS k, s FROM s),
node AS (SELECT k, min(doc_id) AS low, any_value(n) AS n, any_value(s) AS s FROM c GROUP BY k),
shingle AS (SELECT k, n, unnest(s) AS g FROM node),
pair AS (SELECT a.k AS x, b.k AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS met FROM shingle a JOIN shingle b USING (g) WHERE a.k < b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.k, b.k),
link AS (SELECT x, y FROM pair WHERE 100 * met >= 85 * (m + n - met)),
ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT k AS x, k AS y FROM node UNION SELECT r.x, w.y FROM reach r JOIN ways w ON r.y = w.x),
least AS (SELECT r.x AS k, min(low) AS component_id FROM reach r JOIN node ON r.y = node.k GROUP BY r.x)
SELECT doc_id, n AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM c JOIN least USING (k)
"""
