"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH RECURSIVE doc AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
  FROM doc WHERE len(w) > 0),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, s FROM sets GROUP BY s),
items AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM classes),
common AS (SELECT a.c AS u, b.c AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM items a JOIN items b ON a.x = b.x AND a.c < b.c GROUP BY 1, 2),
links AS MATERIALIZED (SELECT u, v FROM common WHERE 100 * k >= 75 * (n + m - k)),
both_ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT c AS node, c AS place FROM classes UNION SELECT r.node, e.v FROM reach r JOIN both_ways e ON r.place = e.u),
lowest AS (SELECT node, min(place) AS component FROM reach GROUP BY node),
own AS (SELECT s.doc_id, len(s.s) AS n, l.component FROM sets s JOIN classes c ON s.s = c.s JOIN lowest l ON l.node = c.c)
SELECT d.doc_id, coalesce(o.n, 0)::BIGINT AS n_shingles, coalesce(o.component, d.doc_id) AS component_id,
  coalesce(o.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN own o USING (doc_id)
"""

OP10 = f"""
WITH doc AS MATERIALIZED (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc WHERE len(w) >= 20),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
removed AS (SELECT doc_id, list(i) AS off FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM doc),
kept AS (SELECT w.doc_id, string_agg(x, ' ' ORDER BY w.i) AS t FROM word w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(r.off), 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM doc d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"

OP2 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t.i, CASE WHEN t.i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS t(i))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 23)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP8 = """
WITH good AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
WHERE rank <= 5
"""


def _crc32(data: str) -> str:
    """crc32 of a list of bytes: each enters at the first of eight steps of the reflected polynomial."""
    steps = f"list_prepend(4294967295::BIGINT, flatten(list_transform({data}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0])))"
    return f"xor(list_reduce({steps}, lambda c, x: xor(xor(c, x) // 2, (xor(c, x) % 2) * 3988292384)), 4294967295)"


def _bytes(text: str) -> str:
    return f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"


OP12 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]{{7,}}')) AS w FROM documents) GROUP BY doc_id, w),
coded AS (SELECT w, k, {_bytes("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS b FROM runs),
hashed AS MATERIALIZED (SELECT w, k, {_crc32('b')} AS h FROM coded),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
one_way AS (
  SELECT a.word AS u, b.word AS v FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cut SEMI JOIN (SELECT word AS rest FROM words) w USING (rest)),
pairs AS MATERIALIZED (SELECT u, v FROM one_way UNION SELECT v, u FROM one_way),
best AS (SELECT u, count(*) AS n_near, min({{'less': -w.n, 'word': v}}) AS b FROM pairs JOIN words w ON w.word = v GROUP BY u),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.b.less >= 10 * w.n THEN b.b.word END AS form,
    CASE WHEN -b.b.less >= 10 * w.n THEN -b.b.less END AS form_n FROM words w LEFT JOIN best b ON b.u = w.word),
follow AS (SELECT word, word AS place, form AS next FROM forms UNION ALL SELECT f.word, f.next, g.form FROM follow f JOIN forms g ON g.word = f.next)
SELECT f.word, f.form, l.place AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN follow l ON l.word = f.word AND l.next IS NULL
"""


def _repair_step(state: int) -> str:
    """Cheapest (cost, audit) in ``state`` behind a row, from those before it with their insertions."""

    def arc(edit: str, cost: str, before: int, when: str) -> str:
        return f"CASE WHEN {when} THEN {{'c': v[{before + 1}].c + {cost}, 'a': v[{before + 1}].a || '{edit}'}} END"

    stays, more = "fault NOT IN ('blank', 'duplicate')", "CASE fault WHEN 'truncated' THEN 3 ELSE 0 END"
    arcs = [arc("D", "4", state, "true")]
    for before, role, to in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)):
        if to == state:
            arcs.append(arc("K", more, before, f"{stays} AND r = '{role}'"))
            if role != "s":
                arcs.append(arc("R", f"3 + {more}", before, stays))
    return f"list_min([{', '.join(arcs)}])"


def _inserted(v: str) -> str:
    """``v`` with one more insertion where that is cheaper: into the state after u from all others, into the state after a from that after u."""

    def more(i: int) -> str:
        return f"{{'c': {v}[{i}].c + 3, 'a': {v}[{i}].a || 'I'}}"

    return f"[{v}[1], {v}[2], list_min([{v}[3], {more(1)}, {more(2)}, {more(4)}]), list_min([{v}[4], {more(3)}])]"


OP13 = f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_bytes("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} AS b FROM conversations),
hashed AS MATERIALIZED (SELECT conv_id, turn, role, text, {_crc32('b')} % 20 AS k FROM coded),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(CASE k WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS r, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
faulty AS MATERIALIZED (
  SELECT *, CASE WHEN t = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM marked),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}] AS v FROM counted
  UNION ALL
  SELECT conv_id, i, [{', '.join(map(_repair_step, range(4)))}] FROM (
    SELECT f.conv_id, f.i, f.fault, f.r, {_inserted('v1')} AS v FROM (
      SELECT w.conv_id, w.i, {_inserted('w.v')} AS v1 FROM walk w) w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
ended AS (
  SELECT conv_id, list_min([v[1], v[4]]) AS e FROM (
    SELECT conv_id, {_inserted('v1')} AS v FROM (SELECT w.conv_id, {_inserted('w.v')} AS v1 FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i))),
edits AS (
  SELECT conv_id, e.c AS cost, e.a AS audit, unnest(range(1, length(e.a) + 1)) AS j FROM ended),
steps AS (
  SELECT conv_id, j, audit[j] AS edit, sum(CASE audit[j] WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS i,
    sum(CASE audit[j] WHEN 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS place FROM edits),
rows AS (
  SELECT s.*, f.role, f.text, f.r, max(CASE WHEN edit = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS system
  FROM steps s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = greatest(s.i, 1) WHERE edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS t FROM rows GROUP BY conv_id)
SELECT d.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.e.c, 0) AS cost, coalesce(e.e.a, '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
"""
