"""DuckDB SQL of queries whose results SQL can state, written out apart from the operators."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of every length that an item has, looked up at every word of every document.
OP13_SQL = rf"""WITH item AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM item WHERE len(w) > 0
), item_window AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS s FROM sized
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), doc_window AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS spot, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS s
  FROM doc, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n
), met AS (
  SELECT r, d.n, spot, item_id FROM doc_window d JOIN item_window i ON d.s = i.s AND d.n = i.n
), hit AS (
  SELECT r, COUNT(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(spot, spot + n)) AS place FROM met) GROUP BY r
), named AS (
  SELECT r, COUNT(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


#: CRC-32 of a list of bytes, by table.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc32(byte_list: str) -> str:
    return f"xor(list_reduce([4294967295] || {byte_list}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _least(*of: str) -> str:
    return f"list_min([{', '.join(of)}])"


def _edit(state: str, op: str, cost: str, line: str | None = None) -> str:
    text = f"CASE WHEN {state}.t = '' THEN {line} ELSE {state}.t || chr(10) || {line} END" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'p': {state}.p || '{op}', 't': {text}}} END"


def _op12_sql() -> str:
    """One row of every conversation a round: the cheapest (cost, edits, text) that ends with no row, s, u or a."""
    insert_u, insert_a = "'user:'", "'assistant:'"
    free = "NOT blank AND NOT again"
    extra = "CASE WHEN cut THEN 5 ELSE 0 END"

    def kept(initial: str, state: str) -> str:
        return f"CASE WHEN {free} AND initial = '{initial}' THEN {_edit(state, 'K', extra, "(role || ':' || text)")} END"

    def rerole(role: str, state: str) -> str:
        return f"CASE WHEN {free} THEN {_edit(state, 'R', f'1 + {extra}', f"('{role}:' || text)")} END"

    u = _least("u", _edit("n", "I", "5", insert_u), _edit("s", "I", "5", insert_u), _edit("a", "I", "5", insert_u))
    state = "STRUCT(c BIGINT, p VARCHAR, t VARCHAR)"
    return rf"""WITH RECURSIVE crc AS ({_CRC_TABLE}), src AS (
  SELECT row_number() OVER () AS place, conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
    string_split(COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' '), '') AS k
  FROM conversations
), judged AS (
  SELECT *, {_crc32("list_transform(k, lambda x: ord(x))")} % 20 AS how FROM src, crc
), damaged AS (
  SELECT place, copy, conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM judged WHERE how <> 0)
), flagged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, place, copy) > 1 AS again,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, place, copy) AS i
  FROM damaged
), counted AS (
  SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (blank) AS blank,
    COUNT(*) FILTER (again AND NOT blank) AS duplicate, COUNT(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
    COUNT(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, MAX(i) AS n_rows
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM flagged) GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'c': 0, 'p': '', 't': ''}} AS {state}) AS n,
    CAST(NULL AS {state}) AS s, CAST(NULL AS {state}) AS u, CAST(NULL AS {state}) AS a FROM counted
  UNION ALL
  SELECT conv_id, i, {_edit("n", "D", "2")}, {_least(_edit("s", "D", "2"), kept("s", "n"))},
    {_least(_edit("u", "D", "2"), *[f(x, y) for y in ("n", "s", "a") for f, x in ((kept, "u"), (rerole, "user"))])},
    {_least(_edit("a", "D", "2"), kept("a", "u"), rerole("assistant", "u"))}
  FROM (SELECT x.conv_id, f.i, n, s, u, {_least("a", _edit("u", "I", "5", insert_a))} AS a, role, text, initial, blank, cut, again
    FROM (SELECT conv_id, i, n, s, a, {u} AS u FROM walk) x JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1)
), ended AS (
  SELECT w.conv_id, {_least("n", "a", _edit("u", "I", "5", insert_a), _edit("s2", "I", "5", insert_a))} AS best
  FROM (SELECT *, {_edit("s", "I", "5", insert_u)} AS s2 FROM walk) w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n_rows
)
SELECT o.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
  COALESCE(illegal, 0) AS illegal, COALESCE(best.c, 0) AS cost, COALESCE(best.p, '') AS audit, sha256(COALESCE(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


OP12_SQL = _op12_sql()


#: Near words meet as equal deletions (one each, with its place) or as a word and its deletion.
OP11_SQL = rf"""WITH RECURSIVE crc AS ({_CRC_TABLE}), run AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents
), once AS (
  SELECT doc_id, w, COUNT(*) AS c, hex(encode(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM run WHERE length(w) >= 5 GROUP BY doc_id, w
), hashed AS (
  SELECT w, c, {_crc32("list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))")} AS h FROM once, crc
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed
), vocabulary AS (
  SELECT word, CAST(SUM(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING SUM(c) >= 3
), deleted AS (
  SELECT DISTINCT word, n, unnest(range(1, length(word) + 1)) AS place, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS rest
  FROM vocabulary
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM deleted a JOIN deleted b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION
  SELECT d.word, v.word, v.n FROM deleted d JOIN vocabulary v ON v.word = d.rest
  UNION
  SELECT v.word, d.word, d.n FROM deleted d JOIN vocabulary v ON v.word = d.rest
), best AS (
  SELECT word, COUNT(*) AS n_near, min({{'low': -other_n, 'other': other}}) AS b FROM near GROUP BY word
), formed AS (
  SELECT v.word, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN -b.low >= 2 * v.n THEN b.other END AS form, CASE WHEN -b.low >= 2 * v.n THEN -b.low END AS form_n
  FROM vocabulary v LEFT JOIN best ON best.word = v.word
), path AS (
  SELECT word, word AS root, form AS ahead FROM formed
  UNION ALL
  SELECT p.word, f.word, f.form FROM path p JOIN formed f ON f.word = p.ahead
)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN path p ON p.word = f.word AND p.ahead IS NULL"""
