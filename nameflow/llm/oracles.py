"""DuckDB SQL that says what queries of this subpackage return, written from their contracts alone."""

from __future__ import annotations

from . import lines

_WORD = r"'[^\x20\x09-\x0D]+'"
#: A-Z alone in lower case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of ASCII text."""
    byte = "list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {byte}), 4294967295)"


OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, len(regexp_extract_all(text, '</turn>|### ')) AS marks,
    length(role) + len(regexp_extract_all(role, '[\\\n]')) AS role_chars FROM rows
), told AS (
  SELECT conv_id, count(*) AS n_turns, max(marks) > 0 AS marked,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
    sum(length(text) + marks + role_chars + length('### ') + length(':') + length('</turn>') + 3) AS chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt)::bigint AS loss_chars, sha256(learnt) AS loss_sha256,
  (length('<conv 0>') + 1 + chars)::bigint AS formatted_chars, marked::int AS level
FROM told
"""

OP4 = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents
), grams AS (
  SELECT DISTINCT r, doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM rows)
), sizes AS (SELECT r, doc_id, count(*) AS n FROM grams GROUP BY ALL),
common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM common JOIN sizes a ON x = a.r JOIN sizes b ON y = b.r
  WHERE 100 * shared >= 80 * (a.n + b.n - shared)
), reach AS (
  SELECT u AS doc_id, v AS other FROM links UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.other = links.u
), least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT rows.doc_id, coalesce(n, 0) AS n_shingles, least(rows.doc_id, coalesce(other, rows.doc_id)) AS component_id
FROM rows LEFT JOIN sizes ON rows.r = sizes.r LEFT JOIN least ON rows.doc_id = least.doc_id
"""

_SEPARATED = r"[\x20\x09-\x0D|»›•·>/,-]"
_PHRASES = " OR ".join(f"contains(low, {_quoted(p)})" for p in lines.BOILERPLATE)
OP6 = rf"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), tokens AS (SELECT r, regexp_extract_all(t, {_WORD}) AS w FROM rows),
placed AS (
  SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM tokens WHERE len(w) >= 5
), twice AS (SELECT r, i FROM placed QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeated AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS i FROM twice, range(5) AS x(k)) GROUP BY r),
parts AS (
  SELECT r, s, lower(s) AS low, list_sum(list_transform(regexp_extract_all(s, {_WORD}), lambda x: length(x))) AS chars,
    len(regexp_extract_all(s, {_WORD})) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS s FROM rows)
), judged AS (
  SELECT *, coalesce(chars, 0) AS c, n > 0 AND (
    len(regexp_extract_all(s, '[#*$%&|<>]')) > {lines.MOST_SYMBOLS_PER_WORD} * n
    OR 100 * len(regexp_extract_all(s, '[^\p{{L}}\p{{M}}\p{{N}}\x20\x09-\x0D]')) > {lines.MOST_MARKS_PERCENT} * chars
    OR (len(regexp_extract_all(s, '[|»›•·]| > | / ')) >= {lines.LEAST_SEPARATORS}
        AND n <= {lines.WORDS_PER_SEPARATOR} * (len(regexp_extract_all(s, '[|»›•·]| > | / ')) + 1) + len(regexp_extract_all(s, '[|»›•·]| > | / ')))
    OR regexp_full_match(low, '{_SEPARATED}*((?:{'|'.join(lines.NAVIGATION)})(?:{_SEPARATED}+|$))+')
    OR (n <= {lines.BOILERPLATE_WORDS} AND ({_PHRASES}))
  ) AS fails FROM parts
), said AS (
  SELECT r, sum(n) AS n_words, sum(c) AS word_chars, sum(n) FILTER (WHERE NOT fails) AS words_left, sum(c) FILTER (WHERE NOT fails) AS chars_left,
    count(*) FILTER (WHERE fails) AS removed, count(*) FILTER (WHERE n > 0) - count(DISTINCT s) FILTER (WHERE n > 0) AS dup
  FROM judged GROUP BY r
), about AS (
  SELECT doc_id, t, said.*, coalesce(repeated.n, 0) AS again, n_words < 10 OR 100 * coalesce(repeated.n, 0) > 20 * n_words AS failed
  FROM rows JOIN said ON rows.r = said.r LEFT JOIN repeated ON rows.r = repeated.r
)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint AS n_symbols,
  dup::bigint AS n_dup_lines, again::bigint AS n_repeat_words, failed AS base_failed,
  NOT failed AND 100 * (word_chars - coalesce(chars_left, 0)) <= {lines.MOST_LOSS_PERCENT} * word_chars AND coalesce(words_left, 0) >= {lines.LEAST_WORDS} AS kept,
  removed::bigint AS n_lines_removed
FROM about
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP7 = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents
), items AS (SELECT item_id::varchar AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 8) AS size, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM rows, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), found AS (SELECT r, i, windows.size, item FROM places JOIN windows ON places.size = windows.size AND places.g = windows.g),
hits AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(named.n, 0) >= 2 AS contaminated
FROM rows LEFT JOIN hits ON rows.r = hits.r LEFT JOIN named ON rows.r = named.r
"""

#: Counts by the patterns; the digest of positions is beyond DuckDB's functions.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_DOUBLED = f"list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 1 THEN (2 * substr({_DIGITS}, i, 1)::int) // 10 + (2 * substr({_DIGITS}, i, 1)::int) % 10 ELSE substr({_DIGITS}, i, 1)::int END)"
BASE8 = rf"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))::bigint AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'), lambda m:
    list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE ('0' || ltrim(p, '0'))::int END)) <= 255))::bigint AS n_ip,
  len(list_filter(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda m: length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum({_DOUBLED}) % 10 = 0))::bigint AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length({_DIGITS}) BETWEEN 10 AND 15))::bigint AS n_phone
FROM rows
"""

BASE10 = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, list_append(regexp_extract_all({_LOWER}, {_WORD}), ' ') AS w,
    doc_id IS NOT NULL AND {_crc32("doc_id::varchar")} % 5 = 1 AS held_out FROM documents
), tokens AS (SELECT r, held_out, unnest(w) AS w FROM rows),
counts AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
whole AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts),
scored AS (
  SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base
  FROM tokens LEFT JOIN counts USING (w), whole GROUP BY r
)
SELECT doc_id, held_out, n_tokens, n_known, n::bigint AS train_tokens, round(base, 6) AS base_score FROM rows JOIN scored USING (r), whole
"""
