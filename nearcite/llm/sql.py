"""The same results in DuckDB SQL, for the operators whose results do not depend on models or samples.

The methods find candidates by hashes and confirm them exactly, so SQL that compares everything must agree.
"""

from __future__ import annotations

from nearcite.llm.license_scan import CONTAINMENT, PHRASES, TEMPLATES

_SPACE = r"[\x20\x09-\x0D]+"
_BARE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDED = r"[^\x20\x09-\x0D]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, breaks: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{breaks}'), lambda x: x <> '')"


NEAR_DEDUP = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')", _SPACE)} AS w FROM documents),
members AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS sh
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM texts WHERE len(w) > 0))),
sizes AS (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
classes AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY content) AS class FROM (
    SELECT doc_id, count(*) AS n, string_agg(sh, '|' ORDER BY sh) AS content FROM members GROUP BY doc_id)),
heads AS (SELECT class AS a, any_value(n) AS n FROM classes GROUP BY class),
links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM members x JOIN members y USING (sh)
    JOIN heads h ON h.a = x.doc_id JOIN heads i ON i.a = y.doc_id WHERE x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN heads h ON h.a = p.a JOIN heads i ON i.a = p.b WHERE 100 * both_have >= 80 * (h.n + i.n - both_have)),
reach(node, other) AS (
  SELECT a, a FROM heads
  UNION SELECT r.node, l.o FROM reach r JOIN (SELECT a AS s, b AS o FROM links UNION SELECT b, a FROM links) l ON l.s = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT t.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(r.root, t.doc_id) AS component_id,
  t.doc_id = coalesce(r.root, t.doc_id) AS kept
FROM texts t LEFT JOIN classes c USING (doc_id) LEFT JOIN roots r ON r.node = c.class"""

QUALITY_RULES = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, {_words('t', _SPACE)} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDED}')) AS l FROM texts),
places AS (
  SELECT k, i, concat_ws(' ', x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, lead(x, 4) OVER o AS last
  FROM (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM parts) WINDOW o AS (PARTITION BY k ORDER BY i)),
windows AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM places WHERE last IS NOT NULL),
repeats AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM windows WHERE c > 1) GROUP BY k),
measures AS (
  SELECT doc_id, w, l, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM parts LEFT JOIN repeats USING (k)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    10 * n_symbols > word_chars
    OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
    OR word_chars > 40 * n_words OR 2 * word_chars < 3 * n_words
    OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '^[^a-z]*[A-Z]{{2}}[^a-z]*$'))) > n_words
    OR 2 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) > n_words
    OR (n_words >= 20 AND 10 * list_sum(list_transform(range(1, n_words + 1, 1000), lambda i: len(list_distinct(w[i:i + 999])))) < n_words)
    OR (n_lines >= 4 AND 2 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > n_lines)
    OR (n_lines >= 4 AND 10 * len(list_filter(l, lambda x: regexp_matches(x, '^\s*[•*\-]\s'))) > 9 * n_lines) AS bad
  FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM judged"""

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
worded AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM lines WHERE regexp_matches(line, '{_WORDED}')),
windows AS (
  SELECT doc_id, i, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c, lead(i, 2) OVER d AS last
  FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, last + 1)) AS i FROM later)
SELECT t.doc_id, CASE WHEN k.n > 0 THEN k.rest ELSE t.text END AS text, coalesce(k.n, 0)::BIGINT AS n_removed
FROM documents t LEFT JOIN (
  SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (c.i IS NULL), '') AS rest, count(c.i) AS n
  FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.i = l.i GROUP BY l.doc_id) k ON k.doc_id = t.doc_id"""


def _shingled(table: str, key: str) -> str:
    return f"""
  SELECT {key}, i - 1 AS pos, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS sh,
    greatest(len(w) - 4, 1) AS n
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM (
    SELECT {key}, {_words("lower(coalesce(text, ''))", _BARE)} AS w FROM {table}) WHERE len(w) > 0)"""


DECONTAMINATION = f"""
WITH doc_sh AS ({_shingled('documents', 'doc_id')}),
item_sh AS ({_shingled('benchmark', 'item_id')}),
windows AS (
  SELECT DISTINCT doc_id, size, unnest(range(greatest(0, least(pos - size + 1, n - size)), greatest(0, least(pos, n - size)) + 1)) AS start
  FROM (SELECT DISTINCT d.doc_id, d.pos, d.n, b.n AS size FROM doc_sh d JOIN item_sh b USING (sh))),
held AS (
  SELECT w.doc_id, w.size, w.start, d.sh, count(*) AS c
  FROM windows w JOIN doc_sh d ON d.doc_id = w.doc_id AND d.pos >= w.start AND d.pos < w.start + w.size GROUP BY ALL),
wanted AS (SELECT item_id, n AS size, sh, count(*) AS c FROM item_sh GROUP BY ALL),
common AS (
  SELECT h.doc_id, h.start, h.size, w.item_id, sum(least(h.c, w.c)) AS both_have
  FROM held h JOIN wanted w USING (size, sh) GROUP BY ALL),
totals AS (SELECT doc_id, start, size, sum(c) AS n FROM held GROUP BY ALL),
scored AS (
  SELECT doc_id, start, item_id, both_have / (n + size - both_have) AS similarity FROM common JOIN totals USING (doc_id, start, size))
SELECT doc_id, item_id, similarity::DOUBLE AS similarity, start::BIGINT AS start_word FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS place FROM scored WHERE similarity >= 0.8)
WHERE place = 1"""


def _license_scan() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    places = " UNION ALL ".join(
        f"SELECT k, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i+{len(p.split()) - 1}] = {p.split()})) - 1 AS pos, '{label}' AS label FROM texts"
        for p, label in PHRASES.items()
    )
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(text)}, {quoted(names)})" for i, (label, text, names) in enumerate(TEMPLATES))
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
    {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')", _BARE)} AS w FROM documents),
places AS ({places}),
base AS (
  SELECT k, count(*) AS n, min(pos) AS first, max(pos) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY k),
templates AS (
  SELECT label, list_distinct({_words('lower(text)', _BARE)}) AS need, {_words('names', _BARE)} AS names,
    ceil(len({_words('lower(text)', _BARE)}) / {CONTAINMENT} - 1e-9)::BIGINT AS run FROM (VALUES {templates}) v(i, label, text, names)),
bare AS (SELECT k, {_words('lower(t)', _BARE)} AS x FROM texts),
tried AS (
  SELECT k, label, need, names, run, x, unnest(range(1, len(x) + 1)) AS i
  FROM bare, templates WHERE len(list_intersect(need, x)) >= {CONTAINMENT} * len(need) - 1e-9),
blocks AS (SELECT k, label, need, names, list_distinct(x[i:i + run - 1]) AS have FROM tried),
found AS (
  SELECT k, label, max(share) AS share FROM (
    SELECT k, label, len(list_intersect(need, have)) / len(need) AS share FROM blocks WHERE list_has_all(have, names))
  WHERE share >= {CONTAINMENT} - 1e-9 GROUP BY k, label),
labelled AS (
  SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
    SELECT k, label FROM found UNION SELECT k, label FROM places) GROUP BY k),
scored AS (SELECT k, max(share) AS share FROM found GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1 ELSE coalesce(s.share, 0) END::DOUBLE AS score
FROM texts LEFT JOIN base b USING (k) LEFT JOIN labelled l USING (k) LEFT JOIN scored s USING (k)"""


LICENSE_SCAN = _license_scan()


RANKED_SEARCH = f"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, {_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')", _BARE)} AS w FROM documents),
totals AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM docs WHERE len(w) > 0),
asked AS (
  SELECT DISTINCT item_id, unnest({_words(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')", _BARE)}) AS term FROM benchmark),
held AS (
  SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(totals.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, totals GROUP BY term),
scored AS (
  SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * held.n * totals.n) // totals.l))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY item_id, k, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50"""

FILTER_AUDIT = f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
measured AS (SELECT *, {_words('t', _SPACE)} AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM docs),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask
  FROM measured LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [a, b, c, d, e] AS o FROM (SELECT l.x AS a, m.x AS b, n.x AS c, p.x AS d, q.x AS e
    FROM letters l, letters m, letters n, letters p, letters q) WHERE len(list_distinct([a, b, c, d, e])) = 5),
steps AS (
  SELECT array_to_string(o, '') AS filter_order, step, bit,
    coalesce((SELECT sum(b.bit) FROM letters b WHERE list_position(o, b.x) < step), 0)::INTEGER AS before
  FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders) JOIN letters ON letters.x = o[step]),
audit AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM audit"""
