"""Plain SQL for every registered query, over the same parquet tables.

Common tables are written once; ``sql`` puts those that a statement names, directly or not, in front.
"""

from __future__ import annotations

import re

from nearcite.functions.text import CPC_LABELS, LOWEST_TIER, SCORE_TIERS
from nearcite.operators.context import (
    CITATIONS_HEADING,
    GRAPH_TEMPLATE,
    IMPORTANT_HEADING,
    PLAIN_TEMPLATE,
    SHARED_HEADING,
)


def _pub(vec_id: str) -> str:
    kinds = f"CASE ({vec_id}) % 10 WHEN 0 THEN '-A1' WHEN 1 THEN '-B1' WHEN 9 THEN '-E1' ELSE '-B2' END"
    return f"'US-' || (8000000 + ({vec_id})) || {kinds}"


def _date(column: str) -> str:
    digits = f"({column})::VARCHAR"
    return (
        f"CASE WHEN {column} IS NULL OR {column} = 0 THEN 'N/A' WHEN length({digits}) = 8 THEN "
        f"substr({digits}, 1, 4) || '-' || substr({digits}, 5, 2) || '-' || substr({digits}, 7, 2) ELSE {digits} END"
    )


def _text(literal: str) -> str:
    return "'" + literal.replace("'", "''") + "'"


def _r(value: str, digits: int = 6) -> str:
    """Rounding that exact halves do not split."""
    return f"round({value} + 1e-{digits + 4}, {digits})"


def _pct(score: str) -> str:
    return f"CASE WHEN {score} IS NOT NULL THEN least(greatest({score} * 100, 0), 100) END"


def _unit(score: str) -> str:
    return f"least(greatest(coalesce({score}, 0), 0), 1)"


def _tier(score: str, what: int) -> str:
    cases = " ".join(
        f"WHEN {score} * 100 >= {tier[0]} THEN {tier[what] if what == 1 else _text(tier[what])}" for tier in SCORE_TIERS
    )
    last = LOWEST_TIER[what - 1]
    return f"CASE {cases} ELSE {last if what == 1 else _text(last)} END"


def _names(column: str) -> str:
    return f"(SELECT string_agg(coalesce(name, ''), '|' ORDER BY pos) FROM {column} x WHERE x.vec_id = c.vec_id)"


def _list(rel: str) -> str:
    return (
        "coalesce((SELECT string_agg(other, '|' ORDER BY pos) FROM rel x "
        f"WHERE x.owner_id = c.vec_id AND x.rel = '{rel}'), '')"
    )


_LABELS = "CASE section " + " ".join(f"WHEN '{k}' THEN {_text(v)}" for k, v in CPC_LABELS.items()) + " ELSE section END"

_REL_NO = "CASE rel WHEN 'citation' THEN 0 WHEN 'cited_by' THEN 1 WHEN 'parent' THEN 2 ELSE 3 END"
_EDGE_TYPE = "CASE rel_no WHEN 0 THEN 'cites' WHEN 1 THEN 'cited_by' WHEN 2 THEN 'parent' ELSE 'child' END"


def _rel(where: str) -> str:
    return f"""
    SELECT owner_id, rel, {_REL_NO} AS rel_no, other,
      row_number() OVER (PARTITION BY owner_id, rel ORDER BY o_orderkey) AS pos
    FROM (SELECT o_orderkey, o_orderkey % n_emb AS owner_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'citation' WHEN '2-HIGH' THEN 'citation'
          WHEN '3-MEDIUM' THEN 'cited_by' WHEN '4-NOT SPECIFIED' THEN 'parent' ELSE 'child' END AS rel,
        {_pub("o_custkey * 7 % (n_emb + n_emb // 10)")} AS other
      FROM orders, n {where})"""


def _nearest(queries: str, corpus: str, key: str, distance: str, k: int) -> str:
    return f"""
    SELECT query_id, {key}, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, {key}) AS rn FROM (
        SELECT q.query_id, c.{key}, {distance} AS distance FROM {queries} q, {corpus} c))
    WHERE rn <= {k}"""


_COSINE = "greatest(round(1 - list_cosine_similarity(q.vec, c.vec), 12), 0)"

_DISPLAY = f"""c.title_value AS title_text, coalesce(c.abstract_value, '') AS abstract_text,
      c.primary_assignee, c.primary_inventor, {_date('c.filing_date')} AS filed,
      {_date('c.publication_date')} AS published, {_date('c.grant_date')} AS granted"""


def _ranked(score: str) -> str:
    return f"""
    SELECT s.*, {_DISPLAY}, c.vec_id,
      row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 12) DESC, s.publication_number) AS rank
    FROM (SELECT *, CASE WHEN ppr_available THEN {score} ELSE similarity END AS score FROM scored) s
    JOIN corpus c USING (publication_number)"""


def _numbered(found: str) -> str:
    return f"""
    SELECT *, publication_number = query_id OR (NOT has_self AND row_no = 1) AS is_query FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, publication_number) AS row_no,
        bool_or(publication_number = query_id) OVER (PARTITION BY query_id) AS has_self FROM {found})"""


def _neighbors(cap: int | None) -> str:
    return f"""
    SELECT query_id, publication_number, neighbor_order FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_seen) AS neighbor_order FROM (
        SELECT f.query_id, l.other AS publication_number,
          min(f.row_no * 4398046511104 + l.rel_no * 1099511627776 + l.pos) AS first_seen
        FROM found f JOIN links l USING (publication_number)
        WHERE NOT EXISTS (SELECT 1 FROM found x WHERE x.query_id = f.query_id AND x.publication_number = l.other)
        GROUP BY f.query_id, l.other))
    WHERE neighbor_order <= {cap or 'neighbor_order'}"""


def _power(nodes: str, edges: str, keep: str) -> str:
    """Personalised PageRank as a recursion that drops a query once it has converged."""
    return f"""
    SELECT query_id, node, is_seed, deg, nn, 1e0 / nn AS r, 0 AS it, 1e9 AS err FROM {nodes}
    UNION ALL
    SELECT query_id, node, is_seed, deg, nn, nr, it + 1, sum(abs(nr - r)) OVER (PARTITION BY query_id) FROM (
      SELECT p.*, 0.85::DOUBLE * coalesce(c.v, 0)
          + CASE WHEN p.is_seed THEN 0.85::DOUBLE * coalesce(d.m, 0) + 0.15::DOUBLE ELSE 0 END AS nr
      FROM {keep} p
      LEFT JOIN (SELECT e.query_id, e.dst, sum(q.r / q.deg) AS v FROM {keep} q
          JOIN {edges} e ON e.query_id = q.query_id AND e.src = q.node GROUP BY e.query_id, e.dst) c
        ON c.query_id = p.query_id AND c.dst = p.node
      LEFT JOIN (SELECT query_id, sum(r) AS m FROM {keep} WHERE deg = 0 GROUP BY query_id) d ON d.query_id = p.query_id
      WHERE p.it < 100 AND p.err >= p.nn * 1e-6)"""


def _power_nodes(nodes: str, edges: str) -> str:
    return f"""
    SELECT n.query_id, n.node, n.is_seed, coalesce(d.c, 0) AS deg, count(*) OVER (PARTITION BY n.query_id) AS nn
    FROM {nodes} n
    LEFT JOIN (SELECT query_id, src, count(*) AS c FROM {edges} GROUP BY query_id, src) d
      ON d.query_id = n.query_id AND d.src = n.node
    WHERE n.query_id IN (SELECT query_id FROM {edges})"""


def _shown_edges(condition: str) -> str:
    """Edges of the view: similar ones, then links that meet the condition."""
    return f"""
    SELECT query_id, query_id AS src, publication_number AS dst, 'similar' AS kind,
      'Score: ' || trunc({_unit('score')} * 100)::INTEGER || '%' AS title, 1 + {_unit('score')} * 2 AS width,
      '#105BD8' AS color, 0.4::DOUBLE AS opacity, false AS dashes
    FROM (SELECT query_id, publication_number, score FROM ranked UNION ALL
      SELECT query_id, publication_number, NULL FROM found WHERE is_query AND publication_number <> query_id)
    UNION ALL
    SELECT a.query_id, CASE WHEN l.rel_no IN (1, 2) THEN l.other ELSE a.publication_number END,
      CASE WHEN l.rel_no IN (1, 2) THEN a.publication_number ELSE l.other END,
      {_EDGE_TYPE}, CASE rel_no WHEN 0 THEN 'Cites' WHEN 1 THEN 'Cited by' WHEN 2 THEN 'Parent' ELSE 'Child' END,
      CASE WHEN rel_no < 2 THEN 1.0 ELSE 1.5 END::DOUBLE,
      CASE rel_no WHEN 0 THEN '#4773AA' WHEN 1 THEN '#8BA6CA' WHEN 2 THEN '#FF9D1E' ELSE '#DD361C' END,
      CASE WHEN rel_no < 2 THEN 0.3 ELSE 0.4 END::DOUBLE, rel_no < 2
    FROM {_MEMBERS} a JOIN links l USING (publication_number)
    JOIN {_MEMBERS} b ON b.query_id = a.query_id AND b.publication_number = l.other
    {condition}"""


def _counted(rows: str, item: str, limit: str = "") -> str:
    """Top counts per query of ``rows`` (query_id, row_no, pos, item)."""
    return f"""
    SELECT query_id, place::INTEGER AS place, {item}, n FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first_seen, {item}) AS place FROM (
        SELECT query_id, {item}, count(*) AS n, min(row_no * 4294967296 + pos) AS first_seen
        FROM ({rows}) GROUP BY query_id, {item})) {limit}"""


def _unnested(rows: str, table: str, item: str, order: str, where: str) -> str:
    return f"""SELECT r.query_id, r.{order} AS row_no, t.pos, {item}
      FROM {rows} r JOIN corpus c USING (publication_number) JOIN {table} t ON t.vec_id = c.vec_id WHERE {where}"""


_MEMBERS = "(SELECT query_id, publication_number FROM found UNION ALL SELECT query_id, publication_number FROM expanded)"

TABLES: dict[str, str] = {
    "n": """
    SELECT (SELECT count(*) FROM embeddings) AS n_emb, (SELECT count(*) FROM part) AS n_part,
      (SELECT count(*) FROM documents) AS n_doc""",
    "docs": f"""
    SELECT e.vec_id, e.label, e.embedding::DOUBLE[] AS vec, {_pub("e.vec_id")} AS publication_number,
      (14000000 + e.vec_id * 3)::VARCHAR AS application_number,
      ((2000 + e.vec_id % 25) * 10000 + (1 + e.vec_id % 12) * 100 + 1 + e.vec_id % 28)::INTEGER AS filing_date,
      ((2002 + e.vec_id % 25) * 10000 + (1 + e.vec_id % 12) * 100 + 1 + e.vec_id % 28)::INTEGER AS publication_date,
      CASE WHEN e.vec_id % 10 <> 0 THEN
        ((2004 + e.vec_id % 25) * 10000 + (1 + e.vec_id % 12) * 100 + 1 + e.vec_id % 28)::INTEGER END AS grant_date,
      CASE WHEN e.vec_id % 50 = 7 THEN 'EP' ELSE 'US' END AS country_code,
      p.title_value, d.abstract_value
    FROM embeddings e CROSS JOIN n
    LEFT JOIN (SELECT p_partkey % least(n_emb, n_part) AS id, string_agg(p_name, ' ' ORDER BY p_partkey) AS title_value
      FROM part, n GROUP BY 1) p ON p.id = e.vec_id % least(n.n_emb, n.n_part)
    LEFT JOIN (SELECT doc_id % least(n_emb, n_doc) AS id, string_agg(text, ' ' ORDER BY doc_id) AS abstract_value
      FROM documents, n GROUP BY 1) d ON d.id = e.vec_id % least(n.n_emb, n.n_doc)""",
    "rel": _rel(""),
    "old_rel": _rel("WHERE o_orderdate < '1999-01-01'"),
    "three": "SELECT 1 AS pos UNION ALL SELECT 2 UNION ALL SELECT 3",
    "assignees": """
    SELECT vec_id, pos, CASE WHEN vec_id % 17 = 5 THEN '' ELSE 'ASSIGNEE ' || label || '-' || (vec_id + pos) % 4 END AS name
    FROM embeddings, three WHERE pos <= vec_id % 3""",
    "inventors": """
    SELECT vec_id, pos, CASE WHEN vec_id % 31 <> 2 THEN 'INVENTOR ' || (vec_id * 13 + pos * 5) % 97 END AS name
    FROM embeddings, three WHERE pos <= 1 + vec_id % 2""",
    "cpcs": """
    SELECT vec_id, pos, CASE WHEN vec_id % 23 = 3 THEN '9' WHEN vec_id % 29 = 1 THEN 'h'
        ELSE substr('ABCDEFGHY', (label + pos) % 9 + 1, 1) END
      || lpad((vec_id % 99)::VARCHAR, 2, '0') || 'L63/10' AS code
    FROM embeddings, three WHERE pos <= 1 + vec_id % 2""",
    "terms": """
    SELECT e.vec_id, pos, p.p_type AS term FROM embeddings e CROSS JOIN three CROSS JOIN n
    JOIN part p ON p.p_partkey = (e.vec_id + pos) % n.n_part""",
    "named": """
    SELECT d.*, a.name AS primary_assignee, i.name AS primary_inventor FROM docs d
    LEFT JOIN assignees a ON a.vec_id = d.vec_id AND a.pos = 1
    LEFT JOIN inventors i ON i.vec_id = d.vec_id AND i.pos = 1""",
    "corpus": "SELECT * FROM named WHERE country_code = 'US' AND vec IS NOT NULL AND filing_date >= 20060101",
    "links": "SELECT c.publication_number, r.rel, r.rel_no, r.pos, r.other FROM corpus c JOIN rel r ON r.owner_id = c.vec_id",
    "inputs": """
    SELECT vec_id AS input_id, CASE vec_id % 7
      WHEN 0 THEN (8000000 + vec_id)::VARCHAR
      WHEN 1 THEN 'US' || (8000000 + vec_id)
      WHEN 2 THEN ' 8,' || substr((8000000 + vec_id)::VARCHAR, 2, 3) || ',' || substr((8000000 + vec_id)::VARCHAR, 5, 3) || ' '
      WHEN 3 THEN (14000000 + vec_id * 3)::VARCHAR
      WHEN 4 THEN 'us-' || (8000000 + vec_id) || '-b2'
      WHEN 5 THEN 'US-' || (8000000 + vec_id)
      ELSE 'abc' || vec_id END AS raw
    FROM embeddings""",
    "cleaned": """
    SELECT *, CASE WHEN NOT formatted AND regexp_full_match(bare, '[0-9]+') THEN bare END AS number FROM (
      SELECT *, regexp_full_match(cleaned, '[A-Z]{2}-[0-9]+-[A-Z][0-9]') AS formatted,
        regexp_replace(cleaned, '^US', '') AS bare
      FROM (SELECT *, upper(replace(replace(trim(raw), ',', ''), ' ', '')) AS cleaned FROM inputs))""",
    "matches": """
    SELECT i.input_id, 0 AS step, 0 AS pref, 0 AS size, c.publication_number FROM cleaned i
      JOIN corpus c ON i.formatted AND c.publication_number = i.cleaned
    UNION ALL SELECT i.input_id, 1, k.pref, 0, c.publication_number FROM cleaned i
      CROSS JOIN (SELECT 0 AS pref, 'B1' AS kind UNION ALL SELECT 1, 'B2' UNION ALL SELECT 2, 'A1') k
      JOIN corpus c ON c.publication_number = 'US-' || i.number || '-' || k.kind
    UNION ALL SELECT i.input_id, 2, 0, length(c.publication_number), c.publication_number FROM cleaned i
      JOIN corpus c ON starts_with(c.publication_number, 'US-' || i.number)
    UNION ALL SELECT i.input_id, 3, 0, 0, c.publication_number FROM cleaned i
      JOIN corpus c ON c.application_number = i.number""",
    "resolved": """
    SELECT i.input_id, coalesce(m.publication_number, CASE WHEN i.formatted THEN i.cleaned END) AS publication_number,
      CASE coalesce(m.step, CASE WHEN i.formatted THEN 0 END) WHEN 0 THEN 'formatted' WHEN 1 THEN 'suffix'
        WHEN 2 THEN 'prefix' WHEN 3 THEN 'application' END AS step,
      m.input_id IS NOT NULL AS found
    FROM cleaned i LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY step, pref, size, publication_number) AS rn FROM matches) m
    ON m.input_id = i.input_id AND m.rn = 1""",
    "queries": """
    SELECT c.publication_number AS query_id, c.vec FROM corpus c
    WHERE c.publication_number IN (SELECT publication_number FROM resolved WHERE found)""",
    "topk": _nearest("queries", "corpus", "publication_number", _COSINE, 20),
    "topk100": _nearest("queries", "corpus", "publication_number", _COSINE, 100),
    "found": _numbered("topk"),
    "found100": _numbered("topk100"),
    "neighbors": _neighbors(None),
    "expanded": "SELECT b.* FROM neighbors b JOIN corpus c USING (publication_number)",
    "nodes": """
    SELECT query_id, node, min(row_no) AS row_no, node = query_id AS is_seed FROM (
      SELECT query_id, publication_number AS node, row_no FROM found
      UNION ALL SELECT query_id, publication_number, 1048576 + neighbor_order FROM expanded -- after all of at most 100 results
      UNION ALL SELECT DISTINCT query_id, query_id, NULL FROM found)
    GROUP BY query_id, node""",
    "edges": f"""
    SELECT query_id, src, dst, {_EDGE_TYPE} AS edge_type FROM (
      SELECT query_id, src, dst, arg_max(rel_no, row_no * 4398046511104 + rel_no * 1099511627776 + pos) AS rel_no FROM (
        SELECT a.query_id, a.row_no, l.rel_no, l.pos,
          CASE WHEN l.rel_no IN (1, 2) THEN l.other ELSE a.node END AS src,
          CASE WHEN l.rel_no IN (1, 2) THEN a.node ELSE l.other END AS dst
        FROM nodes a JOIN links l ON l.publication_number = a.node
        JOIN nodes b ON b.query_id = a.query_id AND b.node = l.other
        WHERE a.row_no IS NOT NULL AND l.other <> a.node)
      GROUP BY query_id, src, dst)""",
    "pr_nodes": _power_nodes("nodes", "edges"),
    "pr": _power("pr_nodes", "edges", "pr"),
    "ppr": "SELECT query_id, node, r AS ppr_raw FROM pr WHERE err < nn * 1e-6",
    "scores": """
    SELECT query_id, node, ppr_raw, CASE WHEN hi = lo THEN 1 ELSE (ppr_raw - lo) / (hi - lo) END AS ppr_score FROM (
      SELECT *, min(ppr_raw) OVER (PARTITION BY query_id) AS lo, max(ppr_raw) OVER (PARTITION BY query_id) AS hi FROM ppr)""",
    "scored": f"""
    SELECT *, {_pct('ppr_score')} AS ppr_pct, {_pct('blended_score')} AS blended_pct FROM (
      SELECT *, 0.6::DOUBLE * similarity + 0.4::DOUBLE * ppr_score AS blended_score FROM (
        SELECT f.query_id, f.publication_number, f.distance, f.row_no, 1 - f.distance AS similarity,
          {_pct('(1 - f.distance)')} AS similarity_pct, a.query_id IS NOT NULL AS ppr_available,
          CASE WHEN a.query_id IS NOT NULL THEN coalesce(s.ppr_raw, 0) END AS ppr_raw,
          CASE WHEN a.query_id IS NOT NULL THEN coalesce(s.ppr_score, 0) END AS ppr_score
        FROM found f LEFT JOIN scores s ON s.query_id = f.query_id AND s.node = f.publication_number
        LEFT JOIN (SELECT DISTINCT query_id FROM scores) a ON a.query_id = f.query_id
        WHERE NOT f.is_query))""",
    "ranked": _ranked("blended_score"),
    "ranked_similarity": _ranked("similarity"),
    "ranked_graph": _ranked("ppr_score"),
    "result_links": """
    SELECT e.* FROM edges e JOIN scored a ON a.query_id = e.query_id AND a.publication_number = e.src
    JOIN scored b ON b.query_id = e.query_id AND b.publication_number = e.dst
    WHERE a.ppr_available""",
    "expanded_rows": f"""
    SELECT x.query_id, x.publication_number, x.neighbor_order, {_DISPLAY}, c.vec_id, s.ppr_raw, s.ppr_score,
      {_pct('s.ppr_score')} AS ppr_pct
    FROM expanded x JOIN corpus c USING (publication_number)
    LEFT JOIN scores s ON s.query_id = x.query_id AND s.node = x.publication_number""",
    "query_rows": f"""
    SELECT f.query_id, f.publication_number, {_DISPLAY}, c.vec_id FROM found f JOIN corpus c USING (publication_number)
    WHERE f.is_query""",
    "shared": """
    SELECT query_id, primary_assignee AS assignee, count(*) AS n, min(rank) AS first_rank FROM ranked
    WHERE rank <= 10 AND coalesce(primary_assignee, '') NOT IN ('', 'N/A')
    GROUP BY query_id, primary_assignee HAVING count(*) > 1""",
    "kpis": """
    SELECT r.query_id, count(*) AS n_results, count(DISTINCT nullif(primary_assignee, '')) AS n_assignees,
      count(DISTINCT nullif(primary_inventor, '')) AS n_inventors, avg(similarity_pct) AS avg_similarity_pct,
      coalesce(any_value(x.n), 0) AS n_expanded
    FROM ranked r LEFT JOIN (SELECT query_id, count(*) AS n FROM expanded GROUP BY query_id) x USING (query_id)
    GROUP BY r.query_id""",
    "shown_nodes": f"""
    SELECT query_id, node, kind, label, hover, color, size, shape, score, score_pct, tier FROM (
      SELECT query_id, query_id AS node, 'query' AS kind, query_id AS label,
        'QUERY: ' || query_id || chr(10) || CASE WHEN publication_number = query_id THEN title_text ELSE '' END AS hover,
        '#0B3D91' AS color, 45 AS size, 'dot' AS shape, NULL::DOUBLE AS score, NULL::INTEGER AS score_pct, NULL::INTEGER AS tier
      FROM query_rows
      UNION ALL
      SELECT query_id, publication_number, kind, publication_number || chr(10) || trunc(u * 100)::INTEGER || '%',
        publication_number || suffix || chr(10) || title_text || chr(10) || 'Assignee: ' || coalesce(primary_assignee, 'N/A')
          || chr(10) || score_name || ': ' || trunc(u * 100)::INTEGER || '%',
        {_tier('u', 2)}, 14 + trunc(u * 52)::INTEGER, shape, u, trunc(u * 100)::INTEGER, {_tier('u', 1)}
      FROM (
        SELECT query_id, publication_number, title_text, primary_assignee, {_unit('score')} AS u, 'result' AS kind,
          '' AS suffix, 'Score' AS score_name, 'dot' AS shape FROM ranked
        UNION ALL
        SELECT query_id, publication_number, title_text, primary_assignee, 0::DOUBLE, 'result', '', 'Score', 'dot'
        FROM query_rows WHERE publication_number <> query_id
        UNION ALL
        SELECT query_id, publication_number, title_text, primary_assignee, {_unit('ppr_score')}, 'expanded',
          ' (Citation Network)', 'PPR', 'triangle' FROM expanded_rows WHERE publication_number <> query_id))""",
    "shown_edges": _shown_edges("WHERE l.other <> a.publication_number"),
    "plain_blocks": f"""
    SELECT query_id, string_agg('Result ' || rank || ': ' || publication_number || chr(10) || 'Title: ' || title_text || chr(10)
      || 'Assignee: ' || coalesce(primary_assignee, 'N/A') || chr(10) || 'Abstract: ' || substr(abstract_text, 1, 500) || chr(10)
      || 'Similarity: ' || printf('%.2f%%', similarity * 100 + 1e-10) || chr(10) || '---', chr(10) ORDER BY rank) AS context
    FROM ranked_similarity WHERE rank <= 5 GROUP BY query_id""",
    "graph_blocks": f"""
    SELECT query_id, string_agg('Result ' || rank || ': ' || publication_number || chr(10) || 'Title: ' || title_text || chr(10)
      || 'Assignee: ' || coalesce(primary_assignee, 'N/A') || chr(10) || 'Abstract: ' || substr(abstract_text, 1, 500) || chr(10)
      || 'Text Similarity: ' || printf('%.2f%%', similarity * 100 + 1e-10) || ' | Graph Importance (PPR): '
      || printf('%.4f', ppr_raw + 1e-12) || ' | Blended: ' || printf('%.2f%%', blended_score * 100 + 1e-10)
      || chr(10) || '---', chr(10) ORDER BY rank) AS blocks
    FROM ranked WHERE rank <= 5 AND ppr_available GROUP BY query_id""",
    "edge_lines": """
    SELECT query_id, string_agg('  ' || src || ' --[' || edge_type || ']--> ' || dst, chr(10) ORDER BY src, dst) AS lines FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst) AS rn FROM result_links) WHERE rn <= 20
    GROUP BY query_id""",
    "shared_lines": """
    SELECT query_id, string_agg('  ' || assignee || ': ' || n || ' patents', chr(10) ORDER BY n DESC, first_rank) AS lines
    FROM shared GROUP BY query_id""",
    "important_lines": """
    SELECT query_id, string_agg('  ' || publication_number || ': ' || title_text || ' (PPR: ' || printf('%.4f', ppr_raw + 1e-12) || ')',
      chr(10) ORDER BY rn) AS lines FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr_raw, 12) DESC, publication_number) AS rn
      FROM expanded_rows WHERE ppr_raw > 0) WHERE rn <= 3
    GROUP BY query_id""",
    "contexts": f"""
    SELECT b.query_id, true AS ppr_available, concat_ws(chr(10), b.blocks,
        {_text(CITATIONS_HEADING)} || e.lines, {_text(SHARED_HEADING)} || s.lines, {_text(IMPORTANT_HEADING)} || i.lines) AS context
    FROM graph_blocks b LEFT JOIN edge_lines e USING (query_id) LEFT JOIN shared_lines s USING (query_id)
    LEFT JOIN important_lines i USING (query_id)
    UNION ALL
    SELECT query_id, false, context FROM plain_blocks
    WHERE query_id NOT IN (SELECT query_id FROM scores)""",
    "given_centers": """
    SELECT row_number() OVER (ORDER BY label) - 1 AS list_id, center FROM (
      SELECT label, list(m ORDER BY d) AS center FROM (
        SELECT label, d, avg(x) AS m FROM (
          SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d)
      GROUP BY label)""",
    "given_lists": """
    SELECT publication_number, arg_max(list_id, list_cosine_similarity(vec, center)) AS list_id
    FROM corpus, given_centers GROUP BY publication_number""",
    "snapshot": "SELECT * FROM named WHERE publication_date < 20150101",
    "corpus_edges": """
    SELECT DISTINCT 'corpus' AS query_id, CASE WHEN l.rel_no IN (1, 2) THEN l.other ELSE l.publication_number END AS src,
      CASE WHEN l.rel_no IN (1, 2) THEN l.publication_number ELSE l.other END AS dst
    FROM links l JOIN corpus c ON c.publication_number = l.other WHERE l.other <> l.publication_number""",
    "corpus_nodes": """
    SELECT 'corpus' AS query_id, publication_number AS node,
      publication_number = (SELECT min(publication_number) FROM corpus) AS is_seed FROM corpus""",
    "corpus_pr_nodes": _power_nodes("corpus_nodes", "corpus_edges"),
    "corpus_pr": _power("corpus_pr_nodes", "corpus_edges", "corpus_pr"),
}
_RECURSIVE = {"pr", "corpus_pr"}
_WORD = re.compile(r"[a-z_0-9]+")


def sql(statement: str) -> str:
    """The statement with the common tables it needs, in the order of definition."""
    needed: set[str] = set()
    pending = [statement]
    while pending:
        for word in set(_WORD.findall(pending.pop())):
            if word in TABLES and word not in needed:
                needed.add(word)
                pending.append(TABLES[word])
    parts = [
        f"{name} AS {'' if name in _RECURSIVE else 'MATERIALIZED '}({TABLES[name]})" for name in TABLES if name in needed
    ]
    return f"WITH RECURSIVE {', '.join(parts)} {statement}" if parts else statement
