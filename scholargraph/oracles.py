"""SQL of the registered queries, over the same tables, in a dialect with ``WITH`` chains.

``_with`` puts the shared table expressions that a query names, and those they need, before it.
"""

from __future__ import annotations

import re

_PARTS = {
    "pairs": """SELECT l_partkey AS citing, cited, count(*) AS n FROM (
        SELECT l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS cited FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE cited IS NOT NULL GROUP BY 1, 2""",
    "thin": "SELECT * FROM pairs WHERE n > 1",
    "cit": """SELECT citing, cited, n, n > 1 AS is_influential, row_number() OVER (PARTITION BY citing ORDER BY n DESC, cited) AS ref_position,
        row_number() OVER (PARTITION BY cited ORDER BY n DESC, citing) AS cite_position,
        CASE WHEN citing % 13 <> 7 OR citing % 2 = 0 THEN 'paper ' || citing END AS citing_title, CASE WHEN cited % 13 <> 7 OR cited % 2 = 0 THEN 'paper ' || cited END AS cited_title FROM pairs""",
    "papers": """SELECT p_partkey AS key, CAST(p_partkey AS VARCHAR) AS paper_id, p_name || ' ' || p_partkey AS title, 'about ' || p_name AS abstract, CASE WHEN p_partkey % 11 <> 0 THEN 1975 + p_size END AS publication_year,
        CAST(coalesce(i, 0) AS INTEGER) AS citation_count, p_brand AS venue, list_concat([p_type], string_split(p_name, ' ')) AS fields, 'Author ' || (p_partkey % 97) AS authors,
        CASE p_partkey % 3 WHEN 0 THEN 'https://doi.org/10.1234/part.' || p_partkey WHEN 1 THEN 'https://example.org/paper/' || p_partkey END AS url, CASE WHEN p_partkey % 3 = 0 THEN '10.1234/part.' || p_partkey END AS doi
        FROM part LEFT JOIN (SELECT cited, count(*) AS i FROM pairs GROUP BY 1) ON cited = p_partkey""",
    "sources": """SELECT 'semantic_scholar' AS source, 0 AS source_rank, key AS position, doi, doi AS own_doi, 's2-' || paper_id AS own, title, publication_year, citation_count,
          CASE WHEN key % 6 <> 0 THEN array_to_string(list_transform(range(0, key % 5 + 1), lambda i: 'Author ' || i), ', ') ELSE '' END AS authors, venue FROM papers WHERE key % 2 = 0
        UNION ALL SELECT 'openalex', 1, key, 'https://doi.org/' || doi, doi, 'https://openalex.org/W' || (key + 100000), title, publication_year, citation_count, authors, venue FROM papers WHERE key % 3 = 0
        UNION ALL SELECT 'crossref', 2, key, upper(doi), doi, NULL, title, publication_year, citation_count, CASE WHEN key % 10 = 0 THEN 'Ann Lee,  ' || authors ELSE '' END, venue FROM papers WHERE key % 5 = 0""",
    "merged_raw": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(doi, own, title) ORDER BY source_rank, position) AS r FROM sources) WHERE r = 1",
    "merged_norm": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(lower(own_doi), own, title) ORDER BY source_rank, position) AS r FROM sources) WHERE r = 1",
    "roots": "SELECT key AS root FROM papers WHERE key % 13 <> 7",
    "adj": """SELECT citing AS id, 0 AS kind, ref_position AS position, cited AS target, cited_title AS title FROM cit WHERE ref_position <= 20
        UNION ALL SELECT cited, 1, cite_position, citing, citing_title FROM cit WHERE cite_position <= 15""",
    "near": "SELECT *, CASE WHEN target % 13 <> 7 THEN 'full' WHEN title IS NOT NULL THEN 'basic' ELSE 'none' END AS state FROM adj",
    "recommended": """SELECT * FROM (SELECT p, q, score, row_number() OVER (PARTITION BY p ORDER BY score DESC, CAST(q AS VARCHAR)) AS k FROM (SELECT p, q, count(*) AS score FROM (
        SELECT a.cited AS p, b.cited AS q FROM cit a JOIN cit b ON a.citing = b.citing AND a.cited <> b.cited UNION ALL SELECT a.citing, b.citing FROM cit a JOIN cit b ON a.cited = b.cited AND a.citing <> b.citing) GROUP BY 1, 2)) WHERE k <= 10""",
    "metrics": """SELECT 's2-' || paper_id AS id, CASE WHEN key % 6 <> 0 THEN least(10, CAST(floor(log10(key % 5 + 2) * 5) AS INTEGER)) ELSE 0 END AS estimated_h_index,
        CASE WHEN citation_count > 0 AND publication_year < 2026 THEN floor((200 * citation_count + (2026 - publication_year)) / (2 * (2026 - publication_year))) / 100 ELSE 0 END AS citations_per_year, 0 AS altmetric_score FROM papers WHERE key % 2 = 0""",
    "n0": "SELECT root, root AS id, 0 AS depth, 0 AS seq, 'full' AS state, 0 AS kind FROM roots",
    "all_authors": "SELECT DISTINCT l_partkey AS key, l_suppkey, s_name, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
}


def _level(at: int, refs: int, cites: int, cap: int, own: str = "", near: str = "near") -> None:
    """Table expressions of one level of the search: candidates, those handled, new nodes, all nodes so far. ``own`` tells searches apart."""
    before = "n0" if at == 0 else f"all{own}{at}"
    start = "n0" if at == 0 else f"n{own}{at}"
    _PARTS[f"cand{own}{at + 1}"] = f"""SELECT f.root, f.seq AS place, f.id AS paper, a.kind, a.position, a.target, a.state, a.state <> 'none' AND v.id IS NULL AS addable
        FROM {start} f JOIN {near} a ON a.id = f.id AND a.position <= CASE WHEN a.kind = 0 THEN {refs} ELSE {cites} END
        LEFT JOIN {before} v ON v.root = f.root AND v.id = a.target WHERE f.state = 'full' AND (f.depth <= 2 OR f.kind = 0)"""
    _PARTS[f"new{own}{at + 1}"] = f"SELECT *, CASE WHEN addable AND row_number() OVER (PARTITION BY root, target, addable ORDER BY place, kind, position) = 1 THEN 1 ELSE 0 END AS is_new FROM cand{own}{at + 1}"
    _PARTS[f"kept{own}{at + 1}"] = f"""SELECT * FROM (SELECT c.*, s.size + coalesce(sum(is_new) OVER (PARTITION BY c.root ORDER BY place, kind, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM new{own}{at + 1} c JOIN (SELECT root, count(*) AS size FROM {before} GROUP BY 1) s ON s.root = c.root) WHERE before < {cap}"""
    _PARTS[f"n{own}{at + 1}"] = f"SELECT root, target AS id, {at + 1} AS depth, before AS seq, state, kind FROM kept{own}{at + 1} WHERE is_new = 1"
    _PARTS[f"all{own}{at + 1}"] = f"SELECT * FROM {before} UNION ALL SELECT * FROM n{own}{at + 1}"


_level(0, 20, 15, 150)
_level(1, 15, 8, 150)
for _at, _limits in enumerate(((20, 15), (15, 8), (10, 3))):
    _level(_at, *_limits, 200, "_ui")
_PARTS["adj_thin"] = """SELECT citing AS id, 0 AS kind, ref_position AS position, cited AS target, cited_title AS title FROM cit WHERE n > 1 AND ref_position <= 20
    UNION ALL SELECT cited, 1, cite_position, citing, citing_title FROM cit WHERE n > 1 AND cite_position <= 15"""
_PARTS["near_thin"] = "SELECT *, CASE WHEN target % 13 <> 7 THEN 'full' WHEN title IS NOT NULL THEN 'basic' ELSE 'none' END AS state FROM adj_thin"
for _at, _limits in enumerate(((20, 15), (15, 8), (10, 3), (5, 0))):
    _level(_at, *_limits, 150, "_thin", "near_thin")
# networks of depth 1 with 200 nodes: at most 36, so that no cap bites
_PARTS["n_first"] = "SELECT root, id, 'full' AS state, NULL AS title, 0 AS depth FROM n0 UNION ALL SELECT root, target, min(state), min(title), 1 FROM (SELECT f.root, a.target, a.state, a.title FROM n0 f JOIN near a ON a.id = f.id WHERE a.state <> 'none' AND a.target <> f.root) GROUP BY 1, 2"
_PARTS["e_first"] = "SELECT DISTINCT f.root, CASE WHEN a.kind = 0 THEN f.id ELSE a.target END AS f, CASE WHEN a.kind = 0 THEN a.target ELSE f.id END AS t, a.kind FROM n0 f JOIN near a ON a.id = f.id"
_PARTS["ego_edges"] = """SELECT DISTINCT root, CASE WHEN kind = 0 THEN paper ELSE target END AS f, CASE WHEN kind = 0 THEN target ELSE paper END AS t, CASE WHEN kind = 0 THEN 'reference' ELSE 'citation' END AS type
    FROM (SELECT * FROM kept1 UNION ALL SELECT * FROM kept2)"""


def _with(sql: str) -> str:
    """``sql`` after the expressions it needs, in order of definition and need."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _PARTS:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(_PARTS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n]})" for n in order) + "\n" + sql if order else sql


def _unrolled_pagerank(rounds: int = 20) -> str:
    flows = "f AS MATERIALIZED (SELECT citing AS s, cited AS d, 0.85 / count(*) OVER (PARTITION BY citing) AS share FROM pairs)"
    base = "v AS MATERIALIZED (SELECT p_partkey AS id, 1.0 / count(*) OVER () AS u FROM part)"
    steps = ["r0 AS MATERIALIZED (SELECT id, u AS s FROM v)"]
    steps += [f"r{i} AS MATERIALIZED (SELECT v.id, 0.15 * v.u + coalesce(g.x, 0) AS s FROM v LEFT JOIN (SELECT d, sum(r.s * share) AS x FROM f JOIN r{i - 1} r ON r.id = f.s GROUP BY d) g ON g.d = v.id)" for i in range(1, rounds + 1)]
    pairs = f"pairs AS MATERIALIZED ({_PARTS['pairs']})"
    return f"WITH {', '.join([pairs, flows, base, *steps])} SELECT CAST(id AS VARCHAR) AS id, round(s, 8) AS score, round(greatest(15, s * 1000), 5) AS size FROM r{rounds}"


def _unrolled_papers(rounds: int = 12) -> str:
    """Ranks, and components by the least key reached in ``rounds`` steps, more than the graph is wide."""
    both = "w AS MATERIALIZED (SELECT citing AS a, cited AS b FROM pairs UNION SELECT cited, citing FROM pairs)"
    steps = ["m0 AS MATERIALIZED (SELECT p_partkey AS id, p_partkey AS m FROM part)"]
    steps += [f"m{i} AS MATERIALIZED (SELECT m.id, least(m.m, coalesce(g.x, m.m)) AS m FROM m{i - 1} m LEFT JOIN (SELECT a, min(o.m) AS x FROM w JOIN m{i - 1} o ON o.id = w.b GROUP BY a) g ON g.a = m.id)" for i in range(1, rounds + 1)]
    head, tail = _unrolled_pagerank().rsplit(" SELECT CAST(id AS VARCHAR)", 1)
    last = tail.rsplit("FROM ", 1)[1]
    return f"{head}, {', '.join([both, *steps])} SELECT CAST(r.id AS VARCHAR) AS paper_id, p_name || ' ' || p_partkey AS title, round(r.s, 6) AS page_rank_score, dense_rank() OVER (ORDER BY m.m) - 1 AS cluster_id, '2026-01-01 12:00:00' AS updated_at FROM {last} r JOIN part ON p_partkey = r.id JOIN m{rounds} m ON m.id = r.id"


def _unrolled_ego_pagerank(rounds: int = 20) -> str:
    """Ranks within each network; rank that flows to targets outside it is lost."""
    more = {
        "ev": "SELECT root, id, 1.0 / count(*) OVER (PARTITION BY root) AS u FROM all2",
        "ef": "SELECT root, f AS s, t AS d, 0.85 / count(*) OVER (PARTITION BY root, f) AS share FROM ego_edges",
        "er0": "SELECT root, id, u AS s FROM ev",
    }
    for i in range(1, rounds + 1):
        more[f"er{i}"] = f"SELECT v.root, v.id, 0.15 * v.u + coalesce(g.x, 0) AS s FROM ev v LEFT JOIN (SELECT e.root, e.d, sum(r.s * e.share) AS x FROM ef e JOIN er{i - 1} r ON r.root = e.root AND r.id = e.s GROUP BY 1, 2) g ON g.root = v.root AND g.d = v.id"
    _PARTS.update(more)
    return _with(f"SELECT CAST(root AS VARCHAR) AS root_id, CAST(id AS VARCHAR) AS id, round(s + 3.14159265e-10, 8) AS score, round(greatest(15, s * 1000), 5) AS size, CAST(0 AS BIGINT) AS cluster_id FROM er{rounds}")


_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

_IDS = "(SELECT unnest(['10.1038/nature12373', '10.48550/arXiv.1706.03762', '1706.03762', 'https://doi.org/10.48550/arxiv.1706.03762v2', 'arXiv:1706.03762', 'arxiv:cs/0112017', 'W2741809807', 'https://openalex.org/W2741809807']) AS shape)"

ORACLES = {
    "pagerank_global": _unrolled_pagerank(),
    "components_thin": _with("""SELECT CAST(p_partkey AS VARCHAR) AS id, dense_rank() OVER (ORDER BY coalesce(c, p_partkey)) - 1 AS cluster_id FROM part LEFT JOIN (
        SELECT id, min(l) AS c FROM (WITH RECURSIVE both_ways AS (SELECT citing AS a, cited AS b FROM thin UNION SELECT cited, citing FROM thin), reach AS (SELECT a AS id, a AS l FROM both_ways UNION SELECT b, l FROM reach JOIN both_ways ON a = id) SELECT * FROM reach) GROUP BY id) ON id = p_partkey"""),
    "ego_network_nodes": _with("""SELECT CAST(root AS VARCHAR) AS root_id, CAST(id AS VARCHAR) AS id, depth, CAST(seq AS BIGINT) AS node_seq, a.state = 'basic' AS basic,
        CASE WHEN a.state = 'basic' THEN 'paper ' || id ELSE p.title END AS label, round(CASE WHEN a.state = 'basic' THEN 15 ELSE greatest(15, log10(p.citation_count + 1) * 12) END, 6) AS size,
        CASE WHEN depth = 0 THEN '#ff6b35' WHEN a.state = 'basic' THEN '#94a3b8' WHEN depth = 1 THEN '#059669' ELSE '#7c3aed' END AS color
        FROM all2 a JOIN papers p ON p.key = a.id"""),
    "ego_pagerank": _unrolled_ego_pagerank(),
    "ego_network_edges": _with("SELECT CAST(root AS VARCHAR) AS root_id, CAST(f AS VARCHAR) AS from_id, CAST(t AS VARCHAR) AS to_id, type, 1 AS weight FROM ego_edges"),
    "ego_network_ui": _with("""SELECT CAST(root AS VARCHAR) AS root_id, CAST(id AS VARCHAR) AS id, depth, CAST(seq AS BIGINT) AS node_seq, state = 'basic' AS basic,
        CASE WHEN depth = 0 THEN '#ff6b35' WHEN state = 'basic' THEN '#94a3b8' WHEN depth = 1 THEN '#059669' WHEN depth = 2 THEN '#7c3aed' ELSE '#dc2626' END AS color FROM all_ui3"""),
    "ego_network_narrow": _with("""SELECT DISTINCT CAST(root AS VARCHAR) AS root_id, CAST(CASE WHEN kind = 0 THEN paper ELSE target END AS VARCHAR) AS from_id, CAST(CASE WHEN kind = 0 THEN target ELSE paper END AS VARCHAR) AS to_id,
        CASE WHEN kind = 0 THEN 'reference' ELSE 'citation' END AS type, 1 AS weight FROM (SELECT * FROM kept_thin1 UNION ALL SELECT * FROM kept_thin2 UNION ALL SELECT * FROM kept_thin3 UNION ALL SELECT * FROM kept_thin4)"""),
    "ego_depth_distribution": _with("SELECT CAST(root AS VARCHAR) AS root_id, CAST(depth AS VARCHAR) AS depth, count(*) AS n FROM all2 GROUP BY 1, 2"),
    "ego_counts": _with("SELECT CAST(n.root AS VARCHAR) AS root_id, n.c AS node_count, coalesce(e.c, 0) AS edge_count FROM (SELECT root, count(*) AS c FROM all2 GROUP BY 1) n LEFT JOIN (SELECT root, count(*) AS c FROM ego_edges GROUP BY 1) e ON e.root = n.root"),
    "induced_subgraph_year": _with("""SELECT CAST(citing AS VARCHAR) AS from_id, CAST(cited AS VARCHAR) AS to_id FROM pairs JOIN papers a ON a.key = citing JOIN papers b ON b.key = cited
        WHERE (a.publication_year IS NULL OR a.publication_year BETWEEN 1990 AND 2010) AND (b.publication_year IS NULL OR b.publication_year BETWEEN 1990 AND 2010)"""),
    "neighbors_batch": _with("""SELECT CAST(id AS VARCHAR) AS id, CAST(neighbor AS VARCHAR) AS neighbor FROM (SELECT citing AS id, cited AS neighbor FROM pairs UNION ALL SELECT cited, citing FROM pairs UNION ALL SELECT p_partkey, p_partkey FROM part)"""),
    "merge_dedup_raw": _with("SELECT source, doi, title, coalesce(publication_year, 0) AS publication_year, citation_count, authors, venue FROM merged_raw"),
    "merge_dedup_normalized": _with("SELECT source, doi, title, coalesce(publication_year, 0) AS publication_year, citation_count, authors, venue FROM merged_norm"),
    "merge_upsert": _with("SELECT source, doi, title, coalesce(publication_year, 0) AS publication_year, citation_count, authors, venue FROM merged_norm"),
    "search_stats": _with("SELECT count(*) FILTER (WHERE source = 'semantic_scholar') AS semantic_scholar_count, count(*) FILTER (WHERE source = 'openalex') AS openalex_count, count(*) FILTER (WHERE source = 'crossref') AS crossref_count FROM sources"),
    "search_top50": _with("SELECT source, title, citation_count FROM merged_raw ORDER BY citation_count DESC, source_rank, position LIMIT 50"),
    "normalize_sources": _with("SELECT source, position, coalesce(doi, '') AS doi, title, authors, citation_count FROM sources"),
    "lookup_doi": _with("SELECT p.key AS query_id, s.source, s.title FROM papers p JOIN sources s ON s.own_doi = p.doi WHERE s.source <> 'openalex'"),
    "lookup_arxiv": "SELECT page_id AS query_id, 's2-' || page_id AS semantic_scholar_id FROM pages",
    "lookup_s2": _with("SELECT key AS query_id, title FROM papers WHERE key % 2 = 0"),
    "resolve_ids": _with("""SELECT 'W' || (key + 100000) AS id, CASE WHEN key % 3 = 0 THEN 'doi' ELSE 'openalex' END AS kind, CASE WHEN key % 3 = 0 THEN doi ELSE 'W' || (key + 100000) END AS value FROM papers"""),
    "lookup_paper": _with("""SELECT 'W' || (key + 100000) AS id, CASE WHEN key % 3 = 0 AND key % 13 <> 7 THEN paper_id END AS paper_id, CASE WHEN key % 3 = 0 AND key % 13 <> 7 THEN 'papers' ELSE 'missing' END AS found_in FROM papers"""),
    "keyword_bm25": f"""WITH d AS (SELECT doc_id AS id, source, {_WORDS.format('text')} AS t FROM documents),
        q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'license'), (2, 'und'), (2, 'der'), (3, 'version'), (3, 'apache')) v(query_id, term)),
        s AS (SELECT source, count(*) AS n, avg(len(t)) AS a FROM d GROUP BY 1),
        f AS (SELECT id, source, len(t) AS len, q.term, q.query_id, len(list_filter(t, lambda x: x = q.term)) AS tf FROM d CROSS JOIN q),
        g AS (SELECT source, term, query_id, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1, 2, 3),
        r AS (SELECT f.query_id, f.source, f.id, sum(ln(1 + (s.n - g.df + 0.5) / (g.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * f.len / s.a))) AS score
          FROM f JOIN g ON g.source = f.source AND g.term = f.term AND g.query_id = f.query_id JOIN s ON s.source = f.source WHERE f.tf > 0 GROUP BY 1, 2, 3)
        SELECT query_id, source, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, id) AS k FROM r) WHERE k <= 20""",
    "filter_spec": _with("""SELECT paper_id, coalesce(publication_year, 0) AS publication_year, citation_count FROM papers WHERE (publication_year IS NULL OR publication_year BETWEEN 1990 AND 2015) AND citation_count >= 5
        AND len(list_filter(fields, lambda f: contains(lower(f), 'eco') OR contains(lower(f), 'bolt'))) > 0 AND contains(lower(venue), 'brand#1')"""),
    "filtered_counts": _with("SELECT count(*) AS total, count(*) FILTER (WHERE (publication_year IS NULL OR publication_year BETWEEN 1990 AND 2025) AND citation_count >= 10) AS kept FROM papers"),
    "facet_years": _with("SELECT DISTINCT publication_year FROM papers WHERE publication_year IS NOT NULL"),
    "facet_fields": _with("SELECT DISTINCT field FROM (SELECT unnest(fields) AS field FROM papers) ORDER BY field LIMIT 10"),
    "facet_venues": _with("SELECT DISTINCT venue FROM papers ORDER BY venue LIMIT 10"),
    "facets_all": _with("""SELECT 'year' AS facet, CAST(row_number() OVER (ORDER BY y DESC) AS INTEGER) AS rank, CAST(y AS VARCHAR) AS value FROM (SELECT DISTINCT publication_year AS y FROM papers WHERE publication_year IS NOT NULL)
        UNION ALL SELECT * FROM (SELECT 'field', CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS r, f FROM (SELECT DISTINCT unnest(fields) AS f FROM papers)) WHERE r <= 10
        UNION ALL SELECT * FROM (SELECT 'venue', CAST(row_number() OVER (ORDER BY venue) AS INTEGER) AS r, venue FROM (SELECT DISTINCT venue FROM papers)) WHERE r <= 10
        UNION ALL SELECT 'bounds', 1, CAST(min(publication_year) AS VARCHAR) FROM papers UNION ALL SELECT 'bounds', 2, CAST(max(publication_year) AS VARCHAR) FROM papers"""),
    "year_bounds": _with("SELECT min(publication_year) AS lo, max(publication_year) AS hi FROM papers"),
    "id_classify": r"""SELECT id, CASE WHEN contains(id, 'doi.org') AND contains(id, 'arxiv') THEN CASE WHEN regexp_matches(id, '(?i)arxiv\.\d{4}\.\d{4,5}') THEN 'arxiv' END WHEN starts_with(id, '10.') THEN 'doi'
          WHEN contains(lower(id), 'arxiv') OR regexp_full_match(id, '\d{4}\.\d{4,5}(?:v\d+)?') THEN CASE WHEN regexp_full_match(regexp_replace(id, '(?i)^arxiv:?', ''), '\d{4}\.\d{4,5}(?:v\d+)?') THEN 'arxiv' END
          WHEN contains(id, 'openalex.org') OR starts_with(id, 'W') THEN 'openalex' ELSE 's2' END AS kind,
          CASE k WHEN 1 THEN right(id, 10) WHEN 2 THEN right(id, 10) WHEN 3 THEN NULL ELSE id END AS value, CASE WHEN k = 3 THEN 'invalid arXiv id' END AS error
        FROM (SELECT CASE p_partkey % 7 WHEN 0 THEN '10.1234/part.' || p_partkey WHEN 1 THEN 'https://doi.org/10.48550/arxiv.1706.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') WHEN 2 THEN 'arXiv:1706.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0')
          WHEN 3 THEN 'arxiv:cs/' || p_partkey WHEN 4 THEN 'W' || p_partkey WHEN 5 THEN 'https://doi.org/10.1038/nature' || p_partkey ELSE md5(CAST(p_partkey AS VARCHAR)) END AS id, p_partkey % 7 AS k FROM part)""",
    "extract_doi": _with(r"SELECT paper_id, nullif(regexp_extract(url, '(?i)10\.\d{4,}[\w().\-/:]+'), '') AS doi FROM papers"),
    "query_hash": _with("SELECT paper_id, left(sha256(paper_id || '_3_200'), 16) AS query_hash FROM papers"),
    "preferred_id": _with("SELECT paper_id, coalesce(CASE WHEN key % 2 = 0 THEN 's2-' || paper_id END, doi, CASE WHEN key % 5 = 0 THEN 'W' || key END, paper_id) AS network_id, coalesce(CASE WHEN key % 2 = 0 THEN 's2-' || paper_id END, CASE WHEN key % 5 = 0 THEN 'W' || key END, paper_id) AS details_id FROM papers"),
    "abstract_roundtrip": r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> ''), ' ') AS abstract FROM documents WHERE text IS NOT NULL",
    "atom_extract": r"SELECT page_id, trim(regexp_extract(html, '<title>(.+?)</title>', 1, 's'), E' \t\n\x0b\f\r') AS title, 'https://arxiv.org/abs/' || page_id AS url FROM pages",
    "atom_fields": """SELECT 'ARXIV:2101.' || n || CASE WHEN k % 2 = 0 THEN 'v3' ELSE '' END AS paper_id, 'Paper ' || k || chr(10) || 'of ' || p_name AS title, CASE WHEN k % 5 = 0 THEN '' ELSE 'about ' || p_name || ' and more' END AS abstract,
        CAST(CASE WHEN k % 7 = 0 THEN 2026 ELSE 1990 + k % 35 END AS INTEGER) AS publication_year, 0 AS citation_count, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'Author ' || (k % 97) ELSE 'Author ' || (k % 97) || ', Author ' || ((k + 1) % 97) END AS authors,
        'arXiv preprint' AS venue, 'https://arxiv.org/abs/2101.' || n AS url, 'https://arxiv.org/pdf/2101.' || n || '.pdf' AS pdf_url, 'Computer Science' AS fields, 'arXiv' AS journal, 'preprint' AS types
        FROM (SELECT p_partkey AS k, p_name, lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS n FROM part)""",
    "author_labels": "SELECT doc_id, CASE WHEN n = 0 THEN '未知作者' WHEN n > 3 THEN 'a0, a1, a2 等' ELSE array_to_string(list_transform(range(0, n), lambda i: 'a' || i), ', ') END AS label FROM (SELECT doc_id, doc_id % 6 AS n FROM documents)",
    "node_style": _with("SELECT paper_id, round(greatest(15, log10(citation_count + 1) * 12), 6) AS size, round(greatest(15, 1.0 / (key + 1) * 1000), 6) AS rank_size, CASE key % 5 WHEN 0 THEN '#ff6b35' WHEN 1 THEN '#059669' WHEN 2 THEN '#7c3aed' WHEN 3 THEN '#dc2626' ELSE '#6b7280' END AS color, CASE WHEN key % 5 = 0 THEN '#ff6b35' ELSE ['#1e3a8a', '#dc2626', '#059669', '#7c3aed', '#ea580c', '#0891b2', '#be185d'][key % 7 + 1] END AS cluster_color FROM papers"),
    "layout_xy": _with("""SELECT CAST(root AS VARCHAR) AS root_id, CAST(id AS VARCHAR) AS id, round(400 + cos(i / n * 2 * pi()) * away, 6) AS x, round(300 + sin(i / n * 2 * pi()) * away, 6) AS y FROM (
        SELECT root, id, i, n, CASE WHEN depth = 0 THEN 50 ELSE 150 + (i % 3) * 100 END AS away FROM (SELECT root, id, depth, row_number() OVER (PARTITION BY root ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY root) AS n FROM all2))"""),
    "paper_metrics": _with("SELECT * FROM metrics"),
    "merge_details": _with("""SELECT 's2-' || paper_id AS id, title, CASE WHEN key % 4 = 0 OR key % 3 = 0 THEN abstract END AS abstract, venue AS journal, doi, CASE WHEN key % 3 = 0 THEN 'https://openalex.org/W' || (key + 100000) END AS openalex_id,
        key % 12 = 0 AS is_open_access, CASE WHEN key % 3 = 0 THEN len(fields) ELSE 0 END AS n_concepts FROM papers WHERE key % 2 = 0"""),
    "merge_details_full": _with("""SELECT 's2-' || paper_id AS id, CASE WHEN key % 8 = 0 THEN 'Journal ' || (key % 5) ELSE venue END AS journal, CASE WHEN key % 10 = 0 THEN 'Venue ' || (key % 3) ELSE '' END AS publication_venue,
        CASE WHEN key % 4 = 0 THEN 'JournalArticle; Type ' || (key % 3) ELSE '' END AS publication_types, CASE WHEN key % 3 <> 1 AND publication_year IS NOT NULL THEN publication_year || '-01-15' ELSE '' END AS publication_date, citation_count,
        CAST(CASE WHEN key % 4 = 2 THEN key % 17 ELSE 0 END AS INTEGER) AS influential_citation_count, CAST(coalesce(r.c, 0) AS INTEGER) AS reference_count, CASE WHEN key % 6 = 0 THEN 'https://example.org/pdf/' || key ELSE '' END AS pdf_url,
        coalesce(r.told, '') AS refs, coalesce(x.told, '') AS cites, CASE WHEN key % 6 = 0 THEN 'https://oa.example.org/' || key ELSE '' END AS oa_url, CASE WHEN key % 9 = 0 THEN CAST(key % 7 * 100 AS VARCHAR) ELSE '' END AS apc_paid,
        CASE WHEN key % 12 = 0 THEN 'SDG 3; SDG ' || (key % 17) ELSE '' END AS sdgs, CASE WHEN key % 3 = 0 THEN array_to_string(list_transform(range(1, len(fields) + 1), lambda i: 'C' || (i - 1) || '|' || fields[i] || '|' || (i - 1) || '|0.5'), '; ') ELSE '' END AS concepts,
        CASE WHEN key % 6 <> 0 THEN array_to_string(list_transform(range(0, key % 5 + 1), lambda i: i || '|Author ' || i), '; ') ELSE '' END AS authors
        FROM papers LEFT JOIN (SELECT citing, count(*) AS c, string_agg(concat_ws('|', 's2-' || cited, cited_title, CASE WHEN cited % 3 <> 0 THEN 1975 + cited % 50 END, n), '; ' ORDER BY ref_position) FILTER (WHERE ref_position <= 20) AS told FROM cit GROUP BY 1) r ON r.citing = key
        LEFT JOIN (SELECT cited, string_agg(concat_ws('|', 's2-' || citing, citing_title, CASE WHEN citing % 3 <> 0 THEN 1975 + citing % 50 END, n), '; ' ORDER BY cite_position) FILTER (WHERE cite_position <= 20) AS told FROM cit GROUP BY 1) x ON x.cited = key WHERE key % 2 = 0"""),
    "contexts_top": _with("SELECT CAST(cited AS VARCHAR) AS paper_id, CAST(citing AS VARCHAR) AS citing_paper_id, cite_position AS rank, 'cited ' || n || ' times' AS context, is_influential FROM cit WHERE cite_position <= 20"),
    "influential_count": _with("SELECT CAST(cited AS VARCHAR) AS paper_id, count(*) AS n_citations, count(*) FILTER (WHERE is_influential) AS n_influential FROM cit GROUP BY 1"),
    "recommend_cocite": _with("SELECT CAST(p AS VARCHAR) AS paper_id, CAST(q AS VARCHAR) AS recommended_id, score, k AS rank FROM recommended"),
    "recommend_embedding": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)
        SELECT paper_id, recommended_id, round(score, 6) AS score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(score, 9) DESC, recommended_id) AS k
        FROM (SELECT a.id AS paper_id, b.id AS recommended_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.id <> b.id)) WHERE k <= 10""",
    "details_few": _with("""SELECT 's2-' || a.paper_id AS id, a.title, CAST(least(20, coalesce(x.c, 0)) AS INTEGER) AS n_contexts, CAST(r.k AS INTEGER) AS rank, 's2-' || r.q AS recommended_id, r.score
        FROM (SELECT * FROM papers WHERE key % 2 = 0 ORDER BY citation_count DESC, key LIMIT 100) a JOIN recommended r ON r.p = a.key LEFT JOIN (SELECT cited, count(*) AS c FROM cit GROUP BY 1) x ON x.cited = a.key"""),
    "paper_details": _with("""SELECT 's2-' || paper_id AS id, title, coalesce(x.contexts, '') AS contexts, coalesce(r.recommended, '') AS recommended, m.estimated_h_index AS h, m.citations_per_year AS per_year FROM papers
        LEFT JOIN (SELECT cited, string_agg(cite_position || ' s2-' || citing || ' cited ' || n || ' times ' || is_influential, '; ' ORDER BY cite_position) AS contexts FROM cit WHERE cite_position <= 20 GROUP BY 1) x ON x.cited = key
        LEFT JOIN (SELECT p, string_agg(k || ' s2-' || q || ' ' || score, '; ' ORDER BY k) AS recommended FROM recommended GROUP BY 1) r ON r.p = key
        JOIN metrics m ON m.id = 's2-' || paper_id WHERE key % 2 = 0"""),
    "authors_hindex": _with("""SELECT CAST(l_suppkey AS VARCHAR) AS author_id, min(s_name) AS name, 'nation ' || min(s_nationkey) AS affiliations, count(*) AS paper_count, CAST(sum(citation_count) AS BIGINT) AS citation_count, count(*) FILTER (WHERE citation_count >= r) AS h_index
        FROM (SELECT a.*, p.citation_count, row_number() OVER (PARTITION BY l_suppkey ORDER BY p.citation_count DESC, a.key) AS r FROM all_authors a JOIN papers p ON p.key = a.key) GROUP BY l_suppkey"""),
    "paper_authors": _with("SELECT CAST(key AS VARCHAR) AS paper_id, CAST(l_suppkey AS VARCHAR) AS author_id, s_name AS name, row_number() OVER (PARTITION BY key ORDER BY l_suppkey) - 1 AS author_position FROM all_authors"),
    "citations_table": _with("SELECT CAST(citing AS VARCHAR) AS citing_paper_id, CAST(cited AS VARCHAR) AS cited_paper_id, 2 * n AS citation_count, is_influential, 'cited ' || n || ' times' AS contexts FROM cit"),
    "papers_table": _unrolled_papers(),
    "components_global": f"SELECT paper_id AS id, cluster_id FROM ({_unrolled_papers()})",
    "doi_duplicates": _with("SELECT lower(own_doi) AS doi, count(*) AS n FROM sources WHERE own_doi IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    "title_missing": "SELECT page_id FROM pages WHERE page_id % 4 = 0",
    "cache_keys": _with("""SELECT left(sha256(CAST(n.root AS VARCHAR) || '_2_150'), 16) AS query_hash, CAST(n.root AS VARCHAR) AS root_paper_id, CAST(n.c AS INTEGER) AS node_count, CAST(coalesce(e.c, 0) AS INTEGER) AS edge_count, md5(n.told) AS nodes_md5, md5(coalesce(e.told, '')) AS edges_md5
        FROM (SELECT root, count(*) AS c, string_agg(a.id || ' ' || depth || ' ' || CASE WHEN a.state = 'basic' THEN 'paper ' || a.id ELSE p.title END, '; ' ORDER BY seq) AS told FROM all2 a JOIN papers p ON p.key = a.id GROUP BY 1) n
        LEFT JOIN (SELECT root, count(*) AS c, string_agg(f || ' ' || t || ' ' || type, '; ' ORDER BY CAST(f AS VARCHAR), CAST(t AS VARCHAR), type) AS told FROM ego_edges GROUP BY 1) e ON e.root = n.root"""),
    "cache_upkeep": """WITH c AS (SELECT user_id, event_id AS root, ts FROM events UNION ALL SELECT user_id, event_id + 1, ts + INTERVAL 1 HOUR FROM events WHERE event_id % 2 = 0)
        SELECT left(sha256(user_id || '_1_200'), 16) AS query_hash, CAST(root AS VARCHAR) AS root_paper_id, strftime(ts + INTERVAL 24 HOURS, '%Y-%m-%d') AS expires_date
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(root AS VARCHAR)) AS r FROM c WHERE ts + INTERVAL 24 HOURS > (SELECT max(ts) FROM events)) WHERE r = 1""",
    "cache_lookup": """SELECT left(sha256(user_id || '_1_200'), 16) AS query_hash, event_id AS root_paper_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS r FROM events
        WHERE ts + INTERVAL 24 HOURS > (SELECT max(ts) FROM events)) WHERE r = 1""",
    "search_log": "SELECT event_type AS query_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS n, CAST(sum(CAST(value AS INTEGER)) AS BIGINT) AS execution_time_ms FROM (SELECT event_type, ts, trunc(value) AS value FROM events) GROUP BY 1, 2",
    "network_warnings": _with("""SELECT p.paper_id AS root_id, CASE WHEN p.key % 13 = 7 THEN '无法获取论文的引用网络，仅显示单个节点' WHEN n.c = 1 THEN '无法获取该论文的引用网络，可能是因为API限制或论文数据不完整' END AS warning
        FROM papers p LEFT JOIN (SELECT root, count(*) AS c FROM n_first GROUP BY 1) n ON n.root = p.key"""),
    "single_node_networks": _with("""SELECT p.paper_id AS root_id, p.paper_id AS id, CASE WHEN p.key % 13 = 7 THEN '所选论文' ELSE p.title END AS label, CASE WHEN p.key % 13 = 7 THEN '所选论文' ELSE p.title END AS title, CASE WHEN p.key % 13 = 7 THEN '未知' ELSE p.authors END AS authors,
        0 AS depth, CAST(coalesce(e.c, 0) AS BIGINT) AS edge_count, CASE WHEN p.key % 13 = 7 THEN 1.0 ELSE 0.0 END AS score, CASE WHEN p.key % 13 = 7 THEN 25.0 ELSE round(greatest(15, log10(p.citation_count + 1) * 12), 6) END AS size, '#ff6b35' AS color
        FROM papers p LEFT JOIN (SELECT root, count(*) AS c FROM n_first GROUP BY 1) n ON n.root = p.key LEFT JOIN (SELECT root, count(*) AS c FROM e_first GROUP BY 1) e ON e.root = p.key WHERE p.key % 13 = 7 OR n.c = 1"""),
    "network_sink": _with("""SELECT p.paper_id AS root_id, false AS cached, CASE WHEN p.key % 13 = 7 THEN '无法获取论文的引用网络，仅显示单个节点' WHEN n.c = 1 THEN '无法获取该论文的引用网络，可能是因为API限制或论文数据不完整' END AS warning,
        CAST(coalesce(n.c, 1) AS INTEGER) AS n_nodes, CAST(coalesce(e.c, 0) AS INTEGER) AS n_edges, coalesce(n.ids, p.paper_id) AS ids FROM papers p
        LEFT JOIN (SELECT root, count(*) AS c, string_agg(id, ' ' ORDER BY depth, kind, position) AS ids FROM (SELECT root, id, depth, 0 AS kind, 0 AS position FROM n_first WHERE depth = 0
          UNION ALL SELECT * FROM (SELECT f.root, a.target, 1, min(a.kind) AS k, min_by(a.position, a.kind) FROM n0 f JOIN near a ON a.id = f.id WHERE a.state <> 'none' AND a.target <> f.root GROUP BY 1, 2)) GROUP BY 1) n ON n.root = p.key
        LEFT JOIN (SELECT root, count(*) AS c FROM e_first GROUP BY 1) e ON e.root = p.key"""),
    "resolve_arxiv_ids": """SELECT 'W' || (page_id + 900000) AS id, 'arxiv' AS kind, '1706.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') AS value, CAST(NULL AS VARCHAR) AS error FROM pages""",
    "lookup_paper_arxiv": r"""SELECT 'W' || (page_id + 900000) AS id, 'arxiv' AS kind, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id ELSE 'ARXIV:1706.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') END AS paper_id,
        CASE WHEN page_id % 3 = 0 THEN url ELSE trim(regexp_extract(html, '<title>(.+?)</title>', 1, 's'), E' \t\n\x0b\f\r') END AS title, CASE WHEN page_id % 3 = 0 THEN 'papers' ELSE 'arxiv' END AS found_in FROM pages""",
    "read_json_sources": _with("""SELECT s.source, s.position, s.doi, s.title, CASE s.source WHEN 'semantic_scholar' THEN CASE WHEN p.key % 4 = 0 THEN p.abstract END WHEN 'openalex' THEN p.abstract END AS abstract, coalesce(s.publication_year, 0) AS publication_year, s.citation_count, s.authors, s.venue,
        CASE WHEN s.source = 'semantic_scholar' THEN s.own END AS semantic_scholar_id, CASE WHEN s.source = 'openalex' THEN s.own END AS openalex_id FROM sources s JOIN papers p ON p.key = s.position"""),
    "read_contexts": _with("""SELECT CAST(cited AS VARCHAR) AS cited_paper_id, CAST(citing AS VARCHAR) AS citing_paper_id, citing_title, CASE WHEN citing % 2 = 0 THEN CAST(citing % 50 + 1970 AS INTEGER) ELSE 0 END AS citing_year, 'cited ' || n || ' times' AS contexts, is_influential, CAST(cite_position AS INTEGER) AS position FROM cit"""),
    "search_dispatch": _with("""SELECT position * 10 + o AS query_id, source, title, citation_count FROM sources CROSS JOIN (VALUES (0), (3)) v(o) WHERE source <> 'crossref'
        UNION ALL SELECT position * 10 + 1, source, title, citation_count FROM sources WHERE source <> 'openalex' AND own_doi IS NOT NULL
        UNION ALL SELECT position * 10 + 2, source, title, citation_count FROM sources WHERE source = 'semantic_scholar'"""),
    "coalesced_years": _with("SELECT paper_id, CASE WHEN key % 4 = 1 THEN CAST(key % 50 + 1970 AS INTEGER) ELSE coalesce(publication_year, 0) END AS year FROM papers"),
}
