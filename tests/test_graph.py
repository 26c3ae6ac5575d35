"""Networks, ranks and components against a plain model written from the rules."""

import random

from pyspark.sql import functions as F

from scholargraph.operators import graph
from scholargraph.operators.components import components
from scholargraph.operators.network import ego_network

COLS = (("abstract", "string"), ("publication_year", "int"), ("citation_count", "int"), ("authors", "string"), ("venue", "string"), ("url", "string"), ("pdf_url", "string"), ("fields_of_study", "array<string>"))


def model(known, refs, cites, titles, root, depth, cap):
    """Nodes in order with depth, and edges, for one root."""
    nodes, edges, queue = {root: 0}, set(), [(root, 0)]
    for paper, at in queue:
        if at >= depth or len(nodes) >= cap:
            continue
        lists = (("reference", refs.get(paper, [])[: (20, 15, 10, 5)[min(at, 3)]]), ("citation", cites.get(paper, [])[: (15, 8, 3, 0)[min(at, 3)]]))
        for kind, targets in lists:
            for t in targets:
                if len(nodes) >= cap:
                    break
                edges.add((paper, t, kind) if kind == "reference" else (t, paper, kind))
                if t in nodes:
                    continue
                if t in known:
                    nodes[t] = at + 1
                    if at + 1 < depth and (kind == "reference" or at < 2):
                        queue.append((t, at + 1))
                elif titles.get(t):
                    nodes[t] = at + 1
    return list(nodes.items()), edges


def test_ego_network_model(spark):
    rnd = random.Random(5)
    for case, (n, m, depth, cap) in enumerate([(30, 120, 2, 200), (60, 500, 3, 40), (25, 200, 4, 25), (40, 60, 1, 5), (20, 80, 0, 10), (50, 300, 3, 1)]):
        ids = [f"p{i}" for i in range(n)]
        known = {p for p in ids if rnd.random() < 0.8}
        titles = {p: "t" for p in ids if rnd.random() < 0.7}
        pairs = list(dict.fromkeys((rnd.choice(ids), rnd.choice(ids)) for _ in range(m)))
        refs, cites, rows = {}, {}, []
        for a, b in pairs:
            refs.setdefault(a, []).append(b)
            cites.setdefault(b, []).append(a)
            rows.append((a, b, len(refs[a]), len(cites[b]), titles.get(b), titles.get(a)))
        papers = spark.createDataFrame([(p, "T" + p) for p in known], "paper_id string, title string")
        for c, t in COLS:
            papers = papers.withColumn(c, F.lit(None).cast(t))
        table = spark.createDataFrame(rows, "citing_paper_id string, cited_paper_id string, ref_position int, cite_position int, cited_title string, citing_title string")
        roots = sorted(known)[:4]
        nodes, edges = ego_network(papers, table, spark.createDataFrame([(r,) for r in roots], "root_id string"), depth, cap)
        got_n, got_e = nodes.collect(), edges.collect()
        for r in roots:
            want_n, want_e = model(known, refs, cites, titles, r, depth, cap)
            assert [(x.id, x.depth) for x in sorted(got_n, key=lambda x: x.node_seq) if x.root_id == r] == want_n, (case, r)
            assert {(x.from_id, x.to_id, x.type) for x in got_e if x.root_id == r} == want_e, (case, r)


def test_pagerank_model(spark):
    rnd = random.Random(3)
    ids = [f"n{i}" for i in range(12)]
    edges = [(rnd.choice(ids), rnd.choice(ids + ["gone"]), rnd.choice(["reference", "citation"])) for _ in range(40)] + [("gone", "n1", "reference")]
    score = {i: 1 / 12 for i in ids}
    for _ in range(20):
        new = {i: 0.15 / 12 for i in ids}
        for i in ids:
            out = [t for s, t, _ in edges if s == i]
            for t in out:
                if t in new:
                    new[t] += 0.85 * score[i] / len(out)
        score = new
    nodes = spark.createDataFrame([("a", i) for i in ids] + [("b", "x")], "root_id string, id string")
    table = spark.createDataFrame([("a", *e) for e in edges], "root_id string, from_id string, to_id string, type string")
    got = {(r.root_id, r.id): r.score for r in graph.pagerank(nodes, table).collect()}
    assert all(abs(got["a", i] - score[i]) < 1e-12 for i in ids) and abs(got["b", "x"] - 0.15) < 1e-12


def test_components(spark):
    rnd = random.Random(4)
    for n, m in ((40, 30), (60, 20), (200, 150), (10, 0)):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(5, 5), (None, 1)]
        low = list(range(n))
        for _ in range(n):
            for a, b in links:
                if a is not None:
                    low[a] = low[b] = min(low[a], low[b])
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
        assert got == {i: low[i] for a, b in links if a is not None for i in (a, b)}


def test_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components(links).collect()} == {0}


def test_cluster_numbers(spark):
    nodes = spark.createDataFrame([("r", c, i) for i, c in enumerate("abcdef")] + [("s", "a", 0), ("s", "z", 1)], "root_id string, id string, node_seq long")
    edges = spark.createDataFrame([("r", "b", "d"), ("r", "f", "c"), ("r", "a", "zz"), ("s", "z", "a")], "root_id string, from_id string, to_id string")
    got = {(r.root_id, r.id): r.cluster_id for r in graph.connected_components(nodes, edges).collect()}
    assert got == {("r", "a"): 0, ("r", "b"): 1, ("r", "d"): 1, ("r", "c"): 2, ("r", "f"): 2, ("r", "e"): 3, ("s", "a"): 0, ("s", "z"): 0}


def test_neighbors_and_subgraph(spark):
    edges = spark.createDataFrame([("r", "a", "b", "reference"), ("r", "a", "b", "citation"), ("r", "c", "a", "reference"), ("r", "a", "a", "reference")], "root_id string, from_id string, to_id string, type string")
    got = sorted(r.neighbor for r in graph.neighbors(edges, spark.createDataFrame([("r", "a")], "root_id string, id string")).collect())
    assert got == ["a", "a", "b", "b", "c"]
    nodes = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 3)], "root_id string, id string, y int")
    left, kept = graph.induced_subgraph(nodes, edges, F.col("y") < 3)
    assert left.count() == 2 and kept.count() == 3


def test_plans_have_no_cross_join_and_no_python(spark):
    from scholargraph.queries import QUERIES
    from tests.conftest import DATA

    for name in ("merge_dedup_raw", "filter_spec", "recommend_cocite", "authors_hindex", "merge_details", "induced_subgraph_year", "lookup_paper"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow")), name


def test_recommendations_count_all_positions(spark):
    from scholargraph.operators.details import recommend

    made = [("A", f"p{k}", k, 1) for k in range(1, 151)] + [("B", "p149", 1, 2), ("B", "p150", 2, 2)]
    df = spark.createDataFrame(made, "citing_paper_id string, cited_paper_id string, ref_position int, cite_position int")
    for part_rows in (7, 1_000):
        got = {(r.paper_id, r.recommended_id): (r.score, r["rank"]) for r in recommend(df, part_rows=part_rows).collect()}
        assert got["p149", "p150"] == got["p150", "p149"] == (2, 1) and got["A", "B"] == (2, 1)
