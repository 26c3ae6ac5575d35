"""What is moved grows with the input, not with pairs, candidates or steps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scholargraph import queries
from scholargraph.operators import components, details, similar
from scholargraph.operators import graph as ranking
from scholargraph.plans import cutpoints
from tests.conftest import DATA
from tests.test_recommend import brute, graph, made, told


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block, most", [(1, 10**9), (7, 5), (2_048, 3)])
def test_blocks_of_any_size_count_the_same(spark, monkeypatch, block, most):
    monkeypatch.setattr(details._met, "__defaults__", (block, most))
    monkeypatch.setattr(details, "COUNTED", 500)
    for asked in (None, ["p1", "h1", "twin3", "nobody"]):
        rows = None if asked is None else spark.createDataFrame([(x,) for x in asked], "id string")
        assert told(details.recommend(made(spark, graph(4)), asked=rows)) == brute(graph(4), asked=None if asked is None else set(asked))


def test_many_asked_papers(spark, monkeypatch):
    """More asked papers than are sent to every task: lists are left out after they are made."""
    monkeypatch.setattr(details, "BROADCAST_ROWS", 2)
    asked = random.Random(1).sample([f"p{i}" for i in range(60)], 20)
    assert told(details.recommend(made(spark, graph(5)), asked=spark.createDataFrame([(x,) for x in asked], "id string"))) == brute(graph(5), asked=set(asked))


def test_no_pair_is_moved(spark):
    """The counted pairs are never grouped apart from their lists: one exchange of lists, none by (p, q)."""
    got = plan(details.recommend(made(spark, graph(2))))
    assert "REPARTITION_BY_NUM" in got and "p#" not in "".join(x for x in got.splitlines() if "ENSURE_REQUIREMENTS" in x)


def test_lone_networks_are_told_before_nodes_are(spark):
    """Only networks without neighbours are unfolded and joined with papers; the citation pairs are there already."""
    got = plan(queries.single_node_networks(spark, DATA))
    assert "size(new_at" in got and "lineitem" not in got


@pytest.mark.parametrize("groups, rows", [(1, 10**6), (3, 5)])
def test_parts_come_to_a_group_once(spark, monkeypatch, groups, rows):
    """Any number of groups gives the same, and a group gets each part it meets in one row."""
    rnd = random.Random(3)
    vectors = {i: [rnd.gauss(0, 1) for _ in range(6)] for i in range(60)}
    frame = spark.createDataFrame(list(vectors.items()), "id long, embedding array<double>")
    monkeypatch.setattr(similar, "GROUPS", groups)
    monkeypatch.setattr(similar, "GROUP_ROWS", rows)
    got = {}
    for r in similar.nearest(frame, 4, cells=5, part_rows=4, first=2).collect():
        got.setdefault(r.paper_id, []).append((r["rank"], r.recommended_id))
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in vectors.items()}
    for i, v in unit.items():
        near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in unit.items() if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]


def test_edges_are_dealt_out_once_by_block(spark, monkeypatch):
    """Blocks are packed where they stay: the packed rows are neither written nor exchanged again."""
    names, plain = [], ranking.written
    monkeypatch.setattr(ranking, "written", lambda df, name="cut": names.append(name) or plain(df, name))
    ends = spark.createDataFrame([(1, 2, 3), (1, 3, 3), (9000, 1, 3)], "src long, dst long, n long")
    blocks = ranking._edge_blocks(ends.withColumn("share", F.lit(0.5)).withColumn("base", F.lit(0.1)), ends, 13, 10)
    assert "blocks" not in names and plan(blocks).count("Exchange hashpartitioning(b") == 1
    assert sorted((r.b, list(r.dst)) for r in blocks.collect()) == [(0, [2, 3]), (1, [1])]


def test_tables_of_nodes_are_not_sent_along(spark, monkeypatch):
    """Beyond a few rows, components send partitions' counts and one number a network only, whatever the files' sizes."""
    plans, plain = [], components.written

    def noting(df, name="cut"):
        plans.append(plan(df))
        return plain(df, name)

    monkeypatch.setattr(cutpoints, "NUMBER_ROWS", 0, raising=False)
    for module in (components, ranking):
        monkeypatch.setattr(module, "written", noting)
    nodes = spark.range(400).select(F.lit("all").alias("root_id"), F.col("id").cast("string").alias("id"), F.col("id").alias("node_seq"))
    edges = spark.range(20, 400).select(F.lit("all").alias("root_id"), F.col("id").cast("string").alias("from_id"), (F.col("id") - 20).cast("string").alias("to_id"))
    got = ranking.connected_components(nodes, edges)
    assert {(int(r.id), r.cluster_id) for r in got.collect()} == {(k, k % 20) for k in range(400)}
    links = spark.range(20, 400).select(F.col("id").alias("u"), (F.col("id") - 20).alias("v")).union(spark.createDataFrame([(5, 5), (900, 900)], "u long, v long"))
    found = components.contracted_components(links, 5)
    assert {(r.node, r.component) for r in found.collect()} == {(k, k % 20) for k in range(400)} | {(900, 900)}
    sent = {re.sub(r"#\d+L?", "", x) for p in [*plans, plan(got), plan(found)] for x in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", p)}
    assert sent <= {"__p", "root_id"}
