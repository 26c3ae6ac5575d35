"""The shared folder, joined search terms, and stored tables on odd rows."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F


class Settings(dict):
    def set(self, key, value):
        self[key] = value


def session(master, folder=None, of_context=None):
    found = SimpleNamespace(isDefined=lambda: of_context is not None, get=lambda: of_context)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: found)))
    return SimpleNamespace(conf=Settings({"spark.checkpoint.dir": folder} if folder else {}), sparkContext=context)


def test_shared_folder_of_a_cluster():
    from scholargraph.plans.cutpoints import shared_dir

    assert shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_dir(session("spark://x:7077", of_context="hdfs:///of/context")) == "hdfs:///of/context"
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
    made = session("local[4]")
    assert shared_dir(made).startswith("/tmp/spark-") and shared_dir(made) == made.conf["spark.checkpoint.dir"]


def test_many_search_terms_are_joined(spark):
    import scholargraph.operators.search as search

    docs = spark.createDataFrame([(i, f"s{i % 3}", None if i % 7 == 0 else f"word{i % 5} common", f"text {i % 11} common") for i in range(60)] + [(99, None, "common", None)], "id int, source string, title string, abstract string")
    queries = spark.createDataFrame([(1, "word1 common"), (2, "10 word3"), (3, None), (4, ""), (5, "absent")], "query_id int, query string")
    told = lambda: sorted((r.query_id, r.source, r.id, round(r.score, 9), r["rank"]) for r in search.search_keyword(docs, queries).collect())
    few = told()
    kept, search.LISTED_TERMS = search.LISTED_TERMS, 0
    try:
        assert told() == few and {r[0] for r in few} == {1, 2} and not any(r[1] is None for r in few)
    finally:
        search.LISTED_TERMS = kept


def test_authors_and_papers_tables(spark):
    from scholargraph.operators import tables

    made = [("p1", 3, [("a", "Ann", ["U", "V"]), (None, "Nobody", None)]), ("p2", 1, [("a", "Anna", ["U", None])]), ("p2", 1, [("a", "Ann", None)]), ("p3", None, [("b", "Bob", None)]), ("p4", 9, None)]
    papers = spark.createDataFrame(made, "paper_id string, citation_count int, authors array<struct<id:string,name:string,affiliations:array<string>>>")
    got = {r.author_id: (r.name, r.affiliations, r.paper_count, r.citation_count, r.h_index) for r in tables.build_authors(papers).collect()}
    assert got == {"a": ("Ann", ["U", "V"], 2, 4, 1), None: ("Nobody", [], 1, 3, 1), "b": ("Bob", [], 1, 0, 0)}
    assert tables.build_authors(papers.limit(0)).count() == 0
    ranks, clusters = spark.createDataFrame([("p1", 0.5)], "id string, score double"), spark.createDataFrame([("p1", 0)], "id string, cluster_id long")
    rows = tables.build_papers(papers.select("paper_id", "citation_count"), ranks, clusters, F.lit("2026-01-01").cast("timestamp")).collect()
    assert len(rows) == 5 and {(r.paper_id, r.page_rank_score, r.cluster_id) for r in rows} == {("p1", 0.5, 0), ("p2", 0.0, None), ("p3", 0.0, None), ("p4", 0.0, None)}
    assert all(str(r.updated_at) == "2026-01-01 00:00:00" for r in rows)


def test_recommendations_of_odd_rows(spark):
    from scholargraph.operators.details import recommend

    made = [("A", "x"), ("A", "y"), ("A", "y"), ("A", None), (None, "x"), ("B", "x"), ("B", "y"), ("C", "C")]
    df = spark.createDataFrame(made, "citing_paper_id string, cited_paper_id string")
    got = {(r.paper_id, r.recommended_id, r.score, r["rank"]) for r in recommend(df).collect()}
    assert got == {("x", "y", 2, 1), ("y", "x", 2, 1), ("A", "B", 2, 1), ("B", "A", 2, 1)}
    assert recommend(df.limit(0)).count() == 0
