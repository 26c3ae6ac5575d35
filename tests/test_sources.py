import json

from pyspark.sql import functions as F

from scholargraph.functions import normalize
from scholargraph.operators import search
from scholargraph.sources import records, stores


def test_json_dumps(spark, tmp_path):
    (tmp_path / "s2.json").write_text(json.dumps({"paperId": "p", "title": "T", "citationCount": None, "authors": [{"name": "A"}, {"name": None}], "url": "https://doi.org/10.1234/x", "position": 1}) + "\nnot json\n")
    s2 = records.read_s2_papers(spark, str(tmp_path / "s2.json"))
    got = normalize.normalize_s2(s2.filter("paperId is not null")).first()
    assert (got.citation_count, got.authors, got.doi, got.source_rank) == (0, "A, ", "10.1234/x", 0)
    (tmp_path / "cr.json").write_text(json.dumps({"message": {"DOI": "10.1/X", "title": [], "author": [{"given": "G"}, {"family": "F"}], "published": {"date-parts": [[2020]]}, "position": 1}}))
    got = normalize.normalize_crossref(records.read_crossref_works(spark, str(tmp_path / "cr.json"))).first()
    assert (got.title, got.authors, got.publication_year, got.doi) == (None, "G ,  F", 2020, "10.1/X")
    (tmp_path / "oa.json").write_text(json.dumps({"id": "W1", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": ""}}, {"author": {"display_name": "Z"}}], "position": 1}))
    got = normalize.normalize_openalex(records.read_openalex_works(spark, str(tmp_path / "oa.json"))).first()
    assert (got.abstract, got.authors, got.is_open_access, got.fields_of_study) == ("a b", "Z", False, [])
    (tmp_path / "cc.json").write_text(json.dumps({"cited_paper_id": "p", "contexts": ["c"], "citingPaper": {"paperId": "q"}}))
    got = records.read_citation_contexts(spark, str(tmp_path / "cc.json")).first()
    assert (got.citing_paper_id, got.is_influential, got.contexts) == ("q", False, ["c"])


def test_missing_sources_are_empty(spark, tmp_path):
    s2, oa, cr = (f(spark, str(tmp_path / "no")) for f in (records.read_s2_papers, records.read_openalex_works, records.read_crossref_works))
    queries = spark.createDataFrame([(1, "attention", "keyword"), (2, "10.1/x", "doi"), (3, " ", None)], "query_id int, query string, query_type string")
    assert search.search(queries, s2, oa, cr).count() == 0
    assert [r.error for r in search.valid_queries(queries).orderBy("query_id").collect()] == [None, None, "query is required"]


def test_search_dispatch(spark, tmp_path):
    from scholargraph.sources import fixtures as fx
    from tests.conftest import DATA

    s2, oa, cr = fx.s2_papers(spark, DATA), fx.openalex_works(spark, DATA), fx.crossref_works(spark, DATA)
    queries = spark.createDataFrame([(1, "widget", "keyword"), (2, "https://doi.org/10.1234/PART.30", "doi"), (3, "s2-4", "semantic_scholar"), (4, "bolt", "odd")], "query_id int, query string, query_type string")
    got = search.top_results(search.search(queries, s2, oa, cr, "normalized"), 50, ["query_id"]).collect()
    by = {q: [r for r in got if r.query_id == q] for q in (1, 2, 3, 4)}
    assert by[2] and all(r.doi.lower() == "10.1234/part.30" for r in by[2]) and [r.semantic_scholar_id for r in by[3]] == ["s2-4"]
    assert by[1] and all("widget" in r.title for r in by[1]) and by[4] and all(r.source != "crossref" for r in by[1])
    stats = search.search_stats(search.search(queries, s2, oa, cr), ["query_id"]).count()
    assert stats == 4


def test_cache_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("r", "{}", 1, 0)], "root_id string, network_data string, node_count int, edge_count int")
    at = lambda s: F.lit(s).cast("timestamp")
    path = str(tmp_path / "cache")
    for now in ("2026-01-01 00:00:00", "2026-01-01 06:00:00"):
        stores.write_network_cache(stores.cache_rows(docs, 3, 200, at(now)), path)
    asked = stores.cache_rows(docs, 3, 200, at("2026-01-01 00:00:00")).select("query_hash")
    live = lambda now: stores.read_network_cache(spark.read.parquet(path), asked, at(now)).collect()
    assert [str(r.generated_at) for r in live("2026-01-01 07:00:00")] == ["2026-01-01 06:00:00"]
    assert len(live("2026-01-02 05:00:00")) == 1 and live("2026-01-02 06:00:00") == []


def test_network_sink(spark, tmp_path):
    from scholargraph.operators.network import ego_network

    papers = spark.createDataFrame([("a", "A"), ("b", "B")], "paper_id string, title string")
    for c, t in (("abstract", "string"), ("publication_year", "int"), ("citation_count", "int"), ("authors", "string"), ("venue", "string"), ("url", "string"), ("pdf_url", "string"), ("fields_of_study", "array<string>")):
        papers = papers.withColumn(c, F.lit(None).cast(t))
    cites = spark.createDataFrame([("a", "b", 1, 1, "B", "A")], "citing_paper_id string, cited_paper_id string, ref_position int, cite_position int, cited_title string, citing_title string")
    nodes, edges = ego_network(papers, cites, spark.createDataFrame([("a",), ("zz",)], "root_id string"), 1)
    stores.write_network(nodes, edges, str(tmp_path / "out"))
    got = {r.root_id: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    data = json.loads(got["a"].data)
    assert [n["id"] for n in data["nodes"]] == ["a", "b"] and data["edges"] == [{"from_id": "a", "to_id": "b", "type": "reference", "weight": 1}]
    assert got["zz"].warning and got["a"].warning is None and json.loads(got["zz"].data)["nodes"][0]["label"] == "所选论文"
