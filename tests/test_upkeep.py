"""Cache upkeep, merging of dumps, facets by one scan, and networks that stop early."""

import os

import pytest
from pyspark.sql import functions as F

from scholargraph.functions import normalize
from scholargraph.operators import filters, network, search
from scholargraph.sources import fixtures as fx
from scholargraph.sources import stores
from tests.conftest import DATA


def at(s):
    return F.lit(s).cast("timestamp")


def days(path):
    return sorted(d for d in os.listdir(path) if d.startswith("expires_date"))


def test_a_write_that_is_tried_again_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([("r", "{}", 1, 0), ("s", "{}", 2, 1)], "root_id string, network_data string, node_count int, edge_count int")
    path = str(tmp_path / "cache")
    rows = stores.cache_rows(docs, 3, 200, at("2026-01-01 00:00:00"))
    for _ in range(3):
        stores.write_network_cache(rows, path, "b1")
    assert spark.read.parquet(path).count() == 2
    stores.write_network_cache(rows, path)
    assert spark.read.parquet(path).count() == 4


def test_compaction(spark, tmp_path):
    docs = spark.createDataFrame([("r", "{}", 1, 0), ("s", "{}", 2, 1)], "root_id string, network_data string, node_count int, edge_count int")
    path = str(tmp_path / "cache")
    for day in ("2026-01-01", "2026-01-03", "2026-01-04"):
        stores.write_network_cache(stores.cache_rows(docs if day != "2026-01-04" else docs.filter("root_id = 's'"), 3, 200, at(f"{day} 06:00:00")), path)
    asked = stores.cache_rows(docs, 3, 200, at("2026-01-01 00:00:00")).select("query_hash")
    now = at("2026-01-04 05:00:00")
    look = lambda: {(r.root_paper_id, str(r.generated_at)) for r in stores.read_network_cache(spark.read.parquet(path), asked, now).collect()}
    before = look()
    assert before == {("r", "2026-01-03 06:00:00"), ("s", "2026-01-04 06:00:00")}
    assert stores.compact_network_cache(spark, path, now) == 3
    assert days(path) == ["expires_date=2026-01-04", "expires_date=2026-01-05"] and spark.read.parquet(path).count() == 2 and look() == before
    # again, and from a state that was broken off between writing and dropping
    stores.write_network_cache(spark.read.parquet(path).drop("batch"), path, "broken-off")
    assert look() == before
    stores.compact_network_cache(spark, path, now)
    assert spark.read.parquet(path).count() == 2 and look() == before
    stores.compact_network_cache(spark, path, at("2027-01-01 00:00:00"))
    assert days(path) == []


def sources(spark):
    parts = [normalize.normalize_s2(fx.s2_papers(spark, DATA)), normalize.normalize_openalex(fx.openalex_works(spark, DATA)), normalize.normalize_crossref(fx.crossref_works(spark, DATA))]
    return parts


@pytest.mark.parametrize("mode", ["raw", "normalized"])
def test_dumps_in_any_order_merge_to_the_same(spark, tmp_path, mode):
    parts = sources(spark)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    told = lambda df: sorted(map(str, df.select(*sorted(whole.columns)).collect()))
    want = told(search.merge_dedup(whole, mode))
    for k, order in enumerate([(2, 0, 1)] if mode == "raw" else [(1, 2, 0)]):
        path = str(tmp_path / f"m{k}")
        for i in (*order, order[0]):
            half = F.pmod(F.xxhash64("position"), F.lit(2)) == 0
            for piece in (parts[i].filter(half), parts[i].filter(~half)):
                stores.merge_papers(spark, path, piece, mode, buckets=5)
        assert told(stores.merged_papers(spark, path)) == want


def test_only_hit_folders_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "m")
    s2 = sources(spark)[0]
    stores.merge_papers(spark, path, s2, buckets=8)
    files = lambda: {f"{d}/{f}" for d in os.listdir(path) if d.startswith("bucket") for f in os.listdir(f"{path}/{d}") if f.startswith("part")}
    before = files()
    stores.merge_papers(spark, path, s2.limit(0), buckets=8)
    assert files() == before
    stores.merge_papers(spark, path, s2.orderBy("position").limit(1), buckets=8)
    kept = before & files()
    assert len({f.split("/")[0] for f in kept}) == 7 and stores.merged_papers(spark, path).count() == search.merge_dedup(s2).count()


def test_facets_by_one_scan(spark):
    papers = fx.papers(spark, DATA)
    got = {(r.facet, r["rank"]): r.value for r in filters.facets(papers, 2026).collect()}
    years = [r[0] for r in filters.facet_years(papers).collect()]
    assert [got["year", k + 1] for k in range(len(years))] == list(map(str, years))
    for facet, rows in (("field", filters.facet_fields(papers)), ("venue", filters.facet_venues(papers))):
        want = [r[0] for r in rows.collect()]
        assert [got[facet, k + 1] for k in range(len(want))] == want
    lo, hi = filters.year_bounds(papers, 2026).first()
    assert (got["bounds", 1], got["bounds", 2]) == (str(lo), str(hi)) and len(got) == len(years) + 22
    stored = spark.read.parquet(f"{DATA}/part.parquet").select(F.col("p_size").alias("publication_year"), F.col("p_brand").alias("venue"), F.lit("").alias("journal"), F.array("p_type").alias("fields_of_study"))
    plan = filters.facets(stored, 2026)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_facets_of_odd_rows(spark):
    schema = "publication_year int, venue string, journal string, fields_of_study array<string>"
    empty = {(r.facet, r["rank"], r.value) for r in filters.facets(spark.createDataFrame([], schema), 2026).collect()}
    assert empty == {("bounds", 1, "1990"), ("bounds", 2, "2026")}
    rows = [(None, None, None, None), (0, "", "J", ["", None, "b", "b"]), (2001, None, "", []), (999, "V", None, ["a"])]
    got = {(r.facet, r["rank"], r.value) for r in filters.facets(spark.createDataFrame(rows, schema), 2026).collect()}
    assert got == {("year", 1, "2001"), ("year", 2, "999"), ("field", 1, "a"), ("field", 2, "b"), ("venue", 1, "J"), ("venue", 2, "V"), ("bounds", 1, "999"), ("bounds", 2, "2001")}


def test_the_search_stops_when_no_network_goes_on(spark, monkeypatch):
    """Depth 50 on a graph that is three levels deep: four levels are met, not fifty."""
    papers = spark.createDataFrame([(x, x.upper()) for x in "abcde"], "paper_id string, title string")
    for c, t in (("abstract", "string"), ("publication_year", "int"), ("citation_count", "int"), ("authors", "string"), ("venue", "string"), ("url", "string"), ("pdf_url", "string"), ("fields_of_study", "array<string>")):
        papers = papers.withColumn(c, F.lit(None).cast(t))
    cites = spark.createDataFrame([("a", "b", 1, 1, "B", "A"), ("b", "c", 1, 1, "C", "B"), ("c", "d", 1, 1, "D", "C")], "citing_paper_id string, cited_paper_id string, ref_position int, cite_position int, cited_title string, citing_title string")
    levels, plain = [], network.written
    monkeypatch.setattr(network, "written", lambda df, name="cut": levels.append(name) or plain(df, name))
    nodes, _ = network.ego_network(papers, cites, spark.createDataFrame([("a",), ("e",), (None,), ("a",)], "root_id string"), 50)
    assert levels.count("kept") == 4 and sorted((r.root_id, r.id, r.depth) for r in nodes.collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("e", "e", 0)]
    levels.clear()
    full, _ = network.ego_network(papers, cites, spark.createDataFrame([("a",)], "root_id string"), 50, 2)
    assert levels.count("kept") == 2 and full.count() == 2
