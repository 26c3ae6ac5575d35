import pytest
from pyspark.sql import functions as F

from scholargraph.functions import ids, normalize, style


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0] if names else spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, kind, value",
    [
        ("10.48550/arXiv.1706.03762", "doi", "10.48550/arXiv.1706.03762"),
        ("10.1038/nature12373", "doi", "10.1038/nature12373"),
        ("1706.03762", "arxiv", "1706.03762"),
        ("https://doi.org/10.48550/arxiv.1706.03762v2", "arxiv", "1706.03762v2"),
        ("https://doi.org/10.48550/arXiv.1706.03762", None, None),
        ("arXiv:1706.03762", "arxiv", "1706.03762"),
        ("arxiv1706.03762", "arxiv", "1706.03762"),
        ("arxiv:cs/0112017", None, None),
        ("W2741809807", "openalex", "W2741809807"),
        ("https://openalex.org/W2741809807", "openalex", "https://openalex.org/W2741809807"),
        ("https://doi.org/10.1038/nature12373", "s2", "https://doi.org/10.1038/nature12373"),
        (" 10.1/x ", "doi", "10.1/x"),
        ("a" * 40, "s2", "a" * 40),
        ("", None, None),
    ],
)
def test_classify(spark, raw, kind, value):
    got = one(spark, ids.classify_paper_id(F.col("s")), s=raw)
    assert (got["kind"], got["value"]) == (kind, value) and (got["error"] is None) == (kind is not None)


def test_classify_any_case(spark):
    assert one(spark, ids.classify_paper_id(F.col("s"), strict=False), s="https://doi.org/10.48550/arXiv.1706.03762")["value"] == "1706.03762"


@pytest.mark.parametrize("url, doi", [("https://doi.org/10.1038/nature12373", "10.1038/nature12373"), ("http://x/y", None), (None, None), ("10.12/x", None), ("see 10.1234/A(b)-c:d/e_f, now", "10.1234/A(b)-c:d/e_f")])
def test_extract_doi(spark, url, doi):
    assert one(spark, ids.extract_doi(F.col("s")), s=url) == doi


def test_small_id_functions(spark):
    assert one(spark, ids.strip_arxiv_version(F.col("s")), s="1706.03762v12") == "1706.03762"
    assert one(spark, ids.strip_doi_resolver(F.col("s")), s="https://doi.org/10.1/x") == "10.1/x"
    assert one(spark, ids.arxiv_from_doi(F.col("s")), s="10.48550/arxiv.1706.03762") == "1706.03762"
    assert one(spark, ids.arxiv_from_doi(F.col("s")), s="10.48550/arXiv.1706.03762") is None
    assert one(spark, ids.openalex_work_id(F.col("s")), s="https://openalex.org/W12") == "W12"
    assert one(spark, ids.openalex_work_id(F.col("s")), s="W123456") == "W123456"
    assert one(spark, ids.openalex_work_id(F.col("s")), s="W12") is None
    import hashlib

    assert one(spark, ids.network_query_hash(F.col("s"), 3, 200), s="p") == hashlib.sha256(b"p_3_200").hexdigest()[:16]


@pytest.mark.parametrize(
    "index, text",
    [("map('b', array(1), 'a', array(0, 2))", "a b a"), ("cast(map() as map<string,array<int>>)", ""), ("cast(null as map<string,array<int>>)", None), ("map('a', array(0), 'b', array(0, 5))", "b b"), ("map('', array(0), 'x', array(1))", "x")],
)
def test_abstract(spark, index, text):
    assert spark.range(1).select(normalize.reconstruct_abstract(F.expr(index))).first()[0] == text


@pytest.mark.parametrize("s, out", [("", "未知作者"), (None, "未知作者"), ("A", "A"), ("A, B, C", "A, B, C"), ("A, B, C, D", "A, B, C 等")])
def test_format_authors(spark, s, out):
    assert one(spark, normalize.format_authors(F.col("s")), s=s) == out


@pytest.mark.parametrize("c, y, out", [(10, 2023, 3.33), (0, 2020, 0.0), (5, 2026, 0.0), (5, 2030, 0.0), (1, 1826, 0.01), (5, 0, 0.0)])
def test_citations_per_year(spark, c, y, out):
    assert one(spark, style.citations_per_year(F.col("c"), F.col("y"), 2026), c=c, y=y) == out


def test_sizes(spark):
    assert one(spark, style.citation_node_size(F.col("c")), c=0) == 15.0
    assert one(spark, style.citation_node_size(F.col("c")), c=999) == pytest.approx(36.0)
    assert one(spark, style.rank_node_size(F.col("c")), c=0.15) == pytest.approx(150.0)
    assert one(spark, style.estimated_h_index(F.col("c")), c=3) == 3
    assert one(spark, style.estimated_h_index(F.col("c")), c=0) == 0


def test_names_keep_null_places(spark):
    df = spark.createDataFrame([(["a", None, "b"],), (None,)], "n array<string>")
    assert [r[0] for r in df.select(normalize.joined_names(F.col("n"))).collect()] == ["a, , b", ""]


def test_arxiv_record(spark):
    from scholargraph.sources.records import read_arxiv_atom

    xml = "<feed><entry><title> A\n b </title><summary> x \n y </summary><published>2017-06-12T00:00:00Z</published><author><name>N One</name></author><author><name> Two </name></author></entry></feed>"
    df = spark.createDataFrame([("1706.03762v2", xml), ("1", "<feed/>")], "arxiv_id string, xml string")
    got = normalize.normalize_arxiv(read_arxiv_atom(df), 2026, details=True).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.paper_id, r.title, r.abstract, r.publication_year, r.authors, r.url) == ("ARXIV:1706.03762v2", "A\n b", "x y", 2017, "N One, Two", "https://arxiv.org/abs/1706.03762")
    assert (r.journal, r.publication_types, r.fields_of_study) == ("arXiv", ["preprint"], ["Computer Science"])
