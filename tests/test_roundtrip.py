"""Texts to inverted indexes and back, row by row."""

from pyspark.sql import functions as F

from scholargraph import queries
from scholargraph.functions import normalize
from scholargraph.oracles import ORACLES


def test_every_row_comes_back_whatever_its_id_and_text(spark, tmp_path):
    """Repeated and null ids, texts without words, equal rows: as the SQL gives them."""
    import duckdb

    texts = [(1, "b  a\tb \n c"), (1, "a a"), (1, "a a"), (None, "x y"), (None, "z"), (2, ""), (3, " \n\t "), (4, None), (5, "é   é"), (6, "w " * 3_000 + "end")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.abstract) for r in queries.abstract_roundtrip(spark, str(tmp_path)).collect()]
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(got, key=repr) == sorted(c.execute(ORACLES["abstract_roundtrip"]).fetchall(), key=repr) and len(got) == 9


def test_places_of_words(spark):
    row = spark.createDataFrame([(["b", "a", "b", "c", "a"], [])], "w array<string>, none array<string>").select(normalize.inverted_index(F.col("w")), normalize.inverted_index(F.col("none"))).first()
    assert tuple(row) == ({"a": [1, 4], "b": [0, 2], "c": [3]}, {})
