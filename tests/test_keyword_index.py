"""The stored index against a full evaluation, what it reads, and its edge cases."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholargraph.operators import keyword_index
from scholargraph.operators.search import search_keyword

DOCS = "id string, source string, title string, abstract string"


def corpus(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.7)) % 200}" for _ in range(40_000)]
    return [(f"d{i}", rnd.choice(["a", "a", "b"]), rnd.choice(words), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(n)]


def brute(rows, queries, k=20):
    found = set()
    for s in {r[1] for r in rows if r[1] is not None}:
        docs = {(r[0], " ".join(x for x in r[2:] if x is not None)) for r in rows if r[1] == s}
        split = {d: Counter(w for w in re.split(r"[\W_]+", d[1].lower()) if w) for d in docs}
        avg = sum(sum(c.values()) for c in split.values()) / len(split)
        df = Counter(w for c in split.values() for w in c)
        for q, text in queries:
            want = {w for w in re.split(r"[\W_]+", (text or "").lower()) if w}
            score = {d: sum(math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in want if w in c) for d, c in split.items()}
            best = sorted(((-round(x, 9), d[0]) for d, x in score.items() if x), key=lambda x: (x[0], x[1] or ""))[:k]
            found |= {(q, s, d, round(-x, 6), i + 1) for i, (x, d) in enumerate(best)}
    return found


def told(df):
    return {(r.query_id, r.source, r.id, round(r.score, 6), r["rank"]) for r in df.collect()}


QUERIES = [(1, "w1 w2"), (2, "W3, w50 w7"), (3, "w1"), (4, None), (5, " ; "), (6, "nowhere"), (7, "w9 w10 w11 w12 w13"), (7, "w9 w10 w11 w12 w13")]


@pytest.mark.parametrize("block, part_rows", [(4, 10), (128, 50_000)])
def test_index_equals_a_full_evaluation(spark, tmp_path, block, part_rows):
    rows = corpus(1) + [("d1", None, "w1", "w1"), ("d7", "b", None, None), (None, "a", "w1 w2", None), ("x", "b", "w1", "w3"), ("x", "b", "w1", "w3"), ("x", "b", "w1", "w1 w1")]
    docs = spark.createDataFrame(rows, DOCS)
    keyword_index.build(docs, str(tmp_path / "i"), block=block, part_rows=part_rows, buckets=8)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    assert told(keyword_index.search(spark, str(tmp_path / "i"), queries)) == brute(rows, QUERIES)


def test_only_the_terms_directories_are_read(spark, tmp_path):
    path = str(tmp_path / "i")
    keyword_index.build(spark.createDataFrame(corpus(2), DOCS), path, buckets=32)
    asked = spark.createDataFrame([("w1",), ("w5",)], "term string")
    table = keyword_index.postings(spark, path, asked, 32)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    everything = spark.read.parquet(f"{path}/postings")
    held = {r[0] for r in table.select("bucket").distinct().collect()}
    files = {r[0] for r in table.select(F.input_file_name()).distinct().collect()}
    assert len(held) <= 2 and len(files) <= 2 < everything.select("bucket").distinct().count()


def test_blocks_that_cannot_matter_are_skipped(spark, tmp_path, monkeypatch):
    """One word in 3,000 documents, often in a few: of some 190 blocks of it a handful is read."""
    rows = [(f"d{i:04d}", "a", "t", "word " * (30 if i < 40 else 1) + "other words of a text " * (i % 7 + 1)) for i in range(3_000)]
    path, kept = str(tmp_path / "i"), []
    keyword_index.build(spark.createDataFrame(rows, DOCS), path, block=16)
    plain = keyword_index.written

    def noting(df, name="cut"):
        made = plain(df, name)
        kept.extend([made.count()] if name in ("blocks", "kept") else [])
        return made

    monkeypatch.setattr(keyword_index, "written", noting)
    queries = spark.createDataFrame([(1, "word")], "query_id int, query string")
    got = told(keyword_index.search(spark, path, queries))
    assert kept[0] > 150 and kept[1] <= 4
    assert got == brute(rows, [(1, "word")])


def test_many_terms_are_joined(spark, tmp_path, monkeypatch):
    rows = corpus(3)
    path = str(tmp_path / "i")
    keyword_index.build(spark.createDataFrame(rows, DOCS), path)
    monkeypatch.setattr(keyword_index, "LISTED_TERMS", 2)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    assert told(keyword_index.search(spark, path, queries)) == brute(rows, QUERIES)
    live = {(r.query_id, r.source, r.id, round(r.score, 6)) for r in search_keyword(spark.createDataFrame(rows, DOCS), queries.distinct()).collect()}
    assert live == {x[:4] for x in brute(rows, QUERIES)}


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "i")
    keyword_index.build(spark.createDataFrame([], DOCS), path)
    assert keyword_index.search(spark, path, spark.createDataFrame([(1, "a")], "query_id int, query string")).count() == 0


def test_no_row_of_a_document_and_term_is_written_between(spark, tmp_path, monkeypatch):
    """What is kept on the way to the index is a row a document at most; each posting is in one part."""
    rows, sizes, plain = corpus(4), [], keyword_index.written

    def noting(df, name="cut"):
        made = plain(df, name)
        sizes.append(made.count())
        return made

    monkeypatch.setattr(keyword_index, "written", noting)
    path = str(tmp_path / "i")
    keyword_index.build(spark.createDataFrame(rows, DOCS).repartition(3), path, block=8, part_rows=20)
    assert max(sizes) <= len(rows)
    table = spark.read.parquet(f"{path}/postings")
    assert table.agg(F.max("part")).first()[0] > 0 and table.agg(F.max(F.size("held"))).first()[0] <= 8
    got = [(r.source, r.term, r.id) for r in table.select("source", "term", F.explode("held.id").alias("id")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, w, d) for d, s, *texts in rows for x in texts for w in x.split()}


def test_many_copies_of_an_id_are_one_document(spark, tmp_path, monkeypatch):
    """Also where ids that are there again are too many to be sent along."""
    rows = corpus(5, 60) + [("d1", "a", "w1", "w2 w2")] * 300 + [("d2", "a", "w1", "w2"), (None, "b", "w1", "w9"), (None, "b", "w1", "w9"), (None, "b", "w3", "w9")]
    path = str(tmp_path / "i")
    monkeypatch.setattr(keyword_index, "maybe_broadcast", lambda df, n: df)
    keyword_index.build(spark.createDataFrame(rows, DOCS).repartition(5), path, block=16)
    assert told(keyword_index.search(spark, path, spark.createDataFrame(QUERIES, "query_id int, query string"))) == brute(rows, QUERIES)


def test_more_files_than_tasks(spark, tmp_path, monkeypatch):
    """A large index is dealt to more tasks than a shuffle has by default; a file holds one bucket."""
    rows, path = corpus(6), str(tmp_path / "i")
    monkeypatch.setattr(keyword_index, "FILE_WORDS", 300)
    keyword_index.build(spark.createDataFrame(rows, DOCS).repartition(3), path, buckets=8, block=16, part_rows=50)
    files = spark.read.parquet(f"{path}/postings").select("bucket", F.input_file_name().alias("f")).distinct().count()
    assert 8 < files <= 8 * (sum(len(t.split()) for r in rows for t in r[2:]) // (8 * 300) + 1)
    assert told(keyword_index.search(spark, path, spark.createDataFrame(QUERIES, "query_id int, query string"))) == brute(rows, QUERIES)
