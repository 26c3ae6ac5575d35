"""Recommendations against brute force, whatever counts as a heavy list, and details of few papers."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholargraph.operators.details import paper_details, recommend
from scholargraph.sources import fixtures as fx
from tests.conftest import DATA


def brute(links, limit=10, asked=None):
    lists = {}
    for a, b in set(links):
        lists.setdefault(("r", a), set()).add(b)
        lists.setdefault(("c", b), set()).add(a)
    score = Counter((p, q) for x in lists.values() for p in x for q in x if p != q)
    best = {}
    for (p, q), n in score.items():
        best.setdefault(p, []).append((-n, q))
    return {(p, q, -n, k + 1) for p, x in best.items() if asked is None or p in asked for k, (n, q) in enumerate(sorted(x)[:limit])}


def made(spark, links):
    return spark.createDataFrame(links, "citing_paper_id string, cited_paper_id string")


def told(df):
    return {(r.paper_id, r.recommended_id, r.score, r["rank"]) for r in df.collect()}


def graph(seed):
    """Some hubs that cite or are cited by many, papers of the very same lists, and a thin rest."""
    rnd = random.Random(seed)
    links = [(f"p{rnd.randrange(60)}", f"p{rnd.randrange(60)}") for _ in range(150)]
    for hub in ("h1", "h2", "p3"):
        links += [(f"p{k}", hub) for k in range(60) if rnd.random() < 0.5]
    links += [("survey", f"p{k}") for k in range(40)] + [(f"twin{k}", h) for k in range(15) for h in ("h1", "h2", "p3")]
    return links


@pytest.mark.parametrize("seed", [0])
def test_any_bound_of_heavy_lists_gives_the_same(spark, seed):
    links = graph(seed)
    want = brute(links)
    for heavy, part_rows in ((1, 3), (6, 2), (500, 1_000)):
        assert told(recommend(made(spark, links), heavy=heavy, part_rows=part_rows)) == want, heavy


def test_asked_papers_only(spark):
    links = graph(7)
    asked = ["p1", "h1", "twin3", "nobody", None, "p1"]
    rows = spark.createDataFrame([(x,) for x in asked], "id string")
    for heavy in (3, 500):
        assert told(recommend(made(spark, links), limit=3, asked=rows, heavy=heavy)) == brute(links, 3, set(asked))
    assert recommend(made(spark, links), asked=rows.limit(0)).count() == 0


def test_a_hub_of_200000(spark):
    """Every paper cites the hub and one of 50,000 others: no list of the hub's length is paired."""
    n = 200_000
    k = F.col("id")
    links = spark.range(n).select(F.explode(F.array(F.lit("hub"), F.concat(F.lit("r"), (k % 50_000).cast("string")))).alias("cited_paper_id"), F.format_string("p%06d", k).alias("citing_paper_id"))
    began = time.time()
    got = recommend(links).filter("paper_id in ('p150007', 'hub', 'r9')").collect()
    assert time.time() - began < 120
    of = {p: [(r.recommended_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.paper_id == p] for p in ("p150007", "hub", "r9")}
    assert of["p150007"] == [("p000007", 2), ("p050007", 2), ("p100007", 2)] + [(f"p{i:06d}", 1) for i in range(8) if i != 7]
    assert of["r9"] == [("hub", 4)] and len(of["hub"]) == 10 and all(s == 4 for _, s in of["hub"])


def test_details_of_few_papers(spark):
    """The same rows for few asked papers as for all, and only their lists are expanded."""
    s2, works = fx.s2_papers(spark, DATA), fx.openalex_works(spark, DATA)
    named = fx.citations(spark, DATA).withColumns({c: F.concat(F.lit("s2-"), c) for c in ("citing_paper_id", "cited_paper_id")})
    every = s2.select(F.col("paperId").alias("id"))
    few = ["s2-2", "s2-36", "s2-100"]
    whole = {r.id: r for r in paper_details(every, s2, works, named, 2026).collect()}
    some = paper_details(spark.createDataFrame([(x,) for x in [*few, None, "nobody", "s2-2"]], "id string"), s2, works, named, 2026).collect()
    assert sorted(r.id for r in some) == sorted(few) and all(r == whole[r.id] for r in some)
