"""Components by contraction against plain search, with and without the last step in one task."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholargraph.operators import components as c


def brute(links):
    near = {}
    for u, v in links:
        if u is not None and v is not None:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    out = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = start
                    todo += near[x]
    return out


def told(df):
    got = df.collect()
    assert len({r.node for r in got}) == len(got)
    return {r.node: r.component for r in got}


@pytest.mark.parametrize("finish", [0, 5, 1_000_000])
def test_random_graphs(spark, finish):
    rnd = random.Random(finish)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(7, 7), (900, 900), (None, 3), (4, None), (-5, 12)] + [(1000, 1000 + k) for k in range(50)]
    df = spark.createDataFrame(links, "u long, v long").repartition(3)
    assert told(c.contracted_components(df, finish)) == brute(links)
    assert told(c.contracted_components(df.limit(0), finish)) == {}


def test_a_long_chain_in_any_order(spark, monkeypatch):
    """20,000 nodes in a row, shuffled: few rounds, each of under half the links of the one before."""
    sizes, plain = [], c.written

    def noting(df, name="cut"):
        made = plain(df, name)
        sizes.extend([made.count()] if name == "links" else [])
        return made

    monkeypatch.setattr(c, "written", noting)
    chain = spark.range(1, 20_001).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")).repartition(4, F.xxhash64("u"))
    got = c.contracted_components(chain, 100)
    assert got.count() == 20_001 and got.select("component").distinct().collect()[0][0] == 0
    assert len(sizes) <= 8 and all(b < 0.5 * a for a, b in zip(sizes, sizes[1:]))


def test_half_the_rounds_of_star_steps(spark, monkeypatch):
    rounds, plain = [], c.written

    def noting(df, name="cut"):
        rounds.append(name)
        return plain(df, name)

    monkeypatch.setattr(c, "written", noting)
    chain = spark.range(1, 2_000).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")).repartition(4, F.xxhash64("u"))
    c.components(chain).count()
    stars = rounds.count("stars")
    rounds.clear()
    c.contracted_components(chain, 100).count()
    assert rounds.count("links") - 1 <= stars / 2


def test_forest():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 50, 40), rng.integers(0, 50, 40)
    nodes, low = c.forest(u, v)
    assert dict(zip(nodes.tolist(), low.tolist())) == brute(list(zip(u.tolist(), v.tolist())))
