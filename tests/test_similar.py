"""Nearest rows by embedding against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholargraph.operators.similar import nearest
from tests.conftest import DATA


def brute(ids, v, k=10, asked=None):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near, out = np.round(u @ u.T, 9), set()
    for i, a in enumerate(ids):
        if asked is None or a in asked:
            order = [j for j in sorted(range(len(ids)), key=lambda j: (-near[i, j], ids[j])) if j != i][:k]
            out |= {(a, ids[j], r + 1) for r, j in enumerate(order)}
    return out


def told(df):
    return {(r.paper_id, r.recommended_id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("cells, part_rows, first", [(None, 2_000, 8), (20, 9, 1)])
def test_exact_for_any_cells_and_parts(spark, cells, part_rows, first):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((6, 12)) * 3
    v = np.concatenate([middle[rng.integers(0, 6, 200)] + rng.standard_normal((200, 12)) * 0.6, rng.standard_normal((60, 12)), np.repeat(rng.standard_normal((1, 12)), 40, 0)])
    ids = [f"p{i}" for i in range(len(v))]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id string, embedding array<double>")
    assert told(nearest(rows, cells=cells, part_rows=part_rows, first=first)) == brute(ids, v)
    asked = spark.createDataFrame([("p3",), ("p255",), ("p299",), (None,), ("nobody",)], "id string")
    assert told(nearest(rows, 4, asked, cells=cells, part_rows=part_rows, first=first)) == brute(ids, v, 4, {"p3", "p255", "p299"})


def test_recall_on_the_given_table(spark):
    """All of the given rows: recall against brute force is 1."""
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = told(nearest(table.select(F.col("vec_id").alias("id"), "embedding"), cells=9, part_rows=50, first=2))
    held = table.orderBy("vec_id").toPandas()
    want = brute(held.vec_id.tolist(), np.array(held.embedding.tolist(), np.float64))
    assert len(got & want) / len(want) == 1 and len(got) == len(want)


def test_far_parts_are_not_met(spark, monkeypatch):
    """Tight groups far from each other: the second pass has hardly a pair left."""
    from scholargraph.operators import similar

    rng = np.random.default_rng(5)
    v = np.concatenate([np.eye(16)[i] * 10 + rng.standard_normal((50, 16)) * 0.05 for i in range(16)])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    made, plain = [], similar._pairs
    monkeypatch.setattr(similar, "_pairs", lambda *a: made.append(plain(*a)) or made[-1])
    got = told(nearest(rows, cells=16, part_rows=50, first=3))
    assert got == brute(list(range(len(v))), v)
    assert made[1].count() < 0.3 * made[0].select("part").distinct().count() ** 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    made = [("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("b", [2.0, 0.1]), ("c", None), (None, [1.0, 1.0]), ("d", [0.0, 0.0]), ("e", [nan, 1.0]), ("f", [inf, 1.0]), ("g", [1.0]), ("h", [None, 1.0]), ("i", [0.0, 1.0])]
    rows = spark.createDataFrame(made, "id string, embedding array<double>")
    assert told(nearest(rows)) == {("a", "b", 1), ("a", "i", 2), ("b", "a", 1), ("b", "i", 2), ("i", "b", 1), ("i", "a", 2)}
    assert nearest(rows.limit(0)).count() == 0 and nearest(rows.filter("id = 'a'")).count() == 0
