"""Wide fingerprints: what is kept of keys grows with near texts, not with texts that share a key by chance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholargraph.llm import simhash


def made(n=300, seed=5):
    """Fingerprints of n texts, of which every tenth and the two after it are near copies."""
    rnd = np.random.default_rng(seed)
    w = rnd.integers(-(2**63), 2**63 - 1, (n, 25))
    for i in range(n):
        if i % 10 in (1, 2):
            flip = np.zeros(1600, np.uint8)
            flip[rnd.choice(1600, 60, replace=False)] = 1
            w[i] = w[i - i % 10] ^ np.packbits(flip).view(np.int64)
    return w


def root(i):
    return i - i % 10 if i % 10 < 3 else i


def test_chance_meetings_are_not_kept(spark, monkeypatch):
    """Keys of 8 bits, which all texts share with others by chance, as 20 bits are beyond a million texts."""
    w, kept, plain = made(), {}, simhash.written

    def counting(df, name="cut"):
        out = plain(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "written", counting)
    nodes = spark.createDataFrame([(i, root(i), [int(x) for x in w[i]]) for i in range(len(w))], "node long, th long, w array<long>")
    texts = nodes.select("th").distinct().select("th", F.concat(F.lit("a b c d e "), F.col("th").cast("string")).alias("text"))
    got = {r.node: r.component for r in simhash.link_components(nodes, simhash.WIDE_DISTANCE, simhash.WIDE, texts=texts, block=8).collect()}
    assert got == {i: root(i) for i in range(len(w))}
    assert kept["members"] <= 90 * 200  # the near ones' keys; 300 * 200 in all


@pytest.mark.parametrize("longest, batch", [(1_000, 10_000), (1_000, 7), (5, 7), (1, 3)])
def test_keys_over_any_batches(spark, longest, batch):
    """Rows with a near one of their key pass, however the rows are cut; of long keys all do."""
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        w = made(60)
        rows = [(i, (int(w[i, 0]), int(w[i, 1])), 0, k) for i in range(60) for k in (i // 7, 100 + i % 2, 200 + i)]
        got = sorted((r.node, r.key) for r in simhash._met(spark.createDataFrame(rows, "node long, head struct<a: long, b: long>, choice short, key long"), longest).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)
    apart = lambda x, y: sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(x, y))
    want = []
    for node, head, _, key in rows:
        others = [r for r in rows if r[3] == key and r[0] != node]
        if len(others) + 1 > longest or any(apart(head, r[1]) <= simhash.HEAD_DISTANCE for r in others):
            want.append((node, key))
    assert got == sorted(want)
