"""Ranked search, hard negatives and the additive classifier against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, rows
from tests.llm.test_text_operators import DOCS, odd  # noqa: F401
from tests.llm.test_toxicity_and_pipeline import corpus  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def search_brute(docs, items, k=20):
    """``docs`` (doc_id, text), ``items`` (item_id, text)."""
    counts = [(d, Counter(w), len(w)) for d, w in ((d, split(t)) for d, t in docs) if w]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = Counter()
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(split(t))
    for i, q in asked.items():
        scored = []
        for d, c, n in counts:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in q.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out.update((i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]))
    return out


def told(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block_terms", [40, 200_000])
def test_search(spark, block_terms):
    from scholargraph.llm.ranking import search

    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = search_brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    if block_terms < 100:
        items = items.filter("item_id < 6")
        want = Counter({x: n for x, n in want.items() if x[0] < 6})
    assert told(search(docs, items, block_terms=block_terms)) == want


def test_search_of_odd_rows(spark, odd):  # noqa: F811
    from scholargraph.llm.ranking import search

    asked = [(1, "same TEXT here"), (1, "same TEXT here"), (2, None), (3, ""), (4, "word1 word2 word1 İ ſ"), (5, "text text text now 한국어"), (6, "nowhere"), (None, "id no no"), (7, "same"), (7, "now")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("item", "term", "times", "block", "query", "doc_id", "score")})
    docs = odd.withColumns({c: F.lit("clash") for c in ("n", "tf", "query", "item_id")})
    want = search_brute([(r.doc_id, r.text) for r in odd.collect()], asked, 3)
    assert told(search(docs, items, 3)) == want and any(x[0] is None for x in want) and any(x[2] is None for x in want)
    assert search(odd.limit(0), items).count() == 0 and search(odd, items.limit(0)).count() == 0
    assert search(odd, items.filter("item_id in (2, 3)")).count() == 0


def test_equal_scores_go_by_id_in_any_partition(spark):
    """Thousands of copies: the least ids are first, whatever task reads them."""
    from scholargraph.llm.ranking import search

    text = F.when(F.col("id") < 4_000, "alpha beta gamma").otherwise("delta")
    docs = spark.range(9_000).select((F.lit(3_999) - F.col("id")).alias("doc_id"), text.alias("text")).repartition(7)
    other = spark.createDataFrame([(10_000, "delta"), (10_001, "beta beta delta")], "doc_id long, text string")
    got = [(r["rank"], r.doc_id) for r in search(docs.union(other), spark.createDataFrame([(1, "alpha gamma")], "item_id long, text string")).orderBy("rank").collect()]
    assert got == [(k + 1, k) for k in range(20)]


def test_shared_sums():
    """The graph gives the plain sums with fewer additions where queries share terms."""
    from scholargraph.llm.ranking import shared_sums

    rnd = random.Random(4)
    common = [rnd.sample(range(60), 8) for _ in range(5)]
    queries = [{t: rnd.choice([1, 1, 2]) for t in rnd.sample(range(60), rnd.randint(0, 6))} | {t: 1 for t in rnd.choice(common)} for _ in range(200)] + [{}]
    graph = shared_sums(queries)
    parts = np.array([[rnd.randint(0, 10**9) for _ in range(7)] for _ in range(60)], np.int64)
    want = [[sum(n * int(parts[t, d]) for t, n in q.items()) for d in range(7)] for q in queries]
    assert graph.added(parts).tolist() == want
    assert graph.additions < 0.6 * sum(max(0, len(q) - 1) for q in queries)
    assert shared_sums([]).added(parts).shape == (0, 7) and shared_sums([{3: 2}]).added(parts).tolist() == [(2 * parts[3]).tolist()]


def negatives_brute(made, n_pos=5, n_neg=3):
    """``made`` (vec_id, label, vector), clean and of distinct ids."""
    c = {i: [math.floor(float(x) * 256) for x in v] for i, _, v in made}
    label = {i: (y + 1) % 10 if i % 7 == 0 else y for i, y, _ in made}
    out = set()
    for a in (i for i in c if i % 50 == 0):
        s = {i: sum(x * y for x, y in zip(c[a], c[i])) for i in c if i != a}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if label[i] == label[a]][:n_pos]:
            fit = [i for i in order if label[i] != label[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:n_neg]
            out |= {(a, p, r + 1, i, s[p], s[i]) for r, i in enumerate(fit)}
    return out


def mined(spark, df, **how):
    from scholargraph.llm.negatives import hard_negatives

    got = hard_negatives(df, F.col("vec_id") % 50 == 0, noisy=F.col("vec_id") % 7 == 0, **how).collect()
    made = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got}
    assert len(made) == len(got)
    return made


@pytest.mark.parametrize("block_rows", [3, 4_096])
def test_hard_negatives(spark, block_rows):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = negatives_brute([(r.vec_id, r.label, r.embedding) for r in table.collect()])
    assert mined(spark, table, block_rows=block_rows) == want and len(want) > 50


def test_hard_negatives_of_copies_and_ties(spark):
    """Groups of equal vectors, a label with most rows, other dimensions than whole words of bits."""
    rng = np.random.default_rng(8)
    v = np.concatenate([np.repeat(rng.standard_normal((6, 70)), 40, 0), rng.standard_normal((260, 70)) * 5]).round(1)
    made = [(i * 5, int(y), x.tolist()) for i, (y, x) in enumerate(zip(rng.choice([1, 1, 1, 1, 4, 9, 12], len(v)), v))]
    df = spark.createDataFrame(made, "vec_id long, label int, embedding array<double>").repartition(5)
    assert mined(spark, df) == negatives_brute(made)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, i % 3, [math.sin(i), math.cos(i * i), (i % 5) / 5]) for i in range(1, 160)]
    bad = [(200, None, [1.0, 1.0, 1.0]), (250, 1, None), (300, 1, [nan, 1.0, 1.0]), (350, 1, [inf, 1.0, 1.0]), (400, 1, [None, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (450, 1, [1.0, 2.0]), (500, 1, [])]
    twice = [good[49], good[98]]
    df = spark.createDataFrame(good + bad + twice, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("clash") for c in ("c", "codes", "aligned", "rest", "block", "a", "noisy", "anchor_id")})
    want = negatives_brute(good)
    assert mined(spark, df) == want and want
    assert mined(spark, df.limit(0)) == set() and mined(spark, df.filter("vec_id % 50 <> 0")) == set()
    zero = spark.createDataFrame([(50, 1, [0.0, 0.0]), (51, 1, [0.0, 1.0]), (52, 2, [1.0, 0.0])], "vec_id long, label int, embedding array<double>")
    assert mined(spark, zero) == {(50, 51, 1, 52, 0, 0)}
    big = [(i, i % 2, [float(10**6 * (i % 4)), float(-(3**i % 1000) * 10**3)]) for i in range(1, 60)]
    assert mined(spark, spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")) == negatives_brute(big)


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_intervals_hold_the_scores(dim):
    """Every inner product lies in every stage's interval; intervals narrow by stage."""
    from scholargraph.llm.negatives import Coder

    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.integers(-300, 300, (200, dim)), np.zeros((1, dim), int), np.full((1, dim), 7)])
    q = np.concatenate([rng.integers(-300, 300, (30, dim)), x[:3], x[-2:]])
    coder = Coder(dim)
    codes, aligned, rest = coder.code(x)
    middle, width, before = 0.0, 1e-6, np.inf
    for s, asked in enumerate(coder.questions(q)):
        along = coder.along(asked, codes[:, s])
        i, j = np.nonzero(np.ones(along.shape, bool))
        assert np.allclose(coder.along_pairs(asked, codes[:, s], i, j), along[i, j])
        middle = middle + aligned[:, s] * along
        width = width + np.abs(aligned[:, s]) * asked[3][:, None]
        last = width + np.linalg.norm(q, axis=1)[:, None] * rest[:, s]
        assert (np.abs(q @ x.T - middle) <= last).all() and last.mean() < before
        before = last.mean()
    if dim >= 64:
        assert before < 0.25 * np.linalg.norm(q, axis=1).mean() * np.linalg.norm(x, axis=1).mean()


def prose(spark, n=900):
    """Ordinary texts, and bad ones of several kinds; every fiftieth label is wrong."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "ter", "sun", "bel"]) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rnd.randint(4, 12))) + "." for _ in range(rnd.randint(3, 25))]
        kind = rnd.choice(["repeat", "marks", "shout", "twice"]) if rnd.random() < 0.25 else ""
        text = "\n".join(lines)
        text = {"": text, "repeat": "buy now " * len(text.split()), "marks": text.replace(" ", " ### "), "shout": text.upper() + "!!!", "twice": "\n".join([lines[0]] * 12)}[kind]
        docs.append((i, text, "x", "s", 1))
        if i % 4:
            labels.append((i, int(not kind) ^ (i % 50 == 1), 0))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_additive_held_out_accuracy(spark):
    from scholargraph.llm.additive import scored

    docs, labels = prose(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = scored(docs, labels).collect()
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.93
    # held-out labels and other columns teach nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in scored(docs.withColumn("lang", F.lit("y")), flipped).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_additive_of_the_given_table(spark):
    from scholargraph.llm.additive import scored

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in scored(docs, labels).filter("held_out").collect() if r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.97


def test_additive_of_odd_rows(spark, odd):  # noqa: F811
    from scholargraph.llm.additive import fit, scored

    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (99, 0, 1), (3, None, 1), (4, 0, 1), (4, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = scored(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    docs, good = prose(spark, 400)
    model = fit(docs, good)
    out = model.score(odd)
    assert sorted(out.columns) == sorted(odd.columns) and out.count() == odd.count()
    assert scored(odd.limit(0), labels).count() == 0
    rate = scored(odd, labels.limit(0)).select("score").distinct().collect()
    assert len(rate) == 1 and rate[0].score == 0.5
    table = model.frame(spark)
    assert table.filter("other is null").count() >= 22 and table.filter("other is not null").count() > 0


def test_scores_are_sums_of_table_entries(spark):
    """Every score, looked up by hand."""
    from scholargraph.llm.additive import NAMES, fit, text_features

    docs, labels = prose(spark, 300)
    model = fit(docs, labels)
    texts = [r.text for r in docs.limit(40).collect()] + ["", "x"]
    got = model.log_odds(np.array([text_features(t) for t in texts]))
    at = lambda edges, v: sum(1 for e in edges if e < v)
    for text, f in zip(texts, got):
        x = text_features(text)
        want = model.base + sum(t[at(e, v)] for e, t, v in zip(model.edges, model.tables, x)) + sum(t[at(a, x[i]), at(b, x[j])] for i, j, a, b, t in model.pairs)
        assert len(x) == len(NAMES) and abs(want - f) < 1e-9


def test_interactions_are_learned():
    """Exclusive or: no single feature tells anything, a pair tells all."""
    from scholargraph.llm.additive import boosted

    rng = np.random.default_rng(2)
    x = rng.random((2_000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = boosted(x, y, np.arange(2_000) % 5 == 0)
    fresh = rng.random((500, 4))
    right = (model.log_odds(fresh) > 0) == ((fresh[:, 1] > 0.5) ^ (fresh[:, 2] > 0.5))
    assert right.mean() > 0.93 and (1, 2) == model.pairs[0][:2]
    assert boosted(x, np.ones(2_000), np.zeros(2_000, bool)).tables == []


def test_trees_over_bins():
    """One cut: the best of all; the pair's tree finds the quadrant."""
    from scholargraph.llm.additive import grown, grown_pair

    g, n = np.array([1.0, 2.0, -5.0, -4.0, 1.0]), np.full(5, 20)
    h = np.full(5, 4.0)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    best = max(range(1, 5), key=lambda k: gain(0, k) + gain(k, 5))
    out = grown(g, h, n, 2, 1, 1.0)
    assert np.allclose(out[:best], g[:best].sum() / (h[:best].sum() + 1)) and np.allclose(out[best:], g[best:].sum() / (h[best:].sum() + 1))
    assert len(set(grown(g, h, n, 2, 10**6, 1.0))) == 1
    grid = np.zeros((4, 5))
    grid[2:, :2] = 3.0
    table, won = grown_pair(grid, np.ones((4, 5)), np.full((4, 5), 30), 1, 1.0)
    assert won > 0 and (table[2:, :2] > 1).all() and np.allclose(table[:2], 0)


def test_repeated_windows_against_plain_counts():
    from scholargraph.llm.additive import NAMES, text_features

    rnd = random.Random(1)
    for _ in range(30):
        words = [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 60))]
        got = dict(zip(NAMES, text_features(" ".join(words))))
        for name, width in (("repeated_pairs", 2), ("repeated_windows", 5)):
            windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
            times = Counter(windows)
            inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(width)}
            assert abs(got[name] - len(inside) / max(1, len(words))) < 1e-12


def test_search_sql(spark, duck):
    from scholargraph.llm import queries

    assert rows(queries.QUERIES["op11_ranked_search"](spark, DATA).toPandas()) == rows(duck.execute(queries.ORACLE_SQL["op11_ranked_search"]).df())
