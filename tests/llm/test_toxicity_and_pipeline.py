"""Held-out accuracy of the classifier, its edge cases, and the pipeline stage by stage."""

import collections
import random
import zlib

from tests.conftest import DATA
from tests.llm.test_text_operators import DOCS, odd  # noqa: F401


def corpus(spark, n=1500):
    """Prose of two languages, each with toxic stems of its own; some labels are wrong."""
    rnd = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        lang = i % 2
        words = ["".join(rnd.choice(["ka", "lo", "mi", "ter", "sun", "bel"]) for _ in range(rnd.randint(1, 3))) + ("a", "o")[lang] for _ in range(rnd.randint(30, 200))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(max(3, len(words) // 15)):
                words[rnd.randrange(len(words))] = rnd.choice(["grumph", "snarl"]) if lang else "vexxo" + rnd.choice(["ta", "ri", "nem", "su", "wik", "pol"])
        docs.append((i, " ".join(words), "xy"[lang], "s", 1))
        if i % 3:
            labels.append((i, 1, int(toxic) ^ (rnd.random() < 0.02)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    from scholargraph.llm.toxicity import scored

    docs, labels = corpus(spark)
    got = scored(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 1500 and sum(p == t for p, t in held) / len(held) > 0.93


def test_a_group_of_copies_adds_no_words(spark):
    """A toxic text copied with small changes doesn't put its own words into the lexicon."""
    from scholargraph.llm.toxicity import fit

    docs, labels = corpus(spark, 600)
    rnd = random.Random(5)
    base = [f"unique{k}" for k in range(80)]
    more = []
    for i in range(300):
        w = list(base)
        w[rnd.randrange(80)] = "changed"
        more.append((10_000 + i, " ".join(w), "x", "s", 1))
    docs = docs.unionByName(spark.createDataFrame(more, DOCS))
    labels = labels.unionByName(spark.createDataFrame([(10_000 + i, 1, 1) for i in range(300)], "doc_id long, quality int, toxic int"))
    lexicon = fit(docs, labels).lexicon
    assert "grumph" in lexicon and not any(w.startswith("unique") and w[6:].isdigit() for w in lexicon)


def test_odd_rows_get_scores(spark, odd):  # noqa: F811
    from scholargraph.llm.toxicity import fit, keep_clean, scored

    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (99, 1, 0), (3, 1, None), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = scored(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert keep_clean(odd, fit(odd, labels)).columns == odd.columns
    docs, labels = corpus(spark, 600)
    model = fit(docs, labels)
    assert len(model.score(odd).select("score").collect()) == odd.count()
    clean = keep_clean(odd, model)
    assert clean.columns == odd.columns and {r.score for r in clean.select("score").collect()} == {"clash"}


def similar_brute(docs, width=5, least=0.8):
    """(doc, text, least id of the component) by exact similarity of shingles."""
    sets = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) for w in (t.lower().split() for _, t in docs)]
    low = list(range(len(docs)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= least * len(a | sets[j]):
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    least_id = {}
    for i, (d, _) in enumerate(docs):
        least_id[find(i)] = min(d, least_id.get(find(i), d))
    return [(d, t, least_id[find(i)]) for i, (d, t) in enumerate(docs)]


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from scholargraph.llm import decontamination, lines, simhash, toxicity

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"] and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    kept = docs
    for name, stage in p.STAGES[:4]:
        before, kept = kept, stage(spark, kept, DATA).cache()
        assert kept.columns == docs.columns, name
        ids = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
        if name == "toxicity":
            assert ids == collections.Counter(d for d, s in scores.items() if s < 0.5)
        if name == "line_dedup":
            assert ids == collections.Counter(r.doc_id for r in before.select("doc_id").collect())
            assert {r.doc_id: r.text for r in kept.collect()} == {r.doc_id: r.text for r in lines.clean_lines(before).collect()}
        if name == "simhash_dedup":
            groups = simhash.near_duplicates(before, 5, simhash.WIDE_DISTANCE, 42, simhash.WIDE).collect()
            exact = {k[2] for k in similar_brute([(r.doc_id, r.text or "") for r in before.select("doc_id", "text").collect()])}
            assert set(ids) == {r.component_id for r in groups} and len(set(ids) ^ exact) <= 0.02 * len(exact)
        if name == "decontamination":
            bad = {r.doc_id for r in decontamination.contaminated(before, bench).collect()}
            assert set(ids) == {r.doc_id for r in before.select("doc_id").collect()} - bad
    packed = p.STAGES[4][1](spark, kept, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids)
    assert simhash.blocks_for(10, 4) == 6 and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_runs_as_registered(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"](spark, DATA).count() > 0


def test_pipeline_on_odd_and_empty_tables(spark, odd):  # noqa: F811
    """Nulls in every column, empty and very long texts, repeats and clashing names, and no rows at all."""
    import corpus_pipeline as p

    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, DATA).cache()
            assert docs.columns == odd.columns, name
            left = docs.count()
            assert left == n if name == "line_dedup" else left <= n, name
            n = left
        packed = p.STAGES[-1][1](spark, docs, DATA)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    kept = {r.text for r in p.simhash_dedup(spark, odd, DATA).select("text").collect()}
    assert {"same text here now", "a", "null lang"} <= kept and len(kept) == odd.select("text").distinct().count() - 2  # null, empty and blank texts are one


def features_brute(text, lexicon, near=5, window=50):
    """The features by their definitions, with plain loops."""
    import math
    import re

    from scholargraph.llm.toxicity import MARK, READ_AS, SECOND_PERSON, STEMS

    listed = lambda w: w in lexicon or any(len(w) > n and MARK + w[:n] in lexicon for n in STEMS)
    words = re.findall(r"[^\W\d_]+", text.lower())
    n, chars = max(1, len(words)), max(1, len(text))
    hits, you = [i for i, w in enumerate(words) if listed(w)], [i for i, w in enumerate(words) if w in SECOND_PERSON]
    close = sum(any(abs(i - j) <= near for j in you) for i in hits)
    thick = max((sum(i <= j < i + window for j in hits) for i in hits), default=0)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    masked = [w.lower().translate(READ_AS) for w in re.findall(r"(?<![A-Za-z])[A-Za-z]+(?:[0-9@$!*._-][A-Za-z]+)+", text)]
    of = lambda signs: sum(c in signs for c in text) / chars
    return [
        math.log1p(len(words)), len(hits) / n, math.log1p(len(hits)), len({words[i] for i in hits}), thick, close / n, len(you) / n,
        upper / max(1, upper + lower), len(re.findall(r"\b[A-Z]{3,}\b", text)) / n, of("!"), of(",.:;?"), of("#$%&*<>|"), of("0123456789"),
        len(masked) / n, sum(map(listed, masked)), len(re.findall(r"([A-Za-z])\1{3}", text)) / n,
    ]


def test_features_against_brute_force(spark):
    from scholargraph.llm.toxicity import Listed, text_features, with_features

    rnd = random.Random(26)
    parts = ["you", "Your", "grumph", "gr4mph", "g.r.u.m.p.h", "snarling", "SNARL", "word", "Ünïq", "12", "ok!!!", "x", "aaaaargh", ",", "#$", "\n", "a_b", "du", "plain"]
    lexicon = frozenset(["grumph", "^snar", "gramph"])
    made = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 150))) for _ in range(300)] + ["", "x" * 3000]
    for t in made:
        assert [round(x, 9) for x in text_features(t, Listed(lexicon))] == [round(x, 9) for x in features_brute(t, lexicon)], t
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.features for r in with_features(df, lexicon).collect()}
    assert got[-1] == features_brute("", lexicon) and all([round(x, 9) for x in got[i]] == [round(x, 9) for x in features_brute(t, lexicon)] for i, t in enumerate(made))


def test_held_out_rows_of_the_given_table(spark):
    """Trained on the labelled rows of the other folds only, at scale 0.01."""
    from scholargraph.llm.toxicity import scored

    top = DATA.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{top}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    got = [(r.score, truth[r.doc_id]) for r in scored(spark.read.parquet(f"{top}/documents.parquet"), labels).collect() if r.held_out and r.doc_id in truth]
    bad, good = [s for s, t in got if t], [s for s, t in got if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert auc > 0.93 and sum((s >= 0.5) == t for s, t in got) / len(got) > 0.95, (auc, len(bad), len(good))
