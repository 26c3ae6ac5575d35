"""Column names that an operator might use itself, through every stage; whole licences; hot pre-tokens."""

import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.test_text_operators import path

#: Names that operators use inside, or used before.
TAKEN = "__drop __id __row __lines __cut __n_lines __n_removed __features __vector __probability __margin __class __raw __score __toxicity __th __found node component th w k1 k2 row features score n_lines n_removed c0 c1 c5".split()


def test_any_column_names_pass_all_stages(spark):
    import corpus_pipeline
    from scholargraph.plans.cutpoints import written

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    docs = docs.union(docs.limit(5))
    docs = written(docs.withColumns({c: F.concat(F.lit(c + " of "), F.col("doc_id").cast("string")) for c in TAKEN}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, DATA))
        assert out.columns == docs.columns, name
        wrong = out.filter(" or ".join(f"`{c}` <> concat('{c} of ', doc_id)" for c in TAKEN))
        assert out.count() > 0 and wrong.count() == 0, name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= docs.count()


@pytest.mark.parametrize("file, label", [("GPL-3", "gpl"), ("GPL-2", "gpl"), ("Apache-2.0", "apache"), ("MPL-2.0", "mpl"), ("CC0-1.0", "cc0"), ("LGPL-3", "lgpl"), ("LGPL-2.1", "lgpl")])
def test_whole_licences(file, label):
    """Label and spans of a whole licence; most of its words are covered."""
    from scholargraph.llm.licenses import Scanner, words

    scanner = Scanner()
    seq = words("some code before\n" + open(f"/usr/share/common-licenses/{file}").read() + "\nand after")
    spans, share = scanner.found(seq)
    covered = {i for s in spans if scanner.labels[s[0]] == label for i in range(s[1], s[2])}
    assert share == 1.0 and len(covered) > 0.85 * len(seq)
    other = sum(s[3] for s in spans if scanner.labels[s[0]] != label)
    assert other < 0.1 * len(seq)


def test_long_text_of_many_notices():
    """7 MB of notices, each a span of its own."""
    from scholargraph.llm.licenses import NOTICES, Scanner, words

    scanner = Scanner()
    seq = words("\n".join(NOTICES[i % len(NOTICES)][1] for i in range(60_000)))
    began = time.time()
    spans, _ = scanner.found(seq)
    assert time.time() - began < 20 and len(spans) > 55_000


def test_nested_spans_against_all_pairs():
    from scholargraph.llm.licenses import NOTICES, Scanner, words

    scanner = Scanner()
    seq = words(" x ".join(NOTICES[(i * 7) % len(NOTICES)][1] + open("/usr/share/common-licenses/GPL-3").read()[i * 300 : i * 300 + 900] for i in range(40)))
    spans, _ = scanner.chains(seq)
    total = {label: len({i for s in spans if scanner.labels[s[0]] == label for i in range(s[1], s[2])}) for label in scanner.labels}
    assert {k: v for k, v in total.items() if v} == scanner.stretch(spans)
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], -total[scanner.labels[s[0]]], s)):
        rank = lambda x: (x[3], total[scanner.labels[x[0]]])
        if not any(rank(o) > rank(s) and scanner.labels[o[0]] != scanner.labels[s[0]] and 2 * (min(s[2], o[2]) - max(s[1], o[1])) >= s[2] - s[1] for o in kept):
            kept.append(s)
    assert scanner.found(seq)[0] == sorted(kept, key=lambda s: (s[1], s[2], s[0]))


def test_a_long_ruler_in_many_texts_is_counted_where_it_is_read(spark):
    """A pre-token of 60 dashes in a third of the texts is in the local table, so it is no key of the join."""
    from tokenizers import Tokenizer

    from scholargraph.llm.tokens import most_frequent, pieces_of, pre_tokens, token_counts

    ruler = "-" * 60
    docs = spark.createDataFrame([(i, f"word{i} and\n{ruler}\nmore" if i % 3 == 0 else f"word{i} {'x' * (i + 50)}") for i in range(90)], "doc_id long, text string")
    table = most_frequent(pieces_of(pre_tokens(docs, path()), path()), 40)
    assert any(w.startswith("---") for w in table)
    of = Tokenizer.from_file(path())
    want = {r.doc_id: len(of.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, path(), known=40).collect()} == want
