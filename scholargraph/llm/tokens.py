"""Token counts from distinct pre-tokens: no token ids are made for the documents.

1. Pre-tokens are counted over all documents, and the pieces of each distinct one are counted once:
   a table (word, times, n).
2. Per-document frequencies are joined with that table and summed. The most frequent pre-tokens, a
   bounded part of the table, are joined where the text is read; each document's other pre-tokens are
   joined by a shuffle. All that stand in many documents are among the first, however long they are, as
   the bound is one of bytes; so no key of that join is hot.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.tokenizing import words_of
from scholargraph.plans.cutpoints import written

#: Pre-tokens sent to every executor at most, and their bytes together.
KNOWN, KNOWN_BYTES = 300_000, 24_000_000


def pre_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, times): the distinct pre-tokens of all texts."""

    def run(batches):
        words = words_of(tokenizer)
        for batch in batches:
            count: Counter = Counter()
            for text in batch.column(0):
                if text.is_valid:
                    count.update(words.split(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["word", "times"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))


def pieces_of(words: DataFrame, tokenizer: str) -> DataFrame:
    """``words`` (word, times) with ``n``, the number of the word's tokens."""

    def run(batches):
        split = words_of(tokenizer)
        for batch in batches:
            n = split.counts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], ["word", "times", "n"])

    return words.mapInArrow(run, "word string, times long, n int")


def most_frequent(pieces: DataFrame, known: int, most_bytes: int = KNOWN_BYTES) -> dict[str, int]:
    """word: n of at most ``known`` words of ``most_bytes`` together, those whose frequency is above a bound."""
    step = F.floor(8 * F.log2("times"))
    total = size = 0
    least = None
    steps = pieces.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes"))
    for r in sorted(steps.collect(), reverse=True):  # some hundred rows
        total, size = total + r["n"], size + r["bytes"]
        if total > known or size > most_bytes:
            break
        least = r["step"]
    if least is None:
        return {}
    return {r[0]: r[1] for r in pieces.filter(step >= least).select("word", "n").collect()}  # at most `known` rows


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, known: int = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A null text is empty: no bytes, no tokens. Null and repeated ids keep a row each. A very long text is
    split whole; other columns don't matter. An empty table gives an empty one.
    """
    pieces = written(pieces_of(pre_tokens(docs, tokenizer, text_col), tokenizer), "pieces")
    table = most_frequent(pieces, known)
    names = ["row_id", "doc_id", "n_bytes", "n_known", "rare"]
    rare_type = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int32())]))

    def run(batches):
        words = words_of(tokenizer)
        for batch in batches:
            sizes, sums, rest = [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                found = words.split(text)
                rare = Counter(w for w in found if w not in table)
                sizes.append(len(text.encode()))
                sums.append(sum(table[w] for w in found if w in table) if rare else sum(map(table.__getitem__, found)))
                rest.append([{"word": w, "times": n} for w, n in rare.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, rare_type)], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = written(numbered.mapInArrow(run, "row_id long, doc_id long, n_bytes long, n_known long, rare array<struct<word:string,times:int>>"), "counted")
    rare = counted.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.times")
    more = rare.join(pieces.select("word", "n"), "word").groupBy("row_id").agg(F.sum(F.col("times") * F.col("n")).alias("n_rare"))
    n_tokens = F.col("n_known") + F.coalesce("n_rare", F.lit(0))
    return counted.drop("rare").join(more, "row_id", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
