"""Ranked lexical search of many queries at once, with their shared term sets evaluated once.

Queries that have terms in common would add up the same documents' weights again and again. So their sums
are first rewritten: a query is a set of symbols (term, times asked), written in an order in which symbols
of the same queries stand together. Pairs of near symbols that several queries have are replaced by a new
one, their sum, round by round, until no pair is shared. What comes out is a graph: terms at the bottom,
shared term sets above them, queries on top. A document's partial sum of a shared set, its accumulator, is
made once and used by all above it.

The corpus is read twice: terms are counted (once per block of queries, if there are very many) and
written as numbers, with the statistics that weights need; then each task adds up its documents along the
graph, batch by batch, and keeps the best few of each query. Only these are shuffled.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.plans.cutpoints import written

#: Symbols of queries that are evaluated together; their terms and graph are sent to all tasks, some 100 bytes each.
BLOCK_TERMS = 200_000
#: Letters of ASCII in lower case and digits stay, and all bytes beyond ASCII; all else separates terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Numbers that a batch of accumulators may hold.
_CELLS = 8_000_000
#: Places up to which symbols of a query are paired.
NEAR = 8
#: Groups of tasks whose best are merged before those of all.
_GROUPS = 32


def terms(text: str) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all characters beyond it; only A to Z are lower-cased."""
    return text.encode().translate(_TABLE).split()


@dataclass
class Graph:
    """Sums of queries. Rows 0, 1, ... are symbols (``term``, ``times``), then shared sets, each of two earlier rows.

    ``level`` of a set is one over its parts'. ``tops`` are the rows of each query, from ``starts`` on.
    """

    term: np.ndarray
    times: np.ndarray
    left: np.ndarray
    right: np.ndarray
    level: np.ndarray
    tops: np.ndarray
    starts: np.ndarray

    def added(self, parts: np.ndarray) -> np.ndarray:
        """(queries, documents) of sums, from the terms' parts (terms, documents)."""
        n = len(self.term)
        rows = np.empty((n + len(self.left), parts.shape[1]), np.int64)
        rows[:n] = parts[self.term] * self.times[:, None]
        for at in range(1, int(self.level.max(initial=0)) + 1):
            k = np.flatnonzero(self.level == at)
            rows[n + k] = rows[self.left[k]] + rows[self.right[k]]
        out = np.zeros((len(self.starts) - 1, parts.shape[1]), np.int64)
        full = np.flatnonzero(np.diff(self.starts))
        if len(full):
            out[full] = np.add.reduceat(rows[self.tops], self.starts[:-1][full], axis=0)
        return out

    @property
    def additions(self) -> int:
        return len(self.left) + len(self.tops) - int((np.diff(self.starts) > 0).sum())


def shared_sums(queries: list[dict[int, int]]) -> Graph:
    """The graph of queries, each a map of term numbers to times asked.

    Symbols are ordered by their number of queries, then by which these are; so those of exactly the same
    queries stand side by side in all of them. A round counts the pairs that stand within NEAR places of
    each other, and replaces, in each query, those that are in two or more queries, the commonest first.
    Rounds end when none is shared; each takes time linear in the queries' length.
    """
    holders: dict[tuple[int, int], list[int]] = {}
    for k, q in enumerate(queries):
        for symbol in q.items():
            holders.setdefault(symbol, []).append(k)
    order = sorted(holders, key=lambda s: (-len(holders[s]), holders[s], s))
    number = {s: i for i, s in enumerate(order)}
    rows = [sorted(number[s] for s in q.items()) for q in queries]
    left, right, level = [], [], []
    depth = lambda x: level[x - len(order)] if x >= len(order) else 0
    near = lambda r: ((x, y) if x < y else (y, x) for i, x in enumerate(r) for y in r[i + 1 : i + 1 + NEAR])
    while True:
        counts = {p: n for p, n in Counter(p for r in rows for p in near(r)).items() if n > 1}
        if not counts:
            break
        made: dict[tuple[int, int], int] = {}
        for k, r in enumerate(rows):
            free, new = set(r), {}
            for p in sorted((p for p in near(r) if p in counts), key=lambda p: (-counts[p], p)):  # the commonest first
                if free.issuperset(p):
                    free.difference_update(p)
                    new |= dict.fromkeys(p, p)
            for p in new.values():
                if p not in made:
                    made[p] = len(order) + len(left)
                    left.append(p[0])
                    right.append(p[1])
                    level.append(1 + max(map(depth, p)))
            rows[k] = list(dict.fromkeys(made[new[x]] if x in new else x for x in r))
    ends = np.cumsum([0, *map(len, rows)])
    whole = lambda x: np.array(x, np.int64)
    return Graph(whole([s[0] for s in order]), whole([s[1] for s in order]), whole(left), whole(right), whole(level), whole([x for r in rows for x in r]), ends)


def counted(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, term, tf) of every document: the number of its terms, and counts of those in ``vocabulary`` by its places."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            n, who, often = [], [], []
            for t in batch.column(1):
                found = terms(t.as_py())
                n.append(len(found))
                times = Counter(map(number.get, found))
                times.pop(None, None)
                who.append(np.fromiter(times.keys(), np.int32, len(times)))
                often.append(np.fromiter(times.values(), np.int32, len(times)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(who, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))], ["doc_id", "n", "term", "tf"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class Best:
    """The first ``k`` of each query so far; equal scores by rising id, null ids last."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]
        self.least, self.pending, self.size = np.zeros(queries, np.int64), [], 0

    def add(self, scores: np.ndarray, id: np.ndarray, null: np.ndarray) -> None:
        q, d = np.nonzero(scores >= np.maximum(self.least, 1)[:, None])
        self.pending.append((q, scores[q, d], id[d], null[d]))
        self.size += len(q)
        if self.size > 500_000 or not self.least.any():
            self.merge()

    def merge(self) -> None:
        q, score, id, null = (np.concatenate(x) for x in zip(self.held, *self.pending))
        order = np.lexsort((id, null, -score, q))
        q = q[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        kept = order[rank < self.k]
        self.held, self.pending, self.size = [q[rank < self.k], score[kept], id[kept], null[kept]], [], 0
        last = rank == self.k - 1
        self.least[q[last]] = score[order[last]]


def _scored(rows: DataFrame, graph: Graph, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score, task): each task's ``k`` best documents of every query."""
    shared = rows.sparkSession.sparkContext.broadcast((graph, weights))

    def run(batches):
        graph, weights = shared.value
        best, size = Best(len(graph.starts) - 1, k), max(1, _CELLS // (len(weights) + len(graph.term) + len(graph.left) + len(graph.tops) + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                n = part.column(1).to_pylist()
                m = np.array([100 - 25 + (25 * x * n_docs) // n_terms for x in n], np.int64)
                length = np.diff(part.column(2).offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), length)
                term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                parts = np.zeros((len(weights), part.num_rows), np.int64)
                parts[term, doc] = weights[term] * ((1_000_000_000 * tf) // (1_000 * tf + 12 * m[doc]))
                id = part.column(0)
                null = id.is_null().to_numpy(zero_copy_only=False)
                best.add(graph.added(parts), id.fill_null(0).to_numpy(), null)
        best.merge()
        q, score, id, null = best.held
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(id, mask=null), pa.array(score)], ["query", "doc_id", "score"])

    made = rows.filter("n > 0 and size(term) > 0").select("doc_id", "n", "term", "tf").mapInArrow(run, "query int, doc_id long, score long")
    return made.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(_GROUPS)))


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, with a score over 0.

    With N documents that hold a term, L terms in all, df documents that hold the term, tf times in a
    document of n terms: its weight is floor(1000 ln((2 N + 2) / (2 df + 1))), and it adds the weight times
    (10**9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, as often as the item has it. Equal scores go
    by rising id, null ids last.

    Null and empty texts and items match nothing; repeated documents are documents of their own; an item
    that stands twice with the same text counts once, one with several texts has the terms of all. Null
    item ids are one item. Empty tables give an empty one.
    """
    spark = docs.sparkSession

    def split(batches):
        for batch in batches:
            rows = [(i, sorted(Counter(terms(t)).items())) for i, t in zip(batch.column(0), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i.as_py() for i, r in rows for _ in r], batch.column(0).type), pa.array([w for _, r in rows for w, _ in r], pa.binary()), pa.array([n for _, r in rows for _, n in r], pa.int64())],
                ["item", "term", "times"],
            )

    asked = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(query_col).cast("string"), F.lit("")).alias("text")).distinct()
    uses = asked.mapInArrow(split, f"item {items.schema[item_col].dataType.simpleString()}, term binary, times long")
    uses = written(uses.groupBy("item", "term").agg(F.sum("times").alias("times")), "uses")
    # items that share their rarest terms fall into one block as long as blocks aren't full
    n_blocks = -(-uses.count() // block_terms)
    if not n_blocks:
        return spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long")
    lead = F.min(F.xxhash64("term")).over(Window.partitionBy("item"))
    blocks = written(uses.withColumn("block", F.pmod(lead, F.lit(n_blocks))), "blocks")
    out = []
    for b in range(n_blocks):
        got = blocks.filter(F.col("block") == b).orderBy("item", "term").toArrow()  # about block_terms rows
        if not got.num_rows:
            continue
        ids, words, times = (got.column(c).to_pylist() for c in ("item", "term", "times"))
        vocabulary = sorted(set(words))
        number = {w: i for i, w in enumerate(vocabulary)}
        queries: dict = {}
        for i, w, n in zip(ids, words, times):
            queries.setdefault(i, {})[number[w]] = n
        graph = shared_sums(list(queries.values()))
        rows = written(counted(docs, vocabulary, id_col, text_col), "counts")
        total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        held = rows.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # a row for each word of the block
        df[held.column(0).to_numpy()] = held.column(1).to_numpy()
        weights = np.array([floor(1000 * log((2 * total["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        some = _first(_scored(rows, graph, weights, total["docs"], total["terms"], k), ["query", "task"], k)
        best = written(_first(some, ["query"], k), "best")
        names = spark.createDataFrame(list(enumerate(queries)), f"query int, item_id {items.schema[item_col].dataType.simpleString()}")
        out.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))  # one row an item of the block
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long")
