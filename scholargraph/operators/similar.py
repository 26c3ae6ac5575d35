"""Nearest papers by embedding: inverted lists of a coarse quantiser, probed by bound, with exact cosines.

A k-means of a bounded sample gives cells; every row goes to the cell whose centre is nearest in angle, and
cells are dealt to parts of some thousand rows, so a hot cell is many parts. A part knows its centre and
the greatest angle of its rows to it. Two rows of parts A and B are at least angle(A, B) - a - b apart.

1. Each part meets the few parts that can be nearest. The k-th best cosine of each of its rows so far, the
   least of them over the part, is what others must reach.
2. Each part meets all others whose bound reaches that. What is left out can't change a result.

Parts are rows of packed vectors, and they are dealt to a few groups; what a group's parts meet comes to it once, sorted
by bound, and a part that can't improve any row of another any more isn't multiplied. So a vector is moved as often as
there are groups, not parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.plans.cutpoints import maybe_broadcast, written
from scholargraph.plans.ordering import dense_numbers

#: Rows that the quantiser is fitted on, cells and parts at most: both are sent to all tasks.
SAMPLE_ROWS, CELLS, PARTS = 20_000, 1_024, 200_000
#: Groups of parts that others are sent to: as many, and rows of one beyond which there are more.
GROUPS, GROUP_ROWS = 24, 32_768
#: Rounding that a bound must allow for.
_SLACK = 1e-9


def _centres(rows: DataFrame, n: int, cells: int | None) -> np.ndarray:
    """(cells, dim) unit vectors, from the rows with the least hash of their number."""
    k = min(cells or round(n**0.5), CELLS, n)
    sample = rows.orderBy(F.xxhash64("k"), "k").limit(SAMPLE_ROWS).select(array_to_vector("v").alias("features"))
    found = np.array(KMeans(k=max(2, k), maxIter=8, seed=7, distanceMeasure="cosine").fit(sample).clusterCenters()) if n > 1 else np.array([rows.first()["v"]])
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (k, v) with cell and angle."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = v @ shared.value.T
            cell = near.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(np.arccos(np.clip(near[np.arange(len(v)), cell], -1, 1)))], ["k", "v", "cell", "angle"])

    return rows.select("k", "v").mapInArrow(run, "k long, v array<double>, cell int, angle double")


def _packed(placed: DataFrame, part_rows: int) -> DataFrame:
    """(part, cell, far, ks, vs): at most some ``part_rows`` rows of a cell, their numbers and vectors in one order."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("k"), F.col("parts")))  # a row a cell
    rows = dealt.groupBy("cell", "sub").agg(F.max("angle").alias("far"), F.sort_array(F.collect_list(F.struct("k", "v"))).alias("x"))
    return written(rows.select((F.col("cell") * F.lit(1 << 32) + F.col("sub")).alias("part"), "cell", "far", F.col("x.k").alias("ks"), F.flatten("x.v").alias("vs")), "parts")


def _pairs(parts: DataFrame, others: DataFrame, centres: np.ndarray, first: int, floors: DataFrame | None = None) -> DataFrame:
    """(part, other, bound): for each part its ``first`` likeliest others, or, given ``floors`` (part, floor), the rest that can reach them."""
    known = others.select("part", "cell", "far").orderBy("part").toArrow()  # PARTS rows or so
    shared = parts.sparkSession.sparkContext.broadcast((centres, known.column(0).to_numpy(), known.column(1).to_numpy(), known.column(2).to_numpy()))
    asked = parts.select("part", "cell", "far", F.lit(None).cast("double").alias("floor")) if floors is None else parts.select("part", "cell", "far").join(maybe_broadcast(floors, len(known)), "part")

    def run(batches):
        centres, part, cell, far = shared.value
        for batch in batches:
            out = []
            for own, at, a, floor in zip(*(batch.column(c).to_pylist() for c in range(4))):
                apart = np.arccos(np.clip(centres @ centres[at], -1, 1))[cell]
                bound = np.cos(np.clip(apart - a - far, 0, np.pi))
                order = np.lexsort((part, apart, -bound))
                if floor is None:
                    take = order[:first]
                else:
                    take = order[first:]
                    take = take[bound[take] >= floor - _SLACK]
                out.append((np.full(len(take), own), part[take], bound[take]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], ["part", "other", "bound"])

    return asked.mapInArrow(run, "part long, other long, bound double")


def _met(parts: DataFrame, others: DataFrame, pairs: DataFrame, k: int, groups: int) -> DataFrame:
    """(part, p, q, score): the ``k`` best of each row of a part among the rows of the parts it meets.

    Parts are dealt to ``groups``. A group's own parts come to it once, and so does each other part that one of them meets.
    """
    of = F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int").alias("group")
    asked = pairs.groupBy(of, "other").agg(F.max("bound").alias("bound"), F.collect_list(F.struct("part", "bound")).alias("x"))
    theirs = asked.join(others.select(F.col("part").alias("other"), "ks", "vs"), "other").select("group", "bound", F.col("x.part").alias("parts"), F.col("x.bound").alias("bounds"), "ks", "vs")
    own = parts.select(of, F.lit(2.0).alias("bound"), F.array("part").alias("parts"), F.lit(None).cast("array<double>").alias("bounds"), "ks", "vs")  # before all others

    def best(p, q, s):
        order = np.lexsort((q, -np.round(s, 9), p))
        p = p[order]
        start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
        rank = np.arange(len(p)) - np.repeat(start, np.diff(np.r_[start, len(p)]))
        at = order[rank < k]
        return at, rank[rank < k]

    def improved(state, bound, oks, theirs):
        ks, mine, (p, q, s), floor = state
        open_ = np.flatnonzero(floor <= bound + _SLACK)
        if not len(open_):
            return state
        near = mine[open_] @ theirs.T
        a, b = np.nonzero((near >= floor[open_, None] - _SLACK) & (ks[open_, None] != oks))
        p, q, s = np.r_[p, open_[a]], np.r_[q, oks[b]], np.r_[s, near[a, b]]
        at, rank = best(p, q, s)
        p, q, s = p[at], q[at], s[at]
        floor = floor.copy()
        floor[p[rank == k - 1]] = s[rank == k - 1]
        return ks, mine, (p, q, s), floor

    def told(held):
        for part, (ks, _, (p, q, s), _) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), part)), pa.array(ks[p]), pa.array(q), pa.array(s)], ["part", "p", "q", "score"])

    def run(batches):
        group, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                at, _, ids, bounds, ks, vs = (batch.column(c)[i] for c in range(6))
                if at.as_py() != group:
                    yield from told(held)
                    group, held = at.as_py(), {}
                ks = ks.values.to_numpy()
                vs = vs.values.to_numpy().reshape(len(ks), -1)
                if not bounds.is_valid:
                    held[ids[0].as_py()] = (ks, vs, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(ks), -2.0))
                    continue
                for part, bound in zip(ids.as_py(), bounds.as_py()):
                    held[part] = improved(held[part], bound, ks, vs)
        yield from told(held)

    return own.union(theirs).repartition("group").sortWithinPartitions("group", F.desc("bound")).mapInArrow(run, "part long, p long, q long, score double")


def nearest(rows: DataFrame, k: int = 10, asked: DataFrame | None = None, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None, part_rows: int = 2_000, first: int = 8) -> DataFrame:
    """(paper_id, recommended_id, score, rank): the ``k`` rows of greatest cosine for each row, or for the ``asked`` (id) ones.

    Exact for any ``cells``, ``part_rows`` and ``first``. Equal scores (to nine digits) go by id. Rows with a
    null id or vector, a null or non-finite component, or no direction (all zero) take no part, nor do
    vectors of another length than most (of several, the shortest). Of an id's rows that with the least
    vector counts. Tables of under two such rows give an empty one.
    """
    spark, x = rows.sparkSession, F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    doubles = rows.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(F.col(id_col).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("v"))
    one = doubles.groupBy("id").agg(F.min("v").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))
    unit = written(one.withColumn("l", length).filter("l > 0").select("id", F.transform("v", lambda v: v / F.col("l")).alias("v")), "unit")
    sizes = unit.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or sizes["n"] < 2:
        return unit.select(F.col("id").alias("paper_id"), F.col("id").alias("recommended_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).filter("false")
    unit, n = unit.filter(F.size("v") == sizes["dim"]), sizes["n"]
    numbers = written(dense_numbers(unit.select("id"), ["id"], "k"), "numbers")
    numbered = written(unit.join(numbers, "id").select("k", "v"), "numbered")
    centres = _centres(numbered, n, cells)
    placed = written(_placed(numbered, centres), "placed")
    part_rows = max(part_rows, -(-n // PARTS))
    others = _packed(placed, part_rows)
    parts, n_asked = others, n
    if asked is not None:
        wanted = written(numbers.join(asked.select("id").na.drop().distinct(), "id", "left_semi").select("k"), "wanted")
        n_asked = wanted.count()
        parts = _packed(placed.join(maybe_broadcast(wanted, n_asked), "k", "left_semi"), part_rows)
    groups = max(GROUPS, -(-n_asked // GROUP_ROWS))
    seen = written(_met(parts, others, _pairs(parts, others, centres, first), k, groups), "seen")
    count = seen.groupBy("part", "p").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-2.0).alias("floor"))
    # a row that has met no other row yet must meet all
    floors = parts.select("part", F.explode("ks").alias("p")).join(count, ["part", "p"], "left").groupBy("part").agg(F.min(F.coalesce("floor", F.lit(-2.0))).alias("floor"))
    more = _met(parts, others, _pairs(parts, others, centres, first, written(floors, "floors")), k, groups)
    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.desc(F.round("score", 9)), "q"))
    best = seen.union(more).select("p", "q", "score").withColumn("rank", rank).filter(F.col("rank") <= k)
    named = [numbers.select(F.col("k").alias(a), F.col("id").alias(c)) for a, c in (("p", "paper_id"), ("q", "recommended_id"))]
    return best.join(named[0], "p").join(named[1], "q").select("paper_id", "recommended_id", "score", "rank")
