"""Connected components of a link table: by alternating large-star and small-star steps, or by contraction.

Star steps suit tables of links that mostly join the same few, contraction whole graphs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholargraph.plans.cutpoints import broadcast_or_merge, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u, v) with u > v.

    Large star: each node links its larger neighbours to the least of its neighbours and itself.
    Small star: each node links its smaller neighbours and itself to the least of them.
    The least neighbour comes from an aggregate with map-side combine, not a window, and a node with
    very many neighbours is joined as any skewed key.
    """
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        own = least.select("u", F.col("m").alias("v"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)
    return out.filter("u > v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); component is the least node reachable.

    Nulls on either side drop the link, self links count their node. Only two counts per round reach
    the driver. Each round is written to the shared folder, so the plan does not grow.
    """
    clean = links.select("u", "v").filter("u is not null and v is not null")
    now = written(clean.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sign = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = sign(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = written(_star(_star(now, True), False), "stars")
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = clean.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return found.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))


#: Links that one task may join at the end, and those that a task joins at once before the first shuffle.
FINISH_ROWS, CHUNK = 1_000_000, 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v) and the least node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        new = low.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))  # roots hook on to lesser ones
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _forests(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v): what each task's own links join, as links of nodes to the least of them; a chunk at a time. Nodes with links to themselves only have one."""

    def run(batches):
        held, n = [], 0

        def told():
            nodes, low = forest(*(np.concatenate(x) for x in zip(*held)))
            inner = nodes != low
            inner |= ~np.isin(nodes, low[inner])  # or alone
            return pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(low[inner])], ["u", "v"])

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
            n += batch.num_rows
            if n >= chunk:
                yield told()
                held, n = [], 0
        if n:
            yield told()

    return links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(run, "u long, v long")


def _contracted(links: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(up, links): every node goes to the neighbour of the least hash, if that is less than its own, and on to the top; links between tops.

    The hash differs by round, so chains of such steps are short whatever the nodes' numbers.
    """
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("x"))
    least = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
    up = written(least.filter(F.col("m") < rank("u")).select(F.col("u").alias("node"), F.col("m.x").alias("up")), "up")
    moved, n = True, up.count()
    while moved:  # each round halves the way to the top
        over = broadcast_or_merge(up.select(F.col("node").alias("up"), F.col("up").alias("over")), n)
        up = written(up.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "up")
        moved = not up.filter("moved").isEmpty()
        up = up.drop("moved")
    out = links
    for c in ("u", "v"):
        out = out.join(broadcast_or_merge(up.withColumnRenamed("node", c), n), c, "left").withColumn(c, F.coalesce("up", c)).drop("up")
    out = out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return up, written(out, "links")


def contracted_components(links: DataFrame, finish_rows: int = FINISH_ROWS, most_rounds: int = 60) -> DataFrame:
    """(node, component) like ``components``, for whole graphs: by contraction.

    First each task joins what its own links join, before anything is shuffled. Then rounds contract the
    graph, each to well under half its nodes, until ``finish_rows`` links or fewer are left, which one task
    joins. Where the nodes went is kept by round, and put together backwards at the end, so all rounds
    together move a small multiple of the graph. Tables of nodes are sent along only if they are few; ``links`` are read once.
    """
    clean = links.select("u", "v").filter("u is not null and v is not null")
    told = written(_forests(clean).distinct(), "links")
    now, alone = told.filter("u <> v"), told.filter("u = v").select(F.col("u").alias("node"))
    trail, n = [], now.count()
    for seed in range(most_rounds):
        if n <= finish_rows:
            break
        up, now = _contracted(now, seed)
        trail.append(up)
        n = now.count()
    else:
        raise RuntimeError("components did not settle")
    last = written(_forests(now.coalesce(1), finish_rows + 1).select(F.col("u").alias("node"), F.col("v").alias("up")), "last")
    for up in reversed(trail):
        there = up.join(broadcast_or_merge(last.select(F.col("node").alias("up"), F.col("up").alias("over")), last.count()), "up", "left").select("node", F.coalesce("over", "up").alias("up"))
        last = written(last.union(there), "placed")
    placed = written(last.union(last.select(F.col("up").alias("node"), "up").distinct()), "placed")
    if not alone.isEmpty():
        alone = alone.join(broadcast_or_merge(placed.select("node"), placed.count()), "node", "left_anti")
        placed = placed.union(alone.select("node", F.col("node").alias("up")))
    if not trail:
        return placed.select("node", F.col("up").alias("component"))
    least = written(placed.groupBy("up").agg(F.min("node").alias("component")), "least")  # tops are of the least hash, not the least node
    return placed.join(broadcast_or_merge(least, least.count()), "up").select("node", "component")
