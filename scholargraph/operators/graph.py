"""Graph analytics on networks or on the whole corpus. ``root_id`` keeps networks apart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions.style import rank_node_size
from scholargraph.operators.components import contracted_components
from scholargraph.operators.network import AGAIN, CITING
from scholargraph.plans.cutpoints import broadcast_or_merge, maybe_broadcast, written
from scholargraph.plans.ordering import dense_numbers


#: Edges of a block of sources beyond which it is cut into parts; contributions that a task adds up at once.
BLOCK_EDGES, HELD = 1_000_000, 4_000_000


def _edge_blocks(flows: DataFrame, ends: DataFrame, bits: int, most: int) -> DataFrame:
    """(b, dst, pos, share, base): the edges (src, dst, share, base) of 2**bits sources as arrays, by target, dealt out by b. base is the share of 1/n.

    A block with more than ``most`` of the edges ``ends`` (src, dst), as a hub's, is several rows.
    """
    large = ends.groupBy(F.shiftright("src", bits).alias("b")).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    large = written(large.filter("parts > 1"), "large")
    at = flows.select(F.shiftright("src", bits).alias("b"), "dst", F.col("src").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("pos"), "share", "base")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("dst"), F.col("parts"))).otherwise(0)
    dealt = at.join(maybe_broadcast(large, large.count()), "b", "left").withColumn("part", part)
    packed = dealt.repartition("b").groupBy("b", "part").agg(F.sort_array(F.collect_list(F.struct("dst", "pos", "share", "base"))).alias("e"))
    return packed.select("b", *[F.col(f"e.{c}").alias(c) for c in ("dst", "pos", "share", "base")])


def _sent(blocks: DataFrame, inflow: DataFrame | None, bits: int, floor: float) -> DataFrame:
    """(b, got): for each block of targets the lists (pos, x) of what flows in.

    A task adds up what its blocks send to the same target. Without ``inflow`` all nodes have their first rank.
    """
    none = "array<struct<pos:array<int>,x:array<double>>>"
    first_round = inflow is None
    both = blocks.withColumn("got", F.lit(None).cast(none)) if first_round else blocks.join(inflow, "b", "left")

    def run(batches):
        held, n = [], 0

        def told():
            dst, x = (np.concatenate(v) for v in zip(*held))
            order = np.argsort(dst, kind="stable")
            dst, x = dst[order], x[order]
            first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
            dst, x = dst[first], np.add.reduceat(x, first)
            at = np.flatnonzero(np.r_[True, dst[1:] >> bits != dst[:-1] >> bits])
            ends = pa.array(np.r_[at, len(dst)].astype(np.int32))
            pos = pa.ListArray.from_arrays(ends, pa.array((dst & ((1 << bits) - 1)).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(dst[at] >> bits), pos, pa.ListArray.from_arrays(ends, pa.array(x))], ["b", "pos", "x"])

        for batch in batches:
            for i in range(batch.num_rows):
                dst, pos, share, base = (batch.column(c)[i].values.to_numpy() for c in ("dst", "pos", "share", "base"))
                if first_round:
                    x = base
                else:
                    rank, got = np.zeros(1 << bits), batch.column("got")[i]
                    for r in got.values if got.is_valid else ():
                        rank[r["pos"].values.to_numpy()] += r["x"].values.to_numpy()
                    x = share * rank[pos] + floor * base
                held.append((dst, x))
                n += len(dst)
                if n > HELD:
                    yield told()
                    held, n = [], 0
        if n:
            yield told()

    made = both.select("dst", "pos", "share", "base", "got").mapInArrow(run, "b long, pos array<int>, x array<double>")
    return made.groupBy("b").agg(F.collect_list(F.struct("pos", "x")).alias("got"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, cut_every: int = 5, bits: int = 13) -> DataFrame:
    """(root_id, id, score) after ``iterations`` rounds from 1/n.

    A node's out-degree counts all its edges, also those to targets that are no nodes and parallel ones
    of another type; what flows to such targets is lost, and rank without a way out is not handed round.
    A node with a null id gets the share of all; edges with a null end count for nothing but out-degrees.

    Nodes are numbered, and the edges of 2**bits sources are one row of arrays, which stay where they are. A
    node's rank is what flows in plus a constant, which its edges carry; so a round sends sums by target,
    packed by block, and has one exchange, of these.
    """
    n = nodes.groupBy("root_id").agg(F.count("*").alias("n"))
    own = nodes.select("root_id", "id").join(maybe_broadcast(n, n.count()), "root_id")  # one row per network: no task of its own if they are few
    own = written(own.withColumn("v", F.monotonically_increasing_id()), "numbered")
    src, dst = own.select("root_id", F.col("id").alias("from_id"), F.col("v").alias("src"), "n"), own.select("root_id", F.col("id").alias("to_id"), F.col("v").alias("dst"))
    ends = written(edges.select("root_id", "from_id", "to_id").join(src, ["root_id", "from_id"]).join(dst, ["root_id", "to_id"], "left").select("src", "dst", "n"), "ends")
    # dealt out by source once, for out-degrees and for parallel edges
    counted = ends.repartition("src").groupBy("src", "dst", "n").agg(F.count("*").alias("times")).withColumn("out", F.sum("times").over(Window.partitionBy("src")))
    by_pair = counted.filter("dst is not null")
    share = F.lit(damping) * F.col("times") / F.col("out")
    packed = _edge_blocks(by_pair.select("src", "dst", share.alias("share"), (share / F.col("n")).alias("base")), ends, bits, BLOCK_EDGES)
    blocks = packed.persist()
    inflow = None
    for i in range(iterations):
        inflow = _sent(blocks, inflow, bits, 1 - damping)
        if (i + 1) % cut_every == 0 or i + 1 == iterations:
            inflow = written(inflow, "inflow")
    blocks.unpersist()
    if inflow is None:
        return own.select("root_id", "id", (1 / F.col("n")).alias("score"))
    each = inflow.select("b", F.explode("got").alias("g")).select("b", F.explode(F.arrays_zip("g.pos", "g.x")).alias("z"))
    got = each.groupBy((F.shiftleft("b", bits) + F.col("z.pos")).alias("dst")).agg(F.sum("z.x").alias("got"))
    return own.join(got, own["v"] == got["dst"], "left").select("root_id", "id", ((1 - F.lit(damping)) / F.col("n") + F.coalesce("got", F.lit(0.0))).alias("score"))


def network_ranks(networks: DataFrame, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(root_id, id, score, cluster_id) of rows of arrays (``network.ego_networks``): ``pagerank`` and ``connected_components`` of each.

    A network is a row, so nothing is exchanged; the networks of a batch are worked on together.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _ranked(batch, damping, iterations)

    kept = networks.select("root_id", "papers", "targets", "marks", "new_at")
    return kept.mapInArrow(run, "root_id string, id string, score double, cluster_id long")


def _ranked(batch: pa.RecordBatch, damping: float, iterations: int) -> pa.RecordBatch:
    roots, papers, targets, marks, new_at = (batch.column(c) for c in ("root_id", "papers", "targets", "marks", "new_at"))
    sizes = lambda c: np.diff(c.offsets.to_numpy())
    nets, taken, new = np.arange(batch.num_rows), sizes(targets), sizes(new_at)
    place = new_at.flatten().to_numpy() - 1 + np.repeat(np.cumsum(taken) - taken, new)
    first = np.cumsum(new + 1) - (new + 1)  # a network's nodes: its root, then the new ones in order
    net = np.repeat(nets, new + 1)
    pool = pa.concat_arrays([roots, targets.flatten().take(pa.array(place))])
    is_new = np.ones(len(net), dtype=bool)
    is_new[first] = False
    order = np.empty(len(net), dtype=np.int64)
    order[first], order[is_new] = nets, batch.num_rows + np.arange(len(place))
    ids = pool.take(pa.array(order))
    # places of the edges' ends among the nodes, by network and id
    told = pa.concat_arrays([ids, papers.flatten(), targets.flatten()]).dictionary_encode()
    code, of = told.indices.fill_null(-1).to_numpy() + 1, np.repeat(nets, taken)
    key = np.r_[net, of, of].astype(np.int64) * (len(told.dictionary) + 1) + code
    n, m = len(net), len(of)
    by = np.argsort(key[:n])
    at = np.minimum(np.searchsorted(key[:n][by], key[n:]), n - 1)
    end = np.where(key[:n][by][at] == key[n:], by[at], -1)
    mark = marks.flatten().to_numpy()
    citing, once = (mark & CITING) != 0, (mark & AGAIN) == 0
    src, dst = np.where(citing, end[m:], end[:m])[once], np.where(citing, end[:m], end[m:])[once]
    src, dst = src[src >= 0], dst[src >= 0]
    share = damping / np.bincount(src, minlength=n)[src]  # of all edges, also those to targets that are no nodes
    src, dst, share = src[dst >= 0], dst[dst >= 0], share[dst >= 0]
    each = 1 / np.repeat(new + 1, new + 1)
    rank = each
    for _ in range(iterations):
        rank = np.bincount(dst, share * rank[src], n) + round(1 - damping, 12) * each
    least = np.arange(n)
    while True:
        low, before = np.minimum(least[src], least[dst]), least.copy()
        np.minimum.at(least, src, low)
        np.minimum.at(least, dst, low)
        least = least[least]
        if (least == before).all():
            break
    number = np.cumsum(least == np.arange(n)) - 1
    return pa.RecordBatch.from_arrays([roots.take(pa.array(net)), ids, pa.array(rank), pa.array(number[least] - number[first][net])], ["root_id", "id", "score", "cluster_id"])


def rank_nodes(nodes: DataFrame, ranks: DataFrame) -> DataFrame:
    """``nodes`` with the score, and the size that follows from it."""
    scored = nodes.drop("page_rank_score", "size").join(ranks, ["root_id", "id"], "left")
    return scored.withColumn("page_rank_score", F.coalesce("score", F.lit(0.0))).withColumn("size", rank_node_size(F.col("page_rank_score"))).drop("score")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root_id, id, cluster_id): components over edges with both ends present, numbered 0, 1, ... by first node.

    ``nodes`` (root_id, id, node_seq), node_seq unique within a network. A network's components are
    numbered apart: the global number of each less that of its network's first. Tables of nodes or components
    are sent to every executor only if they are few.
    """
    own = written(dense_numbers(nodes.select("root_id", "id", "node_seq"), ["root_id", "node_seq"], "n"), "numbered")
    n = own.count()
    ends = [broadcast_or_merge(own.select("root_id", F.col("id").alias(a), F.col("n").alias(b)), n) for a, b in (("from_id", "u"), ("to_id", "v"))]
    links = edges.select("root_id", "from_id", "to_id").join(ends[0], ["root_id", "from_id"]).join(ends[1], ["root_id", "to_id"]).select("u", "v")
    found = contracted_components(links)
    labelled = written(own.join(broadcast_or_merge(found, n), own["n"] == found["node"], "left").select("root_id", "id", F.coalesce("component", "n").alias("c")), "labelled")
    numbers = dense_numbers(labelled.select("root_id", "c").distinct(), ["c"], "k")
    first = numbers.groupBy("root_id").agg(F.min("k").alias("k0"))
    told = numbers.join(maybe_broadcast(first, first.count()), "root_id").select("c", (F.col("k") - F.col("k0")).alias("cluster_id"))
    return labelled.join(broadcast_or_merge(told, numbers.count()), "c").select("root_id", "id", "cluster_id")


def induced_subgraph(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that ``keep`` holds for, and the edges with both ends among them."""
    left = nodes.filter(keep)
    for end in ("from_id", "to_id"):
        edges = edges.join(left.select("root_id", F.col("id").alias(end)), ["root_id", end], "left_semi")
    return left, edges


def neighbors(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(root_id, id, neighbor): each asked node itself and the other ends of its edges, repeats kept."""
    out = edges.select("root_id", F.col("from_id").alias("id"), F.col("to_id").alias("neighbor"))
    back = edges.filter("from_id <> to_id").select("root_id", F.col("to_id").alias("id"), F.col("from_id").alias("neighbor"))
    own = asked.select("root_id", "id", F.col("id").alias("neighbor"))
    return out.union(back).join(asked.select("root_id", "id").distinct(), ["root_id", "id"], "left_semi").select("root_id", "id", "neighbor").union(own)
