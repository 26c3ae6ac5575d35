"""SimHash near-duplicates: blocks of fingerprints, verified by Hamming distance, joined to components.

A fingerprint of 64 bits is keyed by pigeonhole: fingerprints within ``distance`` d of each other agree
on at least k - d of any k blocks, so each is keyed by every choice of k - d blocks and close pairs share
a key for certain. k grows with the number of distinct fingerprints, so that unrelated ones seldom share
a key; the result is the same for any k.

A similarity of 0.8 of shingle sets means that 15 % of the bits differ, which is too much for 64 bits: a
wide fingerprint of 80 blocks of 20 bits is split instead, and each block is a key. Texts within 79 of
the 1,600 bits share a block for certain; a pair at 0.80 (some 242 bits apart) shares one in 0.952 of the
cases, at 0.85 in 0.993, at 0.90 in 0.9999, whatever the table's size. A Hamming limit that hardly any
pair at 0.8 exceeds drops pairs that met by chance, and the exact similarity of the texts' sets of word
shingles decides. Equal fingerprints are one node.

Where the wide ones of a key come together, those without a near one among them are dropped at once, so that
what is kept grows with near texts and not with chance meetings.

A bucket may hold a third of all fingerprints (a large group of near copies), so pairs within buckets
are never listed. Two passes find the components without losing a link between different ones:

1. In each bucket, every fingerprint is compared with the bucket's least one and with the one before it
   in order (of wide ones each takes its few likeliest partners of all buckets; the second pass sees the
   others). Verified links give first components, which already join almost all of a large group.
2. In each bucket that still holds several components, members outside the bucket's largest component
   are compared with all its members, in salted parts. Links inside one component are not needed. A
   bucket of 64-bit fingerprints with many such members is split by pigeonhole once more, over the bits
   that its key leaves free, so that members without a link part; that loses no link either.

Unrelated wide fingerprints share a given block once in 2**20 pairs, so n distinct texts make some
n * n / 26,000 chance meetings, each one comparison of 128 bits inside the join. For far more than 10**8
distinct texts take longer blocks, and more of them (``block``, ``bits``).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.llm.columns import named, numbered, place
from scholargraph.operators.components import components
from scholargraph.plans.cutpoints import maybe_broadcast, written

#: Comparisons within a bucket of 64-bit fingerprints beyond which it is split by further bits.
CROWDED = 400_000_000
#: Shingle hashes turned to bits at once.
_CHUNK = 4_080
#: Bits for a similarity of 0.8 of shingles, in blocks of so many, and a distance that hardly any such pair
#: exceeds: 242.4 is the mean at 0.8, 14.3 the standard deviation; 280 is exceeded in 0.4 % of the cases.
WIDE, BLOCK, WIDE_DISTANCE = 1_600, 20, 280
#: The same for the first two words, 128 bits, that go along with each key: mean 19.4, deviation 4.1.
HEAD_DISTANCE = 36
#: Rows of a key that are compared with one another where they come together; those of longer ones go on as they are.
LONGEST = 1_000


def _derived(hashes: np.ndarray, k: int) -> np.ndarray:
    """(hashes, k): the hashes themselves and k - 1 further independent ones made of each."""
    if k == 1:
        return hashes[:, None]
    with np.errstate(over="ignore"):
        x = hashes[:, None] + np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    x[:, 0] = hashes
    return x


def _added(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Bit columns of 15 arrays added up: arrays of the sums' bits, the least first, by full adders on whole words."""
    out = []
    while rows:
        carries = []
        while len(rows) >= 3:
            a, b, c = rows[:3]
            either = a ^ b
            rows = [*rows[3:], either ^ c]
            carries.append((a & b) | (either & c))
        out.append(rows[0])
        rows = carries
    return out


def _sums(words: np.ndarray) -> np.ndarray:
    """How many rows of ``words`` have each bit set; bytes of ones are added eight at a time."""
    if not len(words):
        return np.zeros(64 * words.shape[1], np.int64)
    lanes = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # 255 ones fit a byte
    return sums.view(np.uint8).sum(axis=0, dtype=np.int64)


def _ones(hashes: np.ndarray, k: int) -> np.ndarray:
    """How many of the hashes have each of the 64 k bits set."""
    total = np.zeros(64 * k, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        made = _derived(hashes[at : at + _CHUNK], k)
        times = len(made) // 15 if k > 1 else 0
        if times:
            planes = _added([made[i * times : (i + 1) * times] for i in range(15)])
            total += sum(_sums(x) << i for i, x in enumerate(planes))
        total += _sums(made[15 * times :])
    return total


def fingerprint(text: str, width: int = 4, seed: int = 42, bits: int = 64) -> list[int]:
    """Words of 64 bits; a bit is 1 if it is set in over half of the hashes of the text's word shingles.

    Fewer than ``width`` words are one shingle; no words give zero. A wide fingerprint stands for the set
    of shingles, as similarity does: repeats count once.
    """
    words = text.encode().lower().split()
    if not words:
        return [0] * (bits // 64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - width + 1)].tolist()
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, (ends[min(width, len(words)) - 1 :] - 1).tolist())), np.uint64, len(starts))
    if bits > 64:
        hashes = np.unique(hashes)
    return np.packbits(2 * _ones(hashes, bits // 64) > len(hashes), bitorder="little").view("<u8").tolist()


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, w) of every document, w signed longs, th a hash of the text. A null text has no words: fingerprint zero."""

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), width, seed, bits) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(made), pa.list_(pa.int64()))], ["doc_id", "th", "w"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(run, "doc_id long, th long, w array<long>")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose keys have as many bits as ``n`` has, or as many blocks as give 400 keys."""
    k = distance + 1
    while 64 * (k - distance) // k < max(20, n.bit_length()) and comb(k + 1, distance) <= 400:
        k += 1
    return k


def _pigeonhole_keys(distance: int, blocks: int) -> list[Column]:
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum((1 << bounds[b + 1]) - (1 << bounds[b]) for b in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [F.get("w", F.lit(0)).bitwiseAND(F.lit(_signed(m))) for m in masks]


def shingles(text: str, width: int) -> frozenset[bytes]:
    """The set that similarity compares; fewer than ``width`` words are one shingle, no words none."""
    words = text.encode().lower().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def block_keys(w: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """(rows, blocks) of fingerprints (rows, words): whole numbers that tell the block's place and its bits."""
    bits = np.unpackbits(np.ascontiguousarray(w).view(np.uint8), axis=1, bitorder="little")
    n = bits.shape[1] // block
    values = np.zeros((len(w), n), np.int64)
    for i in range(block):
        values |= bits[:, i : n * block : block].astype(np.int64) << i
    return values + (np.arange(n, dtype=np.int64) << block)


def _wide_keyed(nodes: DataFrame, block: int) -> DataFrame:
    """(node, head, choice, key); the key tells the block, too."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                w = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                keys = block_keys(w, block)
                times = keys.shape[1]
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), times)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, np.repeat(w[:, 0], times), np.repeat(w[:, 1], times), keys.ravel())], ["node", "a", "b", "key"])

    made = nodes.select("node", "w").mapInArrow(run, "node long, a long, b long, key long")
    return made.select("node", F.struct("a", "b").alias("head"), F.lit(0).cast("short").alias("choice"), "key")


def near_by_head(key: np.ndarray, a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
    """Which rows, sorted by key, have another of their key with a near head; all rows of a key with over ``longest`` pass."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    live = np.repeat(sizes > longest, sizes)
    a, b = a.view(np.uint64), b.view(np.uint64)  # of signed numbers the bits of the absolute value would be counted
    at, d = np.flatnonzero(~live), 0
    while len(at):  # rows that have a row of their key d places on
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        open_ = at[~(live[at] & live[at + d])]
        near = open_[np.bitwise_count(a[open_] ^ a[open_ + d]).astype(np.int16) + np.bitwise_count(b[open_] ^ b[open_ + d]) <= HEAD_DISTANCE]
        live[near] = live[near + d] = True
    return live


def _met(keyed: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The rows of ``keyed`` with a near head among those of their key.

    Beyond 2**20 texts most keys are shared by chance, so this is told where a key's rows come together, before any is
    kept. A key of over ``longest`` rows, as of a large group of near copies, is handed on as it comes.
    """
    names = ["node", "a", "b", "key"]

    def run(batches):
        held, over = [np.zeros(0, np.int64)] * 4, None  # the rows of a key that may go on; a long key's rows pass

        def told(rows, live):
            return pa.RecordBatch.from_arrays([pa.array(x[live]) for x in rows], names)

        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, names)]
            passed = np.searchsorted(rows[3], over, "right") if over is not None else 0
            if passed:
                yield told([x[:passed] for x in rows], slice(None))
            rows = [x[passed:] for x in rows]
            last = np.searchsorted(rows[3], rows[3][-1]) if len(rows[3]) else 0
            if len(rows[3]) - last > longest:
                over, last = rows[3][-1], len(rows[3])
            done, held = [x[:last] for x in rows], [x[last:] for x in rows]
            if last:
                yield told(done, near_by_head(done[3], done[1], done[2], longest))
        if len(held[3]):
            yield told(held, near_by_head(held[3], held[1], held[2], longest))

    dealt = keyed.select("node", "head.a", "head.b", "key").repartition("key").sortWithinPartitions("key")
    made = dealt.mapInArrow(run, "node long, a long, b long, key long")
    return made.select("node", F.struct("a", "b").alias("head"), F.lit(0).cast("short").alias("choice"), "key")


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (u, v, ...) whose texts' shingles have that similarity. ``nodes`` has (node, th), ``texts`` (th, text)."""
    pairs = written(pairs, "pairs")
    met = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "th"), "node"), "met")
    found = written(texts.join(maybe_broadcast(met, met.count()), "th").groupBy("node").agg(F.any_value("text").alias("text")), "texts")
    both = pairs.join(found.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(found.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")
    schema = pairs.schema

    def run(batches):
        for batch in batches:
            keep, last, a = [], None, frozenset()
            for tu, tv in zip(batch.column("tu"), batch.column("tv")):
                tu, tv = tu.as_py(), tv.as_py()
                if tv != last:  # rows of a v follow one another
                    last, a = tv, shingles(tv, width)
                b = shingles(tu, width)
                shared = len(a & b)
                keep.append(a == b or shared >= similarity * (len(a) + len(b) - shared))
            yield batch.select(schema.names).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, schema)


def _apart(a: str, b: str, bits: int) -> Column:
    """Differing bits of two fingerprints; a sum of plain expressions, so that it stays compiled."""
    return reduce(add, [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(bits // 64)])


def _bits_apart(a: Column, b: Column, bits: int) -> Column:
    """Differing bits of two heads: the whole of a 64-bit fingerprint, two words of a wide one."""
    return reduce(add, [F.bit_count(a[x].bitwiseXOR(b[x])) for x in ("a" if bits == 64 else "ab")])


def _heads_apart(bits: int) -> Column:
    return _bits_apart(F.col("hu"), F.col("hv"), bits)


def _free_masks(distance: int, blocks: int) -> list[tuple[int, int]]:
    """(choice, mask): for each key, the choices of half of 2 * distance parts of the bits that it leaves free.

    Fingerprints that share the key and are within the distance agree on one of the choices.
    """
    bounds, parts = [64 * k // blocks for k in range(blocks + 1)], 2 * distance
    out = []
    for choice, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        free = [b for k in range(blocks) if k not in chosen for b in range(bounds[k], bounds[k + 1])]
        cut = [len(free) * k // parts for k in range(parts + 1)]
        for some in combinations(range(parts), distance):
            out.append((choice, _signed(sum(1 << b for k in some for b in free[cut[k] : cut[k + 1]]))))
    return out


def link_components(nodes: DataFrame, distance: int = 4, bits: int = 64, blocks: int | None = None, part_rows: int = 20_000, texts: DataFrame | None = None, width: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(node, component) for distinct fingerprints ``nodes`` (node, w); component is the least node it reaches.

    Wide ones need ``texts`` (th, text) and th in ``nodes``, for the exact similarity.
    """
    spark = nodes.sparkSession
    head_distance = distance if bits == 64 else HEAD_DISTANCE
    if bits == 64:
        blocks = blocks or blocks_for(nodes.count(), distance)
        keys = _pigeonhole_keys(distance, blocks)
        choices = F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), k.alias("key")) for i, k in enumerate(keys)])
        keyed = nodes.select("node", F.struct(F.get("w", F.lit(0)).alias("a")).alias("head"), F.explode(choices).alias("c")).select("node", "head", "c.choice", "c.key")
    else:
        keyed = written(_met(_wide_keyed(nodes, block)), "keyed")

    def close_indeed(pairs: DataFrame) -> DataFrame:
        """Of wide ones (u, v, ...), those that are within the distance and similar."""
        wide = [nodes.select(F.col("node").alias(a), F.col("w").alias(f"w{a}")) for a in "uv"]
        near = pairs.join(wide[0], "u").join(wide[1], "v").filter(_apart("wu", "wv", bits) <= distance).select(*pairs.columns)
        return _similar(near, nodes, texts, width, similarity)

    def likeliest(pairs: DataFrame, best: int = 4) -> DataFrame:
        """(u, v): of each u's near ones (u, v, d) those with the least d."""
        few = pairs.groupBy("u").agg(F.slice(F.sort_array(F.collect_set(F.struct("d", "v"))), 1, best).alias("s"))  # two a key at most
        return few.select("u", F.explode("s.v").alias("v"))

    # two that met by chance part here: the heads' bits, added without carry, are those in which they differ
    parts = "a" if bits == 64 else "ab"
    counted = keyed.groupBy("choice", "key").agg(F.min("node").alias("least"), F.count("*").alias("n"), *[F.bit_xor(f"head.{x}").alias(x) for x in parts])
    differing = reduce(add, [F.bit_count(x) for x in parts])
    shared = written(counted.filter((F.col("n") > 2) | (F.col("n") == 2) & (differing <= head_distance)).drop(*parts), "buckets")
    members = written(keyed.join(shared, ["choice", "key"]), "members")
    part = F.when(F.col("n") > part_rows, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / part_rows)))
    order = Window.partitionBy("choice", "key", part).orderBy("node")  # a large bucket is dealt to parts
    each = F.struct("node", "head")
    met = members.select("node", "head", "n", F.lag(each).over(order).alias("before"), F.first(each).over(order).alias("lowest")).filter("before is not null")
    # pairs that met by chance are dropped before they are listed
    close = lambda v: (v["node"] != F.col("node")) & (_bits_apart(F.col("head"), v["head"], bits) <= head_distance)
    pairs = met.select("node", "head", "n", F.explode(F.array_distinct(F.filter(F.array("before", "lowest"), close))).alias("v"))
    pairs = pairs.select(F.col("node").alias("u"), F.col("v.node").alias("v"), F.col("head").alias("hu"), F.col("v.head").alias("hv"), "n")
    # the least of a large bucket joins its parts
    large = members.filter(F.col("n") > part_rows)
    heads = nodes.select(F.col("node").alias("v"), F.struct(*[F.get("w", F.lit(i)).alias(x) for i, x in enumerate("a" if bits == 64 else "ab")]).alias("hv"))
    leasts = shared.filter(F.col("n") > part_rows).select("choice", "key", F.col("least").alias("v")).join(heads, "v")
    across = large.join(leasts, ["choice", "key"]).select(F.col("node").alias("u"), "v", F.col("head").alias("hu"), "hv", "n")
    near = pairs.union(across).filter((F.col("u") != F.col("v")) & (_heads_apart(bits) <= head_distance)).select("u", "v", _heads_apart(bits).alias("d"), "n")
    near = near if bits == 64 else written(near, "near")
    first = written(components(near.select("u", "v") if bits == 64 else close_indeed(likeliest(near))), "first")
    of = lambda a: [first.withColumnRenamed("node", "f").withColumnRenamed("component", "c"), F.col(a) == F.col("f"), "left"]
    # second pass: only buckets of several components; of two members the first pass has seen the pair
    known = written(members.filter("n > 2").join(*of("node")).select("choice", "key", "n", "head", "node", F.coalesce("c", "node").alias("comp")), "known")
    groups = known.groupBy("choice", "key", "comp").agg(F.count("*").alias("size"))
    mixed = groups.groupBy("choice", "key").agg(F.max(F.struct("size", "comp")).alias("most"), F.count("*").alias("comps")).filter("comps > 1").select("choice", "key", F.col("most.comp").alias("major"), F.col("most.size").alias("most"))
    open_ = known.join(mixed, ["choice", "key"]).withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
    if bits > 64:  # similarities just under 0.8 are told apart by the whole fingerprint only
        open_ = open_.join(nodes.select("node", "w"), "node")
    open_ = written(open_, "open")
    whole = ["w"] if bits > 64 else []
    own = lambda a: [F.col("node").alias(a), F.col("comp").alias(f"c{a}"), F.col("head").alias(f"h{a}"), *[F.col(w).alias(f"{w}{a}") for w in whole]]
    major = (F.col("comp") == F.col("major")).alias("main")
    # a pair outside the largest component is seen once
    apart = (F.col("cu") != F.col("cv")) & (F.col("main") | (F.col("u") < F.col("v"))) & (_heads_apart(bits) <= head_distance)
    if bits > 64:
        apart = apart & (_apart("wu", "wv", bits) <= distance)

    def compared(rows: DataFrame, *by: str) -> DataFrame:
        """Near pairs of different components among the rows that agree on ``by``."""
        return rows.filter("comp <> major").select(*by, *own("u")).join(rows.select(*by, *own("v"), major), list(by)).filter(apart).select("u", "v", "cu", "cv")

    # splitting makes comb(2 d, d) rows of each member, so it is for buckets that would cost far more comparisons
    crowded = ((F.col("n") - F.col("most")) * F.col("n") > CROWDED) if bits == 64 else F.lit(False)
    few = open_.filter(~crowded)
    salted = few.filter("parts > 1")  # every part of the others meets the whole bucket
    left = salted.filter("comp <> major").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("choice", "key", "p", *own("u"))
    right = salted.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("choice", "key", "p", *own("v"), major)
    more = compared(few.filter("parts = 1"), "choice", "key").union(left.join(right, ["choice", "key", "p"]).filter(apart).select("u", "v", "cu", "cv"))
    if bits > 64:
        two = near.filter("n = 2").select("u", "v").distinct()
        for x in "uv":
            two = two.join(*of(x)).withColumn(f"c{x}", F.coalesce("c", x)).drop("f", "c")
        more = close_indeed(more.union(two.filter("cu <> cv").select("u", "v", "cu", "cv")).distinct())
    elif not open_.filter(crowded).isEmpty():
        masks = spark.createDataFrame(_free_masks(distance, blocks), "choice short, mask long")  # as many rows as keys and choices, 28,000 at most
        split = open_.filter(crowded).join(F.broadcast(masks), "choice").withColumn("sub", F.col("head.a").bitwiseAND(F.col("mask")))
        more = more.union(compared(split, "choice", "key", "mask", "sub"))
    more = more.select("cu", "cv")
    joined = components(more.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).withColumnRenamed("node", "j")
    placed = nodes.select("node").join(*of("node")).select("node", F.coalesce("c", "node").alias("comp"))
    return placed.join(joined, F.col("comp") == F.col("j"), "left").select("node", F.coalesce("component", "comp").alias("component"))


def _linked(docs: DataFrame, width: int, distance: int, seed: int, bits: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every document's (doc_id, th, w, node), and (node, least_id, component) of the distinct fingerprints."""
    marked = written(fingerprints(docs, width, seed, bits, id_col, text_col).withColumn("node", F.get("w", F.lit(0)) if bits == 64 else F.xxhash64("w")), "fingerprints")
    nodes = written(marked.groupBy("node").agg(F.any_value("w").alias("w"), F.any_value("th").alias("th"), F.min("doc_id").alias("least_id")), "nodes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    links = link_components(nodes.select("node", "w", "th"), distance, bits, texts=docs.select(F.xxhash64(text).alias("th"), text.alias("text")), width=width, similarity=similarity)
    return marked, written(nodes.select("node", "least_id").join(links, "node"), "linked")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, seed: int = 42, bits: int = 64, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex digits), component_id (least doc_id reachable).

    Null ids keep a row each; a component of null ids only has a null component_id. Documents without
    words all have fingerprint zero and are linked like any others. Repeated rows repeat their row. Very
    long texts are hashed in chunks. Wide fingerprints (``bits`` over 64) find candidates only: two texts
    are linked if their shingles have the ``similarity``, exactly.
    """
    digits = F.array_join(F.transform("w", lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")
    marked, linked = _linked(docs, width, distance, seed, bits, similarity, id_col, text_col)
    ids = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = linked.join(ids, "component").select("node", "component_id")
    return marked.join(named, "node").select("doc_id", digits.alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, width: int = 5, distance: int = WIDE_DISTANCE, seed: int = 42, bits: int = WIDE, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One document of each component, that of the least id; all of ``docs``' columns.

    By default documents are near-duplicates at a similarity of 0.8 of their five-word shingles.
    Of rows that share the least id the one with the least hash of its text stays; a row with a null id
    stays only where its component has no id. Rows that repeat a kept id and text stay as one. Texts
    without words are copies of each other.
    """
    marked, linked = _linked(docs, width, distance, seed, bits, similarity, id_col, text_col)
    rows = marked.join(linked.select("node", "component"), "node").groupBy("component", "doc_id", "th").agg(F.count("*").alias("n"))
    rows = written(rows, "rows")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("best"))
    told = rows.join(best, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))
    told = written(told.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "n", "stays"), "told")
    n_gone, twice = told.agg(F.count_if(~F.col("stays")), F.count_if(F.col("stays") & (F.col("n") > 1))).first()
    back, id_, of = named(docs), place(docs, id_col), place(docs, text_col)
    rows = numbered(docs)
    text = F.xxhash64(F.coalesce(F.col(of).cast("string"), F.lit("")))
    gone = maybe_broadcast(told.filter("not stays").select("__id", "__th"), n_gone)
    kept = rows.join(gone, rows[id_].cast("long").eqNullSafe(gone["__id"]) & (text == gone["__th"]), "left_anti")
    return (kept.withColumn("__th", text).dropDuplicates([id_, "__th"]) if twice else kept).select(*back)
