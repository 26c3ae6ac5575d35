"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is short and a document long, so their resemblance says little; what counts is the share of
the item's shingles that the document contains. Items are partitioned by size (powers of two of their
number of distinct shingles). In a partition with at most u shingles, an item's sketch is its k least
shingle hashes, k = floor((1 - t) u) + 1. A document that contains at least the share t of an item's
shingles misses at most k - 1 of them, so it contains one of the sketch: no such pair is lost. Each
document's shingle hashes are probed against the sketches; candidates are then verified by the exact
containment of shingles, as words.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.plans.cutpoints import maybe_broadcast, written

#: Rows of the sketch index (16 bytes each), or sixteens of characters of the items' shingles, that may be sent
#: to every executor.
INDEX_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(of: Column, width: int, make) -> Column:
    """make(slice) for each window of ``width`` words; none if there are fewer."""
    return F.when(F.size(of) >= width, F.transform(F.sequence(F.lit(1), F.size(of) - (width - 1)), lambda i: make(F.slice(of, i, width)))).otherwise(F.array())


def item_shingles(items: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, width, shingles): distinct shingles as words. Null ids and items without words have no row.

    An item under ``width`` words is one shingle, its whole word sequence.
    """
    split = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    made = F.when(F.size("w") >= width, F.array_distinct(_windows(F.col("w"), width, lambda s: F.array_join(s, " ")))).otherwise(F.array(F.array_join("w", " ")))
    return split.select("item_id", F.least(F.lit(width), F.size("w")).alias("width"), made.alias("shingles"))


def sketches(shingled: DataFrame, share: float) -> DataFrame:
    """(h, item_id): each item's k least hashes, k set by the bound of its size partition."""
    upper = F.pow(F.lit(2), F.floor(F.log2(F.size("shingles"))) + 1) - 1
    k = (F.floor((1 - share) * upper + 1e-9) + 1).cast("int")
    hashes = F.sort_array(F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))
    return shingled.select("item_id", F.explode(F.slice(hashes, F.lit(1), k)).alias("h"))


def _pairs(docs: DataFrame, items: DataFrame, share: float, width: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(doc_id, row, item_id, n_shared, n_shingles, containment); row is a hash of the text."""
    shingled = written(item_shingles(items, width, item_col, item_text_col).distinct(), "items")
    index = sketches(shingled, share)
    sizes = shingled.groupBy("width").agg(F.sum(F.size("shingles")), F.sum(F.aggregate("shingles", F.lit(0), lambda a, x: a + F.length(x)))).collect()  # ``width`` rows at most
    widths = sorted(r[0] for r in sizes) or [width]  # items under ``width`` words are met by windows of their own length
    small, characters = sum(r[1] for r in sizes), sum(r[2] for r in sizes)  # bounds of the index, and of the items' own size
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    split = texts.select("row", "doc_id", words(F.col("text")).alias("w"))
    hashes = [_windows(F.col("w"), n, lambda s: F.xxhash64(s)) for n in widths]
    hashed = split.select("row", "doc_id", F.explode(F.concat(*hashes) if len(hashes) > 1 else hashes[0]).alias("h"))
    hits = written(hashed.join(maybe_broadcast(index, small, INDEX_ROWS), "h").select("row", "doc_id", "item_id").distinct(), "hits")
    wanted = hits.groupBy("row", "doc_id").agg(F.collect_set("item_id").alias("found"))
    wanted = maybe_broadcast(wanted, hits.count()).withColumnsRenamed({"row": "r", "doc_id": "d"})
    pairs = texts.join(wanted, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("row", "doc_id", words(F.col("text")).alias("w"), "found")
    own = [_windows(F.col("w"), n, lambda s: F.array_join(s, " ")) for n in widths]
    own = pairs.select("row", "doc_id", "found", F.array_distinct(F.concat(*own) if len(own) > 1 else own[0]).alias("own"))
    each = own.select("row", "doc_id", "own", F.explode("found").alias("item_id"))
    checked = each.join(maybe_broadcast(shingled, max(small, characters // 16), INDEX_ROWS), "item_id")
    out = checked.select("doc_id", "row", "item_id", F.size(F.array_intersect("shingles", "own")).cast("long").alias("n_shared"), F.size("shingles").cast("long").alias("n_shingles"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= share)


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of all pairs with containment >= ``share``.

    An item under ``width`` words is contained if its whole word sequence is; an item without words or
    with a null id is in no pair. Rows that repeat a document repeat its pairs; a null id keeps its row's
    pairs with a null doc_id. Null and empty texts have no pair; very long ones are searched whole.
    Repeated items (same id and text) count once; rows of one item id with different texts count apart.
    Other columns of either table don't matter.
    """
    return _pairs(docs, items, share, width, id_col, text_col, item_col, item_text_col).drop("row")


def remove_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that contain no item, with all of ``docs``' columns.

    Each row is judged by its own text, also where ids are null or repeat.
    """
    found = written(_pairs(docs, items, share, width, id_col, text_col, item_col, item_text_col).select(F.col("doc_id").alias("__found"), F.col("row").alias("__row")).distinct(), "found")
    found = maybe_broadcast(found, found.count())
    return docs.join(found, docs[id_col].eqNullSafe(found["__found"]) & (F.xxhash64(docs[text_col]) == found["__row"]), "left_anti")
