"""A stored keyword index: postings in blocks with their greatest impact, read for the asked terms only.

``build`` writes two tables below a folder: ``postings``, in directories by a hash of the term, each row a
block of at most ``block`` documents of a source that hold a term, those of the greatest impact first; and
``sources``, the statistics of each source. An impact is a term's BM25 part without its idf.

``search`` reads the directories of its terms, and of these the columns that bound a block first. The
``per_source``-th best impact of a single term is a floor for a query's last result; blocks that can't
reach it, with all the query's other terms at their greatest, are left out. Every document among the
results has all its blocks read, so results are those of a full evaluation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholargraph.operators.search import LISTED_TERMS, terms
from scholargraph.plans.cutpoints import maybe_broadcast, written

#: Documents of one term beyond which its postings are ordered in several parts.
PART_ROWS = 50_000
#: Words of the texts that a file of postings stands for, and files of postings to a task.
FILE_WORDS, TASK_FILES = 1_000_000, 2


def _packed(split: DataFrame) -> DataFrame:
    """(source, term, id, h, tf, len, docs) of documents (source, id, h, t): a row of arrays for a term of a source in a batch. docs: the source's in the batch.

    Terms are counted where the texts are read, so no row of a single document and term is moved.
    """

    def run(batches):
        for batch in batches:
            n, t = batch.num_rows, batch.column(3)
            of, words, size = batch.column(0).dictionary_encode(), t.flatten().dictionary_encode(), pc.list_value_length(t).to_numpy()
            k, own = len(of.dictionary), of.indices.to_numpy()
            doc = np.repeat(np.arange(n), size)
            found, tf = np.unique((words.indices.to_numpy().astype(np.int64) * k + own[doc]) * n + doc, return_counts=True)
            if not len(found):
                continue
            pair, doc = found // n, found % n
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            offsets, pair = pa.array(np.append(starts, len(found)).astype(np.int32)), pair[starts]
            held = [batch.column(1).take(pa.array(doc)), batch.column(2).take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(size[doc].astype(np.int32))]
            told = [of.dictionary.take(pa.array(pair % k)), words.dictionary.take(pa.array(pair // k)), *(pa.ListArray.from_arrays(offsets, x) for x in held), pa.array(np.bincount(own, minlength=k)[pair % k])]
            yield pa.RecordBatch.from_arrays(told, ["source", "term", "id", "h", "tf", "len", "docs"])

    kind = {f.name: f.dataType.simpleString() for f in split.schema}
    return split.select("source", "id", "h", "t").mapInArrow(run, f"source {kind['source']}, term string, id array<{kind['id']}>, h array<long>, tf array<int>, len array<int>, docs long")


def _once(docs: DataFrame, own: DataFrame, key: str, source: str, text: Column) -> DataFrame:
    """(source, id, h, t): each text of each id once. h tells texts of one id apart and is zero where there is one only.

    ``own`` (source, id, h, rows). Only documents whose id is there again are moved.
    """
    each = docs.filter(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.col(key).alias("id"), text.alias("text"))
    again = written(own.groupBy("source", "id").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("source", "id"), "again")
    n = again.count()
    if n:
        same = lambda c: (each["source"] == c["source"]) & each["id"].eqNullSafe(c["id"])
        known = maybe_broadcast(again, n)
        more = each.join(known, same(known), "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["source", "id", "h"])
        each = each.join(known, same(known), "left_anti").withColumn("h", F.lit(0).cast("long")).unionByName(more)
    else:
        each = each.withColumn("h", F.lit(0).cast("long"))
    return each.select("source", "id", "h", terms(F.col("text")).alias("t"))


def build(docs: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, key: str = "id", source: str = "source", buckets: int = 16, block: int = 128, part_rows: int = PART_ROWS) -> None:
    """Writes the index of ``docs`` (id, source, title, abstract) to ``path``, which must not exist.

    Each source is a corpus of its own; rows with a null source are in none. Null texts are empty: they
    count as documents without terms. Rows that repeat source, id and text are one document; rows of one id
    with other texts are others. An empty table gives an empty index.

    Texts are read twice, for their lengths and for their terms. Postings are moved once, packed by ``_packed``, and
    written once. A term that is frequent in a batch goes to one of several parts: every posting is in just one.
    """
    text = F.concat_ws(" ", "title", "abstract")
    sized = docs.filter(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.size(terms(text)).alias("len"))
    own = written(sized.groupBy("source", "id", "h", "len").agg(F.count("*").alias("rows")), "own")
    sources = written(own.groupBy("source").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), F.sum("len").alias("words")), "sources")
    n_sources, words = sources.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    deals = -(-words // (buckets * FILE_WORDS)) or 1
    parts = F.ceil(F.size("id") / F.col("docs") * F.col("n_docs") / part_rows)
    packed = _packed(_once(docs, own, key, source, text)).join(maybe_broadcast(sources, n_sources), "source")
    packed = packed.withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64(F.col("id")[0]), parts)).otherwise(0).cast("int"))
    held = F.arrays_zip("id", "h", "tf", "len").alias("held")
    place = ["bucket", "deal", "source", "term", "part"]
    dealt = packed.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), F.pmod(F.hash("source", "term", "part"), F.lit(deals)).alias("deal"), "source", "term", "part", "avg_len", held)
    tasks = buckets * deals // TASK_FILES
    many = tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "bucket", "deal") if many else dealt.repartition("bucket", "deal")
    met = dealt.groupBy(*place, "avg_len").agg(F.flatten(F.collect_list("held")).alias("held"))
    impact = lambda d: d["tf"] * (k1 + 1) / (d["tf"] + k1 * (1 - b + b * d["len"] / F.col("avg_len")))
    ordered = met.select(*place, F.sort_array(F.transform("held", lambda d: F.struct((-impact(d)).alias("x"), d["h"].alias("h"), d["id"].alias("id")))).alias("d"))
    blocks = F.transform(F.sequence(F.lit(0), F.size("d") - 1, F.lit(block)), lambda i: F.slice("d", i + 1, block))
    rows = ordered.select("bucket", "source", "term", "part", F.posexplode(blocks).alias("block", "d"))
    rows = rows.select("bucket", "source", "term", "part", "block", F.size("d").alias("n"), (-F.col("d")[0]["x"]).alias("most"), F.transform("d", lambda d: F.struct(d["id"].alias("id"), d["h"].alias("h"), (-d["x"]).alias("impact"))).alias("held"))
    rows.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    sources.select("source", "n_docs", "avg_len", F.lit(buckets).alias("buckets"), F.lit(block).alias("block")).coalesce(1).write.parquet(f"{path}/sources")


def postings(spark: SparkSession, path: str, asked: DataFrame, buckets: int) -> DataFrame:
    """The posting blocks of the ``asked`` terms (term): of few terms by directories and values, else by a join."""
    table = spark.read.parquet(f"{path}/postings")
    n = asked.count()
    if n <= LISTED_TERMS:
        listed = asked.select("term", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("b")).collect()
        return table.filter(F.col("bucket").isin(sorted({r.b for r in listed})) & F.col("term").isin(sorted(r.term for r in listed)))
    held = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    return table.join(maybe_broadcast(held, n), ["bucket", "term"], "left_semi")


def search(spark: SparkSession, path: str, queries: DataFrame, per_source: int = 20) -> DataFrame:
    """(query_id, source, id, score, rank) of ``queries`` (query_id, query), each source by itself.

    Null and blank queries match nothing; repeated ones are one; a term counts once a query. Ties go by id.
    """
    wanted = written(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).distinct(), "wanted")
    sources = spark.read.parquet(f"{path}/sources")
    buckets, held = sources.agg(F.max("buckets"), F.max("block")).first()
    if buckets is None:
        return wanted.select("query_id", F.lit("").alias("source"), F.lit("").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).filter("false")
    table = postings(spark, path, wanted.select("term").distinct(), buckets)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked, few = maybe_broadcast(wanted, wanted.count()), maybe_broadcast(sources.select("source", "n_docs"), sources.count())
    place = ["source", "term", "part", "block"]
    counted = table.select(*place, "most", F.sum("n").over(Window.partitionBy("source", "term")).alias("df"))
    blocks = written(counted.join(few, "source").join(asked, "term").select("query_id", *place, idf.alias("idf"), (idf * F.col("most")).alias("most")), "blocks")
    # the greatest of each term, and of the query's terms together
    most = blocks.groupBy("query_id", "source", "term").agg(F.max("most").alias("top"))
    most = written(most.withColumn("all", F.sum("top").over(Window.partitionBy("query_id", "source"))), "most")
    leading = F.col("block") * held < per_source  # the blocks that hold the first of each part
    first = blocks.filter(leading).drop("most").join(table.filter(leading).select(*place, F.slice("held", 1, per_source).alias("held")), place)
    one = first.select("query_id", "source", "term", "idf", F.explode("held.impact").alias("x")).withColumn("x", F.col("idf") * F.col("x"))
    k = F.row_number().over(Window.partitionBy("query_id", "source", "term").orderBy(F.desc("x")))
    floor = one.withColumn("k", k).filter(F.col("k") == per_source).groupBy("query_id", "source").agg(F.max("x").alias("floor"))
    bounded = blocks.join(most, ["query_id", "source", "term"]).join(floor, ["query_id", "source"], "left")
    kept = bounded.filter(F.col("floor").isNull() | (F.col("most") + F.col("all") - F.col("top") >= F.col("floor") - 1e-8)).select("query_id", *place, "idf")
    kept = written(kept, "kept")
    read = table.select(*place, "held").join(maybe_broadcast(kept, kept.count()), place)
    each = read.select("query_id", "source", "idf", F.explode("held").alias("d"))
    scored = each.groupBy("query_id", "source", F.col("d.id").alias("id"), F.col("d.h").alias("h")).agg(F.sum(F.col("idf") * F.col("d.impact")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc(F.round("score", 9)), "id", "h"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= per_source).select("query_id", "source", "id", "score", "rank")
