"""The stored tables: papers, authors, their link, citations, and the checks of their constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions.ids import present


def build_papers(papers: DataFrame, ranks: DataFrame, clusters: DataFrame, now: Column | None = None) -> DataFrame:
    """``papers`` (paper_id, ...) with page_rank_score, cluster_id and updated_at (``now``, by default the query's time).

    A paper without a rank has 0, one without a cluster null. Null ids stay without either; repeated papers
    stay repeated; empty tables give an empty one.
    """
    scored = papers.join(ranks.select(F.col("id").alias("paper_id"), F.col("score").cast("float").alias("page_rank_score")), "paper_id", "left")
    out = scored.join(clusters.select(F.col("id").alias("paper_id"), "cluster_id"), "paper_id", "left")
    return out.withColumn("page_rank_score", F.coalesce("page_rank_score", F.lit(0.0).cast("float"))).withColumn("updated_at", F.current_timestamp() if now is None else now)


def build_paper_authors(papers: DataFrame) -> DataFrame:
    """(paper_id, author_id, name, author_position) from ``authors`` array<struct<id,name>>, from position 0."""
    return papers.select("paper_id", F.posexplode("authors").alias("author_position", "a")).select("paper_id", F.col("a.id").alias("author_id"), F.col("a.name").alias("name"), "author_position")


def build_authors(papers: DataFrame) -> DataFrame:
    """(author_id, name, affiliations, paper_count, citation_count, h_index) from papers with their citation counts.

    Authors are structs of id, name and affiliations (array). The h-index is true: the most h papers with h
    citations each. It is counted from a histogram of an author's citation counts, so an author with very
    many papers is no large group. Repeated papers of an author count once, null citations as 0; authors
    with a null id are one; the first name in order stands, affiliations are distinct and sorted.
    """
    own = papers.select("paper_id", F.coalesce("citation_count", F.lit(0)).alias("c"), F.explode("authors").alias("a")).select("paper_id", "c", F.col("a.id").alias("author_id"), F.col("a.name").alias("name"), F.col("a.affiliations").alias("at"))
    once = own.groupBy("author_id", "paper_id").agg(F.max("c").alias("c"), F.min("name").alias("name"))
    levels = once.groupBy("author_id", "c").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    at_least = levels.withColumn("k", F.sum("n").over(Window.partitionBy("author_id").orderBy(F.desc("c"))))
    # with k papers of at least c citations, h is min(k, c) at best
    counted = at_least.groupBy("author_id").agg(F.min("name").alias("name"), F.sum("n").alias("paper_count"), F.sum(F.col("n") * F.col("c")).alias("citation_count"), F.max(F.least("k", "c")).alias("h_index"))
    places = own.select(F.col("author_id").alias("__a"), F.explode("at").alias("at")).filter("at is not null").distinct().groupBy("__a").agg(F.sort_array(F.collect_list("at")).alias("affiliations"))
    none = F.array().cast("array<string>")
    return counted.join(places, F.col("author_id").eqNullSafe(F.col("__a")), "left").select("author_id", "name", F.coalesce("affiliations", none).alias("affiliations"), "paper_count", "citation_count", "h_index")


def build_citations(references: DataFrame, citing: DataFrame | None = None) -> DataFrame:
    """(citing_paper_id, cited_paper_id, citation_count, is_influential, contexts) from both directions' lists."""
    rows = references.unionByName(citing, allowMissingColumns=True) if citing is not None else references
    return rows.groupBy("citing_paper_id", "cited_paper_id").agg(
        F.sum(F.coalesce("n", F.lit(1))).alias("citation_count"), F.bool_or(F.coalesce("is_influential", F.lit(False))).alias("is_influential"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("contexts", F.array().cast("array<string>")))))).alias("contexts"),
    )


def unique_doi_check(papers: DataFrame) -> DataFrame:
    """(doi, n) of the DOIs that several rows have."""
    return papers.filter(present(F.col("doi")).isNotNull()).groupBy("doi").agg(F.count("*").alias("n")).filter("n > 1")


def required_title_check(papers: DataFrame) -> DataFrame:
    """The rows without a title."""
    return papers.filter(F.col("title").isNull())
