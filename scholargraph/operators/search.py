"""Search over source dumps: lookups, keyword ranking, merge with priorities, limits, id resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions import ids
from scholargraph.functions.normalize import normalize_crossref, normalize_openalex, normalize_s2
from scholargraph.plans.cutpoints import maybe_broadcast, written


#: Terms that may be written into the plan.
LISTED_TERMS = 1_000


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_keyword(docs: DataFrame, queries: DataFrame, per_source: int = 20, k1: float = 1.2, b: float = 0.75, key: str = "id", source: str = "source") -> DataFrame:
    """(query_id, source, id, score, rank): BM25 over ``docs`` (id, source, title, abstract) per source.

    Only the terms of the queries are counted; document lengths are read in the same pass. Each source is
    a corpus of its own, as each was ranked by itself. Null and empty texts and queries match nothing; a
    repeated id is one document per text, and rows that repeat both add up; a null source is no corpus. Queries may
    be many. For a corpus that is asked again and again see ``keyword_index``.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    asked = written(wanted.select("term").distinct(), "asked")
    n_asked = asked.count()
    text = F.concat_ws(" ", "title", "abstract")
    split = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), F.xxhash64(text).alias("h"), terms(text).alias("t"))
    kept = F.col("t")
    if n_asked <= LISTED_TERMS:  # other words needn't be written
        listed = [r[0] for r in asked.collect()]
        kept = F.filter("t", lambda x: x.isin(listed))
    sized = written(split.select("id", "source", "h", F.size("t").alias("len"), kept.alias("t")), "terms")
    stats = written(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")), "stats")
    each = sized.select("id", "source", "h", "len", F.explode("t").alias("term")).join(maybe_broadcast(asked, n_asked), "term", "left_semi")
    tf = written(each.groupBy("id", "source", "h", "len", "term").agg(F.count("*").alias("tf")), "tf")
    df = written(tf.groupBy("source", "term").agg(F.count("*").alias("df")), "df")
    # few sources and terms: sent along if their count is small, so that no source or term is one task
    known = tf.join(maybe_broadcast(df, df.count()), ["source", "term"]).join(maybe_broadcast(stats, stats.count()), "source")
    joined = known.join(maybe_broadcast(wanted, wanted.count()), "term")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = joined.groupBy("query_id", "source", "id", "h").agg(F.sum(part).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc(F.round("score", 9)), "id", "h"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= per_source).drop("h")


def _lookup(papers: DataFrame, queries: DataFrame, kind: str, key: Column, wanted: Column) -> DataFrame:
    """(query_id, paper columns) by equal key; the queries' side is broadcast if it is small."""
    asked = queries.filter(F.col("query_type") == kind).select("query_id", wanted.alias("__key"))
    return papers.withColumn("__key", key).join(maybe_broadcast(asked, asked.count()), "__key").drop("__key")


def search_doi(papers: DataFrame, queries: DataFrame, doi_mode: str = "normalized") -> DataFrame:
    """(query_id, paper columns): papers of S2-style and CrossRef-style sources with the asked DOI.

    Null DOIs and queries match nothing; repeated papers or queries repeat their rows; empty tables give an
    empty one. ``doi_mode`` as in ``merge_dedup``.
    """
    norm = ids.normalized_doi if doi_mode == "normalized" else lambda c: c
    return _lookup(papers.filter(F.col("source") != "openalex"), queries, "doi", norm(F.col("doi")), norm(F.trim(F.col("query"))))


def search_arxiv(papers: DataFrame, queries: DataFrame) -> DataFrame:
    """``papers`` with an arxiv_id; versions and the prefix of the asked id don't matter."""
    asked = ids.strip_arxiv_version(F.regexp_replace(F.trim(F.col("query")), r"(?i)^arxiv:?", ""))
    return _lookup(papers, queries, "arxiv", ids.strip_arxiv_version(F.col("arxiv_id")), asked)


def search_s2_id(papers: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, paper columns): S2-style papers with the asked id; nulls match nothing, repeats repeat."""
    return _lookup(papers.filter(F.col("source") == "semantic_scholar"), queries, "semantic_scholar", F.col("semantic_scholar_id"), F.trim(F.col("query")))


def valid_queries(queries: DataFrame) -> DataFrame:
    """(query_id, query, query_type, error): blank queries are errors; an unknown type is a keyword search."""
    blank = ids.present(F.trim(F.col("query"))).isNull()
    kind = F.when(F.col("query_type").isin("doi", "arxiv", "semantic_scholar"), F.col("query_type")).when(F.col("query_type") == "s2_id", "semantic_scholar").otherwise("keyword")
    return queries.select("query_id", "query", kind.alias("query_type"), F.when(blank, "query is required").alias("error"))


def search(queries: DataFrame, s2: DataFrame, openalex: DataFrame, crossref: DataFrame, doi_mode: str = "raw") -> DataFrame:
    """All of ``queries`` (query_id, query, query_type) at once: canonical papers per query, merged."""
    asked = valid_queries(queries).filter("error is null")
    papers = normalize_s2(s2).unionByName(normalize_openalex(openalex)).unionByName(normalize_crossref(crossref))
    arxiv = papers.filter(F.col("source") == "semantic_scholar").withColumn("arxiv_id", ids.classify_paper_id(F.col("url"), strict=False)["value"])
    found = search_doi(papers, asked).unionByName(search_arxiv(arxiv, asked).drop("arxiv_id")).unionByName(search_s2_id(papers, asked))
    words = asked.filter(F.col("query_type") == "keyword")
    pool = papers.filter(F.col("source") != "crossref").withColumn("__id", F.coalesce("semantic_scholar_id", "openalex_id"))
    ranked = search_keyword(pool, words, key="__id")
    best = pool.join(ranked.select("query_id", "source", F.col("id").alias("__id"), F.col("rank").alias("__rank")), ["source", "__id"])
    return merge_dedup(found.unionByName(best.withColumn("position", F.col("__rank")).drop("__id", "__rank")), doi_mode, ["query_id"])


def merge_key(doi_mode: str = "raw") -> Column:
    """What papers are merged by: DOI, else the source's id, else the title; null if a paper has none."""
    own = F.when(F.col("source") == "semantic_scholar", F.col("semantic_scholar_id")).when(F.col("source") == "openalex", F.col("openalex_id"))
    doi = F.col("doi") if doi_mode == "raw" else ids.normalized_doi(F.col("doi"))
    return F.coalesce(ids.present(doi), ids.present(own), ids.present(F.col("title")))


def merge_dedup(papers: DataFrame, doi_mode: str = "raw", by: list[str] | None = None) -> DataFrame:
    """The first paper of each key, by source and position; papers without a key go.

    Key: DOI, else the source's id, else the title. ``doi_mode`` raw keeps the sources' own spellings
    of DOIs, normalized compares them without resolver and case. Empty strings are as null; of papers with
    the same key, source and position any one stays; an empty table gives an empty one.
    """
    keyed = papers.withColumn("__key", merge_key(doi_mode)).filter("__key is not null")
    first = F.row_number().over(Window.partitionBy(*(by or []), "__key").orderBy("source_rank", "position"))
    return keyed.withColumn("__r", first).filter("__r = 1").drop("__r", "__key")


def sort_by_citations(papers: DataFrame) -> DataFrame:
    return papers.orderBy(F.desc("citation_count"), "source_rank", "position")


def top_results(papers: DataFrame, n: int = 50, by: list[str] | None = None) -> DataFrame:
    """The first ``n`` by citations, per query if ``by`` names it."""
    if not by:
        return sort_by_citations(papers).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("citation_count"), "source_rank", "position"))
    return papers.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def search_stats(papers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Papers per source before merging, a column for each source."""
    counts = [F.count_if(F.col("source") == s).alias(f"{s}_count") for s in ("semantic_scholar", "openalex", "crossref")]
    return papers.groupBy(*by).agg(*counts) if by else papers.agg(*counts)


def resolve_ids(asked: DataFrame, works: DataFrame) -> DataFrame:
    """``asked`` (id) with kind and value; OpenAlex ids become the DOI or arXiv id of their work.

    Ids without a work stay as they are; a null id has null kind and value; repeated ids repeat their rows;
    of several DOIs of a work the least counts. Empty tables give an empty one, or ids without works.
    """
    parsed = asked.withColumn("c", ids.classify_paper_id(F.col("id"))).withColumn("work", F.when(F.col("c.kind") == "openalex", ids.openalex_work_id(F.trim("id"))))
    known = works.select(ids.openalex_work_id(F.col("id")).alias("work"), ids.strip_doi_resolver(F.col("doi")).alias("work_doi")).filter("work is not null and work_doi <> ''")
    known = known.groupBy("work").agg(F.min("work_doi").alias("work_doi"))
    arxiv = ids.arxiv_from_doi(F.col("work_doi"))
    joined = parsed.join(known, "work", "left")
    kind = F.when(F.col("work_doi").isNull(), F.col("c.kind")).when(arxiv.isNotNull(), "arxiv").otherwise("doi")
    return joined.select("id", kind.alias("kind"), F.coalesce(arxiv, "work_doi", "c.value").alias("value"), F.col("c.error").alias("error"))


def lookup_paper(resolved: DataFrame, papers: DataFrame, arxiv_papers: DataFrame) -> DataFrame:
    """``resolved`` (id, kind, value) with paper_id, title and where it was found; null if nowhere.

    ``papers`` (paper_id, doi, arxiv_id, title) first, then, for arXiv ids, ``arxiv_papers``. Of several papers
    with a key the one of the least id counts. Null values are missing; repeated questions repeat their rows.
    """
    keys = papers.select(F.explode(F.array(F.struct(F.lit("doi").alias("kind"), F.lower("doi").alias("k")), F.struct(F.lit("arxiv").alias("kind"), ids.strip_arxiv_version(F.col("arxiv_id")).alias("k")), F.struct(F.lit("s2").alias("kind"), F.col("paper_id").alias("k")))).alias("x"), "paper_id", "title").select("x.kind", "x.k", "paper_id", "title").filter("k is not null")
    keys = keys.groupBy("kind", "k").agg(F.min_by("title", "paper_id").alias("title"), F.min("paper_id").alias("paper_id"))
    key = F.when(F.col("kind") == "arxiv", ids.strip_arxiv_version(F.col("value"))).when(F.col("kind") == "doi", F.lower("value")).otherwise(F.col("value"))
    kind = F.when(F.col("kind").isin("doi", "arxiv"), F.col("kind")).otherwise("s2")
    asked = resolved.select("id", F.col("kind").alias("asked_kind"), kind.alias("kind"), key.alias("k"))
    other = arxiv_papers.select(F.lit("arxiv").alias("kind"), ids.strip_arxiv_version(F.regexp_replace("paper_id", "^ARXIV:", "")).alias("k"), F.col("paper_id").alias("a_id"), F.col("title").alias("a_title"))
    both = asked.join(keys, ["kind", "k"], "left").join(other.dropDuplicates(["kind", "k"]), ["kind", "k"], "left")
    where = F.when(F.col("paper_id").isNotNull(), "papers").when(F.col("a_id").isNotNull(), "arxiv").otherwise("missing")
    return both.select("id", F.col("asked_kind").alias("kind"), F.coalesce("paper_id", "a_id").alias("paper_id"), F.coalesce("title", "a_title").alias("title"), where.alias("found_in"))
