"""Source records to canonical papers, and small text functions on papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.functions.ids import extract_doi, present, strip_arxiv_version
from scholargraph.schemas import PAPER


def _papers(df: DataFrame, source: str, rank: int, **made: Column) -> DataFrame:
    """All columns of a canonical paper; those not in ``made`` are null."""
    from pyspark.sql.types import StructType

    made = {"source": F.lit(source), "source_rank": F.lit(rank), "position": F.col("position"), **made}
    fields = StructType.fromDDL(PAPER)
    return df.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def joined_names(names: Column) -> Column:
    """Names joined by a comma; null elements are empty, a null list too."""
    return F.coalesce(F.array_join(F.transform(names, lambda n: F.coalesce(n, F.lit(""))), ", "), F.lit(""))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``: a lambda's variable is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def inverted_index(words: Column) -> Column:
    """The map of each of ``words`` to its places, from 0, in order; no words make an empty map."""

    def started(s):
        starts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x["w"] != F.get(s, i - 1)["w"]), i)))
        return _let(F.struct(s.alias("s"), starts.alias("starts")), entries)

    def entries(b):
        s, starts = b["s"], b["starts"]
        upto = lambda k: F.coalesce(F.get(starts, k + 1), F.size(s))
        return F.transform(starts, lambda at, k: F.struct(F.get(s, at)["w"].alias("key"), F.transform(F.slice(s, at + 1, upto(k) - at), lambda x: x["p"]).alias("value")))

    placed = F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    return F.map_from_entries(_let(placed, started))


def reconstruct_abstract(index: Column) -> Column:
    """The text of an inverted index; null stays null, an empty index is empty.

    Of words that share a position the one later in the map stays; holes and empty words vanish.
    """
    flat = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    placed = F.sort_array(F.filter(flat, lambda x: x["p"].isNotNull()))

    def joined(words: Column) -> Column:
        last = F.filter(words, lambda x, i: F.coalesce(F.get(words, i + 1)["p"] != x["p"], F.lit(True)))
        return F.array_join(F.transform(F.filter(last, lambda x: x["w"] != ""), lambda x: x["w"]), " ")

    return _let(placed, joined)


def normalize_s2(df: DataFrame) -> DataFrame:
    return _papers(
        df, "semantic_scholar", 0,
        semantic_scholar_id=F.col("paperId"), title=F.col("title"), abstract=F.col("abstract"), publication_year=F.col("year"),
        citation_count=F.coalesce("citationCount", F.lit(0)), authors=joined_names(F.col("authors.name")), venue=F.col("venue"),
        publication_date=F.col("publicationDate"), fields_of_study=F.coalesce("fieldsOfStudy", F.array().cast("array<string>")),
        url=F.col("url"), pdf_url=F.col("openAccessPdf.url"), doi=extract_doi(F.col("url")),
    )


def normalize_openalex(df: DataFrame) -> DataFrame:
    names = F.filter(F.col("authorships.author.display_name"), lambda n: n.isNotNull() & (n != ""))
    return _papers(
        df, "openalex", 1,
        openalex_id=F.col("id"), title=F.col("title"), abstract=reconstruct_abstract(F.col("abstract_inverted_index")),
        publication_year=F.col("publication_year"), citation_count=F.coalesce("cited_by_count", F.lit(0)), authors=joined_names(names),
        venue=F.col("primary_location.source.display_name"), publication_date=F.col("publication_date"),
        fields_of_study=F.coalesce("concepts.display_name", F.array().cast("array<string>")), doi=F.col("doi"),
        is_open_access=F.coalesce("open_access.is_oa", F.lit(False)),
    )


def normalize_crossref(df: DataFrame) -> DataFrame:
    names = F.transform("author", lambda a: F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit(""))))
    container = F.get("container-title", F.lit(0))
    return _papers(
        df, "crossref", 2,
        doi=F.col("DOI"), title=F.get("title", F.lit(0)), publication_year=F.get(F.get(F.col("published.date-parts"), F.lit(0)), F.lit(0)),
        citation_count=F.coalesce(F.col("`is-referenced-by-count`"), F.lit(0)), authors=joined_names(names), venue=container, journal=container,
        url=F.col("URL"), crossref_type=F.col("type"),
    )


def normalize_arxiv(df: DataFrame, as_of_year: int, details: bool = False) -> DataFrame:
    """From (arxiv_id, title, summary, published, names): one paper row each; rows without a title go."""
    base = strip_arxiv_version(F.col("arxiv_id"))
    out = df.filter(present(F.col("title")).isNotNull()).select(
        F.concat(F.lit("ARXIV:"), "arxiv_id").alias("paper_id"),
        F.regexp_replace("title", r"^\s+|\s+$", "").alias("title"),
        F.regexp_replace(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " "), r"^ | $", "").alias("abstract"),
        F.coalesce(F.year(F.try_to_timestamp("published")), F.lit(as_of_year)).alias("publication_year"),
        F.lit(0).alias("citation_count"),
        F.array_join(F.transform("names", lambda n: F.regexp_replace(n, r"^\s+|\s+$", "")), ", ").alias("authors"),
        F.lit("arXiv preprint").alias("venue"),
        F.concat(F.lit("https://arxiv.org/abs/"), base).alias("url"),
        F.concat(F.lit("https://arxiv.org/pdf/"), base, F.lit(".pdf")).alias("pdf_url"),
        F.array(F.lit("Computer Science")).alias("fields_of_study"),
    )
    if details:
        out = out.withColumn("journal", F.lit("arXiv")).withColumn("publication_types", F.array(F.lit("preprint")))
    return out


def format_authors(s: Column) -> Column:
    """Up to three names, then a mark for more; a fixed text if there are none."""
    names = F.split(s, ", ")
    short = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(" 等"))
    return F.when(present(s).isNull(), F.lit("未知作者")).when(F.size(names) > 3, short).otherwise(s)


def coalesce_year(year: Column, publication_year: Column) -> Column:
    return F.coalesce(F.nullif(year, F.lit(0)), publication_year)

