"""Scholarly tables derived from a star schema, so that queries have data at every scale.

A part is a paper, a supplier an author; the parts of an order cite one another downwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    """(citing, cited, n): within an order each part cites the next lower one. ``thin``: pairs of several orders.

    Dealt out by order once, for repeats and windows, and once by citing paper, for counts and what goes by it later.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey")
    lower = F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_partkey"))
    cited = lines.distinct().withColumn("cited", lower).filter("cited is not null")
    found = cited.select(F.col("l_partkey").alias("citing"), "cited").repartition("citing").groupBy("citing", "cited").agg(F.count("*").alias("n"))
    return found.filter("n > 1") if thin else found


def citations(spark: SparkSession, sf_dir: str, thin: bool = False, known: DataFrame | None = None) -> DataFrame:
    """The citation table with list positions; titles of unresolved papers are known for even keys only. ``known``: its pairs, if they are there."""
    p = pairs(spark, sf_dir, thin) if known is None else known
    ref = F.row_number().over(Window.partitionBy("citing").orderBy(F.desc("n"), "cited"))
    cite = F.row_number().over(Window.partitionBy("cited").orderBy(F.desc("n"), "citing"))
    title = lambda c: F.when((F.col(c) % 13 != 7) | (F.col(c) % 2 == 0), F.concat(F.lit("paper "), F.col(c).cast("string")))
    return p.select(
        F.col("citing").cast("string").alias("citing_paper_id"), F.col("cited").cast("string").alias("cited_paper_id"), ref.alias("ref_position"), cite.alias("cite_position"),
        title("citing").alias("citing_title"), title("cited").alias("cited_title"), (F.col("n") > 1).alias("is_influential"), "n", "citing", "cited",
        F.array(F.concat(F.lit("cited "), F.col("n").cast("string"), F.lit(" times"))).alias("contexts"),
    )


def papers(spark: SparkSession, sf_dir: str, resolved: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Canonical papers with key; ``resolved`` leaves out the keys that can't be looked up. ``known``: pairs, as above."""
    indegree = (pairs(spark, sf_dir) if known is None else known).groupBy(F.col("cited").alias("key")).agg(F.count("*").alias("in"))
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "key")
    if resolved:
        part = part.filter("key % 13 <> 7")
    key = F.col("key").cast("string")
    url = F.when(F.col("key") % 3 == 0, F.concat(F.lit("https://doi.org/10.1234/part."), key)).when(F.col("key") % 3 == 1, F.concat(F.lit("https://example.org/paper/"), key))
    return part.join(indegree, "key", "left").select(
        "key", key.alias("paper_id"), F.concat_ws(" ", "p_name", key).alias("title"), F.concat(F.lit("about "), "p_name").alias("abstract"),
        F.when(F.col("key") % 11 != 0, 1975 + F.col("p_size")).alias("publication_year"), F.coalesce("in", F.lit(0)).cast("int").alias("citation_count"),
        F.col("p_brand").alias("venue"), F.lit(None).cast("string").alias("journal"), F.concat(F.array("p_type"), F.split("p_name", " ")).alias("fields_of_study"),
        F.concat(F.lit("Author "), (F.col("key") % 97).cast("string")).alias("authors"), url.alias("url"), F.lit(None).cast("string").alias("pdf_url"),
        F.when(F.col("key") % 3 == 0, F.concat(F.lit("10.1234/part."), key)).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"),
    )


def paper_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, paper_id, citation_count, authors): distinct suppliers of each part, by key."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_suppkey").distinct()
    named = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("s_address")), F.col("l_suppkey") == F.col("s_suppkey"))
    listed = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name", "s_address"))).alias("a"))
    people = F.transform("a", lambda x: F.struct(x["s_suppkey"].cast("string").alias("id"), x["s_name"].alias("name"), F.array(x["s_address"]).alias("affiliations")))
    return papers(spark, sf_dir).select("key", "paper_id", "citation_count").join(listed, "key").select("key", "paper_id", "citation_count", people.alias("authors"))


def s2_papers(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """S2-style records of the even keys; every fourth of them has no abstract."""
    p = papers(spark, sf_dir, known=known).filter("key % 2 = 0")
    people = F.transform(F.sequence(F.lit(0), (F.col("key") % 5).cast("int")), lambda i: F.struct(i.cast("string").alias("authorId"), F.concat(F.lit("Author "), i.cast("string")).alias("name"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("array<string>").alias("affiliations")))
    none = F.lit(None)
    return p.select(
        F.concat(F.lit("s2-"), "paper_id").alias("paperId"), "title", F.when(F.col("key") % 4 == 0, F.col("abstract")).alias("abstract"), F.col("publication_year").alias("year"),
        F.col("citation_count").alias("citationCount"), none.cast("int").alias("influentialCitationCount"), F.when(F.col("key") % 6 != 0, people).alias("authors"), "venue",
        none.cast("struct<name:string>").alias("journal"), none.cast("string").alias("publicationVenue"), none.cast("array<string>").alias("publicationTypes"), none.cast("string").alias("publicationDate"),
        F.col("fields_of_study").alias("fieldsOfStudy"), "url", none.cast("struct<url:string>").alias("openAccessPdf"),
        none.cast("array<struct<paperId:string,title:string,year:int,citationCount:int>>").alias("references"), none.cast("array<struct<paperId:string,title:string,year:int,citationCount:int>>").alias("citations"),
        F.col("key").cast("int").alias("position"),
    )


def openalex_works(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """OpenAlex-style works of the keys divisible by 3; their DOIs carry the resolver."""
    p = papers(spark, sf_dir, known=known).filter("key % 3 = 0")
    words = F.split("abstract", " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    concepts = F.transform("fields_of_study", lambda f, i: F.struct(F.concat(F.lit("C"), i.cast("string")).alias("id"), f.alias("display_name"), i.cast("int").alias("level"), F.lit(0.5).alias("score")))
    who = F.array(F.struct(F.struct(F.col("authors").alias("display_name")).alias("author")), F.struct(F.struct(F.lit("").alias("display_name")).alias("author")))
    none = F.lit(None)
    return p.select(
        F.concat(F.lit("https://openalex.org/W"), (F.col("key") + 100000).cast("string")).alias("id"), "title", index.alias("abstract_inverted_index"), "publication_year", F.col("citation_count").alias("cited_by_count"),
        who.alias("authorships"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), none.cast("string").alias("publication_date"), concepts.alias("concepts"),
        F.when(F.col("key") % 2 == 0, F.struct((F.col("key") % 4 == 0).alias("is_oa"))).alias("open_access"), none.cast("struct<host_venue:struct<url:string>>").alias("best_oa_location"), none.cast("string").alias("apc_paid"),
        none.cast("array<string>").alias("sustainable_development_goals"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.col("key").cast("int").alias("position"),
    )


def crossref_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CrossRef-style works of the keys divisible by 5; their DOIs are in capitals, some are missing."""
    p = papers(spark, sf_dir).filter("key % 5 = 0")
    who = F.array(F.struct(F.lit("Ann").alias("given"), F.lit("Lee").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.col("authors").alias("family")))
    return p.select(
        F.upper("doi").alias("DOI"), F.array("title").alias("title"), F.struct(F.array(F.array("publication_year")).alias("date-parts")).alias("published"), F.col("citation_count").alias("is-referenced-by-count"),
        F.when(F.col("key") % 10 == 0, who).alias("author"), F.array("venue").alias("container-title"), F.col("url").alias("URL"), F.lit("journal-article").alias("type"), F.col("key").cast("int").alias("position"),
    )


def s2_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2-style records with the fields that details have: lists of references and citations, journal, types, dates, PDF."""
    k, text = F.col("position"), F.col("position").cast("string")
    cit = citations(spark, sf_dir)

    def listed(own: str, other: str, place: str, name: str) -> DataFrame:
        year = F.when(F.col(other) % 3 != 0, (1975 + F.col(other) % 50).cast("int"))
        one = F.struct(F.concat(F.lit("s2-"), F.col(other).cast("string")).alias("paperId"), F.col(f"{own_title[other]}").alias("title"), year.alias("year"), F.col("n").cast("int").alias("citationCount"))
        made = cit.groupBy(F.col(own).cast("int").alias("position")).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("at"), one.alias("x")))).alias("l"))
        return made.select("position", F.col("l.x").alias(name))

    own_title = {"cited": "cited_title", "citing": "citing_title"}
    base = s2_papers(spark, sf_dir).drop("references", "citations")
    both = base.join(listed("citing", "cited", "ref_position", "references"), "position", "left").join(listed("cited", "citing", "cite_position", "citations"), "position", "left")
    return both.withColumns({
        "journal": F.when(k % 8 == 0, F.struct(F.concat(F.lit("Journal "), (k % 5).cast("string")).alias("name"))).when(k % 8 == 2, F.struct(F.lit("").alias("name"))),
        "publicationVenue": F.when(k % 10 == 0, F.concat(F.lit("Venue "), (k % 3).cast("string"))), "publicationTypes": F.when(k % 4 == 0, F.array(F.lit("JournalArticle"), F.concat(F.lit("Type "), (k % 3).cast("string")))),
        "publicationDate": F.when(k % 3 != 1, F.concat(F.col("year").cast("string"), F.lit("-01-15"))), "influentialCitationCount": F.when(k % 4 == 2, k % 17),
        "openAccessPdf": F.when(k % 6 == 0, F.struct(F.concat(F.lit("https://example.org/pdf/"), text).alias("url"))),
    })


def openalex_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OpenAlex-style works with open access places, charges and goals."""
    k, text = F.col("position"), F.col("position").cast("string")
    return openalex_works(spark, sf_dir).withColumns({
        "best_oa_location": F.when(k % 6 == 0, F.struct(F.struct(F.concat(F.lit("https://oa.example.org/"), text).alias("url")).alias("host_venue"))),
        "apc_paid": F.when(k % 9 == 0, (k % 7 * 100).cast("string")), "sustainable_development_goals": F.when(k % 12 == 0, F.array(F.lit("SDG 3"), F.concat(F.lit("SDG "), (k % 17).cast("string")))),
    })


def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, arxiv_id, xml): an Atom entry of each part, with odd spaces, lines within titles, several or no names, sometimes no date or summary."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    name = lambda i: F.concat(F.lit("<author><name> Author "), ((k + i) % 97).cast("string"), F.lit("</name></author>"))
    names = F.when(k % 4 == 0, "").when(k % 4 == 1, name(0)).otherwise(F.concat(name(0), F.lit("\n"), name(1)))
    summary = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("<summary>\n  about\t "), F.col("p_name"), F.lit("\n\n and more </summary>")))
    day = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("<published>"), (1990 + k % 35).cast("string"), F.lit("-06-01T12:00:00Z</published>")))
    xml = F.concat(F.lit("<entry>\n<title>\n Paper "), text, F.lit("\nof "), F.col("p_name"), F.lit(" </title>\n"), summary, day, names, F.lit("</entry>"))
    return table(spark, sf_dir, "part").select(k.alias("key"), F.concat(F.lit("2101."), F.lpad((k % 100000).cast("string"), 5, "0"), F.when(k % 2 == 0, "v3").otherwise("")).alias("arxiv_id"), xml.alias("xml"))
