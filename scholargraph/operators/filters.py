"""Filters and facets on canonical papers."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholargraph.functions.ids import present


def filter_year(lo: int, hi: int, year: str = "publication_year") -> Column:
    """Missing years pass."""
    y = F.col(year)
    return y.isNull() | (y == 0) | y.between(lo, hi)


def filter_min_citations(n: int) -> Column:
    return F.coalesce("citation_count", F.lit(0)) >= n


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests) if tests else F.lit(True)


def filter_fields(wanted: list[str]) -> Column:
    """Any wanted text inside any field of the paper, in any case; nothing wanted keeps all."""
    return _any([F.coalesce(F.exists("fields_of_study", lambda f: F.contains(F.lower(f), F.lit(w.lower()))), F.lit(False)) for w in wanted])


def venue_or_journal() -> Column:
    return F.coalesce(present(F.col("venue")), F.col("journal"), F.lit(""))


def filter_venues(wanted: list[str]) -> Column:
    return _any([F.contains(F.lower(venue_or_journal()), F.lit(w.lower())) for w in wanted])


@dataclass(frozen=True)
class FilterSpec:
    """What a user can set; ``hi`` has no default, as it is the current year."""

    hi: int
    lo: int = 1990
    min_citations: int = 0
    fields: list[str] = field(default_factory=list)
    venues: list[str] = field(default_factory=list)

    def predicate(self) -> Column:
        return reduce(and_, [filter_year(self.lo, self.hi), filter_min_citations(self.min_citations), filter_fields(self.fields), filter_venues(self.venues)])


def apply_filters(papers: DataFrame, spec: FilterSpec) -> DataFrame:
    return papers.filter(spec.predicate())


def filtered_counts(papers: DataFrame, spec: FilterSpec) -> DataFrame:
    """(total, kept) in one pass."""
    return papers.agg(F.count("*").alias("total"), F.count_if(spec.predicate()).alias("kept"))


def facet_years(papers: DataFrame) -> DataFrame:
    return papers.select("publication_year").filter("publication_year is not null and publication_year <> 0").distinct().orderBy(F.desc("publication_year"))


def facet_fields(papers: DataFrame, limit: int | None = 10) -> DataFrame:
    found = papers.select(F.explode("fields_of_study").alias("field")).filter("field <> ''").distinct().orderBy("field")
    return found.limit(limit) if limit else found


def facet_venues(papers: DataFrame, limit: int | None = 10) -> DataFrame:
    found = papers.select(venue_or_journal().alias("venue")).filter("venue <> ''").distinct().orderBy("venue")
    return found.limit(limit) if limit else found


def year_bounds(papers: DataFrame, as_of_year: int) -> DataFrame:
    y = F.nullif(F.col("publication_year"), F.lit(0))
    return papers.agg(F.coalesce(F.min(y), F.lit(1990)).alias("lo"), F.coalesce(F.max(y), F.lit(as_of_year)).alias("hi"))


def facets(papers: DataFrame, as_of_year: int, limit: int = 10) -> DataFrame:
    """(facet, rank, value) of all facets by one scan: year (falling), field and venue (rising, the first ``limit``), bounds (lo, hi).

    Each paper gives its values once; grouping sets by facet and value, and by facet alone, make the lists
    and the bounds of years in one aggregation. Missing, empty and zero values are none; without years the
    bounds are 1990 and ``as_of_year``. An empty table has these bounds only.
    """
    year = F.col("publication_year")
    one = lambda facet, value, number=F.lit(None).cast("int"): F.struct(F.lit(facet).alias("facet"), value.alias("value"), number.alias("number"))
    fields = F.transform(F.array_distinct(F.coalesce("fields_of_study", F.array().cast("array<string>"))), lambda f: one("field", f))
    given = F.filter(F.concat(F.array(one("year", year.cast("string"), year.cast("int")), one("venue", venue_or_journal())), fields), lambda x: x["value"].isNotNull() & (x["value"] != "") & ((x["facet"] != "year") | (x["number"] != 0)))
    each = papers.select(F.explode(given).alias("x")).select("x.*")
    sets = each.groupingSets([["facet", "value"], ["facet"]], "facet", "value").agg(F.grouping("value").alias("whole"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    rank = F.row_number().over(Window.partitionBy("facet", "whole").orderBy(F.desc("lo"), "value"))  # years by number, others by value
    ranked = sets.withColumn("rank", rank).filter((F.col("facet") == "year") | (F.col("rank") <= limit))
    bounds = F.when((F.col("whole") == 1) & (F.col("facet") == "year"), F.array(F.struct(F.lit("bounds").alias("facet"), F.lit(1).alias("rank"), F.col("lo").cast("string").alias("value")), F.struct(F.lit("bounds").alias("facet"), F.lit(2).alias("rank"), F.col("hi").cast("string").alias("value"))))
    rows = F.when(F.col("whole") == 1, F.coalesce(bounds, F.array().cast("array<struct<facet:string,rank:int,value:string>>"))).otherwise(F.array(F.struct("facet", "rank", "value")))
    listed = ranked.select(F.explode(rows).alias("x")).select("x.*")
    # default bounds give way to found ones
    spark = papers.sparkSession
    default = spark.createDataFrame([("bounds", 1, "1990"), ("bounds", 2, str(as_of_year))], "facet string, rank int, value string")
    return listed.withColumn("z", F.lit(0)).union(default.withColumn("z", F.lit(1))).groupBy("facet", "rank").agg(F.min_by("value", "z").alias("value"))
