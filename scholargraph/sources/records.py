"""Readers of bibliographic records: JSON lines or Parquet dumps, and Atom entries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scholargraph import schemas
from scholargraph.functions.ids import present


def _read(spark: SparkSession, path: str, schema: str, fmt: str, allow_missing: bool, envelope: str | None = None) -> DataFrame:
    """Malformed JSON lines stay, with their text in ``_corrupt_record``; a missing path can count as empty."""
    fields = StructType.fromDDL(schema)
    inner = StructType([StructField(envelope, fields)]) if envelope else fields
    if fmt == "json":
        inner = StructType([*inner.fields, StructField("_corrupt_record", StringType())])
    try:
        reader = spark.read.schema(inner)
        df = reader.option("mode", "PERMISSIVE").json(path) if fmt == "json" else reader.parquet(path)
    except AnalysisException as e:
        if not allow_missing or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], fields)
    return df.select(f"{envelope}.*", *[c for c in df.columns if c != envelope]) if envelope else df


def read_s2_papers(spark: SparkSession, path: str, fmt: str = "json", allow_missing: bool = True) -> DataFrame:
    return _read(spark, path, schemas.S2_PAPER, fmt, allow_missing)


def read_openalex_works(spark: SparkSession, path: str, fmt: str = "json", allow_missing: bool = True) -> DataFrame:
    return _read(spark, path, schemas.OPENALEX_WORK, fmt, allow_missing)


def read_crossref_works(spark: SparkSession, path: str, fmt: str = "json", allow_missing: bool = True, envelope: bool = True) -> DataFrame:
    """With ``envelope`` each record lies in ``message``."""
    return _read(spark, path, schemas.CROSSREF_WORK, fmt, allow_missing, "message" if envelope else None)


def read_citation_contexts(spark: SparkSession, path: str, fmt: str = "json", allow_missing: bool = True) -> DataFrame:
    return flatten_contexts(_read(spark, path, schemas.CITATION_CONTEXT, fmt, allow_missing))


def flatten_contexts(df: DataFrame) -> DataFrame:
    citing = [F.col(f"citingPaper.{a}").alias(b) for a, b in (("paperId", "citing_paper_id"), ("title", "citing_title"), ("year", "citing_year"))]
    return df.select("cited_paper_id", *citing, "contexts", F.coalesce("isInfluential", F.lit(False)).alias("is_influential"), "position")


def read_arxiv_atom(df: DataFrame, xml_col: str = "xml", id_col: str = "arxiv_id") -> DataFrame:
    """(arxiv_id, title, summary, published, names) of one Atom document per row; absent parts are null.

    For files: ``spark.read.text(path, wholetext=True)``.
    """
    xml = F.col(xml_col)
    part = lambda tag, flags="": present(F.regexp_extract(xml, f"{flags}<{tag}>(.+?)</{tag}>", 1))
    names = F.regexp_extract_all(xml, F.lit("<name>(.+?)</name>"), 1)
    return df.select(F.col(id_col).alias("arxiv_id"), part("title", "(?s)").alias("title"), part("summary", "(?s)").alias("summary"), part("published").alias("published"), names.alias("names"))
