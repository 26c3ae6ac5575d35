"""Identifier functions: Columns in, Columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ARXIV = r"\d{4}\.\d{4,5}(?:v\d+)?"


def present(c: Column) -> Column:
    """Null for null and the empty string."""
    return F.nullif(c, F.lit(""))


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return present(F.regexp_extract(c, pattern, group))


def extract_doi(url: Column) -> Column:
    """The first DOI inside a string, or null."""
    return _found(url, r"(?i)10\.\d{4,}[\w().\-/:]+")


def strip_arxiv_version(c: Column) -> Column:
    return F.regexp_replace(c, r"v\d+$", "")


def strip_doi_resolver(doi: Column) -> Column:
    """Without the first ``https://doi.org/``, in that spelling only."""
    return F.regexp_replace(doi, r"^(.*?)https://doi\.org/", "$1")


def normalized_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(doi), r"^(?:https?://)?(?:dx\.)?doi\.org/", "")


def arxiv_from_doi(doi: Column) -> Column:
    """The arXiv id of an arXiv DOI that spells ``arxiv`` in lower case; else null."""
    return F.when(F.contains(doi, F.lit("arxiv")), _found(doi, rf"(?i)10\.48550/arxiv\.({_ARXIV})", 1))


def openalex_work_id(c: Column) -> Column:
    """``W`` and digits of a work's URL or id; null where it is neither."""
    is_url, is_id = c.startswith("https://openalex.org/") | F.contains(c, F.lit("openalex.org/W")), c.startswith("W") & (F.length(c) > 5)
    return F.when(is_url | is_id, _found(c, r"W\d+"))


def classify_paper_id(c: Column, strict: bool = True) -> Column:
    """struct(kind, value, error); kind is arxiv, doi, openalex or s2, null on error.

    Branches in order: an arXiv DOI URL; a bare DOI; an arXiv id; an OpenAlex id; else an S2 id. With
    ``strict`` off, ``arxiv`` in a DOI URL is found in any case.
    """
    s = F.trim(c)
    low = F.lower(s)
    from_url = _found(s, rf"(?i)arxiv\.({_ARXIV})", 1)
    bare = F.regexp_replace(s, r"(?i)^arxiv:?", "")
    made = lambda kind, value, error=None: F.struct(F.lit(kind).cast("string").alias("kind"), value.alias("value"), F.lit(error).cast("string").alias("error"))
    failed = lambda error: made(None, F.lit(None).cast("string"), error)
    return (
        F.when(s.isNull() | (s == ""), failed("empty id"))
        .when(F.contains(s, F.lit("doi.org")) & F.contains(s if strict else low, F.lit("arxiv")), F.when(from_url.isNotNull(), made("arxiv", from_url)).otherwise(failed("no arXiv id in DOI")))
        .when(s.startswith("10."), made("doi", s))
        .when(F.contains(low, F.lit("arxiv")) | s.rlike(f"^{_ARXIV}$"), F.when(bare.rlike(f"^{_ARXIV}$"), made("arxiv", bare)).otherwise(failed("invalid arXiv id")))
        .when(F.contains(s, F.lit("openalex.org")) | s.startswith("W"), made("openalex", s))
        .otherwise(made("s2", s))
    )


def network_query_hash(paper_id: Column, depth: Column | int, max_nodes: Column | int) -> Column:
    """Sixteen hex digits that name a network request."""
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (depth, max_nodes)]
    return F.substring(F.sha2(F.concat_ws("_", paper_id, *parts), 256), 1, 16)


def preferred_paper_id(s2: Column, doi: Column, openalex: Column, own: Column) -> Column:
    """The id a network is asked for by."""
    return F.coalesce(present(s2), present(doi), present(openalex), own)


def preferred_details_id(node: Column, s2: Column, openalex: Column, own: Column) -> Column:
    """The id details are asked for by; DOIs are not used."""
    return F.coalesce(present(node), present(s2), present(openalex), own)
