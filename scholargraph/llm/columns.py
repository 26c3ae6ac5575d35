"""Tables with columns of any names: an operator works on numbered names and gives the caller's back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ... in order; an operator's own names start with an underscore and so never clash."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The numbered name of a column of ``docs``."""
    return f"c{docs.columns.index(name)}"


def named(docs: DataFrame, instead: dict[str, Column] | None = None) -> list[Column]:
    """Columns that give a numbered table the names of ``docs`` back; ``instead`` has other values for some."""
    return [(instead or {}).get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)]
