"""Sizes, colours, metrics and drawing coordinates of papers and network nodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Colours of the root, of levels 1 to 3, of deeper levels, of incomplete nodes, of clusters.
ROOT, LEVELS, DEEPER, INCOMPLETE = "#ff6b35", ("#059669", "#7c3aed", "#dc2626"), "#6b7280", "#94a3b8"
CLUSTERS = ("#1e3a8a", "#dc2626", "#059669", "#7c3aed", "#ea580c", "#0891b2", "#be185d")


def citation_node_size(citations: Column) -> Column:
    return F.greatest(F.lit(15.0), F.log10(F.coalesce(citations, F.lit(0)) + 1) * 12)


def rank_node_size(rank: Column) -> Column:
    return F.greatest(F.lit(15.0), rank * 1000)


def estimated_h_index(n_authors: Column) -> Column:
    """A proxy from the number of authors only."""
    return F.coalesce(F.least(F.lit(10), F.floor(F.log10(n_authors + 1) * 5).cast("int")), F.lit(0))


def citations_per_year(citations: Column, year: Column, as_of_year: int) -> Column:
    """Citations by years since publication, to two places, half up; 0 where either is missing."""
    age = F.lit(as_of_year) - year
    ratio = F.round(citations.cast("decimal(20,0)") / age.cast("decimal(10,0)"), 2).cast("double")
    known = (F.coalesce(citations, F.lit(0)) != 0) & (F.coalesce(year, F.lit(0)) != 0) & (age > 0)
    return F.when(known, ratio).otherwise(0.0)


def depth_color(depth: Column, is_root: Column, basic: Column | None = None) -> Column:
    out = F.when(is_root, ROOT)
    if basic is not None:
        out = out.when(basic, INCOMPLETE)
    for k, colour in enumerate(LEVELS):
        out = out.when(depth == k + 1, colour)
    return out.otherwise(DEEPER)


def cluster_color(cluster: Column, is_root: Column) -> Column:
    palette = F.array(*map(F.lit, CLUSTERS))
    return F.when(is_root, ROOT).otherwise(F.element_at(palette, (cluster % len(CLUSTERS) + 1).cast("int")))


def layout_export(nodes: DataFrame, width: float = 800, height: float = 600) -> DataFrame:
    """(root_id, id, x, y, radius): a circle per network in node order, the root near the centre.

    One window by network; a network has at most its node cap.
    """
    i = F.row_number().over(Window.partitionBy("root_id").orderBy("node_seq")) - 1
    n = F.count("*").over(Window.partitionBy("root_id"))
    return placed(nodes.withColumn("i", i).withColumn("n", n), width, height)


def placed(nodes: DataFrame, width: float = 800, height: float = 600) -> DataFrame:
    """(root_id, id, x, y, radius) of nodes with their place ``i`` in a network of ``n``."""
    angle = F.col("i") / F.col("n") * 2 * math.pi
    away = F.when(F.col("is_root"), F.lit(50)).otherwise(150 + F.col("i") % 3 * 100)
    size = F.least(F.lit(40.0), F.greatest(F.lit(15.0), F.col("size")))
    return nodes.select("root_id", "id", (width / 2 + F.cos(angle) * away).alias("x"), (height / 2 + F.sin(angle) * away).alias("y"), size.alias("radius"))
