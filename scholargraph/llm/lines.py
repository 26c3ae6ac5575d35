"""Removal of lines that many sites share, by HyperLogLog sketches of each line's sites.

1. Every line of enough words is keyed by 128 bits of hash. One aggregate with map-side combine makes a
   sketch of the sites of each key and finds the key's first place.
2. Keys whose estimate is clear of the threshold are decided by it; keys near it get an exact distinct
   count.
3. All places of a boilerplate line but the first are removed.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholargraph.llm.columns import named, numbered, place
from scholargraph.plans.cutpoints import maybe_broadcast, written

#: Places of boilerplate that may be sent to every executor; beyond it the texts are shuffled to meet them.
DROP_PLACES = 300_000


#: Sites that make a line boilerplate, by default. Ten words and more don't coincide by chance: in the given
#: table copies of whole documents take such lines to 4 sites at most, and a passage of 19 documents still
#: reaches 8 where a third of all documents are of one source. Shorter lines do coincide and need more.
LONG_WORDS, LONG_SITES, SHORT_SITES = 10, 5, 10


def _words(n: int) -> str:
    """A pattern of at least ``n`` words."""
    return r"([^ \t-\r]+[ \t-\r]+){%d}[^ \t-\r]" % (n - 1)


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart, also where ids are null or repeat: the id, and a hash of the text."""
    return [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row")]


def line_places(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int, min_sites: int | None = None) -> DataFrame:
    """(id, row, site, pos, k1, k2, need) of the lines that have ``min_words`` words; need is how many sites make it boilerplate."""
    need = F.when(F.col("line").rlike(_words(LONG_WORDS)), LONG_SITES).otherwise(SHORT_SITES) if min_sites is None else F.lit(min_sites)
    lines = docs.select(*_row_key(id_col, text_col), F.col(site_col).alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    return lines.filter(F.col("line").rlike(_words(min_words))).select("id", "row", "site", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("second"), "line").alias("k2"), need.alias("need"))


def _place() -> Column:
    """A line's place; places without an id come last."""
    return F.struct(F.col("id").isNull().alias("z"), "id", "row", "pos")


def line_sketches(places: DataFrame, lg_k: int = 12) -> DataFrame:
    """(k1, k2, sketch, first, need): sketches of sites merge by ``hll_union_agg`` over tables made apart."""
    return places.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(_place()).alias("first"), F.min("need").alias("need"))


def boilerplate_lines(places: DataFrame, margin: float) -> DataFrame:
    """(k1, k2, first) of the lines that at least ``need`` distinct sites hold, exactly."""
    estimated = written(line_sketches(places).withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch").filter(F.col("sites") > F.col("need") * (1 - margin)), "spread")
    sure = F.col("sites") >= F.col("need") * (1 + margin)
    near = estimated.filter(~sure)
    close = maybe_broadcast(near.select("k1", "k2"), near.count())
    exact = places.join(close, ["k1", "k2"], "left_semi").select("k1", "k2", "site", "need").distinct().groupBy("k1", "k2").agg(F.count("site").alias("exact"), F.min("need").alias("need")).filter(F.col("exact") >= F.col("need"))
    return estimated.filter(sure).select("k1", "k2", "first").union(near.join(exact, ["k1", "k2"], "left_semi").select("k1", "k2", "first"))


def clean_lines(docs: DataFrame, min_sites: int | None = None, min_words: int = 3, margin: float = 0.1, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate removed from the text, and n_lines and n_removed (long).

    A line of at least ``min_words`` words that at least ``min_sites`` distinct sites hold is
    boilerplate (by default, 5 sites for lines of ten words and more, 10 for shorter ones); its place with
    the least (id, hash of the text, position) stays, those of null ids last, all others go. Null sites
    count as no site. Rows are told apart by id and text: rows that repeat both lose the same places. A
    null text stays null; a text that loses all its lines is empty. A very long text is one row of many
    lines. Other columns pass through; ``__id``, ``__row`` and ``__drop`` are taken.

    The texts are not shuffled unless there are over ``DROP_PLACES`` places to remove.
    """
    out = _cut_lines(docs, min_sites, min_words, margin, id_col, text_col, site_col)
    kept = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")}
    return out.select(*[(F.col("__cut") if c == text_col else v).alias(c) for c, v in kept.items()], F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def _cut_lines(docs: DataFrame, min_sites: int | None, min_words: int, margin: float, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """The rows of ``docs`` with numbered names, ``__cut`` (the text that is left), ``__n_lines`` and ``__n_removed``."""
    id_, text, site = (place(docs, c) for c in (id_col, text_col, site_col))
    docs = numbered(docs)
    places = written(line_places(docs, id_, text, site, min_words, min_sites), "lines")
    found = written(boilerplate_lines(places, margin), "boilerplate")
    gone = places.join(maybe_broadcast(found, found.count()), ["k1", "k2"]).filter(_place() != F.col("first"))
    drop = written(gone.groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__drop")), "drop")
    drop = maybe_broadcast(drop, drop.agg(F.coalesce(F.sum(F.size("__drop")), F.lit(0))).first()[0], DROP_PLACES)
    joined = docs.join(drop, docs[id_].eqNullSafe(drop["__id"]) & (F.xxhash64(docs[text]) == drop["__row"]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop")
    cut = F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size("__lines")).cast("long")
    with_lines = joined.withColumn("__lines", F.split(F.col(text), "\n", -1))
    return with_lines.select(*docs.columns, cut.alias("__cut"), n_lines.alias("__n_lines"), F.coalesce(F.size(F.col("__drop")).cast("long"), F.lit(0)).alias("__n_removed"))


def remove_boilerplate(docs: DataFrame, min_sites: int | None = None, min_words: int = 3, margin: float = 0.1, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The columns of ``docs`` only, whatever their names, with the text that ``clean_lines`` leaves."""
    return _cut_lines(docs, min_sites, min_words, margin, id_col, text_col, site_col).select(*named(docs, {text_col: F.col("__cut")}))
