"""Toxicity: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

Features: densities of a lexicon, its nearness to second-person words, capitals, punctuation and
obfuscation. The lexicon is learned, too: words and stems (first letters of longer words) that are much
likelier in toxic texts and occur in a fixed share of them. Near copies count as one text there, so that
a group of copies can't add its own words. Everything is fitted on a bounded sample of labelled rows:
one part for lexicon and trees, another for the calibration.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholargraph.llm.columns import named, numbered, place
from scholargraph.plans.cutpoints import written

#: Most labelled rows that a model is fitted on: those with the least hash of their id.
SAMPLE_ROWS = 20_000
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
#: Signs read as letters in obfuscated words.
READ_AS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
NAMES = (
    "log_words", "lexicon_density", "lexicon_hits", "lexicon_distinct", "lexicon_window", "near_second_person", "second_person_density",
    "capitals", "shouted_words", "exclamations", "marks", "symbols", "digits", "obfuscated_density", "obfuscated_hits", "stretched_density",
)
#: Lengths of stems; a stem is written with a mark before it.
STEMS, MARK = (4, 5), "^"
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_MASKED = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:[0-9@$!*._-][A-Za-z]++)++")  # possessive: linear on long runs of letters
_STRETCHED = re.compile(r"([A-Za-z])\1{3}")


class Listed(dict):
    """Whether a word or one of its stems is in the lexicon; keeps what it has looked up, up to a bound."""

    def __init__(self, lexicon: frozenset[str], most: int = 300_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> bool:
        found = word in self.lexicon or any(MARK + word[:n] in self.lexicon for n in STEMS if len(word) > n)
        if len(self) >= self.most:
            self.clear()
        self[word] = found
        return found


def text_features(text: str, listed: Listed, near: int = 5, window: int = 50) -> list[float]:
    """The features named in NAMES; an empty text has zeros."""
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if listed[w]]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    close = thick = 0
    if hits:
        at, your = np.array(hits), np.array(you or [-(10**9)])
        k = np.searchsorted(your, at)
        gap = np.minimum(np.abs(at - your[np.maximum(k - 1, 0)]), np.abs(at - your[np.minimum(k, len(your) - 1)]))
        close = int((gap <= near).sum())
        thick = int((np.searchsorted(at, at + window) - np.arange(len(at))).max())
    count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    chars = max(1, len(text))
    masked = [w.lower().translate(READ_AS) for w in _MASKED.findall(text)]
    return [
        float(np.log1p(len(words))), len(hits) / n, float(np.log1p(len(hits))), float(len({words[i] for i in hits})), float(thick), close / n, len(you) / n,
        upper / max(1, upper + lower), len(_SHOUT.findall(text)) / n, int(count[33]) / chars, int(count[[44, 46, 58, 59, 63]].sum()) / chars,
        int(count[[35, 36, 37, 38, 42, 60, 62, 124]].sum()) / chars, int(count[48:58].sum()) / chars,
        len(masked) / n, float(sum(listed[w] for w in masked)), len(_STRETCHED.findall(text)) / n,
    ]


def with_features(docs: DataFrame, lexicon: frozenset[str], text_col: str = "text", name: str = "features") -> DataFrame:
    """``docs`` with an array of features; a null text is empty."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType(), False))])
    at = docs.columns.index(text_col)

    def run(batches):
        listed = Listed(lexicon)
        for batch in batches:
            made = [text_features(t.as_py() or "", listed) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def fold(id_col: str = "doc_id") -> Column:
    """0 to 4, from the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 5


@dataclass
class Toxicity:
    """What ``fit`` returns. Without trees (no or one class in the sample) every score is ``rate``."""

    lexicon: frozenset[str]
    trees: Model | None
    calibration: Model | None
    rate: float

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a calibrated score, 0 to 1, as ``name``; all rows, in any state, get one."""
        kept = docs.drop(name)
        back = named(kept)
        if self.trees is None:
            return kept.select("*", F.lit(self.rate).alias(name))
        made = with_features(numbered(kept), self.lexicon, place(kept, text_col), "__features").withColumn("__vector", array_to_vector("__features"))
        raw = self.trees.transform(made).withColumn("__raw", vector_to_array("__probability")[1])
        out = self.calibration.transform(raw)
        return out.select(*back, F.least(F.greatest("__score", F.lit(0.0)), F.lit(1.0)).alias(name))


def learn_lexicon(labelled: DataFrame, least_share: float = 0.03, least_odds: float = 8.0, most: int = 300) -> frozenset[str]:
    """Words and stems in ``least_share`` of the toxic texts of ``labelled`` (text, y) and ``least_odds`` times likelier there.

    Texts with the same least hash of eight-word shingles, as near copies mostly have, count once.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 7, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 8)))
    split = labelled.select("y", words.alias("w")).filter(F.size("w") > 0).select("y", F.array_min(shingles).alias("sig"), "w")
    totals = split.groupBy("y").agg(F.countDistinct("sig").alias("n")).collect()  # two rows
    pos, neg = (float(sum(r.n for r in totals if r.y == y)) for y in (1.0, 0.0))
    stems = [F.when(F.length("w") > n, F.concat(F.lit(MARK), F.substring("w", 1, n))) for n in STEMS]
    each = split.select("y", "sig", F.explode(F.array_distinct("w")).alias("w"))
    entries = each.select("y", "sig", F.explode(F.array_compact(F.array("w", *stems))).alias("e")).distinct()
    counts = entries.groupBy("e").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    odds = (F.col("p") / (pos + 1)) / ((F.col("n") + 1) / (neg + 1))
    chosen = counts.filter((F.col("p") >= max(3, least_share * pos)) & (odds >= least_odds)).orderBy(odds.desc(), "e").limit(most)
    return frozenset(r[0] for r in chosen.select("e").collect())  # at most `most` entries


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", trees: int = 20, depth: int = 3) -> Toxicity:
    """Fits on labelled rows whose fold is not 0. Null ids, labels and unmatched labels take no part; of an id's texts the least does."""
    usable = labels.filter(F.col(label_col).isNotNull() & (fold(id_col) != 0)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y"))
    taken = usable.groupBy("__id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = plain.join(F.broadcast(taken), plain["doc_id"] == F.col("__id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = written(sample.withColumn("fold", fold("doc_id")), "sample")
    learn = sample.filter("fold <> 1")
    size = {(r[0], r[1]): r[2] for r in sample.groupBy(F.col("fold") == 1, "y").count().collect()}  # four rows at most
    pos, neg = size.get((False, 1.0), 0), size.get((False, 0.0), 0)
    rate = (pos + 1) / (pos + neg + 2)
    if not pos or not neg or not any(k[0] for k in size):
        return Toxicity(frozenset(), None, None, rate)
    lexicon = learn_lexicon(learn)
    made = written(with_features(sample, lexicon).drop("text").withColumn("__vector", array_to_vector("features")).coalesce(4), "features")
    grower = GBTClassifier(featuresCol="__vector", labelCol="y", predictionCol="__class", maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=10, seed=7, cacheNodeIds=False)
    grower = grower.setProbabilityCol("__probability").setRawPredictionCol("__margin")
    grown = grower.fit(made.filter("fold <> 1").coalesce(4))
    raw = grown.transform(made.filter("fold = 1")).select("y", vector_to_array("__probability")[1].alias("__raw")).coalesce(1)
    level = IsotonicRegression(featuresCol="__raw", labelCol="y", predictionCol="__score").fit(raw)
    return Toxicity(lexicon, grown, level, rate)


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. A null id counts as not held out."""
    model = fit(docs, labels, sample_rows)
    out = model.score(docs.select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with its columns, whatever their names."""
    return model.score(numbered(docs), place(docs, text_col), "score").filter("score < 0.5").select(*named(docs))
