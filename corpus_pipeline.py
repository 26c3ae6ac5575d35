"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result and reads it again, so that no stage is computed
twice and a lost executor costs its tasks only.

All stages take rows as they come. Extra columns, whatever their names, pass through all but the last
stage. Rows are told apart by id and text, so a null or repeated id never costs another row its text or
its place. An empty table stays empty through all stages. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholargraph.llm import decontamination, lines, packing, simhash, toxicity
from scholargraph.plans.cutpoints import written


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is under 0.5; a model is fitted on a bounded labelled sample.

    Every row has a score: null texts count as empty, rows with null ids are scored like others but teach
    nothing, repeated rows get the same score. Without labels of both kinds the labels' rate is every score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; the first place of each such line stays.

    All rows stay. A null text stays null, one that loses all its lines becomes empty. Null sources count as
    no source; rows with null ids lose their shared lines, too; repeated rows lose the same lines.
    """
    return lines.remove_boilerplate(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Near-duplicates have a similarity of 0.8 or more of their five-word shingles, directly or by way of
    others. Texts without words, null ones too, are copies of each other. A row with a null id stays only if
    no row of its group has one; of rows with the same id the one with the least hash of its text stays.
    """
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, judged row by row.

    A document holds an item if it has 0.8 or more of the item's five-word shingles; an item under five
    words, if it has them in a row. Null and empty texts hold none; null and wordless items are in none.
    """
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Null and empty texts are one piece, the end id; a text over 4,096 ids is cut into as many pieces as it
    needs; null ids and repeated rows are packed like others.
    """
    return packing.pack_documents(docs, _tokenizer(), 4096, 1)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the trained classifier, the fingerprints or the tokenizer; tests/llm compares the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
