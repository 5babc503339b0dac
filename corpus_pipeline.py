"""From raw documents to training sequences.

Quality rules, line deduplication, near-duplicate removal, benchmark decontamination,
packing. Each stage reads what the one before kept, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from shelfmark.scratch import cut
from shelfmark.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go.

    Rows are judged alone: null and repeated ids make no difference, null and empty texts
    go for their few words, an empty table stays one. Other columns than those of
    ``documents`` are left behind, here as in every stage.
    """
    return quality_rules.keep_good(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every row stays, and its n_chars follows its text.

    A page that is boilerplate as a whole keeps its text: such pages are copies of each
    other, of which the next stage keeps one. Null sources are one source; null texts stay
    null with a null n_chars; repeated rows each count as a page; an empty table stays one.
    """
    out = line_dedup.drop_lines(docs.select(*COLUMNS), keep_copied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates exactly one row stays, the one with the least id (null ids come last).

    Rows are told apart by id and text, so null and repeated ids lose no row and spare
    none; of rows equal in both, one stays. Rows without words are in no class and all stay.
    """
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows are judged alone, by their own text: null and repeated ids make no difference,
    null and empty texts stay, an empty benchmark or table drops nothing.
    """
    return decontaminate.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in training sequences; every row has its pieces, one with a null text too."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", sequences),
]

#: Rolling n-gram coverage, alignment within an edit budget and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
