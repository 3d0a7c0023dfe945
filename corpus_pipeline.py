"""From raw documents to token ids: language, near duplicates, repeated passages, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents; run() writes each result as Parquet in the
shared folder and reads it back, so a lost executor never costs more than a stage.

Every stage but the last returns the columns of its input, extra ones and clashing names included, and takes an empty table.
Repeated rows and ties, null ids, null and empty texts have a defined result in each, named below; texts are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from popshift.llm import bpe, decontam, langid, simhash, suffix_dedup
from popshift.llm.common import read, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: no letter (so null and empty texts, too), or a score below the calibrated
    threshold. Rows without a doc_id and repeated rows are judged by their text. With nothing to learn from all rows go."""
    return langid.accepted(docs, langid.fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; of rows that repeat its id and text one.
    Null, empty and wordless texts are near duplicates of each other; rows without a doc_id stay."""
    return simhash.representatives(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id holds are cut from the text; the document stays, even if nothing is left.
    Rows that repeat a doc_id don't cut each other; rows without one neither cut nor are cut; null texts stay null."""
    return suffix_dedup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none; items without an id or text have
    none; rows without a doc_id and repeated rows are judged by their text."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each text's ids, and the digest of what they decode to: a row a document, repeated rows included;
    null and empty texts have no ids."""
    return bpe.encode(docs, bpe.tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The trained classifier and the fingerprints' hash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
