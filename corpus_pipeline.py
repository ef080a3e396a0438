"""The corpus pipeline: from raw documents to training batches, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet to the shared folder and rereads as the next one's documents. All but the last
return the columns of documents.

In every stage null ids are ids, null and empty texts are texts without words, texts of
any length are read whole, other columns are passed on whatever their names, and an empty
table stays empty; what becomes of repeated rows each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserel.llm import bpe, minhash, packing, pii, substring
from tesserel.llm import toxicity as toxic
from tesserel.plans import shared


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` again after texts have changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.

    Null, empty and wordless texts stay; repeated rows go or stay together. Without labels
    of both classes all stay.
    """
    return toxic.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, nulls last.

    Of rows repeated exactly one stays; null, empty and wordless texts are duplicates of
    repetitions of their own row only.
    """
    return minhash.deduplicated(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages that repeat across documents, one document keeps each; the others lose it.

    A document of which no word is left goes. Rows repeated exactly count as one document
    and lose the same; null and empty texts stay as they are.
    """
    return _counted(substring.without_repeats(docs))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets, and the terms that give them away, are masked.

    Every row stays; a text without personal data isn't changed, null and empty ones neither;
    repeated rows come out alike.
    """
    return _counted(pii.sanitise(docs))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows are packed into batches of like length; every row has a slot.

    Null and empty texts have length 0; repeated rows have slots each.
    """
    return packing.op4_packing(docs, vocabulary=bpe.VOCABULARY)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("pii", private), ("packing", batches)]

#: The stages are not expressible in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.table(stage(spark, docs, sf_dir), name)
    return docs
