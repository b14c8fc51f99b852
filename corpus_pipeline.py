"""From raw documents to packed training sequences, in five stages over all that each predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm.common import fresh_path
from quirefold.llm.mixing import mixed_documents
from quirefold.llm.nearcopies import keep_one
from quirefold.llm.packing import pack_documents
from quirefold.llm.passages import cut_passages
from quirefold.llm.resampling import keep_selected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects, with all their columns, whatever those are called.

    A null, empty or very long text is weighed like any other, one without words at 0; rows alike in doc_id and text stay if one of them is drawn; a row without doc_id has no label but may stay. An empty table gives no rows.
    """
    return keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies (Jaccard 0.8 of five-word runs), with all its columns, whatever those are called.

    Texts without words, null ones included, are alike; texts under five words are copies where their words are the same. Of rows alike in doc_id and text one stays.
    A row without doc_id stays only where its group has no other. Very long texts are compared whole. An empty table gives no rows.
    """
    return keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier document, by doc_id, has nearly alike, with all their columns, whatever those are called.

    A document that is such a passage as a whole goes; null and short texts, and rows without doc_id, stay as they are. Rows that repeat a doc_id are cut alike. Very long texts are cut whole. An empty table gives no rows.
    """
    return cut_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix of sources takes, with all their columns, whatever those are called.

    Null, empty and blank texts have no words, so none of them is taken. A null source is a source like any other, rows that repeat one another count each, a row without doc_id comes last in its source. A very long text at
    the budget's end is taken in part. An empty table gives no rows.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; the workers, which other stages use too, remember fewer words, and none of them when a task has ended.

    A null text is an empty one, of one id; a very long text is cut into pieces of sequences; rows that repeat one another, or have no doc_id, are packed each. Other columns go. An empty table gives no rows.
    """
    return pack_documents(docs, remembered=1 << 17, shared=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixing", mixing), ("packing", packing)]

#: The stages hash and iterate in ways that SQL does not express; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
