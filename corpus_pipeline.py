"""A corpus pipeline out of the llm operators: quality, toxicity, near duplicates, personal data, packing.

Each stage maps documents to documents (the last one to pieces of packed
sequences); its result is written as Parquet and read again as the next one's
input, so a stage's decisions hold for all that follow and lost executors repeat
one stage at most.

Null and empty texts have too few words and go in the first stage.  Repeated rows and
rows that share an id are one document from the third stage on; rows without an id stay
documents of their own.  Texts of any length are worked on whole.  An empty table gives an
empty result.  Columns beyond those of documents are passed on until packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.jaccard import one_of_each
from tidepool.llm.packing import pack_documents
from tidepool.llm.pii import redact
from tidepool.llm.quality import keep_documents
from tidepool.llm.tables import documents, staged
from tidepool.llm.toxicity import drop_toxic, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model learnt from the labelled ones among them."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of copies and near copies."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their kind; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: The toxicity stage learns a model, which SQL cannot express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
