"""The corpus pipeline: from web documents to packed training sequences.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import staged
from tidebar.llm.decontaminate import decontaminate
from tidebar.llm.minhash import near_duplicates
from tidebar.llm.packing import pack
from tidebar.llm.quality import classify
from tidebar.llm.substring_dedup import substring_dedup

#: SQL cannot express the classifier and the signatures; tests hold the pipeline against brute force.
ORACLE_SQL = None


#: Documents in a batch between Spark and Python: a few MB, so that executors keep their memory for the work.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels).filter("predicted = 1").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; documents without an id stay."""
    _small_batches(spark)
    groups = near_duplicates(docs)
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return kept.filter("doc_id is null").union(kept.filter("doc_id is not null").dropDuplicates(["doc_id"])) if repeated else kept


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words that occur elsewhere too; a text without such passages stays as it is."""
    _small_batches(spark)
    out = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns({"n_chars": n_chars, "text": text}).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, benchmark).filter(~F.col("contaminated")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    _small_batches(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("minhash near-dedup", one_of_each_group),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
