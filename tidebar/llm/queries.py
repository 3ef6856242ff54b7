"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe, collocations, decontaminate, divergence, embedding_dedup, minhash, oracle, packing, page_text, quality, sharding, substring_dedup, url_filter, warc
from tidebar.llm.common import scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = substring_dedup.substring_dedup(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law `bytes`: the slot map is rebalanced by what its slots hold. The map is stored anew for each call."""
    path = f"{scratch(spark)}/slot-map-{uuid.uuid4().hex}"
    out = sharding.shard(table(spark, folder, "documents").select("doc_id", "text"), path)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "virtual_slot", "map_version")


def op4_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, folder, "labels").select("doc_id", "quality"), keep=["doc_id"])


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, folder, "benchmark"), keep=["doc_id"])


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, folder, "pages").select("page_id", "url", "html")))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents").select("lang", "source", "text"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents").select("lang", "text"))


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Texts to ids, ids to texts; what is returned of both is their digests."""
    out = bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Query]:
    found = [
        op1_url_filter, op2_substring_dedup, op3_sharding, op4_page_text, op5_embedding_dedup,
        op6_quality, op7_packing, op8_decontaminate, op9_minhash, op10_warc, op11_source_divergence, op12_collocations, op13_bpe,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
