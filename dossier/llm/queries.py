"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, license_scan, line_dedup, merkle, mixing, packing, quality, sharding, simhash, toxicity, url_filters, warc
from .common import read
from .oracles import ORACLE_SQL  # noqa: F401


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, bad: the pages whose id is labelled; bad if of low quality or toxic.

    The tables hold no labels of urls of their own. Documents and pages are numbered alike, so a label of a number stands
    for both.
    """
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return read(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id").select("url", "bad")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"), labelled_urls(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs).drop("text", "clean_text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), exact_words=1)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = sharding.with_slots(sharding.shuffled(read(spark, sf_dir, "documents").select("doc_id", "text")))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return records.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).drop("payload", "url")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_quality_rules, op3_line_dedup, op4_sharding, op5_toxicity, op6_simhash, op7_packing, op8_decontamination, op9_warc, op10_license_scan,
        op11_mixing, op12_merkle, op13_alignment,
    )
}
