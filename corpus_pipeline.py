"""A corpus pipeline of five stages over `documents`; counted as part of the subpackage pelagia.llm.

Each stage takes the documents that its predecessor left (same columns) and returns a DataFrame that is written
as Parquet and read again. Texts that a stage changes get a new n_chars; texts that it empties go.

1. quality: documents that the quality rules reject go.
2. near_dedup: of each SimHash component the document with the smallest doc_id stays.
3. suffix_dedup: bytes in later copies of 100-byte strings go, on whole characters.
4. decontaminate: words in occurrences of benchmark windows go, with what stands between them.
5. encode: token counts and digests of byte-level BPE ids and of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm import byte_bpe, common, decontaminate, quality_rules, simhash, suffix_dedup


def _renewed(new: DataFrame, columns: list[str]) -> DataFrame:
    """Drops emptied texts and counts characters anew."""
    left = new.filter(F.length(F.trim("text")) > 0)
    if "n_chars" in columns:
        left = left.withColumn("n_chars", F.length("text").cast(new.schema["n_chars"].dataType))
    return left.select(*[f"`{c}`" for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, *quality_rules.train(docs, common.table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _renewed(suffix_dedup.without_repeats(docs), docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _renewed(decontaminate.without_hits(docs, common.table(spark, sf_dir, "benchmark")), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, byte_bpe.default_bpe())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffixes),
    ("decontaminate", benchmark),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    begun = common.made()
    for _, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir))
        common.drop_made(spark, begun, docs)  # the stage's predecessor and its own intermediates
    return docs
