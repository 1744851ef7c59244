"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing to target weights, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, mixing, near, quality
from tidemark.llm.common import shared_dir, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of hashed word n-grams predicts good; the others go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal after lower-casing A-Z, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are alike to 0.8 or more, the one with the smallest doc_id.

    Each pair is verified and none is left out but by one test on fingerprints, which a pair alike
    to 0.8 fails with a probability below 10**-8; a chain of pairs is one group.
    """
    return near.one_of_each(docs, shingle=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weights 3, 1, 2 takes them: not at all, once or twice."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed, unsigned 32 bits, little-endian) and digests of ids and decoded text."""
    path = bpe.vocabulary()
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    out = bpe.bpe_roundtrip(rows, path, "row", "text")
    return out.select("id.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality_filter), ("exact_dedup", drop_exact_copies), ("simhash", drop_near_copies), ("mixing", mix), ("bpe", encode)]

#: The classifiers and shingles have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on all documents, each written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = shared_dir(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
