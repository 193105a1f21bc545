"""The corpus pipeline: five stages over `documents`, each the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and reread. All but the last return the columns of documents.
A stage begins by letting go what the driver still holds of those before it.

Defined cases, in every stage: an empty table gives an empty one; extra columns go
along up to the last stage, whatever their names. Rows with a null or wordless text
fail the quality rules; a null lang or source is a group of its own; rows with a
null doc_id lose repeated lines, are never grouped as near duplicates and stay;
repeated rows stay repeated up to the near-dedup stage, which keeps or drops all
rows of an id; very long texts go through whole; ties are decided by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe_chunks, decontaminate, line_dedup, minhash, quality
from corvane.llm.scratch import cut, let_go


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rejected documents go."""
    let_go(spark)
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: repeated lines go, n_chars follows the text."""
    let_go(spark)
    done = line_dedup.dedup_lines(docs, keep_names=True)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 on five-word shingles at 0.8: the smallest doc_id of each group stays."""
    let_go(spark)
    return minhash.keep_first(docs, minhash.Rule(5, 80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go."""
    let_go(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ids as little-endian unsigned 32-bit integers, and the digest of what they decode to."""
    let_go(spark)
    done = bpe_chunks.with_ids(docs.select("doc_id", "lang", "source", "text"), decode=True)
    return done.select("doc_id", "lang", "source", "ids", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", minhash_stage),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]

#: Latent retrieval and BPE have no SQL; tests hold each operator against SQL, brute force or the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
