"""A pipeline over documents: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Defined results: null texts count as empty, and go with the quality rules like other texts of too few words; a null id or language is
one like others; rows equal in id and text are one document from near-dedup on; ties go as each operator says; an empty table gives
empty tables; columns beside doc_id, text and lang are carried, n_chars anew where lines went. Counted as part of gramframe.llm, without
which it cannot be imported.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramframe.llm import decontam, line_dedup, near_dup, packing, quality
from gramframe.llm.common import shared_dir, text_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Short clean documents are of use here: five words are enough, and distances count from the operator's own least lengths."""
    return quality.filter(docs, quality.Quality(base_words=5))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came earlier; those of which no word is left go, as an earlier document has all they say."""
    left = line_dedup.dedup_lines(docs)
    gone = (F.col("n_dropped_lines") > 0) & ~F.col("text").rlike(line_dedup.WORD)
    changed = left.where(~F.coalesce(gone, F.lit(False)))
    return changed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    bad = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("id").alias("bad_id"), F.col("node").alias("bad_node")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("bad_id")) & (text_key(docs["text"]) == F.col("bad_node")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: Edit distance, signatures and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
