"""Quality classifier by importance resampling.

Documents and target texts are bags of hashed word unigrams and bigrams. Two generative models, bucket shares among all documents
and among the target, give each document its importance, the ratio of its probability under the target to that under the raw model.
The logarithm of that ratio with Gumbel noise, a function of the document, is its key, and the k largest keys are a sample without
replacement in proportion to the importances. k is given, or the number that rejection sampling would keep on average, which takes a
document with its importance as probability, at most 1.

The raw model counts all documents. The target is a bounded sample of rows labelled good, those with the smallest digests, and starts
from the raw model's shares. Defined results: null texts are empty; texts without a word have no importance (null) and are never
taken; rows equal in id and text share key and fate, so that ties at the last key may give more than k; without labels every ratio is
1; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramframe.llm import textvec as tv
from gramframe.llm.common import by_chunk, chunks, cut


@dataclass(frozen=True)
class Resampling:
    """Buckets of either order, most labelled rows that the target takes, n-grams in the shares of the raw model that it starts from, the documents to take (None: the expected number of rejection sampling), and how many keys are sorted on the driver at most."""

    buckets: int = 1 << 14
    target_rows: int = 20_000
    smoothing: float = 1000.0
    take: int | None = None
    exact_rows: int = 10_000


def bags(col: pa.Array, p: Resampling) -> tuple[np.ndarray, np.ndarray, int]:
    """Text and bucket of each unigram and bigram."""
    data, offs = tv.utf8(col)
    words = tv.Words(data, offs)
    at, pairs = words.ngrams(2)
    m = tv.U(p.buckets)
    return np.concatenate([words.doc, words.doc[at]]), np.concatenate([words.hash % m, pairs % m + m]).astype(np.int64), len(offs) - 1


def bucket_counts(flagged: DataFrame, p: Resampling) -> DataFrame:
    """(bucket, raw, target) over all rows of (text, target); each task gives each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * p.buckets, np.int64), np.zeros(2 * p.buckets, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, bucket, _ = bags(part.column(0), p)
                raw += np.bincount(bucket, minlength=len(raw))
                target += np.bincount(bucket[part.column(1).to_numpy(zero_copy_only=False)[doc]], minlength=len(raw))
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return flagged.select("text", "target").mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, p: Resampling) -> np.ndarray:
    """Of each bucket; as many rows as there are buckets reach the driver."""
    raw, target = np.zeros(2 * p.buckets), np.zeros(2 * p.buckets)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(2 * p.buckets)
    out = []
    for r, t in ((raw[: p.buckets], target[: p.buckets]), (raw[p.buckets :], target[p.buckets :])):
        share = r / max(r.sum(), 1)
        ratio = (t + p.smoothing * share) / np.where(share > 0, share * (t.sum() + p.smoothing), 1)
        out.append(np.log(np.where(share > 0, ratio, 1)))
    return np.concatenate(out)


def scores(texts: DataFrame, ratios: np.ndarray, p: Resampling) -> DataFrame:
    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, bucket, n = bags(part.column(1), p)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.bincount(doc, ratios[bucket], n).astype(np.float64)), pa.array(np.bincount(doc, minlength=n))], ["id", "u", "log_ratio", "n_grams"])

    return texts.select("id", "text", "u").mapInArrow(by_chunk(make, "text"), "id long, u double, log_ratio double, n_grams long")


def least_taken(keys: DataFrame, k: int, exact_rows: int) -> float:
    """The k-th largest key: bins narrow down to few rows, which are then sorted here."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.where(F.col("key").between(low, high))
        width = (high - low) / 4096
        if width == 0 or low + width == low:
            return low
        spot = F.least(F.floor((F.col("key") - low) / width), F.lit(4095)).cast("int")
        found = sorted(((r[0], r[1], r[2], r[3]) for r in inside.groupBy(spot.alias("spot")).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect()), reverse=True)
        for _, n, a, b in found:
            if n >= k:
                break
            k -= n
        if n <= exact_rows:
            return sorted((r[0] for r in keys.where(F.col("key").between(a, b)).select("key").collect()), reverse=True)[k - 1]
        low, high = a, b


def resample(docs: DataFrame, labels: DataFrame, p: Resampling | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, log_ratio, n_grams, gumbel_key, kept) of each row."""
    p = p or Resampling()
    uniform = (F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), uniform.alias("u"))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(p.target_rows)
    flagged = texts.join(F.broadcast(good.withColumn("good", F.lit(True))), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("target"))
    ratios = log_ratios(bucket_counts(flagged, p), p)
    some = F.when(F.col("n_grams") > 0, F.col("log_ratio"))
    keys = cut(scores(texts, ratios, p).withColumn("log_ratio", some).withColumn("key", F.col("log_ratio") - F.log(-F.log("u"))), "keys")
    able = keys.where("key is not null")
    size, expected = able.agg(F.count(F.lit(1)), F.sum(F.exp(F.least("log_ratio", F.lit(0.0))))).first()
    k = min(round(expected or 0) if p.take is None else p.take, size)
    least = least_taken(able, k, p.exact_rows) if k else float("inf")
    return keys.select("id", "log_ratio", "n_grams", F.col("key").alias("gumbel_key"), F.coalesce(F.col("key") >= least, F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """The log ratio, key and fate of each document."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return resample(read("documents"), read("labels")).select(F.col("id").alias("doc_id"), "log_ratio", "n_grams", "gumbel_key", "kept")
