"""Toxicity by non-negative positive-unlabelled learning.

Features of a text are whether it has certain runs of bytes (letters small, all else of ASCII a space), found by their hashes: those
whose share among confirmed toxic texts stands out most from their share among unlabelled texts. A linear model is fitted with
numpy to minimise the sigmoid-loss risk of a classifier that sees positive and unlabelled texts only: prior * R+(positive), plus the
risk of unlabelled texts taken as negative less the share that positives among them explain, which may not fall below zero.

Positives are a bounded sample of the labelled rows outside the held-out fold, those with the smallest digests; the class prior is the
share of toxic rows among the labelled ones there unless it is given. Unlabelled texts are all texts outside the fold: features are
chosen by their counts over all of them, and after a start on a bounded sample the model takes steps along the gradient of the risk
over all of them, summed by Spark. Every text is scored whole.

Defined results: null texts are empty; empty texts get the score of no feature; a text that is labelled more than once is toxic if
any row says so; without a positive every score is 0; an empty table gives an empty result; extra columns are ignored.
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
class Toxicity:
    """Bytes of the runs, buckets of their hashes, features kept, most positive texts, unlabelled texts of the start, least positive texts with a feature, class prior, the optimiser's steps on the start, and its steps over all texts with their rate."""

    sizes: tuple[int, ...] = (5, 7)
    buckets: int = 1 << 20
    features: int = 1024
    positives: int = 6000
    start: int = 12000
    least_texts: int = 4
    prior: float | None = None
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    passes: int = 8
    pass_rate: float = 0.01


def grams(col: pa.Array, p: Toxicity) -> tuple[np.ndarray, np.ndarray, int]:
    """Text and bucket of each run, repeats included."""
    data, offs = tv.utf8(col)
    data = tv.PLAIN[data]
    found = [tv.byte_ngrams(data, offs, k) for k in p.sizes]
    return np.concatenate([d for d, _ in found]), (np.concatenate([h for _, h in found]) % tv.U(p.buckets)).astype(np.int64), len(offs) - 1


def once(doc: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted by text."""
    key = np.unique(doc * n + feature)
    return key // n, key % n


def once_a_text(doc: np.ndarray, bucket: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of texts and buckets in order of texts, without a sort of the buckets: of equal ones in a text the last written holds the place."""
    order = np.argsort(doc, kind="stable")
    bucket, ends = bucket[order], np.cumsum(np.bincount(doc, minlength=n))
    place, number, keep = np.zeros(buckets, np.int32), np.arange(len(bucket), dtype=np.int32), np.zeros(len(bucket), bool)
    start = 0
    for end in ends.tolist():
        own = bucket[start:end]
        place[own] = number[start:end]
        keep[start:end] = place[own] == number[start:end]
        start = end
    return doc[order][keep], bucket[keep]


def gram_counts(sample: DataFrame, p: Toxicity) -> DataFrame:
    """(bucket, pos, unl): texts of either kind that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, p.buckets), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, bucket = once_a_text(*grams(part.column(1), p), p.buckets)
                for j in (0, 1):
                    counts[j] += np.bincount(bucket[part.column(2 + j).to_numpy(zero_copy_only=False)[doc]], minlength=p.buckets)
        some = np.flatnonzero(counts[0] + counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "pos", "unl"])

    return sample.mapInArrow(run, "bucket int, pos long, unl long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))


def fit_nnpu(doc_p: np.ndarray, feat_p: np.ndarray, n_p: int, doc_u: np.ndarray, feat_u: np.ndarray, n_u: int, n_features: int, prior: float, p: Toxicity) -> tuple[np.ndarray, float]:
    """Weights and bias. Where the corrected negative risk is below zero, the step undoes it instead of following the sum."""
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, p.steps + 1):
        zp, zu = np.bincount(doc_p, w[feat_p], n_p) + b, np.bincount(doc_u, w[feat_u], n_u) + b
        sp, su = sigmoid(zp), sigmoid(zu)
        dp, du = sp * (1 - sp), su * (1 - su)
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            gp, gu = -prior * 2 * dp / n_p, du / n_u
        else:
            gp, gu = prior * dp / n_p, -du / n_u
        g = np.append(np.bincount(feat_p, gp[doc_p], n_features) + np.bincount(feat_u, gu[doc_u], n_features) + p.decay * w / n_features, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def unlabelled_sums(rows: DataFrame, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
    """Over all unlabelled rows of (unl, features): the sum of the model's sigmoid, and of its derivatives by weights and bias."""
    model = rows.sparkSession.sparkContext.broadcast((w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        total = np.zeros(len(w) + 2)
        for batch in batches:
            col = batch.column(0)
            feature, n = col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())
            doc = np.repeat(np.arange(len(n)), n)
            s = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[feature], len(n)) + b, -30, 30)))
            d = s * (1 - s)
            total += np.concatenate([np.bincount(feature, d[doc], len(w)), [d.sum(), s.sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    found = rows.where("unl").select("features").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row a weight
    model.destroy()
    total = np.zeros(len(w) + 2)
    for r in found:
        total[r["i"]] = r["x"]
    return float(total[-1]), total[:-1]


def refine(rows: DataFrame, n_u: int, doc_p: np.ndarray, feat_p: np.ndarray, n_p: int, w: np.ndarray, b: float, prior: float, p: Toxicity) -> tuple[np.ndarray, float]:
    """Steps along the gradient of the non-negative risk over all unlabelled rows."""
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, p.passes + 1):
        sp = 1 / (1 + np.exp(-np.clip(np.bincount(doc_p, w[feat_p], n_p) + b, -30, 30)))
        dp = sp * (1 - sp)
        su, gu = unlabelled_sums(rows, w, b)
        gp = np.append(np.bincount(feat_p, dp[doc_p], len(w)), dp.sum()) / n_p
        g = gu / n_u - 2 * prior * gp if su / n_u >= prior * sp.mean() else prior * gp - gu / n_u
        g[:-1] += p.decay * w / len(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = p.pass_rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, p: Toxicity) -> tuple[DataFrame, np.ndarray, float] | None:
    """Written rows (id, held_out, pos, unl, start, features) of all texts, with weights and bias, from (id, text, held_out) and (id, toxic, held_out)."""
    seen = labels.where(~F.col("held_out")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    total, toxic = seen.agg(F.count("toxic"), F.sum("toxic")).first()
    if not toxic:
        return None
    ids = seen.where("toxic = 1").select("id").orderBy(F.xxhash64("id"), "id").limit(p.positives).withColumn("pos", F.lit(True))
    marked = docs.join(F.broadcast(ids), "id", "left").select("id", "text", "held_out", F.coalesce("pos", F.lit(False)).alias("pos"), (~F.col("held_out")).alias("unl"))
    counts = cut(gram_counts(marked.where("unl").select("id", "text", "pos", "unl"), p), "grams")
    n_p, n_u = marked.agg(F.count_if("pos"), F.count_if("unl")).first()
    if not n_p or not n_u:
        return None
    share = lambda c, n: (F.col(c) + 0.5) / F.lit(n + 1.0)
    gap = share("pos", n_p) - share("unl", n_u)
    spread = F.sqrt(share("pos", n_p) * (1 - share("pos", n_p)) / n_p + share("unl", n_u) * (1 - share("unl", n_u)) / n_u + 1e-12)
    best = counts.where(F.col("pos") >= p.least_texts).orderBy(F.desc(F.abs(gap / spread)), "bucket").limit(p.features).select("bucket").collect()
    buckets = np.sort(np.array([r[0] for r in best], np.int64))
    if not len(buckets):
        return None

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, feature, n = features(part.column(1), buckets, p)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), tv.lists(feature, np.searchsorted(doc, np.arange(n + 1)), pa.int32())], ["id", "held_out", "pos", "unl", "features"])

    rows = cut(marked.mapInArrow(by_chunk(make, "text"), "id long, held_out boolean, pos boolean, unl boolean, features array<int>"), "features")
    positive = rows.where("pos").select("features")
    start = rows.where("unl").orderBy(F.xxhash64("id"), "id").limit(p.start).select("features")
    sides = []
    for side in (positive, start):
        bags = side.toPandas()["features"].tolist()  # at most positives rows, or start rows
        sides += [np.repeat(np.arange(len(bags)), [len(x) for x in bags]), np.concatenate([*map(np.asarray, bags), np.zeros(0, np.int64)]).astype(np.int64), len(bags)]
    prior = p.prior or toxic / total
    w, b = fit_nnpu(*sides, len(buckets), prior, p)
    return rows, *refine(rows, n_u, *sides[:3], w, b, prior, p)


def features(col: pa.Array, buckets: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray, int]:
    """Text and number of each feature that it has, sorted by text."""
    doc, bucket, n = grams(col, p)
    known = np.zeros(p.buckets, bool)
    known[buckets] = True
    hit = known[bucket]
    return *once(doc[hit], np.searchsorted(buckets, bucket[hit]), len(buckets)), n


def score(docs: DataFrame, labels: DataFrame, held_out, p: Toxicity | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score) of each row. held_out: a function of an id column, true for rows whose labels are never read."""
    p = p or Toxicity()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    model = train(texts, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic"), held_out(F.col(id_col)).alias("held_out")), p)
    if model is None:
        return texts.select("id", "held_out", F.lit(0.0).alias("score"))
    rows, w, b = model

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            n = np.diff(col.offsets.to_numpy())
            z = np.bincount(np.repeat(np.arange(len(n)), n), w[col.flatten().to_numpy()], len(n)) + b
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "held_out", "score"])

    return rows.select("id", "held_out", "features").mapInArrow(make, "id long, held_out boolean, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """The score of each document; the fold with crc32 of the id in text divisible by 5 is held out."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = score(read("documents"), read("labels"), lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
