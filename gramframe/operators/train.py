"""Minibatch training of the self-normalised model. Parameters are hashed to a fixed number of buckets, so that they fit the driver and
each task whatever the corpus; gradients are summed by Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramframe.operators import loglinear
from gramframe.sources.stage import cut, task

@dataclass(frozen=True)
class Training:
    """Groups a batch, steps, AdaGrad's rate, penalty strength, whether it is L1, and strength of the (log Z)^2 penalty."""

    batch_groups: int = 256
    steps: int = 4
    rate: float = 0.5
    l2: float = 0.1
    l1: bool = False
    normalizer: float = 0.1
    seed: int = 1
    monitor_every: int = 10


def _by_bucket(sums: DataFrame) -> np.ndarray:
    """(pid, g) as an array, a place a bucket; the last is that of the pid -1."""
    found, out = sums.groupBy("pid").agg(F.sum("g").alias("g")).toArrow(), np.zeros(loglinear.BUCKETS + 1)  # at most a row a bucket
    out[found["pid"].to_numpy()] = found["g"].to_numpy()
    return out


def _examples(rows: DataFrame, bags: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """Of a batch: how often contexts are seen, the gradient of its scores, and its size."""
    return loglinear.seen_contexts(rows, bags), _by_bucket(loglinear.data_gradient(rows, bags)), rows.agg(F.sum("n")).first()[0]


def sgd(data: DataFrame, contexts: DataFrame, vocab: DataFrame, p: Training, monitor: Callable[[int, float, float], None] | None = None) -> tuple[np.ndarray, list[float]]:
    """data: (group_id, ctx, word_id, n); contexts: (ctx, fid). Returns the parameters by id and each step's mean log-likelihood.

    A step takes batch_groups groups, or all if there are fewer or batch_groups is 0; what a step over all of them needs of the data is
    found once. monitor gets the step, the mean log-likelihood and the perplexity that it stands for, each monitor_every steps."""
    spark = data.sparkSession
    data, bags = cut(data, "examples"), cut(loglinear.bags(contexts), "bags")
    words = loglinear.word_ids(vocab)
    groups = sorted(r[0] for r in data.select("group_id").distinct().collect()) if p.batch_groups else []  # an id a group of lines
    rng, theta, whole = np.random.default_rng(p.seed), np.zeros(loglinear.BUCKETS), None
    seen, history = np.full(loglinear.BUCKETS, 1e-8), []
    for step in range(p.steps):
        with task(spark, f"training step {step}"):
            if p.batch_groups < len(groups):
                batch = sorted(int(g) for g in rng.choice(groups, p.batch_groups, replace=False))
                chosen = spark.createDataFrame([(g,) for g in batch], "group_id long")
                met, gold, n = _examples(data.join(F.broadcast(chosen), "group_id", "left_semi"), bags)
            else:
                met, gold, n = whole = whole or _examples(data, bags)
            model = _by_bucket(loglinear.model_gradient(met, theta, words, p.normalizer))
        ll = float(gold[:-1] @ theta + model[-1])
        grad = (gold + model)[:-1] / n - (0 if p.l1 else p.l2 * theta / n)
        seen += grad**2
        theta = theta + p.rate * grad / np.sqrt(seen)
        if p.l1:
            theta = np.sign(theta) * np.maximum(np.abs(theta) - p.rate * p.l2 / n / np.sqrt(seen), 0)
        history.append(ll / n)
        if monitor and step % p.monitor_every == 0:
            monitor(step, ll / n, float(np.exp(-ll / n)))
    return theta, history


def parameters(spark, theta: np.ndarray) -> DataFrame:
    """(pid, weight) of parameters that are not zero."""
    at = np.flatnonzero(theta)
    return spark.createDataFrame(pa.table({"pid": at, "weight": theta[at]}))


def unnormalized_scores(pairs: DataFrame, contexts: DataFrame, weights: DataFrame) -> DataFrame:
    """pairs (ctx, word_id, ...) with score: the sum of their parameters, without the partition function; parameters that have no weight are zero."""
    each = pairs.select("ctx", "word_id").distinct().join(contexts, "ctx").select("ctx", "word_id", loglinear.pid_of().alias("pid"))
    summed = each.join(weights, "pid", "left").groupBy("ctx", "word_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("score"))
    return pairs.join(summed, ["ctx", "word_id"])
