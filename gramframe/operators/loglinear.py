"""Log-linear models over (word, context feature) pairs: scores, partition functions, objectives and gradients.

pairs: (ctx, word_id, n): how often a word of the vocabulary follows a context. contexts: (ctx, fid): the feature ids of each
distinct context. theta: a Column of the parameter of a product id. The partition function is computed once a distinct context.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramframe.functions import text as X
from gramframe.operators.correlation import BUCKETS, Scores
from gramframe.sources.stage import cut

#: Words that a broadcast vocabulary may have, and contexts that one task scores against it.
MOST_WORDS, CONTEXTS_A_TASK = 1_000_000, 250_000


def theta_of(pid: Column) -> Column:
    """Fixed parameters for queries and tests."""
    return (F.pmod(pid * 37, F.lit(101)) - 50).cast("double") / F.lit(500).cast("double")


def pid_of(word: str = "word_id", feature: str = "fid") -> Column:
    return X.product_id(F.col(word), F.col(feature), BUCKETS)


def bags(contexts: DataFrame) -> DataFrame:
    """(ctx, fids): a row a context."""
    return contexts.groupBy("ctx").agg(F.sort_array(F.collect_list("fid")).alias("fids"))


def score_of(word: Column, fids: Column, theta=theta_of) -> Column:
    """The parameters of a word with each of a context's features, summed."""
    return F.aggregate(F.transform(fids, lambda f: theta(X.product_id(word, f, BUCKETS))), F.lit(0.0), lambda s, x: s + x)


def scores(rows: DataFrame, contexts: DataFrame, theta=theta_of) -> DataFrame:
    """rows (ctx, word_id, ...) with score."""
    return rows.join(bags(contexts), "ctx").withColumn("score", score_of(F.col("word_id"), F.col("fids"), theta)).drop("fids")


def word_ids(vocab: DataFrame) -> np.ndarray:
    """The ids of the whole vocabulary, for the driver and each task. Refuses vocabularies that have not been cut."""
    n = vocab.count()
    if n > MOST_WORDS:
        raise ValueError(f"{n} words; cut the vocabulary to {MOST_WORDS} first")
    return np.sort(vocab.select(F.col("word_id").cast("long").alias("word_id")).toArrow()["word_id"].to_numpy())


def log_sum_exp(scores: Column) -> Column:
    """The log of the sum of exp over an array, in one pass with the largest score so far and the sum relative to it."""
    step = lambda a, x: F.struct(F.greatest(a["top"], x).alias("top"), (a["sum"] * F.exp(a["top"] - F.greatest(a["top"], x)) + F.exp(x - F.greatest(a["top"], x))).alias("sum"))
    return F.aggregate(scores, F.struct(F.lit(-1e300).alias("top"), F.lit(0.0).alias("sum")), step, lambda a: a["top"] + F.ln(a["sum"]))


def theta_array(spark: SparkSession, theta=theta_of) -> np.ndarray:
    """The parameters of all buckets."""
    found = spark.range(BUCKETS).select("id", theta(F.col("id")).cast("double").alias("theta")).toArrow()
    out = np.zeros(BUCKETS)
    out[found["id"].to_numpy()] = found["theta"].to_numpy()
    return out


def dealt(contexts: DataFrame, n: int) -> DataFrame:
    """n contexts, dealt to all cores, or to more tasks where a task would get too many."""
    return contexts.repartition(max(contexts.sparkSession.sparkContext.defaultParallelism, -(-n // CONTEXTS_A_TASK)))


def log_partition(contexts: DataFrame, vocab: DataFrame, theta=theta_of) -> DataFrame:
    """(ctx, fids, logz), written, as several sums need it; no rows without words. Contexts are dealt to tasks and meet parameters and
    vocabulary there, so nothing of the size of both is made."""
    spark = contexts.sparkSession
    each = cut(bags(contexts), "contexts")
    model = spark.sparkContext.broadcast((theta_array(spark, theta), word_ids(vocab)))

    def run(batches):
        batches = list(batches)
        if batches and len(model.value[1]):
            rows = pa.Table.from_batches(batches)
            z = Scores(*model.value).log_z(rows["fids"].to_pylist())
            yield from rows.append_column("logz", pa.array(z)).to_batches(max_chunksize=10_000)

    out = cut(dealt(each, each.count()).mapInArrow(run, each.select("*", F.lit(0.0).alias("logz")).schema), "logz")
    model.destroy()
    return out


def softmax_logprob(pairs: DataFrame, contexts: DataFrame, vocab: DataFrame, theta=theta_of) -> DataFrame:
    z = log_partition(contexts, vocab, theta)
    scored = pairs.join(z, "ctx").withColumn("score", score_of(F.col("word_id"), F.col("fids"), theta)).drop("fids")
    return scored.withColumn("log_prob", F.col("score") - F.col("logz"))


def self_normalized(pairs: DataFrame, contexts: DataFrame, vocab: DataFrame, strength: float, theta=theta_of) -> DataFrame:
    """One row: the objective, sum of score - log Z - strength / 2 (log Z)^2. Strength 0 is the exact objective."""
    s = softmax_logprob(pairs, contexts, vocab, theta)
    return s.agg(F.sum(F.col("n") * (F.col("log_prob") - F.lit(strength / 2) * F.col("logz") * F.col("logz"))).alias("objective"), F.sum("n").cast("long").alias("n"))


def gradient_of(weighted: DataFrame, contexts: DataFrame) -> DataFrame:
    """(pid, g): the weights of (ctx, word_id, w) summed over the parameters that each score has."""
    return weighted.groupBy("ctx", "word_id").agg(F.sum("w").alias("w")).join(contexts, "ctx").groupBy(pid_of().alias("pid")).agg(F.sum("w").alias("g"))


def data_gradient(pairs: DataFrame, bagged: DataFrame) -> DataFrame:
    """(pid, g) of the scores of pairs (ctx, word_id, n); bagged: (ctx, fids)."""
    each = pairs.join(bagged, "ctx").select("word_id", F.col("n").cast("double").alias("n"), F.explode("fids").alias("fid"))
    return each.groupBy(pid_of().alias("pid")).agg(F.sum("n").alias("g"))


def model_gradient(seen: DataFrame, theta: np.ndarray, words: np.ndarray, strength: float) -> DataFrame:
    """(pid, g) of -m (log Z + strength / 2 (log Z)^2) over seen (fids, m), a context a row, by tasks; their sum of that value has the pid -1."""
    model = seen.sparkSession.sparkContext.broadcast((theta, words))

    def run(batches):
        batches = list(batches)
        if batches and len(model.value[1]):
            rows = pa.Table.from_batches(batches)
            value, grad, met = Scores(*model.value).model(rows["fids"].to_pylist(), rows["m"].to_numpy(), strength)
            some = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(grad[some], value))], ["pid", "g"])

    return seen.select("fids", F.col("m").cast("double").alias("m")).mapInArrow(run, "pid long, g double")


def seen_contexts(pairs: DataFrame, bagged: DataFrame) -> DataFrame:
    """(fids, m), written and dealt: how often each context is seen."""
    seen = cut(pairs.groupBy("ctx").agg(F.sum("n").alias("m")).join(bagged, "ctx").select("fids", "m"), "seen")
    return dealt(seen, seen.count())


def self_normalized_gradient(pairs: DataFrame, contexts: DataFrame, vocab: DataFrame, strength: float, theta=theta_of) -> DataFrame:
    """(pid, g) of that objective. The model's part is summed by parameter in each task."""
    spark, bagged = pairs.sparkSession, cut(bags(contexts), "contexts")
    model = model_gradient(seen_contexts(pairs, bagged), theta_array(spark, theta), word_ids(vocab), strength).where("pid >= 0")
    return data_gradient(pairs, bagged).unionByName(model).groupBy("pid").agg(F.sum("g").alias("g"))


def nce_terms(pairs: DataFrame, noise: DataFrame, contexts: DataFrame, vocab: DataFrame, k: int, theta=theta_of) -> DataFrame:
    """(ctx, word_id, n, is_data, logit) of data and noise. noise: (ctx, word_id, j, noise_id); vocab: (word_id, q) with the noise distribution."""
    data = pairs.select("ctx", "word_id", "n", F.lit(True).alias("is_data"))
    drawn = noise.join(pairs, ["ctx", "word_id"]).select("ctx", F.col("noise_id").alias("word_id"), "n", F.lit(False).alias("is_data"))
    both = scores(data.unionByName(drawn), contexts, theta).join(vocab, "word_id")
    return both.select("ctx", "word_id", "n", "is_data", (F.col("score") - F.ln(F.lit(float(k))) - F.ln("q")).alias("logit"))


def nce(pairs: DataFrame, noise: DataFrame, contexts: DataFrame, vocab: DataFrame, k: int, theta=theta_of) -> DataFrame:
    """One row: the noise-contrastive objective."""
    sign = F.when(F.col("is_data"), -1.0).otherwise(1.0)
    return nce_terms(pairs, noise, contexts, vocab, k, theta).agg(F.sum(-F.col("n") * X.softplus(sign * F.col("logit"))).alias("objective"))


def nce_gradient(pairs: DataFrame, noise: DataFrame, contexts: DataFrame, vocab: DataFrame, k: int, theta=theta_of) -> DataFrame:
    """(pid, g): data weigh 1 - p, noise -p, p the probability of being data."""
    p = X.sigmoid(F.col("logit"))
    terms = nce_terms(pairs, noise, contexts, vocab, k, theta)
    return gradient_of(terms.select("ctx", "word_id", (F.col("n") * (F.when(F.col("is_data"), 1.0).otherwise(0.0) - p)).alias("w")), contexts)


def candidates(pairs: DataFrame, noise: DataFrame) -> DataFrame:
    """(ctx, of, word_id, n, is_data): each pair's own word and its noise."""
    own = pairs.select("ctx", F.col("word_id").alias("of"), "word_id", "n", F.lit(True).alias("is_data"))
    drawn = noise.join(pairs, ["ctx", "word_id"]).select("ctx", F.col("word_id").alias("of"), F.col("noise_id").alias("word_id"), "n", F.lit(False).alias("is_data"))
    return own.unionByName(drawn)


def sampled_objective(scored: DataFrame) -> DataFrame:
    """One row, of candidates with score: the word's score less the log of the sum of exp over it and its noise."""
    each = scored.groupBy("ctx", "of").agg(F.max(F.when(F.col("is_data"), F.col("score"))).alias("own"), F.max("n").alias("n"), F.sum(F.exp("score")).alias("z"))
    return each.agg(F.sum(F.col("n") * (F.col("own") - F.ln("z"))).alias("objective"))


def sampled_weights(scored: DataFrame) -> DataFrame:
    """candidates with w, the derivative of that objective by their score."""
    z = scored.groupBy("ctx", "of").agg(F.sum(F.exp("score")).alias("z"))
    return scored.join(z, ["ctx", "of"]).withColumn("w", F.col("n") * (F.when(F.col("is_data"), 1.0).otherwise(0.0) - F.exp("score") / F.col("z")))


def sampled_softmax(pairs: DataFrame, noise: DataFrame, contexts: DataFrame, theta=theta_of) -> DataFrame:
    return sampled_objective(scores(candidates(pairs, noise), contexts, theta))


def sampled_softmax_gradient(pairs: DataFrame, noise: DataFrame, contexts: DataFrame, theta=theta_of) -> DataFrame:
    """(pid, g) of it."""
    return gradient_of(sampled_weights(scores(candidates(pairs, noise), contexts, theta)).select("ctx", "word_id", "w"), contexts)


def low_rank_sums(rows: DataFrame, contexts: DataFrame, rank: int, theta=theta_of) -> DataFrame:
    """rows (ctx, word_id, ...) with fids, x (the sum of the active features' vectors, `rank` parameters each) and score, its squared length."""

    def one(k: int) -> Column:
        return F.aggregate(F.transform("fids", lambda f: theta(X.product_id(F.col("word_id"), f, BUCKETS) * rank + k)), F.lit(0.0), lambda s, v: s + v)

    x = F.array(*map(one, range(rank)))
    return rows.join(bags(contexts), "ctx").withColumn("x", x).withColumn("score", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))


def low_rank_scores(pairs: DataFrame, contexts: DataFrame, rank: int, theta=theta_of) -> DataFrame:
    return low_rank_sums(pairs, contexts, rank, theta).select("ctx", "word_id", "score")


def low_rank(pairs: DataFrame, noise: DataFrame, contexts: DataFrame, rank: int, theta=theta_of) -> DataFrame:
    """One row: the sampled objective with those scores."""
    return sampled_objective(low_rank_sums(candidates(pairs, noise), contexts, rank, theta))


def low_rank_gradient(pairs: DataFrame, noise: DataFrame, contexts: DataFrame, rank: int, theta=theta_of) -> DataFrame:
    """(pid, g): pid is a feature's times the rank plus the dimension; a score's derivative by each active vector is twice the sum."""
    w = sampled_weights(low_rank_sums(candidates(pairs, noise), contexts, rank, theta))
    parts = w.select("word_id", "w", F.explode("fids").alias("fid"), "x").select(pid_of().alias("p"), "w", F.posexplode("x").alias("k", "v"))
    return parts.groupBy((F.col("p") * rank + F.col("k")).alias("pid")).agg(F.sum(2 * F.col("w") * F.col("v")).alias("g"))


def num_params(features: int, rank: int = 1) -> int:
    return features * rank


def decisions(codes: DataFrame) -> DataFrame:
    """(word_id, sign, node): a row for each code suffix that is not empty; codes run from leaf to root, node is the rest of the suffix."""
    return codes.select("word_id", F.explode(X.code_suffixes(F.col("code"))).alias("s")).select("word_id", X.bit_sign(F.substring("s", 1, 1)).alias("sign"), F.expr("substring(s, 2)").alias("node"))


def hierarchical_terms(pairs: DataFrame, contexts: DataFrame, codes: DataFrame, nodes: DataFrame, theta=theta_of, const: bool = True) -> DataFrame:
    """(ctx, word_id, n, node_id, sign, dot): dot sums a node's parameters, and those of the node 0 of all decisions, over the context's features."""
    dec = decisions(codes).join(nodes, "node").select("word_id", "sign", "node_id")
    asked = pairs.join(dec, "word_id")
    dot = score_of(F.col("node_id"), F.col("fids"), theta)
    return asked.join(bags(contexts), "ctx").withColumn("dot", dot + score_of(F.lit(0), F.col("fids"), theta) if const else dot).drop("fids")


def hierarchical_scores(pairs: DataFrame, contexts: DataFrame, codes: DataFrame, nodes: DataFrame, theta=theta_of) -> DataFrame:
    """(ctx, word_id, log_prob): the sum of -log(1 + exp(sign * dot)) over decisions."""
    t = hierarchical_terms(pairs, contexts, codes, nodes, theta)
    return t.groupBy("ctx", "word_id").agg(F.sum(-X.softplus(F.col("sign") * F.col("dot"))).alias("log_prob"))


def hierarchical_objective(pairs: DataFrame, contexts: DataFrame, codes: DataFrame, nodes: DataFrame, theta=theta_of, const: bool = True) -> DataFrame:
    """One row: the log-likelihood of words that have a code."""
    t = hierarchical_terms(pairs, contexts, codes, nodes, theta, const)
    return t.agg(F.sum(-F.col("n") * X.softplus(F.col("sign") * F.col("dot"))).alias("objective"))


def hierarchical_gradient(pairs: DataFrame, contexts: DataFrame, codes: DataFrame, nodes: DataFrame, theta=theta_of, const: bool = True) -> DataFrame:
    """(pid, g) of the log-likelihood; without const there is no node of all decisions."""
    t = hierarchical_terms(pairs, contexts, codes, nodes, theta, const).select("ctx", "node_id", (-F.col("n") * F.col("sign") * X.sigmoid(F.col("sign") * F.col("dot"))).alias("w")).groupBy("ctx", "node_id").agg(F.sum("w").alias("w"))
    both = t.unionByName(t.groupBy("ctx").agg(F.sum("w").alias("w")).withColumn("node_id", F.lit(0).cast("long"))) if const else t
    return both.join(contexts, "ctx").groupBy(pid_of("node_id").alias("pid")).agg(F.sum("w").alias("g"))
