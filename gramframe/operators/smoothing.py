"""Interpolated trigram and Kneser-Ney models: aggregates that are joined, never looked up row by row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramframe.functions import text as X
from gramframe.operators import counts as N
from gramframe.sources import corpus as C
from gramframe.sources.stage import BROADCAST_ROWS, cut

D = 0.1


def asked_of(grams: DataFrame, rows: int = BROADCAST_ROWS):
    """A function that keeps of a model's counts the rows that can matter to grams, before they are aggregated. The keys that are asked
    for are broadcast if grams, which has to be a written table, is small enough; else both sides are shuffled by them."""
    small = grams.count() <= rows

    def keep(counts: DataFrame, **keys: str) -> DataFrame:
        want = grams.select(*[F.col(g).alias(c) for c, g in keys.items()]).distinct()
        return counts.join(F.broadcast(want) if small else want, list(keys), "left_semi")

    return keep


@dataclass
class TrigramModel:
    c2: DataFrame  # u, v, c2
    c3: DataFrame  # u, v, w, c3
    types: DataFrame  # u, v, w: distinct trigrams, with those that start a line (u is null)
    total: DataFrame  # total: bigram types, one row


def trigram_model(rows: DataFrame) -> TrigramModel:
    """rows: (words). The first trigram of a line, (none, <s>, w), counts among the trigram types."""
    grams = N.gram_tables(rows, 3, 2)
    c2 = grams[2].withColumnsRenamed({"w1": "u", "w2": "v", "c": "c2"})
    c3 = grams[3].withColumnsRenamed({"w1": "u", "w2": "v", "w3": "w", "c": "c3"})
    starts = c2.where(F.col("u") == C.START).select(F.lit(None).cast("string").alias("u"), F.col("u").alias("v"), F.col("v").alias("w"))
    return TrigramModel(c2, c3, c3.select("u", "v", "w").unionByName(starts), c2.agg(F.count(F.lit(1)).alias("total")))


def trigram_score(grams: DataFrame, m: TrigramModel, strict: bool = False) -> DataFrame:
    """grams (u, v, w; u and v may be null) with p and log_prob. Unknown words and the start have none, or 0 where strict."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = lambda name: F.count(F.lit(1)).alias(name)
    grams = cut(grams, "asked")
    keep = asked_of(grams)
    t1 = keep(m.c2, v="w").groupBy(F.col("v").alias("w")).agg(n("t1"))  # distinct words before w
    f1 = keep(m.c2, u="v").groupBy(F.col("u").alias("v")).agg(n("f1"))  # distinct words after v
    n2 = keep(m.types, v="v").groupBy("v").agg(n("n2"))  # distinct trigrams around v
    t2 = keep(m.types, v="v", w="w").groupBy("v", "w").agg(n("t2"))  # distinct trigrams that end so
    c2, c3 = keep(m.c2, u="u", v="v"), keep(m.c3, u="u", v="v", w="w")
    f2 = keep(m.c3, u="u", v="v").groupBy("u", "v").agg(n("f2"))  # distinct words after both
    j = grams.join(t1, "w", "left").join(f1, "v", "left").join(n2, "v", "left").join(t2, ["v", "w"], "left").join(c2, ["u", "v"], "left").join(f2, ["u", "v"], "left").join(c3, ["u", "v", "w"], "left").join(F.broadcast(m.total))
    p1 = F.col("t1") / F.col("total")
    p2 = F.when(z("n2") == 0, p1).otherwise(F.greatest(z("t2") - D, F.lit(0.0)) / F.col("n2") + D * z("f1") / F.col("n2") * p1)
    p3 = F.when(F.col("c2").isNull(), p2).otherwise(F.greatest(z("c3") - D, F.lit(0.0)) / F.col("c2") + D * z("f2") / F.col("c2") * p2)
    known = F.col("t1").isNotNull() & (F.col("w") != C.START)
    p = F.when(known, p3).otherwise(F.lit(1.0) if strict else F.lit(None).cast("double"))
    return j.withColumn("p", p).select(*grams.columns, "p", X.safe_ln(F.col("p")).alias("log_prob"))


@dataclass
class KneserNey:
    order: int
    grams: dict[int, DataFrame]  # k -> (w1..wk, c)


def kneser_ney(rows: DataFrame, order: int = 3) -> KneserNey:
    return KneserNey(order, N.gram_tables(rows, order))


def kneser_ney_score(grams: DataFrame, m: KneserNey) -> DataFrame:
    """grams (w1..wn) with p and log_prob, by the chain from the highest order down."""
    n, d = m.order, D
    names = [f"w{i + 1}" for i in range(n)]
    grams = cut(grams, "asked")
    keep = asked_of(grams)
    same = lambda cols: {c: c for c in cols}
    ending = keep(m.grams[n], **same(names[:-1]))
    j = grams.join(keep(m.grams[n], **same(names)).withColumnRenamed("c", "top"), names, "left")
    j = j.join(ending.groupBy(*names[:-1]).agg(F.sum("c").alias("norm"), F.count(F.lit(1)).alias("foll")), names[:-1], "left")
    p = F.when(F.col("top").isNotNull(), (F.col("top") - d) / F.col("norm")).otherwise(0.0)
    s = F.when(F.col("norm").isNotNull(), d * F.col("foll") / F.col("norm")).otherwise(1.0)
    for h in range(n - 1, 0, -1):
        tail, ctx = names[n - h :], names[n - h : -1]
        longer = m.grams[h + 1].select(*[F.col(f"w{i + 2}").alias(tail[i]) for i in range(h)])  # distinct (h + 1)-grams without their first words
        j = j.join(keep(longer, **same(tail)).groupBy(*tail).agg(F.count(F.lit(1)).alias(f"cont{h}")), tail, "left")
        if ctx:
            shorter = m.grams[h].select(*[F.col(f"w{i + 1}").alias(ctx[i]) for i in range(h - 1)])
            j = j.join(keep(longer, **same(ctx)).groupBy(*ctx).agg(F.count(F.lit(1)).alias(f"norm{h}")), ctx, "left")
            j = j.join(keep(shorter, **same(ctx)).groupBy(*ctx).agg(F.count(F.lit(1)).alias(f"foll{h}")), ctx, "left")
        else:
            one = m.grams[2].agg(F.count(F.lit(1)).alias(f"norm{h}")).join(F.broadcast(m.grams[1].agg(F.count(F.lit(1)).alias(f"foll{h}"))))
            j = j.join(F.broadcast(one))
        p = p + F.when(F.col(f"cont{h}").isNotNull(), s * (F.col(f"cont{h}") - d) / F.col(f"norm{h}")).otherwise(0.0)
        s = s * F.when(F.col(f"norm{h}").isNotNull(), d * F.col(f"foll{h}") / F.col(f"norm{h}")).otherwise(1.0)
    return j.withColumn("p", p).select(*grams.columns, "p", X.safe_ln(F.col("p")).alias("log_prob"))


def kneser_ney_mass(contexts: DataFrame, m: KneserNey) -> DataFrame:
    """contexts (w1, w2) with total: the probability of all words together under an order 3 model. Each level's share is a sum of counts
    less the discount of its types, so no vocabulary is crossed with the contexts."""
    d = D
    contexts = cut(contexts, "asked")
    keep = asked_of(contexts)
    top = keep(m.grams[3], w1="w1", w2="w2").groupBy("w1", "w2").agg(F.sum("c").alias("norm"), F.count(F.lit(1)).alias("foll"))
    pairs = keep(m.grams[3].select("w2", "w3"), w2="w2").groupBy("w2", "w3").agg(F.count(F.lit(1)).alias("c"))
    mid = pairs.groupBy("w2").agg(F.sum("c").alias("norm2"), F.count(F.lit(1)).alias("types2"))
    low = keep(m.grams[2].select(F.col("w1").alias("w2")), w2="w2").groupBy("w2").agg(F.count(F.lit(1)).alias("foll1"))
    base = m.grams[2].groupBy("w2").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("norm1"), F.count(F.lit(1)).alias("types1"))
    j = contexts.join(top, ["w1", "w2"], "left").join(mid, "w2", "left").join(low, "w2", "left").join(F.broadcast(base))
    share = lambda total, types: F.coalesce((F.col(total) - d * F.col(types)) / F.col(total), F.lit(0.0))
    s2 = F.coalesce(d * F.col("foll") / F.col("norm"), F.lit(1.0))
    s1 = s2 * F.coalesce(d * F.col("foll1") / F.col("norm2"), F.lit(1.0))
    return j.select(*contexts.columns, (share("norm", "foll") + s2 * share("norm2", "types2") + s1 * share("norm1", "types1")).alias("total"))


def raw_count_score(grams: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """The raw count of an n-gram as its score, 0.001 if it has none."""
    score = F.coalesce(F.col("c").cast("double"), F.lit(0.001))
    return grams.join(counts, keys, "left").withColumn("p", score).select(*grams.columns, "p", F.ln("p").alias("log_prob"))


def get_count(grams: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    return grams.join(counts, keys, "left").select(*grams.columns, F.coalesce("c", F.lit(0)).alias("c"))


def fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, log_prob): the first model's score, or the second's where it has none."""
    b = second.select(key, F.col("log_prob").alias("other"))
    return first.join(b, key, "left").select(key, F.coalesce("log_prob", "other").alias("log_prob"))


def perplexity(scored: DataFrame, log_prob: str = "log_prob", weight: str | None = None, base: float | None = None) -> DataFrame:
    """One row: n and perplexity over scores that are finite; null if there is none. base: of the logarithm, e if None."""
    lp = F.col(log_prob)
    good = scored.where(lp.isNotNull() & ~F.isnan(lp) & (F.abs(lp) != float("inf")))
    n = F.lit(1) if weight is None else F.col(weight)
    mean = -F.try_divide(F.sum(lp * n), F.sum(n))
    return good.agg(F.sum(n).cast("long").alias("n"), (F.exp(mean) if base is None else F.pow(F.lit(base), mean)).alias("perplexity"))


@dataclass(frozen=True)
class TrigramScorer:
    """A language model over columns u, v, w."""

    model: TrigramModel

    def score(self, grams: DataFrame) -> DataFrame:
        return trigram_score(grams, self.model)


@dataclass(frozen=True)
class ExternalScorer:
    """A language model whose logarithms (base 10) another program wrote: (word, log10p)."""

    scores: DataFrame

    def score(self, grams: DataFrame) -> DataFrame:
        """grams (word) with p and log_prob, null for words without a score."""
        found = grams.join(self.scores, "word", "left")
        return found.select(*grams.columns, F.pow(F.lit(10.0), "log10p").alias("p"), (F.col("log10p") * F.ln(F.lit(10.0))).alias("log_prob"))
