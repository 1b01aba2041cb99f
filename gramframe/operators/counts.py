"""Counts of words, n-grams, their types and their contexts. Each is a partial and a final hash aggregate on one key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramframe.functions import text as X
from gramframe.sources import corpus as C
from gramframe.sources.stage import cut

#: Words whose ids each task gets, a few MB.
FREQUENT = 250_000


def unigrams(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def vocab_cut(counts: DataFrame, min_count: int) -> DataFrame:
    """Words that occur more often than min_count."""
    return counts.where(F.col("c") > min_count)


def feature_cut(counts: DataFrame, min_count: int) -> DataFrame:
    """Features that occur at least min_count times."""
    return counts.where(F.col("c") >= min_count)


def in_vocabulary(rows: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    return rows.join(vocab.select(F.col("word").alias(word)), word, "left_semi")


def ngram_counts(rows: DataFrame, orders: tuple[int, ...] = (1, 2, 3), pad: bool = True) -> DataFrame:
    """(n, ngram, c): orders side by side in one pass and one shuffle."""
    words = C.padded(F.col("words")) if pad else F.col("words")
    all_orders = F.concat(*[F.transform(X.ngrams(words, k), lambda g: F.struct(F.lit(k).alias("n"), g.alias("ngram"))) for k in orders])
    return rows.select(F.inline(all_orders)).groupBy("n", "ngram").agg(F.count(F.lit(1)).alias("c"))


def word_columns(rows: DataFrame, k: int) -> DataFrame:
    """(w1..wk, c): counts of k-grams over padded lines, a column a word."""
    names = [f"w{i + 1}" for i in range(k)]
    return rows.select(F.inline(X.windows(C.padded(F.col("words")), k)).alias(*names)).groupBy(*names).agg(F.count(F.lit(1)).alias("c"))


def gram_tables(rows: DataFrame, most: int = 3, least: int = 1) -> dict[int, DataFrame]:
    """k -> (w1..wk, c) for each order from least to most, from one pass over the corpus and one shuffle, written once."""
    names = [f"w{i + 1}" for i in range(most)]
    word = lambda z, i, k: z[str(i)] if i < k else F.lit(None).cast("string")
    one = lambda k: lambda z: F.struct(F.lit(k).alias("k"), *[word(z, i, k).alias(names[i]) for i in range(most)])
    every = F.concat(*[F.transform(X.windows(C.padded(F.col("words")), k), one(k)) for k in range(least, most + 1)])
    table = cut(rows.select(F.inline(every)).groupBy("k", *names).agg(F.count(F.lit(1)).alias("c")), "grams")
    return {k: table.where(F.col("k") == k).select(*names[:k], "c") for k in range(least, most + 1)}


def context_normalizers(counts: DataFrame, k: int) -> DataFrame:
    """Tokens after each context of k - 1 words."""
    return counts.groupBy(*[f"w{i + 1}" for i in range(k - 1)]).agg(F.sum("c").cast("long").alias("total"))


def continuations(types: DataFrame, k: int) -> DataFrame:
    """Distinct heads before each tail of k - 1 words; types has a row for each k-gram."""
    return types.groupBy(*[f"w{i + 1}" for i in range(1, k)]).agg(F.count(F.lit(1)).alias("types"))


def middles(types: DataFrame, k: int) -> DataFrame:
    """Distinct (head, last) around each middle of k - 2 words."""
    return types.groupBy(*[f"w{i + 1}" for i in range(1, k - 1)]).agg(F.count(F.lit(1)).alias("types"))


def followers(types: DataFrame, k: int) -> DataFrame:
    """Distinct words after each prefix of k - 1 words."""
    return types.groupBy(*[f"w{i + 1}" for i in range(k - 1)]).agg(F.count(F.lit(1)).alias("types"))


def feature_counts(ngrams: DataFrame, featurizer, ngram: str = "g", weight: Column | None = None) -> DataFrame:
    """(feature, c) over all n-grams."""
    n = F.lit(1) if weight is None else weight
    return ngrams.select(F.explode(featurizer(F.col(ngram))).alias("feature"), n.alias("n")).groupBy("feature").agg(F.sum("n").cast("long").alias("c"))


def histogram(counts: DataFrame) -> DataFrame:
    """How many features occur once, twice, more often."""
    return counts.agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"), F.count_if(F.col("c") >= 3).alias("more"))


def suffix_counts(vocab: DataFrame) -> DataFrame:
    """(suffix, types): each suffix of each distinct word counts once."""
    return vocab.select(F.explode(X.suffixes(F.col("word"))).alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("types"))


def suffix_backoff(words: DataFrame, suffixes: DataFrame, threshold: int) -> DataFrame:
    """(word, mapped): the longest suffix that enough words share, else UNK."""
    each = words.select("word", F.explode(X.suffixes(F.col("word"))).alias("suffix"))
    met = each.join(suffixes.where(F.col("types") >= threshold), "suffix").groupBy("word").agg(F.max_by("suffix", F.length("suffix")).alias("mapped"))
    return words.select("word").join(met, "word", "left").select("word", F.coalesce("mapped", F.lit(C.UNK)).alias("mapped"))


def rare_collapse(words: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """(word, mapped): words that occur threshold times or less become UNK."""
    return words.select("word").join(counts.where(F.col("c") > threshold).select("word", F.lit(True).alias("known")), "word", "left").select("word", F.when(F.col("known"), F.col("word")).otherwise(C.UNK).alias("mapped"))


def merge_runs(*runs: DataFrame, keys: tuple[str, ...] = ("suffix", "word")) -> DataFrame:
    """Count runs as one, equal keys summed."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy(*keys).agg(F.sum("c").cast("long").alias("c"))


def dense_ids(keys: DataFrame, key: str, *order: Column, name: str = "id") -> DataFrame:
    """keys with ids from 0 in the given order: sorted by range and written, then each part's ids start where the parts before end."""
    spark, order = keys.sparkSession, order or (F.col(key),)
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = cut(ranged.withColumn("spot", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "ranged")
    sizes = {r[0]: r[1] for r in placed.groupBy("part").agg(F.count(F.lit(1))).collect()}  # a row a partition
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    table = spark.createDataFrame(list(starts.items()) or [(0, 0)], "part int, start long")
    return placed.join(F.broadcast(table), "part").withColumn(name, F.col("start") + F.col("spot")).drop("part", "spot", "start")


def feature_covariance(has: DataFrame, means: DataFrame, sampled: DataFrame) -> DataFrame:
    """(f, g, cov) of sampled features f: the sum over n-grams with f of (1 - mean_f)(x_g - mean_g), for g that occur with f.

    has: (ngram, feature, c), c the occurrences of the n-gram.
    """
    with_f = has.join(sampled, "feature", "left_semi").select("ngram", F.col("feature").alias("f"), "c")
    both = with_f.join(has.select("ngram", F.col("feature").alias("g")), "ngram").groupBy("f", "g").agg(F.sum("c").alias("n_fg"))
    n_f = with_f.groupBy("f").agg(F.sum("c").alias("n_f"))
    mean = lambda x: means.select(F.col("feature").alias(x), F.col("mean").alias(f"m_{x}"))
    return both.join(n_f, "f").join(mean("f"), "f").join(mean("g"), "g").select("f", "g", ((1 - F.col("m_f")) * (F.col("n_fg") - F.col("n_f") * F.col("m_g"))).alias("cov"))


def line_ids(rows: DataFrame, ids: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, line_no, ids) of rows (doc_id, line_no, words): each word's id. ids: (word, word_id), the most frequent first, with all words.

    The frequent words' ids are broadcast, so that lines stay whole; only the others' occurrences are shuffled, to their ids and back."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(ids.where(F.col("word_id") < frequent).select("word", F.col("word_id").cast("long").alias("word_id")).toArrow().combine_chunks())

    def run(batches):
        words, numbers = (known.value.column(c).combine_chunks() for c in ("word", "word_id"))
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            flat, ends = lists.flatten(), pc.cast(pc.cumulative_sum(pc.list_value_length(lists)), "int32")
            offsets = pa.concat_arrays([pa.array([0], "int32"), ends])
            at = pc.index_in(flat, value_set=words.cast(flat.type))
            rare = pc.is_null(at)
            before = pa.concat_arrays([pa.array([0], "int64"), pc.cumulative_sum(pc.cast(rare, "int64"))])  # rare words before each place
            starts = pc.take(before, offsets)
            first = pc.take(starts, pc.list_parent_indices(pa.ListArray.from_arrays(offsets, flat)))
            nth = pc.subtract(pc.subtract(first, before.slice(0, len(flat))), 1)  # -1 for a line's first rare word, -2 for the next
            found = pc.coalesce(pc.take(numbers, at), nth)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pc.cast(found, "int32")), pa.ListArray.from_arrays(pc.cast(starts, "int32"), pc.filter(flat, rare))], ["doc_id", "line_no", "found", "rare"])

    schema = rows.select("doc_id", "line_no", F.array(F.lit(0)).alias("found"), F.col("words").alias("rare")).schema  # ids under frequent and places in a line are ints
    lines = cut(rows.select("doc_id", "line_no", "words").mapInArrow(run, schema), "lines")
    known.destroy()
    occurrences = lines.select("doc_id", "line_no", F.posexplode("rare").alias("nth", "word"))
    met = occurrences.join(ids.where(F.col("word_id") >= frequent), "word").groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("nth", "word_id"))).alias("others"))
    both = lines.select("doc_id", "line_no", "found").join(met.select("doc_id", "line_no", F.col("others.word_id").alias("others")), ["doc_id", "line_no"], "left")
    return both.select("doc_id", "line_no", F.transform("found", lambda x: F.when(x < 0, F.get("others", (-x - 1).cast("int"))).otherwise(x)).alias("ids"))


def coded_pairs(rows: DataFrame, own: DataFrame, vocab: DataFrame, *keep: str, frequent: int = FREQUENT) -> DataFrame:
    """rows (words, ...) with the columns to keep and, of each line's pairs of neighbours whose second word is in the vocabulary, arrays of ids
    side by side: own_id and word_id, or, where the first word's id is not among the frequent ones, rare (the word) and rare_word_id.

    own: (own, own_id), the most frequent first; vocab: (word, word_id). Both are broadcast, the first up to the frequent ids."""
    arrow = lambda df, *names: df.select(F.col(names[0]), F.col(names[1]).cast("int").alias(names[1])).toArrow().combine_chunks()
    tables = rows.sparkSession.sparkContext.broadcast((arrow(own.where(F.col("own_id") < frequent), "own", "own_id"), arrow(vocab, "word", "word_id")))

    def ids_of(words, table):
        keys, ids = (table.column(i).combine_chunks() for i in range(2))
        return pc.take(ids, pc.index_in(words, value_set=keys.cast(words.type)))

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            flat, line = lists.flatten(), pc.list_parent_indices(lists)
            n = max(len(flat) - 1, 0)
            second = ids_of(flat.slice(1), tables.value[1])
            met = pc.and_(pc.equal(line.slice(0, n), line.slice(1)), pc.is_valid(second))
            first = ids_of(flat.slice(0, n), tables.value[0])
            out = list(batch.columns[1:])
            for chosen, value in ((pc.and_(met, pc.is_valid(first)), first), (pc.and_(met, pc.is_null(first)), flat.slice(0, n))):
                sizes = np.bincount(pc.filter(line.slice(0, n), chosen).to_numpy(zero_copy_only=False), minlength=batch.num_rows)
                offsets = pa.array(np.append(0, np.cumsum(sizes)), "int32")
                out += [pa.ListArray.from_arrays(offsets, pc.filter(x, chosen)) for x in (value, second)]
            yield pa.RecordBatch.from_arrays(out, [*keep, "own_id", "word_id", "rare", "rare_word_id"])

    numbers, words = F.array(F.lit(0)), F.array(F.lit(""))
    schema = rows.select(*keep, numbers.alias("own_id"), numbers.alias("word_id"), words.alias("rare"), numbers.alias("rare_word_id")).schema
    return rows.select("words", *keep).mapInArrow(run, schema)
