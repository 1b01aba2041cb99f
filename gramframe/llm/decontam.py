"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are taken without case and punctuation (of ASCII). Each run of seed_words words of a test item is a seed. One pass over the
documents finds their seeds, through a bitmap of a fixed size, and where they are; texts go no further. Then seeds are counted: one is
rare if it is in no more documents than rare_docs, the part rare_part of all, or a few times the median of the item's seeds that occur.
Rare seeds join documents to items, so that phrases which half the corpus has pair nothing; a heavy seed is joined by broadcast. The
texts of documents that have a candidate are read again, and each passage around rare seeds is aligned with the item word by word,
unless it has too few of the item's words for any alignment to do. A document leaks an item if the alignment reaches min_score of the
item's own. Copies in which no rare seed is left are not found.

Defined results: null texts and items are empty and never match; an item of fewer than seed_words words is one seed; rows equal in
id and text give one row an item, as do repeated items; a null id is an id like others; an empty table on either side gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramframe.llm import textvec as tv
from gramframe.llm.common import by_chunk, cut, join_split, sized, text_key


@dataclass(frozen=True)
class Decontam:
    """Words a seed, least share of the item's own score, the scores of the alignment, what is rare, and places of the bitmap."""

    seed_words: int = 3
    min_score: float = 0.5
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    rare_docs: int = 50
    rare_part: float = 0.001
    rare_medians: float = 4.0
    places: int = 1 << 24


def align(item: np.ndarray, passage: np.ndarray, p: Decontam) -> tuple[int, int]:
    """Best local score of two word sequences, and where in the passage it ends. A row at a time: gaps along it are a running maximum."""
    steps = -p.gap * np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.maximum(above + p.gap, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, p.match, p.mismatch))
        above = np.maximum.accumulate(row + steps) - steps
        k = int(above.argmax())
        if above[k] > best:
            best, end = int(above[k]), k
    return best, end


def plain_words(col: pa.Array) -> tv.Words:
    data, offs = tv.utf8(col)
    return tv.Words(tv.PLAIN[data], offs)


def seed_hashes(words: tv.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each run of k words."""
    at, h = words.ngrams(k)
    return at, tv.mix(h + tv.U(k))


def item_seeds(benchmark: DataFrame, p: Decontam) -> tuple[DataFrame, DataFrame]:
    """Written tables of distinct items (item, item_id, words) and their seeds (seed, item, k)."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        words = plain_words(part.column(2))
        bags, lengths = [], []
        for d in range(part.num_rows):
            run = slice(words.at[d], words.at[d + 1])
            bags.append(words.hash[run].view(np.int64).tolist())
            lengths.append(run.stop - run.start)
        seeds = [[] for _ in lengths]
        sizes = np.array(lengths, np.int64)
        for k in sorted({min(p.seed_words, n) for n in lengths if n}):
            at, h = seed_hashes(words, k)
            for d, x in zip(words.doc[at].tolist(), h.view(np.int64).tolist()):
                if min(p.seed_words, sizes[d]) == k:
                    seeds[d].append(x)
        kinds = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bags, kinds), pa.array([sorted(set(x)) for x in seeds], kinds), pa.array([min(p.seed_words, n) for n in lengths], pa.int32())], ["item", "item_id", "words", "seeds", "k"])

    each = benchmark.select(text_key(F.concat_ws(" ", F.col("item_id").cast("string"), "text")).alias("item"), "item_id", "text").dropDuplicates(["item"])
    found = cut(each.mapInArrow(by_chunk(make, "text"), "item binary, item_id long, words array<long>, seeds array<long>, k int"), "items")
    return found.select("item", "item_id", "words"), found.select(F.explode("seeds").alias("seed"), "item", "k")


def hits(texts: DataFrame, seeds: DataFrame, p: Decontam) -> DataFrame:
    """(id, node, seed, spots): where each document has words that may be a seed; the bitmap lets some through that are none."""
    lengths = [r[0] for r in seeds.select("k").distinct().collect()]  # up to seed_words numbers
    bitmap = np.zeros(p.places, bool)
    set_bits = seeds.select(F.pmod("seed", F.lit(p.places)).cast("int").alias("bit")).distinct().toArrow()  # at most a row a place
    bitmap[set_bits.column(0).to_numpy()] = True
    bits = texts.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def make(part: pa.RecordBatch) -> pa.RecordBatch | None:
        words, known, found = plain_words(part.column(2)), np.unpackbits(bits.value).view(bool), []
        for k in lengths:
            at, h = seed_hashes(words, k)
            spot = np.flatnonzero(known[(h.view(np.int64) % p.places)])
            found.append((at[spot], h[spot].view(np.int64)))
        at, seed = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        if not len(at):
            return None
        doc = words.doc[at]
        order = np.lexsort((at, seed, doc))
        at, seed, doc = at[order], seed[order], doc[order]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])))
        own = pa.array(doc[new])
        return pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(seed[new]), tv.lists((at - words.at[doc]).astype(np.int32), np.append(new, len(at)), pa.int32())], ["id", "node", "seed", "spots"])

    return cut(texts.select("id", "node", "text").mapInArrow(by_chunk(make, "text"), "id long, node binary, seed long, spots array<int>"), "hits")


def rare_seeds(found: DataFrame, seeds: DataFrame, docs: int, p: Decontam) -> DataFrame:
    """(seed, items, rows), written: the items that each rare seed stands for, and in how many documents it is."""
    counts = cut(found.groupBy("seed").agg(F.count(F.lit(1)).alias("rows")), "counts")
    met = cut(seeds.select("seed", "item").join(counts, "seed"), "met")
    typical = met.groupBy("item").agg(F.percentile_approx("rows", 0.5, 1000).alias("median"))
    most = F.greatest(F.lit(float(p.rare_docs)), F.lit(p.rare_part * docs), F.col("median") * p.rare_medians)
    return cut(met.join(typical, "item").where(F.col("rows") <= most).groupBy("seed").agg(F.collect_list("item").alias("items"), F.max("rows").alias("rows")), "rare")


def leaks(docs: DataFrame, benchmark: DataFrame, p: Decontam | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, node, item_id, score, end_word) of each document and item that it leaks."""
    p = p or Decontam()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", text_key(F.col("text")))
    items, seeds = item_seeds(benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")), p)
    found = hits(texts, seeds, p) if not seeds.isEmpty() else None
    if found is None or found.isEmpty():
        return texts.where("false").select("id", "node", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("end_word"))
    rare = rare_seeds(found, seeds, docs.count(), p)
    met = join_split(found, rare, ["seed"]).select("id", "node", "spots", F.explode("items").alias("item"))
    spots = met.groupBy("id", "node", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("spots"))
    asked = spots.join(sized(items), "item").groupBy("id", "node").agg(F.collect_list(F.struct("item_id", "words", "spots")).alias("asked"))
    asked = cut(asked.withColumnsRenamed({"id": "of_id", "node": "of_node"}), "asked")
    both = texts.join(sized(asked), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("node") == F.col("of_node"))).select("id", "node", "text", "asked")

    def score(own: np.ndarray, passage: np.ndarray) -> tuple[float, int] | None:
        # no alignment matches more words than the passage has of the item's
        if np.isin(own, passage).sum() < p.min_score * len(own):
            return None
        best, end = align(own, passage, p)
        share = best / (p.match * len(own))
        return (share, end) if share >= p.min_score else None

    def make(part: pa.RecordBatch) -> pa.RecordBatch | None:
        words, rows = plain_words(part.column(2)), []
        for doc, wanted in enumerate(part.column(3).to_pylist()):
            whole = words.hash[words.at[doc] : words.at[doc + 1]]
            for one in wanted:
                own = np.array(one["words"], np.int64).view(tv.U)
                first = last = one["spots"][0]
                for spot in [*one["spots"][1:], 1 << 60]:  # seeds further apart than the item is long are passages of their own
                    if spot - last > len(own):
                        a = max(0, first - len(own))
                        if got := score(own, whole[a : last + len(own) + p.seed_words]):
                            rows.append((doc, one["item_id"], got[0], a + got[1]))
                        first = spot
                    last = spot
        if not rows:
            return None
        doc = pa.array([r[0] for r in rows])
        return pa.RecordBatch.from_arrays([part.column(0).take(doc), part.column(1).take(doc), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64())], ["id", "node", "item_id", "score", "end_word"])

    scored = both.mapInArrow(by_chunk(make, "text"), "id long, node binary, item_id long, score double, end_word long")
    return scored.groupBy("id", "node", "item_id").agg(F.max(F.struct("score", "end_word")).alias("best")).select("id", "node", "item_id", "best.score", "best.end_word")


def query(spark, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it leaks, with the alignment's share of the item's own score."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("id").alias("doc_id"), "item_id", F.round("score", 6).alias("score"), "end_word")
