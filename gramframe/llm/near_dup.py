"""MinHash near-dedup with ProbMinHash signatures.

Each distinct text is a set of word shingles. Every shingle is a Poisson process whose rate is its weight; each arrival falls on a
random component, and a component keeps the shingle that arrived first. Two signatures agree in a component with the probability
Jaccard similarity of the sets, and as each distinct shingle weighs 1, that is the Jaccard similarity by which links are verified. A
text's processes end once no further arrival can win a component.

Equal texts are one node from the start. Texts that share a band are candidates; in each bucket the member that meets most others
is compared with the rest, so a bucket of n gives n - 1 pairs. What this leaves in more than one class is compared across classes, in
blocks that have the shingle sets: those whose signatures agree nearly enough are verified there, the best first, and a member gives
one link a class that it joins, so that no list of pairs is made. Links are verified on the whole shingle sets, and their components
are the classes.

Defined results: null texts are empty; texts without a word are alike only if equal; a text of one to four words is one shingle;
rows with equal text always share a class, whatever their doc_id; a null doc_id comes after all others; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramframe.llm import textvec as tv
from gramframe.llm.common import by_chunk, cut, text_key


@dataclass(frozen=True)
class NearDup:
    """Words a shingle, least Jaccard similarity of a link, bands and rows a band, and how many members of a bucket one task compares."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 30
    rows: int = 6
    block: int = 1000
    seed: int = 1


def prob_minhash(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int, m: int, seed: int = 1) -> np.ndarray:
    """Signatures of n sets, m components each: the id that arrives first in each; 0 where a set is empty."""
    first, sig = np.full(n * m, np.inf), np.zeros(n * m, tv.U)
    state = tv.mix(ids + tv.U(seed * 0x9E3779B9 + 1))
    doc, ids, rate = doc.copy(), ids.copy(), 1.0 / weight
    time, step = np.zeros(len(ids)), 0
    while len(ids):
        span = int(min(256, max(1, 200_000 // len(ids)))) if step else 1
        u = tv.mix(state[:, None] + (np.arange(step + 1, step + 1 + span, dtype=tv.U) * tv.U(0x9E3779B97F4A7C15))[None, :])
        gap = -np.log1p(-((u >> tv.U(11)).astype(np.float64) * 2.0**-53)) * rate[:, None]
        at = time[:, None] + (np.cumsum(gap, 1) if span > 1 else gap)
        cell = doc[:, None] * m + ((tv.mix(u ^ tv.U(0xA5A5A5A5A5A5A5A5)) >> tv.U(32)) % tv.U(m)).astype(np.int64)
        flat, arrived = cell.ravel(), at.ravel()
        np.minimum.at(first, flat, arrived)
        won = arrived == first[flat]
        sig[flat[won]] = np.repeat(ids, span)[won]
        time, step = at[:, -1], step + span
        alive = time < first.reshape(n, m).max(1)[doc]
        doc, ids, rate, time, state = doc[alive], ids[alive], rate[alive], time[alive], state[alive]
    return sig.reshape(n, m)


def band_keys(col: pa.Array, p: NearDup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each text and band; its signature, 32 bits a component; which texts have a shingle."""
    doc, ids, _, n = tv.distinct_shingles(col, p.words)
    sig = prob_minhash(doc, ids, np.ones(len(ids)), n, p.bands * p.rows, p.seed)
    key = np.zeros((n, p.bands), tv.U)
    for j in range(p.rows):
        key = tv.mix(key * tv.STEP + sig[:, j :: p.rows])
    return key, (sig & tv.U(0xFFFFFFFF)).astype(np.uint32), np.isin(np.arange(n), doc)


def sketches(texts: DataFrame, p: NearDup) -> DataFrame:
    """(id, node, bands, signature) of each text that has a word."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        key, sig, some = band_keys(part.column(2), p)
        key, sig, has = key[some], sig[some], pa.array(some)
        return pa.RecordBatch.from_arrays([part.column(0).filter(has), part.column(1).filter(has), tv.lists(key.ravel().view(np.int64), np.arange(len(key) + 1) * p.bands, pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "node", "bands", "signature"])

    return texts.select("id", "node", "text").mapInArrow(by_chunk(make, "text"), "id long, node binary, bands array<long>, signature binary")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, ids, brief) with the distinct shingles of each text; brief: 32 bits of each, sorted, as bytes."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, ids, _, n = tv.distinct_shingles(part.column(1), words)
        at = np.searchsorted(doc, np.arange(n + 1))
        brief = [np.unique(ids[a:b].astype(np.uint32)).tobytes() for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([part.column(0), tv.lists(ids.view(np.int64), at, pa.int64()), pa.array(brief, pa.binary())], ["node", "ids", "brief"])

    return texts.select("node", "text").mapInArrow(by_chunk(make, "text"), "node binary, ids array<long>, brief binary")


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("ids").alias("x")), sets.select(F.col("node").alias("b"), F.col("ids").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(jaccard(F.col("x"), F.col("y")) >= similarity).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links lead to, of each node that has a link. Labels are pulled along links and then along labels until none changes."""
    both = cut(links.union(links.select("b", "a")).toDF("node", "near").where("node != near").distinct(), "links")
    labels = cut(both.groupBy("node").agg(F.min("near").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("near"), F.col("label").alias("of_near"))
        pulled = both.join(seen, "near").groupBy("node").agg(F.min("of_near").alias("pulled")).join(labels, "node").select("node", "label", F.least("pulled", "label").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("of_best"))
        new = cut(pulled.join(jump, "best", "left").select("node", F.col("label").alias("was"), F.least("best", "of_best").alias("label")), "labels")
        changed = not new.where("was != label").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels


def across(rows: DataFrame, p: NearDup) -> DataFrame:
    """Links between members of one bucket and different classes, as many as join what can be joined. Pairs whose signatures agree in less
    than the share `similarity` less 3.7 standard errors of it are left out, which one link in ten thousand is, as many as no band finds.
    Of the others 32 bits a shingle are compared, the pair that agrees best first, until a member has joined each class that it meets.
    rows: (band, key, node, bands, signature, brief, label, main, size).

    Members of a bucket's main class stand in one block each; the others are in every block, so that each pair meets in some block.
    """
    blocks = F.ceil(F.col("size") / p.block).cast("int")
    own = (F.pmod(F.xxhash64("node"), blocks)).cast("int")
    spread = rows.withColumn("block", F.explode(F.when(F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1)))).withColumn("home", own)

    def links(batch):
        import pandas as pd

        bands, node = np.array(batch["bands"].tolist(), np.int64), batch["node"].to_numpy()
        sig = np.stack([np.frombuffer(x, np.uint32) for x in batch["signature"]])
        sets = [np.frombuffer(x, np.uint32) for x in batch["brief"]]
        least = p.similarity - 3.7 * (p.similarity * (1 - p.similarity) / sig.shape[1]) ** 0.5
        label = np.unique(np.array([x.hex() for x in batch["label"]]), return_inverse=True)[1]
        band, block, home, out = int(batch["band"].iloc[0]), int(batch["block"].iloc[0]), batch["home"].to_numpy(), []
        for i in np.flatnonzero(~batch["main"].to_numpy()):
            ok = np.flatnonzero((label != label[i]) & (home == block))
            ok = ok[(bands[ok] == bands[i]).argmax(1) == band]  # pairs that meet in an earlier band are compared there
            agree = (sig[ok] == sig[i]).mean(1)
            ok, agree = ok[agree >= least], agree[agree >= least]
            for j in ok[np.lexsort((ok, -agree))]:
                if label[j] == label[i]:
                    continue  # joined through another member
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= p.similarity * (len(sets[i]) + len(sets[j]) - both):
                    out.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return spread.groupBy("band", "key", "block").applyInPandas(links, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, p: NearDup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, class_id, class_node) of each row; class_id is the smallest id of its class, class_node the text it has."""
    p = p or NearDup()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", text_key(F.col("text")))
    sketch = cut(sketches(rows, p), "sketch")
    once = sketch.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    flat = once.select("node", F.posexplode("bands").alias("band", "key"))
    full = flat.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(flat.join(full, ["band", "key"]), "members")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "node").withColumn("rank", F.struct(F.col("degree"), F.col("node")))
    hubs = ranked.groupBy("band", "key").agg(F.max("rank").getField("node").alias("hub"))
    stars = members.join(hubs, ["band", "key"]).where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    stars = cut(stars, "stars")
    same = (F.col("node") == F.col("of_node")) & F.col("id").eqNullSafe(F.col("of_id"))
    one_each = members.select("node").distinct().join(once.select("node", "id"), "node")
    sets = cut(shingle_sets(rows.join(one_each.toDF("of_node", "of_id"), same, "left_semi"), p.words).dropDuplicates(["node"]), "sets")
    links = cut(verified(stars, sets, p.similarity), "links")
    labels = components(links)
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tally = named.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = tally.groupBy("band", "key").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "label")).getField("label").alias("most")).where("classes > 1").drop("classes")
    signed = sketch.select(F.col("id").alias("of_id"), F.col("node").alias("of_node"), "signature").dropDuplicates(["of_id", "of_node"])
    apart = named.join(mixed, ["band", "key"]).withColumn("main", F.col("label") == F.col("most")).join(once, "node").join(signed, same).join(sets.select("node", "brief"), "node").select("band", "key", "node", "bands", "signature", "brief", "label", "main", "size")
    new = cut(verified(across(apart, p), sets, p.similarity), "links")
    if not new.isEmpty():
        labels = components(links.union(new))
    ids = rows.groupBy("node").agg(F.min("id").alias("least_id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = cut(ids, "ids")
    least = ids.groupBy("label").agg(F.min(F.struct(F.col("least_id").isNull().alias("last"), "least_id", "node")).alias("least")).select("label", F.col("least.least_id").alias("class_id"), F.col("least.node").alias("class_node"))
    return rows.select("id", "node").join(ids.join(least, "label").select("node", "class_id", "class_node"), "node").select("id", "node", "class_id", "class_node")


def keep_one(docs: DataFrame, p: NearDup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of docs, that with the smallest id, and one of rows that repeat it."""
    best = near_duplicates(docs, p, id_col, text_col).select(F.col("class_id").alias("best_id"), F.col("class_node").alias("best_node")).distinct()
    kept = docs.join(best, docs[id_col].eqNullSafe(F.col("best_id")) & (text_key(docs[text_col]) == F.col("best_node")), "left_semi")
    return kept.dropDuplicates([id_col, text_col])


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of the documents alike, of each document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
