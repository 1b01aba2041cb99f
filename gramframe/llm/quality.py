"""Quality rules by distribution divergence.

One pass counts each document's characters by class, its common words, and the base figures; texts go no further. References are
the mean histograms of a language's documents that pass the base rules, fitted again on those that are near the first fit. A
document is rejected if its Jensen-Shannon distance (the square root of the divergence in bits) to the reference of its language is
too large, for either histogram. Histograms of few counts are noisy, so short texts get an allowance that falls with the root of
their words, and a histogram of too little does not count at all: that of common words in texts of fewer than min_words words, that of
characters in texts of fewer than min_chars characters in words. If a language has fewer than min_reference documents to make a
reference of, in either fit, it has none: its distances are null and reject nothing.

Defined results: null texts are empty; empty texts fail the base rules and have zero counts; a null language is one of its own; rows
are judged one by one, so repeated rows get equal results; an empty table gives an empty result; extra columns are kept by `filter`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramframe.llm import textvec as tv
from gramframe.llm.common import by_chunk, cut, sized, text_key

# Common words of English, French, German and Spanish.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "with", "be", "at", "this", "have", "from", "or"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "du", "est", "que", "dans", "qui", "pour", "en", "sur", "pas", "au", "par", "il"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
}
WORDS = sorted(set().union(*COMMON.values()))
SYMBOLS = b"#*$%&|<>"
CLASSES = ["small", "capital", "digit", "space", "symbol", "mark", "point", "other letter"]


def _classes() -> np.ndarray:
    out = np.full(256, 7, np.int64)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b in (9, 10, 11, 12, 13, 32) else 4 if b in SYMBOLS else 5 if c in "!?" else 6
    out[128:192] = 8  # the other bytes of a character
    return out


CLASS = _classes()


@dataclass(frozen=True)
class Quality:
    """Fewest words, greatest percentage of words in repeated 3-word windows, greatest distances, allowance (over the root of the words), and the bounds of words, characters and documents under which distances do not count."""

    base_words: int = 50
    repeat_percent: int = 50
    char_distance: float = 0.14
    word_distance: float = 0.35
    char_allowance: float = 0.5
    word_allowance: float = 3.0
    min_words: int = 80
    min_chars: int = 100
    min_reference: int = 20


def figures(texts: DataFrame, p: Quality) -> DataFrame:
    """(id, node, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, p, q) of each row of (id, node, lang, text): p and q are the shares of character classes and common words."""
    data, offs = tv.utf8(pa.array(WORDS))
    known = tv.Words(data, offs).hash
    order = np.argsort(known)
    known_sorted = known[order]

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = tv.utf8(part.column(3))
        n, words = len(offs) - 1, tv.Words(data, offs)
        doc = np.repeat(np.arange(n), np.diff(offs))
        chars = np.bincount(doc * 9 + CLASS[data], minlength=9 * n).reshape(n, 9)[:, :8]
        at, h = words.ngrams(3)
        owner = words.doc[at]
        by = np.lexsort((h, owner))
        same = (h[by][1:] == h[by][:-1]) & (owner[by][1:] == owner[by][:-1])
        twice = np.zeros(len(h), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        repeated = np.zeros(len(words.hash), bool)
        for j in range(3):
            repeated[at[twice] + j] = True
        small = tv.Words(tv.PLAIN[data], offs)
        spot = np.minimum(np.searchsorted(known_sorted, small.hash), len(known) - 1)
        hit = known_sorted[spot] == small.hash
        k = len(WORDS)
        common = np.bincount(small.doc[hit] * (k + 1) + order[spot[hit]], minlength=n * (k + 1)).reshape(n, k + 1)
        common[:, k] = small.count - common.sum(1)
        dup = []
        for text in part.column(3).to_pylist():
            lines = (text or "").split("\n")
            if len(lines) != len(set(lines)):
                lines = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
            else:
                lines = []
            dup.append(len(lines) - len(set(lines)))
        longs = lambda x: pa.array(np.asarray(x, np.int64))
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(2), longs(words.count), longs(chars.sum(1) - chars[:, 3]), longs(chars[:, 4]), longs(dup), longs(np.bincount(words.doc[repeated], minlength=n)), tv.lists(shares(chars), np.arange(n + 1) * 8, pa.float64()), tv.lists(shares(common), np.arange(n + 1) * (k + 1), pa.float64())],
            ["id", "node", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "p", "q"],
        )

    kinds = "id long, node binary, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, p array<double>, q array<double>"
    return texts.select("id", "node", "lang", "text").mapInArrow(by_chunk(make, "text"), kinds)


def shares(counts: np.ndarray) -> np.ndarray:
    """Each row's counts over their sum, one row after another; zeros where that is none."""
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).ravel()


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, in bits; null if b is."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(a, b, lambda x, y: part(x, y) + part(y, x))
    return F.when(b.isNotNull(), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0))))


def _means(rows: DataFrame, width: tuple[int, int], keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.array(*[F.avg(F.col("p")[i]) for i in range(width[0])]).alias("rp"), F.array(*[F.avg(F.col("q")[i]) for i in range(width[1])]).alias("rq"))


def references(rows: DataFrame, p: Quality) -> DataFrame:
    """(lang, rp, rq) of languages with enough rows with the shares p and q that pass the base rules; lang is never null here ('' stands for null)."""
    width = (len(CLASSES), len(WORDS) + 1)
    return _means(rows, width, ["lang"]).where(F.col("docs") >= p.min_reference).select("lang", "rp", "rq")


def judge(docs: DataFrame, p: Quality | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, node, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept) of each row."""
    p = p or Quality()
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("node"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    failed = (F.col("n_words") < p.base_words) | (100 * F.col("n_repeat_words") > p.repeat_percent * F.col("n_words"))
    rows = cut(figures(texts, p).withColumn("base_failed", failed), "figures")
    room = lambda x: x / F.sqrt(F.greatest("n_words", F.lit(1)))
    of_chars = (F.col("word_chars") < p.min_chars) | (F.col("char_distance") <= p.char_distance + room(F.lit(p.char_allowance)))
    of_words = (F.col("n_words") < p.min_words) | (F.col("word_distance") <= p.word_distance + room(F.lit(p.word_allowance)))
    near = F.coalesce(of_chars, F.lit(True)) & F.coalesce(of_words, F.lit(True))

    def measured(refs: DataFrame) -> DataFrame:
        return rows.join(sized(refs), "lang", "left").withColumn("char_distance", distance(F.col("p"), F.col("rp"))).withColumn("word_distance", distance(F.col("q"), F.col("rq"))).drop("rp", "rq")

    good = ~F.col("base_failed")
    first = cut(references(rows.where(good), p), "references")
    refs = cut(references(measured(first).where(good & near & F.col("char_distance").isNotNull()), p), "references")
    return measured(refs).withColumn("kept", good & near).select("id", "node", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def filter(docs: DataFrame, p: Quality | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs that the rules keep, with all columns. Rows of one id and text share a language's verdict only if all of them pass."""
    bad = judge(docs, p, id_col, text_col, lang_col).where(~F.col("kept")).select(F.col("id").alias("bad_id"), F.col("node").alias("bad_node")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("bad_id")) & (text_key(docs[text_col]) == F.col("bad_node")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """Figures and verdict of each document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id").drop("node")
