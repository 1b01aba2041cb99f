"""Line dedup by a deletion-neighbourhood join.

A line is its words; lines are equal if the MD5 of their words, joined by single spaces, is. Two lines are alike if they are equal, or if
one word put in, left out or changed turns one into the other and both have at least min_words words: the edit bound is a word in
min_words, which for shorter lines is none. Each distinct line with a possible partner emits a key for itself and one for each word left
out, together with the word's place; lines that meet in a key are within the bound, so the earliest of a key stands for it and no
pairs within a key are made. The edit distance of each line and the earliest that it meets is then verified on the words.

A line is dropped if an earlier line (by doc_id, place in the document) is alike; the earliest stays, whatever happened to lines
between. Lines that can have a partner share the words before or after their middle, which a first join on those halves finds. Keys that
a large part of all lines has, as boilerplate does, are joined by broadcast, the others by shuffle.

Defined results: null texts are empty and stay; lines without a word are never dropped; rows equal in id and text are one document
and get one result; of rows that share an id but not the text, that with the smaller digest comes first; a null id comes before all others; extra columns are kept.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramframe.llm import textvec as tv
from gramframe.llm.common import by_chunk, cut, join_split, once, text_key

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class LineDedup:
    """Fewest words of lines that are compared by edit distance; shorter ones must be equal."""

    min_words: int = 8


def _lines(part: pa.RecordBatch, column: int):
    """Words of all lines of a batch of texts, the row and the number in it of each line, and the row and line of each word."""
    data, offs = tv.utf8(part.column(column))
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(offs, breaks + 1)
    starts = starts[starts <= offs[-1]] if len(offs) else starts
    words = tv.Words(data, np.append(starts[starts < len(data)], len(data)) if len(data) else np.zeros(1, np.int64))
    begin = starts[starts < len(data)]
    row = np.searchsorted(offs, begin, "right") - 1
    empty = np.searchsorted(offs, breaks, "right") - 1
    number = np.searchsorted(breaks, begin, "left") - np.searchsorted(breaks, offs[row], "left") if len(begin) else begin
    return words, row, number, empty


def line_keys(texts: DataFrame, p: LineDedup) -> DataFrame:
    """(id, node, line, words, key, halves) of each line that has a word. halves: keys of what stands before and after the middle."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        words, row, number, _ = _lines(part, 2)
        has = np.flatnonzero(words.count > 0)
        n, at = words.count[has], words.at[has]
        lines = (line.split() for text in part.column(2).cast(pa.binary()).to_pylist() for line in (text or b"").split(b"\n"))
        key = [hashlib.md5(b" ".join(line)).digest() for line in lines if line]
        first = np.repeat(words.at[:-1], words.count)
        ahead = tv.placed(words.hash, np.arange(len(words.hash)) - first)

        def run(a: np.ndarray, b: np.ndarray, mark: np.ndarray) -> np.ndarray:
            return tv.mix(tv.sums_of(ahead, a, b) + mark)

        def tail(a: np.ndarray, size: np.ndarray, mark: np.ndarray) -> np.ndarray:
            stop = np.cumsum(size)
            spot = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - size, size)
            own = tv.placed(words.hash[np.repeat(a, size) + spot], spot)
            return tv.mix(tv.sums_of(own, stop - size, stop) + mark)

        halves = np.zeros((len(has), 4), tv.U)
        for j, size in enumerate((n // 2, (n - 1) // 2)):
            mark = size.astype(tv.U) * tv.STEP
            halves[:, 2 * j] = run(at, at + size, mark)
            halves[:, 2 * j + 1] = tail(at + n - size, size, mark ^ tv.U(0x5555))
        some = np.where(n >= p.min_words, np.where(n % 2 == 1, 2, 4), 0)
        flat = halves[np.arange(4)[None, :] < some[:, None]]
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(row[has])), part.column(1).take(pa.array(row[has])), pa.array(number[has], pa.int32()), pa.array(n, pa.int32()), pa.array(key, pa.binary()), tv.lists(flat.view(np.int64), np.append(0, np.cumsum(some)), pa.int64())],
            ["id", "node", "line", "words", "key", "halves"],
        )

    return texts.select("id", "node", "text").mapInArrow(by_chunk(make, "text"), "id long, node binary, line int, words int, key binary, halves array<long>")


def variants(lines: DataFrame) -> DataFrame:
    """(key, first, variant, place) of each line and each word left out; place -1 is the line itself. A variant is the sum of its words at
    their places, so that those behind the word that is left out move up by one."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = tv.utf8(part.column(1))
        words = tv.Words(data, offs)
        a, b = words.at[:-1], words.at[1:]
        line, at = words.doc, np.arange(len(words.hash))
        start, stop, place = a[line], b[line], at - a[line]
        here, moved = tv.placed(words.hash, place), tv.placed(words.hash, place - 1)
        whole = tv.mix(tv.sums_of(here, a, b) + (b - a).astype(tv.U))
        less = tv.mix(tv.sums_of(here, start, at) + tv.sums_of(moved, at + 1, stop) + (stop - start - 1).astype(tv.U))
        own = np.concatenate([np.arange(len(a)), line])
        places = np.concatenate([np.full(len(a), -1), place])
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), part.column(2).take(pa.array(own)), pa.array(np.concatenate([whole, less]).view(np.int64)), pa.array(places, pa.int32())], ["key", "first", "variant", "place"])

    kind = lines.select("first").schema[0].dataType.simpleString()
    return lines.select("key", "text", "first").mapInArrow(by_chunk(make, "text"), f"key binary, first {kind}, variant long, place int")


def one_edit(a, b):
    """If one word changed, put in or left out at most makes a of b: what is left after the longest equal beginning and end is at most a word each."""
    lead = lambda x, y: F.coalesce(F.array_position(F.transform(F.arrays_zip(x, y), lambda z: F.coalesce(z["0"] == z["1"], F.lit(False))), False) - 1, F.lit(0))
    x, y = F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b)))
    rx, ry = F.reverse(a), F.reverse(b)
    before, after = lead(F.concat(x, F.array(F.lit("a b"))), F.concat(y, F.array(F.lit("c d")))), lead(F.concat(rx, F.array(F.lit("a b"))), F.concat(ry, F.array(F.lit("c d"))))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (before + after >= F.greatest(F.size(a), F.size(b)) - 1)


def dropped_lines(docs: DataFrame, p: LineDedup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, lines): the numbers of the lines that go, of each document that loses any."""
    p = p or LineDedup()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", text_key(F.col("text")))
    lines = cut(line_keys(texts, p), "lines")
    place = F.struct("id", "node", "line")
    firsts = cut(lines.groupBy("key").agg(F.min(place).alias("first"), F.max("words").alias("words"), F.max("halves").alias("halves"), F.count(F.lit(1)).alias("rows")), "firsts")
    halves = firsts.select("key", F.explode("halves").alias("half"))
    shared = cut(halves.groupBy("half").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "halves")
    near = join_split(halves, shared, ["half"]).select("key").distinct().join(firsts.select("key", "first"), "key")
    wanted = near.select("key", "first", F.col("first.id").alias("id"), F.col("first.node").alias("node"), F.col("first.line").alias("line")).groupBy("id", "node").agg(F.collect_list(F.struct("line", "key", "first")).alias("want"))
    wanted = wanted.withColumnsRenamed({"id": "of_id", "node": "of_node"})
    asked = lambda parts: F.transform("want", lambda w: F.struct(w["key"].alias("key"), w["first"].alias("first"), F.element_at(parts, w["line"] + 1).alias("text")))
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("node") == F.col("of_node"))).select(F.explode(once(F.split("text", "\n"), asked)).alias("w"))
    # the order of firsts with seven bytes of the digest, as millions of variants carry it
    brief = F.struct(F.col("w.first.id"), F.conv(F.hex(F.substring("w.first.node", 1, 7)), 16, 10).cast("long").alias("node"), F.col("w.first.line")).alias("first")
    survivors = cut(found.select("w.key", brief, "w.text").dropDuplicates(["key"]), "survivors")
    keyed = cut(variants(survivors), "variants")
    own = keyed.where("place < 0").select("variant", F.col("key").alias("own"), F.col("first").alias("own_first"))
    less = cut(keyed.where("place >= 0").groupBy("variant", "place").agg(F.min(F.struct("first", "key")).alias("least"), F.count(F.lit(1)).alias("rows")), "less")
    # changed words: all of a variant and place are within one word; the earliest stands for them
    changed = join_split(keyed.where("place >= 0"), less.where("rows > 1"), ["variant", "place"]).where("key != least.key").select("key", F.col("least.key").alias("other"))
    # a word more or less: the line that is the variant itself against those that lose a word
    shorter = less.groupBy("variant").agg(F.min("least").alias("least")).join(own, "variant").where("least.first < own_first").select(F.col("own").alias("key"), F.col("least.key").alias("other"))
    longer = keyed.where("place >= 0").join(own, "variant").where("own_first < first").select("key", F.col("own").alias("other"))
    pairs = changed.union(shorter).union(longer).distinct()
    told = survivors.select("key", F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("a"))
    other = told.select(F.col("key").alias("other"), F.col("a").alias("b"))
    alike = cut(pairs.join(told, "key").join(other, "other").where(one_edit(F.col("a"), F.col("b"))).select("key").distinct(), "alike")
    fate = firsts.select("key", "first", "rows").join(alike.withColumn("near", F.lit(True)), "key", "left").where("rows > 1 or near")
    gone = join_split(lines.select("key", "id", "node", "line"), cut(fate, "fate"), ["key"]).where((F.struct("id", "node", "line") != F.col("first")) | F.col("near"))
    return cut(gone.select("id", "node", "line").distinct().groupBy("id", "node").agg(F.sort_array(F.collect_list("line")).alias("lines")), "gone")


def dedup_lines(docs: DataFrame, p: LineDedup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the dropped lines, and the columns n_lines and n_dropped_lines."""
    gone = dropped_lines(docs, p, id_col, text_col).select(F.col("id").alias("gone_id"), F.col("node").alias("gone_node"), F.col("lines").alias("gone_lines"))
    text = F.col(text_col)
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone_lines"))
    left = once(parts, lambda of: F.array_join(F.transform(stay, lambda i: F.get(of, i)), "\n"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col("gone_id")) & (text_key(docs[text_col]) == F.col("gone_node")), "left")
    return joined.select(*[(F.when(F.col("gone_lines").isNull(), text).otherwise(left).alias(c) if c == text_col else docs[c]) for c in docs.columns], F.size(parts).alias("n_lines"), F.coalesce(F.size("gone_lines"), F.lit(0)).alias("n_dropped_lines"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text that is left, n_lines and n_dropped_lines of each document."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
