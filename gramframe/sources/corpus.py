"""Corpora as DataFrames: lines of documents or text files, tokens, limits and groups of lines, word lists, artefacts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramframe.sources.stage import sized

START, STOP, UNK = "<s>", "</s>", "UNK"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): the lines of each text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def text_lines(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """(doc_id, line_no, line) of text files, gzip or plain; doc_id is a number of the file. limit: lines of each file, 0 for all.

    Lines of a split of a file follow each other, so a line's number is its place in its split after the lines of the file's earlier
    splits; only a row a split is sorted.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select(F.xxhash64(meta["file_path"]).alias("doc_id"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = rows.groupBy("doc_id", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = splits.select("doc_id", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"))
    out = rows.join(sized(base), ["doc_id", "block"]).select("doc_id", (F.col("at") + F.col("base")).alias("line_no"), "line")
    return out.where(F.col("line_no") < limit) if limit else out


def tokens(line: Column, trim: bool = False, strict: bool = False) -> Column:
    """Words between single spaces. strict keeps inner empty words, and drops those at the end only."""
    words = F.split(F.trim(line) if trim else line, " ")
    if not strict:
        return F.filter(words, lambda x: x != "")
    solid = F.filter(F.transform(words, lambda x, i: F.when(x != "", i + 1).otherwise(0)), lambda i: i > 0)
    return F.slice(words, 1, F.coalesce(F.array_max(solid), F.lit(0)))


def tokenized(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, line_no, words) of lines that have a word."""
    return lines(docs).where(F.trim("line") != "").select("doc_id", "line_no", tokens(F.col("line"), **how).alias("words"))


def padded(words: Column) -> Column:
    return F.concat(F.array(F.lit(START)), words, F.array(F.lit(STOP)))


def end_marked(words: Column) -> Column:
    return F.concat(words, F.array(F.lit(STOP)))


def numbered(rows: DataFrame, partitions_by: str = "doc_id", order: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """rows with ordinal, their place in the order, by counts of each document and a sum of those before it: no sort of all rows in one task.

    Only (document, lines) pairs are summed in one window, by ranges of the document number.
    """
    per = rows.groupBy(partitions_by).agg(F.count(F.lit(1)).alias("n"))
    block = F.floor(F.col(partitions_by) / 4096)
    inner = F.sum("n").over(Window.partitionBy("block").orderBy(partitions_by).rowsBetween(Window.unboundedPreceding, -1))
    sums = per.withColumn("block", block)
    before = sums.groupBy("block").agg(F.sum("n").alias("m"))
    outer = before.select("block", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    start = sums.withColumn("inner", F.coalesce(inner, F.lit(0))).join(outer, "block").select(partitions_by, (F.col("inner") + F.col("base")).alias("start"))
    place = F.row_number().over(Window.partitionBy(partitions_by).orderBy(*[c for c in order if c != partitions_by])) - 1
    return rows.withColumn("place", place).join(start, partitions_by).withColumn("ordinal", F.col("start") + F.col("place")).drop("place", "start")


def limited(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in the order of documents and lines, with ordinal; 0 for all. Each task keeps n rows at most, and only the last n of them are numbered."""
    if not n:
        return numbered(rows)
    order = ("doc_id", "line_no")
    return rows.orderBy(*order).limit(n).withColumn("ordinal", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def line_groups(rows: DataFrame, size: int) -> DataFrame:
    """rows with group_id: runs of `size` lines that follow each other."""
    return numbered(rows).withColumn("group_id", F.floor(F.col("ordinal") / size))


def in_groups(rows: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of the groups of a batch."""
    return rows.where(F.col("group_id").isin(ids))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a file with a word a line."""
    return spark.read.text(path).select(F.col("value").alias("word")).where("word <> ''").distinct()


def external_scores(rows: DataFrame, *keep: str) -> DataFrame:
    """(word, log10p, columns to keep) from a scorer's output lines (line): 'word=id order log10p' by tabs; other lines, such as a trailer,
    have none. A word may itself have '=', tabs or line separators: it ends at the last '=' that the three numbers follow."""
    form = r"(?s)^(.+)=[0-9]+[ \t][0-9]+[ \t](-?[0-9.eE+-]+)\z"
    part = lambda i: F.regexp_extract("line", form, i)
    return rows.where(F.col("line").rlike(form)).select(part(1).alias("word"), part(2).cast("double").alias("log10p"), *keep)


def piped_scores(rows: DataFrame, command: str) -> DataFrame:
    """The output lines of an external scorer that reads lines and writes lines, run once a partition."""
    return rows.sparkSession.createDataFrame(rows.select("line").rdd.map(lambda r: r[0]).pipe(command).map(lambda x: (x,)), "line string")


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_text(df: DataFrame, path: str, *columns: str) -> None:
    """Columns joined by a space, a row a line."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def save_groups(groups: DataFrame, path: str) -> None:
    """Rows with group_id, a folder a group, so that a batch reads its own groups alone."""
    groups.repartition("group_id").write.mode("overwrite").partitionBy("group_id").parquet(path)


def load_groups(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The written rows of a batch of groups."""
    return in_groups(spark.read.parquet(path), ids)


def save_model(path: str, config: dict, **tables: DataFrame) -> None:
    """A model: its parameters and indexes as Parquet, its configuration as JSON."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        save(df, f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"config": config, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """Configuration and tables by name."""
    about = json.loads(spark.read.text(f"{path}/config").first()[0])
    return about["config"], {name: load(spark, f"{path}/{name}") for name in about["tables"]}


def save_count_runs(df: DataFrame, path: str) -> None:
    """suffix,word,count in order of key length, key and word."""
    df.repartitionByRange(F.size(F.split("suffix", "_")), "suffix", "word").sortWithinPartitions(F.size(F.split("suffix", "_")), "suffix", "word").write.mode("overwrite").csv(path)


def load_count_runs(spark: SparkSession, *paths: str) -> list[DataFrame]:
    return [spark.read.csv(p, "suffix string, word string, c long") for p in paths]


def copy_run(spark: SparkSession, source: str, target: str) -> None:
    """A run as it is, under another path: one that has no partner in a round of merges."""
    spark.read.text(source).write.mode("overwrite").text(target)
