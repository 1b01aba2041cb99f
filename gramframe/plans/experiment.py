"""Experiments: a configuration from a file or the command line, and stages that run in order and share what they made."""

from __future__ import annotations

import argparse
import dataclasses
import logging
from collections.abc import Callable, Iterable
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession

from gramframe.sources.stage import task


@dataclasses.dataclass(frozen=True)
class Config:
    """Paths, limits (0 for all lines), cuts and training of an experiment."""

    train_path: str = ""
    test_path: str = ""
    experiment_path: str = "work"
    lines: int = 0
    line_group_size: int = 100
    min_word_count: int = 100
    min_feature_count: int = 5
    hash_features: float = 1.0
    epochs: int = 10
    l2: float = 0.1

    @classmethod
    def of(cls, values: dict[str, str]) -> Config:
        """By names as here or in camel case; unknown names are an error."""
        kinds = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        snake = {k: "".join("_" + c.lower() if c.isupper() else c for c in k) for k in values}
        if unknown := sorted(k for k, s in snake.items() if s not in kinds):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{s: kinds[s](values[k]) for k, s in snake.items()})

    @classmethod
    def from_file(cls, path: str) -> Config:
        """A setting a line, 'name: value'; # begins a comment."""
        with open(path, encoding="utf-8") as f:
            pairs = [line.split("#", 1)[0].partition(":") for line in f]
        return cls.of({k.strip(): v.strip() for k, colon, v in pairs if colon})

    @classmethod
    def from_args(cls, argv: list[str]) -> Config:
        """--name value, after the settings of --config, if there is one."""
        parser = argparse.ArgumentParser()
        parser.add_argument("--config")
        for f in dataclasses.fields(cls):
            parser.add_argument("--" + f.name.replace("_", "-"), dest=f.name, type=type(f.default))
        got = vars(parser.parse_args(argv))
        path = got.pop("config")
        base = cls.from_file(path) if path else cls()
        return dataclasses.replace(base, **{k: v for k, v in got.items() if v is not None})


class Stage(Protocol):
    name: str

    def run(self, spark: SparkSession, config: Config, made: dict[str, Any]) -> dict[str, Any]: ...


@dataclasses.dataclass(frozen=True)
class Step:
    """A stage from a function of (spark, config, made), which returns what it adds."""

    name: str
    make: Callable[[SparkSession, Config, dict[str, Any]], dict[str, Any]]

    def run(self, spark: SparkSession, config: Config, made: dict[str, Any]) -> dict[str, Any]:
        return self.make(spark, config, made)


@dataclasses.dataclass(frozen=True)
class Experiment:
    stages: tuple[Stage, ...]

    def run(self, spark: SparkSession, config: Config) -> dict[str, Any]:
        """All that the stages made, by name; each stage's jobs carry its name."""
        made: dict[str, Any] = {}
        for stage in self.stages:
            with task(spark, stage.name):
                made |= stage.run(spark, config, made)
        return made


@runtime_checkable
class LanguageModel(Protocol):
    """Adds p and log_prob to n-grams."""

    def score(self, grams: DataFrame) -> DataFrame: ...


class Objective(Protocol):
    """Value and gradient (pid, g) over a batch."""

    def value(self, batch: DataFrame, theta: Callable[[Column], Column]) -> DataFrame: ...

    def gradient(self, batch: DataFrame, theta: Callable[[Column], Column]) -> DataFrame: ...


@dataclasses.dataclass(frozen=True)
class Index:
    """Ids of keys as a table (key, id)."""

    table: DataFrame

    def size(self) -> int:
        return self.table.count()

    def apply(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with id, -1 for keys that are not indexed."""
        from pyspark.sql import functions as F

        found = self.table.select(F.col("key").alias(key), F.col("id").alias("found"))
        return rows.join(found, key, "left").withColumn("id", F.coalesce("found", F.lit(-1).cast("long"))).drop("found")

    def unapply(self, rows: DataFrame, id_col: str = "id") -> DataFrame:
        """rows with key."""
        return rows.join(self.table.withColumnRenamed("id", id_col), id_col, "left")

    def pairs(self) -> Iterable[tuple[Any, int]]:
        return ((r["key"], r["id"]) for r in self.table.select("key", "id").toLocalIterator())


def console(level: int = logging.INFO) -> None:
    """Log to the console with the time of each entry."""
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
