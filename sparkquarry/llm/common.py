"""What the text operators share: table access, Arrow batches, checkpoints, words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import kept as checkpointed  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts of ASCII only take the faster built-in, which does the same to them."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text as UTF-8 bytes): all that the Arrow functions get, whatever else the table has."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that the table doesn't have, for columns beside its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text_col: str) -> Column:
    """What tells rows of one id, or of none, apart."""
    return F.xxhash64(F.col(text_col).cast("binary"))


def keep_first(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of `docs` for each `component` of its rows (id, key, component), in the order of ids, null ones last, then keys;
    of rows alike in id and key one. Rows that go are looked up; those that stay don't move unless they repeat."""
    row = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    firsts = grouped.groupBy("component").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone_id, gone_key, copy = free_names(docs, "gone_id", "gone_key", "copy")
    gone = grouped.join(firsts, "component").where(row != F.col("first")).select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct()
    left = docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col(gone_id)) & text_key(text_col).eqNullSafe(F.col(gone_key)), "left_anti")
    if grouped.groupBy("id", "key").count().where("count > 1").limit(1).count():
        alike = Window.partitionBy(F.col(id_col).cast("long"), text_key(text_col)).orderBy(text_key(text_col))
        left = left.withColumn(copy, F.row_number().over(alike)).where(F.col(copy) == 1).drop(copy)
    return left


def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch one at a time, so that a batch of long texts isn't held twice."""
    columns = [batch.column(i) for i in range(batch.num_columns)]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


class Remembered:
    """What a worker remembers, in bounded room: when half of it is full, what was not asked for since the last time is forgotten.

    `young` is looked up first and directly; `older` finds the rest and makes it young again."""

    def __init__(self, most: int, cost: int):
        self.most, self.cost, self.held = most, cost, 0
        self.young: dict = {}
        self.old: dict = {}

    def keep(self, key: str, value: bytes) -> None:
        self.young[key] = value
        self.held += len(key) + len(value) + self.cost

    def keep_all(self, found: dict[str, bytes]) -> None:
        self.young.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + self.cost * len(found)

    def older(self, key: str) -> bytes | None:
        if (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value

    def trim(self) -> None:
        if 2 * self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
