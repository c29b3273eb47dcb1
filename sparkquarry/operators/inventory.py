"""The inventory of a file table: (ord, rel_path, content or size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def supported(files: DataFrame, ignore: tuple[str, ...] = paths.IGNORED) -> DataFrame:
    """Rows of supported files outside ignored directories, with `language`; one narrow pass, no shuffle."""
    return files.where(~paths.ignored(F.col("rel_path"), ignore)).withColumn("language", paths.language(F.col("rel_path"))).where(F.col("language").isNotNull())


def passed_over(files: DataFrame, ignore: tuple[str, ...] = paths.IGNORED) -> DataFrame:
    return files.where(paths.ignored(F.col("rel_path"), ignore))


def language_counts(inventory: DataFrame) -> DataFrame:
    """(language, n_files, first_ord), to be shown in the order in which languages are first seen."""
    return inventory.groupBy("language").agg(F.count("*").alias("n_files"), F.min("ord").alias("first_ord"))


def total_size(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))
