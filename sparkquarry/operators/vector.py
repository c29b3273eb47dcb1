"""Cosine similarity and the nearest chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Questions that a chunk meets at once.
BLOCK = 64


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def cosine(one: Column, two: Column) -> Column:
    """Zero for vectors of different length and for those without one; doubles throughout."""
    a, b = one.cast("array<double>"), two.cast("array<double>")
    return _cosine(a, b, F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b)))


def _cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    norms = norm_a * norm_b
    return F.when((F.size(a) == F.size(b)) & (norms > 0), _dot(a, b) / F.nullif(norms, F.lit(0.0))).otherwise(F.lit(0.0))


def with_norm(chunks: DataFrame) -> DataFrame:
    """Adds each vector as doubles, and its norm, so that neither is computed for each question anew."""
    held = chunks.withColumn("vector", F.col("embedding").cast("array<double>"))
    return held.withColumn("norm", F.sqrt(_dot(F.col("vector"), F.col("vector"))))


def similarities(chunks: DataFrame, query: list[float]) -> DataFrame:
    """Every chunk with a vector and its similarity to the query. The query is part of the plan: no join."""
    return chunks.where(F.size("embedding") > 0).withColumn("similarity", cosine(F.col("embedding"), F.lit([float(x) for x in query]) if query else F.array().cast("array<double>")))


def nearest(chunks: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k nearest, ties by `ord`: each task keeps k rows, and nothing is sorted as a whole."""
    if k < 0:
        raise ValueError("k must not be negative")
    return similarities(chunks, query).orderBy(F.desc("similarity"), F.asc("ord")).limit(k)


def similarities_each(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Every chunk with a vector and its similarity to every query (query_id, embedding): the queries stand in blocks of about BLOCK,
    and a chunk meets each block once, by an equality on its number."""
    asked = with_norm(queries.where(F.size("embedding") > 0))
    blocks = max(1, -(-asked.count() // BLOCK))
    held = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "vector", "norm")).alias("queries"))
    met = with_norm(chunks.where(F.size("embedding") > 0)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(held, "block")
    each = F.transform("queries", lambda q: F.struct(q["query_id"].alias("query_id"), _cosine(F.col("vector"), q["vector"], F.col("norm"), q["norm"]).alias("similarity")))
    return met.select(*chunks.columns, F.explode(each).alias("found")).select(*chunks.columns, "found.query_id", "found.similarity")


def nearest_each(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest of each query, ties by `ord`: every task keeps k rows a query before the shuffle."""
    if k < 0:
        raise ValueError("k must not be negative")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("ord")))
    return similarities_each(chunks, queries).withColumn("place", place).where(F.col("place") <= k).drop("place")
