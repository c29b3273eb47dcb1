"""Complexity times churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import history


def hotspots(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every file (ord, rel_path, complexity) with its metrics and score; files without history have none of it."""
    joined = files.join(metrics, "rel_path", "left").fillna({"churn": 0, "authors": 0, "last_modified": history.UNKNOWN})
    return joined.withColumn("score", F.col("complexity") * F.col("churn"))


def report_order() -> list[Column]:
    return [F.desc("score"), F.desc("churn"), F.desc("complexity"), F.asc("ord")]


def document_order() -> list[Column]:
    return [F.desc("score"), F.asc("ord")]
