"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, unless the session says otherwise: texts can be long, and a worker holds a batch or two.
BATCH, USUAL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, whose path needn't hold it, once per application.

    The archive goes through Spark's own file server, as with --py-files."""
    if spark.conf.get(BATCH) == USUAL_BATCH and not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, "8m")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that spark.checkpoint.dir names. Without that setting, a local session takes a temporary folder
    and a cluster one next to its warehouse."""
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="checkpoint-") if context.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not given.isDefined():
        context.setCheckpointDir(folder)
    return folder


def kept(table: DataFrame) -> DataFrame:
    """The table cut off from its plan through the shared folder, so that nothing it took is done again."""
    shared_folder(table.sparkSession)
    return table.checkpoint()


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
