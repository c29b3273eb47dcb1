"""Incremental re-indexing: a stream of file versions keeps a snapshot of hashes and derived rows up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache
from ..session import kept
from ..sources.store import Snapshot


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each file in a batch of (rel_path, version, content)."""
    newest = versions.groupBy("rel_path").agg(F.max_by(F.struct("content"), "version").alias("last"))
    return newest.select("rel_path", F.col("last.content").alias("content"))


def changed(versions: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a batch whose content isn't what the snapshot (key, sha256, summary) knows."""
    return cache.misses(cache.with_hash(latest(versions)), known)


def start(stream: DataFrame, snapshot: Snapshot, derive: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch: only files with new content reach `derive`, which gives (key, sha256, summary).

    What `derive` gives is kept before it is used, so a service behind it is called once for a row. A batch that is replayed after a
    failure finds its files known and changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        known = snapshot.read()
        fresh = kept(derive(changed(batch, known)).select("key", "sha256", "summary"))
        if not fresh.isEmpty():
            snapshot.write(cache.upsert(known, fresh))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
