"""Commit logs and blame lines of a git working tree, through the git command."""

from __future__ import annotations

import subprocess
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import arrow_map, shared_folder

COMMIT_SCHEMA = "rel_path string, sha string, author_name string, author_email string, message string, committed timestamp_ntz, ord long"
BLAME_SCHEMA = "rel_path string, line_no int, sha string"
#: Rows of a history that are written at once.
ROWS = 50_000


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], check=True, capture_output=True).stdout.decode("utf-8", "replace")


def top_level(root: str) -> str | None:
    """The working tree that holds `root`, or None."""
    try:
        return _git(root, "rev-parse", "--show-toplevel").strip()
    except (subprocess.CalledProcessError, FileNotFoundError):
        return None


def _local(seconds: str, zone: str) -> datetime:
    """The wall clock at the commit's own offset."""
    sign = -1 if zone[0] == "-" else 1
    offset = timedelta(hours=int(zone[1:3]), minutes=int(zone[3:5])) * sign
    return datetime.fromtimestamp(int(seconds), timezone(offset)).replace(tzinfo=None)


def log(root: str) -> Iterator[tuple]:
    """Rows of COMMIT_SCHEMA from one reading of the history of `root`, newest first, as git writes it; paths relative to `root`, so a
    directory below the top level works too. Of a merge, the files count that differ from all its parents, as they do in the history of a file.
    Fields stand between marks made for this reading, which no message holds."""
    mark = uuid.uuid4().hex
    form = f"{mark}C" + f"{mark}F".join(["%H", "%an", "%ae", "%ct", "%cd", "%B", ""])
    command = ["git", "-C", root, "log", "-z", "-c", "--relative", "--name-only", "--no-renames", "--date=format:%z", f"--format={form}", "--", "."]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        for k, part in enumerate(_records(run.stdout, f"{mark}C".encode())):
            sha, name, email, seconds, zone, message, names = part.decode("utf-8", "replace").split(f"{mark}F")
            for rel in dict.fromkeys(x for x in names.lstrip("\n\0").split("\0") if x):
                yield rel, sha, name, email, message.strip("\n"), _local(seconds, zone), k


def _records(stream, mark: bytes) -> Iterator[bytes]:
    """What stands behind each mark, without holding more than a part of the stream."""
    held = b""
    while block := stream.read(1 << 20):
        *whole, held = (held + block).split(mark)
        yield from (x for x in whole if x.strip(b"\n\0"))
    if held.strip(b"\n\0"):
        yield held


def file_commits(spark: SparkSession, root: str) -> DataFrame:
    """The history as a table; empty outside of a working tree or without commits. It goes to the shared folder as it is read, ROWS at
    a time, so the driver never holds it."""
    none = spark.createDataFrame([], COMMIT_SCHEMA)
    if not top_level(root):
        return none
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    rows, found = log(root), False
    while part := list(islice(rows, ROWS)):
        spark.createDataFrame(part, COMMIT_SCHEMA).write.mode("append").parquet(folder)
        found = True
    return spark.read.schema(COMMIT_SCHEMA).parquet(folder) if found else none


def commits(found: DataFrame) -> DataFrame:
    """(sha, author_name, message, committed), each commit once."""
    return found.select("sha", "author_name", "message", "committed").dropDuplicates(["sha"])


def blame(files: DataFrame, root: str) -> DataFrame:
    """BLAME_SCHEMA for every line of every file: one call a file, in the tasks. Files unknown to git have no lines."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            names, numbers, shas = [], [], []
            for rel in batch.column(0).to_pylist():
                try:
                    out = _git(root, "blame", "--line-porcelain", "--", rel)
                except (subprocess.CalledProcessError, FileNotFoundError):
                    continue
                head = True
                for row in out.split("\n"):
                    if row.startswith("\t"):
                        head = True
                    elif head and row:
                        sha, _, number, *_ = row.split(" ")
                        names.append(rel), numbers.append(int(number)), shas.append(sha)
                        head = False
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(shas, pa.string())], ["rel_path", "line_no", "sha"])

    return arrow_map(files.select("rel_path"), batches, BLAME_SCHEMA)
