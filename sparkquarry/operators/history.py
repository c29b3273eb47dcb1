"""Change history: (rel_path, sha, author_name, author_email, committed, ord) and blame lines (rel_path, line_no, sha)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, NO_MESSAGE = "Unknown", "No commit info available"


def author() -> Column:
    return F.coalesce(F.nullif(F.col("author_email"), F.lit("")), F.nullif(F.col("author_name"), F.lit("")))


def churn(file_commits: DataFrame) -> DataFrame:
    return file_commits.groupBy("rel_path").agg(F.count("*").alias("churn"))


def authors(file_commits: DataFrame) -> DataFrame:
    return file_commits.groupBy("rel_path").agg(F.count_distinct(author()).alias("authors"))


def last_modified(file_commits: DataFrame) -> DataFrame:
    """The time of the first commit in log order, in that commit's own offset; timestamps carry local time."""
    return file_commits.groupBy("rel_path").agg(F.date_format(F.min_by("committed", "ord"), "yyyy-MM-dd HH:mm:ss").alias("last_modified"))


def metrics(file_commits: DataFrame) -> DataFrame:
    """All three in one aggregation: rows are combined by file and author before they move, then by file, so a file
    with very many commits is no more work for its last task than it has authors."""
    return file_commits.groupBy("rel_path").agg(
        F.count("*").alias("churn"),
        F.count_distinct(author()).alias("authors"),
        F.date_format(F.min_by("committed", "ord"), "yyyy-MM-dd HH:mm:ss").alias("last_modified"),
    )


def valid_sha(token: Column) -> Column:
    """A blame line's first token without its boundary mark, if it is seven hex digits or more, else null."""
    bare = F.regexp_replace(token, r"^\^", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{7,}$"), bare)


def blame_ranges(ranges: DataFrame, blame: DataFrame) -> DataFrame:
    """(rel_path, ord, sha) of every commit that a line range holds, once. Equality on the file carries the join; the
    range is tested on what meets there."""
    r, b = ranges.alias("r"), blame.alias("b")
    inside = (F.col("r.rel_path") == F.col("b.rel_path")) & F.col("b.line_no").between(F.col("r.start_line"), F.col("r.end_line"))
    return r.join(b, inside).select("r.rel_path", "r.ord", "b.sha").distinct()


def blame_latest(ranges: DataFrame, blame: DataFrame, commits: DataFrame) -> DataFrame:
    """Every range with the latest commit of its lines, ties by sha: sha (eight digits), author, message (first line) and
    date. Ranges without a known commit have the defaults; commits that can't be found are passed over."""
    latest = (
        blame_ranges(ranges, blame)
        .join(commits, "sha")
        .groupBy("rel_path", "ord")
        .agg(F.max_by(F.struct("sha", "author_name", "message", "committed"), F.struct("committed", "sha")).alias("c"))
    )
    text = F.coalesce(F.get(F.split("c.message", "\n"), F.lit(0)), F.lit(""))
    described = latest.select(
        "rel_path", "ord", F.substring("c.sha", 1, 8).alias("sha"), F.col("c.author_name").alias("author"), text.alias("message"), F.date_format("c.committed", "yyyy-MM-dd").alias("date")
    )
    return ranges.join(described, ["rel_path", "ord"], "left").fillna({"sha": UNKNOWN, "author": UNKNOWN, "message": NO_MESSAGE, "date": UNKNOWN})
