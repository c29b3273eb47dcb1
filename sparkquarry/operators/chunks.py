"""Chunks along syntax: classes, functions outside of them, and what lies between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text

#: The heading of a chunk by kind.
HEADINGS = {"class": "// Class in ", "function": "// Function in ", "module_level": "// Module level code in "}


def _shown(symbols: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Symbols whose lines hold more than blanks; all of them where only intervals are asked for."""
    if lines is None:
        return symbols
    held = symbols.join(lines, "rel_path").withColumn("body", paths.line_range(F.col("lines"), F.col("start_line"), F.col("end_line"))).drop("lines")
    return held.where(~paths.blank(F.col("body")))


def class_intervals(symbols: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Every class, nested ones too."""
    return _shown(symbols.where("kind = 'class'"), lines)


def function_intervals(symbols: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Functions that lie in no class and in no function before them in the file's order.

    Containment is transitive, so what an absorbed function would hide is hidden by what absorbs it, and the
    earlier ones need no walk. Whatever contains a function begins before it, so a function that ends after all that begin before it
    is outside at once; only the others, few in a file, are joined with what might contain them."""
    classes, functions = class_intervals(symbols, lines), _shown(symbols.where("kind = 'function'"), lines)
    every = classes.select("rel_path", "start_line", "end_line", F.lit(-1).cast("long").alias("place")).unionByName(functions.select("rel_path", "start_line", "end_line", F.col("ord").cast("long").alias("place")))
    before = Window.partitionBy("rel_path").orderBy("start_line", F.desc("end_line"), "place").rowsBetween(Window.unboundedPreceding, -1)
    doubtful = every.withColumn("reached", F.max("end_line").over(before)).where("place >= 0 AND reached >= end_line").alias("a")
    other = every.alias("o")
    inside = (
        (F.col("a.rel_path") == F.col("o.rel_path"))
        & (F.col("o.place") < F.col("a.place"))
        & (F.col("a.start_line") >= F.col("o.start_line"))
        & (F.col("a.end_line") <= F.col("o.end_line"))
    )
    absorbed = doubtful.join(other, inside, "left_semi").select("rel_path", F.col("place").alias("ord"))
    return functions.join(absorbed, ["rel_path", "ord"], "left_anti")


def gaps(intervals: DataFrame, n_lines: DataFrame) -> DataFrame:
    """(rel_path, start_line, end_line) of the lines between and after intervals; files are given by (rel_path, n_lines)."""
    before = Window.partitionBy("rel_path").orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    opened = intervals.select("rel_path", (F.coalesce(F.max("end_line").over(before), F.lit(0)) + 1).alias("from"), (F.col("start_line") - 1).alias("to"))
    ends = intervals.groupBy("rel_path").agg(F.max("end_line").alias("last"))
    trailing = n_lines.join(ends, "rel_path", "left").select("rel_path", (F.greatest(F.coalesce("last", F.lit(0)), F.lit(0)) + 1).alias("from"), F.col("n_lines").alias("to"))
    return opened.unionByName(trailing).where(F.col("from") <= F.col("to")).select("rel_path", F.col("from").alias("start_line"), F.col("to").alias("end_line"))


def chunk_text(kind: str, path: Column, body: Column) -> Column:
    return F.concat(F.lit(HEADINGS[kind]), path, F.lit("\n"), body)


def chunk_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(rel_path, part, ord, type, name, start_line, end_line, text) of all files (rel_path, content); part and ord give
    the order within a file: classes, functions, then what lies between."""
    lines = files.select("rel_path", paths.lines(F.col("content")).alias("lines"))
    classes, functions = class_intervals(symbols, lines), function_intervals(symbols, lines)
    both = classes.select("rel_path", "start_line", "end_line").unionByName(functions.select("rel_path", "start_line", "end_line"))
    open_ = gaps(both, lines.select("rel_path", F.size("lines").alias("n_lines"))).join(lines, "rel_path").withColumn("body", paths.line_range(F.col("lines"), F.col("start_line"), F.col("end_line"))).where(~paths.blank(F.col("body")))
    parts = [
        rows.select("rel_path", F.lit(k).alias("part"), place.cast("long").alias("ord"), F.lit(kind).alias("type"), name.alias("name"), F.col("start_line").cast("int"), F.col("end_line").cast("int"), chunk_text(kind, F.col("rel_path"), F.col("body")).alias("text"))
        for k, (rows, kind, place, name) in enumerate(((classes, "class", F.col("ord"), F.col("name")), (functions, "function", F.col("ord"), F.col("name")), (open_, "module_level", F.col("start_line"), F.lit("global"))))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def summary_chunks(summarised: DataFrame) -> DataFrame:
    """A chunk for each file (rel_path, summary) whose summary says something."""
    return summarised.where("summary IS NOT NULL AND summary <> ''").select(
        "rel_path", F.lit("file_summary").alias("type"), F.lit("summary").alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        F.concat(F.lit("// File summary for "), F.col("rel_path"), F.lit("\n"), F.col("summary")).alias("text"),
    )


def annotated(chunks: DataFrame) -> DataFrame:
    """Adds `why` from the columns of a blame."""
    return chunks.withColumn("why", text.why(F.col("sha"), F.col("author"), F.col("message")))
