"""Prompts, citations and context, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands for a missing summary.
NO_SUMMARY = "No summary available."
FILE_SYSTEM = "Say in two or three sentences what this source file is for, what it is responsible for, and where it stands in the system."
MODULE_SYSTEM = "Say in two or three sentences what this directory of source files is for as a whole. Use nothing but the summaries of its files."
OVERVIEW_SYSTEM = "Write an architecture overview in Markdown from the summaries of a system's modules, with sections on the system, the structure of its modules, and design principles and data flows."
ANSWER_SYSTEM = "Answer the question about a codebase from the given excerpts. Name the files and lines that the answer rests on."


def file_prompt(path: Column, content: Column) -> Column:
    return F.concat(F.lit("Path of the file: "), path, F.lit("\nIts source:\n"), content)


def file_line(path: Column, summary: Column) -> Column:
    return F.concat(F.lit("- "), path, F.lit(": "), F.coalesce(summary, F.lit(NO_SUMMARY)))


def module_prompt(directory: Column, file_lines: Column) -> Column:
    return F.concat(F.lit("Directory: "), directory, F.lit("\nWhat its files are for:\n"), file_lines)


def module_section(directory: Column, summary: Column) -> Column:
    return F.concat(F.lit("## `"), directory, F.lit("`\n"), summary, F.lit("\n"))


def overview_prompt(sections: Column) -> Column:
    return F.concat(F.lit("What the modules of the system are for:\n\n"), sections)


#: Fixed form: a path, its lines and the type of the chunk.
def citation(path: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.concat(path, F.lit(" (Lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(", Type: "), kind, F.lit(")"))


def context_block(cite: Column, similarity: Column, why: Column, text: Column) -> Column:
    """Similarity is shown as four digits of the exact value's nearest multiple of 1/10000."""
    shown = F.format_string("%.4f", F.round(similarity, 4))
    note = F.when(why.isNotNull(), F.concat(F.lit("Why: "), why, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), cite, F.lit("] similarity "), shown, F.lit("\n"), note, text, F.lit("\n"))


def why(sha: Column, author: Column, message: Column) -> Column:
    """Null where the commit isn't known."""
    said = F.concat(author, F.lit(" changed this last, in "), sha, F.lit(": '"), message, F.lit("'"))
    return F.when(sha != "Unknown", said)
