"""Columns over relative paths, text lines and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of supported languages, and directories that a scan passes over.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".eggs", ".mypy_cache", ".pytest_cache", "target", "out")
#: Names of files that nothing needs to import.
ENTRY_POINTS = ("main.py", "cli.py", "index.js", "app.py", "setup.py", "wsgi.py")
#: What ends a line.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"


def extension(path: Column) -> Column:
    """The last suffix in lower case; a name that only begins with dots has none."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    """The path without its last suffix."""
    suffix = F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)
    return F.substring(path, 1, F.length(path) - F.length(suffix))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    """The parent directory, the root as a dot."""
    parent = dirname(path)
    return F.when(parent == "", F.lit(".")).otherwise(parent)


def module(path: Column) -> Column:
    """The dotted name under which a file can be imported."""
    return F.replace(stem(path), F.lit("/"), F.lit("."))


def language(path: Column) -> Column:
    """The language of a supported extension, else null."""
    out = F.lit(None).cast("string")
    for name in dict.fromkeys(LANGUAGES.values()):
        out = F.when(extension(path).isin([e for e, lang in LANGUAGES.items() if lang == name]), F.lit(name)).otherwise(out)
    return out


def ignored(path: Column, names: tuple[str, ...] = IGNORED) -> Column:
    """Whether a directory on the way to the file, not the file itself, is one of the names. No names: none is."""
    if not names:
        return F.lit(False)
    return F.arrays_overlap(F.split(dirname(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), F.array(*map(F.lit, names)))


def normalized(path: Column) -> Column:
    """The path without empty, dot and resolved parent steps; parent steps beyond the root stay."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))

    def step(done: Column, x: Column) -> Column:
        back = (x == "..") & (F.size(done) > 0) & ~F.coalesce(F.element_at(done, -1) == "..", F.lit(False))
        return F.when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))

    joined = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def entry_point(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.isin(*ENTRY_POINTS) | name.startswith("test_")


def blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def lines(text: Column) -> Column:
    """Lines by any Unicode line end; a last empty line is none."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_range(text_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from one, within what there is."""
    first = F.greatest(start, F.lit(1))
    n = F.greatest(F.least(end, F.size(text_lines)) - first + 1, F.lit(0))
    return F.array_join(F.slice(text_lines, first.cast("int"), n.cast("int")), "\n")
