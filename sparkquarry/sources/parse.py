"""Symbols, imports and complexity of source files, one parse each, in Arrow batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from . import scripts

_SYMBOL = "array<struct<name:string,start_line:int,end_line:int>>"
SCHEMA = f"ord long, rel_path string, language string, classes {_SYMBOL}, functions {_SYMBOL}, imports array<string>, complexity int, error string"
_ARROW_SYMBOL = pa.list_(pa.struct([("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
_ARROW = {"classes": _ARROW_SYMBOL, "functions": _ARROW_SYMBOL, "imports": pa.list_(pa.string()), "complexity": pa.int32(), "error": pa.string()}
_EMPTY = {"classes": [], "functions": [], "imports": []}


def analyse_python(code: str) -> dict:
    """Classes and functions in the order in which they begin, outer before inner; module names of imports; one plus
    the number of if, for, while, except and conditional expressions and of boolean operators between two
    operands. An elif isn't counted: it belongs to its if."""
    tree = ast.parse(code)
    classes, functions, imports = [], [], set()
    complexity = 1
    elifs = set()
    rows = code.split("\n")
    for node in ast.walk(tree):
        if isinstance(node, ast.If):
            for inner in node.orelse[:1]:
                if isinstance(inner, ast.If) and len(node.orelse) == 1 and rows[inner.lineno - 1].encode()[inner.col_offset :].startswith(b"elif"):
                    elifs.add(id(inner))
    for node in ast.walk(tree):
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            (classes if isinstance(node, ast.ClassDef) else functions).append((node.lineno, node.col_offset, node.end_lineno, node.name))
        elif isinstance(node, ast.Import):
            imports |= {alias.name for alias in node.names}
        elif isinstance(node, ast.ImportFrom):
            imports.add("." * node.level + (node.module or ""))
        elif isinstance(node, ast.BoolOp):
            complexity += len(node.values) - 1
        elif isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)):
            complexity += id(node) not in elifs
    order = lambda found: [{"name": n, "start_line": s, "end_line": e} for s, _, e, n in sorted(found)]
    return {"classes": order(classes), "functions": order(functions), "imports": sorted(imports), "complexity": complexity}


_DEFINITION = re.compile(r"^([ \t]*)(?:async[ \t]+)?(class|def)[ \t]+(\w+)")
_IMPORT = re.compile(r"^[ \t]*import[ \t]+([\w., \t]+)")
_FROM = re.compile(r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import\b")
_DECISION = re.compile(r"^[ \t]*(?:async[ \t]+)?(?:if|for|while|except)\b|\band\b|\bor\b")


def recover_python(code: str) -> dict:
    """What lines and indents tell of a file that doesn't parse."""
    rows = code.split("\n")
    classes, functions, imports, complexity = [], [], set(), 1
    for i, row in enumerate(rows):
        if m := _DEFINITION.match(row):
            end = i
            for k in range(i + 1, len(rows)):
                if rows[k].strip():
                    if len(rows[k]) - len(rows[k].lstrip()) <= len(m[1]):
                        break
                    end = k
            (classes if m[2] == "class" else functions).append({"name": m[3], "start_line": i + 1, "end_line": end + 1})
        elif m := _FROM.match(row):
            imports.add(m[1])
        elif m := _IMPORT.match(row):
            imports |= {x.split()[0] for x in m[1].split(",") if x.split()}
        complexity += len(_DECISION.findall(row.split("#")[0]))
    return {"classes": classes, "functions": functions, "imports": sorted(imports), "complexity": complexity}


def analyse(language: str, content: bytes | None) -> dict:
    """All of a file, and an error instead of a failure. No content: nothing, and complexity 0."""
    if language not in ("python", "javascript", "typescript"):
        raise ValueError(f"Unsupported language: {language}")
    if content is None:
        return _EMPTY | {"complexity": 0, "error": None}
    code = content.decode("utf-8", "ignore")
    try:
        if language == "python":
            try:
                return analyse_python(code) | {"error": None}
            except (SyntaxError, ValueError) as e:
                return recover_python(code) | {"error": str(e)}
        return scripts.analyse(code) | {"error": None}
    except (RecursionError, IndexError) as e:
        return _EMPTY | {"complexity": 1, "error": f"{type(e).__name__}: {e}"}


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file (ord, rel_path, language, content): SCHEMA. A file that fails has an error, the rest go on."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = []
            for i in range(batch.num_rows):
                try:
                    found.append(analyse(batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))
                except ValueError as e:
                    found.append(_EMPTY | {"complexity": 1, "error": str(e)})
            arrays = [pa.array([x[name] for x in found], kind) for name, kind in _ARROW.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], ["ord", "rel_path", "language", *_ARROW])

    wanted = files.select(F.col("ord").cast("long"), "rel_path", "language", F.col("content").cast("binary").alias("content"))
    return arrow_map(wanted, batches, SCHEMA)


def symbols(parsed: DataFrame) -> DataFrame:
    """(rel_path, kind, ord, name, start_line, end_line), `ord` counting within file and kind."""
    kinds = [parsed.select("rel_path", F.lit(kind).alias("kind"), F.posexplode(column).alias("ord", "s")) for kind, column in (("class", "classes"), ("function", "functions"))]
    return kinds[0].unionByName(kinds[1]).select("rel_path", "kind", F.col("ord").cast("long").alias("ord"), "s.name", "s.start_line", "s.end_line")


def imports(parsed: DataFrame) -> DataFrame:
    """(rel_path, import_name), distinct within a file."""
    return parsed.select("rel_path", F.explode("imports").alias("import_name"))
