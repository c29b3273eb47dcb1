"""The module graph: imports resolved to files, edges, unreferenced files, flowchart text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

#: What may follow a relative import, first match first.
SUFFIXES = (".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx", "/index.ts", "/index.tsx")


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, imp, dst): the first Python file in inventory order whose module is the import, ends with a dot and the
    import, or is a prefix of the import, with no dot needed.

    Three equality joins instead of a search of all files for each import: the import against every
    dotted suffix of a module, and every prefix of the import against whole modules.
    """
    modules = files.where("language = 'python'").select("ord", F.col("rel_path").alias("dst"), paths.module(F.col("rel_path")).alias("module"))
    dots = F.split("module", r"\.", -1)
    suffixes = modules.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, i, F.size(dots)), "."))))
    wanted = imports.select("src", "imp").distinct().where("imp <> ''")
    whole = wanted.join(suffixes, F.col("imp") == F.col("key")).select("src", "imp", "dst", "ord")
    prefixes = wanted.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("imp")), lambda n: F.substring(F.col("imp"), F.lit(1), n))))
    begun = prefixes.join(modules, F.col("key") == F.col("module")).where("module <> ''").select("src", "imp", "dst", "ord")
    return whole.unionByName(begun).groupBy("src", "imp").agg(F.min_by("dst", "ord").alias("dst"))


def resolve_scripts(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, imp, dst) of relative imports: the target followed by the first suffix that gives a file, then the first
    such file in inventory order. The target as it stands is not tried."""
    relative = imports.select("src", "imp").distinct().where(F.col("imp").startswith("./") | F.col("imp").startswith("../"))
    target = paths.normalized(F.concat(paths.dirname(F.col("src")), F.lit("/"), F.col("imp")))
    tried = relative.withColumn("target", target).select("src", "imp", "target", F.posexplode(F.array(*map(F.lit, SUFFIXES))).alias("pos", "suffix"))
    tried = tried.withColumn("key", paths.normalized(F.concat("target", "suffix")))
    known = files.select("ord", F.col("rel_path").alias("dst"), paths.normalized(F.col("rel_path")).alias("path"))
    found = tried.join(known, F.col("key") == F.col("path"))
    return found.groupBy("src", "imp").agg(F.min_by("dst", F.struct("pos", "ord")).alias("dst"))


def edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, first_import): distinct edges between files; an import that resolves to its own file is dropped after
    its first match, with no second one tried."""
    source = files.select(F.col("rel_path").alias("src"), F.col("language").alias("of"))
    known = imports.join(source, "src")
    resolved = resolve_python(known.where("of = 'python'"), files).unionByName(resolve_scripts(known.where("of IN ('javascript', 'typescript')"), files))
    return resolved.where("src <> dst").groupBy("src", "dst").agg(F.min("imp").alias("first_import"))


def in_degrees(files: DataFrame, found: DataFrame) -> DataFrame:
    counts = found.groupBy(F.col("dst").alias("rel_path")).agg(F.count("*").alias("in_degree"))
    return files.select("rel_path").join(counts, "rel_path", "left").fillna({"in_degree": 0})


def unreferenced(files: DataFrame, found: DataFrame) -> DataFrame:
    """(ord, rel_path, is_entrypoint) of files that no other imports."""
    dead = files.join(found.select(F.col("dst").alias("rel_path")), "rel_path", "left_anti")
    return dead.select("ord", "rel_path", paths.entry_point(F.col("rel_path")).alias("is_entrypoint"))


def flowchart_nodes(files: DataFrame) -> DataFrame:
    """(idx, rel_path, line). One numbering over all files: the drawing is a single text in any case."""
    idx = (F.row_number().over(Window.orderBy("ord")) - 1).cast("long")
    return files.select(idx.alias("idx"), "rel_path").withColumn("line", F.concat(F.lit("    node_"), F.col("idx").cast("string"), F.lit('["'), F.col("rel_path"), F.lit('"]')))


def flowchart_edges(files: DataFrame, found: DataFrame) -> DataFrame:
    """(u, v, first_import, line), in the order of source and of the first import that makes the edge."""
    nodes = flowchart_nodes(files).select("idx", "rel_path")
    ends = found.join(nodes.select(F.col("idx").alias("u"), F.col("rel_path").alias("src")), "src").join(nodes.select(F.col("idx").alias("v"), F.col("rel_path").alias("dst")), "dst")
    return ends.select("u", "v", "first_import", F.concat(F.lit("    node_"), F.col("u").cast("string"), F.lit(" --> node_"), F.col("v").cast("string")).alias("line"))


def flowchart(files: DataFrame, found: DataFrame) -> DataFrame:
    """(mermaid): the whole text in one row."""
    nodes = flowchart_nodes(files).select(F.lit(0).alias("part"), F.col("idx").alias("a"), F.lit("").alias("b"), "line")
    arrows = flowchart_edges(files, found).select(F.lit(1).alias("part"), F.col("u").alias("a"), F.col("first_import").alias("b"), "line")
    every = nodes.unionByName(arrows).agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "line"))).alias("all"))
    return every.select(F.array_join(F.concat(F.array(F.lit("graph TD")), F.transform("all", lambda x: x["line"])), "\n").alias("mermaid"))
