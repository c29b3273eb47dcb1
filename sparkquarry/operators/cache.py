"""Content-hash caching of summaries, and rollups by directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import costs, paths, text


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))


def hits(hashed: DataFrame, cache: DataFrame, key: str = "rel_path") -> DataFrame:
    """Rows whose key and content hash are in the cache (key, sha256, summary), with the summary."""
    known = cache.select(F.col("key").alias("__key"), F.col("sha256").alias("__sha"), "summary")
    return hashed.join(known, (F.col(key) == F.col("__key")) & (F.col("sha256") == F.col("__sha"))).drop("__key", "__sha")


def with_summary(hashed: DataFrame, cache: DataFrame, key: str = "rel_path") -> DataFrame:
    """All rows, the summary null where the cache has none for this content."""
    known = cache.select(F.col("key").alias("__key"), F.col("sha256").alias("__sha"), "summary")
    return hashed.join(known, (F.col(key) == F.col("__key")) & (F.col("sha256") == F.col("__sha")), "left").drop("__key", "__sha")


def misses(hashed: DataFrame, cache: DataFrame, key: str = "rel_path") -> DataFrame:
    known = cache.select(F.col("key").alias("__key"), F.col("sha256").alias("__sha"))
    return hashed.join(known, (F.col(key) == F.col("__key")) & (F.col("sha256") == F.col("__sha")), "left_anti")


def directories(files: DataFrame) -> DataFrame:
    """(dir, n_files, files): files by their own parent directory, names in order."""
    return files.groupBy(paths.directory(F.col("rel_path")).alias("dir")).agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("rel_path")).alias("files"))


def directory_hashes(hashed: DataFrame) -> DataFrame:
    """(dir, n_files, sha256): the hash over the directory's name and its files' hashes in the order of their paths.
    Moves paths and hashes only, never contents."""
    by_path = F.array_sort(F.collect_list(F.struct("rel_path", "sha256")))
    grouped = hashed.select("rel_path", "sha256").groupBy(paths.directory(F.col("rel_path")).alias("dir")).agg(F.count("*").alias("n_files"), by_path.alias("all"))
    joined = F.concat("dir", F.array_join(F.transform("all", lambda x: x["sha256"]), ""))
    return grouped.select("dir", "n_files", F.sha2(joined.cast("binary"), 256).alias("sha256"))


def _tokens(files: DataFrame) -> Column:
    """The files' own column `tokens`, as a tokenizer counted them, or the estimate where there is none."""
    return F.col("tokens") if "tokens" in files.columns else costs.tokens(F.col("content"))


def scan_cost(hashed: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(uncached_files, input_tokens, output_tokens, cost) of the files that the cache misses."""
    sums = misses(hashed, cache).agg(F.count("*").alias("uncached_files"), F.coalesce(F.sum(_tokens(hashed)), F.lit(0)).cast("long").alias("input_tokens"))
    sums = sums.withColumn("output_tokens", costs.completion(F.col("input_tokens")))
    return sums.withColumn("cost", costs.dollars(F.col("input_tokens"), F.col("output_tokens"), model))


def document_cost(hashed: DataFrame, cache: DataFrame, model: str, overview_exists: bool) -> DataFrame:
    """(uncached_files, uncached_dirs, input_tokens, output_tokens, cost) of files, then directories, then the overview."""
    dirs = directory_hashes(hashed)
    names = ("uncached_files", "map_tokens", "uncached_dirs", "files_in_them", "n_dirs")
    parts = (
        (misses(hashed, cache), {"uncached_files": F.lit(1), "map_tokens": _tokens(hashed)}),
        (misses(dirs, cache, "dir"), {"uncached_dirs": F.lit(1), "files_in_them": F.col("n_files")}),
        (dirs, {"n_dirs": F.lit(1)}),
    )
    counted = [rows.select(*[given.get(n, F.lit(0)).cast("long").alias(n) for n in names]) for rows, given in parts]
    sums = counted[0].union(counted[1]).union(counted[2]).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    again = F.lit(not overview_exists) | (F.col("uncached_dirs") > 0)
    over = F.when(again, costs.SUMMARY * F.col("n_dirs")).otherwise(F.lit(0))
    into = (F.col("map_tokens") + costs.SUMMARY * F.col("files_in_them") + over).cast("long")
    out = (costs.SUMMARY * (F.col("uncached_files") + F.col("uncached_dirs")) + F.when(over > 0, F.lit(costs.OVERVIEW)).otherwise(F.lit(0))).cast("long")
    return sums.select("uncached_files", "uncached_dirs", into.alias("input_tokens"), out.alias("output_tokens")).withColumn("cost", costs.dollars(F.col("input_tokens"), F.col("output_tokens"), model))


def module_prompts(summarised: DataFrame) -> DataFrame:
    """(dir, prompt) from all files (rel_path, summary or null), in the order of their paths."""
    by_path = F.array_sort(F.collect_list(F.struct("rel_path", text.file_line(F.col("rel_path"), F.col("summary")).alias("line"))))
    grouped = summarised.groupBy(paths.directory(F.col("rel_path")).alias("dir")).agg(by_path.alias("all"))
    return grouped.select("dir", text.module_prompt(F.col("dir"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("prompt"))


def overview_prompt(modules: DataFrame) -> DataFrame:
    """(prompt) in one row from the modules (dir, summary)."""
    section = F.struct("dir", text.module_section(F.col("dir"), F.col("summary")).alias("section"))
    grouped = modules.agg(F.array_sort(F.collect_list(section)).alias("all"))
    return grouped.select(text.overview_prompt(F.array_join(F.transform("all", lambda x: x["section"]), "\n")).alias("prompt"))


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next snapshot of the cache: entries that aren't replaced, and the new ones."""
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)
