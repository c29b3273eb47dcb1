"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own size.
MOST = 3
#: Documents of a source are numbered in cells: so many size classes for each doubling of the size, in each so many parts
#: of the shuffle of ids.
CLASSES, CELLS = 64, 64
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """The place of a size in CLASSES equal steps from each power of two to the next; whole numbers, so alike everywhere."""
    bits = F.length(F.bin(size + 1))
    return (CLASSES * bits + F.floor((size + 1) * CLASSES / F.pow(F.lit(2.0), bits))).cast("int")


def scattered(number: Column) -> Column:
    """An id's place in a fixed shuffle: a multiplicative generator over a prime, kept within long arithmetic."""
    residue = F.pmod(F.coalesce(number.cast("long"), F.lit(0)), F.lit(1000003))
    return F.pmod((residue + 1) * 48271, F.lit(2147483647))


def ranks(sizes: DataFrame) -> DataFrame:
    """Adds `rank`, the place of each source by name from 0, null last: sorted ranges count for themselves, and how many rows each
    range has, one number a partition, tells where it begins."""
    placed = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = checkpointed(placed.withColumns({"part": F.spark_partition_id(), "rank": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    begins, so_far = {}, 0
    for part, n in sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()):
        begins[part], so_far = so_far, so_far + n
    begin = F.element_at(F.create_map(*[F.lit(x) for pair in begins.items() for x in pair]), F.col("part")) if begins else F.lit(0)
    return placed.withColumn("rank", F.col("rank") + begin).drop("part")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target. Each source gets min(most * size, level * weight), the level being
    the one at which the targets add up to the total: the sources that a level would take beyond their caps are set to
    them, and the others share what is left at a new one, until none is above. Each round is one sum over the sources,
    however many there are; a level rises with every round, so no source is set free again."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = checkpointed(ranks(sizes).withColumn("weight", weight)).drop("rank")
    cap = most * F.col("source_size")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap
        n, capped, shared = weighted.agg(F.sum(over.cast("int")), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if (n or 0) == before or not shared:
            break
        before, level = n, float(total - (capped or 0)) / shared
    return weighted.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), cap.cast("double")).alias("target"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: bool = False) -> DataFrame:
    """(id, size, source, source_size, target, copies[, row]) of every row; `row` is the whole input row.

    A document's expected copies are its source's target over its size. Systematic sampling: expected copies
    are summed along the source, a random offset that depends on the source's name alone is added, and a
    document is taken once for each whole number crossed. Documents stand in size classes and, within them,
    in a fixed shuffle of their ids, so the words taken follow the target in every class. Null texts have size 0; sources
    without words have target 0 and no copies; null sources are one source; null ids are 0 in the shuffle and stand first
    among those of their place; rows alike in id and size are numbered in any order, which changes no total.
    Numbers within a source come from counts of bounded cells plus a running sum over the cells, so
    no source is ever sorted in one task.
    """
    held = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), *([F.struct("*").alias("row")] if carry else [])
    )
    if not carry:
        held = checkpointed(held)  # texts are read once
    placed = held.withColumn("place", scattered(F.col("id"))).withColumn("class", size_class(F.col("size")))
    placed = placed.withColumn("cell", F.floor(F.col("place") * CELLS / F.lit(2147483647)).cast("int"))
    cells = checkpointed(placed.groupBy("source", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    sized = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    along = Window.partitionBy("source").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    aim = targets(sized, weights, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}/"), F.coalesce(starts["source"], F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    known = starts.join(aim, starts["source"].eqNullSafe(aim["source"])).select(
        starts["source"].alias("of"), F.col("class").alias("in_class"), F.col("cell").alias("in_cell"), "before", "source_size", "target", offset.alias("offset")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    within = Window.partitionBy("source", "class", "cell").orderBy("place", "size", "id")
    numbered = placed.withColumn("k", F.row_number().over(within))
    joined = numbered.join(known, numbered["source"].eqNullSafe(known["of"]) & (F.col("class") == F.col("in_class")) & (F.col("cell") == F.col("in_cell")))
    number = F.col("before") + F.col("k")
    taken = F.floor(number * rate + F.col("offset")) - F.floor((number - 1) * rate + F.col("offset"))
    return joined.select("id", "size", "source", "source_size", "target", taken.cast("long").alias("copies"), *(["row"] if carry else []))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed table: every row as often as it is taken, with all its columns and no others."""
    taken = copies(docs, carry=True, **how).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
