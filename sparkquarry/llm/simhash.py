"""SimHash near-duplicates through a grid over segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import checkpointed, id_and_bytes, keep_first, rows, text_key
from .components import connected_components

SEED = 42
#: 32 segments of two bits, dealt into so many slabs. More slabs make smaller cells, and more of them: with 8 and a distance of 2
#: a fingerprint stands in 28 cells, each of the counts of 24 segments, which are worth 36 bits of a random fingerprint.
SLABS = 8
LOW_BITS = 0x5555555555555555


def shingle_hashes(text: bytes | None, width: int) -> list[int]:
    """Hashes of the word shingles of a whole text, repeats included; A-Z count as lower case. Up to `width` words are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a whole text."""
    return majority(shingle_hashes(text, width))


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that over half the hashes have; none without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row; null and empty texts have fingerprint zero. Null ids and repeated rows stay."""
    return _marked(id_and_bytes(docs, id_col, text_col), "id long", width)


def _marked(held: DataFrame, own: str, width: int) -> DataFrame:
    """Rows of some columns and a text last, with the fingerprint in place of the text."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [fingerprint(text, width) for *_, text in rows(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], "fp"])

    return arrow_map(held, batches, own + ", fp long")


def counts_in_unary(fp: Column) -> Column:
    """The embedding: each two-bit segment's count as 00, 01 or 11. Differing bits of two such codes are the
    Manhattan distance of the counts, which never exceeds the Hamming distance of the fingerprints."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def slab_masks(distance: int) -> list[int]:
    """Masks that keep the segments of all but `distance` slabs, for every choice of them. Counts at a
    Manhattan distance within it differ in so many slabs at most, so some mask maps both to one cell."""
    if not 0 < distance < SLABS:
        raise ValueError(f"distance must be from 1 to {SLABS - 1}")
    slab = [sum(3 << 2 * k for k in range(32) if k % SLABS == s) for s in range(SLABS)]
    masks = [sum(slab[s] for s in range(SLABS) if s not in left) for left in combinations(range(SLABS), distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def grid_cells(fp: Column, distance: int) -> Column:
    """The names of a fingerprint's cells in the grid. Fingerprints within the distance share one at least."""
    counts = counts_in_unary(fp)
    return F.array(*[F.xxhash64(F.lit(k), counts.bitwiseAND(F.lit(m))) for k, m in enumerate(slab_masks(distance))])


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) of all distinct fingerprints `fp` that differ in up to `distance` bits, a < b.

    Grid range join: a cell reaches over the whole range of the slabs that it leaves open and is one point in the others. (Cells
    of one size in all dimensions would have to be joined with their neighbours: 545 of them within a distance of 2 over 16
    segments of four bits.) The join keeps what is within
    the Manhattan bound, then compares the bits themselves. A fingerprint has a bounded number of others
    within the distance, so links grow in proportion to the fingerprints however dense a group is. The hint is needed: Spark takes
    exploded cells to be no more than the fingerprints, and would broadcast 28 times what it allows.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("slabs"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(slab_masks(distance))]))
    dealt = distinct.select("fp", counts_in_unary(F.col("fp")).alias("counts")).select("fp", "counts", cells.alias("at")).select("fp", "counts", "at.slabs", "at.cell")
    one, two = dealt.alias("one"), dealt.alias("two")
    near = (
        (F.col("one.slabs") == F.col("two.slabs"))
        & (F.col("one.cell") == F.col("two.cell"))
        & (F.col("one.fp") < F.col("two.fp"))
        & (F.bit_count(F.col("one.counts").bitwiseXOR(F.col("two.counts"))) <= distance)
        & (F.bit_count(F.col("one.fp").bitwiseXOR(F.col("two.fp"))) <= distance)
    )
    return one.hint("merge").join(two, near).select(F.col("one.fp").alias("a"), F.col("two.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id among the rows that chains of links reach.

    Null and empty texts have fingerprint zero and are linked like any others. Rows of one fingerprint are one node, so copies
    are never paired with each other. A component whose rows all lack an id has a null component_id. An empty table gives an
    empty result.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, width))
    return marked.join(_components(marked, distance), "fp").select("id", "fp", F.col("first").alias("component_id"))


def _components(marked: DataFrame, distance: int) -> DataFrame:
    """(fp, component, first): each fingerprint's component, named by its smallest fingerprint, and the smallest id in it."""
    nodes = marked.groupBy("fp").agg(F.min("id").alias("first"))
    found = connected_components(links(nodes.select("fp"), distance))
    named = nodes.join(found, nodes.fp == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    return named.select("fp", "component").join(firsts, "component").select("fp", "component", "first")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """One row of `docs` for each component, with all its columns: the one of the smallest id, those without an id last.

    Null texts count as empty ones. Ids may repeat or be null; of rows alike in id and text one stays. An empty table stays
    empty. Columns of any name pass through untouched.
    """
    held = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    marked = checkpointed(_marked(held, "id long, key long", width))
    grouped = marked.join(_components(marked, distance), "fp").select("id", "key", F.col("component"))
    return keep_first(docs, grouped, id_col, text_col)
