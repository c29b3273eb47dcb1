"""Near copies by the Jaccard similarity of word shingles: cells of SimHash fingerprints, cells of equal minima for what is
further apart than these reach, then the whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import checkpointed, keep_first, rows, text_key
from .components import connected_components
from .simhash import SEED, grid_cells, majority, shingle_hashes

WIDTH = 5
#: Sets are near at 4/5 or more, compared in whole numbers.
LEAST, OF = 4, 5
#: Fingerprints of sets that differ in so many bits at most share a cell of the grid for certain. Sets at 4/5 differ in 10 bits in the
#: mean; a grid for as many would put most of a large corpus into each other's cells, so minima find what the grid doesn't.
DISTANCE = 2
#: BANDS cells of DEPTH minima each: two sets at 4/5 share no cell with a chance of (1 - 0.8^4)^32, 5 in 100 million.
BANDS, DEPTH = 32, 4
#: Of 128 minima, 102 agree in the mean at 4/5, give or take 4.5: pairs with fewer than this are not compared.
AGREE = 70
#: Members of a cell that are compared with so many others at once.
BLOCK = 500
#: Places per shuffle partition at least, and bytes of sets to a place: more sets take more places, not larger ones.
PLACES, PLACE_BYTES = 16, 4 << 20

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 32, (BANDS * DEPTH, 1), np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, (BANDS * DEPTH, 1), np.uint32)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The different shingles of a whole text as sorted hashes."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def name_of(found: np.ndarray) -> int:
    """Equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each of the hash functions."""
    out = np.full(BANDS * DEPTH, (1 << 32) - 1, np.uint32)
    low = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (low[at : at + 2048] * _FACTORS + _SHIFTS).min(axis=1), out=out)
    return out


def cells_of(least: np.ndarray) -> list[int]:
    """One cell a band."""
    raw, size = least.tobytes(), 4 * DEPTH
    return [xxhash.xxh3_64_intdigest(raw[k * size : (k + 1) * size], k) - (1 << 63) for k in range(BANDS)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), text.alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, key, node, n, fp, cells) of every row: the name of its set, how many shingles it has, the SimHash fingerprint of the
    set, each shingle once, and the cells of its minima."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingle_set(text, width) for *_, text in rows(batch)]
            nodes, fps, cells = [name_of(x) for x in sets], [majority(x) for x in sets], [cells_of(minima(x)) for x in sets]
            columns = [pa.array(nodes, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(fps, pa.int64()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "key", "node", "n", "fp", "cells"])

    return arrow_map(_keyed(docs, id_col, text_col), batches, "id long, key long, node long, n long, fp long, cells array<long>")


def linked(sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links between near sets that connect all that are near; where there are two sides, only sets of different
    sides are compared. Sets that a chain of links joins already need no comparison."""
    marks = np.stack([minima(x) for x in sets]).astype(np.uint8)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    root, out, both = np.arange(len(sets)), [], side.min() != side.max()
    for i in range(len(sets) - 1):
        may = root[i + 1 :] != root[i]
        if both:
            may &= side[i + 1 :] != side[i]
        j = np.flatnonzero(may) + i + 1
        j = j[OF * np.minimum(sizes[j], sizes[i]) >= LEAST * np.maximum(sizes[j], sizes[i])]
        j = j[(marks[j] == marks[i]).sum(axis=1) >= AGREE]
        for at in range(0, len(j), 64):
            part = j[at : at + 64]
            part = part[root[part] != root[i]]
            if not len(part) or not sizes[i]:
                continue
            others = np.concatenate([sets[k] for k in part])
            place = np.minimum(np.searchsorted(sets[i], others), sizes[i] - 1)
            same = np.add.reduceat((sets[i][place] == others).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            for k in part[OF * same >= LEAST * (sizes[i] + sizes[part] - same)].tolist():
                if root[k] != root[i]:
                    out.append((i, k))
                    root[root == root[k]] = root[i]
    return out


def _compare(group: pa.Table) -> pa.Table:
    """All cells of one place -> (a, b) links of nodes."""
    keys = np.stack([group.column(name).to_numpy() for name in ("cell", "low", "high")])
    order = np.lexsort(keys)
    keys, nodes, side = keys[:, order], group.column("node").to_numpy()[order], group.column("block").to_numpy()[order]
    packed, found = group.column("shingles"), []
    heads = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
        sets = [np.frombuffer(packed[int(i)].as_py(), np.uint64) for i in order[a:b]]
        found += [(int(nodes[a + i]), int(nodes[a + j])) for i, j in linked(sets, side[a:b])]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def links(docs: DataFrame, marked: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(a, b) of nodes that are near, enough of them that chains reach whatever a chain of all would reach.

    Nodes meet in the cells of the grid of fingerprints and in those of minima. Cells of the same members are one. Sets are fetched for
    what is not alone in its cells, and each cell's are compared block by block in the workers, so that a dense group gives links in
    proportion to its members and never a row a pair. Differing bits are not counted: the sets themselves say what is near.
    """
    nodes = marked.groupBy("node").agg(F.min("key").alias("key"), F.any_value("n").alias("shingles"), F.any_value("fp").alias("fp"), F.any_value("cells").alias("cells"))
    entries = nodes.select("node", "shingles", F.explode(F.concat("cells", grid_cells(F.col("fp"), DISTANCE))).alias("cell"))
    entries = entries.where("cell IS NOT NULL").repartition("cell")  # moved once, for the counts and for the members, which take the same columns
    crowded = entries.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node", "shingles")).alias("mix"))
    crowded = crowded.where("n > 1").groupBy("n", "low", "high", "mix").agg(F.min("cell").alias("cell")).select("cell", "n")
    members = checkpointed(entries.join(crowded, "cell").select("cell", "n", "node", "shingles"))
    needed = members.select("node").distinct().join(nodes.select("node", "key"), "node").select("key").distinct()
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.join(needed, "key", "left_semi").select("text")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingle_set(text, width) for (text,) in rows(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    sets = arrow_map(texts, batches, "node long, shingles binary").dropDuplicates(["node"])
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("node", "cell", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    size = members.agg(F.sum(8 * F.col("shingles") * blocks)).first()[0] or 0
    places = max(PLACES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PLACE_BYTES))
    met = dealt.join(sets, "node").withColumn("place", F.pmod(F.xxhash64("cell", "low", "high"), F.lit(places)))
    return met.groupBy("place").applyInArrow(_compare, "a long, b long").distinct()


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of `docs` for each component of near texts, with all its columns: the one of the smallest id, those without an id last.

    Null texts are empty ones; texts of equal sets, such as texts without words, are near. Ids may repeat or be null; of rows
    alike in id and text one stays. Whole texts are compared, however long. An empty table stays empty. Columns of any name
    pass through untouched.
    """
    marked = checkpointed(sketches(docs, id_col, text_col, width))
    names = connected_components(links(docs, marked, text_col, width)).withColumnRenamed("node", "of")
    grouped = marked.select("id", "key", "node").join(names, F.col("node") == F.col("of"), "left")
    return keep_first(docs, grouped.select("id", "key", F.coalesce("component", "node").alias("component")), id_col, text_col)
