"""Exact duplicates by naming blocks, then pairs of names, until a text has one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, free_names

#: Bytes of a block.
BLOCK = 1 << 12
#: Different contents with one hash that are told apart by a list in the plan; with more, another hash is tried.
TWINS = 1000
#: Bits of the buckets that contents are sorted in, and of the places within a bucket.
BUCKET, PLACE = 14, 32
#: What has more than this part of all rows is looked up by broadcast: there can be no more such values than that.
HOT = 1000
#: The other half of an odd name's pair.
NONE = -1


class Hashing:
    """A short form of contents: their 64-bit hash, and the place among the contents of that hash in their own order.

    `twins` lists the contents that share a hash, which is empty but for rare chance, so that the short form is an
    expression of the content alone, yet no two contents have the same one."""

    def __init__(self, seed: int, twins: list[tuple[bytes, int]]):
        self.seed, self.twins = seed, twins

    def short(self, content: Column) -> Column:
        place = F.lit(1)
        for twin, k in self.twins:
            place = F.when(content == F.lit(twin), F.lit(k)).otherwise(place)
        return F.struct(F.xxhash64(F.lit(self.seed), content).alias("h"), place.alias("place"))


def hashing(contents: DataFrame) -> Hashing:
    """A hashing without collisions for all values of the column `content`: groups them, and looks for different ones with one hash.

    Equal contents are combined before the shuffle, so copies cost nothing there."""
    for seed in range(64):
        hashed = contents.select(F.xxhash64(F.lit(seed), "content").alias("h"), "content").distinct()
        shared = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h").limit(TWINS + 1).collect()
        if not shared:
            return Hashing(seed, [])
        if len(shared) <= TWINS:
            found = hashed.where(F.col("h").isin([r.h for r in shared])).limit(TWINS + 1).collect()
            if len(found) <= TWINS:
                of: dict[int, list[bytes]] = {}
                for r in found:
                    of.setdefault(r.h, []).append(bytes(r.content))
                return Hashing(seed, [(c, k) for group in of.values() for k, c in enumerate(sorted(group), 1)])
    raise RuntimeError("no hash tells the contents apart")


def blocks(text: Column) -> Column:
    """The bytes of a text in pieces of BLOCK; the empty text has one empty block. The text is bound to a variable: an
    expression would be evaluated again for each block."""

    def cut(raw: Column) -> Column:
        last = F.greatest(F.floor((F.octet_length(raw) - 1) / F.lit(BLOCK)), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * BLOCK + 1, F.lit(BLOCK)))

    return F.transform(F.array(text.cast("binary")), cut)[0]


def pairs(names: Column) -> Column:
    """Neighbouring names two by two; an odd one stands with NONE."""
    last = ((F.size(names) - 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get(names, 2 * i).alias("one"), F.coalesce(F.get(names, 2 * i + 1), F.lit(NONE)).alias("two")))


def ranked(values: DataFrame, key: Column, *order: str) -> DataFrame:
    """Adds `name`, an integer by the place of each row in the sorted order of its 64-bit `key` and then of `order`: the key's first bits are
    the bucket, in which a window counts. The same for equal tables, whatever their partitions."""
    bucket = F.shiftrightunsigned(key, 64 - BUCKET)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)).cast("long")
    return values.withColumn("bucket", bucket).withColumn("name", F.shiftleft(F.col("bucket"), PLACE) + place).drop("bucket")


def looked_up(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined with a table whose keys are its own and whose `n` counts the rows of a key. Keys of more than 1 in HOT of all rows,
    fewer than HOT, are broadcast, so none of them makes a task larger than others."""
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = table.where(F.col("n") * HOT > total).drop("n")
    common = rows.join(F.broadcast(hot), on)
    rare = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(F.col("n") * HOT <= total).drop("n"), on)
    return common.unionByName(rare)


def identified(shorts: DataFrame) -> DataFrame:
    """(shorts, n) of texts as lists of short forms, each list once, n times seen -> with `same`, one identity for each.

    All blocks are sorted into integer names; then all pairs of neighbouring names are, until a text has one name.
    Names of different rounds can be alike, so an identity is the number of blocks and the last name."""
    blocks_of = shorts.select(F.explode("shorts").alias("at")).groupBy("at.h", "at.place").agg(F.count("*").alias("n"))
    names = checkpointed(ranked(blocks_of, F.col("h"), "h", "place"))
    single = shorts.where(F.size("shorts") == 1).select("shorts", F.col("shorts")[0]["h"].alias("h"), F.col("shorts")[0]["place"].alias("place"))
    single = looked_up(single, names, ["h", "place"]).select("shorts", F.lit(1).alias("blocks"), F.col("name").alias("root"))
    several = shorts.where(F.size("shorts") > 1).select("shorts")
    several = checkpointed(ranked(several, F.xxhash64("shorts"), "shorts").withColumnRenamed("name", "of"))
    exploded = several.select("of", F.posexplode("shorts").alias("pos", "at")).select("of", "pos", "at.h", "at.place")
    left = _gathered(looked_up(exploded, names, ["h", "place"]))
    roots = []
    while (most := left.agg(F.max(F.size("names"))).first()[0] or 0) > 1:
        paired = left.select("of", F.posexplode(pairs(F.col("names"))).alias("pos", "at")).select("of", "pos", "at.one", "at.two")
        table = checkpointed(ranked(paired.groupBy("one", "two").agg(F.count("*").alias("n")), F.xxhash64("one", "two"), "one", "two"))
        left = _gathered(looked_up(paired, table, ["one", "two"]))
        roots.append(left.where(F.size("names") == 1).select("of", F.col("names")[0].alias("root")))
        left = left.where(F.size("names") > 1)
        if most <= 2:
            break
    same = F.struct("blocks", "root").alias("same")
    found = single.select("shorts", same)
    for root in roots:
        found = found.unionByName(several.join(root, "of").select("shorts", F.size("shorts").alias("blocks"), "root").select("shorts", same))
    return found


def _gathered(named: DataFrame) -> DataFrame:
    """(of, names): the names of a text in their order."""
    held = named.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("all"))
    return checkpointed(held.select("of", F.transform("all", lambda x: x["name"]).alias("names")))


def _shorts(docs: DataFrame, text: Column):
    """What makes an expression of a text's blocks in short form. Telling their hashes apart takes a job over all blocks of `text`."""
    held = hashing(docs.select(F.explode(blocks(text)).alias("content")))
    return lambda text: F.transform(blocks(text), held.short)


def _groups(rows: DataFrame) -> DataFrame:
    """Rows (id, shorts, n) -> (shorts, n, keep_id, group_size, ids) of each identity; combined before the shuffle, so that the copies of a text count as one."""
    lists = checkpointed(rows.groupBy("shorts").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("ids")))
    same = identified(lists.select("shorts", F.lit(1).alias("n")))
    grouped = lists.join(same, "shorts").groupBy("same").agg(F.any_value("shorts").alias("shorts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.sum("ids").alias("ids"))
    return checkpointed(grouped.select("shorts", F.col("ids").alias("n"), "keep_id", "group_size"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too.

    Of equal texts the row with the largest id stays; null texts are empty ones; null ids are smaller than any other.
    Of rows alike in id and text, which nothing tells apart, one stays. Long texts are read whole. An empty table gives an empty result.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    shorts = _shorts(docs, text)
    low = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("low"))
    marked = low.select("id", shorts(F.col("low")).alias("shorts"), F.sha2("low", 256).alias("text_sha256"))
    rows = checkpointed(marked.groupBy("shorts", "id", "text_sha256").agg(F.count("*").alias("copies")))
    groups = _groups(rows.select("id", "shorts", F.col("copies").alias("n")))
    found = looked_up(rows, groups, ["shorts"])
    each = found.select("id", "keep_id", F.col("group_size").cast("long"), "text_sha256", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("k"))
    return each.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal texts the one with the largest id.

    Null texts are empty ones; null ids are smaller than any other; of rows alike in id and text one stays. Whole texts
    count, however long. An empty table stays empty. Columns of any name pass through untouched. What is looked up for a row is
    its id and short form: texts move only if the rows that go are too many to broadcast."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    own = _shorts(docs, text)(text)
    rows = checkpointed(docs.select(F.col(id_col).cast("long").alias("id"), own.alias("shorts")).groupBy("shorts", "id").agg(F.count("*").alias("copies")))
    groups = _groups(rows.select("id", "shorts", F.col("copies").alias("n"))).where("n > 1")
    gone_id, gone_of, of, row = free_names(docs, "gone_id", "gone_of", "of", "row")
    gone = looked_up(rows, groups, ["shorts"]).where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias(gone_id), F.col("shorts").alias(gone_of))
    marked = docs.withColumn(of, own)
    left = marked.join(gone, marked[id_col].cast("long").eqNullSafe(F.col(gone_id)) & (F.col(of) == F.col(gone_of)), "left_anti")
    if rows.where("copies > 1").limit(1).count():
        left = left.withColumn(row, F.col(id_col)).dropDuplicates([row, of]).drop(row)
    return left.drop(of)
