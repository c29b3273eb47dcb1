"""License scans: ordered signatures behind a keyword gate, overlaps resolved by priority and containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .signatures import BASE, CONFIDENCE, GATE, SHORT, Signature, signatures

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in texts whose capitals still stand; a class of what they hold takes a seventh of the time of what they don't.
ANY_CASE = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: What no word holds, and so can mark where a match begins and ends.
FIRST, LAST = "<", ">"
TOP = max(CONFIDENCE)


def gate(low: Column) -> Column:
    """Whether a lower-case text can hold a license at all: every signature needs one of these."""
    other = r"[^0-9a-z\x80-\x{10FFFF}]"
    short = [_all(low, (words[0],)) & low.rlike(f"(?:^|{other}){pattern.format(other=other)}(?:$|{other})") for words, pattern in SHORT.items()]
    return reduce(lambda a, b: a | b, [*[_all(low, parts) for parts in GATE], *short])


def _all(low: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(p)) for p in parts])


def due(joined: Column, made: list[Signature]) -> Column:
    """The numbers of the signatures that match, each tried only where its keywords stand. Patterns are part of the plan, so
    they are compiled once."""
    groups: dict[tuple[str, ...], list[Signature]] = {}
    for s in made:
        groups.setdefault(s.keywords, []).append(s)
    tried = []
    for keywords, members in groups.items():
        numbers = F.array_compact(F.array(*[F.when(joined.rlike(s.pattern), F.lit(s.order)) for s in members]))
        tried.append(F.when(_all(joined, keywords), numbers).otherwise(F.lit([]).cast("array<int>")))
    return F.flatten(F.array(*tried))


def places(joined: Column, pattern: Column) -> Column:
    """Where a pattern stands, as first word and word past the end: matches get a mark at either end, and are read off the
    words. Takes time in proportion to the words, however many matches there are."""
    marked = F.regexp_replace(joined, F.concat(F.lit(" ("), F.substring(pattern, F.lit(2), F.length(pattern) - 2), F.lit(") ")), F.lit(f" {FIRST}$1{LAST} "))
    words = F.split(marked, "  ")
    number = lambda mark, shift: F.array_compact(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i + shift)))
    return F.zip_with(number(FIRST, 0), number(LAST, 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def detections(joined: Column, made: list[Signature]) -> Column:
    """All matches of all signatures, as an array."""
    of = F.array(*[F.struct(F.lit(s.pattern).alias("pattern"), F.lit(s.priority).alias("priority"), F.lit(s.label).alias("label")) for s in made])

    def found(k: Column) -> Column:
        s = F.get(of, k)
        match = lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("minus_end"), (-s["priority"]).alias("minus_priority"), k.alias("order"), s["label"].alias("label"))
        return F.transform(places(joined, s["pattern"]), match)

    return F.flatten(F.transform(due(joined, made), found))


def resolve(found: Column) -> Column:
    """(labels, priority) of the matches that no other of the same or a higher priority contains; of equal matches the first
    signature stays.

    In the order of start and, at one start, of falling end and priority, a match is contained if one seen
    before, of its priority or higher, ends no earlier; so the largest end by priority is all to be kept."""
    start = F.struct(F.array(*[F.lit(-1)] * (TOP + 1)).alias("ends"), F.lit([]).cast("array<string>").alias("labels"), F.lit(-1).alias("priority"))

    def step(s: Column, d: Column) -> Column:
        own = -d["minus_priority"]
        end = -d["minus_end"]
        counts = ~F.exists(F.slice(s["ends"], own + 1, F.lit(TOP + 1)), lambda e: e >= end) & (d["label"] != "")
        return F.struct(
            F.transform(s["ends"], lambda e, i: F.when(i == own, F.greatest(e, end)).otherwise(e)).alias("ends"),
            F.when(counts, F.array_union(s["labels"], F.array(d["label"]))).otherwise(s["labels"]).alias("labels"),
            F.when(counts, F.greatest(s["priority"], own)).otherwise(s["priority"]).alias("priority"),
        )

    return F.aggregate(F.array_sort(found), start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: list[Signature] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, found) of every row; no shuffle.

    Null and empty texts have no words and no labels. Null ids and repeated rows are scanned like any others. `found` holds
    every match, hidden ones too, with its words; ends and priorities are negative there for the sake of their order.
    The score is the confidence of the best match that counts, 0 without one.
    """
    made = made or signatures()
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.regexp_count(text, F.lit(ANY_CASE)).cast("long").alias("n_words"))
    joined = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)), "  "), F.lit(" "))
    # lower once, not once for each fragment
    low = read.withColumn("low", F.lower("text"))
    gated = low.select("id", "n_words", F.when(gate(F.col("low")), joined).alias("joined"))
    kind = "array<struct<start:int,minus_end:int,minus_priority:int,order:int,label:string>>"
    matched = gated.select("id", "n_words", F.when(F.col("joined").isNotNull(), detections(F.col("joined"), made)).otherwise(F.lit([]).cast(kind)).alias("found"))
    base = F.filter("found", lambda d: d["minus_priority"] == 0)
    kept = matched.select("id", "n_words", "found", base.alias("base"), F.when(F.size("found") > 0, resolve(F.col("found"))).alias("kept"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda d: d["label"])))
    none = F.lit([]).cast("array<string>")
    starts = F.transform("base", lambda d: d["start"])
    worth = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(CONFIDENCE.items()) for x in pair]), F.col("kept.priority"))
    return kept.select(
        "id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce(F.col("kept.labels"), none))), ",").alias("labels"), F.greatest(F.coalesce(worth, F.lit(0.0)), F.when(F.size("base") > 0, CONFIDENCE[0]).otherwise(0.0)).alias("score"), "found",
    )
