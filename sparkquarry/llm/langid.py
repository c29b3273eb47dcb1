"""Language identification: the family first, then pairwise linear machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_map
from .common import rows

#: Families of the languages that corpora mostly hold; any other language is a family of its own.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"), "romance": ("fr", "es", "it", "pt", "ro", "ca"), "slavic": ("ru", "uk", "pl", "cs", "bg", "sr")}
#: Rows of a language that the machines learn from, at most, and rows in all.
ROWS, SAMPLE = 400, 12_000
#: Parts of a language's rows that are ranked apart at first.
SHARES = 32
#: Hashed character n-grams of one, two and three letters.
BUCKETS = 4096
#: Bytes of a text that are counted at once.
BLOCK = 1 << 20
ROUNDS, RIDGE = 40, 1e-4
LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def features(text: bytes) -> np.ndarray:
    """Unit vector of the damped counts of hashed byte n-grams of a whole text, A-Z as lower case, anything but
    letters of any script as one blank. A long text is counted in blocks, each of which knows the two letters before it, so
    that the counts are those of one pass."""
    raw = np.frombuffer(text, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    before, blank = np.empty(0, np.uint8), False
    for at in range(0, len(raw), BLOCK):
        code = _FOLD[raw[at : at + BLOCK]]
        keep = code != 32
        keep[1:] |= code[:-1] != 32
        keep[0] |= not blank
        blank = code[-1] == 32
        code = np.concatenate((before, code[keep])).astype(np.uint32)
        two = code[:-1] * np.uint32(257) + code[1:]
        three = two[:-1] * np.uint32(257) + code[2:]
        n = len(before)
        for gram, salt in ((code[n:], 0x9E3779B1), (two[max(n - 1, 0) :], 0x85EBCA77), (three[max(n - 2, 0) :], 0xC2B2AE3D)):
            counts += np.bincount((gram * np.uint32(salt)) >> np.uint32(20), minlength=BUCKETS)
        before = code[-2:].astype(np.uint8)
    out = np.sqrt(counts).astype(np.float32)
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


def _fold_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[i for i in range(128) if not (97 <= i <= 122 or 65 <= i <= 90)]] = 32
    return table


_FOLD = _fold_table()


def _machines(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Linear support vector machines with squared hinge loss, one for each column of signs, by accelerated gradient steps; the
    last feature is the bias. Classes weigh alike whatever their sizes."""
    weight = np.where(sign > 0, 0.5 / np.maximum(1, (sign > 0).sum(0)), 0.5 / np.maximum(1, (sign < 0).sum(0))).astype(np.float32)
    step = (1 / (2 * 2.0 * (weight * (x * x).sum(1, keepdims=True)).sum(0) + RIDGE)).astype(np.float32)
    w = ahead = np.zeros((x.shape[1], sign.shape[1]), np.float32)
    for k in range(ROUNDS * 5):
        gap = np.maximum(0, 1 - sign * (x @ ahead))
        gradient = -2 * (x.T @ (weight * gap * sign)) + np.float32(RIDGE) * ahead
        new = ahead - step * gradient
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def _signs(positive: np.ndarray) -> np.ndarray:
    return np.where(positive, 1, -1).astype(np.float32)


class Discriminator:
    """Families by one machine against the rest each; within a family one machine for each pair of languages."""

    def __init__(self, vectors: np.ndarray, langs: list[str]):
        langs_of = np.array(langs)
        self.members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.members.setdefault(family_of(lang), []).append(lang)
        names = sorted(self.members)
        family = np.array([family_of(x) for x in langs])
        vectors = np.hstack([vectors, np.ones((len(vectors), 1), np.float32)])
        self.families = dict(zip(names, _machines(vectors, _signs(family[:, None] == np.array(names))).T)) if len(names) > 1 else {}
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                of = (langs_of == a) | (langs_of == b)
                self.pairs[a, b] = _machines(vectors[of], _signs(langs_of[of] == a)[:, None])[:, 0]

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        x = np.append(vector, np.float32(1))
        sure = 1.0
        if self.families:
            margins = {f: float(w @ x) for f, w in self.families.items()}
            best = max(sorted(margins), key=margins.get)
            second = max((m for f, m in margins.items() if f != best), default=0.0)
            sure = _squash(margins[best] - second)
        else:
            best = next(iter(self.members))
        members = self.members[best]
        if len(members) == 1:
            return members[0], sure
        votes = dict.fromkeys(members, 0.0)
        for (a, b), w in self.pairs.items():
            if a in votes:
                p = _squash(2 * float(w @ x))
                votes[a] += p
                votes[b] += 1 - p
        lang = max(sorted(votes), key=votes.get)
        return lang, sure * min(1.0, votes[lang] / (len(members) - 1))


def _squash(margin: float) -> float:
    return float(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = ROWS) -> Discriminator | None:
    """Learns from at most `most` rows of each language, fewer where all languages would have more than SAMPLE together
    but one at least, those that come first by a hash of the id, so the choice depends on no order of rows. None if no row has a language and a text with a letter.

    What comes to the driver is one vector per row of that sample: its size is bounded by the parameters."""
    place = F.xxhash64(F.col(id_col).cast("string"))
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    languages = known.select(F.col(lang_col).cast("string")).distinct().count()
    most = max(1, min(most, SAMPLE // max(languages, 1)))
    # first within shares of a language, so that a common language is not one task's work, then among what they leave
    shares = Window.partitionBy("lang", F.pmod("place", F.lit(SHARES))).orderBy("place", "id")
    first = Window.partitionBy("lang").orderBy("place", "id")
    rows_of = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), place.alias("place"))
    chosen = rows_of.withColumn("k", F.row_number().over(shares)).where(F.col("k") <= most).withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    sample = chosen.select(F.col("id").alias("__id"), F.col("lang").alias("__lang"))
    texts = known.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # at most SAMPLE ids, or one a language: a proven bound for the broadcast
    texts = texts.join(F.broadcast(sample), (texts["id"] == F.col("__id")) & (texts["lang"] == F.col("__lang")), "left_semi")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [(lang, features(text).astype(np.float16).tobytes()) for _, text, lang in rows(batch) if LETTER.search(text.decode("utf-8", "replace"))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())], ["lang", "vector"])

    found = sorted((r["lang"], bytes(r["vector"])) for r in arrow_map(texts, batches, "lang string, vector binary").collect())
    if not found:
        return None
    return Discriminator(np.stack([np.frombuffer(v, np.float16) for _, v in found]).astype(np.float32), [lang for lang, _ in found])


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from the machines: the remainder of its id's CRC is 2. Null ids count as 'null'."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("null"))) % 4 == 2


def predict(docs: DataFrame, model: Discriminator | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its text alone; `und` with score 0 for null texts, texts without a
    letter, and when there was nothing to learn from. Null ids and repeated rows are predicted like any others.

    The model, a few vectors, goes to the workers once per task as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in source:
            found = []
            for _, raw in rows(batch):
                if own is None or raw is None or not LETTER.search(raw.decode("utf-8", "replace")):
                    found.append(("und", 0.0))
                else:
                    found.append(own.predict(features(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")), batches, "id long, lang_pred string, score double")
