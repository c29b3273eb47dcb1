"""Repetition coverage of texts by rolling hashes of word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import arrow_map
from .common import id_and_bytes, rows
from .rolling import rolled

#: n-gram lengths, and the share of a text's word characters that n-grams found twice may cover.
LIMITS = {5: 0.45, 6: 0.42, 7: 0.39, 8: 0.36, 9: 0.33, 10: 0.30}
#: The share of characters in lines with a word that lines seen before may hold.
LINE_LIMIT = 0.30
BASE_WIDTH, BASE_WORDS, BASE_PERCENT = 8, 20, 30
SYMBOLS = list(b"#*$%&|<>")
BLANKS = [9, 10, 11, 12, 13, 32]


def repeated_windows(ids: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` ids, whether it stands elsewhere in the text too. Equal rolling hashes only
    propose; the ids themselves are compared, and if a hash ever lied, windows are named exactly instead."""
    n = len(ids) - width + 1
    twice = np.zeros(max(n, 0), bool)
    if n < 2:
        return twice
    hashes = rolled(ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), width)
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(same):
        return twice
    left, right = order[same], order[same + 1]
    if all(np.array_equal(ids[left + k], ids[right + k]) for k in range(width)):
        twice[left] = twice[right] = True
        return twice
    _, name, count = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width), axis=0, return_inverse=True, return_counts=True)
    return count[name.ravel()] > 1


def covered(windows: np.ndarray, width: int, n: int) -> np.ndarray:
    """The words that lie in a marked window."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(windows), 1)
    np.add.at(edges, np.flatnonzero(windows) + width, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: bytes | None) -> dict:
    """The counts and shares of one whole text; a null text counts as empty."""
    text = text or b""
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    code_points = len(text) - int(bytes_of[128:192].sum())
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out = {"n_words": n, "word_chars": code_points - int(bytes_of[BLANKS].sum()), "n_symbols": int(bytes_of[SYMBOLS].sum()), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": 0}
    line_chars = again = 0
    seen: set[bytes] = set()
    for x in lines:
        size = len(x.decode("utf-8", "replace"))
        line_chars += size
        if x in seen:
            again += size
        seen.add(x)
    out["line_share"] = again / line_chars if line_chars else 0.0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    shares = dict.fromkeys(LIMITS, 0.0)
    sizes = None
    for width in sorted({*LIMITS, BASE_WIDTH}):
        windows = repeated_windows(ids, width)
        if not windows.any():
            break  # no longer n-gram can repeat either
        if sizes is None:
            sizes = np.fromiter((len(w.decode("utf-8", "replace")) for w in words), np.int64, n)
        inside = covered(windows, width, n)
        if width == BASE_WIDTH:
            out["n_repeat_words"] = int(inside.sum())
        if width in shares:
            shares[width] = float(sizes[inside].sum() / max(1, out["word_chars"]))
    out["base_failed"] = n < BASE_WORDS or 100 * out["n_repeat_words"] > BASE_PERCENT * n
    out["kept"] = not out["base_failed"] and out["line_share"] <= LINE_LIMIT and all(shares[w] <= LIMITS[w] for w in LIMITS)
    out["shares"] = [shares[w] for w in LIMITS]
    return out


_FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("line_share", "double"), ("shares", "array<double>")]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, verdict, shares) of every row; `shares` follows the order of LIMITS.

    Null and empty texts have no words and fail. Null ids and repeated rows are measured like any others.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [measure(text) for _, text in rows(batch)]
            arrays = [pa.array([x[name] for x in found], _ARROW[kind]) for name, kind in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *[name for name, _ in _FIELDS]])

    return arrow_map(id_and_bytes(docs, id_col, text_col), batches, "id long, " + ", ".join(f"{n} {k}" for n, k in _FIELDS))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns, without a shuffle."""
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(at).cast(pa.binary())
            keep = pa.array([measure(texts[i].as_py())["kept"] for i in range(len(texts))], pa.bool_())
            yield batch.filter(keep)

    return arrow_map(docs, batches, schema)
