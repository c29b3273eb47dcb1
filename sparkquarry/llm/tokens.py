"""Token counts of byte-level BPE by dynamic programming over prefixes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import arrow_map
from .common import Remembered, id_and_bytes, rows

#: Bytes of pieces and counts that a worker remembers, what one costs besides its own, and the characters of the longest
#: piece that is remembered.
MEMO, COST, LONGEST = 200_000_000, 300, 64
#: Pairs of tokens of which a worker remembers whether they can stand next to each other.
PAIRS = 1_000_000
#: The published split pattern of this family of vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters of which every Unicode version in use says the same; other texts are split by the library.
PLAIN = regex.compile(r"[\t-\r -~¡-¬®-ȟ‐-‧‰-⁞€]*")
#: Pieces of the pattern that, with their last letter off, are two.
BROKEN = ("'re", "'ve", "'ll")
BLANKS = regex.compile(r"\s{2,}")
_SHORT = (2, 1)


class PrefixCounter:
    """Exact token counts of a text and of each of its prefixes.

    The text is cut into pieces that merges never cross. Within a piece, dynamic programming over its prefixes: the
    encoding of a prefix is that of a shorter one and a last token, and of all tokens that end there exactly one can
    stand next to the shorter one's own last token, so each prefix takes a few lookups and none is encoded. The count at a
    prefix of the text is what the pieces before it add up to, plus the count within its piece; a prefix that ends in a
    run of blanks ends in one piece, and one that ends in a special token's string has no such token.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.merger, ranks = _merger(path)
        # a token that merges never reach is the last of no prefix
        self.ranks = {token: rank for token, rank in ranks.items() if self.merger._encode_single_piece(token) == [rank]}
        self.token = {rank: token for token, rank in self.ranks.items()}
        sizes: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 2:
                sizes.setdefault(token[-3:], set()).add(len(token))
        #: the lengths of the tokens that end in three bytes, longest first; any two bytes may be a token, and any single one is
        self.sizes = {end: (*sorted(found, reverse=True), 2, 1) for end, found in sizes.items()}
        self.fits: dict[int, bool] = {}
        self.memo = Remembered(MEMO, COST)

    def pieces(self, text: str) -> list[str]:
        if not any(special in text for special in self.specials):
            return self._split(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            out += [part] if part in self.specials else self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _adjacent(self, one: int, two: int) -> bool:
        key = one << 20 | two
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.merger._encode_single_piece(self.token[one] + self.token[two]) == [one, two]
        return known

    def within(self, piece: str) -> list[int]:
        """The counts of a piece's prefixes, by characters, as if merges were all that there is."""
        raw = piece.encode()
        n = len(raw)
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        ranks, sizes, fits = self.ranks.get, self.sizes.get, self.fits.get
        for end in range(1, n + 1):
            for size in sizes(raw[end - 3 : end], _SHORT) if end > 2 else _SHORT[2 - end :]:
                start = end - size
                if start < 0 or (rank := ranks(raw[start:end])) is None:
                    continue
                if start:
                    fit = fits(last[start] << 20 | rank)
                    if not (self._adjacent(last[start], rank) if fit is None else fit):
                        continue
                counts[end], last[end] = counts[start] + 1, rank
                break
        if n == len(piece):
            return counts[1:]
        return [counts[k] for k in range(1, n + 1) if k == n or raw[k] & 0xC0 != 0x80]

    def counts(self, piece: str) -> bytes | list[int]:
        """The counts of a piece's prefixes: a byte each, or numbers where a piece is too long to be remembered."""
        if piece in self.specials:
            return bytes([1] * len(piece))
        found = self.within(piece)
        if piece in BROKEN:
            found[1] = 2
        if len(piece) > LONGEST:
            return found
        raw = bytes(found)
        self.memo.keep(piece, raw)
        return raw

    def _known(self, piece: str) -> bytes | list[int]:
        return self.memo.young.get(piece) or self.memo.older(piece) or self.counts(piece)

    def total(self, piece: str) -> int:
        return int(self._known(piece)[-1])

    def table(self, text: str) -> np.ndarray:
        """The token count of every prefix, by its last character."""
        pieces = self.pieces(text)
        if not pieces:
            return np.zeros(0, np.int32)
        self.memo.trim()
        found = list(map(self.memo.young.get, pieces))
        if None in found:
            for k, counts in enumerate(found):
                if counts is None:
                    found[k] = self._known(pieces[k])
        try:
            held = np.frombuffer(b"".join(found), np.uint8).astype(np.int32)
        except TypeError:  # some are numbers
            held = np.concatenate([np.frombuffer(c, np.uint8) if type(c) is bytes else np.array(c, np.int32) for c in found]).astype(np.int32)
        sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
        ends = np.cumsum(sizes)
        own = held[ends - 1]
        before, starts = np.cumsum(own) - own, ends - sizes
        held += np.repeat(before, sizes).astype(np.int32)
        for run in BLANKS.finditer(text):
            cut = run.end() - 1
            k = int(np.searchsorted(starts, cut))
            if k < len(pieces) and starts[k] == cut and pieces[k - 1].isspace():
                held[cut] = before[k - 1] + self.total(pieces[k - 1] + text[cut])
        if any(special in text for special in self.specials):
            for k in [k for k, piece in enumerate(pieces) if piece in self.specials]:
                for cut in range(int(starts[k]) + 1, int(ends[k])):
                    held[cut - 1] = self._recounted(text, cut, k, pieces, starts, before)
        return held

    def _recounted(self, text: str, cut: int, k: int, pieces: list[str], starts: np.ndarray, before: np.ndarray) -> int:
        """The count of a prefix that ends within the special token k: its string is split with what stands before it, from a piece on
        that no such string can change."""
        k = max(k - 2, 0)
        while k and (pieces[k - 1][-1].isspace() or pieces[k - 1] in self.specials):
            k -= 1
        return int(before[k]) + sum(self.total(p) for p in self.pieces(text[int(starts[k]) : cut]))

    def at(self, text: str, cut: int, table: np.ndarray | None = None) -> int:
        """The token count of text[:cut], from the table."""
        table = self.table(text) if table is None else table
        cut = min(max(cut, 0), len(table))
        return int(table[cut - 1]) if cut else 0

    def cut_within(self, text: str, budget: int, table: np.ndarray | None = None) -> int:
        """The length in characters of the longest prefix whose tokens fit the budget, from the table."""
        return longest(self.table(text) if table is None else table, budget)


def longest(table: np.ndarray, budget: int) -> int:
    """The length of the longest prefix within a budget. Counts can fall from one prefix to the next, so it is the last that fits."""
    fits = np.flatnonzero(table <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _merger(path: str) -> tuple[tiktoken.Encoding, dict[bytes, int]]:
    """The merges of the file for single pieces, and the tokens by rank: a merge's rank is its place in the file."""
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    # the published stand-ins for bytes: printable ones are themselves, the rest follow from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    ranks = {bytes([b]): b for b in range(256)}
    for k, pair in enumerate(merges):
        one, two = pair if isinstance(pair, list) else pair.split(" ")
        ranks.setdefault(bytes(byte_of[c] for c in one + two), 256 + k)
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), ranks


@lru_cache(1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def pack(table: np.ndarray) -> bytes:
    """The table as steps from prefix to prefix, one byte each where they fit, or four."""
    steps = np.diff(table, prepend=table.dtype.type(0))
    wide = steps.size and max(int(steps.max()), -int(steps.min())) > 127
    return bytes([bool(wide)]) + steps.astype("<i4" if wide else "i1").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, "<i4" if packed[0] else "i1", offset=1), dtype=np.int32)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, prefixes) of every row; `prefixes` is the packed table of the counts at every prefix.

    `tokenizer` is the path of a byte-level BPE file that executors can read. Null texts count as empty: no
    bytes, no tokens. Strings of special tokens within texts are tokens, as the library has it by default.
    Null ids and repeated rows are counted like any others.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in source:
            sizes, totals, tables = [], [], []
            for _, text in rows(batch):
                table = count.table((text or b"").decode("utf-8", "replace"))
                sizes.append(len(text or b""))
                totals.append(int(table[-1]) if len(table) else 0)
                tables.append(pack(table))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(tables, pa.binary())], ["id", "n_bytes", "n_tokens", "prefixes"])

    return arrow_map(id_and_bytes(docs, id_col, text_col), batches, "id long, n_bytes long, n_tokens long, prefixes binary")


def over_budget(counts: DataFrame, budget: int) -> DataFrame:
    """Adds over_limit: whether a whole text needs more tokens than the budget."""
    return counts.withColumn("over_limit", F.col("n_tokens") > budget)


def within_budget(counts: DataFrame, budget: int) -> DataFrame:
    """(id, n_chars, n_tokens) of every row of counts: the longest prefix whose tokens fit the budget and its own count, read off the
    stored tables; nothing is encoded again. The empty prefix fits any budget."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes, totals = [], []
            for _, packed in rows(batch):
                table = unpack(packed)
                sizes.append(longest(table, budget))
                totals.append(int(table[sizes[-1] - 1]) if sizes[-1] else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["id", "n_chars", "n_tokens"])

    return arrow_map(counts.select("id", "prefixes"), batches, "id long, n_chars long, n_tokens long")
