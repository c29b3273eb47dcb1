"""Encoding and decoding with SentencePiece models on the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, normalizers

from ..session import arrow_map
from .common import Remembered, id_and_bytes, rows

SPACE = "▁"
#: A blank and its marker, which texts may hold too.
MARKS = f" {SPACE}"
#: Words that are encoded at once, and the library's threads: there is a worker for each core already.
BATCH, THREADS = 4096, "2"
#: Field numbers and values of the published model format.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of words and ids that a worker remembers, what one costs besides its own, and the characters of the longest word that
#: is remembered: scripts without blanks have words as long as texts.
MEMO, COST, LONGEST = 90_000_000, 190, 64
#: One word in so many, by its checksum, is held against the SentencePiece library when it is new: every one.
VERIFY = 1


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, message[at : at + size]
        at += size


class Model:
    """What a .model file says: pieces with scores and kinds, algorithm, normaliser."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        with open(path, "rb") as f:
            for field, value in fields(f.read()):
                if field == PIECE:
                    piece = dict(fields(value))
                    self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
                elif field == TRAINER:
                    trainer = dict(fields(value))
                elif field == NORMALIZER:
                    normalizer = dict(fields(value))
        self.algorithm = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))

    def merges(self) -> list[tuple[str, str]]:
        """Every way to make a piece of two, best scores first: BPE files keep scores in place of merges."""
        score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER)}
        rank = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        found = []
        for piece, s in score.items():
            found += [(-s, rank[piece], k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in score and piece[k:] in score]
        return [(a, b) for *_, a, b in sorted(found)]

    def backend(self) -> Tokenizer:
        """The model rebuilt, for words that carry the marker already."""
        if self.algorithm == UNIGRAM:
            return Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback))
        if self.algorithm != BPE:
            raise ValueError("only unigram and BPE models can be rebuilt")
        vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        return Tokenizer(models.BPE(vocabulary, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))

    def normalizer(self):
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        return normalizers.Sequence(steps) if steps else None


class Different(ValueError):
    """The rebuilt model doesn't give the ids of the SentencePiece library."""


class Codec:
    """Encodes texts word by word: no piece has the marker after another character, so pieces never reach
    over the start of a word and a word's ids don't depend on its neighbours. New words of a batch are
    encoded together, on the library's threads, and remembered. All ids are those of the rebuilt model; those of one new word
    in `verify` are compared with the SentencePiece library's, and a difference is an error. Only a marker alone can't be, as the
    library puts the first one itself."""

    def __init__(self, path: str, verify: int = VERIFY):
        self.model = Model(path)
        self.native = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = self.model.backend()
        self.normalizer = self.model.normalizer()
        self.memo = Remembered(MEMO, COST)
        self.verify = verify
        kinds = [kind for _, _, kind in self.model.pieces]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for (p, _, _), k in zip(self.model.pieces, kinds, strict=True)]
        local = not any(SPACE in p.lstrip(SPACE) for p, _, k in self.model.pieces if k in (NORMAL, USER))
        # blanks get their marker word by word
        self.words = re.compile(f"[{MARKS}]*[^{MARKS}]+|[{MARKS}]+" if local else r"(?s).+")

    def normalized(self, text: str) -> str:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return (" " if self.model.dummy_prefix and text else "") + text

    def _bare(self, word: str) -> str:
        """What the SentencePiece library is to be given for a word: it puts the first marker itself."""
        return word[1:] if self.model.dummy_prefix and word[0] in MARKS else "" if self.model.dummy_prefix else word

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words; those that are not too long are remembered."""
        found = {}
        for at in range(0, len(words), BATCH):
            part = words[at : at + BATCH]
            checked = [w for w in part if not zlib.crc32(w.encode()) % self.verify and self._bare(w)]
            expected = dict(zip(checked, self.native.encode(list(map(self._bare, checked)), num_threads=1), strict=True))
            for word, encoding in zip(part, self.library.encode_batch_fast([w.replace(" ", SPACE) for w in part], add_special_tokens=False), strict=True):
                ids = encoding.ids
                if word in expected and expected[word] != ids:
                    raise Different(f"{word!r} has ids {ids}, the library says {expected[word]}")
                found[word] = array("i", ids).tobytes()
        self.memo.keep_all({w: raw for w, raw in found.items() if len(w) <= LONGEST})
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = [self.words.findall(self.normalized(t)) for t in texts]
        self.memo.trim()
        known = self.memo.young
        unseen = set().union(*split) - known.keys()
        new = self._learn([w for w in unseen if self.memo.older(w) is None])
        if not any(len(w) > LONGEST for w in new):
            for words in split:
                yield b"".join(map(known.__getitem__, words))
            return
        for words in split:
            yield b"".join([new[w] if w in new else known[w] for w in words])

    def decode(self, ids: np.ndarray | list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return raw[1:] if self.model.dummy_prefix and raw.startswith(" ") else raw


def groups(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of a batch, in lists of about `most` bytes."""
    texts, size = [], 0
    for _, raw in rows(batch):
        texts.append((raw or b"").decode("utf-8", "replace"))
        size += len(raw or b"")
        if size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


@lru_cache(1)
def codec(path: str) -> Codec:
    os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
    return Codec(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip[, ids]) of every row, whole texts, no added tokens.

    ids_sha256 is over the ids as little-endian 32-bit numbers, decoded_sha256 over the text that they
    decode to; round_trip says whether that is the text itself. Null texts are encoded as empty ones. Null
    ids and repeated rows are encoded like any others. `model` is a path that executors can read.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in source:
            at = 0
            for texts in groups(batch):  # a batch goes out in parts, so that its ids aren't all held at once
                found = list(own.encode(texts))
                back = [own.decode(np.frombuffer(ids, "<i4")) for ids in found]
                digest = lambda raw: hashlib.sha256(raw).hexdigest()
                sizes = np.fromiter((len(ids) // 4 for ids in found), np.int64, len(found))
                arrays = [batch.column(0).slice(at, len(texts)), pa.array(sizes), pa.array(list(map(digest, found))), pa.array([digest(x.encode()) for x in back]), pa.array([x == y for x, y in zip(back, texts, strict=True)])]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4"))))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *["ids"] * with_ids])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return arrow_map(id_and_bytes(docs, id_col, text_col), batches, schema)


def parity(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, same) of every row: whether its whole text has the ids that the SentencePiece library gives it. Null texts are empty ones."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in source:
            same = [ids == array("i", own.native.encode(text)).tobytes() for texts in groups(batch) for text, ids in zip(texts, own.encode(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.bool_())], ["id", "same"])

    return arrow_map(id_and_bytes(docs, id_col, text_col), batches, "id long, same boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids decode to the empty text."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in source:
            texts = [own.decode(ids or []) for _, ids in rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return arrow_map(encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")), batches, "id long, text string")
