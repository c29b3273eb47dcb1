"""Removal of repeated byte strings with suffix arrays.

Every string of LENGTH bytes is dealt, by the smallest hash of the shorter strings in it, to one place where all
strings equal to it are dealt too. Neighbouring strings of a text mostly share that hash, so a text becomes
a few runs of strings; runs, not strings, are what moves. Runs that are equal as a whole need no comparison
but of their 128-bit digests. Runs that share their hash and differ are fetched, and a suffix array of them is built
by two-stage sorting: suffixes smaller than their successors are sorted directly, the others follow by
scanning buckets, and common prefixes of neighbours give the strings that stand more than once.

A hash that very many different runs share, such as that of a common line, is too much for one place. Tasks that see many
runs of it send a mark instead, and its strings are dealt one by one, by their own digests, of which each task sends the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import arrow_map, ship
from .common import checkpointed
from .rolling import rolled

LENGTH = 100
#: Length of the hashed strings.
ANCHOR = 32
#: Different runs of one hash beyond which its strings are dealt one by one: among those that a task holds at once, and in all.
LOCAL, MANY = 8, 2_000
#: Rows that share an id are told apart by a number above the bits of the position.
ROW_BITS = 40
#: From here on stand the rows without an id, spread by their texts.
NAMELESS = 1 << 62
#: Positions hashed at once, and runs, or single strings, gathered before they are handed on.
BLOCK, RUNS = 1 << 19, 1 << 20
#: Places per shuffle partition at least, and bytes of text to a place: more text takes more places, not larger ones.
PLACES, PLACE_BYTES = 16, 16 << 20
#: What a row of packed bytes holds.
SPANS, REQUESTS, HELD, STRINGS = 0, 1, 2, 3
#: Bytes that one suffix array is built over, unless one hash alone has more.
ARRAY = 1 << 20

_MIX = np.uint64(0xD6E8FEB86659FD93)
_ROW = np.dtype([("anchor", "<u8"), ("digest", "<u8"), ("more", "<u8"), ("id", "<i8"), ("at", "<i8"), ("windows", "<i4"), ("self", "?")])
_STRING = np.dtype([("digest", "<u8"), ("more", "<u8"), ("id", "<i8"), ("at", "<i8")])


def _sliding(of, a: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        a = of(a[:-done], a[done:])
        done *= 2
    return of(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def runs_of(text: bytes, anchor: int = ANCHOR, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first start, end of starts, holds its hash twice) of the runs of strings of a text."""
    width = length - anchor + 1
    for first in range(0, len(text) - length + 1, BLOCK):
        block = np.frombuffer(text, np.uint8, min(BLOCK + length - 1, len(text) - first), first)
        h = rolled(block.astype(np.uint64) + np.uint64(1), anchor)
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        least = _sliding(np.minimum, h, width)
        starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        ends = np.append(starts[1:], len(least))
        # the hashes that are the smallest of some string; two equal ones no farther apart than that have touching strings, which are one run
        padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
        chosen = np.flatnonzero(h == _sliding(np.maximum, padded, width))
        twice = np.zeros(len(starts), bool)
        near = np.flatnonzero((h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= width))
        if len(near):
            twice[np.searchsorted(starts, np.minimum(chosen[near], len(least) - 1), "right") - 1] = True
        yield least[starts], starts + first, ends + first, twice


def text_runs(text: bytes, row: int, at: int) -> np.ndarray:
    """The runs of one text as rows; `at` holds what tells rows of one id apart."""
    parts = []
    digest = xxhash.xxh3_128_digest
    for anchor, starts, ends, twice in runs_of(text):
        part = np.empty(len(starts), _ROW)
        part["anchor"], part["id"], part["at"], part["windows"], part["self"] = anchor, row, starts + at, ends - starts, twice
        reach = LENGTH - 1
        part["digest"], part["more"] = np.frombuffer(b"".join([digest(text[s : e + reach]) for s, e in zip(starts.tolist(), ends.tolist())]), "<u8").reshape(-1, 2).T
        parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, _ROW)


def _batch(place: list, kind: int, ids: list, payload: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array([kind] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(payload, pa.binary())], ["place", "kind", "id", "payload"])


_BATCH = "place long, kind int, id long, payload binary"


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin a new key."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _parts(key: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the rows of each key, in order."""
    bounds = np.append(np.flatnonzero(_heads(key)), len(key)).tolist() if len(key) else []
    return list(zip(bounds[:-1], bounds[1:]))


def _first_of_each(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ordered by hash, digest and position, and which of them are the first of equal ones."""
    runs = runs[np.lexsort((runs["at"], runs["id"], runs["more"], runs["digest"], runs["anchor"]))]
    return runs, _heads(runs["anchor"], runs["digest"], runs["more"], runs["windows"])


def _packed(rows: np.ndarray) -> bytes:
    """Column by column, so that the shuffle's compression finds the zeros."""
    return b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)


def _unpacked(payloads: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = [np.empty(0, kind)]
    for payload in payloads:
        n, offset = len(payload) // kind.itemsize, 0
        part = np.empty(n, kind)
        for name in kind.names:
            part[name] = np.frombuffer(payload, kind[name], n, offset)
            offset += n * kind[name].itemsize
        parts.append(part)
    return np.concatenate(parts)


def _requests(runs: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(id, rows of position, bytes, `length` and hash) for the texts of runs."""
    order = np.argsort(runs["id"], kind="stable")
    runs, length = runs[order], length[order]
    rows = np.empty((len(runs), 4), "<i8")
    rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = runs["at"], runs["windows"] + (LENGTH - 1), length, runs["anchor"].view(np.int64)
    for a, b in _parts(runs["id"]):
        yield int(runs["id"][a]), rows[a:b].tobytes()


def _covered(ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(id, spans) with touching spans joined, spans as pairs of start and end."""
    order = np.lexsort((at, ids))
    ids, at, end = ids[order], at[order], (at + size)[order]
    if not len(ids):
        return
    # ends are made to grow within a row by its own running maximum
    new_id = np.concatenate(([True], ids[1:] != ids[:-1]))
    bounds = np.append(np.flatnonzero(new_id), len(ids))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s, e = at[a:b], np.maximum.accumulate(end[a:b])
        cut = np.concatenate(([True], s[1:] > e[:-1]))
        last = np.append(np.flatnonzero(cut)[1:] - 1, b - a - 1)
        yield int(ids[a]), np.stack([s[cut], e[last]], 1).astype("<i8").tobytes()


def _sent(kind: int, found: list[tuple[int, bytes]], places: int) -> pa.RecordBatch:
    return _batch([i % places for i, _ in found], kind, [i for i, _ in found], [x for _, x in found])


def _dealt(kind: int, rows: np.ndarray, key: np.ndarray, places: int) -> pa.RecordBatch:
    """Rows packed by the place of their key."""
    place = ((key >> np.uint64(20)) % np.uint64(places)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, rows = place[order], rows[order]
    parts = _parts(place)
    return _batch([int(place[a]) for a, _ in parts], kind, [None] * len(parts), [_packed(rows[a:b]) for a, b in parts])


def _scatter(places: int):
    """Texts to packed runs by place. Runs equal to an earlier one among those at hand are resolved at once; of a hash
    with more than LOCAL different ones a mark is sent, which is a run of no windows, and the texts of its runs are asked for."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        runs, new = _first_of_each(np.concatenate(parts))
        old, runs = runs[~new], runs[new]
        yield _sent(SPANS, list(_covered(old["id"], old["at"], old["windows"] + (LENGTH - 1))), places)
        group = np.cumsum(_heads(runs["anchor"])) - 1
        hot = (np.bincount(group) > LOCAL)[group] if len(runs) else np.zeros(0, bool)
        yield _sent(REQUESTS, list(_requests(runs[hot], np.full(int(hot.sum()), LENGTH))), places)
        marks = runs[hot & _heads(runs["anchor"])] if len(runs) else runs
        for name in ("digest", "more", "id", "at", "windows"):
            marks[name] = 0
        runs = np.concatenate((runs[~hot], marks))
        yield _dealt(HELD, runs, runs["anchor"], places)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in source:
            ids, numbers, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                if len(text := texts[i].as_py() or b"") >= LENGTH:
                    parts.append(text_runs(text, ids[i].as_py(), numbers[i].as_py() << ROW_BITS))
                    held += len(parts[-1])
                    if held >= RUNS:
                        yield from flush(parts)
                        parts, held = [], 0
        if parts:
            yield from flush(parts)

    return batches


def _gather(group: pa.Table) -> pa.Table:
    """All runs of one place: spans of runs equal to an earlier one, and requests for the texts of those whose hash
    different runs share, to be compared as runs or, where there are too many, string by string."""
    kinds, ids, payloads = (group.column(name).to_pylist() for name in ("kind", "id", "payload"))
    out = [(k, i, x) for k, i, x in zip(kinds, ids, payloads, strict=True) if k != HELD]
    runs = _unpacked([x for k, x in zip(kinds, payloads) if k == HELD], _ROW)
    hot = np.unique(runs["anchor"][runs["windows"] == 0])
    runs, new = _first_of_each(runs[runs["windows"] > 0])
    old, runs = runs[~new], runs[new]
    out += [(SPANS, i, x) for i, x in _covered(old["id"], old["at"], old["windows"] + (LENGTH - 1))]
    if len(runs):
        heads = _heads(runs["anchor"])
        group_of = np.cumsum(heads) - 1
        size = np.bincount(group_of)
        single = (size > MANY) | np.isin(runs["anchor"][heads], hot)
        wanted = single | (size > 1) | (np.bincount(group_of, runs["self"]) > 0)
        asked = wanted[group_of]
        out += [(REQUESTS, i, x) for i, x in _requests(runs[asked], np.where(single, LENGTH, ANCHOR)[group_of[asked]])]
    return pa.table({"kind": pa.array([k for k, *_ in out], pa.int32()), "id": pa.array([i for _, i, _ in out], pa.int64()), "payload": pa.array([x for *_, x in out], pa.binary())})


def _again(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of equal strings, and the others."""
    strings = strings[np.lexsort((strings["at"], strings["id"], strings["more"], strings["digest"]))]
    first = _heads(strings["digest"], strings["more"])
    return strings[first], strings[~first]


def _fetch(places: int):
    """Texts with requests to the runs' bytes, dealt by hash, and to single strings, dealt by digest: the first of equal ones
    among those at hand, while the others are resolved at once."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, again = _again(np.concatenate(parts))
        for batch in (_sent(SPANS, list(_covered(again["id"], again["at"], np.full(len(again), LENGTH))), places), _dealt(STRINGS, first, first["digest"], places)):
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nothing, nothing], ["place", "kind", "id", "payload", "key", "at"])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        digest = xxhash.xxh3_128_digest
        for batch in source:
            ids, numbers, texts, asked = (batch.column(i) for i in range(4))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                text, row, number = texts[i].as_py() or b"", ids[i].as_py(), numbers[i].as_py()
                rows = np.frombuffer(b"".join(asked[i].as_py()), "<i8").reshape(-1, 4)
                for at, size, length, h in rows[rows[:, 0] >> ROW_BITS == number].tolist():
                    start = at & (1 << ROW_BITS) - 1
                    if length == ANCHOR:
                        out.append((h, row, at, text[start : start + size]))
                        continue
                    n = size - LENGTH + 1
                    part = np.empty(n, _STRING)
                    part["digest"], part["more"] = np.frombuffer(b"".join([digest(text[k : k + LENGTH]) for k in range(start, start + n)]), "<u8").reshape(-1, 2).T
                    part["id"], part["at"] = row, np.arange(at, at + n)
                    parts.append(part)
                    held += n
                    if held >= RUNS:
                        yield from flush(parts)
                        parts, held = [], 0
            if out:
                keys, rows_of, at, runs = zip(*out)
                place = (np.array(keys, np.int64).view(np.uint64) >> np.uint64(20)) % np.uint64(places)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array([HELD] * len(keys), pa.int32()), pa.array(rows_of, pa.int64()), pa.array(runs, pa.binary()), pa.array(keys, pa.int64()), pa.array(at, pa.int64())], ["place", "kind", "id", "payload", "key", "at"])
        if parts:
            yield from flush(parts)

    return batches


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, words): the suffixes of a byte array in the order of their first LENGTH bytes at least, and the eight
    bytes from each position as a number. Zeros follow the end."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(LENGTH + 16, np.uint8)))
    words = np.zeros(n + LENGTH + 8, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(words)]
    # smaller than the successor: the next different byte is larger
    step = np.sign(padded[1 : n + 1].astype(np.int16) - text.astype(np.int16))
    where = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(where[::-1])[::-1]
    smaller = np.append(step, -1)[following] > 0
    # stage one: direct sorting, by eight bytes at a time where a tie is left
    rank = np.full(n + 1, -1, np.int64)
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(words[direct], kind="stable")]
    tie = np.zeros(len(direct), np.int64)
    if len(direct):
        key = words[direct]
        tie = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    for offset in range(8, LENGTH + 8, 8):
        same = np.zeros(len(tie) + 1, bool)
        same[1:-1] = tie[1:] == tie[:-1]
        loose = np.flatnonzero(same[:-1] | same[1:])
        if not len(loose):
            break
        at = direct[loose]
        order = np.lexsort((words[np.minimum(at + offset, n)], tie[loose]))
        direct[loose] = at = at[order]
        key, group = words[np.minimum(at + offset, n)], tie[loose]
        # a tie's number is the place of its first suffix, so refined ties stay in order
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        tie = tie.astype(np.int64)
        tie[loose] = loose[np.maximum.accumulate(np.where(new, np.arange(len(loose)), 0))] + len(direct)
    # stage two: each bucket's larger suffixes in the order of their successors, which stand in smaller buckets or before them
    counts = np.bincount(text, minlength=256)
    begins = np.concatenate(([0], np.cumsum(counts)))[:-1]
    of_direct = np.bincount(text[direct], minlength=256)
    larger = np.flatnonzero(~smaller)
    larger = larger[np.argsort(text[larger], kind="stable")]
    of_larger = np.bincount(text[larger], minlength=256)
    from_larger = np.concatenate(([0], np.cumsum(of_larger)))
    from_direct = np.concatenate(([0], np.cumsum(of_direct)))
    after = padded[1 : n + 1]
    sorted_suffixes = np.empty(n, np.int64)
    for c in np.flatnonzero(counts):
        place = begins[c]
        mine = larger[from_larger[c] : from_larger[c + 1]]
        level = mine[(after[mine] != c) | (mine == n - 1)]
        level = level[np.argsort(rank[level + 1], kind="stable")]
        while len(level):
            sorted_suffixes[place : place + len(level)] = level
            rank[level] = np.arange(place, place + len(level))
            place += len(level)
            level = level[level > 0] - 1
            level = level[text[level] == c]
        own = direct[from_direct[c] : from_direct[c + 1]]
        sorted_suffixes[place : place + len(own)] = own
        rank[own] = np.arange(place, place + len(own))
    return sorted_suffixes, words


def common_prefixes(order: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, up to LENGTH; the end counts as zeros."""
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for offset in range(0, LENGTH, 8):
        last = len(words) - 1
        differ = words[np.minimum(order[left] + offset, last)] ^ words[np.minimum(order[left - 1] + offset, last)]
        same = differ == 0
        out[left[same]] += 8
        rest, bits = left[~same], differ[~same]
        for k in range(7):
            out[rest] += (bits >> np.uint64(8 * (7 - k))) == 0
        left = left[same]
        if not len(left):
            break
    return np.minimum(out, LENGTH)


def repeats(ids: np.ndarray, at: np.ndarray, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(id, position) of every string of LENGTH bytes in the runs that also starts earlier in them."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    text = np.frombuffer(b"".join(runs), np.uint8)
    order, words = suffix_array(text)
    shared = common_prefixes(order, words)
    group = np.cumsum(shared < LENGTH)
    twice = np.zeros(len(order), bool)
    twice[1:] = shared[1:] >= LENGTH
    twice[:-1] |= twice[1:]
    order, group = order[twice], group[twice]
    run = np.searchsorted(np.cumsum(sizes), order, "right")
    inside = order - (np.cumsum(sizes) - sizes)[run]
    whole = inside + LENGTH <= sizes[run]  # a string over the end of a run is none of a text
    group, run, inside = group[whole], run[whole], inside[whole]
    who, where = ids[run], at[run] + inside
    first = np.lexsort((where, who, group))
    group, who, where = group[first], who[first], where[first]
    again = np.zeros(len(group), bool)
    # overlapping runs may hold a string of the same place twice: that is not an earlier one
    again[1:] = group[1:] == group[:-1]
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(group)))) if len(group) else np.zeros(0, int)
    again &= (who != who[head]) | (where != where[head])
    return who[again], where[again]


def _compare(group: pa.Table) -> pa.Table:
    """All that was fetched for one place -> spans: runs in suffix arrays of whole hashes and about ARRAY bytes, strings by their digests."""
    kinds = group.column("kind").to_numpy()
    take = lambda kind, *names: [group.column(name).combine_chunks().take(pa.array(np.flatnonzero(kinds == kind))) for name in names]
    out = list(zip(*(x.to_pylist() for x in take(SPANS, "id", "payload")), strict=True))
    _, again = _again(_unpacked(take(STRINGS, "payload")[0].to_pylist(), _STRING))
    out += _covered(again["id"], again["at"], np.full(len(again), LENGTH))
    keys, ids, at = (x.to_numpy() for x in take(HELD, "key", "id", "at"))
    if len(keys):
        order = np.argsort(keys, kind="stable")
        runs = take(HELD, "payload")[0].take(pa.array(order)).to_pylist()
        keys, ids, at = keys[order], ids[order], at[order]
        filled = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
        found, begin = [], 0
        for _, head in _parts(keys):
            if head == len(keys) or filled[head - 1] - (filled[begin - 1] if begin else 0) >= ARRAY:
                found.append(repeats(ids[begin:head], at[begin:head], runs[begin:head]))
                begin = head
        who, where = (np.concatenate(x) for x in zip(*found))
        out += _covered(who, where, np.full(len(who), LENGTH))
    return pa.table({"id": pa.array([i for i, _ in out], pa.int64()), "payload": pa.array([x for _, x in out], pa.binary())})


def _merged(spans: list[bytes], number: int, n: int) -> list[tuple[int, int]]:
    pairs = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    pairs = pairs[pairs[:, 0] >> ROW_BITS == number] - (number << ROW_BITS)
    out: list[list[int]] = []
    for a, b in sorted(pairs.tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out if a < n]


def _cut(with_text: bool):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            numbers, own, texts, spans = (batch.column(i) for i in range(1, 5))
            out: list[tuple] = []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or b""
                cuts = _merged(spans[i].as_py() or [], numbers[i].as_py(), len(text))
                kept, end = [], 0
                for a, b in cuts:
                    kept.append(text[end:a])
                    end = b
                rest = b"".join([*kept, text[end:]])
                out.append((own[i].as_py(), len(text), len(text) - len(rest), len(cuts), hashlib.sha256(rest).hexdigest(), *[rest] * with_text))
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)

    return batches


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row, from whole texts as bytes.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a row of a smaller id, or before it in
    the same row. Null texts are empty. Rows without an id come after all others (whose ids are below 2^62), in the order of a hash of
    their texts. Of rows that share an id, those with other texts are told apart by the order of the texts, up to 2^23 of them; rows alike in
    id and text are one document, each with its result. An empty table gives an empty result.
    """
    session = docs.sparkSession
    ship(session)
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS)
    raw = docs.select(F.coalesce(F.col(id_col).cast("long"), hashed).alias("id"), F.col(id_col).cast("long").alias("own"), F.col(text_col).cast("binary").alias("text"))
    held = raw.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).agg(F.max("n").alias("most"), F.sum("bytes").alias("bytes")).first()
    places = max(PLACES * int(session.conf.get("spark.sql.shuffle.partitions")), -(-(held.bytes or 0) // PLACE_BYTES))
    if (held.most or 0) > 1:
        numbered = raw.withColumn("number", (F.dense_rank().over(Window.partitionBy("id").orderBy("text")) - 1).cast("long"))
    else:
        numbered = raw.withColumn("number", F.lit(0).cast("long"))
    texts = numbered.select("id", "number", "own", "text")
    # rows alike in id and text are one document, of which no string is another's copy
    once = texts.dropDuplicates(["id", "number"]) if (held.most or 0) > 1 else texts
    scattered = arrow_map(once.select("id", "number", "text"), _scatter(places), _BATCH)
    met = scattered.groupBy("place").applyInArrow(_gather, "kind int, id long, payload binary")
    met = checkpointed(met)
    asked = met.where(F.col("kind") == REQUESTS).groupBy("id").agg(F.collect_list("payload").alias("asked"))
    fetching = once.join(asked.hint("shuffle_hash"), "id").select("id", "number", "text", "asked", "own")
    fetched = arrow_map(fetching, _fetch(places), _BATCH + ", key long, at long")
    compared = fetched.groupBy("place").applyInArrow(_compare, "id long, payload binary")
    spans = met.where(F.col("kind") == SPANS).select("id", "payload").union(compared).groupBy("id").agg(F.collect_list("payload").alias("spans"))
    joined = texts.join(spans.hint("shuffle_hash"), "id", "left").select("id", "number", "own", "text", "spans")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return arrow_map(joined, _cut(with_text), schema)
