"""Repeated byte strings against a plain search."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash

from sparkquarry.llm import queries, suffixes
from tests.conftest import SMALL

from .conftest import ODD

N = suffixes.LENGTH


def plain(texts):
    """[text as bytes] in their order -> (bytes, removed, spans, digest of the rest) of each."""
    seen, out = set(), []
    for text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - N + 1):
            part = text[i : i + N]
            if part in seen:
                gone[i : i + N] = b"\1" * N
            seen.add(part)
        rest = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(text), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    found = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(docs).collect()}
    assert [found[i] for i in range(len(texts))] == plain([t.encode() for t in texts])


def test_repeats_equal_plain_search(spark):
    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    found = {r[0]: tuple(r)[1:] for r in queries.op5_suffixes(spark, SMALL).collect()}
    assert [found[d.doc_id] for d in docs] == plain([d.text.encode() for d in docs])


def test_repeats_of_hard_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passage, line = word(160), word(70)
    texts = ["a" * 99, "a" * 100, "a" * 130, "b" * 350, "ab" * 200, "", "\0" * 240, word(50) + passage + word(60), passage, "x" + passage[:120], word(40) + line + word(60)]
    texts += [word(30) + line + word(rng.randrange(80)) + passage[rng.randrange(60) :] for _ in range(30)]
    texts += [passage[k : k + 100] for k in range(0, 60, 7)] + [word(3000) * 2, passage * 3]
    check(spark, texts)


def test_repeats_of_every_period(spark):
    """A text of each period, in whose runs a hash may stand again at any distance, alone and with an exact copy of it."""
    rng = random.Random(7)
    texts = []
    for period in range(1, 101):
        unit = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(period))
        for size in (100 + period, 169, 170, 3 * period + 100):
            texts.append((unit * (size // period + 1))[:size])
    line = "".join(rng.choice("ABCDEFGH ") for _ in range(68)) + "\n"
    copied = "".join(rng.choice("0123456789") for _ in range(69)) * 3
    check(spark, [*texts, line * 3, copied, copied])


@pytest.mark.parametrize("local, many, runs, place", [(8, 2000, 1 << 20, 16 << 20), (0, 2000, 1 << 20, 16 << 20), (8, 1, 1 << 20, 200), (1, 3, 40, 1000), (10**9, 10**9, 7, 16 << 20)])
def test_results_do_not_depend_on_how_strings_are_dealt(spark, monkeypatch, local, many, runs, place):
    """Common lines in different surroundings, copies and periods, with every way to deal their strings."""
    for name, value in (("LOCAL", local), ("MANY", many), ("RUNS", runs), ("PLACE_BYTES", place)):
        monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("xyz \n") for _ in range(n))
    middle, longer = word(98), word(260)
    texts = [word(20) + middle + word(20) for _ in range(60)] + [word(rng.randrange(90)) + longer[rng.randrange(80) :] + word(rng.randrange(90)) for _ in range(60)]
    texts += [longer, longer, longer * 2, "q" * 300, "ab" * 150, middle * 3, "", "x"]
    rng.shuffle(texts)
    check(spark, texts)


def test_groups_stay_small_as_the_input_grows(spark, monkeypatch):
    """A line that stands in every text in other surroundings: the largest group's bytes, at two sizes."""
    sizes = []
    true = suffixes._gather
    monkeypatch.setattr(suffixes, "LOCAL", 4)
    for n in (300, 1200):
        rng = random.Random(n)
        word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))  # noqa: E731, B023
        line = "the same line stands in every one of these texts, whatever stands before or after it\n"
        texts = [(word(200) + line + word(200)).encode() for _ in range(n)]
        batch = pa.RecordBatch.from_pydict({"id": list(range(n)), "number": [0] * n, "text": texts})
        sent = pa.Table.from_batches(suffixes._scatter(1 << 30)(iter([batch])))
        held = sent.filter(pa.compute.equal(sent.column("kind"), suffixes.HELD)).to_pylist()
        by_place = Counter()
        for row in held:
            by_place[row["place"]] += len(row["payload"])
        sizes.append(max(by_place.values()))
        assert true(sent.slice(0, 5)).num_rows
    assert sizes[0] == sizes[1] <= (suffixes.LOCAL + 1) * suffixes._ROW.itemsize


def test_runs_of_small_blocks(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(suffixes, "BLOCK", 150)
    text = ("".join(rng.choice("xyz ") for _ in range(700)) * 2).encode()
    covered = sorted((s, e) for _, a, b, _ in suffixes.runs_of(text) for s, e in zip(a.tolist(), b.tolist()))
    assert covered[0][0] == 0 and covered[-1][1] == len(text) - N + 1
    assert all(x[1] == y[0] for x, y in zip(covered, covered[1:]))


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 2), (2, 1), (50, 1), (300, 2), (900, 3), (2000, 200)):
        text = rng.integers(0, letters, size).astype(np.uint8)
        raw = text.tobytes()
        order, words = suffixes.suffix_array(text)
        padded = raw + bytes(N + 8)
        keys = [padded[i : i + N] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(size)) and keys == sorted(keys)
        shared = suffixes.common_prefixes(order, words)
        for k in range(1, size):
            same = next((j for j in range(N) if keys[k][j] != keys[k - 1][j]), N)
            assert shared[k] == same


def test_repeats_odd_rows(odd, none):
    assert suffixes.remove_repeats(none).count() == 0
    found = suffixes.remove_repeats(odd, with_text=True).collect()
    assert Counter((r.id, r.n_bytes) for r in found) == Counter((d[0], len((d[1] or "").encode())) for d in ODD)
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in found)
    long = next(r for r in found if r.id == 6)
    assert long.n_removed == 25000 - 5 and long.n_spans == 1


def test_rows_of_null_and_repeated_ids(spark):
    """Rows without an id come last, by the hashes of their texts; other texts of one id in the order of the texts; rows alike in both are one document."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    one, two, three = word(150), word(150), word(150)
    docs = [(None, one + word(20)), (None, two), (3, two + one), (3, one), (3, one), (5, three), (4, word(9) + three[:120]), (None, None), (5, None), (None, two)]
    found = Counter(map(tuple, suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()))
    place = lambda i, t: ((1 << 62) + xxhash.xxh64_intdigest(t, 42) % (1 << 62) if i is None else i, t)
    order = sorted({place(i, (t or "").encode()) for i, t in docs})
    of = dict(zip(order, plain([t for _, t in order])))
    assert found == Counter((i, *of[place(i, (t or "").encode())]) for i, t in docs)
