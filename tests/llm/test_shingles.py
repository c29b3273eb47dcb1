"""Near copies by five-word shingles against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquarry.llm import shingles
from tests.conftest import SMALL


def plain_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_first(docs):
    """[(id, text)] -> ids that stay: the smallest of each component of pairs at 0.8 or more."""
    sets, names = [plain_set(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            names[root(i)] = root(j)
    least = {}
    for i, (row, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), row), row)
    return set(least.values())


def kept(spark, texts, parts=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect())


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()}
    assert found == plain_first([(d.doc_id, d.text) for d in docs.collect()])


def test_edited_copies_equal_brute_force(spark, monkeypatch):
    """A dense group with every degree of editing, in several blocks, and sets at 4/5 exactly."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(90):
        words = base[:]
        for _ in range(rng.randrange(8)):
            words[rng.randrange(120)] = f"x{rng.random()}"
        texts.append(" ".join(words))
    texts += [" ".join(f"{c}{k}" for k in range(n)) for c in "abcdefgh" for n in (12, 14)]  # 8 of 10 shingles
    texts += ["", None, " \n", "one two", "ONE  two", "one two three"]
    expected = sorted(plain_first(list(enumerate(texts))))
    assert kept(spark, texts) == expected
    monkeypatch.setattr(shingles, "BLOCK", 7)
    assert kept(spark, texts) == expected


def test_fingerprints_find_near_sets(spark):
    """Sets that share no cell of minima meet by their SimHash fingerprints; only those that are near are linked."""
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(["x", *words]), " ".join(words[:1500]), "a b c", "d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = shingles.sketches(docs).withColumn("cells", F.array(F.xxhash64("node")))
    ids = {r.node: r.id for r in marked.collect()}
    bits = {r.id: r.fp for r in marked.collect()}
    assert all(((bits[0] ^ bits[k]) & (1 << 64) - 1).bit_count() <= shingles.DISTANCE for k in (1, 2))
    found = [{ids[r.a], ids[r.b]} for r in shingles.links(docs, marked).collect()]
    assert set().union(*found) == {0, 1, 2}


def test_minima_lose_no_pair():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        n = int(rng.integers(5, 200)) * 10
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate((a[n // 10 :], rng.integers(0, 1 << 63, n // 10, np.uint64)))  # 9 of 11
        one, two = shingles.minima(a), shingles.minima(b)
        assert set(shingles.cells_of(one)) & set(shingles.cells_of(two))
        assert (one == two).sum() >= shingles.AGREE


def test_ids_repeated_or_null(spark):
    long, other = " ".join(map(str, range(60))), " ".join(map(str, range(100, 160)))
    docs = [(1, long), (2, long + " z"), (2, other), (None, other + " z"), (None, "a b c"), (None, "A b c"), (7, "t u"), (7, "t u")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.text.lower()) for r in corpus_pipeline.near_dedup(spark, table, SMALL).collect())
    assert found == sorted([(1, long), (2, other), (0, "a b c"), (7, "t u")])
