"""SimHash, quality rules, token counts, languages, SentencePiece and mixing against plain versions."""

import hashlib
import itertools
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from sparkquarry.llm import langid, mixing, quality, queries, sentencepieces, simhash, tokens
from tests.conftest import SMALL

from .conftest import CLASHING, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()


def plain_simhash(text, width=3):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance=2):
    """fps: [(id, fingerprint)]; the component of each row."""
    names = list(range(len(fps)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= distance:
            names[root(i)] = root(j)
    least = {}
    for i, (row, _) in enumerate(fps):
        if row is not None:
            least[root(i)] = min(least.get(root(i), row), row)
    return [least.get(root(i)) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, docs):
    found = queries.op2_simhash(spark, SMALL).collect()
    fps = [(d.doc_id, plain_simhash(d.text)) for d in docs]
    expected = {(i, f"{fp:016x}", c) for (i, fp), c in zip(fps, plain_components(fps), strict=True)}
    assert {tuple(r) for r in found} == expected and len(found) == len(docs)


def test_simhash_odd_rows(odd, none):
    found = simhash.near_duplicates(odd).collect()
    fps = [(d[0], plain_simhash(d[1])) for d in ODD]
    expected = Counter((i, fp - (1 << 64) if fp >> 63 else fp, c) for (i, fp), c in zip(fps, plain_components(fps), strict=True))
    assert Counter(map(tuple, found)) == expected
    assert simhash.near_duplicates(none).count() == 0
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    rows = left.collect()
    # the smallest id of each component; of those without an id, one in a component that has none
    assert Counter(r.doc_id for r in rows) == Counter({c for _, c in zip(fps, plain_components(fps), strict=True) if c is not None} | ({None} if any(c is None for c in plain_components(fps)) else set()))
    assert all(r[name] == "clash" for r in rows for name in CLASHING)
    assert simhash.drop_near_duplicates(none).count() == 0


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, k, replace=False)) for b in base for k in (1, 2, 3)]
    fps = sorted({*map(int, base), *near, 0, 1, -1, -2, 3 << 40})
    expected = {(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert {tuple(r) for r in found} == expected


def test_cells_are_not_broadcast(spark):
    """At any size: a broadcast of cells is many times what Spark takes it for, and the driver has to hold it."""
    near = simhash.links(spark.createDataFrame([(1,), (3,), (255 << 40,)], "fp long"))
    assert [tuple(r) for r in near.collect()] == [(1, 3)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_components_of_a_long_chain(spark):
    from sparkquarry.llm.components import connected_components

    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (200, 200), (None, 4)], "a long, b long")
    found = {tuple(r) for r in connected_components(chain).collect()}
    assert found == {(k, 0) for k in range(61)} | {(k, 100) for k in (100, 101, 102)}


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words)


def plain_shares(text):
    words = WORD.findall(text or "")
    out = []
    for n in quality.LIMITS:
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        often = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(n)}
        out.append(sum(len(words[i]) for i in inside) / max(1, sum(map(len, words))))
    return out


def test_quality_equals_brute_force(spark, docs):
    texts = {d.doc_id: d.text for d in docs}
    found = quality.repetition(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert len(found) == len(docs)
    for r in found:
        assert tuple(r)[1:7] == plain_quality(texts[r.id])
        assert r.shares == pytest.approx(plain_shares(texts[r.id]))
        assert not (r.base_failed and r.kept)


def test_quality_odd_rows(odd, none):
    found = quality.repetition(odd).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(map(tuple, found)) == Counter((d[0], *plain_quality(d[1])) for d in ODD)
    assert quality.repetition(none).count() == 0
    assert quality.keep_good(odd).columns == odd.columns


def test_quality_survives_equal_hashes(monkeypatch):
    ids = np.array([1, 2, 3, 4, 1, 2, 3, 9, 8, 7])
    monkeypatch.setattr(quality, "rolled", lambda values, width: np.zeros(len(values) - width + 1, np.uint64))
    assert quality.repeated_windows(ids, 3).tolist() == [True, False, False, False, True, False, False, False]


def test_quality_keeps_good_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in queries.op3_quality(spark, SMALL).select("doc_id", "n_words", "kept").collect() if r.n_words >= 20}
    good = [kept[i] for i, q in labels.items() if q == 1 and i in kept]
    assert sum(good) >= 0.97 * len(good)


def test_tokens_equal_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in queries.op4_tokens(spark, SMALL).collect()}
    for d in docs:
        n = len(library.encode(d.text, add_special_tokens=False).ids)
        assert (found[d.doc_id].n_tokens, found[d.doc_id].n_bytes, found[d.doc_id].over_limit) == (n, len(d.text.encode()), n > 1024)


def test_tokens_odd_rows(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = Counter((d[0], len((d[1] or "").encode()), len(library.encode(d[1] or "", add_special_tokens=False).ids)) for d in ODD)
    assert Counter(map(tuple, tokens.token_counts(odd, path).select("id", "n_bytes", "n_tokens").collect())) == expected
    assert tokens.token_counts(none, path).count() == 0


PREFIXED = (
    ODD[7][1], "it's  \n\n  a<|endoftext|>b <|endoftext|", "\n\n\n x\t\ty '' 's 12 345,6", "  lead and trail  ", "they're we'll I've 'rest 've\n\nnew   line\r\n\r\n  x", "!!<|endoftext|>  <|endoftext|><|endo\n<|endoftext|>",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa b", "漢字かな交じり文を読む、長い文章。" * 8, "=" * 90 + "-" * 70 + " " * 90 + "x", "e\u0301e\u0301 naïve ½ ⅷ ٣٤ \u00a0\u2003 \u200b😀👩‍👩‍👧", "x" + "\n" * 7 + "\t" * 3 + "y \n z",
)


def test_counts_at_every_prefix():
    counter = tokens.counter(public_tokenizers.path("byte_bpe_50k.json"))
    for text in PREFIXED:
        table = tokens.unpack(tokens.pack(counter.table(text)))
        expected = [len(counter.library.encode(text[:cut], add_special_tokens=False).ids) for cut in range(len(text) + 1)]
        assert [counter.at(text, cut, table) for cut in range(len(text) + 1)] == expected, text
        for budget in range(12):
            assert counter.cut_within(text, budget, table) == max(cut for cut, n in enumerate(expected) if n <= budget)


def test_counts_at_prefixes_of_documents(spark, docs):
    """Cuts at random in every document, and budgets read off the stored tables."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = tokens.counter(path)
    rng = np.random.default_rng(2)
    for d in docs:
        table = counter.table(d.text)
        assert len(table) == len(d.text)
        for cut in rng.integers(0, len(d.text) + 1, 5).tolist():
            assert counter.at(d.text, cut, table) == len(counter.library.encode(d.text[:cut], add_special_tokens=False).ids)
    texts = {d.doc_id: d.text for d in docs}
    for r in tokens.within_budget(tokens.token_counts(spark.read.parquet(f"{SMALL}/documents.parquet"), path), 100).collect():
        encoded = len(counter.library.encode(texts[r.id][: r.n_chars], add_special_tokens=False).ids)
        assert encoded == r.n_tokens <= 100 and (r.n_chars == len(texts[r.id]) or r.n_tokens >= 98)


def test_a_budget_cuts_inside_a_piece():
    counter = tokens.counter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a" * 3000 + " b"
    cut = counter.cut_within(text, 100)
    assert cut > 300 and len(counter.library.encode(text[:cut]).ids) <= 100 < len(counter.library.encode(text[: cut + 16]).ids)


def test_a_very_long_text_without_breaks():
    rng = np.random.default_rng(6)
    counter = tokens.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "".join(chr(97 + k) for k in rng.integers(0, 26, 300_000))
    assert int(counter.table(text)[-1]) == len(counter.merger.encode_ordinary(text))
    assert counter.memo.held < 10_000


def test_languages_held_out(spark):
    found = queries.op6_langid(spark, "/root/testdata/sf0.01").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in found if r.held_out]
    assert len(found) == len(langs) and len(held) > 150
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_languages_odd_rows(odd, none):
    model = langid.train(odd)
    found = Counter((r.id, r.lang_pred == "und") for r in langid.predict(odd, model).collect())
    assert found == Counter((d[0], not d[1] or not any(c.isalpha() for c in d[1])) for d in ODD)
    assert langid.train(none) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_pieces_equal_the_library(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    native = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {r.doc_id: r for r in queries.op9_sentencepiece(spark, SMALL).collect()}
    for d in docs:
        ids = native.encode(d.text)
        assert found[d.doc_id].n_tokens == len(ids)
        assert found[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert found[d.doc_id].decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest() and found[d.doc_id].round_trip


def test_pieces_odd_rows_round_trip(odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    native = sentencepiece.SentencePieceProcessor(model_file=path)
    found = sentencepieces.encode(odd, path)
    assert Counter((r.id, tuple(r.ids)) for r in found.collect()) == Counter((d[0], tuple(native.encode(d[1] or ""))) for d in ODD)
    assert Counter(map(tuple, sentencepieces.decode(found, path).collect())) == Counter((d[0], d[1] or "") for d in ODD)
    assert sentencepieces.encode(none, path).count() == 0


def test_runs_of_blanks_have_parity():
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, native = sentencepieces.codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [" " * k + "word" + " " * (37 - k) for k in range(38)] + ["▁x ▁▁ y", "a\n\n  b\t c"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == native.encode(text)


def test_all_texts_have_parity(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sentencepieces.parity(docs, path).where("NOT same").count() == 0
    assert Counter(r.same for r in sentencepieces.parity(odd, path).collect()) == Counter({True: len(ODD)})


def test_a_broken_backend_is_caught(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    true = sentencepieces.Model.merges
    monkeypatch.setattr(sentencepieces.Model, "merges", lambda self: true(self)[::-1])
    broken = sentencepieces.Codec(path)
    with pytest.raises(sentencepieces.Different):
        list(broken.encode([" ".join(f"{a}{b}{c}" for a in ("inter", "trans", "re", "con", "de") for b in ("ac", "la", "na", "duc", "mo", "vo", "sta") for c in ("tion", "tional", "ting", "ted", "tive"))]))


def test_every_new_word_is_held_against_the_library():
    class Off:
        def encode_batch_fast(self, words, add_special_tokens):
            return [SimpleNamespace(ids=[7]) for _ in words]

    broken = sentencepieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    broken.library = Off()
    for word in "one of these words after another is encoded by a library that is wrong about all".split():
        with pytest.raises(sentencepieces.Different):
            list(broken.encode([word]))


def test_words_without_blanks_are_not_remembered():
    own = sentencepieces.Codec(public_tokenizers.path("piece_bpe_32k.model"), verify=1)
    native = own.native
    texts = ["漢字仮名" * 300 + str(k) for k in range(20)] + ["short words are " * 9, "x" * 65 + " y", ""]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == native.encode(text)
    assert max(map(len, own.memo.young)) <= sentencepieces.LONGEST and own.memo.held < 10_000


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(sentencepieces, "MEMO", 1000)
    own = sentencepieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    for k in range(30):
        assert np.frombuffer(next(own.encode([f"some words {k} and {k * k}"])), "<i4").tolist() == own.native.encode(f"some words {k} and {k * k}")
        assert own.memo.held < 3000 and sum(len(k) + len(v) + sentencepieces.COST for part in (own.memo.young, own.memo.old) for k, v in part.items()) < 6000


def test_unigram_models_are_rebuilt(tmp_path):
    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    def field(number, value):
        return varint(number << 3 | 2) + varint(len(value)) + value

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + varint(2 << 3 | 5) + np.float32(score).tobytes() + varint(3 << 3) + varint(kind))

    parts = [piece("<unk>", 0, 2), piece("▁a", -1, 1), piece("b", -2, 1), piece("▁ab", -1.5, 1)]
    model = tmp_path / "tiny.model"
    model.write_bytes(b"".join(parts) + field(2, varint(3 << 3) + varint(1)) + field(3, varint(3 << 3) + varint(1)))
    own = sentencepieces.Model(str(model))
    assert own.algorithm == sentencepieces.UNIGRAM and own.dummy_prefix
    assert own.backend().encode("▁ab").ids == [3] and own.backend().encode("▁abb").ids == [3, 2]


def plain_targets(sizes):
    """Weights share the total; what is above a cap is shared anew among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return target


def check_mix(docs, found):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    target = plain_targets(sizes)
    assert Counter((r.id, r.size) for r in found) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in docs)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    return sizes, target, taken


def test_mixing(spark, docs):
    held = spark.createDataFrame([(d.doc_id, d.text, d.source) for d in docs], "doc_id long, text string, source string")
    found = mixing.copies(held).collect()
    sizes, target, taken = check_mix([(d.doc_id, d.text, d.source) for d in docs], found)
    for s in sizes:
        largest = max(r.size for r in found if r.source == s)
        assert abs(taken[s] - target[s]) <= 1.5 * largest
    again = mixing.copies(held.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_mixing_odd_rows(odd, none):
    check_mix([(d[0], d[1], d[3]) for d in ODD], mixing.copies(odd).collect())
    assert mixing.copies(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in mixing.copies(odd).collect())
