"""The pipeline against a plain version of all its stages."""

import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece

import corpus_pipeline
from sparkquarry.llm import mixing, quality
from tests.conftest import SMALL

from .conftest import CLASHING
from .test_native import plain_duplicates
from .test_shingles import plain_first
from .test_text import WORD, plain_quality, plain_shares, plain_targets


def plain_kept(text):
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    again = sum(len(x) for i, x in enumerate(lines) if x in lines[:i])
    shares = zip(plain_shares(text), quality.LIMITS.values())
    return not plain_quality(text)[5] and again <= quality.LINE_LIMIT * sum(map(len, lines)) and all(s <= most for s, most in shares)


def plain_copies(docs):
    """[(id, text, source)] -> id: copies."""
    sizes, of = Counter(), defaultdict(list)
    for i, text, source in docs:
        n = len(WORD.findall(text))
        sizes[source] += n
        place = ((i % 1000003) + 1) * 48271 % 2147483647
        of[source].append((mixing.CLASSES * (n + 1).bit_length() + ((n + 1) * mixing.CLASSES >> (n + 1).bit_length()), place * mixing.CELLS // 2147483647, place, n, i))
    out = {}
    for source, target in plain_targets(sizes).items():
        offset = int(hashlib.md5(f"{mixing.SEED}/{source}".encode()).hexdigest()[:8], 16) / 4294967296
        rate = target / sizes[source]
        for k, (*_, i) in enumerate(sorted(of[source]), 1):
            out[i] = math.floor(k * rate + offset) - math.floor((k - 1) * rate + offset)
    return out


def test_pipeline_equals_plain(spark):
    docs = [(d.doc_id, d.text, d.source) for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = [d for d in docs if plain_kept(d[1])]
    stay = {k[0] for k in plain_duplicates([d[:2] for d in docs]) if k[3]}
    docs = [d for d in docs if d[0] in stay]
    first = plain_first([d[:2] for d in docs])
    assert len(first) < len(docs)
    docs = [d for d in docs if d[0] in first]
    copies = plain_copies(docs)
    native = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter({(d[0], tuple(native.encode(d[1]))): copies[d[0]] for d in docs if copies[d[0]]})
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == expected
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


def test_stages_on_odd_rows(spark, odd, none):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (odd, none):
            left = stage(spark, docs, SMALL)
            rows = left.collect()
            assert k == len(corpus_pipeline.STAGES) - 1 or left.columns == docs.columns
            assert len(rows) <= 3 * docs.count() and (docs is odd or not rows)
            # what a caller's own columns hold is returned as it was
            assert k == len(corpus_pipeline.STAGES) - 1 or all(r[name] == "clash" for r in rows for name in CLASHING)
    assert {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, odd, SMALL).collect()} >= {4, 5, 6, 7, -8, 9}
