"""URL filters, exact duplicates and license scans against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from sparkquarry.llm import blocks, licenses, queries, signatures, urls
from tests.conftest import SMALL

from .conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()


def plain_duplicates(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in sorted(ids, key=lambda i: i != keep):
            out[i, keep, len(ids), i == keep and left, hashlib.sha256(text.encode()).hexdigest()] += 1
            left = False
    return out


def test_duplicates_equal_plain(spark, docs):
    found = Counter(map(tuple, queries.op7_blocks(spark, SMALL).collect()))
    assert found == plain_duplicates([tuple(d) for d in docs])


@pytest.mark.parametrize("size", [1 << 12, 7])
def test_duplicates_odd_rows(odd, none, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK", size)
    assert Counter(map(tuple, blocks.duplicates(odd).collect())) == plain_duplicates([d[:2] for d in ODD])
    assert blocks.duplicates(none).count() == 0
    left = blocks.drop_duplicates(odd)
    assert left.columns == odd.columns
    stay = Counter(k[0] for k, n in plain_duplicates([d[:2] for d in ODD]).items() if k[3] for _ in range(n))
    assert Counter(r.doc_id for r in left.collect()) == stay


def test_names_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)
    texts = ["abc" * 9, "abc" * 9 + "a", "ABC" * 9, "abcabcabd" * 3, "abc" * 8, "abc" * 16, "abc" * 16, "", "ab", "éé" * 5, "éé" * 5, "ÉÉ" * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(map(tuple, blocks.duplicates(docs).collect())) == plain_duplicates(list(enumerate(texts)))


def test_contents_with_one_hash_have_different_names(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(blocks, "BLOCK", 4)
    true = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *columns: true(*columns) if all(isinstance(c, str) for c in columns) else F.lit(7).cast("long"))
    texts = ["abcdefgh", "abcdxxxx", "abcdefgh", "abcd", "xxxxabcd", "", "abcdefghabcd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shorts = docs.select("doc_id", blocks._shorts(docs, F.col("text"))(F.col("text")).alias("shorts"))
    same = shorts.join(blocks.identified(shorts.select("shorts", F.lit(1).alias("n")).distinct()), "shorts")
    names = [r.same for r in same.orderBy("doc_id").collect()]
    assert [[a == b for a in names] for b in names] == [[a == b for a in texts] for b in texts]


WORD = re.compile(licenses.WORD)


def plain_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for label, phrase in licenses.BASE:
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


SIGNATURES = [(x, re.compile(x.pattern.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010FFFF"))) for x in signatures.signatures()]


def plain_found(text):
    """(first word, word past the end, signature) of every match, with neither gate nor keywords."""
    words = " " + "  ".join(WORD.findall((text or "").translate(LOWER))) + " "
    return [(len(words[: m.start()].split()), len(words[: m.end()].split()), x) for x, pattern in SIGNATURES for m in pattern.finditer(words)]


def plain_labels(text):
    found = plain_found(text)

    def hides(one, two):
        (a, b, x), (c, d, y) = one, two
        return a <= c and d <= b and x.priority >= y.priority and ((a, b) != (c, d) or x.priority > y.priority or x.order < y.order)

    kept = [x for a, b, x in found if not any(hides(other, (a, b, x)) for other in found) and x.label]
    base = {x.label for _, _, x in found if not x.priority}
    return {x.label for x in kept} | base, max([x.confidence for x in kept] + [0.9] * bool(base), default=0.0)


TEXTS = [
    "Released under the MIT license.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0 here", "under  the\nMIT-license and under the MIT License",
    "not licensed under the Apache License, Version 2.0 at all", "SPDX-License-Identifier: Apache 2.0", "the mit license; apache license version 1.1", "éunder the mit license", "cc by nc sa 4.0", "CC0 1.0", "a cc b", "All rights reserved", "mit 0", "public-domain",
]


def test_licenses_equal_plain(spark, docs):
    texts = {d.doc_id: d.text for d in docs} | {-k: t for k, t in enumerate(TEXTS, 1)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in licenses.scan(table).collect():
        assert tuple(r)[1:6] == plain_base(texts[r.id]), texts[r.id]
        assert (set(filter(None, r.labels.split(","))), r.score) == plain_labels(texts[r.id]), texts[r.id]


def test_licenses_odd_rows(odd, none):
    found = licenses.scan(odd).select("id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert Counter(map(tuple, found)) == Counter((d[0], *plain_base(d[1])) for d in ODD)
    assert licenses.scan(none).count() == 0


def example(parsed, rng):
    """A string that a parsed pattern matches."""
    out = ""
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "IN":
            what, chosen = rng.choice(value)
            out += chr(chosen if str(what) == "LITERAL" else rng.choice(chosen))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            out += "".join(example(inner, rng) for _ in range(rng.randint(least, min(most, 12))))
        elif kind == "SUBPATTERN":
            out += example(value[3], rng)
        elif kind == "BRANCH":
            out += example(rng.choice(value[1]), rng)
        else:
            raise AssertionError(kind)
    return out


def test_every_signature_passes_gate_and_keywords(spark):
    """Sentences that each signature matches, at random, in odd spelling."""
    rng = random.Random(11)
    texts = {}
    for x, pattern in SIGNATURES:
        for _ in range(4):
            words = example(re._parser.parse(pattern.pattern), rng).split()
            texts[len(texts)] = "A " + "".join(w.upper() + rng.choice([" ", "  ", "-", ".\n", ", "]) for w in words) + "b"
            assert any(y is x for _, _, y in plain_found(texts[len(texts) - 1])), x
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in licenses.scan(table).collect():
        assert Counter((d.start, -d.minus_end, d.order) for d in r.found) == Counter((a, b, x.order) for a, b, x in plain_found(texts[r.id])), texts[r.id]
        assert (set(filter(None, r.labels.split(","))), r.score) == plain_labels(texts[r.id]), texts[r.id]
    assert len(SIGNATURES) > 250 and len({(x.priority, x.label, x.pattern) for x, _ in SIGNATURES}) == len(SIGNATURES)


def test_licenses_of_very_many_matches(spark):
    one = "Released under the MIT license. "
    texts = [one * 300, one * 70_000, "see cc by nc " * 1000 + "under the mit license"]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("id").collect()
    for r in found:
        assert tuple(r)[1:6] == plain_base(texts[r.id])
    assert (set(found[0].labels.split(",")), found[0].score) == plain_labels(texts[0])
    assert (found[1].labels, found[1].score) == (found[0].labels, found[0].score)


def plain_rule(url):
    m = re.search(r"://", url or "")
    if not m:
        return "", "", None, None
    rest = url[m.end() :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = []
    for what, rule in urls.RULES:
        own, _, more = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + more):
            fits.append((len(rule), rule, what))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    found = queries.op1_urls(spark, SMALL).collect()
    assert len(found) == len(pages)
    for r in found:
        host, path, rule, what = plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (what or ("block" if r.score > 0.5 else "allow"))


def test_urls_odd_rows(spark):
    odd = [None, "", "no scheme.com/en/", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en/", "http://xexample.com/en/", "http://a.net/es/?q#f", "http://net/fr/1", "http://É.com", "http://a.com?x=/en/", "x://y://z.com/", "http://www.example.com/EN/", "http://com/"]
    pages = spark.createDataFrame([(k, u, "clash", 0.5) for k, u in enumerate([*odd, *odd])] + [(None, None, None, None)], "page_id long, url string, host string, score double")
    for r in urls.judge(pages).collect():
        assert (r.host, r.path, r.rule) == plain_rule(r.url)[:3], r.url
        assert r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_of_odd_characters(spark):
    """Hosts that mean something in SQL, regular expressions or substitution, and very long ones, are statistics like any others."""
    odd = ["${a}.com", "${b}.com", "$1.net", "'; drop", '"q".net', "a\\b.com", "%s.com", "{{x}}.net", "`b`.com", "a.b.c.d.e.f.g.com", "x" * 70_000 + ".net", ".com", "..net", "com", "\u0000.com"]
    rows = [(k, f"http://{host}/{path}") for k, (host, path) in enumerate((h, p) for h in odd for p in ("es/", "fr/x", "", "y" * 3000))]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path, r.rule) == plain_rule(r.url)[:3] and 0 <= r.score <= 1


def plain_score(trees, row):
    total = 0.0
    for tree in trees:
        while not isinstance(tree, float):
            name, cut, low, high = tree
            tree = low if row[name] <= cut else high
        total += tree
    return 1 / (1 + math.exp(-total))


def test_verdicts_are_those_of_the_trees(spark):
    """The score of every page from its features, walked tree by tree."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    host, path = urls.split_url(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    _, what = urls.rule_of(F.col("host"), F.col("path"))
    known = own.withColumn("by_rule", what).where("by_rule IS NOT NULL").select("url", "host", "path", (F.col("by_rule") == "block").cast("int").alias("label"))
    model = urls.train(known)
    assert model.trees
    features = {r.page_id: r for r in model.with_statistics(urls.lexical(own, "url")).collect()}
    for r in queries.op1_urls(spark, SMALL).collect():
        assert r.score == pytest.approx(plain_score(model.trees, features[r.page_id]))
        if r.rule is None:
            assert r.verdict == ("block" if r.score > 0.5 else "allow")


def test_trees_learn_what_is_labelled(spark):
    def url(k):
        bad = k % 3 == 0
        return f"http://{'win-free-' if bad else 'site'}{k % 50}.example.{'org' if k % 2 else 'net'}/p{k}{'?a=1&b=2&c=3' if bad else ''}", int(bad)

    table = spark.createDataFrame([url(k) for k in range(1200)], "url string, label int")
    learn, test = table.where("pmod(xxhash64(url), 4) > 0"), table.where("pmod(xxhash64(url), 4) = 0")
    found = urls.judge(test.selectExpr("label AS page_id", "url"), rules=(), labelled=learn).collect()
    assert sum((r.verdict == "block") == bool(r.id) for r in found) >= 0.97 * len(found) > 200
