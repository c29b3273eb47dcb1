"""Statistics of all labelled URLs, and a sample of different ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkquarry.llm import urls


def test_statistics_cover_all_rows_and_the_sample_different_urls(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE", 40)
    rows = [(f"https://www.site{k}.{('com', 'net', 'org')[k % 3]}/en/{j}", int(k % 4 == 0)) for k in range(150) for j in range(2)]
    # the URL that comes first by its hash stands many times
    first = spark.createDataFrame(rows, "url string, label int").orderBy(F.xxhash64("url"), "url").first()
    rows += [(first.url, first.label)] * 500
    host, path = urls.split_url(F.col("url"))
    known = spark.createDataFrame(rows, "url string, label int").withColumns({"host": host, "path": path})
    model = urls.train(urls.lexical(known, "url"))
    assert model.trees
    n, ones = len(rows), sum(label for _, label in rows)
    block, allow = n / (2 * ones), n / (2 * (n - ones))
    found = model.with_statistics(urls.lexical(known, "url")).select("url", "suffix_share", "domain_share").distinct().collect()
    assert len(found) == 300
    for column, name in (("domain_share", lambda u: u.split("/")[2].removeprefix("www.")), ("suffix_share", lambda u: u.split("/")[2].rpartition(".")[2])):
        yes, no = Counter(), Counter()
        for url, label in rows:
            (yes if label else no)[name(url)] += 1
        for r in found:
            a, b = block * yes[name(r.url)], allow * no[name(r.url)]
            assert r[column] == pytest.approx((a + urls.SMOOTH / 2) / (a + b + urls.SMOOTH))
