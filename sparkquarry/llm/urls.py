"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, checkpointed

#: What a rule says, and the host and path that it fits.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Different labelled URLs that the trees learn from, at most; statistics are of all rows.
SAMPLE = 6000
#: Parts that the rows of one suffix are dealt into: few suffixes have most of the rows.
PARTS = 32
TREES, DEPTH, BINS, RATE, PENALTY, LEAST, SMOOTH = 30, 3, 32, 0.3, 1.0, 1.25, 10.0
#: A URL that the trees learn from sees the statistics of the other parts alone, so no label is known to its own features.
FOLDS = 5
FEATURES = ("url_length", "host_length", "labels", "hyphens", "depth", "path_length", "digit_ratio", "host_digits", "entropy", "parameters", "suffix_share", "domain_share")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null URLs and those without ://."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. A rule is one comparison of the two columns, so
    the list belongs in the plan, and a list too long for that in a join on the suffixes of the host."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    weighed = F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda total, c: total + F.when(c == "", 0.0).otherwise((F.length(text) - F.length(F.replace(text, c))) * F.log2((F.length(text) - F.length(F.replace(text, c))).cast("double")))
    )
    return F.when(n > 0, F.log2(n) - weighed / n).otherwise(F.lit(0.0))


def lexical(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds the features that need no statistics, and the suffixes that need them. Null URLs are empty ones."""
    url, host, path = F.coalesce(F.col(url_col), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]")).cast("double")
    return pages.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "labels": F.size(F.split(host, r"\.")).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"), "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"), "path_length": F.length(path).cast("double"),
        "digit_ratio": digits(url) / F.greatest(F.length(url), F.lit(1)), "host_digits": digits(host), "entropy": entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        "suffix": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2),
    })


@dataclass
class Trees:
    """A base score, and trees as nested (feature, threshold, left, right) or leaf values; statistics of suffixes."""

    base: float = 0.0
    trees: list = field(default_factory=list)
    suffixes: DataFrame | None = None
    domains: DataFrame | None = None

    def score(self) -> Column:
        """The log-odds of blocking, as one expression."""
        return reduce(lambda total, tree: total + _value(tree), self.trees, F.lit(self.base))

    def with_statistics(self, pages: DataFrame) -> DataFrame:
        """Joins the shares of suffixes and domains; a common suffix is dealt into parts, a common domain is left to the skew handling of adaptive execution."""
        prior = F.lit(_sigmoid(self.base))
        if self.suffixes is None or self.domains is None:
            return pages.withColumns({"suffix_share": prior, "domain_share": prior})
        dealt = self.suffixes.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        pages = pages.withColumn("__part", F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int")).join(dealt, ["suffix", "__part"], "left").drop("__part")
        pages = pages.join(self.domains, "domain", "left")
        return pages.withColumns({name: F.coalesce(name, prior) for name in ("suffix_share", "domain_share")})


def _sigmoid(x: float) -> float:
    return 1 / (1 + 2.718281828459045**-x)


def _value(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, threshold, left, right = tree
    return F.when(F.col(name) <= threshold, _value(left)).otherwise(_value(right))


def train(labelled: DataFrame) -> Trees:
    """Boosts trees on URLs (url, host, path and `label`, 1: block, 0: allow): at most SAMPLE different ones, those that come
    first by a hash of the URL. The shares of suffixes and domains are counted over all rows; for a URL of the sample, over
    those of the other folds. The sample's features, a bounded table of numbers, come to the driver, which chooses the
    splits. No rows, or one label only: no trees, and the base score says what was seen."""
    counts = checkpointed(lexical(labelled, "url").groupBy("suffix", "domain", _fold().alias("fold")).agg(F.sum("label").alias("ones"), F.count("*").alias("n")))
    n, ones = counts.agg(F.sum("n"), F.sum("ones")).first()
    n, ones = n or 0, ones or 0
    if not n or ones in (0, n):
        return Trees(base=_log_odds(ones + 0.5, n - ones + 0.5) if n else -5.0)
    # both labels weigh alike in all: what is known of neither stands in the middle
    block, allow = n / (2 * ones), n / (2 * (n - ones))
    share = lambda yes, no: (yes + SMOOTH / 2) / (yes + no + SMOOTH)
    shares, sample = {}, _sampled(labelled).withColumn("fold", _fold())
    for key in ("suffix", "domain"):
        parts = counts.groupBy(key, "fold").agg((block * F.sum("ones")).alias("own_yes"), (allow * (F.sum("n") - F.sum("ones"))).alias("own_no"))
        found = parts.groupBy(key).agg(F.sum("own_yes").alias("yes"), F.sum("own_no").alias("no"))
        shares[key] = checkpointed(found.select(key, share(F.col("yes"), F.col("no")).alias(f"{key}_share")))
        others = parts.join(found, key).select(key, "fold", share(F.greatest(F.col("yes") - F.col("own_yes"), F.lit(0.0)), F.greatest(F.col("no") - F.col("own_no"), F.lit(0.0))).alias(f"{key}_share"))
        sample = sample.join(others, [key, "fold"])
    learnt = np.array(sample.select("label", *FEATURES).collect(), np.float64)
    learnt = learnt[np.lexsort(learnt.T)]
    return Trees(0.0, boosted(learnt[:, 1:], learnt[:, 0]), shares["suffix"], shares["domain"])


def _fold() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")


def _sampled(labelled: DataFrame) -> DataFrame:
    """The features of the different URLs that the trees learn from."""
    return lexical(labelled.select("url", "host", "path", "label").distinct().orderBy(F.xxhash64("url"), "url", "label").limit(SAMPLE), "url")


def _log_odds(yes: float, no: float) -> float:
    return float(np.log(yes / no))


def boosted(x: np.ndarray, y: np.ndarray) -> list:
    """Trees for a table of features and labels, by gradients of the log loss; labels weigh alike in all."""
    edges = [_cuts(column) for column in x.T]
    bins = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    weight = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-score))
        g, h = weight * (chance - y), weight * chance * (1 - chance)
        tree = _tree(bins, edges, g, h, np.arange(len(y)), DEPTH, score)
        if isinstance(tree, float):
            break  # nothing is left to split
        trees.append(tree)
    return trees


def _cuts(column: np.ndarray) -> np.ndarray:
    """Up to BINS - 1 cuts between the values of a feature, at their quantiles, so that a value never seen goes with the nearer ones."""
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="lower"))
    return (values[1:] + values[:-1]) / 2


def _tree(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, score: np.ndarray):
    """The best tree over some rows, whose leaves are added to their scores. Gains are rounded, and the first of equal splits is taken."""
    whole_g, whole_h = g[rows].sum(), h[rows].sum()
    gain_of = lambda a, b: a * a / (b + PENALTY)
    most, split = 1e-6, None
    for feature in range(bins.shape[1] if depth else 0):
        of, n = bins[rows, feature], len(edges[feature]) + 1
        left_g, left_h = (np.cumsum(np.bincount(of, v[rows], n))[:-1] for v in (g, h))
        gain = np.round(gain_of(left_g, left_h) + gain_of(whole_g - left_g, whole_h - left_h) - gain_of(whole_g, whole_h), 6)
        gain[(np.minimum(left_h, whole_h - left_h) < LEAST)] = 0
        if len(gain) and gain.max() > most:
            most, split = gain.max(), (feature, int(gain.argmax()))
    if split is None:
        leaf = round(float(-RATE * whole_g / (whole_h + PENALTY)), 9)
        score[rows] += leaf
        return leaf
    feature, cut = split
    low = bins[rows, feature] <= cut
    left, right = (_tree(bins, edges, g, h, rows[side], depth - 1, score) for side in (low, ~low))
    return FEATURES[feature], float(edges[feature][cut]), left, right


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, url_of: str = "url", label_of: str = "label") -> DataFrame:
    """(id, url, host, path, rule, verdict, score) of every row: the longest rule's verdict, else that of the trees.

    The trees learn from `labelled` (a URL and 1 to block or 0 to allow), or, without it, from the URLs that the
    rules decide. Null URLs and those without :// have an empty host and path, fit no rule and are judged by
    the trees like any other. Null ids and repeated rows are judged like any others; an empty table, or no labels,
    gives no trees, and the verdict is then to allow.
    """

    def parsed(table: DataFrame, column: str, *more) -> DataFrame:
        host, path = split_url(F.col(column))
        return table.select(*more, F.col(column).alias("url"), host.alias("host"), path.alias("path"))

    own = parsed(pages, url_col, F.col(id_col).cast("long").alias("id"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    decided = own.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    if labelled is None:
        known = decided.where("by_rule IS NOT NULL").select("url", "host", "path", (F.col("by_rule") == "block").cast("int").alias("label"))
    else:
        known = parsed(labelled, url_of, F.col(label_of).cast("int").alias("label")).where("label IS NOT NULL")
    model = train(known)
    scored = model.with_statistics(lexical(decided, "url")).withColumn("score", 1 / (1 + F.exp(-model.score())))
    learnt = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("id", "url", "host", "path", "rule", F.coalesce("by_rule", learnt).alias("verdict"), "score")
