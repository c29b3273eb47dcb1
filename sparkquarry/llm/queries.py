"""One query per text operator, over its whole table, with the columns that are agreed for it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, langid, licenses, mixing, quality, sentencepieces, signatures, simhash, suffixes, tokens, urls
from .common import table

TOKEN_BUDGET = 1024


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.repetition(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_share")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.over_budget(counts, TOKEN_BUDGET).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def op7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("found")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {f.__name__: f for f in (op1_urls, op2_simhash, op3_quality, op4_tokens, op5_suffixes, op6_langid, op7_blocks, op8_licenses, op9_sentencepiece, op10_mixing)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_WIDTHS = sorted({*quality.LIMITS, quality.BASE_WIDTH})

_OP3 = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
  w AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs),
  grams AS (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, gram) AS often FROM (
    SELECT r, n, unnest(range(1, len(words) - n + 2)) AS i, unnest([array_to_string(words[k : k + n - 1], ' ') for k in range(1, len(words) - n + 2)]) AS gram FROM docs, (VALUES {", ".join(f"({n})" for n in _WIDTHS)}) AS t(n) WHERE len(words) >= n)),
  inside AS (SELECT DISTINCT r, n, i + k AS i FROM grams, range(0, {max(_WIDTHS)}) AS t(k) WHERE often > 1 AND k < n),
  cover AS (SELECT r, n, count(*) AS words, sum(length(word)) AS chars FROM inside JOIN w USING (r, i) GROUP BY r, n),
  lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY k) AS again FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
  line AS (SELECT r, count(*) FILTER (again > 1) AS dups, coalesce(sum(length(line)) FILTER (again > 1), 0) / sum(length(line))::DOUBLE AS share FROM lines GROUP BY r),
  m AS (SELECT d.r, doc_id, len(words) AS n_words, coalesce(list_sum([length(x) for x in words]), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce((SELECT c.words FROM cover c WHERE c.r = d.r AND n = {quality.BASE_WIDTH}), 0) AS n_repeat_words, coalesce(share, 0.0)::DOUBLE AS line_share,
    {" AND ".join(f"coalesce((SELECT chars FROM cover c WHERE c.r = d.r AND n = {n}), 0) / greatest(1, coalesce(list_sum([length(x) for x in words]), 0))::DOUBLE <= {limit}::DOUBLE" for n, limit in quality.LIMITS.items())} AS plain
    FROM docs d LEFT JOIN line ON line.r = d.r)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_share, n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.BASE_PERCENT} * n_words AS base_failed,
    NOT (n_words < {quality.BASE_WORDS} OR 100 * n_repeat_words > {quality.BASE_PERCENT} * n_words) AND line_share <= {quality.LINE_LIMIT}::DOUBLE AND plain AS kept FROM m"""

_OP7 = """WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
  placed AS (SELECT doc_id, low, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size, row_number() OVER (PARTITION BY low, doc_id) AS k FROM docs)
  SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND k = 1 AS kept, sha256(low) AS text_sha256 FROM placed"""

_OP10 = f"""WITH docs AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, (((coalesce(doc_id, 0) % 1000003 + 1000003) % 1000003 + 1) * 48271) % 2147483647 AS place FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
  ranked AS (SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM s),
  capped AS (SELECT *, row_number() OVER o AS pos, (sum(source_size) OVER () - {mixing.MOST} * coalesce(sum(source_size) OVER p, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS share FROM ranked
    WINDOW o AS (ORDER BY {float(mixing.MOST)}::DOUBLE * source_size / weight, source NULLS LAST), p AS (ORDER BY {float(mixing.MOST)}::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  level AS (SELECT arg_min(share, pos) AS level FROM capped WHERE share * weight <= {mixing.MOST} * source_size),
  aims AS (SELECT source, source_size, least(level * weight, ({mixing.MOST} * source_size)::DOUBLE) AS target, ('0x' || substr(md5('{mixing.SEED}/' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift FROM capped, level),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ({mixing.CLASSES} * length(bin(size + 1)) + floor((size + 1) * {mixing.CLASSES} / pow(2.0::DOUBLE, length(bin(size + 1)))))::INTEGER, place * {mixing.CELLS} // 2147483647, place, size, doc_id NULLS FIRST) AS k FROM docs)
  SELECT doc_id, size, source_size, target, ((floor(k * rate + shift) - floor((k - 1) * rate + shift)) * size)::BIGINT AS taken
  FROM (SELECT n.*, source_size, target, shift, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM numbered n JOIN aims a ON n.source IS NOT DISTINCT FROM a.source)"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SIGNED = ", ".join(f"({x.order}, {x.priority}, {_quoted(x.label)}, {_quoted(x.keywords[0])}, {_quoted(f' ({x.pattern[1:-1]}) ')}, {x.confidence}::DOUBLE)" for x in signatures.signatures())

#: Matches are marked, split into words, and held against each other pair by pair.
_OP8 = f"""WITH signed AS (SELECT * FROM (VALUES {_SIGNED}) AS t(k, priority, label, keyword, pattern, worth)),
  docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
  joined AS (SELECT r, ' ' || array_to_string(words, '  ') || ' ' AS held FROM docs),
  marked AS (SELECT r, k, priority, label, worth, string_split(regexp_replace(held, pattern, ' <\\1> ', 'g'), '  ') AS w FROM joined JOIN signed ON contains(held, keyword) WHERE regexp_matches(held, pattern)),
  ends AS (SELECT *, [i for i in range(1, len(w) + 1) if contains(w[i], '<')] AS a, [i for i in range(1, len(w) + 1) if contains(w[i], '>')] AS b FROM marked),
  hits AS (SELECT r, k, priority, label, worth, unnest(a) - 1 AS s, unnest(b) AS e FROM ends),
  kept AS (SELECT * FROM hits h WHERE label <> '' AND NOT EXISTS (SELECT 1 FROM hits g WHERE g.r = h.r AND g.s <= h.s AND g.e >= h.e AND g.priority >= h.priority AND (g.s < h.s OR g.e > h.e OR g.priority > h.priority OR g.k < h.k))),
  base AS (SELECT r, count(*) AS n, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits WHERE priority = 0 GROUP BY r),
  named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(worth) AS score FROM (SELECT r, label, worth FROM kept UNION ALL SELECT r, label, worth FROM hits WHERE priority = 0) GROUP BY r)
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(m.labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
  FROM docs LEFT JOIN base b USING (r) LEFT JOIN named m USING (r)"""

#: The others have no SQL: fingerprints, pieces, trees and machines aren't in its reach, and the strings of all bytes are too
#: many for it. Tests hold them against plain versions.
ORACLES: dict[str, str] = {"op3_quality": _OP3, "op7_blocks": _OP7, "op8_licenses": _OP8, "op10_mixing": _OP10}
