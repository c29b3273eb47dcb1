"""Every named query over the test tables, with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs, errors, paths, text
from ..operators import cache, chunks, graph, history, hotspots, inventory, vector
from ..sources import parse
from . import stand_ins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.supported(S.files(spark, sf_dir))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.with_hash(_inventory(spark, sf_dir))


# inventory


@query(f"WITH {S.INVENTORY} SELECT ord, rel_path, language, size_bytes FROM inventory")
def inventory_supported(spark, sf_dir):
    return _inventory(spark, sf_dir).select("ord", "rel_path", "language", "size_bytes")


@query(f"WITH {S.FILES} SELECT rel_path FROM files WHERE rel_path LIKE 'node_modules/%'")
def ignored_paths(spark, sf_dir):
    return inventory.passed_over(S.files(spark, sf_dir)).select("rel_path")


@query(f"WITH {S.INVENTORY} SELECT language, count(*) AS n_files, min(ord) AS first_ord FROM inventory GROUP BY language")
def language_stats(spark, sf_dir):
    return inventory.language_counts(_inventory(spark, sf_dir)).orderBy("first_ord")


@query(f"WITH {S.INVENTORY} SELECT coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes FROM inventory")
def total_size(spark, sf_dir):
    return inventory.total_size(_inventory(spark, sf_dir))


#: Forms of paths, in which @ is a number: the extension, and whether a scan passes them over.
_PATHS = (("a/b@.PY", ".py", False), (".py", "", False), ("x/.hidden@.js", ".js", False), ("noext@", "", False), ("a.b/c@", "", False), ("a/b@.tar.gz", ".gz", False), ("..a@.ts", ".ts", False), ("d/build", "", False), ("build/d@.py", ".py", True))
_FORMS, _SUFFIXES, _PASSED = zip(*_PATHS)


@query(
    f"WITH forms AS (SELECT doc_id AS ord, replace({S.chosen_sql(_FORMS, 'doc_id')}, '@', doc_id::VARCHAR) AS path, {S.chosen_sql(_SUFFIXES, 'doc_id')} AS ext, {S.chosen_sql(_PASSED, 'doc_id')} AS is_ignored FROM documents)"
    " SELECT ord, path, ext, replace(substr(path, 1, length(path) - length(ext)), '/', '.') AS module, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, is_ignored FROM forms"
)
def path_functions(spark, sf_dir):
    p = F.col("path")
    rows = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.replace(S.chosen(_FORMS, F.col("doc_id")), F.lit("@"), F.col("doc_id").cast("string")).alias("path"))
    return rows.select("ord", "path", paths.extension(p).alias("ext"), paths.module(p).alias("module"), paths.directory(p).alias("dir"), paths.basename(p).alias("base"), paths.ignored(p).alias("is_ignored"))


# cache and cost


@query(f"WITH {S.INVENTORY} SELECT rel_path, sha256 FROM inventory")
def file_hashes(spark, sf_dir):
    return _hashed(spark, sf_dir).select("rel_path", "sha256")


@query(f"WITH {S.INVENTORY} SELECT dir, count(*) AS n_files, string_agg(rel_path, ',' ORDER BY rel_path) AS files FROM inventory GROUP BY dir")
def dir_groups(spark, sf_dir):
    return cache.directories(_inventory(spark, sf_dir)).withColumn("files", F.array_join("files", ","))


@query(f"WITH {S.INVENTORY}, {S.DIRECTORIES} SELECT dir, n_files, sha256 FROM dirs")
def dir_combined_hash(spark, sf_dir):
    return cache.directory_hashes(_hashed(spark, sf_dir))


@query(f"WITH {S.INVENTORY}, {S.SNAPSHOT} SELECT rel_path, summary FROM inventory i JOIN cache c ON c.key = i.rel_path AND c.sha256 = i.sha256")
def cache_hits(spark, sf_dir):
    return cache.hits(_hashed(spark, sf_dir), S.snapshot(_inventory(spark, sf_dir))).select("rel_path", "summary")


@query(f"WITH {S.INVENTORY}, {S.SNAPSHOT} SELECT rel_path, (length(content) // 4)::BIGINT AS tokens FROM inventory i WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.key = i.rel_path AND c.sha256 = i.sha256)")
def cache_misses(spark, sf_dir):
    return cache.misses(_hashed(spark, sf_dir), S.snapshot(_inventory(spark, sf_dir))).select("rel_path", costs.tokens(F.col("content")).alias("tokens"))


@query(f"WITH {S.INVENTORY}, {S.DIRECTORIES} SELECT dir, n_files FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM dir_cache c WHERE c.key = d.dir AND c.sha256 = d.sha256)")
def cache_dir_misses(spark, sf_dir):
    hashes = cache.directory_hashes(_hashed(spark, sf_dir))
    return cache.misses(hashes, S.directory_snapshot(hashes), "dir").select("dir", "n_files")


@query(f"WITH {S.INVENTORY}, {S.SNAPSHOT}, fresh AS (SELECT rel_path AS key, sha256, 'new' AS summary FROM inventory WHERE ord % 3 = 0) SELECT * FROM fresh UNION ALL SELECT * FROM cache WHERE key NOT IN (SELECT key FROM fresh)")
def cache_upsert(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    fresh = hashed.where("ord % 3 = 0").select(F.col("rel_path").alias("key"), "sha256", F.lit("new").alias("summary"))
    return cache.upsert(S.snapshot(_inventory(spark, sf_dir)), fresh)


@query(f"WITH {S.INVENTORY} SELECT rel_path, (length(content) // 4)::BIGINT AS tokens FROM inventory")
def token_estimate(spark, sf_dir):
    return _inventory(spark, sf_dir).select("rel_path", costs.tokens(F.col("content")).alias("tokens"))


_MISSED = f"{S.INVENTORY}, {S.SNAPSHOT}, missed AS (SELECT count(*) AS n, coalesce(sum(length(content) // 4), 0)::BIGINT AS tokens FROM inventory i WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.key = i.rel_path AND c.sha256 = i.sha256))"


@query(f"WITH {_MISSED} SELECT n AS uncached_files, tokens AS input_tokens, trunc(tokens * 0.25)::BIGINT AS output_tokens, round(tokens / 1e6 * 0.15::DOUBLE + trunc(tokens * 0.25) / 1e6 * 0.6::DOUBLE, 8) AS cost FROM missed")
def scan_cost(spark, sf_dir):
    return cache.scan_cost(_hashed(spark, sf_dir), S.snapshot(_inventory(spark, sf_dir)), "gpt-4o-mini").withColumn("cost", F.round("cost", 8))


@query(
    f"WITH {_MISSED}, {S.DIRECTORIES}, md AS (SELECT count(*) AS n, coalesce(sum(n_files), 0)::BIGINT AS files FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM dir_cache c WHERE c.key = d.dir AND c.sha256 = d.sha256)), nd AS (SELECT count(*) AS n FROM dirs),"
    " t AS (SELECT missed.n AS uf, md.n AS ud, missed.tokens + 150 * md.files + CASE WHEN md.n > 0 THEN 150 * nd.n ELSE 0 END AS i, 150 * (missed.n + md.n) + CASE WHEN md.n > 0 AND nd.n > 0 THEN 800 ELSE 0 END AS o FROM missed, md, nd)"
    " SELECT uf AS uncached_files, ud AS uncached_dirs, i::BIGINT AS input_tokens, o::BIGINT AS output_tokens, round(i / 1e6 * 2.5::DOUBLE + o / 1e6 * 10::DOUBLE, 8) AS cost FROM t"
)
def doc_cost(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    known = S.snapshot(_inventory(spark, sf_dir)).unionByName(S.directory_snapshot(cache.directory_hashes(hashed)))
    return cache.document_cost(hashed, known, "gpt-4o", True).withColumn("cost", F.round("cost", 8))


_MODELS = [*costs.PRICES, "unknown-model", "GPT-4O"]
_PRICED = [costs.PRICES.get(m, costs.OTHER) for m in _MODELS]


@query(f"SELECT event_id, {S.chosen_sql(_MODELS, 'event_id')} AS model, ({S.chosen_sql([p for p, _ in _PRICED], 'event_id')})::DOUBLE AS input, ({S.chosen_sql([p for _, p in _PRICED], 'event_id')})::DOUBLE AS output FROM events")
def price_lookup(spark, sf_dir):
    return costs.priced(S.table(spark, sf_dir, "events").select("event_id", S.chosen(_MODELS, F.col("event_id")).alias("model"))).select("event_id", "model", "input", "output")


# history and hotspots


@query(f"WITH {S.FILES}, {S.COMMITS} SELECT rel_path, count(*) AS churn FROM commits GROUP BY rel_path")
def churn(spark, sf_dir):
    return history.churn(S.file_commits(spark, sf_dir))


@query(f"WITH {S.FILES}, {S.COMMITS} SELECT rel_path, count(DISTINCT author) AS authors FROM commits GROUP BY rel_path")
def authors_distinct(spark, sf_dir):
    return history.authors(S.file_commits(spark, sf_dir))


@query(f"WITH {S.FILES}, {S.COMMITS} SELECT rel_path, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_modified FROM commits GROUP BY rel_path")
def last_modified(spark, sf_dir):
    return history.last_modified(S.file_commits(spark, sf_dir))


_HOT = f"""WITH {S.INVENTORY}, {S.COMMITS}, m AS (SELECT rel_path, count(*) AS churn, count(DISTINCT author) AS authors, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_modified FROM commits GROUP BY rel_path),
  h AS (SELECT ord, i.rel_path, {S.COMPLEXITY} AS complexity, coalesce(churn, 0) AS churn, coalesce(authors, 0) AS authors, coalesce(last_modified, 'Unknown') AS last_modified FROM inventory i LEFT JOIN m ON m.rel_path = i.rel_path)
  SELECT *, complexity * churn AS score FROM h"""


def _hotspots(spark, sf_dir):
    files = _inventory(spark, sf_dir)
    known = history.metrics(S.file_commits(spark, sf_dir))
    return hotspots.hotspots(files.select("ord", "rel_path", S.complexity(F.col("content")).alias("complexity")), known).select("ord", "rel_path", "complexity", "churn", "authors", "last_modified", "score")


@query(_HOT)
def hotspots_(spark, sf_dir):
    return _hotspots(spark, sf_dir).orderBy(*hotspots.report_order())


QUERIES["hotspots"], ORACLES["hotspots"] = QUERIES.pop("hotspots_"), ORACLES.pop("hotspots_")


@query(_HOT + " ORDER BY score DESC, ord")
def hotspots_doc_order(spark, sf_dir):
    return _hotspots(spark, sf_dir).orderBy(*hotspots.document_order())


_RANGES = f"{S.SYMBOLS}, {S.BLAME}, hit AS (SELECT DISTINCT s.rel_path, s.ord, b.event_id FROM symbols s JOIN blame b ON b.rel_path = s.rel_path AND b.line_no BETWEEN s.start_line AND s.end_line)"


@query(f"WITH {_RANGES} SELECT rel_path, ord, event_id::VARCHAR AS sha FROM hit")
def blame_range(spark, sf_dir):
    return history.blame_ranges(S.symbols(spark, sf_dir), S.blame(spark, sf_dir))


_LATEST = f"""WITH {_RANGES}, best AS (SELECT hit.rel_path, hit.ord, arg_max(struct_pack(sha := known.event_id::VARCHAR, author := author, message := message, ts := ts), (ts, known.event_id::VARCHAR)) AS c FROM hit JOIN known USING (event_id) GROUP BY hit.rel_path, hit.ord),
  latest AS (SELECT s.*, coalesce(substr(c.sha, 1, 8), 'Unknown') AS sha, coalesce(c.author, 'Unknown') AS author, coalesce(c.message, 'No commit info available') AS message, coalesce(strftime(c.ts, '%Y-%m-%d'), 'Unknown') AS date FROM symbols s LEFT JOIN best b ON b.rel_path = s.rel_path AND b.ord = s.ord)"""


@query(_LATEST + " SELECT rel_path, ord, sha, author, message, date FROM latest")
def blame_latest(spark, sf_dir):
    return history.blame_latest(S.symbols(spark, sf_dir), S.blame(spark, sf_dir), S.commits(spark, sf_dir)).select("rel_path", "ord", "sha", "author", "message", "date")


@query(_LATEST + " SELECT rel_path, ord, CASE WHEN sha <> 'Unknown' THEN author || ' changed this last, in ' || sha || ': ''' || message || '''' END AS why FROM latest")
def why_annotation(spark, sf_dir):
    return chunks.annotated(history.blame_latest(S.symbols(spark, sf_dir), S.blame(spark, sf_dir), S.commits(spark, sf_dir))).select("rel_path", "ord", "why")


@query(
    "WITH t AS (SELECT event_id, event_id % 7 AS k, md5(event_id::VARCHAR) AS h FROM events)"
    " SELECT event_id, CASE k WHEN 0 THEN '^' || substr(h, 1, 7) WHEN 1 THEN substr(h, 1, 6) WHEN 2 THEN upper(h) WHEN 3 THEN h || 'x' WHEN 4 THEN '^^' || h WHEN 5 THEN '' ELSE h END AS token,"
    " CASE k WHEN 0 THEN substr(h, 1, 7) WHEN 2 THEN upper(h) WHEN 6 THEN h END AS sha FROM t"
)
def sha_tokens(spark, sf_dir):
    h, k = F.md5(F.col("event_id").cast("string").cast("binary")), F.col("event_id") % 7
    forms = (F.concat(F.lit("^"), F.substring(h, 1, 7)), F.substring(h, 1, 6), F.upper(h), F.concat(h, F.lit("x")), F.concat(F.lit("^^"), h), F.lit(""), h)
    token = F.element_at(F.array(*forms), (k + 1).cast("int"))
    return S.table(spark, sf_dir, "events").select("event_id", token.alias("token")).select("event_id", "token", history.valid_sha(F.col("token")).alias("sha"))


# graph


@query(f"WITH {S.PAGES} SELECT page_id, imp AS import_name FROM links")
def import_distinct(spark, sf_dir):
    return S.page_modules(spark, sf_dir)[1].select("page_id", F.col("imp").alias("import_name"))


def graph_sql(prelude: str, files: str, imports: str) -> dict[str, str]:
    """SQL of the graph queries over files (ord, rel_path, language) and imports (src, imp), which are given as SQL after a prelude."""
    modules = "SELECT ord, rel_path, replace(regexp_replace(rel_path, '\\.[^./]*$', ''), '/', '.') AS mod FROM tree WHERE language = 'python'"
    py = f"{prelude}tree AS ({files}), imports AS ({imports}), mods AS ({modules}), py AS (SELECT i.src, i.imp, arg_min(m.rel_path, m.ord) AS dst FROM imports i JOIN tree t ON t.rel_path = i.src AND t.language = 'python' JOIN mods m ON m.mod = i.imp OR ends_with(m.mod, '.' || i.imp) OR (m.mod <> '' AND starts_with(i.imp, m.mod)) GROUP BY i.src, i.imp)"
    # each step of a path is popped by recursion
    js = (
        f"{py}, js AS (SELECT i.src, i.imp, regexp_extract(i.src, '^(.*)/[^/]*$', 1) || '/' || i.imp AS p FROM imports i JOIN tree t ON t.rel_path = i.src AND t.language <> 'python' WHERE starts_with(i.imp, './') OR starts_with(i.imp, '../')),"
        " suffixes AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(graph.SUFFIXES)) + ") AS t(pos, suffix)),"
        " walk AS (SELECT src, imp, [x for x in string_split(p, '/') if x NOT IN ('', '.')] AS steps, []::VARCHAR[] AS done FROM js UNION ALL SELECT src, imp, steps[2:], CASE WHEN steps[1] = '..' AND len(done) > 0 AND done[-1] <> '..' THEN done[:len(done)-1] ELSE list_append(done, steps[1]) END FROM walk WHERE len(steps) > 0),"
        " normal AS (SELECT src, imp, array_to_string(done, '/') AS target FROM walk WHERE len(steps) = 0),"
        " found AS (SELECT n.src, n.imp, arg_min(t.rel_path, (pos, t.ord)) AS dst FROM normal n CROSS JOIN suffixes s JOIN tree t ON t.rel_path = n.target || s.suffix GROUP BY n.src, n.imp)"
    )
    edges = f"WITH RECURSIVE {js}, resolved AS (SELECT * FROM py UNION ALL SELECT * FROM found), edges AS (SELECT src, dst, min(imp) AS first_import FROM resolved WHERE src <> dst GROUP BY src, dst)"
    arrows = "SELECT s.ord::BIGINT AS u, d.ord::BIGINT AS v, first_import, '    node_' || s.ord || ' --> node_' || d.ord AS line FROM edges JOIN tree s ON s.rel_path = src JOIN tree d ON d.rel_path = dst"
    name = "regexp_extract(lower(rel_path), '([^/]*)$', 1)"
    return {
        "resolve_py": f"WITH {py} SELECT * FROM py",
        "resolve_js": f"WITH RECURSIVE {js} SELECT * FROM found",
        "edges": f"{edges} SELECT src, dst, first_import FROM edges",
        "in_degree": f"{edges}, counted AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst) SELECT rel_path, coalesce(n, 0) AS in_degree FROM tree LEFT JOIN counted ON dst = rel_path",
        "dead_files": f"{edges} SELECT rel_path, ({name} IN ('main.py', 'cli.py', 'index.js', 'app.py', 'setup.py', 'wsgi.py') OR starts_with({name}, 'test_')) AS is_entrypoint FROM tree WHERE rel_path NOT IN (SELECT dst FROM edges)",
        "mermaid_nodes": f"{edges} SELECT ord::BIGINT AS idx, rel_path, '    node_' || ord || '[\"' || rel_path || '\"]' AS line FROM tree",
        "mermaid_edges": f"{edges} {arrows}",
        "mermaid_text": f"{edges}, arrows AS ({arrows}) SELECT 'graph TD' || chr(10) || (SELECT string_agg('    node_' || ord || '[\"' || rel_path || '\"]', chr(10) ORDER BY ord) FROM tree) || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY u, first_import) FROM arrows) AS mermaid",
    }


def _python(files: DataFrame, imports: DataFrame) -> DataFrame:
    return graph.resolve_python(imports.join(files.where("language = 'python'").select(F.col("rel_path").alias("src")), "src"), files)


def _scripts(files: DataFrame, imports: DataFrame) -> DataFrame:
    return graph.resolve_scripts(imports.join(files.where("language <> 'python'").select(F.col("rel_path").alias("src")), "src"), files)


#: The graph queries over files and imports, wherever these come from.
GRAPH: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "resolve_py": _python,
    "resolve_js": _scripts,
    "edges": lambda files, imports: graph.edges(imports, files),
    "in_degree": lambda files, imports: graph.in_degrees(files, graph.edges(imports, files)),
    "dead_files": lambda files, imports: graph.unreferenced(files, graph.edges(imports, files)).select("rel_path", "is_entrypoint"),
    "mermaid_nodes": lambda files, imports: graph.flowchart_nodes(files),
    "mermaid_edges": lambda files, imports: graph.flowchart_edges(files, graph.edges(imports, files)),
    "mermaid_text": lambda files, imports: graph.flowchart(files, graph.edges(imports, files)),
}


def _over_tables(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _inventory(spark, sf_dir).select("ord", "rel_path", "language")
        return build(files, S.imports(files))

    return run


QUERIES |= {name: _over_tables(build) for name, build in GRAPH.items()}
ORACLES |= graph_sql(f"{S.INVENTORY}, ", S.TABLE_FILES_SQL, S.TABLE_IMPORTS_SQL)


#: Steps to and fro behind a file's own directory, and nothing but steps.
_STEPS = ("a/./b//c", "../b", "./../../x", "..//../..", "", ".", "a/..", "../../../../b/./..")


@query(
    f"WITH RECURSIVE {S.INVENTORY}, p AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN '' ELSE dir || '/' END || {S.chosen_sql(_STEPS, 'ord')} AS path FROM inventory),"
    " walk AS (SELECT ord, path, [x for x in string_split(path, '/') if x NOT IN ('', '.')] AS steps, []::VARCHAR[] AS done FROM p UNION ALL SELECT ord, path, steps[2:], CASE WHEN steps[1] = '..' AND len(done) > 0 AND done[-1] <> '..' THEN done[:len(done)-1] ELSE list_append(done, steps[1]) END FROM walk WHERE len(steps) > 0)"
    " SELECT ord, path, coalesce(nullif(array_to_string(done, '/'), ''), '.') AS normal FROM walk WHERE len(steps) = 0"
)
def normpath(spark, sf_dir):
    before = F.when(F.col("ord") % 3 == 0, F.lit("")).otherwise(F.concat(paths.directory(F.col("rel_path")), F.lit("/")))
    return _inventory(spark, sf_dir).select("ord", F.concat(before, S.chosen(_STEPS, F.col("ord"))).alias("path")).select("ord", "path", paths.normalized(F.col("path")).alias("normal"))


_POINTS = (("src/@/Main.PY", True), ("@/index.js", True), ("@/index.ts", False), ("a/test_@.js", True), ("a/@_tests.py", False), ("main.py/@.py", False), ("wsgi.py", True))


@query(f"SELECT doc_id AS ord, replace({S.chosen_sql([p for p, _ in _POINTS], 'doc_id')}, '@', doc_id::VARCHAR) AS path, {S.chosen_sql([e for _, e in _POINTS], 'doc_id')} AS is_entrypoint FROM documents")
def entrypoint_flag(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.replace(S.chosen([p for p, _ in _POINTS], F.col("doc_id")), F.lit("@"), F.col("doc_id").cast("string")).alias("path"))
    return rows.withColumn("is_entrypoint", paths.entry_point(F.col("path")))


@query(f"WITH {S.PAGES}, folders AS (SELECT DISTINCT folder FROM page_dirs WHERE folder <> '') SELECT p.folder AS src, l.imp AS dst, count(*) AS n_links FROM links l JOIN page_dirs p USING (page_id) JOIN folders f ON f.folder = l.imp WHERE p.folder <> l.imp GROUP BY ALL")
def page_edges(spark, sf_dir):
    pages, links = S.page_modules(spark, sf_dir)
    folders = pages.where("folder <> ''").select(F.col("folder").alias("imp")).distinct()
    return links.join(folders, "imp", "left_semi").join(pages, "page_id").where("folder <> imp").groupBy(F.col("folder").alias("src"), F.col("imp").alias("dst")).agg(F.count("*").alias("n_links"))


# chunks


@query(f"WITH {S.SYMBOLS} SELECT rel_path, ord, start_line, end_line FROM symbols WHERE kind = 'class'")
def chunk_classes(spark, sf_dir):
    return chunks.class_intervals(S.symbols(spark, sf_dir)).select("rel_path", "ord", "start_line", "end_line")


_FREE = f"{S.SYMBOLS}, free AS (SELECT * FROM symbols f WHERE kind = 'function' AND NOT EXISTS (SELECT 1 FROM symbols o WHERE o.rel_path = f.rel_path AND (o.kind = 'class' OR o.ord < f.ord) AND f.start_line >= o.start_line AND f.end_line <= o.end_line))"


@query(f"WITH {_FREE} SELECT rel_path, ord, start_line, end_line FROM free")
def chunk_functions(spark, sf_dir):
    return chunks.function_intervals(S.symbols(spark, sf_dir)).select("rel_path", "ord", "start_line", "end_line")


_GAPS = f"""{_FREE}, kept AS (SELECT rel_path, start_line, end_line FROM free UNION ALL SELECT rel_path, start_line, end_line FROM symbols WHERE kind = 'class'),
  opened AS (SELECT rel_path, coalesce(max(end_line) OVER (PARTITION BY rel_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS a, start_line - 1 AS b FROM kept
    UNION ALL SELECT s.rel_path, coalesce(max(end_line), 0) + 1, {S.N_LINES} FROM (SELECT DISTINCT rel_path FROM symbols) s LEFT JOIN kept k ON k.rel_path = s.rel_path GROUP BY s.rel_path),
  gaps AS (SELECT rel_path, a AS start_line, b AS end_line FROM opened WHERE a <= b)"""


def _gaps(spark, sf_dir):
    symbols = S.symbols(spark, sf_dir)
    both = chunks.class_intervals(symbols).unionByName(chunks.function_intervals(symbols)).select("rel_path", "start_line", "end_line")
    return both, chunks.gaps(both, symbols.select("rel_path").distinct().withColumn("n_lines", F.lit(S.N_LINES)))


@query(f"WITH {_GAPS} SELECT rel_path, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM gaps")
def chunk_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir)[1].select("rel_path", F.col("start_line").cast("int"), F.col("end_line").cast("int"))


@query(f"WITH {_GAPS} SELECT rel_path, 'class' AS type, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line FROM symbols WHERE kind = 'class' UNION ALL SELECT rel_path, 'function', start_line, end_line FROM free UNION ALL SELECT rel_path, 'module_level', start_line, end_line FROM gaps")
def chunks_all(spark, sf_dir):
    symbols = S.symbols(spark, sf_dir)
    parts = ((chunks.class_intervals(symbols), "class"), (chunks.function_intervals(symbols), "function"), (_gaps(spark, sf_dir)[1], "module_level"))
    one, two, three = (rows.select("rel_path", F.lit(kind).alias("type"), F.col("start_line").cast("int"), F.col("end_line").cast("int")) for rows, kind in parts)
    return one.unionByName(two).unionByName(three)


@query(f"WITH {S.INVENTORY}, {S.SNAPSHOT} SELECT rel_path, 'file_summary' AS type, 'summary' AS name, 1 AS start_line, 1 AS end_line, '// File summary for ' || rel_path || chr(10) || summary AS text FROM inventory i JOIN cache c ON c.key = i.rel_path AND c.sha256 = i.sha256")
def summary_chunks(spark, sf_dir):
    return chunks.summary_chunks(cache.with_summary(_hashed(spark, sf_dir), S.snapshot(_inventory(spark, sf_dir))))


@query(f"WITH {S.FILES}, parts AS (SELECT rel_path, string_split(content, chr(10)) AS p FROM files) SELECT rel_path, (len(p) - CASE WHEN p[-1] = '' THEN 1 ELSE 0 END)::BIGINT AS n_lines, coalesce(array_to_string(p[1:3], chr(10)), '') AS head FROM parts")
def file_lines(spark, sf_dir):
    lines = paths.lines(F.col("content"))
    head = paths.line_range(F.split("content", "\n", -1), F.lit(1), F.lit(3))
    return S.files(spark, sf_dir).select("rel_path", F.size(lines).cast("long").alias("n_lines"), head.alias("head"))


# vectors


_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
#: Every vector whose number is divisible by 100 is a question to all of them.
_NEAR = f"SELECT q.vec_id AS query_id, e.vec_id, e.label, {_COSINE} AS exact FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"


def _questions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    stored = S.table(spark, sf_dir, "embeddings").withColumn("ord", F.col("vec_id"))
    return stored, stored.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"SELECT query_id, vec_id, round(exact, 6) AS similarity FROM ({_NEAR})")
def cosine_all(spark, sf_dir):
    return vector.similarities_each(*_questions(spark, sf_dir)).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


_VECTORS = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 1.0], [1.0, 0.0], 0.707107), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0), ([-2.0, 0.0], [1.0, 0.0], -1.0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {s}::DOUBLE)" for k, (_, _, s) in enumerate(_VECTORS)) + ") AS t(id, similarity)")
def cosine_edge_cases(spark, sf_dir):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(_VECTORS)], "id long, a array<double>, b array<double>")
    return rows.select("id", F.round(vector.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


def _top(spark, sf_dir):
    return vector.nearest_each(*_questions(spark, sf_dir), 5)


_TOP = f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS place FROM ({_NEAR})) WHERE place <= 5)"


@query(f"WITH {_TOP} SELECT query_id, vec_id, label, round(exact, 6) AS similarity FROM top")
def vector_topk(spark, sf_dir):
    return _top(spark, sf_dir).select("query_id", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


_CITE = "'src/' || vec_id || '.py (Lines ' || (vec_id % 90 + 1) || '-' || (vec_id % 90 + 11) || ', Type: function)'"


def _cited(rows):
    start = F.col("vec_id") % 90 + 1
    path = F.concat(F.lit("src/"), F.col("vec_id").cast("string"), F.lit(".py"))
    return rows.withColumn("cite", text.citation(path, start, start + 10, F.lit("function")))


@query(f"SELECT vec_id, {_CITE} AS cite FROM embeddings")
def citations(spark, sf_dir):
    return _cited(S.table(spark, sf_dir, "embeddings")).select("vec_id", "cite")


# the similarity is compared as a number within a unit of its last digit: the engines round text differently
@query(f"WITH {_TOP} SELECT query_id, vec_id, '[' || {_CITE} || '] similarity ' AS head, true AS shown, CASE WHEN vec_id % 2 = 0 THEN 'Why: w' || chr(10) ELSE '' END || 'chunk ' || vec_id || chr(10) AS tail FROM top")
def context_block(spark, sf_dir):
    why = F.when(F.col("vec_id") % 2 == 0, F.lit("w"))
    block = text.context_block(F.col("cite"), F.col("similarity"), why, F.concat(F.lit("chunk "), F.col("vec_id").cast("string")))
    part = lambda k: F.regexp_extract("block", r"(?s)^(\[.*?\] similarity )(-?\d\.\d{4})\n(.*)$", k)
    rows = _cited(_top(spark, sf_dir)).withColumn("block", block)
    return rows.select("query_id", "vec_id", part(1).alias("head"), (F.abs(part(2).cast("double") - F.col("similarity")) < 0.000051).alias("shown"), part(3).alias("tail"))


_LINES = "string_agg('- ' || i.rel_path || ': ' || coalesce(summary, 'No summary available.'), chr(10) ORDER BY i.rel_path)"
_PROMPTS = f"WITH {S.INVENTORY}, {S.SNAPSHOT}, prompts AS (SELECT dir, 'Directory: ' || dir || chr(10) || 'What its files are for:' || chr(10) || {_LINES} AS prompt FROM inventory i LEFT JOIN cache c ON c.key = i.rel_path AND c.sha256 = i.sha256 GROUP BY dir)"


@query(_PROMPTS + " SELECT dir, prompt FROM prompts")
def module_prompt(spark, sf_dir):
    return cache.module_prompts(cache.with_summary(_hashed(spark, sf_dir), S.snapshot(_inventory(spark, sf_dir))))


@query(f"WITH {S.INVENTORY}, {S.DIRECTORIES} SELECT 'What the modules of the system are for:' || chr(10) || chr(10) || string_agg('## `' || dir || '`' || chr(10) || 'files: ' || n_files || chr(10), chr(10) ORDER BY dir) AS prompt FROM dirs")
def system_prompt(spark, sf_dir):
    dirs = cache.directory_hashes(_hashed(spark, sf_dir)).withColumn("summary", F.concat(F.lit("files: "), F.col("n_files").cast("string")))
    return cache.overview_prompt(dirs)


@query(f"WITH {S.INVENTORY} SELECT rel_path, md5('Path of the file: ' || rel_path || chr(10) || 'Its source:' || chr(10) || content) AS prompt_md5 FROM inventory")
def file_prompt(spark, sf_dir):
    return _inventory(spark, sf_dir).select("rel_path", F.md5(text.file_prompt(F.col("rel_path"), F.col("content")).cast("binary")).alias("prompt_md5"))


_MESSAGES = [("Request TIMED OUT", "timeout"), ("read Timeout: Connection refused", "timeout"), ("connection refused", "other"), ("[Errno 111] Connection refused", "unreachable"), ("model 'x' not found", "missing_model"), ("Model not Found", "other"), ("error insufficient_quota", "quota"), ("model_not_found", "no_access"), ("the model does not exist", "no_access"), ("Incorrect API key provided", "bad_key"), ("", "other")]


@query(f"SELECT event_id, {S.chosen_sql([m for m, _ in _MESSAGES], 'event_id')} || ' (' || event_id || ')' AS message, {S.chosen_sql([k for _, k in _MESSAGES], 'event_id')} AS kind FROM events")
def error_classifier(spark, sf_dir):
    said = F.concat(S.chosen([m for m, _ in _MESSAGES], F.col("event_id")), F.lit(" ("), F.col("event_id").cast("string"), F.lit(")"))
    return S.table(spark, sf_dir, "events").select("event_id", said.alias("message")).withColumn("kind", errors.kind(F.col("message")))


# parsing: the tables hold no code, so each file gets some, of which SQL can say what it holds


def _parsed(spark, sf_dir):
    return parse.parse_files(S.code(_inventory(spark, sf_dir)))


@query(
    f"WITH {S.INVENTORY}, {S.CODE}, f AS (SELECT *, unnest(range(n)) AS j FROM coded)"
    " SELECT rel_path, 'function' AS kind, j AS ord, 'f' || j AS name, (first + step * j)::INTEGER AS start_line, (first + step * j + 3)::INTEGER AS end_line FROM f"
    " UNION ALL SELECT rel_path, 'function', n, 'm', (first + step * n + 1)::INTEGER, (first + step * n + 1 + py::INTEGER)::INTEGER FROM coded"
    " UNION ALL SELECT rel_path, 'class', 0, 'C' || ord, (first + step * n)::INTEGER, (first + step * n + 2)::INTEGER FROM coded"
)
def ast_symbols(spark, sf_dir):
    return parse.symbols(_parsed(spark, sf_dir))


@query(f"WITH {S.INVENTORY}, {S.CODE} SELECT rel_path, unnest(CASE WHEN py THEN ['os', 'pkg' || ord] ELSE ['./f' || ord, 'pkg' || ord] END) AS import_name FROM coded")
def ast_imports(spark, sf_dir):
    return parse.imports(_parsed(spark, sf_dir))


@query(f"WITH {S.INVENTORY}, {S.CODE} SELECT rel_path, (1 + n * CASE WHEN py THEN 2 ELSE 3 END)::INTEGER AS complexity FROM coded")
def ast_complexity(spark, sf_dir):
    return _parsed(spark, sf_dir).select("rel_path", F.col("complexity").cast("int").alias("complexity"))
