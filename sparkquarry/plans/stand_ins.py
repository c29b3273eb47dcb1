"""The code model over the test tables: files from documents, history from events, symbols from lineitem.

Each stand-in has the same meaning as a DataFrame and as SQL, so that results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines of every stand-in file for symbols and blame.
N_LINES = 220


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file in a directory named after its source; one source stands for a directory that scans ignore."""
    docs = table(spark, sf_dir, "documents")
    folder = F.when(F.col("source") == "src7", F.lit("node_modules")).otherwise(F.coalesce("source", F.lit("none")))
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".js").when(F.col("lang") == "fr", ".ts").otherwise(".md")
    return docs.select(
        F.col("doc_id").alias("ord"), F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("rel_path"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"), F.coalesce("text", F.lit("")).alias("content"),
    )


FILES = """files AS (SELECT doc_id AS ord,
  CASE WHEN source = 'src7' THEN 'node_modules' ELSE coalesce(source, 'none') END || '/' || doc_id::VARCHAR || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.js' WHEN 'fr' THEN '.ts' ELSE '.md' END AS rel_path,
  strlen(coalesce(text, ''))::BIGINT AS size_bytes, coalesce(text, '') AS content FROM documents)"""
INVENTORY = (
    FILES
    + """, inventory AS (SELECT *, CASE WHEN rel_path LIKE '%.py' THEN 'python' WHEN rel_path LIKE '%.js' THEN 'javascript' ELSE 'typescript' END AS language,
  sha256(content) AS sha256, split_part(rel_path, '/', 1) AS dir FROM files WHERE rel_path NOT LIKE 'node_modules/%' AND rel_path NOT LIKE '%.md')"""
)


def snapshot(inventory: DataFrame) -> DataFrame:
    """A cache of an earlier state: every third file has changed since, every seventh is new."""
    old = F.when(F.col("ord") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return inventory.where("ord % 7 <> 0").select(F.col("rel_path").alias("key"), F.sha2(old.cast("binary"), 256).alias("sha256"), F.concat(F.lit("summary of "), "rel_path").alias("summary"))


SNAPSHOT = """cache AS (SELECT rel_path AS key, sha256(CASE WHEN ord % 3 = 0 THEN content || '!' ELSE content END) AS sha256, 'summary of ' || rel_path AS summary FROM inventory WHERE ord % 7 <> 0)"""


def directory_snapshot(hashes: DataFrame) -> DataFrame:
    """Cached directories: those with an even last digit in the name."""
    return hashes.where("dir RLIKE '[02468]$'").select(F.col("dir").alias("key"), "sha256", F.concat(F.lit("module "), "dir").alias("summary"))


DIRECTORIES = """dirs AS (SELECT dir, count(*) AS n_files, sha256(dir || string_agg(sha256, '' ORDER BY rel_path)) AS sha256 FROM inventory GROUP BY dir),
  dir_cache AS (SELECT dir AS key, sha256, 'module ' || dir AS summary FROM dirs WHERE regexp_matches(dir, '[02468]$'))"""


def _event_file() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def file_commits(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """An event is a commit of the file that its key names; the later it is, the earlier it stands in the log."""
    found = files(spark, sf_dir) if only is None else only
    events = table(spark, sf_dir, "events").select(
        _event_file().cast("long").alias("ord"), F.col("event_id").cast("string").alias("sha"), F.col("user_id").cast("string").alias("author_name"),
        F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit("@example.com"))).alias("author_email"), F.col("event_type").alias("message"), F.col("ts").alias("committed"),
        F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")).alias("place"),
    )
    return found.select("ord", "rel_path").join(events, "ord").select("rel_path", "sha", "author_name", "author_email", "message", "committed", F.col("place").alias("ord"))


COMMITS = """commits AS (SELECT f.rel_path, e.event_id, e.user_id, e.ts, e.event_type AS message,
  CASE WHEN e.user_id % 5 = 0 THEN e.user_id::VARCHAR ELSE e.user_id::VARCHAR || '@example.com' END AS author
  FROM files f JOIN events e ON f.ord = CAST(json_extract_string(e.props, '$.k') AS BIGINT))"""


def complexity(content) -> F.Column:
    """A counter that stands in for decision points: the texts hold no code."""
    return (F.lit(1) + F.regexp_count(content, F.lit(" (and|or|for|if) "))).cast("long")


COMPLEXITY = "(1 + len(regexp_extract_all(content, ' (and|or|for|if) ')))::BIGINT"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a class or function of the file that its order names. All columns are needed to number items."""
    items = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    start = (F.col("l_partkey") % 150 + 1).cast("int")
    return items.select(
        F.col("l_orderkey").cast("string").alias("rel_path"), F.when(F.col("l_returnflag") == "R", "class").otherwise("function").alias("kind"), place.cast("long").alias("ord"),
        start.alias("start_line"), (start + F.col("l_quantity").cast("int")).alias("end_line"),
    )


SYMBOLS = """symbols AS (SELECT l_orderkey::VARCHAR AS rel_path, CASE WHEN l_returnflag = 'R' THEN 'class' ELSE 'function' END AS kind,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord,
  (l_partkey % 150 + 1)::INTEGER AS start_line, (l_partkey % 150 + 1 + l_quantity::INTEGER)::INTEGER AS end_line FROM lineitem)"""


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(_event_file().cast("string").alias("rel_path"), (F.col("event_id") % 200 + 1).cast("int").alias("line_no"), F.col("event_id").cast("string").alias("sha"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event in eleven is a commit that can't be found."""
    return table(spark, sf_dir, "events").where("event_id % 11 <> 0").select(F.col("event_id").cast("string").alias("sha"), F.col("user_id").cast("string").alias("author_name"), F.concat("event_type", F.lit("\nmore")).alias("message"), F.col("ts").alias("committed"))


BLAME = """blame AS (SELECT json_extract_string(props, '$.k') AS rel_path, (event_id % 200 + 1)::INTEGER AS line_no, event_id FROM events),
  known AS (SELECT event_id, user_id::VARCHAR AS author, event_type AS message, ts FROM events WHERE event_id % 11 <> 0)"""

def chosen(values, number) -> F.Column:
    """One of some literals, by a row's number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def chosen_sql(values, number: str) -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"[{', '.join(map(shown, values))}][{number} % {len(values)} + 1]"


def code(inventory: DataFrame) -> DataFrame:
    """The inventory with source code for content: imports, up to three functions with decisions, a class with a method; how many depends on
    the file's number."""
    number = F.col("ord").cast("string")

    def written(head: list, block: str, tail: list) -> F.Column:
        part = lambda j: F.replace(F.lit(block), F.lit("@"), j.cast("string"))
        inner = F.when(F.col("ord") % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("ord") % 4 - 1), part), "")).otherwise(F.lit(""))
        return F.concat(*head, inner, *tail)

    python = written([F.lit("import os\nfrom pkg"), number, F.lit(" import z\n\n")], "def f@(x):\n    if x and y:\n        return 1\n    return 2\n\n", [F.lit("class C"), number, F.lit(":\n    def m(self):\n        return 0\n")])
    head = [F.lit("import a from './f"), number, F.lit("';\nconst r = require(\"pkg"), number, F.lit("\");\n")]
    tail = [F.lit("class C"), number, F.lit(" {\n  m() { return 0; }\n}\n")]
    scripts = {kind: written(head, f"function f@(x{kind}){kind} {{\n  if (x && y) {{ return 1; }}\n  return x ? 1 : 2;\n}}\n", tail) for kind in ("", ": number")}
    held = F.when(F.col("language") == "python", python).when(F.col("language") == "javascript", scripts[""]).otherwise(scripts[": number"])
    return inventory.withColumn("content", held)


CODE = """coded AS (SELECT ord, rel_path, ord % 4 AS n, CASE language WHEN 'python' THEN 4 ELSE 3 END AS first, CASE language WHEN 'python' THEN 5 ELSE 4 END AS step, language = 'python' AS py FROM inventory)"""

#: A small tree for rules of matching, the same for both engines: path, language, and its imports.
TREE = (
    ("app/index.ts", "typescript", ("./util", "../lib/core", "./missing", "react")), ("app/util.js", "javascript", ("../app/index", "./../app//util")), ("app/util.ts", "typescript", ()), ("cli.py", "python", ("pkg.core", "os", "osquery", ".local", "pkg")),
    ("lib/core/index.js", "javascript", ("./../../app/util", "../../../x")), ("lib/core.jsx", "javascript", ("./core/index.js", "./core/index")), ("lib/self.js", "javascript", ("./self",)), ("os.py", "python", ("sub.mod", "os", "pkg.core.deep")),
    ("pkg/__init__.py", "python", ("core", "pkg.core", "app")), ("pkg/core.py", "python", ("pkg", "cli", "mod")), ("pkg/sub/mod.py", "python", ("pkg.sub.mod.inner", "core")), ("tests/test_core.py", "python", ("pkg.core", "tests.test_core")), ("zeta.mjs", "javascript", ("./zeta", "./app/index")),
)


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


TREE_FILES_SQL = f"SELECT * FROM (VALUES {_rows((k, p, lang) for k, (p, lang, _) in enumerate(TREE))}) AS t(ord, rel_path, language)"
TREE_IMPORTS_SQL = f"SELECT * FROM (VALUES {_rows((p, i) for p, _, imports in TREE for i in imports)}) AS t(src, imp)"


def tree(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.sql(TREE_FILES_SQL), spark.sql(TREE_IMPORTS_SQL)


def imports(files: DataFrame) -> DataFrame:
    """(src, imp): what each file of the table imports, by its number: the next one by its bare name, one near it by its dotted name or
    relative path, with something behind it or steps to and fro before it, one of another directory, and one that no file is."""
    near, number = F.col("ord").bitwiseXOR(F.lit(3)).cast("string"), F.col("ord").cast("string")
    folder = F.substring_index("rel_path", "/", 1)
    after = (F.col("ord") + 1).cast("string")
    far = [(F.col("ord") + 20 * k).cast("string") for k in (1, 2, 3)]
    python = F.array(after, *far, F.concat(folder, F.lit("."), near), F.concat(folder, F.lit("."), after, F.lit(".deep")), F.lit("os"), F.concat(F.lit("src1."), near))
    scripts = F.array(F.concat(F.lit("./"), near), *[F.concat(F.lit("./"), k) for k in far], F.concat(F.lit("./../"), folder, F.lit("//"), after), F.concat(F.lit("../src1/./"), after), F.lit("react"), F.concat(F.lit("./"), number))
    return files.select(F.col("rel_path").alias("src"), F.explode(F.when(F.col("language") == "python", python).otherwise(scripts)).alias("imp"))


#: The same over the inventory, numbered from 0.
TABLE_FILES_SQL = "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, rel_path, language FROM inventory"
TABLE_IMPORTS_SQL = """SELECT rel_path AS src, unnest(CASE WHEN language = 'python' THEN [(ord + 1)::VARCHAR, (ord + 20)::VARCHAR, (ord + 40)::VARCHAR, (ord + 60)::VARCHAR, dir || '.' || xor(ord, 3), dir || '.' || (ord + 1) || '.deep', 'os', 'src1.' || xor(ord, 3)]
  ELSE ['./' || xor(ord, 3), './' || (ord + 20), './' || (ord + 40), './' || (ord + 60), './../' || dir || '//' || (ord + 1), '../src1/./' || (ord + 1), 'react', './' || ord] END) AS imp FROM inventory"""


def page_modules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as modules: a page's folder is the first step of its address, its links are imports of folders."""
    pages = table(spark, sf_dir, "pages")
    links = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))))
    return pages.select("page_id", F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("folder")), pages.select("page_id", links.alias("imp"))


PAGES = """page_dirs AS (SELECT page_id, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS folder FROM pages),
  links AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS imp FROM pages)"""
