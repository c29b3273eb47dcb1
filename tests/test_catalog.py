"""Every query of the catalogue: equal to its SQL, and the registry without the text operators."""

import sys

import pytest

import __spark_entry__ as entry
from sparkquarry.plans import catalog, stand_ins

from .conftest import SMALL
from .duck import same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(spark, catalog.QUERIES[name], catalog.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(catalog.GRAPH))
def test_graph_of_a_small_tree_equals_sql(spark, name):
    """Rules of matching that the tables don't meet, on a tree made for them."""
    sql = catalog.graph_sql("", stand_ins.TREE_FILES_SQL, stand_ins.TREE_IMPORTS_SQL)
    same_rows(spark, lambda spark, _: catalog.GRAPH[name](*stand_ins.tree(spark)), sql[name], SMALL)


def test_graph_over_tables_has_edges_of_both_kinds(spark):
    found = catalog.QUERIES["edges"](spark, "/root/testdata/sf0.01").collect()
    assert len(found) > 1000 and {r.src.rpartition(".")[2] for r in found} >= {"py", "js", "ts"}


def test_questions_in_blocks(spark, monkeypatch):
    from sparkquarry.operators import vector

    whole = sorted(map(tuple, catalog.QUERIES["vector_topk"](spark, SMALL).collect()))
    monkeypatch.setattr(vector, "BLOCK", 1)
    assert sorted(map(tuple, catalog.QUERIES["vector_topk"](spark, SMALL).collect())) == whole


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


SOURCES = [
    ("a.py", "python", "import os\nfrom .x import y\n\nclass A:\n    def m(self):\n        if a and b or c:\n            pass\n        elif d:\n            return [i for i in z]\n\nasync def f():\n    try:\n        pass\n    except E:\n        x = 1 if y else 2\n"),
    ("b.js", "javascript", "import x from './x';\nconst r = require(\"./r\");\nclass B extends C {\n  go(a) { if (a && b) { return a ? 1 : 2; } else if (c) { } }\n}\nconst f = (x) => { switch (x) { case 1: break; default: } };\n"),
    ("c.ts", "typescript", "export class T<U> { run(): void { for (const x of y) { while (z ?? 1) {} } } }\nexport async function load(p: string): Promise<void> { try { await import('./m'); } catch (e) {} }\n"),
]


def test_parsing(spark):
    from sparkquarry.sources import parse

    rows = spark.createDataFrame([(k, p, lang, code.encode()) for k, (p, lang, code) in enumerate(SOURCES)], "ord long, rel_path string, language string, content binary")
    parsed = parse.parse_files(rows)
    found = {(r.rel_path, r.kind, r.name) for r in parse.symbols(parsed).collect()}
    assert found == {("a.py", "class", "A"), ("a.py", "function", "m"), ("a.py", "function", "f"), ("b.js", "class", "B"), ("b.js", "function", "go"), ("b.js", "function", "f"), ("c.ts", "class", "T"), ("c.ts", "function", "run"), ("c.ts", "function", "load")}
    assert {r.rel_path: r.complexity for r in parsed.collect()} == {"a.py": 6, "b.js": 6, "c.ts": 5}


def test_registry_without_text_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
