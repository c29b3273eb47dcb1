"""Random trees against sequential rules, and the same results from shuffled partitions."""

import posixpath
import random

import pytest

from sparkquarry.functions import paths
from sparkquarry.operators import chunks, graph, inventory
from sparkquarry.plans import catalog

from .conftest import SMALL


def first_python(imp, files):
    for _, path, lang in files:
        module = posixpath.splitext(path)[0].replace("/", ".")
        if lang == "python" and (module == imp or module.endswith("." + imp) or (module and imp.startswith(module))):
            return path
    return None


def first_script(src, imp, files):
    if not imp.startswith(("./", "../")):
        return None
    target = posixpath.normpath(posixpath.join(posixpath.dirname(src), imp))
    known = [posixpath.normpath(p) for _, p, _ in files]
    return next((files[known.index(posixpath.normpath(target + s))][1] for s in graph.SUFFIXES if posixpath.normpath(target + s) in known), None)


def random_tree(seed):
    rng = random.Random(seed)
    part = lambda: rng.choice(["a", "b", "ab", "os", "x.y", "index"])
    names = sorted({"/".join([part() for _ in range(rng.randrange(1, 4))]) + rng.choice([".py", ".py", ".js", ".ts", ".jsx"]) for _ in range(18)})
    files = [(k, n, paths.LANGUAGES[n[n.rindex(".") :]]) for k, n in enumerate(names)]
    imports = set()
    for _, n, lang in files:
        for _ in range(4):
            steps = [part() for _ in range(rng.randrange(1, 4))]
            imports.add((n, ".".join(steps) if lang == "python" else rng.choice(["./", "../", "../../", ""]) + "/".join(steps)))
    return files, sorted(imports)


@pytest.mark.parametrize("seed", range(5))
def test_edges_equal_sequential_rules(spark, seed):
    files, imports = random_tree(seed)
    lang = {n: x for _, n, x in files}
    expected = set()
    for src, imp in imports:
        dst = first_python(imp, files) if lang[src] == "python" else first_script(src, imp, files)
        if dst and dst != src:
            expected.add((src, dst))
    table = spark.createDataFrame(files, "ord long, rel_path string, language string").repartition(3)
    found = graph.edges(spark.createDataFrame(imports, "src string, imp string").repartition(4), table)
    assert {(r.src, r.dst) for r in found.collect()} == expected
    dead = {r.rel_path for r in graph.unreferenced(table, found).collect()}
    assert dead == {n for _, n, _ in files} - {d for _, d in expected}


def chunked(n_lines, text, classes, functions):
    """Intervals by one pass over the symbols in order."""
    held, out = [], []
    blank = lambda s, e: not "".join(text[max(s, 1) - 1 : min(e, n_lines)]).strip()
    for s, e in classes:
        if not blank(s, e):
            held.append((s, e)), out.append(("class", s, e))
    for s, e in functions:
        if not any(s >= a and e <= b for a, b in held) and not blank(s, e):
            held.append((s, e)), out.append(("function", s, e))
    at = 1
    for s, e in sorted(held):
        if s > at and not blank(at, s - 1):
            out.append(("module_level", at, s - 1))
        at = max(at, e + 1)
    if at <= n_lines and not blank(at, n_lines):
        out.append(("module_level", at, n_lines))
    return sorted(out)


def test_chunks_equal_sequential_rules(spark):
    rng = random.Random(9)
    files, symbols, expected = [], [], {}
    for k in range(60):
        n = rng.randrange(0, 14)
        text = [rng.choice(["", "  ", "x", " ", "code"]) for _ in range(n)]
        if text and text[-1] == "":
            text[-1] = "x"
        spans = lambda: [(s, s + rng.randrange(0, 6)) for s in sorted(rng.randrange(1, 15) for _ in range(rng.randrange(0, 4)))]
        classes, functions = spans(), spans()
        name = f"f{k}"
        files.append((k, name, "\n".join(text)))
        symbols += [(name, "class", i, "C", s, e) for i, (s, e) in enumerate(classes)] + [(name, "function", i, "f", s, e) for i, (s, e) in enumerate(functions)]
        expected[name] = chunked(n, text, classes, functions)
    found = chunks.chunk_files(spark.createDataFrame(files, "ord long, rel_path string, content string"), spark.createDataFrame(symbols, "rel_path string, kind string, ord long, name string, start_line int, end_line int"))
    got = {name: [] for name in expected}
    for r in found.collect():
        got[r.rel_path].append((r.type, r.start_line, r.end_line))
        assert r.text.startswith(chunks.HEADINGS[r.type] + r.rel_path + "\n")
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_normal_paths(spark):
    rng = random.Random(4)
    every = sorted({"/".join(rng.choice(["a", "b", ".", "..", ""]) for _ in range(rng.randrange(1, 7))).lstrip("/") or "." for _ in range(400)})
    table = spark.createDataFrame([(p,) for p in every], "p string")
    for r in table.select("p", paths.normalized(table.p).alias("n")).collect():
        assert r.n == posixpath.normpath(r.p)


def test_partitions_do_not_matter(spark, monkeypatch):
    from sparkquarry.plans import stand_ins

    plain = {name: sorted(map(repr, catalog.QUERIES[name](spark, SMALL).collect())) for name in ("hotspots", "vector_topk", "chunks_all", "module_prompt")}
    table = stand_ins.table
    monkeypatch.setattr(stand_ins, "table", lambda *a: table(*a).repartition(7))
    assert plain == {name: sorted(map(repr, catalog.QUERIES[name](spark, SMALL).collect())) for name in plain}


def test_ignored_names(spark):
    table = spark.createDataFrame([(0, "build/a.py"), (1, "a/build"), (2, "a/build.py"), (3, "src\\dist\\b.py")], "ord long, rel_path string")
    assert {r.rel_path for r in inventory.supported(table).collect()} == {"a/build.py"}
    assert inventory.passed_over(table, ()).count() == 0
