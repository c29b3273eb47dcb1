"""The engine over a small tree, parsers, stores, services, stream."""

import os
import subprocess
import textwrap

import pytest
from hypothesis import given, settings as hyp, strategies as st

from sparkquarry import cli
from sparkquarry.functions import costs, errors
from sparkquarry.operators import cache
from sparkquarry.plans.commands import Engine, Stopped
from sparkquarry.sources import clients, git, local, parse, reports, scripts, store
from sparkquarry.sources.settings import Settings

TREE = {
    "main.py": "import os\nimport database\nfrom utils import parse\n\nclass Application:\n    def __init__(self):\n        pass\n\n    def run(self):\n        return parse('x')\n\ndef helper():\n    return 1\n",
    "database.py": "class Connection:\n    def connect(self):\n        return True\n",
    "utils.py": "def parse(text):\n    if text and len(text) > 1:\n        for c in text:\n            print(c)\n    return text\n",
    "index.js": "const api = require('./api');\nimport helper from './helpers/utils';\nclass Server {\n  start() {\n    return api;\n  }\n}\n",
    "api.js": "module.exports = {\n  get: function () { return 1; }\n};\n",
    "node_modules/skipped.js": "var x = 1;\n",
    "src/empty.py": "",
}


@pytest.fixture
def tree(tmp_path):
    for name, body in TREE.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(body)
    return tmp_path


def commit(root, message, **who):
    env = os.environ | {"GIT_AUTHOR_NAME": who.get("name", "Ann"), "GIT_AUTHOR_EMAIL": who.get("email", "ann@example.com"), "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@example.com", "GIT_AUTHOR_DATE": who["date"], "GIT_COMMITTER_DATE": who["date"]}
    subprocess.run(["git", "-C", root, "add", "-A"], check=True, env=env)
    subprocess.run(["git", "-C", root, "commit", "-qm", message], check=True, env=env)


@pytest.fixture
def repo(tree):
    subprocess.run(["git", "-C", tree, "init", "-q"], check=True)
    commit(tree, "First\n\nbody", date="2024-01-01T10:00:00+0530")
    (tree / "utils.py").write_text(TREE["utils.py"] + "\ndef other():\n    return 2\n")
    commit(tree, "Second", date="2024-02-01T10:00:00-0300", name="Bob", email="bob@example.com")
    return tree


def engine(spark, root, **more):
    said = []
    own = Engine(spark, str(root), Settings(str(root / ".settings.yaml")), said.append, lambda q: True, **more)
    own.said = said
    return own


def test_inventory(spark, tree):
    found = local.listing(spark, str(tree)).orderBy("ord").collect()
    assert [f.rel_path for f in found] == ["api.js", "database.py", "index.js", "main.py", "src/empty.py", "utils.py"]
    assert found[0].language == "javascript" and found[1].size_bytes == len(TREE["database.py"])
    assert "node_modules/skipped.js" in [f.rel_path for f in local.listing(spark, str(tree), ()).collect()]


def test_graph_and_dead_files(spark, tree):
    own = engine(spark, tree)
    assert {(e.src, e.dst) for e in own.edges().collect()} == {("main.py", "database.py"), ("main.py", "utils.py"), ("index.js", "api.js")}
    text = own.graph(str(tree / "out" / "g.md"))
    assert text.startswith("graph TD\n    node_0[\"api.js\"]") and "    node_3 --> node_1\n    node_3 --> node_5" in text
    assert (tree / "out" / "g.md").read_text().startswith("# Modules and their imports\n\n```mermaid\ngraph TD")
    own.deadcode()
    rows = dict(line.split(" | ") for line in own.said[-1].split("\n")[2:])
    assert {k.strip(): v.strip() for k, v in rows.items()} == {"index.js": reports.ENTRY, "main.py": reports.ENTRY, "src/empty.py": reports.DEAD}


def test_history_and_hotspots(spark, repo):
    own = engine(spark, repo)
    rows = {r.rel_path: r for r in own.hotspot_rows().collect()}
    assert (rows["utils.py"].churn, rows["utils.py"].authors, rows["utils.py"].complexity, rows["utils.py"].score) == (2, 2, 4, 8)
    assert rows["utils.py"].last_modified == "2024-02-01 10:00:00" and rows["main.py"].last_modified == "2024-01-01 10:00:00"
    own.hotspots()
    assert own.said[-1].split("\n")[2].startswith("utils.py ")
    ranges = spark.createDataFrame([("utils.py", 0, 1, 2), ("utils.py", 1, 6, 8), ("none.py", 2, 1, 2)], "rel_path string, ord long, start_line int, end_line int")
    found = {r.ord: r for r in own.blamed(ranges).collect()}
    assert (found[0].author, found[0].message, found[0].date) == ("Ann", "First", "2024-01-01")
    assert (found[1].author, found[1].message, len(found[1].sha)) == ("Bob", "Second", 8)
    assert found[2].sha == "Unknown"
    below = Engine(spark, str(repo / "src"), own.settings).hotspot_rows().collect()
    assert [(r.rel_path, r.churn) for r in below] == [("empty.py", 1)]


def test_history_of_merges_and_odd_messages(spark, repo, monkeypatch):
    """Merges count for files that differ from all parents; messages may hold any characters, and names too."""
    run = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=M", "-c", "user.email=m@x", *a], check=True, capture_output=True)
    main = subprocess.run(["git", "-C", repo, "branch", "--show-current"], check=True, capture_output=True, text=True).stdout.strip()
    run("checkout", "-q", "-b", "side")
    (repo / "utils.py").write_text("side = 1\n")
    (repo / "api.js").write_text("side\n")
    run("commit", "-qam", "Side \x1e with \x1f marks\n\nand\ttabs")
    run("checkout", "-q", main)
    (repo / "utils.py").write_text("main = 1\n")
    (repo / "an odd \"name\" é.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "Main")
    subprocess.run(["git", "-C", repo, "-c", "user.name=M", "-c", "user.email=m@x", "merge", "-q", "side"], capture_output=True)
    (repo / "utils.py").write_text("both = 1\n")
    run("commit", "-qam", "Merge")
    monkeypatch.setattr(git, "ROWS", 3)
    found = git.file_commits(spark, str(repo)).collect()
    log = lambda name: subprocess.run(["git", "-C", repo, "log", "--format=%H", "--", name], check=True, capture_output=True, text=True).stdout.split()
    for name in ("utils.py", "api.js", "main.py", "an odd \"name\" é.py"):
        assert sorted(r.sha for r in found if r.rel_path == name) == sorted(log(name)), name
    assert "Side \x1e with \x1f marks\n\nand\ttabs" in {r.message for r in found} and len({r.message for r in found if r.rel_path == "utils.py"}) == 5


def test_no_repository(spark, tree):
    own = engine(spark, tree)
    assert not git.top_level(str(tree)) and {r.churn for r in own.hotspot_rows().collect()} == {0}
    own.hotspots()
    assert "no git history" in own.said[0]


def test_scan(spark, repo):
    own = engine(spark, repo, generator=clients.OfflineGenerator())
    own.scan(detailed=True, dry_run=True)
    text = "\n".join(own.said)
    assert "main.py: python, " in text and "    Application, lines 5 to 10, Ann in " in text and ": Second" in text
    assert "  imports: database, os, utils" in text and "  Python: 4" in text and "no service is called" in text
    own.said.clear()
    own.scan(with_ai=True, budget=0)
    assert own.said[-1].startswith("Stopped: ")
    own.said.clear()
    own.scan(with_ai=True)
    assert sum("answer " in s for s in own.said) == 5
    (repo / "api.js").write_text("changed\n")
    again = engine(spark, repo)
    again.scan(dry_run=True)
    assert "  files: 2 of 6, the others are known" in again.said


def test_costs_with_a_tokenizer(spark, tree):
    known = spark.createDataFrame([], store.CACHE_SCHEMA)
    texts = engine(spark, tree, tokenizer=str.split)._counted()
    words = sum(len(t.split()) for t in [r.content for r in texts.collect()])
    assert cache.scan_cost(texts, known, "gpt-4o-mini").first().input_tokens == words
    dirs = {os.path.dirname(r.rel_path) for r in texts.collect()}
    assert cache.document_cost(texts, known, "gpt-4o", True).first().input_tokens == words + 150 * 6 + 150 * len(dirs)


def test_doc(spark, repo):
    own = engine(spark, repo, generator=clients.OfflineGenerator())
    own.doc(with_ai=True)
    names = ("architecture.md", "dependency_graph.md", "hotspots.md", "deadcode.md", "index.md")
    assert all((repo / "docs" / n).exists() for n in names)
    assert "| `src/empty.py` | *(No summary generated)* |" in (repo / "docs" / "index.md").read_text()
    assert (repo / "docs" / "hotspots.md").read_text().split("\n")[6].startswith("| utils.py | 4 | 2 | 8 |")
    again = engine(spark, repo)
    again.doc(dry_run=True)
    assert "  files to summarise: 1 of 6" in again.said and "  directories to summarise: 0" in again.said


class Broken:
    model = "m"

    def generate(self, prompt, system=""):
        raise RuntimeError("insufficient_quota")


def test_doc_fails_before_pages(spark, tree):
    own = engine(spark, tree, generator=Broken())
    with pytest.raises(Stopped):
        own.doc(with_ai=True)
    assert not (tree / "docs").exists() and any("quota" in s for s in own.said)
    assert engine(spark, tree).doc(with_ai=True) is None and not (tree / "docs").exists()


def test_ask(spark, repo):
    own = engine(spark, repo, generator=clients.OfflineGenerator(), embedder=clients.OfflineEmbedder())
    answer = own.ask("def parse(text):")
    assert answer.startswith("answer ") and len([s for s in own.said if s.startswith("  ")]) == 5
    index = own.index.read()
    assert {r.type for r in index.select("type").distinct().collect()} == {"class", "function", "module_level"}
    assert index.where("why LIKE 'Bob changed this last, in %: ''Second'''").count() > 0
    own.said.clear()
    (repo / "utils.py").write_text("x = 1\n")
    fresh = engine(spark, repo, generator=clients.OfflineGenerator(), embedder=clients.OfflineEmbedder())
    fresh.ask("anything")
    assert any("--rebuild" in s for s in fresh.said)
    fresh.ask("x", rebuild=True)
    assert any("The index holds" in s for s in fresh.said)


def test_cli(spark, tree, capsys):
    assert cli.main(["help"]) == 0 and "deadcode" in capsys.readouterr().out
    assert cli.main(["graph", str(tree)], spark) == 0 and "graph TD" in capsys.readouterr().out
    assert cli.main(["graph", str(tree / "nowhere")], spark) == 1 and "nothing at" in capsys.readouterr().err
    own = Settings(str(tree / "s" / "c.yaml"))
    answers = iter(["anthropic", ""])
    cli.wizard(own, lambda q: next(answers), lambda q: "key")
    again = Settings(own.path)
    assert (again.get("provider"), again.get("model"), again.get("api_key")) == ("anthropic", clients.MODELS["anthropic"], "key")
    (tree / "bad.yaml").write_text("- a: [")
    assert Settings(str(tree / "bad.yaml")).get("model") == "gpt-4o-mini"


def test_resolve(tree):
    assert local.resolve(str(tree)) == (str(tree), None)
    made = []
    root, held = local.resolve("https://example.com/x.git", lambda url, target: made.append((url, target)))
    assert made == [("https://example.com/x.git", root)] and os.path.isdir(root)
    held.cleanup()
    for bad in ("/no/such/place", str(tree / "main.py"), "ssh://x"):
        with pytest.raises(ValueError):
            local.resolve(bad)
    with pytest.raises(ValueError, match="can't be cloned"):
        local.resolve("git@x:y.git", lambda url, target: 1 / 0)


def test_python_source():
    code = textwrap.dedent("""
        import a.b as c, d
        from . import x
        from ..p.q import y
        class A:
            @property
            def m(self):
                return 1 if self and x or y else 2
        async def f():
            if a:
                pass
            elif b:
                pass
            else:
                if c: pass
            for _ in x:
                while y: pass
            try: pass
            except E: pass
            return [i for i in z if i]
    """)
    found = parse.analyse_python(code)
    assert [(c["name"], c["start_line"], c["end_line"]) for c in found["classes"]] == [("A", 5, 8)]
    assert [(c["name"], c["start_line"]) for c in found["functions"]] == [("m", 7), ("f", 9)]
    assert found["imports"] == [".", "..p.q", "a.b", "d"] and found["complexity"] == 1 + 1 + 2 + 2 + 1 + 1 + 1
    broken = parse.analyse("python", b"class A:\n    def f(self):\n        return (\n\nimport z\nfrom .k import v\n")
    assert broken["error"] and [f["name"] for f in broken["functions"]] == ["f"] and broken["imports"] == [".k", "z"]
    assert parse.analyse("python", None)["complexity"] == 0
    with pytest.raises(ValueError):
        parse.analyse("cobol", b"")


def test_script_source():
    code = textwrap.dedent("""\
        import a, { b } from "m1";
        import 'm2';
        export * from 'not';
        const c = require("m3"), d = import('m4');
        class K extends L {
          static async go(x) { return x ?? 1; }
          get v() { return 1; }
          #p() {}
        }
        const f = async (x) => {
          if (x) { return 1; } else if (y) {}
          for (const z of x) { while (z) {} }
          do { x--; } while (x > 0);
          switch (x) { case 1: case 2: break; default: }
          try { g(); } catch (e) {}
          return x && y || z ? 1 : 2;
        };
        let g = function () { return `a ${h(() => 1)} class Q {}`; };
        export default function named() { return /if (x) {/.test("if (y)"); }
        const o = { m() { return 1; }, n: (q) => q, if: 3, case: 4 };
        // function hidden() {}
        call(function () {}, x => x);
        """)
    found = scripts.analyse(code)
    assert found["imports"] == ["m1", "m2", "m3", "m4"]
    assert [(c["name"], c["start_line"], c["end_line"]) for c in found["classes"]] == [("K", 5, 9)]
    assert [(x["name"], x["start_line"], x["end_line"]) for x in found["functions"]] == [("go", 6, 6), ("v", 7, 7), ("#p", 8, 8), ("f", 10, 17), ("g", 18, 18), ("named", 19, 19), ("m", 20, 20)]
    assert found["complexity"] == 1 + 1 + 2 + 2 + 1 + 2 + 1 + 3
    typed = scripts.analyse("export class T<U> { run(a?: string): void { if (a) {} } private go = (): number => 1; }\nconst h = async <X,>(x: X): Promise<X> => { return x; };\nfunction k(a: {b?: number}): {c: string} { return a?.b ? x : y; }\ninterface I { m(): void; }\n")
    assert [c["name"] for c in typed["classes"]] == ["T"] and [x["name"] for x in typed["functions"]] == ["run", "h", "k"] and typed["complexity"] == 3


@given(st.text(alphabet="(){}[]=>?:;,.`'\"/\\$abif class function\n", max_size=60))
@hyp(max_examples=200, deadline=None)
def test_scripts_never_fail(code):
    found = parse.analyse("javascript", code.encode())
    assert found["complexity"] >= 1


def test_costs():
    assert costs.cost(1000, "gpt-4o-mini") == (pytest.approx(0.0003), 1000, 250)
    assert costs.shown(0.0003) == "$0.00030" and costs.shown(0.125) == "$0.12" and costs.count_tokens("abcdefghi") == 2
    assert costs.cost(7, "other")[2] == 1 and not costs.over_budget(0.5, 50) and costs.over_budget(0.51, 50)


def test_error_advice():
    assert "ollama pull m" in errors.advice("model 'm' not found", "ollama", "m")
    assert "timed out" in errors.advice("Read Timeout", "openai", "m") and "quota" in errors.advice("insufficient_quota", "openai", "m")
    assert "boom" in errors.advice("boom", "openai", "m")


def test_services(monkeypatch):
    for name in ("OPENAI_API_KEY", "ANTHROPIC_API_KEY", "OLLAMA_HOST"):
        monkeypatch.delenv(name, raising=False)
    sent = []
    reply = {"choices": [{"message": {"content": "a"}}], "content": [{"text": "b"}], "response": "c", "data": [{"embedding": [1.0]}], "embedding": [2.0]}
    send = lambda *request: sent.append(request) or reply
    assert clients.Generator("OpenAI", "k", send=send).generate("p", "s") == "a" and sent[-1][2]["temperature"] == 0.2 and sent[-1][3] == 30
    assert clients.Generator("anthropic", "k", send=send).generate("p") == "b" and sent[-1][2]["max_tokens"] == 2048 and "system" not in sent[-1][2]
    assert clients.Generator("local", send=send).generate("p", "s") == "c" and sent[-1][0] == "http://localhost:11434/api/generate" and sent[-1][3] == 300
    assert clients.Embedder("openai", "k", send=send).embed("t") == [1.0] and clients.Embedder("ollama", send=send).embed("t") == [2.0]
    for wrong in (lambda: clients.Generator("x"), lambda: clients.Generator("openai").generate("p"), lambda: clients.Embedder("anthropic", "k").embed("t"), lambda: clients.Embedder("openai").embed("t")):
        with pytest.raises(ValueError):
            wrong()


def test_snapshot(spark, tmp_path):
    own = store.Snapshot(spark, str(tmp_path / "t"), store.CACHE_SCHEMA)
    assert own.read().count() == 0
    own.write(spark.createDataFrame([("a", "1", "x")], store.CACHE_SCHEMA))
    own.write(own.read().unionByName(spark.createDataFrame([("b", "2", "y")], store.CACHE_SCHEMA)))
    assert own.read().count() == 2
    (tmp_path / "t" / "v-999999999999-torn").mkdir()  # a write that never ended
    assert own.read().count() == 2
    plan = own.read()
    for k in range(store.VERSIONS - 1):
        own.write(spark.createDataFrame([(str(k), "1", "x")], store.CACHE_SCHEMA))
    assert plan.count() == 2 and [r.key for r in own.read().collect()] == [str(store.VERSIONS - 2)]
    own.clear()
    assert own.read().count() == 0 and len(own.versions()) == store.VERSIONS


def test_snapshot_on_another_file_system(spark, tmp_path):
    own = store.Snapshot(spark, f"file://{tmp_path}/far/t/", store.CACHE_SCHEMA)
    own.write(spark.createDataFrame([("a", "1", "x")], store.CACHE_SCHEMA))
    assert own.read().count() == 1 and len(own.versions()) == 1


def test_stream_calls_a_service_once_for_a_row(spark, tmp_path):
    from sparkquarry.streaming import reindex

    own = store.Snapshot(spark, str(tmp_path / "hashes"), store.CACHE_SCHEMA)
    calls = spark.sparkContext.accumulator(0)

    def derive(rows):
        def called(source):
            for batch in source:
                calls.add(batch.num_rows)
                yield batch

        return rows.selectExpr("rel_path AS key", "sha256", "content AS summary").mapInArrow(called, "key string, sha256 string, summary string")

    schema = "rel_path string, version long, content string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "z")], schema).write.parquet(str(tmp_path / "in"))
    reindex.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), own, derive, str(tmp_path / "at")).awaitTermination()
    assert own.read().count() == 2 and calls.value == 2


def test_stream_reindexes_what_changed(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkquarry.streaming import reindex

    own = store.Snapshot(spark, str(tmp_path / "hashes"), store.CACHE_SCHEMA)
    schema = "rel_path string, version long, content string"
    derived = []

    def derive(rows):
        derived.append(sorted(r.rel_path for r in rows.select("rel_path").collect()))
        return rows.select(F.col("rel_path").alias("key"), "sha256", F.upper("content").alias("summary"))

    for batch in ([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("a", 3, "y"), ("b", 2, "w"), ("c", 1, None)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        reindex.start(stream, own, derive, str(tmp_path / "at")).awaitTermination()
    assert derived == [["a", "b"], ["b", "c"]]
    assert {(r.key, r.summary) for r in own.read().collect()} == {("a", "Y"), ("b", "W"), ("c", None)}
