"""The engine over one source tree: scan, graph, hotspots, deadcode, doc, ask."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs, errors, paths, text
from ..operators import cache, chunks, graph, history, hotspots, inventory, vector
from ..sources import clients, git, local, parse, reports, store
from ..session import kept
from ..sources.settings import Settings


class Stopped(Exception):
    """A command that ends before its work, for a reason to be shown."""


@dataclass
class Engine:
    """`say` gets progress lines, `confirm` decides before services are paid for; both services can be replaced."""

    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    say: Callable[[str], None] = print
    confirm: Callable[[str], bool] = lambda question: False
    generator: object | None = None
    embedder: object | None = None
    ignore: tuple[str, ...] | None = None
    tokenizer: Callable[[str], list] | None = None

    # tables

    @cached_property
    def files(self) -> DataFrame:
        return local.listing(self.spark, self.root, self.ignore)

    @cached_property
    def contents(self) -> DataFrame:
        return local.contents(self.files, self.root)

    @cached_property
    def parsed(self) -> DataFrame:
        """Each file is parsed once, for symbols, imports and complexity alike, and kept on disk for later reads."""
        return self._kept(parse.parse_files(self.contents))

    @cached_property
    def file_commits(self) -> DataFrame:
        return git.file_commits(self.spark, self.root)

    @cached_property
    def cache(self) -> store.Snapshot:
        return store.Snapshot(self.spark, os.path.join(self.root, ".sparkquarry", "cache"), store.CACHE_SCHEMA)

    @cached_property
    def index(self) -> store.Snapshot:
        return store.Snapshot(self.spark, os.path.join(self.root, ".sparkquarry", "index"), store.INDEX_SCHEMA)

    def _kept(self, table: DataFrame) -> DataFrame:
        """Cut off from its plan, so that parsers and services are not called again."""
        return kept(table)

    def edges(self) -> DataFrame:
        imports = parse.imports(self.parsed).select(F.col("rel_path").alias("src"), F.col("import_name").alias("imp"))
        return graph.edges(imports, self.files)

    def blamed(self, ranges: DataFrame) -> DataFrame:
        return history.blame_latest(ranges, git.blame(self.files, self.root), git.commits(self.file_commits))

    # commands

    def scan(self, detailed: bool = False, with_ai: bool = False, budget: int | None = None, dry_run: bool = False) -> None:
        files = self.files.orderBy("ord").collect()
        if not files:
            self.say("Nothing to scan: no Python, JavaScript or TypeScript here.")
            return
        self.say(f"{len(files)} files")
        symbols, imports, failed = ({}, {}, {}) if not detailed else self._details()
        for f in files:
            self.say(f"{f.rel_path}: {f.language}, {f.size_bytes} bytes")
            if f.rel_path in failed:
                self.say(f"  can't be parsed: {failed[f.rel_path]}")
            for kind, title in (("class", "classes"), ("function", "functions")):
                if found := symbols.get((f.rel_path, kind)):
                    self.say(f"  {title}:")
                    for s in found:
                        who = f", {s.author} in {s.sha}: {s.message}" if s.sha != history.UNKNOWN else ""
                        self.say(f"    {s.name}, lines {s.start_line} to {s.end_line}{who}")
            if f.rel_path in imports:
                self.say(f"  imports: {', '.join(imports[f.rel_path])}")
        self.say("In all")
        for r in inventory.language_counts(self.files).orderBy("first_ord").collect():
            self.say(f"  {r.language.capitalize()}: {r.n_files}")
        self.say(f"  bytes: {inventory.total_size(self.files).first().total_bytes}")
        if with_ai or dry_run:
            self._scan_ai(len(files), budget, dry_run)

    def _details(self):
        found = self.blamed(parse.symbols(self.parsed)).orderBy("rel_path", "kind", "ord")
        symbols: dict[tuple[str, str], list] = {}
        for s in found.toLocalIterator():
            symbols.setdefault((s.rel_path, s.kind), []).append(s)
        rows = self.parsed.select("rel_path", "imports", "error").toLocalIterator()
        imports, failed = {}, {}
        for r in rows:
            if r.imports:
                imports[r.rel_path] = r.imports
            if r.error:
                failed[r.rel_path] = r.error
        return symbols, imports, failed

    def _texts(self) -> DataFrame:
        return self.contents.select("ord", "rel_path", "sha256", F.coalesce("text", F.lit("")).alias("content"))

    def _counted(self) -> DataFrame:
        return costs.with_tokens(self._texts(), self.tokenizer) if self.tokenizer else self._texts()

    def _scan_ai(self, n: int, budget: int | None, dry_run: bool) -> None:
        model = self.settings.get("model")
        cost = cache.scan_cost(self._counted(), self.cache.read(), model).first()
        self.say("Summaries by a language model")
        self.say(f"  service: {self.settings.get('provider')}")
        self.say(f"  model: {model}")
        self.say(f"  files: {cost.uncached_files} of {n}, the others are known")
        self.say(f"  tokens: {cost.input_tokens} to read, about {cost.output_tokens} to write")
        self.say(f"  price: about {costs.shown(cost.cost)}")
        if dry_run:
            self.say("An estimate was asked for; no service is called.")
            return
        if not self._may_run(cost.cost, budget):
            return
        if cost.uncached_files and self._agreed("Summarise these files?"):
            self._summarise_files()
        for r in cache.with_summary(self._texts(), self.cache.read()).where("summary IS NOT NULL").orderBy("ord").toLocalIterator():
            self.say(f"\n{r.rel_path}\n  {r.summary}")

    def _may_run(self, dollars: float, budget: int | None) -> bool:
        if self.generator is None and not self.settings.key() and self.settings.get("provider") != "ollama":
            self.say(f"{self.settings.get('provider')} needs an API key: run init, or set its variable.")
            return False
        if budget is not None:
            self.say(f"  budget: {costs.shown(budget / 100)}")
            if costs.over_budget(dollars, budget):
                self.say(f"Stopped: {costs.shown(dollars)} is more than the budget of {costs.shown(budget / 100)}.")
                return False
        return True

    def _agreed(self, question: str) -> bool:
        if not self.confirm(question):
            raise Stopped("not confirmed")
        return True

    def _service(self):
        return self.generator or clients.Generator(self.settings.get("provider"), self.settings.key(), self.settings.get("model"))

    def _filled(self, prompts: DataFrame, system: str) -> int:
        """Summaries of prompts (key, sha256, prompt) into the cache; how many failed, with the first failure shown."""
        made = self._kept(clients.generate_rows(prompts, self._service(), system))
        self.cache.write(cache.upsert(self.cache.read(), made.where("error IS NULL").select("key", "sha256", "summary")))
        wrong = made.where("error IS NOT NULL")
        if first := wrong.orderBy("key").first():
            self.say(f"  no summary: {errors.advice(first.error, self.settings.get('provider'), self.settings.get('model'))}")
        return wrong.count() if first else 0

    def _summarise_files(self) -> int:
        missed = cache.misses(self._texts(), self.cache.read()).where(~paths.blank(F.col("content")))
        prompts = missed.select(F.col("rel_path").alias("key"), "sha256", text.file_prompt(F.col("rel_path"), F.col("content")).alias("prompt"))
        return self._filled(prompts, text.FILE_SYSTEM)

    def graph(self, output: str | None = None) -> str:
        mermaid = graph.flowchart(self.files, self.edges()).first().mermaid
        self.say(mermaid)
        if output:
            self.say(f"The graph is in {reports.write(output, reports.graph_page('Modules and their imports', mermaid))}")
        return mermaid

    def hotspot_rows(self) -> DataFrame:
        complexity = self.parsed.select("ord", "rel_path", F.col("complexity").cast("long"))
        return hotspots.hotspots(complexity, history.metrics(self.file_commits))

    def hotspots(self) -> None:
        if not git.top_level(self.root):
            self.say("There is no git history here, so churn is zero.")
        self.say(reports.hotspot_table(self.hotspot_rows().orderBy(*hotspots.report_order()).toLocalIterator()))

    def deadcode(self) -> None:
        self.say(reports.dead_table(graph.unreferenced(self.files, self.edges()).orderBy("ord").toLocalIterator()))

    def doc(self, with_ai: bool = False, budget: int | None = None, dry_run: bool = False) -> None:
        n = self.files.count()
        if not n:
            self.say("There are no source files here.")
            return
        docs = os.path.join(self.root, "docs")
        overview = os.path.join(docs, "architecture.md")
        model = self.settings.get("model")
        cost = cache.document_cost(self._counted(), self.cache.read(), model, os.path.exists(overview)).first()
        self.say("Documentation by a language model")
        self.say(f"  files to summarise: {cost.uncached_files} of {n}")
        self.say(f"  directories to summarise: {cost.uncached_dirs}")
        self.say(f"  tokens to read: {cost.input_tokens}")
        self.say(f"  tokens to write: about {cost.output_tokens}")
        self.say(f"  price: about {costs.shown(cost.cost)}")
        if dry_run:
            self.say("An estimate was asked for; no service is called.")
            return
        if with_ai:
            if not self._may_run(cost.cost, budget):
                return
            self._agreed("Write the documentation?")
            self._document(overview)
        self._static(docs, overview)

    def _document(self, overview: str) -> None:
        """File summaries, then directories from them, then the overview from those; a failure ends the command."""
        if self._summarise_files():
            raise Stopped("Some files could not be summarised.")
        hashes = cache.directory_hashes(self._texts())
        missed = cache.misses(hashes, self.cache.read(), "dir")
        prompts = cache.module_prompts(cache.with_summary(self._texts(), self.cache.read()))
        due = missed.join(prompts, "dir").select(F.col("dir").alias("key"), "sha256", "prompt")
        if self._filled(due, text.MODULE_SYSTEM):
            raise Stopped("Some modules could not be summarised.")
        modules = cache.hits(hashes, self.cache.read(), "dir")
        try:
            said = self._service().generate(cache.overview_prompt(modules).first().prompt, text.OVERVIEW_SYSTEM)
        except (RuntimeError, ValueError) as e:
            raise Stopped(errors.advice(str(e), self.settings.get("provider"), self.settings.get("model"))) from e
        self.say(f"The overview is in {reports.write(overview, said.strip())}")

    def _static(self, docs: str, overview: str) -> None:
        edges = self._kept(self.edges())
        hot = self.hotspot_rows().orderBy(*hotspots.document_order())
        dead = graph.unreferenced(self.files, edges)
        summarised = cache.with_summary(self._texts(), self.cache.read()).select("ord", "rel_path", "summary").orderBy("ord")
        pages = {
            "dependency_graph.md": lambda: reports.graph_page("Modules and their imports", graph.flowchart(self.files, edges).first().mermaid),
            "hotspots.md": lambda: reports.hotspot_page(hot.toLocalIterator()),
            "deadcode.md": lambda: reports.dead_page(r.rel_path for r in dead.toLocalIterator()),
            "index.md": lambda: reports.index_page(summarised.toLocalIterator(), os.path.exists(overview)),
        }
        for name, page in pages.items():
            try:
                self.say(f"  {reports.write(os.path.join(docs, name), page())}")
            except OSError as e:
                self.say(f"  {name} can't be written: {e}")

    # search

    def _embedder(self):
        return self.embedder or clients.Embedder(self.settings.get("provider"), self.settings.key())

    def chunk_rows(self) -> DataFrame:
        """Chunks of all files with why they last changed, and the summaries. `ord` puts chunks by file, kind and place, and summaries last: it
        is made of those numbers, so nothing is sorted to number it."""
        texts = self._texts().select("ord", "rel_path", "content")
        code = chunks.chunk_files(texts, parse.symbols(self.parsed)).join(self.files.select("rel_path", F.col("ord").alias("file")), "rel_path")
        numbered = code.withColumn("ord", F.shiftleft(F.col("file"), 34) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("ord"))
        why = chunks.annotated(self.blamed(numbered)).drop("sha", "author", "message", "date")
        told = chunks.summary_chunks(cache.with_summary(self._texts(), self.cache.read())).join(self.files.select("rel_path", F.col("ord").alias("file")), "rel_path")
        said = told.withColumn("ord", F.lit(1 << 62) + F.col("file")).withColumn("why", F.lit(None).cast("string"))
        columns = ["ord", "text", "rel_path", "type", "name", "start_line", "end_line", "why"]
        return why.select(*columns).unionByName(said.select(*columns))

    def stale(self) -> DataFrame:
        """Indexed files whose content has another hash by now, and files that the index lacks."""
        indexed = self.index.read().where("type <> 'file_summary'").select("rel_path", "sha256").distinct()
        return self._texts().where(~paths.blank(F.col("content"))).select("rel_path", "sha256").join(indexed, ["rel_path", "sha256"], "left_anti")

    def build_index(self) -> int:
        hashes = self._texts().select("rel_path", "sha256")
        embedded = self._kept(clients.embed_rows(self.chunk_rows(), self._embedder()))
        for r in embedded.where("embed_error IS NOT NULL").limit(5).collect():
            self.say(f"{r.rel_path} is not indexed: {r.embed_error}")
        good = embedded.where("embed_error IS NULL").drop("embed_error").join(hashes, "rel_path")
        return self.index.write(good.select("ord", "text", "rel_path", "type", "name", "start_line", "end_line", "why", "embedding", "sha256")).count()

    def ask(self, question: str, rebuild: bool = False, k: int = 5) -> str | None:
        if self.embedder is None and not self.settings.key() and self.settings.get("provider") != "ollama":
            self.say(f"{self.settings.get('provider')} needs an API key: run init, or set its variable.")
            return None
        if rebuild or self.index.read().isEmpty():
            self.say(f"The index holds {self.build_index()} chunks.")
        elif not self.stale().isEmpty():
            self.say("The index is older than some files; --rebuild makes a new one.")
        try:
            near = vector.nearest(self.index.read(), self._embedder().embed(question), k)
            cite = text.citation(F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("type"))
            rows = near.select("ord", "similarity", cite.alias("cite"), text.context_block(cite, F.col("similarity"), F.col("why"), F.col("text")).alias("block")).orderBy(F.desc("similarity"), "ord").collect()
            if not rows:
                self.say("Nothing in the index is near the question.")
                return None
            context = "\n".join(r.block for r in rows)
            answer = self._service().generate(f"Excerpts:\n\n{context}\n\nThe question: {question}", text.ANSWER_SYSTEM)
        except (RuntimeError, ValueError) as e:
            raise Stopped(errors.advice(str(e), self.settings.get("provider"), self.settings.get("model"))) from e
        self.say("Answer")
        self.say(answer)
        self.say("From")
        for r in rows:
            self.say(f"  {r.cite}")
        return answer
