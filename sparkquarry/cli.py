"""Command line of the engine."""

from __future__ import annotations

import argparse
import getpass
import sys

from pyspark.sql import SparkSession

from . import __version__
from .plans.commands import Engine, Stopped
from .sources import clients, local
from .sources.settings import Settings

HELP = """commands:
  scan [path_or_url] [--detailed] [--with-ai] [--ai-budget CENTS] [--dry-run-ai]   files, symbols, statistics, summaries
  graph [path_or_url] [--output FILE]                                              module graph as a Mermaid flowchart
  hotspots [path_or_url]                                                           files by complexity x churn
  deadcode [path_or_url]                                                           files that no other imports
  doc [path_or_url] [--with-ai] [--ai-budget CENTS] [--dry-run-ai]                 documentation under docs/
  ask QUESTION [path_or_url] [--rebuild]                                           answers from the indexed code
  init                                                                             settings
  help                                                                             this text"""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkquarry", description="Analytics of source trees on Spark.", epilog=HELP, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--version", action="version", version=f"sparkquarry {__version__}")
    commands = top.add_subparsers(dest="command")

    def add(name: str, *, path: bool = True, ai: bool = False) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        if name == "ask":
            one.add_argument("question")
        if path:
            one.add_argument("path", nargs="?", default=".")
        if ai:
            one.add_argument("--with-ai", action="store_true")
            one.add_argument("--ai-budget", type=int, metavar="CENTS")
            one.add_argument("--dry-run-ai", action="store_true")
        return one

    add("scan", ai=True).add_argument("--detailed", action="store_true")
    add("graph").add_argument("--output", "-o")
    add("hotspots")
    add("deadcode")
    add("doc", ai=True)
    add("ask").add_argument("--rebuild", action="store_true")
    add("init", path=False)
    add("help", path=False)
    return top


def _asked(question: str) -> bool:
    return input(f"{question} [y/N]: ").strip().lower() in ("y", "yes")


def wizard(settings: Settings, ask=input, secret=getpass.getpass) -> None:
    known = settings.get("provider")
    provider = (ask(f"AI provider (openai, anthropic, ollama) [{known}]: ").strip() or known).lower()
    if provider not in clients.MODELS:
        raise Stopped(f"no service is called {provider}")
    default = settings.get("model") if provider == known else clients.MODELS[provider]
    model = ask(f"Model [{default}]: ").strip() or default
    key = url = ""
    if provider == "ollama":
        url = ask(f"Ollama host [{settings.get('api_url')}]: ").strip() or settings.get("api_url") or clients.OLLAMA
    else:
        key = secret("API key (empty: use the environment): ")
    settings.set("provider", provider)
    settings.set("model", model)
    if key:
        settings.set("api_key", key)
    if url:
        settings.set("api_url", url)
    print(f"Settings are in {settings.path}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **engine) -> int:
    options = parser().parse_args(argv)
    if options.command in (None, "help"):
        print(HELP)
        return 0
    try:
        settings = engine.pop("settings", None) or Settings()
        if options.command == "init":
            wizard(settings)
            return 0
        root, held = local.resolve(options.path)
        spark = spark or SparkSession.builder.appName("sparkquarry").getOrCreate()
        own = Engine(spark, root, settings, **({"confirm": _asked} | engine))
        if options.command == "scan":
            own.scan(options.detailed, options.with_ai, options.ai_budget, options.dry_run_ai)
        elif options.command == "doc":
            own.doc(options.with_ai, options.ai_budget, options.dry_run_ai)
        elif options.command == "graph":
            own.graph(options.output)
        elif options.command == "ask":
            own.ask(options.question, options.rebuild)
        else:
            getattr(own, options.command)()
        del held
    except (Stopped, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
