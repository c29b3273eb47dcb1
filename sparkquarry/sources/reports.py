"""Reports as text, from rows in order."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path

#: Fixed value: what stands for a missing summary.
NONE = "*(No summary generated)*"
ENTRY, DEAD = "entry point, so expected", "imported by no file"


def hotspot_table(rows: Iterable) -> str:
    """Fixed columns of 40, 10, 6, 8, 7 and 19 characters."""
    form = "{:<40} | {:<10} | {:<6} | {:<8} | {:<7} | {:<19}"
    head = form.format("File", "Complexity", "Churn", "Score", "Authors", "Last change")
    return "\n".join([head, "-" * 102, *(form.format(r.rel_path, r.complexity, r.churn, r.score, r.authors, r.last_modified) for r in rows)])


def dead_table(rows: Iterable) -> str:
    form = "{:<50} | {:<25}"
    body = [form.format(r.rel_path, ENTRY if r.is_entrypoint else DEAD) for r in rows]
    return "\n".join([form.format("File", "Why it stands here"), "-" * 80, *body]) if body else "Every file is imported by another."


def graph_page(title: str, mermaid: str) -> str:
    return f"# {title}\n\n```mermaid\n{mermaid}\n```\n"


def hotspot_page(rows: Iterable) -> str:
    body = "".join(f"| {r.rel_path} | {r.complexity} | {r.churn} | {r.score} | {r.authors} | {r.last_modified} |\n" for r in rows)
    return "# Hotspots\n\nFiles by complexity × churn.\n\n| File | Complexity | Churn | Score | Authors | Last change |\n| --- | --- | --- | --- | --- | --- |\n" + body


def dead_page(names: Iterable[str]) -> str:
    body = "".join(f"- `{n}`\n" for n in sorted(names))
    return "# Unreferenced files\n\nFiles that no other file imports.\n\n" + (body or "None found.\n")


def index_page(rows: Iterable, has_overview: bool) -> str:
    """Every file with its summary; an empty summary counts as none."""
    overview = "- [System architecture](architecture.md)" if has_overview else "- System architecture: not generated; run `doc --with-ai`"
    links = ["- [Dependency graph](dependency_graph.md)", "- [Hotspots](hotspots.md)", "- [Unreferenced files](deadcode.md)"]
    body = "\n".join(f"| `{r.rel_path}` | {r.summary or NONE} |" for r in rows)
    return "# Documentation\n\n" + "\n".join([overview, *links]) + "\n\n## File summaries\n\n| File | Summary |\n| --- | --- |\n" + body + "\n"


def write(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return path
