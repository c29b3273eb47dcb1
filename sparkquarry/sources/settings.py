"""User settings in a YAML file."""

from __future__ import annotations

import os
from pathlib import Path

import yaml

PATH = os.path.expanduser("~/.sparkquarry/config.yaml")
#: What holds unless the file says otherwise.
DEFAULTS = {"provider": "openai", "model": "gpt-4o-mini", "api_key": "", "api_url": "http://localhost:11434"}


class Settings:
    def __init__(self, path: str = PATH):
        self.path = path
        self.values = dict(DEFAULTS)
        try:
            loaded = yaml.safe_load(Path(path).read_text())
        except (OSError, yaml.YAMLError):
            loaded = None
        if isinstance(loaded, dict):
            self.values |= loaded

    def get(self, key: str, default=None):
        return self.values.get(key, default)

    def set(self, key: str, value) -> None:
        """Takes effect at once, in the file too; a file that can't be written leaves the value in memory."""
        self.values[key] = value
        try:
            os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
            Path(self.path).write_text(yaml.safe_dump(self.values, default_flow_style=False))
        except OSError as e:
            print(f"Warning: settings not saved: {e}")

    def key(self) -> str | None:
        """The key of the provider: its environment variable first, then the file; the host for Ollama."""
        provider = self.get("provider")
        if provider in ("openai", "anthropic"):
            return os.environ.get(f"{provider.upper()}_API_KEY") or self.get("api_key")
        return self.get("api_url") if provider in ("ollama", "local") else None
