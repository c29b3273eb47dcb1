"""Text generation and embedding services, and their offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import os
import ssl
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import arrow_map

#: Models, addresses and limits of the services.
MODELS = {"openai": "gpt-4o-mini", "anthropic": "claude-3-5-sonnet-20241022", "ollama": "llama3"}
EMBEDDERS = {"openai": "text-embedding-3-small", "ollama": "nomic-embed-text"}
OLLAMA = "http://localhost:11434"
GENERATE_S = {"openai": 30, "anthropic": 30, "ollama": 300}
EMBED_S = 15
TEMPERATURE, MOST_TOKENS = 0.2, 2048

Post = Callable[[str, dict, dict, float], dict]


def post(url: str, headers: dict, payload: dict, timeout: float) -> dict:
    """JSON in and out, over verified connections only."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout, context=ssl.create_default_context()) as response:
            return json.loads(response.read().decode())
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"HTTP error {e.code}: {e.read().decode('utf-8', 'ignore')}") from e
    except TimeoutError as e:
        raise RuntimeError(f"request timed out: {e}") from e
    except OSError as e:
        raise RuntimeError(f"request failed: {e}") from e


def provider_name(provider: str) -> str:
    name = provider.lower()
    return "ollama" if name == "local" else name


class Generator:
    """Answers prompts. The key is an argument or, without one, an environment variable; for Ollama it is the host."""

    def __init__(self, provider: str, key: str | None = None, model: str | None = None, send: Post = post):
        self.provider = provider_name(provider)
        if self.provider not in MODELS:
            raise ValueError(f"no service is called {provider}")
        self.model = model or MODELS[self.provider]
        self.send = send
        variable = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "ollama": "OLLAMA_HOST"}[self.provider]
        self.key = key or os.environ.get(variable) or (OLLAMA if self.provider == "ollama" else None)

    def generate(self, prompt: str, system: str = "") -> str:
        if not self.key:
            raise ValueError(f"{self.provider} needs an API key")
        limit = GENERATE_S[self.provider]
        if self.provider == "openai":
            messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
            body = {"model": self.model, "messages": messages, "temperature": TEMPERATURE}
            return self.send("https://api.openai.com/v1/chat/completions", {"Authorization": f"Bearer {self.key}"}, body, limit)["choices"][0]["message"]["content"]
        if self.provider == "anthropic":
            body = {"model": self.model, "max_tokens": MOST_TOKENS, "messages": [{"role": "user", "content": prompt}]} | ({"system": system} if system else {})
            return self.send("https://api.anthropic.com/v1/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, body, limit)["content"][0]["text"]
        body = {"model": self.model, "prompt": prompt, "stream": False} | ({"system": system} if system else {})
        try:
            return self.send(f"{self.key}/api/generate", {}, body, limit)["response"]
        except RuntimeError as e:
            raise e if "timed out" in str(e).lower() else RuntimeError(f"{e} ({self.key}). Ensure Ollama is running.") from e


class Embedder:
    """Vectors of texts, from the services that offer them."""

    def __init__(self, provider: str, key: str | None = None, model: str | None = None, send: Post = post):
        self.provider = provider_name(provider)
        self.key, self.send = key, send
        self.model = model or EMBEDDERS.get(self.provider)

    def embed(self, text: str) -> list[float]:
        if self.provider == "openai":
            if not self.key:
                raise ValueError("openai needs an API key")
            return self.send("https://api.openai.com/v1/embeddings", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "input": text}, EMBED_S)["data"][0]["embedding"]
        if self.provider == "ollama":
            return self.send(f"{self.key or OLLAMA}/api/embeddings", {}, {"model": self.model, "prompt": text}, EMBED_S)["embedding"]
        raise ValueError(f"{self.provider} offers no vectors")


class OfflineGenerator:
    """Says what it was asked, in a digest: the same answer to the same prompt."""

    model = "offline"

    def generate(self, prompt: str, system: str = "") -> str:
        return f"answer {hashlib.sha256((system + chr(0) + prompt).encode()).hexdigest()[:12]}"


class OfflineEmbedder:
    """Hashed words as a vector: texts with words in common are near each other."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.size
        for word in text.lower().split():
            digest = hashlib.sha256(word.encode()).digest()
            out[digest[0] % self.size] += 1.0 if digest[1] & 1 else -1.0
        return out


def embed_rows(chunks: DataFrame, embedder) -> DataFrame:
    """Adds `embedding` to rows of `text`, and `embed_error` where the service failed. Write the result before it is read
    twice: each evaluation calls the service."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("embed_error", T.StringType())])
    place = chunks.columns.index("text")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            vectors, failed = [], []
            for value in batch.column(place).to_pylist():
                try:
                    vectors.append([float(x) for x in embedder.embed(value or "")])
                    failed.append(None)
                except (RuntimeError, ValueError) as e:
                    vectors.append(None)
                    failed.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array(failed, pa.string())], [*batch.schema.names, "embedding", "embed_error"])

    return arrow_map(chunks, batches, schema)


def generate_rows(prompts: DataFrame, generator, system: str) -> DataFrame:
    """(key, sha256, summary, error) of rows (key, sha256, prompt). Write it once before use, as above."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            said, failed = [], []
            for prompt in batch.column(2).to_pylist():
                try:
                    said.append(generator.generate(prompt, system).strip())
                    failed.append(None)
                except (RuntimeError, ValueError) as e:
                    said.append(None)
                    failed.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(failed, pa.string())], ["key", "sha256", "summary", "error"])

    return arrow_map(prompts.select("key", F.col("sha256"), "prompt"), batches, "key string, sha256 string, summary string, error string")
