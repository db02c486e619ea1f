"""Embedding and language models behind HTTP, as callables for vectors.embed_chunks() and copilot.ask()."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from graphloam.operators.vectors import EmbeddingError


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.loads(r.read())
    except (urllib.error.URLError, OSError, ValueError) as e:
        raise EmbeddingError(f"{url}: {e}") from e


def http_embedder(url: str, model: str, timeout: float = 60.0) -> Callable[[list[str]], list[list[float]]]:
    """Posts {model, input} and reads `embeddings`; raises for a failed request or another number of vectors. It runs on
    the executors, a batch a request."""

    def embed(texts: list[str]) -> list[list[float]]:
        got = _post(url, {"model": model, "input": texts}, timeout).get("embeddings")
        if not isinstance(got, list) or len(got) != len(texts):
            raise EmbeddingError(f"{len(texts)} texts gave {len(got) if isinstance(got, list) else 'no'} vectors")
        return got

    return embed


def http_llm(url: str, model: str, timeout: float = 300.0) -> Callable[..., str]:
    """Posts the prompt without streaming and reads `response`."""

    def generate(prompt: str, max_tokens: int = 600, temperature: float = 0.0, system: str | None = None) -> str:
        body = {"model": model, "prompt": prompt, "stream": False, "options": {"num_predict": max_tokens, "temperature": temperature}} | ({"system": system} if system else {})
        return str(_post(url, body, timeout).get("response", ""))

    return generate
