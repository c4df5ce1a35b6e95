"""Generators of answers: the interface, a client over HTTP, prompts to answers as a column, and one answer as a stream of tokens."""

from __future__ import annotations

import json
import threading
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GenerationError

TIMEOUT = 180.0


class Client(Protocol):
    """What a generator offers."""

    def generate(self, prompt: str) -> str: ...

    def generate_stream(self, prompt: str) -> Iterator[str]: ...


class HttpClient:
    """A generator behind HTTP: JSON with model, prompt and options in; JSON lines with `response` (and `done`) out."""

    def __init__(self, url: str, model: str, timeout: float = TIMEOUT, options: dict | None = None):
        self.url, self.model, self.timeout, self.options = url, model, timeout, options or {}

    def _lines(self, prompt: str, stream: bool) -> Iterator[dict]:
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": stream, "options": self.options}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                for line in answer:
                    if line.strip():
                        yield json.loads(line)
        except (OSError, ValueError) as e:
            raise GenerationError(f"the generator failed: {e}") from e

    def generate(self, prompt: str) -> str:
        return "".join(x.get("response", "") for x in self._lines(prompt, False)).strip()

    def generate_stream(self, prompt: str) -> Iterator[str]:
        for x in self._lines(prompt, True):
            if x.get("response"):
                yield x["response"]
            if x.get("done"):
                return


def generator(make: Callable[[], Client]) -> Callable[[Column], Column]:
    """A column of prompts to a column of texts, for `answer.generated`; make builds a client in each worker. A prompt whose
    generation fails gives null, so that its question falls back."""

    def one(client: Client, prompt: str | None) -> str | None:
        try:
            return client.generate(prompt) if prompt else None
        except GenerationError:
            return None

    def run(batches):
        client = make()
        for prompts in batches:
            yield pa.array([one(client, p) for p in prompts.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def stream_answer(prompt: str, client: Client, cancelled: threading.Event | None = None) -> Iterator[str]:
    """One answer's tokens as they come, until the generator ends or the event is set."""
    for token in client.generate_stream(prompt):
        if cancelled is not None and cancelled.is_set():
            return
        yield token
