"""Embedders by provider: the hash embedder, an HTTP service, a local model; and the asynchronous batch cycle."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .embedding import batch_requests, batch_results, embedded, hash_embedded, matched

#: What embeds: a table with a text column to the same with an embedding.
Embedder = Callable[[DataFrame], DataFrame]


class HttpEncoder:
    """Encoder of a service that takes {model, input} and gives data[i].embedding; made anew in every task.

    The key is read from an environment variable on the executor, so that it stands in no plan or log."""

    def __init__(self, endpoint: str, model: str, key_variable: str = "", timeout: float = 60.0):
        self.endpoint, self.model, self.key_variable, self.timeout = endpoint, model, key_variable, timeout

    def __call__(self, texts: list[str]) -> np.ndarray:
        headers = {"Content-Type": "application/json"}
        if key := os.environ.get(self.key_variable or " "):
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(self.endpoint, json.dumps({"model": self.model, "input": texts}).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            rows = json.loads(answer.read())["data"]
        return np.array([r["embedding"] for r in rows], np.float32)


def _hash(config: dict) -> Embedder:
    return lambda df: hash_embedded(df, int(config.get("dim", 64)))


def _http(config: dict) -> Embedder:
    encoder = HttpEncoder(config["endpoint"], config["model"], config.get("key_variable", ""))
    return lambda df: embedded(df, lambda: encoder, _batch(config))


def _local(config: dict) -> Embedder:
    def load():
        from sentence_transformers import SentenceTransformer  # not part of this environment

        return SentenceTransformer(config["model"]).encode

    return lambda df: embedded(df, load, _batch(config))


def _batch(config: dict) -> int:
    """Texts in one call, by embedding.mode: 'batch' or 'single'; another mode raises."""
    mode = config.get("mode", "batch")
    if mode not in ("batch", "single"):
        raise ValueError(f"unknown embedding mode {mode!r}")
    return int(config.get("batch_size", 100)) if mode == "batch" else 1


PROVIDERS: dict[str, Callable[[dict], Embedder]] = {"hash": _hash, "http": _http, "local": _local}


def register(provider: str, make: Callable[[dict], Embedder]) -> None:
    """Add a provider, or put another in its place."""
    PROVIDERS[provider] = make


def embedder(config: dict) -> Embedder:
    """The embedder of an embedding section; an unknown provider raises ValueError."""
    provider = config.get("provider", "hash")
    if provider not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {provider!r}")
    return PROVIDERS[provider](config)


class BatchService(Protocol):
    """A service that embeds whole files of requests some time later."""

    def submit(self, path: str, window: str) -> str:
        """Take in a folder of request lines; gives the job's id."""

    def status(self, job: str) -> str:
        """'completed', 'failed', 'expired', 'cancelled', or anything else while it runs."""

    def results(self, job: str) -> str:
        """Path of the result lines of a completed job."""


class BatchFailed(Exception):
    """A batch job ended without results."""


def batch_embedded(chunks: DataFrame, service: BatchService, model: str, folder: str, poll_seconds: float = 5.0, window: str = "24h", wait: Callable[[float], None] = time.sleep, longest: float = 24 * 3600.0) -> DataFrame:
    """chunks (chunk_id, text, ...) with the embeddings of a batch job: write requests, submit, poll, read results, join by chunk_id.

    Chunks without a result of status 200 are left out; embedding.missing() tells which. A job that
    fails, or runs longer than the window, raises BatchFailed."""
    spark = chunks.sparkSession
    batch_requests(chunks, model).write.mode("overwrite").text(folder)
    job, waited = service.submit(folder, window), 0.0
    while (state := service.status(job)) != "completed":
        if state in ("failed", "expired", "cancelled") or waited > longest:
            raise BatchFailed(f"batch {job} is {state}")
        wait(poll_seconds)
        waited += poll_seconds
    return matched(chunks, batch_results(spark.read.text(service.results(job)).select(F.col("value").alias("line"))))
