"""Pluggable models: an embedding backend and an answering backend, run in Arrow batches."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import embed_text
from .functions.vectors import hash_vector
from .operators.dedupe import latest_by_id


class EmbeddingBackend(Protocol):
    model_id: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed_new(items: DataFrame, vectors: DataFrame, make: Callable[[], EmbeddingBackend], model_id: str) -> DataFrame:
    """``(item_id, model_id, dim, vector)`` of items without a vector of the model; the model is loaded once a task."""
    todo = latest_by_id(items).join(vectors.where(F.col("model_id") == model_id).select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    todo = todo.select(F.col("id").alias("item_id"), embed_text(F.col("title"), F.col("lede")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for f in frames:
            made = backend.embed(f["text"].tolist())
            yield pd.DataFrame({"item_id": f["item_id"], "model_id": model_id, "dim": [len(v) for v in made], "vector": made})

    return todo.mapInPandas(run, "item_id string, model_id string, dim int, vector array<double>")


def embed_by_hash(items: DataFrame, vectors: DataFrame, dim: int = 8) -> DataFrame:
    """The same with the reproducible hash model, without leaving the JVM."""
    model = f"hash-{dim}"
    todo = latest_by_id(items).join(vectors.where(F.col("model_id") == model).select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    return todo.select(F.col("id").alias("item_id"), F.lit(model).alias("model_id"), F.lit(dim).alias("dim"), hash_vector(embed_text(F.col("title"), F.col("lede")), dim).alias("vector"))


def ask(questions: DataFrame, make_post: Callable[[], Callable[[str], float]], retries: int = 4, wait: float = 1.0) -> DataFrame:
    """``questions`` (``pair_id``, ``body``) with ``p``, or ``error``.

    An answer is a number in [0, 1]; anything else, a boolean or a text among them, is
    an error at once. A failed call is tried again, after ``wait`` seconds and twice as
    long each time, unless its exception has a ``status`` that blames the request (400
    to 499, other than 408 and 429).
    """

    def answer(post, body) -> tuple[float | None, str | None]:
        error = "not asked"
        for n in range(retries):
            if n and wait:
                time.sleep(wait * 2 ** (n - 1))
            try:
                p = post(body)
            except Exception as e:  # noqa: BLE001 - any failure of a call is data
                error, status = str(e)[:200], getattr(e, "status", None)
                if isinstance(status, int) and 400 <= status < 500 and status not in (408, 429):
                    break
                continue
            if isinstance(p, bool) or not isinstance(p, int | float):
                return None, f"{p!r} is no number"[:200]
            return (float(p), None) if 0 <= p <= 1 else (None, "outside [0, 1]")
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        post = make_post()
        for f in frames:
            said = [answer(post, body) for body in f["body"]]
            yield pd.DataFrame({"pair_id": f["pair_id"], "p": pd.Series([p for p, _ in said], dtype="float64"), "error": pd.Series([e for _, e in said], dtype="object")})

    return questions.select("pair_id", "body").mapInPandas(run, "pair_id string, p double, error string")


def prompt_id(prompt: str) -> str:
    """Six bytes of BLAKE2b: answers hold only for the prompt they were given to."""
    return hashlib.blake2b(prompt.encode(), digest_size=6).hexdigest()
