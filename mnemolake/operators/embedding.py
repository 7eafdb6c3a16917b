"""Filling vector gaps with a host model, in batches that shrink and retry."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemolake.functions.text import truncate_to_tokens

Model = Callable[[list[str]], list[list[float]]]


class TooLarge(Exception):
    """The model takes fewer texts at once."""


class RateLimited(Exception):
    """The model asks to wait."""


def byte_model(dimension: int) -> Model:
    """A deterministic stand-in: weights of bytes by place."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
            v = np.bincount((np.arange(len(data)) + data) % dimension, 1.0 + (data % 7) * 0.1, dimension)
            out.append((v if v.any() else np.eye(1, dimension)[0]).tolist())
        return out

    return embed


def embed_patiently(model: Model, texts: list[str], waits: tuple[float, ...] = (0.5, 1.0, 2.0)) -> list[list[float]]:
    """Vectors of ``texts``: halves a batch that is too large, waits where asked to."""
    for wait in (*waits, None):
        try:
            found = model(texts)
            if len(found) != len(texts):
                raise ValueError("the model must give a vector per text")
            return found
        except TooLarge:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return embed_patiently(model, texts[:half], waits) + embed_patiently(model, texts[half:], waits)
        except RateLimited:
            if wait is None:
                raise
            time.sleep(wait)
    raise AssertionError


def fill_gaps(gaps: DataFrame, model: Model, batch: int = 32, max_tokens: int | None = None) -> DataFrame:
    """id, vector (unit length) of every row (id, text) of ``gaps``; texts are cut to the model's budget first."""
    rows = gaps.select("id", truncate_to_tokens("text", max_tokens).alias("text") if max_tokens else "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for at in range(0, len(ids), batch):
                v = np.array(embed_patiently(model, [t or "" for t in texts[at : at + batch]]), np.float64)
                if not np.isfinite(v).all() or not (v != 0).any(axis=1).all():
                    raise ValueError("vectors must be finite and not zero")
                unit = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
                yield pa.record_batch([pa.array(ids[at : at + batch], pa.int64()), pa.array(unit.tolist(), pa.list_(pa.float32()))], names=["id", "vector"])

    return rows.mapInArrow(run, "id long, vector array<float>")
