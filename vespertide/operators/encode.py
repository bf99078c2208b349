"""Documents to vectors by any encoder, in batches.

An encoder is named and made by a function that loads it, and is loaded once in each Python worker, however many
tasks that worker runs. It takes a list of texts and gives one vector each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_TEXTS = 512
_LOADED: dict[str, Callable] = {}


@dataclass(frozen=True)
class Encoder:
    """name: says which model it is, with all that its vectors depend on. load: gives a function from texts to vectors."""

    name: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]

    def encode(self, texts: list[str]) -> np.ndarray:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return np.asarray(_LOADED[self.name](texts), dtype=np.float64)


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def encoded(docs: DataFrame, encoder: Encoder, batch: int = BATCH_TEXTS) -> DataFrame:
    """(id, vec): unit vectors of documents, so many at a time. docs: (id, document), each id once. Blank documents and those without a direction are not covered and left out."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for begin in range(0, len(rows), batch):
                part = rows.iloc[begin : begin + batch]
                vectors = encoder.encode(part["document"].tolist())
                there = np.isfinite(vectors).all(axis=1) & vectors.any(axis=1)
                yield pd.DataFrame({"id": part["id"].to_numpy()[there], "vec": pd.Series(list(unit(vectors[there])), dtype=object)})

    said = docs.where(F.trim(F.coalesce("document", F.lit(""))) != "").select("id", "document")
    return said.mapInPandas(each, "id long, vec array<double>")


def hashing(size: int) -> Encoder:
    """Counts of words hashed to `size` places, for corpora without a trained encoder."""

    def load():
        word = re.compile("[a-z0-9]{2,}")

        def counts(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for n, text in enumerate(texts):
                for w in word.findall(text.lower()):
                    out[n, int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % size] += 1
            return out

        return counts

    return Encoder(f"hashing-{size}", load)


def query_text(text: str, keywords: list[str] | None) -> str:
    return ". ".join(x for x in ((text or "").strip(), ", ".join(k for k in keywords or [] if k)) if x)


def query_encoder(encoder: Encoder) -> Callable[[str, list[str]], list[float] | None]:
    """Free text and keywords to a unit vector as documents have them; None for what says nothing."""

    def encode(text: str, keywords: list[str]) -> list[float] | None:
        asked = query_text(text, keywords)
        vector = encoder.encode([asked])[0] if asked else None
        return unit(vector[None])[0].tolist() if vector is not None and vector.any() else None

    return encode
