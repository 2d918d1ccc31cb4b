"""Embedding texts through an injected provider, and the sidecar table of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.operators.corpus import to_embed, upsert
from quotewright.runtime import ship_code

#: Texts that a provider gets at once.
BATCH = 1000


def sign_bits(vectors: np.ndarray) -> list[bytes]:
    """Vectors as one bit a dimension, set where positive, most significant bit first."""
    return [r.tobytes() for r in np.packbits(np.asarray(vectors) > 0, axis=1)]


def signed_bytes(vectors: np.ndarray) -> list[bytes]:
    """Vectors of whole numbers from -128 to 127 as one byte a dimension, in two's complement."""
    return [r.tobytes() for r in np.asarray(vectors).astype(np.int8)]


def arranged(answers: list[tuple[int, list[float]]]) -> np.ndarray:
    """A provider's answers (index, vector), in whatever order they came, by index."""
    return np.array([v for _, v in sorted(answers, key=lambda a: a[0])])


#: How vectors are packed, by dtype.
PACKED = {"binary": sign_bits, "int8": signed_bytes}


def stub(dim: int) -> Callable[[list[str]], np.ndarray]:
    """A provider without a model: vectors that depend on nothing but the text."""
    return lambda texts: np.stack([np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(dim) for t in texts])


def embed(texts: DataFrame, provider: Callable[[list[str]], np.ndarray | list[tuple]], model: str, dtype: str = "binary") -> DataFrame:
    """record_id, model, dim, dtype, text_sha256, vec of texts (id, text, text_sha256), a few requests a task. A provider
    gives vectors in order, or pairs (index, vector) in any order; a number of vectors other than asked raises."""
    ship_code(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), BATCH):
                part = b.slice(start, BATCH)
                given = provider(part.column(1).to_pylist())
                vectors = arranged(given) if len(given) and isinstance(given[0], tuple) else np.asarray(given)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(vectors)} vectors")
                n = len(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model] * n), pa.array([vectors.shape[1]] * n, pa.int32()), pa.array([dtype] * n), part.column(2), pa.array(PACKED[dtype](vectors), pa.binary())], names=["record_id", "model", "dim", "dtype", "text_sha256", "vec"])

    return texts.select("id", "text", "text_sha256").mapInArrow(run, "record_id string, model string, dim int, dtype string, text_sha256 string, vec binary")


def refresh(records: DataFrame, variants: DataFrame, stored: DataFrame, provider: Callable[[list[str]], np.ndarray], model: str) -> DataFrame:
    """The sidecar with vectors for texts that are new or changed; the others aren't embedded again."""
    new = embed(to_embed(records, variants, stored.where(F.col("model") == model)), provider, model)
    columns = ["record_id", "model", "dim", "dtype", "text_sha256", "vec"]
    return upsert(stored.select(*columns), new.select(*columns), ["record_id", "model"], ["text_sha256"])
