"""Text to vectors in batches with retries; the encoder is pluggable."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.config import DEFAULTS
from corpusmill.functions.arrow import map_columns
from corpusmill.functions.fulltext import analyze

Encoder = Callable[[list[str]], list[list[float]]]
Sleeper = Callable[[float], None]


def hashing_encoder(texts: list[str], dimensions: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words; deterministic and without a model, so no substitute for a semantic one."""
    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts):
        for word, _ in analyze(text):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            row[h % dimensions] += 1 if h >> 63 else -1
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32).tolist()


def batches(texts: list, size: int) -> Iterator[list]:
    for i in range(0, len(texts), size):
        yield texts[i : i + size]


def encode_texts(texts: list[str], encoder: Encoder = hashing_encoder, batch: int = DEFAULTS.encode_batch, retries: int = DEFAULTS.encode_retries, backoff: float = DEFAULTS.encode_backoff_s, sleep: Sleeper = time.sleep) -> list[list[float]]:
    """Vectors in order; a failing batch is tried again ``retries`` times after ``backoff``, twice that, and so on."""
    out: list[list[float]] = []
    for part in batches(texts, batch):
        for attempt in range(retries + 1):
            try:
                got = encoder(part)
                break
            except Exception:
                if attempt == retries:
                    raise
                sleep(backoff * 2**attempt)
        if len(got) != len(part):
            raise ValueError(f"the encoder gave {len(got)} vectors for {len(part)} texts")
        out += got
    return out


def embed(df: DataFrame, text: str = "text", out: str = "embedding", encoder: Encoder = hashing_encoder, batch: int = DEFAULTS.encode_batch, error: str | None = None) -> DataFrame:
    """``df`` with the vector of ``text`` (null for null); with ``error``, a column of that name says why a row has none,
    and a text that the encoder can't take fails neither the others nor the job."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(text)

    def run(*cols: list) -> tuple:
        there = [i for i, t in enumerate(cols[at]) if t is not None]
        vectors: list = [None] * len(cols[at])
        errors: list = [None] * len(cols[at])
        for part in batches(there, batch):
            try:
                got = encode_texts([cols[at][i] for i in part], encoder, batch)
            except Exception:
                if error is None:
                    raise
                got = []
                for i in part:
                    try:
                        got += encode_texts([cols[at][i]], encoder, batch, retries=0)
                    except Exception as x:
                        got.append(None)
                        errors[i] = f"{type(x).__name__}: {x}"
            for i, v in zip(part, got):
                vectors[i] = v
        return (*cols, vectors, errors) if error else (*cols, vectors)

    return map_columns(df, run, f"{kinds}, {out} array<float>" + (f", {error} string" if error else ""))


def oversize(df: DataFrame, tokens: str = "token_count", most: int = DEFAULTS.max_chunk_tokens) -> DataFrame:
    """n_chunks, n_oversize: how many chunks are longer than the encoder takes."""
    return df.agg(F.count("*").alias("n_chunks"), F.count_if(F.col(tokens) > most).alias("n_oversize"))


def vector_literal(vector: Column) -> Column:
    """'[a,b,c]'."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))
