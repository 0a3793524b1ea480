"""Embedding models behind one interface, with a deterministic built-in model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    name: str
    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of words and word pairs into a unit vector; equal texts give equal vectors."""

    def __init__(self, size: int = 64, name: str = "kelpline/hash-64"):
        self.size, self.name = size, name

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            for feature in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = xxhash.xxh64_intdigest(feature)
                out[i, h % self.size] += 1.0 if h >> 40 & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class PixelEmbedder:
    """Brightness of an 8 by 8 raster over a PNG, centred and of unit length; equal images give equal vectors."""

    size, name = 64, "kelpline/pixel-64"

    def embed(self, images: list[bytes]) -> np.ndarray:
        from ..sources.pdfimages import decode_png

        out = np.zeros((len(images), self.size), np.float32)
        for i, data in enumerate(images):
            pixels = decode_png(data)
            if pixels is None:
                continue
            rows, cols = (np.linspace(0, n, 9).astype(int) for n in pixels.shape[:2])
            gray = pixels.reshape(*pixels.shape[:2], -1)[..., :3].mean(axis=2)
            out[i] = [gray[a : max(b, a + 1), c : max(d, c + 1)].mean() for a, b in zip(rows, rows[1:]) for c, d in zip(cols, cols[1:])]
        out -= out.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm < 1e-6, 1, norm)


def providers(gpu: bool = False) -> list[str]:
    """Execution providers for models that run on ONNX: the GPU first if it is wanted and there."""
    try:
        import onnxruntime

        there = onnxruntime.get_available_providers()
    except ImportError:
        there = []
    return ["CUDAExecutionProvider"] * (gpu and "CUDAExecutionProvider" in there) + ["CPUExecutionProvider"]


#: models by name: (maker, vector size, description)
MODELS: dict[str, tuple[Callable[[], Embedder], int, str]] = {
    f"kelpline/hash-{n}": (lambda n=n: HashEmbedder(n, f"kelpline/hash-{n}"), n, f"Feature hashing of words and word pairs into {n} values, deterministic and without model files")
    for n in (64, 128, 384)
}
#: image models by name; they embed PNG bytes.  Register others with ``register_image_model``
IMAGE_MODELS: dict[str, tuple[Callable[[], Embedder], int, str]] = {"kelpline/pixel-64": (PixelEmbedder, 64, "Brightness of an 8 by 8 raster, deterministic and without model files")}
DEFAULT_MODEL, DEFAULT_IMAGE_MODEL = "kelpline/hash-64", "kelpline/pixel-64"
_LOADED: dict[str, Embedder] = {}


def loaded(model: str, registry: dict | None = None) -> Embedder:
    """The model, made once per worker and kept for all later batches."""
    known = MODELS if registry is None else registry
    key = f"{'text' if registry is None else 'image'}:{model}"
    if key not in _LOADED:
        _LOADED[key] = known[model][0]()
    return _LOADED[key]


def register_model(name: str, make: Callable[[], Embedder], size: int, description: str = "") -> None:
    MODELS[name] = (make, size, description)


def register_image_model(name: str, make: Callable[[], Embedder], size: int, description: str = "") -> None:
    IMAGE_MODELS[name] = (make, size, description)


def model_info(name: str, registry: dict | None = None) -> dict:
    """Name, size and description of exactly this model; ``ValueError`` names the first ten others."""
    known = MODELS if registry is None else registry
    if name not in known:
        raise ValueError(f"unknown model {name!r}; known are {', '.join(sorted(known)[:10])}")
    _, size, description = known[name]
    return {"model": name, "size": size, "description": description}


def models_table(spark, search: str | None = None, registry: dict | None = None) -> DataFrame:
    """``(model, size, description)`` by name, filtered by a substring without regard to case."""
    rows = [(n, s, d) for n, (_, s, d) in (MODELS if registry is None else registry).items()]
    out = spark.createDataFrame(rows, "model string, size int, description string")
    if search:
        out = out.where(F.contains(F.lower("model"), F.lit(search.lower())))
    cut = F.when(F.length("description") > 50, F.concat(F.substring("description", 1, 47), F.lit("..."))).otherwise(F.col("description"))
    return out.withColumn("description", cut).orderBy("model")


def _embedding(data: Column, model: str, registry: dict | None, empty) -> Column:
    make = (MODELS if registry is None else registry)[model]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # a model that was registered on the driver only comes with the function
        (MODELS if registry is None else IMAGE_MODELS).setdefault(model, make)
        embedder = loaded(model, None if registry is None else IMAGE_MODELS)
        for batch in batches:
            vectors = embedder.embed([empty if x is None else x for x in batch])
            yield pd.Series([None if x is None else v for x, v in zip(batch, vectors)])

    return run(data)


def embed(text: Column, model: str = DEFAULT_MODEL) -> Column:
    """Vector of each text (null for null); one model per worker, texts in Arrow batches."""
    return _embedding(text, model, None, "")


def embed_images(data: Column, model: str = DEFAULT_IMAGE_MODEL) -> Column:
    """Vector of each PNG (null for null); one model per worker, images in Arrow batches."""
    return _embedding(data, model, IMAGE_MODELS, b"")
