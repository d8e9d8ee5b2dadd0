"""Applying a caller's encoder to text, chunks and images (V1, V2, V8).

An encoder is a callable from a list of strings or bytes (None where an image is missing) to an array of
shape (n, dim). It is loaded once per Python worker. Only the input column travels to Python. A Hashing takes the place
of an encoder where trigram counts are enough, and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.text import content_chunks, encoder_text
from postlens.operators.hashing import Hashing, HashingModel

VECTOR = T.ArrayType(T.FloatType())
SLICE_BYTES, SLICE_ITEMS = 1 << 18, 8192  # of a batch, at once in Python
_LOADED: dict[str, Callable] = {}


@dataclass(frozen=True)
class EncoderSpec:
    """How to load an encoder on a worker, its width, and the rows given to it at once."""

    name: str
    load: Callable[[], Callable[[Sequence], np.ndarray]]
    dim: int
    batch: int = 8


def _model(spec: EncoderSpec) -> Callable:
    if spec.name not in _LOADED:
        _LOADED[spec.name] = spec.load()
    return _LOADED[spec.name]


def _encode(model: Callable, items: Sequence, spec: EncoderSpec) -> np.ndarray:
    """Unit vectors for the items, in mini-batches; a zero vector stays zero."""
    if not len(items):
        return np.zeros((0, spec.dim))
    parts = [np.asarray(model(items[i:i + spec.batch]), dtype="float64") for i in range(0, len(items), spec.batch)]
    out = np.vstack(parts)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _slices(items: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of about SLICE_BYTES; a larger item stands alone. What Python holds of a batch does not grow with the batch."""
    ends = np.cumsum(pc.binary_length(items).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(items):
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))), start + SLICE_ITEMS)
        yield start, stop
        start = stop


def _vectors(out: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.astype("float32").ravel()))


def _encode_present(spec: EncoderSpec):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(spec)
        for rows in batches:
            there, items = np.flatnonzero(rows.is_valid()), rows.drop_null()
            out = np.zeros((len(rows), spec.dim), dtype="float32")
            for a, b in _slices(items):
                out[there[a:b]] = _encode(model, items[a:b].to_pylist(), spec)
            yield _vectors(out)

    return F.arrow_udf(run, VECTOR)


def _encode_lists(spec: EncoderSpec, how: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(spec)
        fold, none = (np.maximum, -np.inf) if how == "max" else (np.add, 0.0)
        for rows in batches:
            items, owner = pc.list_flatten(rows), pc.list_parent_indices(rows).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, items = owner[np.asarray(items.is_valid())], items.drop_null()
            n = np.bincount(owner, minlength=len(rows))[:, None]
            out = np.full((len(rows), spec.dim), none)
            for a, b in _slices(items):
                of, first = np.unique(owner[a:b], return_index=True)
                out[of] = fold(out[of], fold.reduceat(_encode(model, items[a:b].to_pylist(), spec), first, axis=0))
            yield _vectors(np.where(n > 0, out if how == "max" else out / np.maximum(n, 1), 0.0))

    return F.arrow_udf(run, VECTOR)


def _one(spec: EncoderSpec | Hashing, item: Column) -> Column:
    return spec.vector(item) if isinstance(spec, Hashing) else _encode_present(spec)(item)


def _many(spec: EncoderSpec | Hashing, items: Column, how: str) -> Column:
    return spec.pooled(items, how) if isinstance(spec, Hashing) else _encode_lists(spec, how)(items)


def encode_text(text: Column, spec: EncoderSpec | Hashing, kept: Column | None = None) -> Column:
    """V1: blank text is encoded as one space; rows not `kept` get zeros and never reach the encoder."""
    clean = encoder_text(text)
    return _one(spec, clean if kept is None else F.when(kept, clean))


def encode_content(text: Column, spec: EncoderSpec | Hashing, kept: Column | None = None, **cut: int) -> Column:
    """V8: mean of the vectors of the pieces; blank content gives zeros."""
    pieces = content_chunks(text, **cut)
    return _many(spec, pieces if kept is None else F.when(kept, pieces), "mean")


def encode_image(image: Column, spec: EncoderSpec | Hashing, kept: Column | None = None) -> Column:
    """V2, cover: a missing image is given to the encoder as empty bytes, for it to answer its blank image."""
    present = F.coalesce(image, F.lit(b""))
    present = F.decode(present, "ISO-8859-1") if isinstance(spec, Hashing) else present
    return _one(spec, present if kept is None else F.when(kept, present))


def encode_images(images: Column, spec: EncoderSpec | Hashing, how: str = "mean", kept: Column | None = None) -> Column:
    """V2 and V7, inner images: missing ones are skipped, none at all gives zeros."""
    given = F.transform(images, lambda i: F.decode(i, "ISO-8859-1")) if isinstance(spec, Hashing) else images
    return _many(spec, given if kept is None else F.when(kept, given), how)


def hashing_encoder(dim: int, batch: int = 8192) -> EncoderSpec:
    """Trigram counts by the Arrow path; the vectors equal those of Hashing(dim)."""
    return EncoderSpec(f"trigrams-{dim}", lambda: HashingModel(dim), dim, batch)
