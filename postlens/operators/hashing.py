"""Feature hashing of character trigrams as column expressions, and the same for the Arrow path (V1, V2, V8)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.vectors import l2_norm, pool, zeros

# Multipliers and moduli of the trigram hash; the top bit gives the sign, bits from 12 the dimension.
STEP, FOLD, MIX, WIDTH, SHIFT = 65599, 1 << 31, 2654435761, 1 << 32, 12
CHARS = 1 << 18  # trigrams counted at once


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def trigram_hashes(text: Column) -> Column:
    """A hash for every three characters in a row of the text with a space at both ends; an empty text counts as one space."""
    padded = F.concat(F.lit(" "), F.when(text == "", F.lit(" ")).otherwise(text), F.lit(" "))

    def hashes(c: Column) -> Column:
        def one(i: Column) -> Column:
            h = F.lit(0).cast("long")
            for j in range(3):
                h = (h * STEP + F.element_at(c, (i + j).cast("int"))) % F.lit(FOLD)
            return (h * F.lit(MIX)) % F.lit(WIDTH)

        return F.transform(F.sequence(F.lit(1), F.size(c) - 2), one)

    return _bound(F.transform(F.split(padded, ""), F.ascii), hashes)


@dataclass(frozen=True)
class Hashing:
    """A vectoriser that never leaves the JVM: signed counts of trigrams in `dim` dimensions, scaled to length 1."""

    dim: int

    def vector(self, text: Column) -> Column:
        """NULL gives zeros, as does a text whose signed counts cancel out."""
        def add(sums: Column, m: Column) -> Column:
            at = (F.shiftright(m, SHIFT) % self.dim).cast("int")
            sign = F.when(m >= FOLD, F.lit(-1.0)).otherwise(F.lit(1.0))
            return F.concat(F.slice(sums, 1, at), F.array(F.element_at(sums, at + 1) + sign), F.slice(sums, at + 2, self.dim))

        def unit(v: Column) -> Column:
            return _bound(l2_norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

        there = _bound(F.aggregate(trigram_hashes(text), zeros(self.dim), add), unit)
        return F.when(text.isNotNull(), there).otherwise(zeros(self.dim)).cast("array<float>")

    def pooled(self, texts: Column, how: str) -> Column:
        vectors = F.transform(F.filter(texts, lambda t: t.isNotNull()), self.vector)
        return _bound(vectors, lambda v: pool(v, self.dim, how)).cast("array<float>")


@dataclass(frozen=True)
class HashingModel:
    """The same signed counts in numpy, for lists of texts or bytes (one character a byte)."""

    dim: int

    def __call__(self, items: Sequence) -> np.ndarray:
        texts = [f" {(i.decode('latin-1') if isinstance(i, bytes) else i) or ' '} " for i in items]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        ends, size = np.cumsum([len(t) for t in texts], dtype=np.int64), len(texts) * self.dim
        out = np.zeros(size)
        for start in range(0, len(chars) - 2, CHARS):
            c = chars[start : start + CHARS + 2].astype(np.int64)
            at = np.arange(start, start + len(c) - 2)
            owner = np.searchsorted(ends, at, side="right")
            whole = at + 2 < ends[owner]  # a trigram over two texts is none
            h = ((c[:-2] * STEP + c[1:-1]) % FOLD * STEP + c[2:]) % FOLD
            m = (h * MIX % WIDTH)[whole]
            out += np.bincount(owner[whole] * self.dim + (m >> SHIFT) % self.dim, np.where(m >= FOLD, -1.0, 1.0), size)
        return out.reshape(len(texts), self.dim)
