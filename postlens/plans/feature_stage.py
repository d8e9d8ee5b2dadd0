"""Multimodal features of posts as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import image_count, tag_names
from postlens.functions.vectors import expand, pack
from postlens.operators import encoder_stage as enc
from postlens.operators.filters import min_impressions, rename_vectors
from postlens.settings import LEGACY_PREFIXES, VECTOR_PREFIXES


@dataclass(frozen=True)
class Modality:
    """One vector of a post: its name in VECTOR_PREFIXES, what kind of input it has, and the input."""

    name: str
    kind: str  # text, content, image or images
    source: Column

    @property
    def column(self) -> str:
        return f"{self.name}_vec"


def standard_modalities(columns: Sequence[str], switches: Mapping[str, bool] | None = None) -> list[Modality]:
    """Modalities whose inputs exist and that are not switched off."""
    inputs = {
        "cover_image": ("image", "cover_image", lambda c: F.col(c)),
        "inner_image": ("images", "inner_images", lambda c: F.col(c)),
        "title": ("text", "title", lambda c: F.col(c)),
        "content": ("content", "content", lambda c: F.col(c)),
        "tag": ("text", "tag_info", lambda c: tag_names(F.col(c))),
        "cover_ocr": ("text", "cover_image_ocr_text", lambda c: F.col(c)),
        "inner_ocr": ("text", "inner_images_ocr_text", lambda c: F.col(c)),
    }
    on = switches or {}
    return [
        Modality(name, kind, make(column))
        for name, (kind, column, make) in inputs.items() if column in columns and on.get(name, True)
    ]


def _vector(m: Modality, text: enc.EncoderSpec | enc.Hashing, image: enc.EncoderSpec | enc.Hashing, how: str, kept: Column | None) -> Column:
    if m.kind == "text":
        return enc.encode_text(m.source, text, kept)
    if m.kind == "content":
        return enc.encode_content(m.source, text, kept)
    if m.kind == "image":
        return enc.encode_image(m.source, image, kept)
    if m.kind == "images":
        return enc.encode_images(m.source, image, how, kept)
    raise ValueError(f"unknown kind {m.kind}")


def feature_stage(
    df: DataFrame, modalities: Sequence[Modality], text: enc.EncoderSpec | enc.Hashing, image: enc.EncoderSpec | enc.Hashing | None = None,
    min_imp: int = 5000, keep_filtered: bool = True, pooling: str = "mean",
) -> DataFrame:
    """V9: adds `{name}_vec` per modality and num_images.

    The impression filter stands before the encoder. With keep_filtered the rows it drops stay with zero
    vectors, empty texts and zero counts; their inputs reach Python as NULL and are not encoded.
    """
    if not keep_filtered:
        df, kept = min_impressions(df, min_imp), None
    else:
        kept = F.coalesce(F.col("imp_num") >= min_imp, F.lit(False)) if min_imp > 0 else None
    new = {m.column: _vector(m, text, image or text, pooling, kept) for m in modalities}
    for m in modalities:
        if m.kind == "images":
            count = image_count(m.source)
            new["num_images"] = count if kept is None else F.when(kept, count).otherwise(0)
    return df.withColumns(new)


def incremental_stage(
    df: DataFrame, modalities: Sequence[Modality], text: enc.EncoderSpec | enc.Hashing, image: enc.EncoderSpec | enc.Hashing | None = None,
    min_imp: int = 0, renames: Mapping[str, str] = LEGACY_PREFIXES,
) -> DataFrame:
    """Filters, renames old vectors, and computes only the modalities whose vectors are not there."""
    renamed = rename_vectors(df, renames)
    have = {
        m.name for m in modalities
        if m.column in renamed.columns or any(c.startswith(VECTOR_PREFIXES[m.name]) for c in renamed.columns)
    }
    todo = [m for m in modalities if m.name not in have]
    return feature_stage(renamed, todo, text, image, min_imp, keep_filtered=False)


def widen(df: DataFrame, dims: Mapping[str, int]) -> DataFrame:
    """V3 for export: every `{name}_vec` becomes its numbered columns, in one projection."""
    vectors = [n for n in dims if f"{n}_vec" in df.columns]
    rest = [c for c in df.columns if c not in {f"{n}_vec" for n in vectors}]
    cells = [c for n in vectors for c in expand(f"{n}_vec", VECTOR_PREFIXES[n], dims[n])]
    return df.select(*rest, *cells)


def narrow(df: DataFrame) -> DataFrame:
    """V4: numbered columns become one array per modality."""
    groups = {n: [c for c in df.columns if c.startswith(p)] for n, p in VECTOR_PREFIXES.items()}
    gone = {c for cs in groups.values() for c in cs}
    rest = [c for c in df.columns if c not in gone]
    return df.select(*rest, *[pack(cs).alias(f"{n}_vec") for n, cs in groups.items() if cs])
