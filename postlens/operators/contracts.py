"""Column roles, feature presets and naming, decided from the schema alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.literals import literal_rows
from postlens.settings import (
    DEPRECATED_PREFIXES, DETECT_DENSE, DETECT_SPARSE, FEATURE_PRESETS, PRESET_NOTES,
    ROLE_DENSE, ROLE_EXCLUDE, ROLE_RENAMES, ROLE_SPARSE, ROLE_VECTOR, VECTOR_PREFIXES,
)

# Column roles of the single-task form: other lists than the multi-task one.
SINGLE_EXCLUDE = ["ctr", "click", "imp_num", "impression", "click_num", "note_id", "user_id"]
SINGLE_VECTOR = ["image_feat_", "text_feat_"]
SINGLE_SPARSE = ["nickname", "title_clean", "type", "taxonomy", "intention"]
SINGLE_DENSE = ["title_length"]
IMAGE_PREFIXES = ("image_feat_", VECTOR_PREFIXES["cover_image"])
TEXT_PREFIXES = ("text_feat_", VECTOR_PREFIXES["title"])


@dataclass(frozen=True)
class Roles:
    sparse: list[str] = field(default_factory=list)
    dense: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)
    renames: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """The renames the roles were named after, as one projection."""
        return df.withColumnsRenamed(self.renames) if self.renames else df


def _holds(name: str, parts: Sequence[str]) -> bool:
    return any(p in name for p in parts)


def multi_task_roles(columns: Sequence[str]) -> Roles:
    """Excluded and matched by substring, dense by exact name."""
    roles = Roles()
    for c in columns:
        if _holds(c, ROLE_EXCLUDE):
            continue
        if _holds(c, ROLE_VECTOR):
            roles.vectors.append(c)
        elif _holds(c, ROLE_SPARSE):
            roles.sparse.append(c)
        elif c in ROLE_RENAMES:
            roles.renames[c] = ROLE_RENAMES[c]
            roles.sparse.append(ROLE_RENAMES[c])
        elif c in ROLE_DENSE:
            roles.dense.append(c)
    return roles


def single_task_roles(columns: Sequence[str]) -> Roles:
    """P10: default classification of the single-task form; `type` becomes `item_type`."""
    roles = Roles()
    for c in columns:
        if _holds(c, SINGLE_EXCLUDE):
            continue
        if _holds(c, SINGLE_VECTOR):
            roles.vectors.append(c)
        elif c == "type":
            roles.renames[c] = "item_type"
            roles.sparse.append("item_type")
        elif _holds(c, SINGLE_SPARSE):
            roles.sparse.append(c)
        elif c in SINGLE_DENSE:
            roles.dense.append(c)
    return roles


def preset(name: str = "default") -> dict:
    """P11; an unknown name means the default."""
    return dict(FEATURE_PRESETS.get(name, FEATURE_PRESETS["default"]))


def custom_preset(sparse: Sequence[str] = (), dense: Sequence[str] = (), image: bool = False, text: bool = False) -> dict:
    return {"sparse": list(sparse), "dense": list(dense), "clip_image": image, "clip_text": text}


def preset_names() -> list[str]:
    return list(PRESET_NOTES)


def describe_preset(name: str) -> str:
    return PRESET_NOTES.get(name, PRESET_NOTES["default"])


def detect_preset(columns: Sequence[str]) -> dict:
    """What the columns allow."""
    return {
        "sparse": [c for c in DETECT_SPARSE if c in columns],
        "dense": [c for c in DETECT_DENSE if c in columns],
        "clip_image": any(c.startswith(IMAGE_PREFIXES) for c in columns),
        "clip_text": any(c.startswith(TEXT_PREFIXES) for c in columns),
    }


def merge_presets(base: Mapping, override: Mapping) -> dict:
    """Lists are united in the order met, anything else is overridden."""
    merged = dict(base)
    for key, value in override.items():
        if key in ("sparse", "dense"):
            merged[key] = list(dict.fromkeys([*merged.get(key, []), *value]))
        else:
            merged[key] = value
    return merged


def preset_roles(columns: Sequence[str], config: Mapping) -> Roles:
    """The features of a preset that the columns have."""
    prefixes = (IMAGE_PREFIXES if config.get("clip_image") else ()) + (TEXT_PREFIXES if config.get("clip_text") else ())
    return Roles(
        [c for c in config.get("sparse", []) if c in columns],
        [c for c in config.get("dense", []) if c in columns],
        [c for c in columns if prefixes and c.startswith(prefixes)],
    )


def contract_report(df: DataFrame, config: Mapping) -> DataFrame:
    """P12 from the schema: kind, name, status (ok, missing, few, invalid, valid) and, per kind, how many exist."""
    columns, rows = df.columns, []
    for kind in ("sparse", "dense"):
        for c in config.get(kind, []):
            rows.append((kind, c, "ok" if c in columns else "missing", int(c in columns)))
    for kind, prefixes in (("clip_image", IMAGE_PREFIXES), ("clip_text", TEXT_PREFIXES)):
        if config.get(kind):
            n = sum(c.startswith(prefixes) for c in columns)
            rows.append((kind, kind, "ok" if n else "missing", n))
    total = sum(r[3] for r in rows)
    if total < 5:
        rows.append(("table", "features", "few", total))
    bad = total == 0 or any(r[2] == "missing" for r in rows)
    rows.append(("table", "contract", "invalid" if bad else "valid", total))
    return literal_rows(df.sparkSession, rows, "kind string, name string, status string, available int")


def vector_names(kind: str, dims: int, prefixes: Mapping[str, str] = VECTOR_PREFIXES) -> list[str]:
    """`{prefix}{i}`; an unknown kind is an error."""
    if kind not in prefixes:
        raise ValueError(f"unknown vector kind {kind}; known are {list(prefixes)}")
    return [f"{prefixes[kind]}{i}" for i in range(dims)]


def vector_kind(name: str, prefixes: Mapping[str, str] = VECTOR_PREFIXES) -> str | None:
    return next((k for k, p in prefixes.items() if name.startswith(p)), None)


def check_names(names: Sequence[str], deprecated: Sequence[str] = DEPRECATED_PREFIXES) -> dict[str, list[str]]:
    """Names that start with a deprecated prefix, and unknown names that merely hold one."""
    old = [n for n in names if n.startswith(tuple(deprecated))]
    odd = [n for n in names if n not in old and _holds(n, deprecated) and vector_kind(n) is None]
    return {"deprecated": old, "unknown": odd}


def fill_absent(df: DataFrame, sparse: Sequence[str], dense: Sequence[str], vectors: Mapping[str, int]) -> DataFrame:
    """The columns of a saved definition in its order; absent categories 0, numbers 0.0, vectors zeros."""
    has = set(df.columns)
    keep = [F.col(c) for c in df.columns if c not in {*sparse, *dense, *vectors}]
    wanted = [F.col(c) if c in has else F.lit(0).alias(c) for c in sparse]
    wanted += [F.col(c) if c in has else F.lit(0.0).alias(c) for c in dense]
    wanted += [F.col(c) if c in has else F.array_repeat(F.lit(0.0), d).alias(c) for c, d in vectors.items()]
    return df.select(*keep, *wanted)


def missing_features(columns: Sequence[str], wanted: Sequence[str]) -> Column:
    """names of the wanted features that a row lacks, absent columns included."""
    cells = [F.when(F.col(c).isNull(), F.lit(c)) if c in columns else F.lit(c) for c in wanted]
    return F.array_compact(F.array(*cells))


def explain_features(df: DataFrame, sparse: Sequence[str], dense: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    """adds totals by kind and the list of missing features."""
    wanted = [*sparse, *dense, *vectors]
    return df.withColumns({
        "total_features": F.lit(len(wanted)),
        "sparse_features": F.lit(len(sparse)),
        "dense_features": F.lit(len(dense)),
        "vector_features": F.lit(len(vectors)),
        "missing_features": missing_features(df.columns, wanted),
    })
