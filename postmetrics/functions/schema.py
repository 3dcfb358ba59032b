"""Schema helpers: alias resolution and struct flattening (plan-time, on ``df.schema``)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(schema: T.StructType, path: Sequence[str]):
    cur = schema
    for part in path:
        if not isinstance(cur, T.StructType) or part not in cur.fieldNames():
            return None
        cur = cur[part].dataType
    return cur


def has_column(df: DataFrame, name: str) -> bool:
    """True for a top-level column (dots allowed in the name) or a nested struct path."""
    return name in df.columns or _field(df.schema, name.split(".")) is not None


def col_ref(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.col(f"`{name}`")
    return F.col(name)


def resolve(df: DataFrame, candidates: Sequence[str], contains: str | None = None,
            endswith: str | None = None, required: bool = False, what: str = "column") -> Column:
    """First present candidate; then generic fallbacks by substring / suffix; else NULL or error."""
    for c in candidates:
        if has_column(df, c):
            return col_ref(df, c)
    flat = flatten_names(df.schema)
    for c in flat:
        if (contains and contains in c) or (endswith and c.endswith(endswith)):
            return col_ref(df, c)
    if required:
        raise ValueError(f"No {what} column found (tried {list(candidates)})")
    return F.lit(None)


def flatten_names(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        name = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            out.extend(flatten_names(f.dataType, name + "."))
        else:
            out.append(name)
    return out


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """``json_normalize``: nested structs become dotted columns; arrays stay arrays."""
    cols = []
    for name in flatten_names(df.schema):
        parts = name.split(".")
        c = F.col(f"`{parts[0]}`")
        for p in parts[1:]:
            c = c.getField(p)
        cols.append(c.alias(sep.join(parts)))
    return df.select(*cols)
