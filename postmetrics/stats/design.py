"""Design matrices as DataFrame columns (treatment coding, statsmodels-style names).

Terms are given as a Python list (no formula parser):

* ``("cat", col)``           categorical; first sorted level is the base, others -> ``C(col)[T.level]``
* ``("bool", col)``          boolean -> ``col[T.True]``
* ``("num", col)``           numeric passthrough -> ``col``
* ``("inter", a, b)``        product of two terms' columns -> ``a_name:b_name``

Levels are found with one ``distinct`` per categorical under a size guard (the
design width must stay small: the Gram matrix is p x p on the driver; ``models.fit_ols``
takes one factor of any width out of the matrix).

Rows travel as factor codes (``narrow_frame``: one column per base column, however many
levels it has) and become design rows (``expand``) only inside the arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 1000


@dataclass
class Design:
    names: list[str]
    exprs: list[Column] = field(repr=False)
    terms: tuple = ()
    levels: dict = field(default_factory=dict, repr=False)
    intercept: bool = True

    @property
    def p(self) -> int:
        return len(self.names)

    def base_columns(self) -> dict[str, str]:
        """Every column that a term reads, with its kind (cat, bool, num)."""
        out: dict[str, str] = {}

        def walk(term):
            if term[0] == "inter":
                walk(term[1]), walk(term[2])
            else:
                out.setdefault(term[1], term[0])
        for t in self.terms:
            walk(t)
        return out

    def recipe(self) -> "Design":
        """What ``expand`` needs, without Columns: it can travel to tasks."""
        return Design(self.names, [], self.terms, self.levels, self.intercept)

    @property
    def discrete(self) -> bool:
        """True if the rows of X repeat: no numeric column."""
        return "num" not in self.base_columns().values()


class TooManyLevels(ValueError):
    """A categorical is too wide for the matrix on the driver."""

    def __init__(self, column: str, most: int):
        super().__init__(f"categorical {column}: more than {most} levels")
        self.column = column


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise TooManyLevels(col, max_levels)
    return sorted(r[0] for r in rows)


def _term_columns(df, term, lv_cache, max_levels):
    kind = term[0]
    if kind == "cat":
        col = term[1]
        if col not in lv_cache:
            lv_cache[col] = levels(df, col, max_levels)
        lv = lv_cache[col]
        return [(f"C({col})[T.{v}]", (F.col(col) == F.lit(v)).cast("double")) for v in lv[1:]]
    if kind == "bool":
        col = term[1]
        return [(f"{col}[T.True]", F.col(col).cast("double"))]
    if kind == "num":
        col = term[1]
        return [(col, F.col(col).cast("double"))]
    if kind == "inter":
        left = _term_columns(df, term[1], lv_cache, max_levels)
        right = _term_columns(df, term[2], lv_cache, max_levels)
        return [(f"{ln}:{rn}", lc * rc) for ln, lc in left for rn, rc in right]
    raise ValueError(f"unknown term kind {kind!r}")


def build_design(df: DataFrame, terms: Sequence[tuple], intercept: bool = True, max_levels: int = MAX_LEVELS) -> Design:
    """Columns of the terms; a categorical with more than ``max_levels`` levels raises ``TooManyLevels``,
    since the driver solves systems as wide as the design."""
    names, exprs, cache = [], [], {}
    if intercept:
        names.append("Intercept")
        exprs.append(F.lit(1.0))
    for t in terms:
        for n, e in _term_columns(df, t, cache, max_levels):
            names.append(n)
            exprs.append(e)
    return Design(names, exprs, tuple(terms), cache, intercept)


def narrow_frame(df: DataFrame, design: Design, y: Sequence[Column | str] = ()) -> DataFrame:
    """Complete rows with one column per base column (b0.., categoricals as level codes) and y0.. ."""
    cols, need = [], []
    for i, (name, kind) in enumerate(design.base_columns().items()):
        if kind == "cat":
            known = F.array(*[F.lit(v) for v in design.levels[name]])
            code = F.array_position(known, F.col(name)) - 1 if design.levels[name] else F.lit(None)
            cols.append(F.when(code >= 0, code).cast("int").alias(f"b{i}"))
        else:
            cols.append(F.col(name).cast("double").alias(f"b{i}"))
        need.append(f"b{i}")
    for j, c in enumerate(y):
        cols.append((F.col(c) if isinstance(c, str) else c).cast("double").alias(f"y{j}"))
        need.append(f"y{j}")
    return df.select(*cols).dropna(subset=need)


def expand(design: Design, data: Mapping[str, np.ndarray], n: int) -> np.ndarray:
    """The n x p design rows of ``data``: values per base column, categoricals as level codes."""
    def term(t) -> np.ndarray:
        if t[0] == "inter":
            a, b = term(t[1]), term(t[2])
            return (a[:, :, None] * b[:, None, :]).reshape(n, -1)
        v = np.asarray(data[t[1]])
        if t[0] != "cat":
            return v.astype(np.float64)[:, None]
        out = np.zeros((n, max(len(design.levels[t[1]]), 1)))
        out[np.arange(n), v.astype(np.int64)] = 1.0
        return out[:, 1:]
    parts = [np.ones((n, 1))] if design.intercept else []
    return np.concatenate(parts + [term(t) for t in design.terms], axis=1) if parts or design.terms else np.zeros((n, 0))


def design_frame(df: DataFrame, design: Design, y: Sequence[Column | str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """Rows with x0..x{p-1} doubles and the response columns y0.. (complete cases only)."""
    ys = [F.col(c) if isinstance(c, str) else c for c in y]
    cols = [e.alias(f"x{i}") for i, e in enumerate(design.exprs)]
    cols += [c.cast("double").alias(f"y{j}") for j, c in enumerate(ys)]
    out = df.select(*cols, *[F.col(c) for c in extra])
    return out.dropna(subset=[f"x{i}" for i in range(design.p)] + [f"y{j}" for j in range(len(ys))])
