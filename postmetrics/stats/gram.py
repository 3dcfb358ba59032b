"""Distributed sums for least squares: XᵀWX, XᵀWy, Σ w e² x xᵀ, residual moments.

Three sources of the same sums:

* ``CellSums`` - a design without numeric columns has few distinct rows of X.  One native
  aggregation per cell (a combination of the discrete columns) gives n, mean and central moments of
  y; every later sum, Newton step or residual moment is arithmetic over the cells.
* ``RowSums`` - rows travel as factor codes; each task expands its Arrow batches into design rows, in
  slices of bounded size, and sends p x p partials as one array.  Arrays are added up in the JVM in at
  most ``SLOTS`` groups, and those on the driver.
* ``EntitySums`` - rows centred by entity: central moments of every entity, kept as a table, give the
  sums within and between entities.

Either way only p x p numbers, or one row per cell (checked), reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmetrics.session import materialize
from postmetrics.stats.design import Design, expand, narrow_frame

#: Groups of the first level of the sum; a group holds one array for each of its partitions.
SLOTS = 256
#: Numbers of a slice of design rows inside a task; cells (and their design rows) the driver may hold.
SLICE_NUMBERS = 2_000_000
MAX_CELLS, MAX_CELL_NUMBERS = 100_000, 20_000_000
_PACKED = "slot int, v array<double>"


def _emit(*blocks: np.ndarray) -> pa.RecordBatch:
    flat = np.concatenate([np.asarray(m, dtype="float64").ravel() for m in blocks])
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()),
                                       pa.array([flat], pa.list_(pa.float64()))], names=["slot", "v"])


def _collect(packed: DataFrame, *shapes: tuple) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    zero = F.array_repeat(F.lit(0.0), int(ends[-1]))
    added = F.aggregate(F.collect_list("v"), zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    rows = packed.groupBy("slot").agg(added.alias("v")).toArrow().column("v")  # SLOTS rows at most
    total = sum((r.values.to_numpy() for r in rows), np.zeros(ends[-1]))
    return [part.reshape(shape) for part, shape in zip(np.split(total, ends[:-1]), shapes)]


def _slices(batches, x_of, p: int, ys: list[str]):
    """(X, Y) of consecutive slices of the batches, of at most about SLICE_NUMBERS numbers of X."""
    step = max(1, SLICE_NUMBERS // max(p, 1))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            y = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ys], axis=1) if ys else np.zeros((part.num_rows, 0))
            yield x_of(part), y


def _dense(p: int):
    def x_of(b):
        return np.stack([b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(p)], axis=1) if p else np.zeros((b.num_rows, 0))
    return x_of


def gram(frame: DataFrame, p: int, q: int, x_of=None) -> dict[str, np.ndarray]:
    """XᵀX (p x p), XᵀY (p x q), YᵀY (q x q) and n; ``x_of`` makes design rows of a batch (else x0..)."""
    make, ys = x_of or _dense(p), [f"y{j}" for j in range(q)]

    def part(batches):
        xtx, xty, yty, n = np.zeros((p, p)), np.zeros((p, q)), np.zeros((q, q)), 0.0
        for x, y in _slices(batches, make, p, ys):
            xtx += x.T @ x
            xty += x.T @ y
            yty += y.T @ y
            n += len(x)
        yield _emit(xtx, xty, yty, np.array([n]))

    xtx, xty, yty, n = _collect(frame.mapInArrow(part, _PACKED), (p, p), (p, q), (q, q), (1,))
    return {"xtx": xtx, "xty": xty, "yty": yty, "n": float(n[0])}


def _deviance_terms(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2.0 * (np.where(y > 0, y * np.log(y / mu), 0.0) - (y - mu))


class RowSums:
    """Sums over the rows of a ``narrow_frame``, for response ``j``; ``keep`` are the columns of X used,
    ``zero`` those whose rows are left out."""

    def __init__(self, frame: DataFrame, design: Design, j: int = 0):
        self.frame, self.design, self.j = frame, design, j
        self.keep, self.zero = list(range(design.p)), []

    def without(self, separated: list[int]) -> "RowSums":
        """The sums over the rows where all the given columns are 0, and over the other columns."""
        out = RowSums(self.frame, self.design, self.j)
        out.zero = separated
        out.keep = [j for j in self.keep if j not in separated]
        return out

    def _reader(self):
        """A function of Arrow batches that gives (X, y) of consecutive slices; it holds no DataFrame."""
        recipe, names, width = self.design.recipe(), list(self.design.base_columns()), self.design.p
        keep, zero, y_name = self.keep, self.zero, f"y{self.j}"

        def x_of(b):
            data = {c: b.column(f"b{i}").to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            return expand(recipe, data, b.num_rows)

        def read(batches):
            for x, y in _slices(batches, x_of, width, [y_name]):
                if zero:
                    rows = (x[:, zero] == 0).all(1)
                    x, y = x[rows], y[rows]
                yield (x if len(keep) == width else x[:, keep]), y[:, 0]
        return read

    def gram(self) -> dict[str, np.ndarray]:
        p, read = len(self.keep), self._reader()

        def part(batches):
            xtx, xty, sums = np.zeros((p, p)), np.zeros(p), np.zeros(2)
            for x, y in read(batches):
                xtx += x.T @ x
                xty += x.T @ y
                sums += (len(y), y.sum())
            yield _emit(xtx, xty, sums)
        xtx, xty, sums = _collect(self.frame.mapInArrow(part, _PACKED), (p, p), (p,), (2,))
        return {"xtx": xtx, "xty": xty, "n": float(sums[0]), "sum_y": float(sums[1])}

    def newton(self, beta: np.ndarray) -> dict[str, np.ndarray]:
        """XᵀWX and XᵀWz of a Poisson step (W = mu, z = xβ + (y - mu)/mu), and the deviance at β."""
        p, read = len(self.keep), self._reader()

        def part(batches):
            xtx, xtz, dev = np.zeros((p, p)), np.zeros(p), np.zeros(1)
            for x, y in read(batches):
                eta = x @ beta
                mu = np.exp(eta)
                xtx += x.T @ (mu[:, None] * x)
                xtz += x.T @ (mu * eta + y - mu)
                dev += _deviance_terms(y, mu).sum()
            yield _emit(xtx, xtz, dev)
        xtx, xtz, dev = _collect(self.frame.mapInArrow(part, _PACKED), (p, p), (p,), (1,))
        return {"xtx": xtx, "xtz": xtz, "deviance": float(dev[0])}

    def residuals(self, beta: np.ndarray, log_link: bool = False, centre: float = 0.0) -> dict:
        """Σ e² x xᵀ (meat), Σe … Σe⁴, Σ(y - centre)², and for the log link deviance, Pearson, log-likelihood."""
        p, read = len(self.keep), self._reader()

        def part(batches):
            meat, mom = np.zeros((p, p)), np.zeros(len(_MOMENTS))
            for x, y in read(batches):
                eta = x @ beta
                mu = np.exp(eta) if log_link else eta
                e = y - mu
                meat += x.T @ ((e * e)[:, None] * x)
                mom[:6] += (len(y), e.sum(), (e ** 2).sum(), (e ** 3).sum(), (e ** 4).sum(), ((y - centre) ** 2).sum())
                if log_link:
                    lg = _lgamma1p(y)
                    mom[6:] += (_deviance_terms(y, mu).sum(), (e * e / mu).sum(), (y * eta - mu - lg).sum(), lg.sum())
            yield _emit(meat, mom)
        meat, mom = _collect(self.frame.mapInArrow(part, _PACKED), (p, p), (len(_MOMENTS),))
        return {"meat": meat, **dict(zip(_MOMENTS, mom.tolist()))}


_MOMENTS = ("n", "sum_e", "sum_e2", "sum_e3", "sum_e4", "sum_yc2", "deviance", "pearson", "llf", "sum_lgamma")


def cells(df: DataFrame, design: Design, ys: list) -> DataFrame:
    """One row per combination of the discrete columns: for every response n, mean and central moments,
    Σ y ln y and Σ ln y! (complete rows only)."""
    names = list(design.base_columns())
    rows = df.select(*[F.col(c).alias(f"b{i}") for i, c in enumerate(names)],
                     *[(F.col(y) if isinstance(y, str) else y).cast("double").alias(f"_y{j}") for j, y in enumerate(ys)]).dropna()
    aggs = []
    for j in range(len(ys)):
        v = F.col(f"_y{j}")
        aggs += [F.count(v).alias(f"n{j}"), F.avg(v).alias(f"mean{j}"), F.var_pop(v).alias(f"var{j}"), F.skewness(v).alias(f"skew{j}"),
                 F.kurtosis(v).alias(f"kurt{j}"), F.sum(F.when(v > 0, v * F.ln(v)).otherwise(0.0)).alias(f"ylny{j}"),
                 F.sum(log_factorial(v)).alias(f"lgamma{j}")]
    return rows.groupBy(*[f"b{i}" for i in range(len(names))]).agg(*aggs)


class CellSums:
    """The sums of ``RowSums`` from the cells of a discrete design, held by the driver (response ``j``)."""

    def __init__(self, design: Design, table: pa.Table, j: int = 0):
        names = list(design.base_columns())
        n = table.num_rows
        data = {}
        for i, c in enumerate(names):
            values = table.column(f"b{i}").to_pylist()
            code = {v: k for k, v in enumerate(design.levels[c])} if c in design.levels else None
            data[c] = np.array([code.get(v, -1) for v in values] if code is not None else values, dtype=np.float64)
        known = np.ones(n, bool)
        for v in data.values():
            known &= v >= 0
        data = {c: v[known] for c, v in data.items()}
        self.x = expand(design, data, int(known.sum()))

        def column(name):
            return np.nan_to_num(table.column(f"{name}{j}").to_numpy().astype(np.float64))[known]
        self.n, self.mean, self.ylny, self.lgamma = (column(c) for c in ("n", "mean", "ylny", "lgamma"))
        self.m2 = column("var") * self.n
        self.m3 = column("skew") * self.m2 ** 1.5 / np.sqrt(np.maximum(self.n, 1))
        self.m4 = (column("kurt") + 3) * self.m2 ** 2 / np.maximum(self.n, 1)

    def without(self, separated: list[int]) -> "CellSums":
        out = object.__new__(CellSums)
        rows = (self.x[:, separated] == 0).all(1)
        for k, v in vars(self).items():
            setattr(out, k, v[rows])
        out.x = np.delete(out.x, separated, axis=1)
        return out

    def gram(self) -> dict[str, np.ndarray]:
        w = self.n[:, None]
        return {"xtx": self.x.T @ (w * self.x), "xty": self.x.T @ (self.n * self.mean), "n": float(self.n.sum()),
                "sum_y": float((self.n * self.mean).sum())}

    def newton(self, beta: np.ndarray) -> dict[str, np.ndarray]:
        eta = self.x @ beta
        mu = np.exp(eta)
        w = self.n * mu
        return {"xtx": self.x.T @ (w[:, None] * self.x), "xtz": self.x.T @ (w * eta + self.n * (self.mean - mu)),
                "deviance": float(self._deviance(eta, mu))}

    def _deviance(self, eta, mu):
        return 2.0 * (self.ylny - self.n * self.mean * eta - self.n * (self.mean - mu)).sum()

    def residuals(self, beta: np.ndarray, log_link: bool = False, centre: float = 0.0) -> dict:
        eta = self.x @ beta
        mu = np.exp(eta) if log_link else eta
        n, d = self.n, self.mean - mu  # a residual is (y - mean of its cell) + d
        e2 = self.m2 + n * d ** 2
        out = {"meat": self.x.T @ (e2[:, None] * self.x), "n": n.sum(), "sum_e": (n * d).sum(), "sum_e2": e2.sum(),
               "sum_e3": (self.m3 + 3 * d * self.m2 + n * d ** 3).sum(),
               "sum_e4": (self.m4 + 4 * d * self.m3 + 6 * d ** 2 * self.m2 + n * d ** 4).sum(),
               "sum_yc2": (self.m2 + n * (self.mean - centre) ** 2).sum()}
        if log_link:
            out.update(deviance=self._deviance(eta, mu), pearson=(e2 / mu).sum(),
                       llf=(n * (self.mean * eta - mu) - self.lgamma).sum(), sum_lgamma=self.lgamma.sum())
        return {k: v if k == "meat" else float(v) for k, v in out.items()}


class EntitySums:
    """Sums over the complete rows of the entities with at least ``min_size`` rows, for y on ``xs`` and a constant.

    One aggregation gives n, means and covariances of every entity, another (``residuals``) the central
    moments of its residuals; both stay tables, of which totals reach the driver.  With them the sums of
    rows centred by entity (``within``) and of the rows as they are differ only in the entities' means.
    """

    def __init__(self, df: DataFrame, y: str, xs, entity: str, min_size: int, time: str | None = None):
        values = [F.col(c).cast("double") for c in (y, *xs)]
        complete = F.lit(True)
        for v in values:
            complete = complete & v.isNotNull() & ~F.isnan(v)
        known = F.col(entity).isNotNull()
        if df.schema[entity].dataType.typeName() in ("float", "double"):
            known = known & ~F.isnan(entity)
        # incomplete rows count for min_size, and for nothing else
        self.rows = df.where(known).select(F.col(entity).alias("e"), *([F.col(time).alias("t")] if time else []), complete.alias("complete"),
                                           *[F.when(complete, v).alias(f"v{i}") for i, v in enumerate(values)])
        self.q, self.min_size = len(values), min_size
        pairs = [(i, j) for i in range(self.q) for j in range(i, self.q)]
        cov = [(F.var_pop(f"v{i}") if i == j else F.covar_pop(f"v{i}", f"v{j}")).alias(f"c{i}_{j}") for i, j in pairs]
        self.all = materialize(self.rows.groupBy("e").agg(F.count(F.lit(1)).alias("size"), F.count("v0").alias("n"),
                                                          *[F.avg(f"v{i}").alias(f"m{i}") for i in range(self.q)], *cov), "entities")
        self.table = self.all.where((F.col("size") >= min_size) & (F.col("n") > 0))
        n = F.col("n")
        total = self.table.agg(
            F.count("*").alias("entities"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg("n").alias("mean"), F.sum("n").alias("n"),
            (F.var_pop("m0") * F.count("*")).alias("y2"), *[(F.sum(n * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in range(self.q)],
            *[F.sum(n * F.col(f"c{i}_{j}")).alias(f"c{i}_{j}") for i, j in pairs]).first()
        self.entities, self.obs_per_entity, self.n = total["entities"], (total["lo"], total["hi"], total["mean"]), float(total["n"] or 0)
        self.means = np.array([total[f"m{i}"] or 0.0 for i in range(self.q)])
        off = [F.col(f"m{i}") - F.lit(float(g)) for i, g in enumerate(self.means)]
        apart = self.table.agg(*[F.sum(n * off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        self.inside, self.between = np.zeros((self.q, self.q)), np.zeros((self.q, self.q))
        for i, j in pairs:
            self.inside[i, j] = self.inside[j, i] = total[f"c{i}_{j}"] or 0.0
            self.between[i, j] = self.between[j, i] = apart[f"c{i}_{j}"] or 0.0
        #: Σ(y - mean)² over the rows, and over the means of the entities.
        self.total_y2, self.means_y2 = float(self.inside[0, 0] + self.between[0, 0]), float(total["y2"] or 0.0)

    def gram(self, within: bool) -> dict[str, np.ndarray]:
        """XᵀX and Xᵀy with the constant first; ``within``: of rows centred by entity, plus the means of all."""
        centred = self.inside if within else self.inside + self.between
        one = np.concatenate([[1.0], self.means[1:]])
        xtx = self.n * np.outer(one, one)
        xtx[1:, 1:] += centred[1:, 1:]
        xty = self.n * self.means[0] * one
        xty[1:] += centred[1:, 0]
        return {"xtx": xtx, "xty": xty, "n": self.n, "sum_y": float(self.n * self.means[0])}

    def residuals(self, *betas: np.ndarray) -> list[dict]:
        """For every β, in one pass: Σe … Σe⁴ and Σ(y - mean)² of the rows centred by entity, Σe² of the rows as
        they are (``rows_e2``) and of the means of the entities (``means_e2``)."""
        names = range(len(betas))
        errors = [sum((F.lit(-float(b)) * F.col(f"v{i}") for i, b in enumerate(beta[1:], 1)), F.col("v0") - F.lit(float(beta[0]))) for beta in betas]
        rows = self.rows.select("e", "v0", *[e.alias(f"e{k}") for k, e in zip(names, errors)])
        aggs = [F.count(F.lit(1)).alias("size"), F.count("v0").cast("double").alias("n")]
        for k in names:
            aggs += [F.avg(f"e{k}").alias(f"mean{k}"), F.var_pop(f"e{k}").alias(f"var{k}"),
                     F.skewness(f"e{k}").alias(f"skew{k}"), F.kurtosis(f"e{k}").alias(f"kurt{k}")]
        by_entity = rows.groupBy("e").agg(*aggs).where((F.col("size") >= self.min_size) & (F.col("n") > 0))
        n, totals = F.col("n"), []
        for k in names:
            mean, m2 = F.col(f"mean{k}"), F.col(f"var{k}") * n
            # without spread there is no skewness
            m3 = F.when(m2 > 0, F.col(f"skew{k}") * F.pow(m2, F.lit(1.5)) / F.sqrt(n)).otherwise(0.0)
            m4 = F.when(m2 > 0, (F.col(f"kurt{k}") + 3) * m2 * m2 / n).otherwise(0.0)
            totals += [F.sum(c).alias(f"{name}{k}") for name, c in
                       (("m2_", m2), ("m3_", m3), ("m4_", m4), ("off", n * mean * mean), ("means", mean * mean))]
        row = by_entity.agg(*totals).first()
        out = []
        for k, beta in zip(names, betas):
            m2, m3, m4 = (row[f"{m}{k}"] or 0.0 for m in ("m2_", "m3_", "m4_"))
            d = float(self.means[0] - beta[0] - self.means[1:] @ beta[1:])  # a residual is (e - mean of its entity) + d
            out.append({"n": self.n, "sum_e": self.n * d, "sum_e2": m2 + self.n * d ** 2, "sum_e3": m3 + 3 * d * m2 + self.n * d ** 3,
                        "sum_e4": m4 + 4 * d * m3 + 6 * d ** 2 * m2 + self.n * d ** 4, "sum_yc2": float(self.inside[0, 0]),
                        "rows_e2": m2 + (row[f"off{k}"] or 0.0), "means_e2": row[f"means{k}"] or 0.0})
        return out

    def periods(self) -> tuple:
        """Number of periods; least, most and mean rows in one."""
        rows = self.rows.where("complete").select("e", "t")
        gone = self.all.where(F.col("size") < self.min_size).select("e")
        if gone.limit(1).count():  # each has few rows, usually there are none: they are looked up, the others not moved
            rows = rows.join(materialize(gone, "small_entities"), "e", "left_anti")
        return tuple(rows.groupBy("t").count().agg(F.count("*"), F.min("count"), F.max("count"), F.avg("count")).first())


def sums(df: DataFrame, design: Design, *ys: Column | str) -> list:
    """For every response ``CellSums`` where the design is discrete and its cells are few (checked; one
    aggregation for all of them), else ``RowSums`` over a narrow table that is written once."""
    if design.discrete:
        most = int(min(MAX_CELLS, MAX_CELL_NUMBERS // max(design.p, 1)))
        table = cells(df, design, list(ys)).limit(most + 1).toArrow()
        if table.num_rows <= most:
            return [CellSums(design, table, j) for j in range(len(ys))]
    # passes of a fit or an iteration read this narrow table, not the source
    frame = materialize(narrow_frame(df, design, list(ys)), "design")
    return [RowSums(frame, design, j) for j in range(len(ys))]


def _lgamma1p(y: np.ndarray) -> np.ndarray:
    """log Gamma(y + 1) by Stirling's series after a shift by ten (vectorised, any y >= 0)."""
    x = np.asarray(y, dtype="float64") + 1.0
    shift = np.zeros_like(x)
    for k in range(10):
        shift += np.log(x + k)
    x = x + 10.0
    series = 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5) - 1 / (1680 * x ** 7)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def log_factorial(y: Column) -> Column:
    """``_lgamma1p`` as a Column."""
    shift = F.ln(y + 1)
    for k in range(1, 10):
        shift = shift + F.ln(y + (1 + k))
    x = y + 11
    series = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return (x - 0.5) * F.ln(x) - x + 0.5 * float(np.log(2 * np.pi)) + series - shift
