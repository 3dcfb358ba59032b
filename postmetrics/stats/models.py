"""Regressions from distributed sums: OLS (HC1), Poisson GLM by IRLS (HC1), entity fixed effects.

Every pass over the rows is a Spark job (``stats.gram``); the driver only solves
p x p systems.  Results come back as small DataFrames (one row per term, or one
summary row), built with ``createDataFrame`` from at most p rows; the levels of a wide
factor are rows that Spark keeps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

from postmetrics.session import materialize
from postmetrics.stats import linalg as la
from postmetrics.stats.design import Design, TooManyLevels, build_design, design_frame
from postmetrics.stats.gram import EntitySums, sums


@dataclass
class Fit:
    names: list[str]
    params: np.ndarray
    cov: np.ndarray  # covariance of the estimates, or (for a wide factor) their variances only
    n: float
    rank: int
    summary: dict
    t_df: float | None = None  # Student reference with so many degrees of freedom; None: normal

    @property
    def bse(self) -> np.ndarray:
        d = np.diag(self.cov) if self.cov.ndim == 2 else self.cov
        return np.sqrt(np.where(d >= 0, d, np.nan))

    def table(self, spark: SparkSession, exp: bool = False) -> DataFrame:
        """term, coef, se, z, p, ci_lower, ci_upper (normal reference, or Student's for ``t_df``)."""
        rows = []
        reach = la.t_quantile(0.975, self.t_df) if self.t_df else la.Z975
        for name, b, s in zip(self.names, self.params, self.bse):
            z = b / s if s and s > 0 else float("nan")
            p = (la.t_sf2(z, self.t_df) if self.t_df else la.norm_sf2(z)) if math.isfinite(z) else float("nan")
            lo, hi = b - reach * s, b + reach * s
            if exp:
                b, lo, hi = _exp(b), _exp(lo), _exp(hi)
            rows.append((name, _f(b), _f(s), _f(z), _f(p), _f(lo), _f(hi)))
        schema = "term string, coef double, se double, z double, p double, ci_lower double, ci_upper double"
        return spark.createDataFrame(rows, schema)


@dataclass
class WideFit:
    """A fit whose factor has any number of levels: they stay a table (f, term, coef, var), the base left out;
    ``rest`` is the fit of the intercept and the other columns.  ``table`` takes none of the levels to the driver;
    ``names``, ``params`` and ``cov`` (variances) do, in the order of the levels."""
    rest: Fit
    levels: DataFrame
    n: float
    rank: int
    summary: dict

    @cached_property
    def _held(self):
        return self.levels.orderBy("f").select("term", "coef", "var").toArrow()

    @property
    def names(self) -> list[str]:
        return self.rest.names[:1] + self._held.column("term").to_pylist() + self.rest.names[1:]

    def _between(self, of_rest: np.ndarray, column: str) -> np.ndarray:
        return np.concatenate([of_rest[:1], self._held.column(column).to_numpy(), of_rest[1:]])

    @property
    def params(self) -> np.ndarray:
        return self._between(self.rest.params, "coef")

    @property
    def cov(self) -> np.ndarray:
        return self._between(self.rest.cov, "var")

    bse = Fit.bse

    def table(self, spark: SparkSession, exp: bool = False) -> DataFrame:
        """The columns of ``Fit.table``; its rows come in no order."""
        from pyspark.sql import functions as F

        @F.pandas_udf("double")
        def two_sided(z: pd.Series) -> pd.Series:
            return z.map(la.norm_sf2, na_action="ignore")

        def finite(c: Column) -> Column:
            return F.when(F.abs(c) < float("inf"), c)
        b, s = F.col("coef"), F.col("se")
        shown = F.exp if exp else (lambda c: c)
        rows = self.levels.withColumn("se", F.when(F.col("var") >= 0, F.sqrt("var"))).withColumn("z", finite(F.when(s > 0, b / s)))
        rows = rows.select("term", finite(shown(b)).alias("coef"), finite(s).alias("se"), "z", two_sided("z").alias("p"),
                           finite(shown(b - la.Z975 * s)).alias("ci_lower"), finite(shown(b + la.Z975 * s)).alias("ci_upper"))
        return self.rest.table(spark, exp).unionByName(rows)


def main_terms(table: DataFrame, pattern: str, by: str = "coef") -> DataFrame:
    """Rows of a coefficient table whose term matches ``pattern`` (a regular expression), by value."""
    from pyspark.sql import functions as F
    return table.where(F.col("term").rlike(pattern)).orderBy(F.desc(by), "term")


def durbin_watson(residuals: DataFrame, order: Sequence[str], name: str = "e") -> DataFrame:
    """Durbin-Watson statistic of a residual column in the given row order, for any fitted design."""
    from pyspark.sql import functions as F
    from postmetrics.operators.ordinal import with_previous
    lagged = with_previous(residuals, [F.col(c) for c in order], [name], "prev_")
    e, before = F.col(name), F.col(f"prev_{name}")
    return lagged.agg((F.sum((e - before) ** 2) / F.sum(e ** 2)).alias("durbin_watson"))


def robust_sweep(df: DataFrame, y: str, terms: Sequence[tuple] = (), thresholds: Sequence[float] = (0.90, 0.95, 0.99),
                 report: Sequence[str] | None = None, design: Design | None = None) -> list[tuple]:
    """OLS of log(1 + y) with ``y`` capped at each quantile: rows (threshold, term, estimate).

    Caps are quantiles over all rows of ``df``; the fits take complete rows.  ``report`` names the
    terms to return (None: all slopes; a term the design lacks counts as 0), then 'R-squared' follows.
    R-squared comes from residuals and centred responses, not from differences of raw sums.
    """
    from pyspark.sql import functions as F
    from postmetrics.operators.quantiles import quantiles
    design = design or build_design(df, terms, True)
    names = [f"c{j}" for j in range(len(thresholds))]
    caps = quantiles(df, y, list(thresholds), names=names).first()
    capped = [F.log1p(F.when(F.col(y).isNotNull(), F.least(F.col(y).cast("double"), F.lit(caps[c])))) for c in names]
    rows = []
    for s, t in zip(sums(df, design, *capped), thresholds):
        g = s.gram()
        inv, _ = la.sym_pinv(g["xtx"])
        beta = inv @ g["xty"]
        r = s.residuals(beta, centre=g["sum_y"] / g["n"] if g["n"] else 0.0)
        of = dict(zip(design.names, beta))
        rows += [(t, nm, _f(of.get(nm, 0.0))) for nm in (design.names[1:] if report is None else report)]
        rows.append((t, "R-squared", _f(1 - r["sum_e2"] / r["sum_yc2"]) if r["sum_yc2"] > 0 else None))
    return rows


def _f(x) -> float | None:
    x = float(x)
    return x if math.isfinite(x) else None


def _exp(x: float) -> float:
    try:
        return math.exp(x)
    except OverflowError:
        return float("inf")


def fit_ols(df: DataFrame, y: Column | str, terms: Sequence[tuple] = (), design: Design | None = None,
            cov_type: str = "HC1", intercept: bool = True) -> Fit | WideFit:
    """OLS with HC1 (or classical) covariance; min-norm solution when rank-deficient.

    A discrete design is fitted from the sums of its cells (one native aggregation), any other from
    Gram passes over factor codes.  One categorical may have more levels than the matrix takes: then
    ``fit_wide_factor`` fits the same model.
    """
    if design is None:
        try:
            design = build_design(df, terms, intercept)
        except TooManyLevels as wide:
            if not intercept or cov_type != "HC1" or ("cat", wide.column) not in terms:
                raise
            return fit_wide_factor(df, y, wide.column, [t for t in terms if t != ("cat", wide.column)])
    s = sums(df, design, y)[0]
    g = s.gram()
    inv, rank = la.sym_pinv(g["xtx"])
    beta = inv @ g["xty"]
    r = s.residuals(beta, centre=g["sum_y"] / g["n"] if design.intercept and g["n"] else 0.0)
    return _ols_report(design, g, r, inv, rank, beta, cov_type)


def _ols_report(design: Design, g: dict, r: dict, inv: np.ndarray, rank: int, beta: np.ndarray, cov_type: str) -> Fit:
    """Covariance and summary of an OLS fit from its Gram sums ``g`` and residual sums ``r``."""
    xtx, n, intercept, ssr = g["xtx"], g["n"], design.intercept, r["sum_e2"]
    df_resid = n - rank
    if cov_type == "HC1":
        cov = inv @ r["meat"] @ inv * (n / df_resid)
    else:
        cov = inv * (ssr / df_resid)
    sst = r["sum_yc2"]
    r2 = 1.0 - ssr / sst if sst > 0 else float("nan")
    df_model = rank - (1 if intercept else 0)
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(ssr / n) + 1.0)
    m2 = ssr / n
    mean_e = r["sum_e"] / n
    c2 = m2 - mean_e ** 2
    c3 = r["sum_e3"] / n - 3 * mean_e * m2 + 2 * mean_e ** 3
    c4 = r["sum_e4"] / n - 4 * mean_e * r["sum_e3"] / n + 6 * mean_e ** 2 * m2 - 3 * mean_e ** 4
    summary = dict(n=n, rank=rank, df_model=df_model, df_resid=df_resid, r_squared=r2,
                   adj_r_squared=1.0 - (1.0 - r2) * (n - (1 if intercept else 0)) / df_resid,
                   llf=llf, aic=-2 * llf + 2 * rank, bic=-2 * llf + rank * math.log(n),
                   skew=c3 / c2 ** 1.5 if c2 > 0 else float("nan"),
                   kurtosis=c4 / c2 ** 2 if c2 > 0 else float("nan"),
                   jarque_bera=(n / 6.0 * ((c3 / c2 ** 1.5) ** 2 + (c4 / c2 ** 2 - 3.0) ** 2 / 4.0)
                                if c2 > 0 else float("nan")),
                   ssr=ssr, condition_number=la.condition_number(xtx))
    if intercept and design.p > 1:
        # Wald test that all slopes are zero, with the chosen covariance (robust F)
        slopes, v = beta[1:], cov[1:, 1:]
        v_inv, q = la.sym_pinv(v)
        f = float(slopes @ v_inv @ slopes) / max(q, 1)
        summary.update(f_stat=f, f_df=(q, df_resid), f_pvalue=la.f_sf(f, q, df_resid))
    return Fit(design.names, beta, cov, n, rank, summary)


def fit_wide_factor(df: DataFrame, y: Column | str, factor: str, terms: Sequence[tuple] = ()) -> WideFit:
    """OLS with HC1 errors of ``C(factor)`` and ``terms``, the factor taken out by its level sums.

    With treatment coding the factor's block of XᵀX is diagonal, so the other columns solve a system
    of their own width from the covariances inside levels, and each level follows from its means:
    a_l = mean_l(y) - mean_l(z) g.  Errors need per level only Σe², Σe² z and Σe² z zᵀ.  All are native
    aggregations, and levels stay rows of a table, however many: the driver holds totals and the base level.
    Rows meet the means of their level in one hash join, which keeps levels, not rows, in memory.
    """
    from pyspark.sql import functions as F
    other = build_design(df, terms, False)
    q = other.p
    xs, pairs = [f"x{i}" for i in range(q)], [(i, j) for i in range(q) for j in range(i, q)]
    rows = design_frame(df.where(F.col(factor).isNotNull()), other, [y], [factor]).withColumnRenamed(factor, "f")
    by_level = materialize(rows.groupBy("f").agg(
        F.count("*").alias("n"), F.avg("y0").alias("my"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(x, "y0").alias(f"cy{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(xs[i], xs[j]).alias(f"c{i}_{j}") for i, j in pairs]), "levels")

    def symmetric(values) -> np.ndarray:
        out = np.zeros((q, q))
        for (i, j), v in zip(pairs, values):
            out[i, j] = out[j, i] = v
        return out
    total = by_level.agg(F.count("*").alias("levels"), F.sum("n").cast("double").alias("n"),
                         *[F.sum(F.col("n") * F.col(f"cy{i}")).alias(f"cy{i}") for i in range(q)],
                         *[F.sum(F.col("n") * F.col(f"c{i}_{j}")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if q:
        inv, inner_rank = la.sym_pinv(symmetric(total[f"c{i}_{j}"] for i, j in pairs))
        slope = inv @ np.array([total[f"cy{i}"] for i in range(q)])
    else:
        inv, inner_rank, slope = np.zeros((0, 0)), 0, np.zeros(0)
    n, rank = total["n"] or 0.0, total["levels"] + inner_rank
    scale = n / (n - rank)

    known = ["n", "my", *[f"m{i}" for i in range(q)]]
    zs = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(xs)]
    e = sum((F.lit(-float(b)) * z for b, z in zip(slope, zs)), F.col("y0") - F.col("my"))
    scored = rows.join(by_level.select("f", *known).hint("shuffle_hash"), "f").select(
        "f", *known, (e ** 2).alias("e2"), *[z.alias(f"z{i}") for i, z in enumerate(zs)])
    level_sums = materialize(scored.groupBy("f").agg(
        *[F.first(c).alias(c) for c in known], F.sum("e2").alias("s"),
        *[F.sum(F.col("e2") * F.col(f"z{i}")).alias(f"u{i}") for i in range(q)],
        *[F.sum(F.col("e2") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"w{i}_{j}") for i, j in pairs]), "level_sums")
    spread = level_sums.agg(F.sum("s").alias("s"), *[F.sum(f"w{i}_{j}").alias(f"w{i}_{j}") for i, j in pairs]).first()
    v = inv @ symmetric(spread[f"w{i}_{j}"] for i, j in pairs) @ inv

    def dot(columns: list, numbers) -> Column:
        return sum((c * F.lit(float(b)) for c, b in zip(columns, numbers)), F.lit(0.0))
    # the error of a level: its mean residual, less zbar times the error of the slopes
    zbar = [F.col(f"m{i}") for i in range(q)]
    cross = [dot([F.col(f"u{i}") / F.col("n") for i in range(q)], inv[:, j]) for j in range(q)]
    reach = [dot(zbar, v[:, j]) for j in range(q)]
    var = F.col("s") / F.col("n") ** 2 + sum((z * (r - 2 * c) for z, r, c in zip(zbar, reach, cross)), F.lit(0.0))
    of_level = level_sums.select("f", (F.col("my") - dot(zbar, slope)).alias("level"), var.alias("own"),
                                 *[c.alias(f"cross{j}") for j, c in enumerate(cross)],
                                 *[r.alias(f"reach{j}") for j, r in enumerate(reach)], *[z.alias(f"m{j}") for j, z in enumerate(zbar)])
    base = of_level.agg(F.min_by(F.struct(*of_level.columns), "f").alias("base")).first()["base"]
    base_m, base_cross = [[base[f"{c}{j}"] for j in range(q)] for c in ("m", "cross")]
    with_base = dot([F.col(f"reach{j}") - F.col(f"cross{j}") for j in range(q)], base_m) - dot(zbar, base_cross)
    levels = of_level.where(F.col("f") != F.lit(base["f"])).select(
        "f", F.concat(F.lit(f"C({factor})[T."), _shown(of_level, "f"), F.lit("]")).alias("term"),
        (F.col("level") - F.lit(base["level"])).alias("coef"),
        (F.lit(scale) * (F.col("own") + F.lit(base["own"]) - 2 * with_base)).alias("var"))
    rest = Fit(["Intercept", *other.names], np.concatenate([[base["level"]], slope]),
               scale * np.concatenate([[base["own"]], np.diag(v)]), n, rank, {})
    ssr, variance = spread["s"], rows.agg(F.var_pop("y0")).first()[0]
    summary = dict(n=n, rank=rank, df_model=rank - 1, df_resid=n - rank, ssr=ssr,
                   r_squared=1.0 - ssr / (variance * n) if variance else float("nan"))
    return WideFit(rest, levels, n, rank, summary)


def _shown(df: DataFrame, name: str) -> Column:
    """A level as Python shows it."""
    from pyspark.sql import functions as F
    if df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long", "string", "date"):
        return F.col(name).cast("string")
    return F.udf(str, "string")(name)


def fit_poisson(df: DataFrame, y: Column | str, terms: Sequence[tuple] = (), design: Design | None = None,
                cov_type: str = "HC1", tol: float = 1e-12, dev_tol: float = 1e-10, max_iter: int = 100) -> Fit:
    """Poisson GLM (log link) by IRLS: one weighted pass over cells or staged factor codes per iteration.

    Separation: a dummy term whose rows all have y = 0 has no finite estimate.  Such
    terms are found from the first Gram pass (Σ x_j y = 0 with Σ x_j > 0), their rows
    (which contribute nothing in the limit) are left out of the iterations, and the
    terms are reported with NULL estimates and listed in ``summary['separated']``;
    n and the rank for the HC1 scale still count them, as in the full-design fit.
    """
    design = design or build_design(df, terms, True)
    p = design.p
    everything = sums(df, design, y)[0]
    g0 = everything.gram()
    n_all = g0["n"]
    sep = [j for j in range(1, p) if "[T." in design.names[j]
           and g0["xtx"][j, j] > 0 and g0["xty"][j] == 0]
    keep = [j for j in range(p) if j not in sep]
    work = everything.without(sep) if sep else everything
    q = len(keep)
    g1 = work.gram() if sep else g0
    ybar = g1["sum_y"] / g1["n"]
    beta = np.zeros(q)
    beta[0] = math.log(max(ybar, 1e-10))
    it, converged = 0, False
    inv = np.eye(q)
    rank = q
    prev_dev = None
    for it in range(1, max_iter + 1):
        g = work.newton(beta)
        inv, rank = la.sym_pinv(g["xtx"])
        new = inv @ g["xtz"]
        step = np.max(np.abs(new - beta))
        beta = new
        # stop on a settled coefficient step, or once the deviance (evaluated at the previous
        # iterate) changes by less than dev_tol relative: the step just taken is then one more
        # Newton step past a converged point; quasi-separated terms stop drifting here too
        settled = prev_dev is not None and abs(g["deviance"] - prev_dev) / (abs(g["deviance"]) + 0.1) < dev_tol
        prev_dev = g["deviance"]
        if step < tol * max(1.0, np.max(np.abs(beta))) or settled:
            converged = True
            break
    r = work.residuals(beta, log_link=True)
    rank_all = rank + len(sep)
    df_resid = n_all - rank_all
    cov_k = inv @ r["meat"] @ inv * (n_all / df_resid) if cov_type == "HC1" else inv
    params = np.full(p, np.nan)
    cov = np.full((p, p), np.nan)
    for a, i in enumerate(keep):
        params[i] = beta[a]
        for b, j in enumerate(keep):
            cov[i, j] = cov_k[a, b]
    # intercept-only model: mu = mean(y); its log-likelihood from the same sums
    sum_y, ybar_all = g0["sum_y"], g0["sum_y"] / n_all
    llnull = (sum_y * math.log(ybar_all) if sum_y > 0 else 0.0) - n_all * ybar_all - r["sum_lgamma"]
    summary = dict(n=n_all, rank=rank_all, df_resid=df_resid, df_model=rank_all - 1, iterations=it, converged=converged,
                   deviance=r["deviance"], pearson_chi2=r["pearson"], llf=r["llf"], llnull=llnull,
                   pseudo_r2_cs=1.0 - math.exp(2.0 * (llnull - r["llf"]) / n_all),
                   aic=-2.0 * r["llf"] + 2.0 * rank_all,
                   separated=[design.names[j] for j in sep])
    return Fit(design.names, params, cov, n_all, rank_all, summary)


def fit_entity_fe(df: DataFrame, y: str, xs: Sequence[str], entity: str, min_size: int = 2,
                  full_summary: bool = True, time: str | None = None) -> Fit:
    """Entity fixed effects with a constant (within transform plus grand means), classical SE.

    Entities with fewer than ``min_size`` rows are dropped; df = n - k - (entities - 1).  With ``time``
    the summary also counts its periods and the rows in them.  All sums come from the central moments of
    every entity (``EntitySums``): rows are aggregated where they are read, never joined or sorted.
    """
    panel = EntitySums(df, y, xs, entity, min_size, time)
    design = Design(["Intercept", *xs], [], tuple(("num", x) for x in xs))
    within, pooled = panel.gram(within=True), panel.gram(within=False)
    (inv, k), (pooled_inv, _) = la.sym_pinv(within["xtx"]), la.sym_pinv(pooled["xtx"])
    beta, pooled_beta = inv @ within["xty"], pooled_inv @ pooled["xty"]
    r, *of_pooled = panel.residuals(beta, *([pooled_beta] if full_summary else []))
    fit = _ols_report(design, within, r, inv, k, beta, "classical")
    n_ent = panel.entities
    df_resid = fit.n - k - (n_ent - 1)
    cov = fit.cov * (fit.n - k) / df_resid
    s = dict(fit.summary, df_resid=df_resid, entities=n_ent, obs_per_entity=panel.obs_per_entity)
    if len(fit.params) > 1:
        v_inv, q = la.sym_pinv(cov[1:, 1:])
        f = float(fit.params[1:] @ v_inv @ fit.params[1:]) / max(q, 1)
        s.update(f_stat=f, f_df=(q, df_resid), f_pvalue=la.f_sf(f, q, df_resid))
    if time:
        periods, *per = panel.periods()
        s.update(time_periods=periods, obs_per_period=tuple(per))
    if full_summary:
        # R² overall / between use the slopes on untransformed data (below 0 where the fit does worse
        # than the mean); poolability F compares with the pooled OLS without entity effects
        def explained(ssr, total):
            return 1.0 - ssr / total if total else float("nan")
        ssr_fe, ssr_pool = fit.summary["ssr"], of_pooled[0]["rows_e2"]
        pool_f = ((ssr_pool - ssr_fe) / max(n_ent - 1, 1)) / (ssr_fe / df_resid) if ssr_fe > 0 else float("nan")
        s.update(r_squared_within=fit.summary["r_squared"],
                 r_squared_overall=explained(r["rows_e2"], panel.total_y2),
                 r_squared_between=explained(r["means_e2"], panel.means_y2),
                 poolability_f=pool_f, poolability_df=(n_ent - 1, df_resid),
                 poolability_pvalue=la.f_sf(pool_f, n_ent - 1, df_resid) if math.isfinite(pool_f) else float("nan"))
    return Fit(["const" if nm == "Intercept" else nm for nm in fit.names], fit.params, cov, fit.n, k, s, df_resid)
