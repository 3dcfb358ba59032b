"""Model queries with closed-form DuckDB oracles on saturated designs.

* OLS / HC1, summary, coefficient table, sort, Durbin-Watson: value ~ C(category) on events
* interactions: value ~ C(category) * is_weekend on events
* Poisson / IRR: floor(value) ~ C(category)
* entity fixed effects: l_extendedprice ~ l_quantity within l_suppkey (lineitem)
* robustness sweep: log1p(capped value) ~ C(category) at caps .90 / .95 / .99; with the reference's terms on the core sample
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmetrics.functions.numeric import round_half_even
from postmetrics.plans.derived import SQL_CORE, SQL_ENGINEERED
from postmetrics.plans.registry import r6, register
from postmetrics.session import materialize
from postmetrics.sources.tables import posts, table
from postmetrics.stats import linalg as la
from postmetrics.stats import models
from postmetrics.stats.design import build_design
from postmetrics.stats.gram import sums
from postmetrics.stats.models import fit_entity_fe, fit_ols, fit_poisson, main_terms

CAT = [("cat", "category")]

SQL_OLS_BASE = """
WITH d AS (SELECT event_type AS g, value AS y, ts, event_id FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL),
nn AS (SELECT count(*) AS n, count(DISTINCT g) AS k, avg(y) AS ybar FROM d),
gm AS (SELECT g, count(*) AS ng, avg(y) AS m FROM d GROUP BY g),
e AS (SELECT d.*, d.y - gm.m AS e FROM d JOIN gm USING (g)),
res AS (SELECT g, sum(e * e) AS s2 FROM e GROUP BY g),
v AS (SELECT gm.g, gm.m, res.s2 / (gm.ng * gm.ng) AS vg FROM gm JOIN res USING (g)),
bv AS (SELECT v.m AS mb, v.vg AS vb FROM v WHERE g = (SELECT min(g) FROM gm)),
coefs AS (
  SELECT 'Intercept' AS term, mb AS coef, sqrt(n / (n - k) * vb) AS se FROM bv, nn
  UNION ALL
  SELECT 'C(category)[T.' || g || ']', m - mb, sqrt(n / (n - k) * (vg + vb)) FROM v, bv, nn
  WHERE g <> (SELECT min(g) FROM gm))"""


def _ols_fit(spark, d):
    return fit_ols(posts(spark, d), "engagement", CAT, cov_type="HC1")


@register("model_ols_hc1", SQL_OLS_BASE + """
SELECT term, round_even(coef, 6) AS coef, round_even(se, 6) AS se FROM coefs""")
def model_ols_hc1(spark, d):
    t = _ols_fit(spark, d).table(spark)
    return t.select("term", r6("coef").alias("coef"), r6("se").alias("se"))


@register("model_ols_two_regressors", """
WITH t AS (SELECT ln(1 + strlen(text)) AS y, n_chars::DOUBLE AS a, (lang = 'en')::INT::DOUBLE AS b FROM documents),
m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM t),
s AS (SELECT sum((a - ma) * (a - ma)) AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) AS bb,
             sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS yb FROM t, m),
c AS (SELECT (bb * ay - ab * yb) / (aa * bb - ab * ab) AS pa, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS pb FROM s)
SELECT 'Intercept' AS term, round_even(my - pa * ma - pb * mb, 6) AS coef FROM m, c
UNION ALL SELECT '1000 n_chars', round_even(1000 * pa, 6) FROM c
UNION ALL SELECT 'english[T.True]', round_even(pb, 6) FROM c""")
def model_ols_two_regressors(spark, d):
    """Text length next to a boolean: regressors of very different size."""
    docs = table(spark, d, "documents").select(F.log1p(F.octet_length("text")).alias("y"), "n_chars", (F.col("lang") == "en").alias("english"))
    t = fit_ols(docs, "y", [("num", "n_chars"), ("bool", "english")]).table(spark)
    per = F.when(F.col("term") == "n_chars", 1000).otherwise(1)
    term = F.when(F.col("term") == "n_chars", "1000 n_chars").otherwise(F.col("term"))
    return t.select(term.alias("term"), r6(F.col("coef") * per).alias("coef"))


@register("model_wide_factor", """
WITH d AS (SELECT l_partkey AS f, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS z FROM lineitem
           WHERE l_partkey IS NOT NULL AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL),
m AS (SELECT f, count(*) AS n, avg(y) AS my, avg(z) AS mz FROM d GROUP BY f),
t AS (SELECT d.f, d.y - m.my AS yt, d.z - m.mz AS zt FROM d JOIN m USING (f)),
g AS (SELECT sum(zt * yt) / sum(zt * zt) AS b, sum(zt * zt) AS s FROM t),
e AS (SELECT f, yt - b * zt AS e, zt FROM t, g),
u AS (SELECT f, sum(e * e) AS s2, sum(e * e * zt) AS u FROM e GROUP BY f),
v AS (SELECT sum(e * e * zt * zt) / (any_value(s) * any_value(s)) AS v FROM e, g),
k AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM m) + 1 AS p),
a AS (SELECT m.f, my - b * mz AS alpha, s2 / (n * n) - 2 * u / n / s * mz + mz * mz * v AS va, u / n / s AS c, mz FROM m JOIN u USING (f), g, v),
o AS (SELECT alpha AS alpha0, va AS va0, c AS c0, mz AS mz0 FROM a WHERE f = (SELECT min(f) FROM a))
SELECT 'Intercept' AS term, round_even(alpha0, 2) AS coef, round_even(sqrt(n * 1.0 / (n - p) * va0), 2) AS se FROM o, k
UNION ALL
SELECT 'C(l_partkey)[T.' || f || ']', round_even(alpha - alpha0, 2),
       round_even(sqrt(n * 1.0 / (n - p) * (va + va0 - 2 * (mz * mz0 * v - c * mz0 - c0 * mz))), 2) FROM a, o, k, v WHERE f <> (SELECT min(f) FROM a)
UNION ALL
SELECT 'l_quantity', round_even(b, 2), round_even(sqrt(n * 1.0 / (n - p) * v), 2) FROM g, v, k""")
def model_wide_factor(spark, d):
    """Price on every part (thousands of levels) and quantity."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity")
    fit = models.fit_wide_factor(li, F.col("l_extendedprice").cast("double"), "l_partkey", [("num", "l_quantity")])
    return fit.table(spark).select("term", round_half_even(F.col("coef"), 2).alias("coef"), round_half_even(F.col("se"), 2).alias("se"))


@register("model_coef_table", SQL_OLS_BASE + """
SELECT term, round_even(coef, 6) AS coef, round_even(se, 6) AS se, round_even(coef / se, 6) AS z,
  round_even(coef - 1.959963984540054 * se, 6) AS ci_lower, round_even(coef + 1.959963984540054 * se, 6) AS ci_upper
FROM coefs""")
def model_coef_table(spark, d):
    t = _ols_fit(spark, d).table(spark)
    return t.select("term", *[r6(c).alias(c) for c in ("coef", "se", "z", "ci_lower", "ci_upper")])


# the normal distribution from its power series; beyond 8 the tail is below 1e-15
SQL_P = """CASE WHEN abs({z}) > 8 THEN 0.0 WHEN {z} = 0 THEN 1.0 ELSE 1 - 2 / sqrt(2 * pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(
  range(0, 200), lambda j: exp((2 * j + 1) * ln(abs({z})) - lgamma(2 * j + 2) + j * ln(2) + lgamma(j + 1)))) END"""


@register("model_coef_pvalues", SQL_OLS_BASE + ", z AS (SELECT term, coef / se AS z FROM coefs) SELECT term, round_even(z, 6) AS z, round_even("
          + SQL_P.format(z="z") + ", 6) AS p FROM z")
def model_coef_pvalues(spark, d):
    """Test statistics and two-sided p values of the coefficient table."""
    return _ols_fit(spark, d).table(spark).select("term", r6("z").alias("z"), r6("p").alias("p"))


@register("model_ols_wald", SQL_OLS_BASE + """,
mo AS (SELECT avg(e) AS me, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM e),
sk AS (SELECT (m3 - 3 * me * m2 + 2 * me * me * me) / pow(m2 - me * me, 1.5) AS skew,
              (m4 - 4 * me * m3 + 6 * me * me * m2 - 3 * me * me * me * me) / pow(m2 - me * me, 2) AS kurt, n::DOUBLE AS n, k FROM mo, nn),
s1 AS (SELECT *, skew * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y,
              sqrt(2 * (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
              (kurt - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
              6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM sk),
s2 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS a FROM s1),
s3 AS (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS low FROM s2),
om AS (SELECT zs * zs + pow((1 - 2 / (9 * a) - sign(low) * pow((1 - 2 / a) / abs(low), 1.0 / 3)) / sqrt(2 / (9 * a)), 2) AS k2, n, k FROM s3),
w AS (SELECT sum(m / vg) / sum(1 / vg) AS mean FROM v),
wald AS (SELECT sum((m - mean) * (m - mean) / vg) AS stat FROM v, w)
SELECT n::BIGINT AS nobs, round_even(k2, 6) AS omnibus, round_even(exp(-k2 / 2), 6) AS omnibus_pvalue,
  round_even(stat * (n - k) / n / (k - 1), 6) AS f_robust, CAST(k - 1 AS BIGINT) AS f_df_num, CAST(n - k AS BIGINT) AS f_df_den FROM om, wald""")
def model_ols_wald(spark, d):
    """Omnibus and robust F of the summary: with one factor the Wald test is that of weighted group means."""
    s = _ols_fit(spark, d).summary
    k2 = la.omnibus(s["n"], s["skew"], s["kurtosis"])
    out = spark.createDataFrame([(int(s["n"]), k2, math.exp(-k2 / 2.0), float(s["f_stat"]), *map(int, s["f_df"]))],
                                "nobs bigint, omnibus double, omnibus_pvalue double, f_robust double, f_df_num bigint, f_df_den bigint")
    return out.select("nobs", *[r6(c).alias(c) for c in ("omnibus", "omnibus_pvalue", "f_robust")], "f_df_num", "f_df_den")


@register("sort_coef", SQL_OLS_BASE + """
SELECT term, round_even(coef, 6) AS coef, ROW_NUMBER() OVER (ORDER BY coef, term) - 1 AS position FROM coefs""")
def sort_coef(spark, d):
    t = _ols_fit(spark, d).table(spark)
    # p rows: a window over the coefficient table is bounded by the design width
    w = Window.orderBy("coef", "term")
    return t.select("term", r6("coef").alias("coef"), (F.row_number().over(w) - 1).cast("bigint").alias("position"))


def _residuals_in_time(spark, d, fit):
    p = posts(spark, d)
    names = fit.names
    pred = F.lit(float(fit.params[0]))
    for nm, b in zip(names[1:], fit.params[1:]):
        level = nm[len("C(category)[T."):-1]
        pred = pred + F.when(F.col("category") == level, F.lit(float(b))).otherwise(F.lit(0.0))
    return p.where(F.col("category").isNotNull() & F.col("engagement").isNotNull()).select(
        "post_id", "post_datetime", (F.col("engagement") - pred).alias("e"))


def durbin_watson(spark, d, fit):
    e = _residuals_in_time(spark, d, fit)
    return models.durbin_watson(e, ["post_datetime", "post_id"])


SQL_DW = """,
dw AS (SELECT sum((e - pe) * (e - pe)) / (SELECT sum(e * e) FROM e) AS durbin_watson
       FROM (SELECT e, LAG(e) OVER (ORDER BY ts, event_id) AS pe FROM e))"""


@register("win_durbin_watson", SQL_OLS_BASE + SQL_DW + " SELECT round_even(durbin_watson, 6) AS durbin_watson FROM dw")
def win_durbin_watson(spark, d):
    return durbin_watson(spark, d, _ols_fit(spark, d)).select(r6("durbin_watson").alias("durbin_watson"))


@register("model_ols_summary", SQL_OLS_BASE + SQL_DW + """,
s AS (SELECT (SELECT sum(s2) FROM res) AS ssr, (SELECT sum((y - ybar) * (y - ybar)) FROM d, nn) AS sst),
mo AS (SELECT avg(e) AS me, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM e),
cm AS (SELECT m2 - me * me AS c2, m3 - 3 * me * m2 + 2 * me * me * me AS c3,
              m4 - 4 * me * m3 + 6 * me * me * m2 - 3 * me * me * me * me AS c4 FROM mo),
ll AS (SELECT -n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1) AS llf FROM s, nn)
SELECT n AS nobs, CAST(k - 1 AS BIGINT) AS df_model, CAST(n - k AS BIGINT) AS df_resid,
  round_even(1 - ssr / sst, 6) AS r_squared,
  round_even(1 - (ssr / sst) * (n - 1) / (n - k), 6) AS adj_r_squared,
  round_even(llf, 6) AS llf, round_even(-2 * llf + 2 * k, 6) AS aic, round_even(-2 * llf + k * ln(n), 6) AS bic,
  round_even(c3 / pow(c2, 1.5), 6) AS skew, round_even(c4 / (c2 * c2), 6) AS kurtosis,
  round_even(n / 6.0 * (pow(c3 / pow(c2, 1.5), 2) + pow(c4 / (c2 * c2) - 3, 2) / 4.0), 6) AS jarque_bera,
  round_even(exp(-(n / 6.0 * (pow(c3 / pow(c2, 1.5), 2) + pow(c4 / (c2 * c2) - 3, 2) / 4.0)) / 2.0), 6) AS jb_pvalue,
  round_even(durbin_watson, 6) AS durbin_watson
FROM nn, s, ll, cm, dw""")
def model_ols_summary(spark, d):
    fit = _ols_fit(spark, d)
    s = fit.summary
    dw = durbin_watson(spark, d, fit)
    stats = ("r_squared", "adj_r_squared", "llf", "aic", "bic", "skew", "kurtosis", "jarque_bera")
    row = [(int(s["n"]), int(s["df_model"]), int(s["df_resid"]), *[float(s[k]) for k in stats],
            math.exp(-s["jarque_bera"] / 2.0))]   # chi-square(2) upper tail
    schema = ("nobs bigint, df_model bigint, df_resid bigint, r_squared double, adj_r_squared double, llf double, "
              "aic double, bic double, skew double, kurtosis double, jarque_bera double, jb_pvalue double")
    base = spark.createDataFrame(row, schema)
    return base.select("nobs", "df_model", "df_resid", *[r6(c).alias(c) for c in (*stats, "jb_pvalue")],
                       r6(dw.scalar()).alias("durbin_watson"))


@register("model_ols_diagnostics")
def model_ols_diagnostics(spark, d):
    """The rest of the summary: omnibus, robust F and condition number."""
    s = _ols_fit(spark, d).summary
    k2 = la.omnibus(s["n"], s["skew"], s["kurtosis"])
    row = [(int(s["n"]), k2, math.exp(-k2 / 2.0), float(s["f_stat"]), *map(int, s["f_df"]), float(s["f_pvalue"]), s["condition_number"])]
    out = spark.createDataFrame(row, "nobs bigint, omnibus double, omnibus_pvalue double, f_robust double, f_df_num bigint, "
                                     "f_df_den bigint, f_pvalue double, condition_number double")
    return out.select("nobs", "f_df_num", "f_df_den", *[r6(c).alias(c) for c in ("omnibus", "omnibus_pvalue", "f_robust", "f_pvalue",
                                                                                 "condition_number")])


@register("model_design", """
WITH d AS (SELECT event_type AS g FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL)
SELECT 'Intercept' AS term, CAST(count(*) AS DOUBLE) AS col_sum FROM d
UNION ALL
SELECT 'C(category)[T.' || g || ']', CAST(count(*) AS DOUBLE) FROM d WHERE g <> (SELECT min(g) FROM d) GROUP BY g""")
def model_design(spark, d):
    p = posts(spark, d)
    des = build_design(p, CAT)
    g = sums(p, des, "engagement")[0].gram()
    rows = [(nm, float(g["xtx"][0, j])) for j, nm in enumerate(des.names)]
    return spark.createDataFrame(rows, "term string, col_sum double")


SQL_INTER = """
WITH d AS (SELECT event_type AS g, dayofweek(ts) IN (0, 6) AS wk, value AS y FROM events
           WHERE event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT g, wk, avg(y) AS m FROM d GROUP BY g, wk),
b AS (SELECT min(g) AS b FROM d),
p AS (SELECT g, max(CASE WHEN wk THEN m END) AS mt, max(CASE WHEN NOT wk THEN m END) AS mf FROM c GROUP BY g),
pb AS (SELECT mt AS bt, mf AS bf FROM p WHERE g = (SELECT b FROM b)),
coefs AS (
  SELECT 'Intercept' AS term, bf AS coef FROM pb
  UNION ALL SELECT 'C(category)[T.' || g || ']', mf - bf FROM p, pb WHERE g <> (SELECT b FROM b)
  UNION ALL SELECT 'is_weekend[T.True]', bt - bf FROM pb
  UNION ALL SELECT 'C(category)[T.' || g || ']:is_weekend[T.True]', mt - mf - bt + bf FROM p, pb WHERE g <> (SELECT b FROM b))"""


def _interaction_fit(spark, d):
    p = posts(spark, d).withColumn("is_weekend", F.dayofweek("post_datetime").isin(1, 7))
    terms = [("cat", "category"), ("bool", "is_weekend"), ("inter", ("cat", "category"), ("bool", "is_weekend"))]
    return fit_ols(p, "engagement", terms, cov_type="HC1")


@register("model_interactions", SQL_INTER + " SELECT term, round_even(coef, 6) AS coef FROM coefs")
def model_interactions(spark, d):
    return _interaction_fit(spark, d).table(spark).select("term", r6("coef").alias("coef"))


@register("filt_term_regex", SQL_INTER + " SELECT term, round_even(coef, 6) AS coef FROM coefs WHERE regexp_matches(term, '^[^:]+:[^:]+$')")
def filt_term_regex(spark, d):
    return main_terms(_interaction_fit(spark, d).table(spark), "^[^:]+:[^:]+$").select("term", r6("coef").alias("coef"))


SQL_POISSON = """
WITH d AS (SELECT event_type AS g, floor(value) AS y FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL),
nn AS (SELECT count(*) AS n, count(DISTINCT g) AS k FROM d),
gm AS (SELECT g, count(*) AS ng, avg(y) AS m FROM d GROUP BY g),
v AS (SELECT d.g, any_value(gm.m) AS m, sum((d.y - gm.m) * (d.y - gm.m)) / pow(any_value(gm.ng) * any_value(gm.m), 2) AS vg
      FROM d JOIN gm USING (g) GROUP BY d.g),
bv AS (SELECT m AS mb, vg AS vb FROM v WHERE g = (SELECT min(g) FROM gm)),
coefs AS (
  SELECT 'Intercept' AS term, ln(mb) AS coef, sqrt(n / (n - k) * vb) AS se FROM bv, nn
  UNION ALL
  SELECT 'C(category)[T.' || g || ']', ln(m / mb), sqrt(n / (n - k) * (vg + vb)) FROM v, bv, nn
  WHERE g <> (SELECT min(g) FROM gm))"""


def _poisson_fit(spark, d):
    p = posts(spark, d).withColumn("count", F.floor("engagement").cast("double"))
    return fit_poisson(p, "count", CAT)


@register("model_poisson_irls", SQL_POISSON + " SELECT term, round_even(coef, 6) AS coef, round_even(se, 6) AS se FROM coefs")
def model_poisson_irls(spark, d):
    return _poisson_fit(spark, d).table(spark).select("term", r6("coef").alias("coef"), r6("se").alias("se"))


@register("model_irr", SQL_POISSON + """
SELECT term, round_even(exp(coef), 6) AS irr, round_even(exp(coef - 1.959963984540054 * se), 6) AS ci_lower,
  round_even(exp(coef + 1.959963984540054 * se), 6) AS ci_upper FROM coefs""")
def model_irr(spark, d):
    t = _poisson_fit(spark, d).table(spark, exp=True)
    return t.select("term", r6("coef").alias("irr"), r6("ci_lower").alias("ci_lower"), r6("ci_upper").alias("ci_upper"))


@register("model_poisson_summary", SQL_POISSON + """,
t AS (SELECT d.y, gm.m FROM d JOIN gm USING (g)),
r AS (SELECT 2 * sum(CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END - (y - m)) AS deviance, sum((y - m) * (y - m) / m) AS pearson,
             sum(y * ln(m) - m - lgamma(y + 1)) AS llf, sum(lgamma(y + 1)) AS lg, avg(y) AS ybar, sum(y) AS sy FROM t),
q AS (SELECT *, sy * ln(ybar) - n * ybar - lg AS llnull FROM r, nn)
SELECT n AS nobs, CAST(n - k AS BIGINT) AS df_resid, CAST(k - 1 AS BIGINT) AS df_model, round_even(deviance, 4) AS deviance,
  round_even(pearson, 4) AS pearson_chi2, round_even(llf, 4) AS llf, round_even(-2 * llf + 2 * k, 4) AS aic,
  round_even(1 - exp(2 * (llnull - llf) / n), 6) AS pseudo_r2_cs FROM q""")
def model_poisson_summary(spark, d):
    """Header of the Poisson report."""
    s = _poisson_fit(spark, d).summary
    row = [(int(s["n"]), int(s["df_resid"]), int(s["df_model"]), s["deviance"], s["pearson_chi2"], s["llf"], s["aic"], s["pseudo_r2_cs"])]
    out = spark.createDataFrame(row, "nobs bigint, df_resid bigint, df_model bigint, deviance double, pearson_chi2 double, llf double, "
                                     "aic double, pseudo_r2_cs double")
    return out.select("nobs", "df_resid", "df_model", *[round_half_even(c, 4).alias(c) for c in ("deviance", "pearson_chi2", "llf", "aic")],
                      r6("pseudo_r2_cs").alias("pseudo_r2_cs"))


MAIN = r"\[T\.[psv]"


@register("model_coef_main", SQL_OLS_BASE + f"""
SELECT term, round_even(coef, 6) AS coef, round_even(se, 6) AS se FROM coefs WHERE regexp_matches(term, '{MAIN}') ORDER BY coef DESC""")
def model_coef_main(spark, d):
    """Coefficients of the main variables, largest first."""
    return main_terms(_ols_fit(spark, d).table(spark), MAIN).select("term", r6("coef").alias("coef"), r6("se").alias("se"))


@register("model_irr_main", SQL_POISSON + f"""
SELECT term, round_even(exp(coef), 6) AS irr FROM coefs WHERE regexp_matches(term, '{MAIN}') ORDER BY irr DESC""")
def model_irr_main(spark, d):
    """Rate ratios of the main variables, largest first."""
    return main_terms(_poisson_fit(spark, d).table(spark, exp=True), MAIN).select("term", r6("coef").alias("irr"))


@register("model_panel_fe_summary", """
WITH d AS (SELECT l_suppkey AS e, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x FROM lineitem
           WHERE l_suppkey IS NOT NULL AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL),
sz AS (SELECT e, count(*) AS c, avg(y) AS my, avg(x) AS mx FROM d GROUP BY e HAVING count(*) >= 2),
dd AS (SELECT d.y - sz.my AS yt, d.x - sz.mx AS xt, d.y, d.x FROM d JOIN sz USING (e)),
g AS (SELECT avg(y) AS gy, avg(x) AS gx, sum(xt * yt) / sum(xt * xt) AS b FROM dd),
w AS (SELECT 1 - sum((yt - b * xt) * (yt - b * xt)) / sum(yt * yt) AS r2_within,
             1 - sum((y - gy - b * (x - gx)) * (y - gy - b * (x - gx))) / sum((y - gy) * (y - gy)) AS r2_overall, count(*) AS n FROM dd, g),
m AS (SELECT avg(my) AS mm, count(*) AS entities, min(c) AS least, max(c) AS most, avg(c) AS mean FROM sz),
t AS (SELECT 1 - sum((my - gy - b * (mx - gx)) * (my - gy - b * (mx - gx))) / sum((my - mm) * (my - mm)) AS r2_between FROM sz, g, m)
SELECT n::BIGINT AS nobs, entities::BIGINT AS entities, least::BIGINT AS min_obs, most::BIGINT AS max_obs, round_even(mean, 6) AS mean_obs,
       round_even(r2_within, 6) AS r2_within, round_even(r2_between, 6) AS r2_between, round_even(r2_overall, 6) AS r2_overall FROM w, m, t""")
def model_panel_fe_summary(spark, d):
    """Header of the fixed-effects report: counts and the three R-squared variants."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity")
    s = fit_entity_fe(li, "l_extendedprice", ["l_quantity"], "l_suppkey", min_size=2).summary
    row = spark.createDataFrame([(int(s["n"]), s["entities"], *s["obs_per_entity"], s["r_squared_within"], s["r_squared_between"],
                                  s["r_squared_overall"])],
                                "nobs long, entities long, min_obs long, max_obs long, mean_obs double, r2_within double, "
                                "r2_between double, r2_overall double")
    return row.select("nobs", "entities", "min_obs", "max_obs", *[r6(c).alias(c) for c in ("mean_obs", "r2_within", "r2_between", "r2_overall")])


@register("model_panel_fe", """
WITH d AS (SELECT l_suppkey AS e, l_extendedprice AS y, l_quantity AS x FROM lineitem
           WHERE l_suppkey IS NOT NULL AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL),
sz AS (SELECT e, count(*) AS c, avg(y) AS my, avg(x) AS mx FROM d GROUP BY e HAVING count(*) >= 2),
dd AS (SELECT d.y - sz.my AS yt, d.x - sz.mx AS xt, d.y, d.x FROM d JOIN sz USING (e)),
g AS (SELECT avg(y) AS gy, avg(x) AS gx, count(*) AS n, sum(xt * yt) AS sxy, sum(xt * xt) AS sxx FROM dd),
b AS (SELECT sxy / sxx AS slope, gy - sxy / sxx * gx AS c, n, sxx, gx FROM g),
r AS (SELECT sum((yt - (SELECT slope FROM b) * xt) * (yt - (SELECT slope FROM b) * xt)) AS ssr FROM dd),
k AS (SELECT count(*) AS ne FROM sz)
SELECT 'const' AS term, round_even(c, 6) AS coef, round_even(sqrt(ssr / (n - 2 - (ne - 1)) * (1.0 / n + gx * gx / sxx)), 6) AS se
FROM b, r, k
UNION ALL
SELECT 'l_quantity', round_even(slope, 6), round_even(sqrt(ssr / (n - 2 - (ne - 1)) / sxx), 6) FROM b, r, k""")
def model_panel_fe(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity")
    # only the coefficient table is returned: skip the extra summary passes
    fit = fit_entity_fe(li, "l_extendedprice", ["l_quantity"], "l_suppkey", min_size=2, full_summary=False)
    return fit.table(spark).select("term", r6("coef").alias("coef"), r6("se").alias("se"))


@register("model_panel_fe_report", """
WITH d0 AS (SELECT l_suppkey AS e, l_shipdate AS p, l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x FROM lineitem
            WHERE l_suppkey IS NOT NULL AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL),
sz AS (SELECT e, count(*) AS c, avg(y) AS my, avg(x) AS mx FROM d0 GROUP BY e HAVING count(*) >= 2),
d AS (SELECT d0.*, my, mx FROM d0 JOIN sz USING (e)),
a AS (SELECT avg(y) AS gy, avg(x) AS gx, sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b, sum((x - mx) * (x - mx)) AS sxx,
             count(*) AS n, (SELECT count(*) FROM sz) AS ne FROM d),
r AS (SELECT sum((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS ssr, sum((y - gy) * (y - gy)) AS syy,
             sum((x - gx) * (y - gy)) AS sxy, sum((x - gx) * (x - gx)) AS sxx2 FROM d, a),
t AS (SELECT count(*) AS periods, min(c) AS lo, max(c) AS hi, avg(c) AS mean FROM (SELECT p, count(*) AS c FROM d GROUP BY p))
SELECT n::BIGINT AS nobs, round_even(-n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1), 4) AS llf,
  round_even(b * b * sxx / (ssr / (n - ne - 1)), 3) AS f_stat, CAST(n - ne - 1 AS BIGINT) AS f_df_den,
  round_even(((syy - sxy * sxy / sxx2 - ssr) / (ne - 1)) / (ssr / (n - ne - 1)), 6) AS poolability_f, CAST(ne - 1 AS BIGINT) AS poolability_df,
  periods::BIGINT AS time_periods, lo::BIGINT AS min_per_period, hi::BIGINT AS max_per_period, round_even(mean, 6) AS mean_per_period
FROM a, r, t""")
def model_panel_fe_report(spark, d):
    """Log-likelihood, F statistics and time periods of the fixed-effects report."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    s = fit_entity_fe(li, "l_extendedprice", ["l_quantity"], "l_suppkey", min_size=2, time="l_shipdate").summary
    row = [(int(s["n"]), s["llf"], s["f_stat"], int(s["f_df"][1]), s["poolability_f"], int(s["poolability_df"][0]), s["time_periods"],
            *s["obs_per_period"])]
    out = spark.createDataFrame(row, "nobs long, llf double, f_stat double, f_df_den long, poolability_f double, poolability_df long, "
                                     "time_periods long, min_per_period long, max_per_period long, mean_per_period double")
    return out.select("nobs", round_half_even("llf", 4).alias("llf"), round_half_even("f_stat", 3).alias("f_stat"), "f_df_den",
                      r6("poolability_f").alias("poolability_f"), "poolability_df", "time_periods", "min_per_period", "max_per_period",
                      r6("mean_per_period").alias("mean_per_period"))


THRESHOLDS = (0.90, 0.95, 0.99)


@register("model_robust_sweep", """
WITH caps AS (SELECT 90 AS pct, quantile_cont(value, 0.90) AS cap FROM events
              UNION ALL SELECT 95, quantile_cont(value, 0.95) FROM events
              UNION ALL SELECT 99, quantile_cont(value, 0.99) FROM events),
d AS (SELECT caps.pct, event_type AS g, ln(1 + least(value, caps.cap)) AS y FROM events, caps
      WHERE event_type IS NOT NULL AND value IS NOT NULL),
gm AS (SELECT pct, g, avg(y) AS m FROM d GROUP BY pct, g),
tot AS (SELECT pct, avg(y) AS ybar FROM d GROUP BY pct),
ss AS (SELECT d.pct, sum((d.y - gm.m) * (d.y - gm.m)) AS ssr, sum((d.y - tot.ybar) * (d.y - tot.ybar)) AS sst
       FROM d JOIN gm ON d.pct = gm.pct AND d.g = gm.g JOIN tot ON d.pct = tot.pct GROUP BY d.pct),
b AS (SELECT pct, m AS mb FROM gm WHERE g = (SELECT min(g) FROM gm))
SELECT gm.pct AS threshold, 'C(category)[T.' || gm.g || ']' AS term, round_even(gm.m - b.mb, 6) AS value
FROM gm JOIN b ON gm.pct = b.pct WHERE gm.g <> (SELECT min(g) FROM gm)
UNION ALL
SELECT pct, 'R-squared', round_even(1 - ssr / sst, 6) FROM ss""")
def model_robust_sweep(spark, d):
    p = posts(spark, d).where(F.col("category").isNotNull() & F.col("engagement").isNotNull())
    return _sweep_table(spark, models.robust_sweep(p, "engagement", CAT, THRESHOLDS))


def _sweep_table(spark, rows):
    out = spark.createDataFrame([(int(round(t * 100)), nm, v) for t, nm, v in rows], "threshold int, term string, value double")
    return out.select("threshold", "term", r6("value").alias("value"))


# Multi-regressor fits with the reference's model shape (treatment-coded reply type, category,
# weekday, hour and tier, plus a numeric control) on the engineered core sample.  No closed form
# exists, so these are registered without an oracle (rows-only check); tests compare the same
# code path with numpy.
FULL_TERMS = [("cat", "reply_type"), ("cat", "category"), ("cat", "weekday"), ("cat", "hour_of_day"),
              ("cat", "account_tier"), ("num", "k")]


def _core(spark, d):
    from postmetrics.plans.derived import core_sample, engineered
    return core_sample(engineered(spark, d, cap=True))


@register("model_ols_full")
def model_ols_full(spark, d):
    fit = fit_ols(_core(spark, d), F.log1p("winsorized_engagement"), FULL_TERMS, cov_type="HC1")
    return fit.table(spark).select("term", r6("coef").alias("coef"), r6("se").alias("se"))


@register("model_poisson_full")
def model_poisson_full(spark, d):
    fit = fit_poisson(_core(spark, d), F.col("total_engagement").cast("double"), FULL_TERMS)
    return fit.table(spark, exp=True).select("term", r6("coef").alias("irr"), r6("ci_lower").alias("ci_lower"),
                                             r6("ci_upper").alias("ci_upper"))


# The reference's sweep: reply type, link, media and its controls, without month and tier.
SWEEP_TERMS = [("cat", "reply_type"), ("bool", "has_link"), ("bool", "has_media"), ("num", "text_length_chars"), ("num", "num_hashtags"),
               ("num", "num_mentions"), ("cat", "weekday"), ("cat", "hour_of_day")]
SWEEP_REPORT = ("C(reply_type)[T.reply_other]", "has_link[T.True]", "has_media[T.True]")


@register("model_robust_sweep_core")
def model_robust_sweep_core(spark, d):
    """Key coefficients and R-squared of the core sample at each cap."""
    from postmetrics.plans.derived import core_sample, engineered
    columns = [t[1] for t in SWEEP_TERMS]
    # written once: caps, levels and sums all read it
    core = materialize(core_sample(engineered(spark, d, entities=True)).select(*columns, "total_engagement"), "sweep")
    return _sweep_table(spark, models.robust_sweep(core, "total_engagement", SWEEP_TERMS, THRESHOLDS, SWEEP_REPORT))


_LINK, _MEDIA, _REPLY = ("bool", "has_link"), ("bool", "has_media"), ("cat", "reply_type")
SATURATED = [_REPLY, _LINK, _MEDIA, ("inter", _REPLY, _LINK), ("inter", _REPLY, _MEDIA), ("inter", _LINK, _MEDIA),
             ("inter", ("inter", _REPLY, _LINK), _MEDIA)]


@register("model_robust_sweep_saturated", "WITH " + SQL_ENGINEERED + ", " + SQL_CORE + """,
c AS (SELECT reply_type AS r, k BETWEEN 30 AND 49 AS l, k BETWEEN 45 AND 64 AS m, total_engagement AS e FROM core WHERE k IS NOT NULL),
caps AS (SELECT 90 AS threshold, quantile_cont(e, 0.90) AS cap FROM c UNION ALL SELECT 95, quantile_cont(e, 0.95) FROM c
         UNION ALL SELECT 99, quantile_cont(e, 0.99) FROM c),
y AS (SELECT threshold, r, l, m, ln(1 + least(e, cap)) AS y FROM c, caps),
cell AS (SELECT threshold, r, l, m, avg(y) AS mean FROM y GROUP BY ALL),
base AS (SELECT threshold, mean AS base FROM cell WHERE r = 'none' AND NOT l AND NOT m),
tot AS (SELECT threshold, avg(y) AS mean FROM y GROUP BY threshold),
ss AS (SELECT y.threshold, sum((y.y - cell.mean) * (y.y - cell.mean)) AS ssr, sum((y.y - tot.mean) * (y.y - tot.mean)) AS sst
       FROM y JOIN cell ON y.threshold = cell.threshold AND y.r = cell.r AND y.l = cell.l AND y.m = cell.m
       JOIN tot ON y.threshold = tot.threshold GROUP BY y.threshold)
SELECT cell.threshold, CASE WHEN r <> 'none' THEN 'C(reply_type)[T.reply_other]' WHEN l THEN 'has_link[T.True]' ELSE 'has_media[T.True]' END AS term,
  round_even(mean - base, 6) AS value
FROM cell JOIN base ON cell.threshold = base.threshold WHERE (r <> 'none')::INT + l::INT + m::INT = 1
UNION ALL SELECT threshold, 'R-squared', round_even(1 - ssr / sst, 6) FROM ss""")
def model_robust_sweep_saturated(spark, d):
    """The sweep on the core sample with reply type, link, media and all their interactions: each cell
    has its mean, so the three coefficients and R-squared have a closed form."""
    from postmetrics.plans.derived import core_sample, engineered
    core = core_sample(engineered(spark, d, entities=True)).where("k IS NOT NULL").select("reply_type", "has_link", "has_media", "total_engagement")
    return _sweep_table(spark, models.robust_sweep(core, "total_engagement", SATURATED, THRESHOLDS, SWEEP_REPORT))
