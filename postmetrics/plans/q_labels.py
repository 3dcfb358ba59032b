"""Labelling and labeler-evaluation queries over ``documents``.

The keyword labelers are offline stand-ins for the reference's external text
classifiers; the truth labeler plays the role of the reference labeler.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from postmetrics.operators import labels as lb
from postmetrics.plans.registry import register
from postmetrics.sources.tables import table

TRUTH = "truth"
LABELER_RULES = {
    TRUTH: lb.DEFAULT_RULES,
    "kw_no_exclaim": replace(lb.DEFAULT_RULES, humor=[r for r in lb.DEFAULT_RULES.humor if r[0] != "absurdist"]),
    "kw_swap": replace(lb.DEFAULT_RULES, topic=[
        ("politics" if lab == "social_commentary" else "social_commentary" if lab == "politics" else lab, kws)
        for lab, kws in lb.DEFAULT_RULES.topic]),
    "kw_digits_low": replace(lb.DEFAULT_RULES, data_reference=list("01234"),
                             critique=[r for r in lb.DEFAULT_RULES.critique if r[0] != "personal"]),
}


def labelers():
    return {name: lb.KeywordLabeler(r) for name, r in LABELER_RULES.items()}


def _sel(rules, extra=""):
    e = lb.rules_sql(rules)
    return ", ".join(f"{e[f]} AS {f}" for f in lb.LABEL_FIELDS) + extra


SQL_LABELS = f"SELECT doc_id, {_sel(lb.DEFAULT_RULES)} FROM documents"
SQL_LONG = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS model, {_sel(r)} FROM documents"
                              for name, r in LABELER_RULES.items())
_PAIR_COLS = ", ".join(f"c.{f}, t.{f} AS truth_{f}" for f in lb.LABEL_FIELDS)
SQL_PAIRS = f"""
WITH long AS ({SQL_LONG}),
pairs AS (SELECT c.doc_id, c.model, {_PAIR_COLS}
          FROM long c JOIN long t ON c.doc_id = t.doc_id AND t.model = '{TRUTH}' WHERE c.model <> '{TRUTH}'),
agree AS (SELECT doc_id, model, {" + ".join(f"CAST({f} IS NOT DISTINCT FROM truth_{f} AS INTEGER)" for f in lb.LABEL_FIELDS)} AS m
          FROM pairs),
scores AS (SELECT model, round_even(sum(m) / (5.0 * count(*)), 3) AS mean, count(*) AS count,
                  round_even(stddev_samp(m / 5.0), 3) AS std FROM agree GROUP BY model)"""


def doc_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@register("label_posts", SQL_LABELS)
def label_posts(spark, d):
    return lb.label_posts(doc_texts(spark, d), "doc_id", "text")


def _neutral_sql(f):
    v = lb.NEUTRAL[f]
    return repr(v).upper() if isinstance(v, bool) else f"'{v}'"


SQL_VALIDATE = f"""
WITH r AS (SELECT doc_id, {_sel(lb.DEFAULT_RULES)} FROM documents)
SELECT doc_id, {", ".join(f"CASE WHEN doc_id % 5 IN (0, 4) THEN {f} ELSE {_neutral_sql(f)} END AS {f}" for f in lb.LABEL_FIELDS)}
FROM r"""


@register("label_validate", SQL_VALIDATE)
def label_validate(spark, d):
    """Replies broken by a rule on the post: a field missing, a wrong type, no JSON at all.

    The rest (whole replies, also of long texts) are valid; broken ones become neutral.
    """
    r = lb.label_replies(doc_texts(spark, d), "doc_id", "text", {"labeler": lb.KeywordLabeler()})
    kind = F.col("doc_id") % 5
    reply = (F.when(kind == 1, F.regexp_replace("reply", '"topic_category": "[a-z_]*", ', ""))
             .when(kind == 2, F.regexp_replace("reply", '"has_data_reference": (true|false)', '"has_data_reference": "maybe"'))
             .when(kind == 3, F.concat(F.lit("Here it is: "), F.substring("reply", 2, 40))).otherwise(F.col("reply")))
    return r.select("doc_id", *lb.validate(reply))


@register("label_posts_multi", SQL_LONG)
def label_posts_multi(spark, d):
    return lb.label_posts_multi(doc_texts(spark, d), "doc_id", "text", labelers())


def pairs(spark, d):
    return lb.truth_pairs(label_posts_multi(spark, d), "doc_id", TRUTH)


@register("join_truth_pairs", SQL_PAIRS + f" SELECT doc_id, model, {', '.join(f + ', truth_' + f for f in lb.LABEL_FIELDS)} FROM pairs")
def join_truth_pairs(spark, d):
    p = pairs(spark, d)
    return p.select("doc_id", "model", *[c for f in lb.LABEL_FIELDS for c in (f, f"truth_{f}")])


@register("agg_agreement", SQL_PAIRS + " SELECT doc_id, model, m / 5.0 AS agreement_score FROM agree")
def agg_agreement(spark, d):
    p = pairs(spark, d)
    return p.select("doc_id", "model", (lb.agreement_matches(p) / F.lit(5.0)).alias("agreement_score"))


@register("agg_model_scores", SQL_PAIRS + " SELECT model, mean, count, std FROM scores")
def agg_model_scores(spark, d):
    return lb.model_scores(pairs(spark, d)).orderBy(F.desc("mean"), "model")


@register("eval_labelers_detail", SQL_PAIRS + """
SELECT p.doc_id, d.text, d.n_chars AS engagement, p.model, a.m / 5.0 AS agreement_score, truth_humor_type AS truth_humor, humor_type AS model_humor,
  truth_topic_category AS truth_topic, topic_category AS model_topic, truth_has_data_reference AS truth_has_data, has_data_reference AS model_has_data,
  truth_shows_vulnerability AS truth_vulnerable, shows_vulnerability AS model_vulnerable
FROM pairs p JOIN agree a ON p.doc_id = a.doc_id AND p.model = a.model JOIN documents d ON p.doc_id = d.doc_id""")
def eval_labelers_detail(spark, d):
    """The evaluation table behind the scores: 13 columns per post and model."""
    return lb.evaluation_detail(pairs(spark, d), table(spark, d, "documents"), "doc_id", "text", "n_chars")


@register("eval_labelers", SQL_PAIRS + """
SELECT model AS best_model, mean AS agreement FROM scores ORDER BY mean DESC, model LIMIT 1""")
def eval_labelers(spark, d):
    return lb.best_labeler(lb.model_scores(pairs(spark, d)))


@register("join_labels_back", f"""
WITH l AS ({SQL_LABELS})
SELECT d.doc_id, d.lang, d.source, l.humor_type, l.topic_category FROM documents d JOIN l ON d.doc_id = l.doc_id""")
def join_labels_back(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    lab = lb.label_posts(docs.select("doc_id", "text"), "doc_id", "text")
    return docs.drop("text").join(lab, "doc_id").select("doc_id", "lang", "source", "humor_type", "topic_category")
