"""Batch labelling of posts through a pluggable labeler, validation, labeler evaluation.

The default labeler is an offline keyword rule set (no network).  Rule sets are plain data and are
compiled: to Column expressions (``rule_columns``), so that labelling stays inside the JVM and adds
no shuffle and no Python worker, and to SQL for the oracle.

Any other *labeler* is a picklable callable ``texts: pandas.Series -> pandas.Series``
of reply strings (JSON with the five label fields), ``None`` for a failed call.
It runs inside ``mapInPandas`` on Arrow batches, so parallelism is the number
of partitions and the batch size is ``spark.sql.execution.arrow.maxRecordsPerBatch``.
Validation is native Spark (``from_json`` + NULL checks): an invalid reply, a
missing field or a failed call gives the neutral record, as in the reference.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_SCHEMA = T.StructType([
    T.StructField("humor_type", T.StringType()),
    T.StructField("topic_category", T.StringType()),
    T.StructField("has_data_reference", T.BooleanType()),
    T.StructField("shows_vulnerability", T.BooleanType()),
    T.StructField("critique_type", T.StringType()),
])
LABEL_FIELDS = [f.name for f in LABEL_SCHEMA.fields]

# The neutral record used whenever a reply is unusable.
NEUTRAL = {"humor_type": "none", "topic_category": "general", "has_data_reference": False,
           "shows_vulnerability": False, "critique_type": "none"}

# Label domains of the classification prompt.
HUMOR_TYPES = ["absurdist", "self_deprecating", "observational", "none"]
TOPICS = ["tech", "housing", "religion", "politics", "social_commentary", "personal", "general"]
CRITIQUES = ["systemic", "institutional", "personal", "none"]

PROMPT_TEMPLATE = "{instructions}\n\nText:\n{text}"


@dataclass(frozen=True)
class KeywordRules:
    """Offline labeler: first matching (label, keywords) wins; matching is on
    ' ' + lower(text) + ' ' by substring."""
    humor: Sequence[tuple[str, Sequence[str]]]
    topic: Sequence[tuple[str, Sequence[str]]]
    data_reference: Sequence[str]
    vulnerability: Sequence[str]
    critique: Sequence[tuple[str, Sequence[str]]]


DEFAULT_RULES = KeywordRules(
    humor=[("absurdist", ["!"]), ("self_deprecating", [" was "]), ("observational", [" that "])],
    topic=[("tech", [" data ", " code ", " software "]), ("housing", [" house ", " rent "]),
           ("religion", [" que "]), ("politics", [" der "]), ("social_commentary", [" les "]),
           ("personal", [" it "])],
    data_reference=list("0123456789"),
    vulnerability=[" be "],
    critique=[("systemic", [" of the "]), ("institutional", [" by "]), ("personal", [" you "])],
)


@dataclass
class KeywordLabeler:
    rules: KeywordRules = field(default_factory=lambda: DEFAULT_RULES)

    def __call__(self, texts: pd.Series) -> pd.Series:
        return self.label_prepared(prepare_texts(texts), {}, texts.index)

    def label_prepared(self, t, cache: dict, index) -> pd.Series:
        """Label Arrow texts already lower-cased and space-padded; ``cache`` shares keyword
        hits between labelers that look at the same batch."""
        n = len(t)

        def hits(kws):
            out = np.zeros(n, dtype=bool)
            for kw in kws:
                if kw not in cache:
                    cache[kw] = pc.match_substring(t, kw).to_numpy(zero_copy_only=False)
                out |= cache[kw]
            return out

        def first(rule_list, default):
            out = np.full(n, default, dtype=object)
            done = np.zeros(n, dtype=bool)
            for label, kws in rule_list:
                hit = hits(kws) & ~done
                out[hit] = label
                done |= hit
            return out

        def js(x):
            return np.where(x, "true", "false").astype(object)

        reply = ('{"humor_type": "' + first(self.rules.humor, NEUTRAL["humor_type"])
                 + '", "topic_category": "' + first(self.rules.topic, NEUTRAL["topic_category"])
                 + '", "has_data_reference": ' + js(hits(self.rules.data_reference))
                 + ', "shows_vulnerability": ' + js(hits(self.rules.vulnerability))
                 + ', "critique_type": "' + first(self.rules.critique, NEUTRAL["critique_type"]) + '"}')
        replies = pd.Series(reply, index=index, dtype="object")
        return replies


def prepare_texts(texts: pd.Series):
    """Arrow array of ' ' + lower(text) + ' ' (NULL -> ''), computed once per batch."""
    arr = pa.array(texts.astype(object).where(texts.notna(), ""), type=pa.large_string())
    sp = pa.scalar(" ", type=pa.large_string())
    return pc.binary_join_element_wise(sp, pc.utf8_lower(arr), sp, pa.scalar("", type=pa.large_string()))


Labeler = Callable[[pd.Series], pd.Series]


@dataclass
class PromptLabeler:
    """Adapter for an external text classifier: builds one prompt per post from
    ``PROMPT_TEMPLATE`` and hands the whole Arrow batch of prompts to ``call``
    (``list[str] -> list[str | None]``, e.g. a batched client).  Replies are validated
    like any other labeler's; a failing call yields the neutral record."""
    call: Callable[[list], list]
    instructions: str

    def __call__(self, texts: pd.Series) -> pd.Series:
        prompts = [PROMPT_TEMPLATE.format(instructions=self.instructions, text=t if t is not None else "")
                   for t in texts.tolist()]
        return pd.Series(self.call(prompts), index=texts.index, dtype="object")


def _safe_call(labeler: Labeler, texts: pd.Series) -> pd.Series:
    """Replies of a batch; a failing batch is halved until only the failing texts are without one."""
    try:
        out = labeler(texts)
        return pd.Series(out, index=texts.index, dtype="object")
    except Exception:
        if len(texts) <= 1:  # behaves like an unusable reply -> neutral
            return pd.Series([None] * len(texts), index=texts.index, dtype="object")
        half = len(texts) // 2
        return pd.concat([_safe_call(labeler, texts.iloc[:half]), _safe_call(labeler, texts.iloc[half:])])


def label_replies(df: DataFrame, id_col: str, text_col: str, labelers: Mapping[str, Labeler],
                  model_col: str = "model") -> DataFrame:
    """(id, model, reply) for every post and labeler; labelers run in ``mapInPandas``.

    Each text crosses the JVM/Python boundary once; every labeler sees the same
    Arrow batch and the batch fans out to one reply row per labeler.
    """
    names = list(labelers)
    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    id_type = df.schema[id_col].dataType.simpleString()
    lab = dict(labelers)
    shared = all(isinstance(x, KeywordLabeler) for x in lab.values())

    def run(batches):
        for pdf in batches:
            replies = None
            if shared:
                try:
                    t, cache = prepare_texts(pdf["_text"]), {}
                    replies = {name: lab[name].label_prepared(t, cache, pdf.index) for name in names}
                except Exception:  # fall back to isolated calls (each failure -> neutral)
                    replies = None
            if replies is None:
                replies = {name: _safe_call(lab[name], pdf["_text"]) for name in names}
            parts = [pd.DataFrame({"_id": pdf["_id"].to_numpy(), model_col: name,
                                   "reply": replies[name].to_numpy()}) for name in names]
            yield pd.concat(parts, ignore_index=True)

    out = src.mapInPandas(run, f"_id {id_type}, {model_col} string, reply string")
    return out.withColumnRenamed("_id", id_col)


def validate(reply: Column) -> list[Column]:
    """Parse a reply into the five fields; invalid JSON or any missing field -> neutral record."""
    parsed = F.from_json(reply, LABEL_SCHEMA, {"mode": "PERMISSIVE"})
    ok = F.lit(True)
    for f in LABEL_FIELDS:
        ok = ok & parsed[f].isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return [F.when(ok, parsed[f]).otherwise(F.lit(NEUTRAL[f])).alias(f) for f in LABEL_FIELDS]


def keywords(rules: KeywordRules) -> list[str]:
    """Every keyword of a rule set."""
    lists = [k for _, k in (*rules.humor, *rules.topic, *rules.critique)] + [rules.data_reference, rules.vulnerability]
    return [k for words in lists for k in words]


def rule_columns(rules: KeywordRules, hit: Mapping[str, Column]) -> dict[str, Column]:
    """The five label fields of a rule set from ``hit``, the boolean column of every keyword."""
    def any_of(words):
        out = F.lit(False)
        for k in words:
            out = out | hit[k]
        return out

    def first_of(listed, default):
        out = None
        for label, words in listed:
            out = F.when(any_of(words), label) if out is None else out.when(any_of(words), label)
        return F.lit(default) if out is None else out.otherwise(default)

    return {"humor_type": first_of(rules.humor, NEUTRAL["humor_type"]), "topic_category": first_of(rules.topic, NEUTRAL["topic_category"]),
            "has_data_reference": any_of(rules.data_reference), "shows_vulnerability": any_of(rules.vulnerability),
            "critique_type": first_of(rules.critique, NEUTRAL["critique_type"])}


def _hits(df: DataFrame, id_col: str, text_col: str, rule_sets: Sequence[KeywordRules]) -> tuple[DataFrame, dict[str, Column]]:
    """One boolean column per distinct keyword of the rule sets: a text is searched once for each."""
    words = sorted({k for rules in rule_sets for k in keywords(rules)})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    padded = df.select(id_col, F.concat(F.lit(" "), F.lower(text), F.lit(" ")).alias("_padded"))
    found = padded.select(id_col, *[F.col("_padded").contains(k).alias(f"_h{i}") for i, k in enumerate(words)])
    return found, {k: F.col(f"_h{i}") for i, k in enumerate(words)}


def label_posts(df: DataFrame, id_col: str, text_col: str, labeler: Labeler | None = None) -> DataFrame:
    """(id, five label fields) for every post with one labeler; a keyword rule set is compiled."""
    labeler = labeler or KeywordLabeler()
    if isinstance(labeler, KeywordLabeler):
        found, hit = _hits(df, id_col, text_col, [labeler.rules])
        fields = rule_columns(labeler.rules, hit)
        return found.select(id_col, *[fields[f].alias(f) for f in LABEL_FIELDS])
    r = label_replies(df, id_col, text_col, {"labeler": labeler})
    return r.select(id_col, *validate(F.col("reply")))


def label_posts_multi(df: DataFrame, id_col: str, text_col: str, labelers: Mapping[str, Labeler]) -> DataFrame:
    """Long table (id, model, five fields) for several labelers; rule sets alone are compiled."""
    if all(isinstance(x, KeywordLabeler) for x in labelers.values()):
        found, hit = _hits(df, id_col, text_col, [x.rules for x in labelers.values()])
        records = []
        for name, labeler in labelers.items():
            fields = rule_columns(labeler.rules, hit)
            records.append(F.struct(F.lit(name).alias("model"), *[fields[f].alias(f) for f in LABEL_FIELDS]))
        return found.select(id_col, F.explode(F.array(*records)).alias("r")).select(id_col, "r.*")
    r = label_replies(df, id_col, text_col, labelers)
    return r.select(id_col, "model", *validate(F.col("reply")))


def truth_pairs(long: DataFrame, id_col: str, truth: str) -> DataFrame:
    """Each candidate's labels next to the truth labeler's labels for the same post
    (posts without a truth row are skipped).

    A post has one row per labeler - a group bounded by the labeler count - so a
    window over the post id pairs them without a self-join (which would run the
    Python labelers twice).
    """
    rec = F.struct(*[F.col(f).alias(f"truth_{f}") for f in LABEL_FIELDS])
    w = Window.partitionBy(id_col)
    paired = long.withColumn("_t", F.max(F.when(F.col("model") == truth, rec)).over(w))
    return (paired.where((F.col("model") != truth) & F.col("_t").isNotNull())
            .select(id_col, "model", *LABEL_FIELDS, "_t.*"))


def agreement_matches(pairs: DataFrame) -> Column:
    """Number of the five fields on which candidate and truth agree (NULL-safe)."""
    m = F.lit(0)
    for f in LABEL_FIELDS:
        m = m + F.col(f).eqNullSafe(F.col(f"truth_{f}")).cast("int")
    return m


def evaluation_detail(pairs: DataFrame, posts: DataFrame, id_col: str, text_col: str, value_col: str) -> DataFrame:
    """The 13-column evaluation table: post, text, engagement, model, agreement, and four of the five
    fields (humor, topic, data reference, vulnerability) of the truth labeler and of the model."""
    scored = pairs.withColumn("agreement_score", agreement_matches(pairs) / F.lit(5.0))
    shown = {"humor": "humor_type", "topic": "topic_category", "has_data": "has_data_reference", "vulnerable": "shows_vulnerability"}
    joined = scored.join(posts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(value_col).alias("_value")),
                         F.col(id_col) == F.col("_id"), "left")
    return joined.select(id_col, F.col("_text").alias("text"), F.col("_value").alias("engagement"), "model", "agreement_score",
                         *[F.col(f"{side}{field}").alias(f"{who}_{short}") for short, field in shown.items()
                           for who, side in (("truth", "truth_"), ("model", ""))])


def model_scores(pairs: DataFrame, digits: int = 3) -> DataFrame:
    """mean / count / sample std of the agreement score per model."""
    a = pairs.select("model", agreement_matches(pairs).alias("_m"))
    g = a.groupBy("model").agg(F.sum("_m").alias("_s"), F.count(F.lit(1)).alias("count"),
                               F.stddev_samp(F.col("_m") / F.lit(5.0)).alias("std"))
    from postmetrics.functions.numeric import round_half_even as rnd
    return g.select("model", rnd(F.col("_s") / (F.lit(5.0) * F.col("count")), digits).alias("mean"), "count",
                    rnd(F.col("std"), digits).alias("std"))


def best_labeler(scores: DataFrame) -> DataFrame:
    """Highest mean agreement (ties -> model name), O(1) state."""
    return scores.agg(F.min_by(F.struct("model", "mean"), F.struct(-F.col("mean"), F.col("model"))).alias("b")) \
        .select(F.col("b.model").alias("best_model"), F.col("b.mean").alias("agreement"))


# ---------------------------------------------------------------- SQL generation for the oracle

def rules_sql(rules: KeywordRules, text: str = "text") -> dict[str, str]:
    """The same rules as DuckDB expressions over ``text``."""
    t = f"(' ' || lower(COALESCE({text}, '')) || ' ')"

    def anyc(kws):
        return "(" + " OR ".join(f"contains({t}, '{_q(k)}')" for k in kws) + ")"

    def first(rule_list, default):
        return "CASE " + " ".join(f"WHEN {anyc(k)} THEN '{lab}'" for lab, k in rule_list) + f" ELSE '{default}' END"

    return {
        "humor_type": first(rules.humor, NEUTRAL["humor_type"]),
        "topic_category": first(rules.topic, NEUTRAL["topic_category"]),
        "has_data_reference": anyc(rules.data_reference),
        "shows_vulnerability": anyc(rules.vulnerability),
        "critique_type": first(rules.critique, NEUTRAL["critique_type"]),
    }


def _q(s: str) -> str:
    return s.replace("'", "''")
