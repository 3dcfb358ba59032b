"""Source and sink queries.

Each query first writes archive-shaped data that Spark derives from the driver
tables into a fresh folder under the shared checkpoint location, then reads it
back with the scanner under test, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postmetrics.functions import features as fx
from postmetrics.functions.schema import flatten
from postmetrics.operators import labels as lb
from postmetrics.operators.ordinal import with_global_index
from postmetrics.plans.derived import SQL_ENGINEERED, archive_inputs, engineered
from postmetrics.plans.q_labels import SQL_LABELS, SQL_PAIRS, pairs
from postmetrics.plans.q_rows import SQL_FOLLOW, follow_lists
from postmetrics.plans.registry import r6, register
from postmetrics.session import scratch_path
from postmetrics.sources import archive as ar
from postmetrics.sources import ledger, sinks
from postmetrics.sources.tables import table

# ---------------------------------------------------------------- post archive export


def export_events_archive(spark, d, wrapped: bool = True) -> str:
    """Write events as archive JSON lines ({"tweet": {...}} records); absent values are omitted."""
    a = archive_inputs(spark, d)
    text = F.concat_ws(" ", F.col("full_text"), F.lit("from"), F.concat(F.lit("@user"), F.col("author_id").cast("string")),
                       F.lit("at"), F.date_format("post_datetime", "HH:mm"))
    tweet = F.struct(
        F.col("id_str"),
        F.date_format("post_datetime", fx.ARCHIVE_TIME_WRITE_FORMAT).alias("created_at"),
        text.alias("full_text"),
        F.col("favorite_count"), F.col("retweet_count"),
        F.col("retweeted"), F.col("retweeted_status"), F.col("is_quote_status"), F.col("quoted_status_id_str"),
        F.col("in_reply_to_status_id_str"), F.col("in_reply_to_status_id_str").alias("in_reply_to_status_id"),
        F.col("in_reply_to_user_id_str"),
        F.when(F.col("in_reply_to_user_id_str").isNotNull(), F.concat(F.lit("user"), F.col("in_reply_to_user_id_str")))
         .alias("in_reply_to_screen_name"),
        F.struct(F.col("author_id").cast("string").alias("id_str"),
                 F.concat(F.lit("user"), F.col("author_id").cast("string")).alias("screen_name")).alias("user"),
        F.struct(F.col("urls").alias("urls")).alias("entities"),
    )
    path = scratch_path(spark, "archive-posts")
    out = a.select(tweet.alias("tweet")) if wrapped else a.select(tweet.alias("t")).select("t.*")
    sinks.write_json(out, path)
    return path


SQL_ARCHIVE = "WITH " + SQL_ENGINEERED + """,
x AS (
  SELECT a.*, CAST(post_id AS VARCHAR) AS id_str2,
    full_text || ' from @user' || CAST(author_id AS VARCHAR) || ' at ' || strftime(post_datetime, '%H:%M') AS text2
  FROM a)"""


@register("scan_posts_json", SQL_ARCHIVE + """
SELECT id_str2 AS id_str, strftime(post_datetime, '%a %b %d %H:%M:%S +0000 %Y') AS created_at, text2 AS full_text,
  CAST(engagement AS VARCHAR) AS favorite_count, CAST(k AS VARCHAR) AS retweet_count,
  CAST(author_id AS VARCHAR) AS user_id_str FROM x""")
def scan_posts_json(spark, d):
    p = ar.load_posts(spark, export_events_archive(spark, d))
    return p.select("id_str", "created_at", "full_text", "favorite_count", "retweet_count",
                    F.col("user.id_str").alias("user_id_str"))


@register("scan_posts_mixed", SQL_ARCHIVE + """
SELECT id_str2 AS id_str, CASE k % 3 WHEN 0 THEN 'lines' WHEN 1 THEN 'array' ELSE 'object' END AS kind, text2 AS full_text,
  CAST(author_id AS VARCHAR) AS user_id_str FROM x WHERE k IS NOT NULL""")
def scan_posts_mixed(spark, d):
    """One folder with JSON lines, arrays and objects with ``tweets``, read in one call."""
    posts_ = spark.read.json(export_events_archive(spark, d), schema="tweet string").select("tweet")
    keyed = posts_.select("tweet", F.get_json_object("tweet", "$.retweet_count").cast("bigint").alias("k")).where("k IS NOT NULL")
    root = scratch_path(spark, "mixed-archive")
    sinks.write_text_lines(keyed.where("k % 3 = 0").select(F.concat(F.lit('{"tweet": '), "tweet", F.lit("}")).alias("value")), "value", f"{root}/lines")
    # documents over several lines: each file is one partition, streamed between its head and foot
    for name, kind, head, foot in (("array", 1, "[", "]"), ("object", 2, '{"tweets": [', "]}")):
        rows = keyed.where(F.col("k") % 3 == kind)
        wrap = F.concat(F.lit('{"tweet": '), "tweet", F.lit("}")) if name == "object" else F.col("tweet")
        files = rows.select((F.col("k") % 12).cast("int").alias("file"), F.lit(1).alias("part"), wrap.alias("value"))
        firsts = files.groupBy("file").agg(F.min("value").alias("_first"))
        body = files.join(F.broadcast(firsts), "file").select(
            "file", F.when(F.col("value") == F.col("_first"), 1).otherwise(2).alias("part"),
            F.when(F.col("value") == F.col("_first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
        ends = firsts.select("file", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit(head).alias("value")),
                                                       F.struct(F.lit(3).alias("part"), F.lit(foot).alias("value")))).alias("e"))
        whole = body.unionByName(ends.select("file", "e.part", "e.value"))
        whole.repartition("file").sortWithinPartitions("file", "part").select("file", "value").write.partitionBy("file").text(f"{root}/{name}")
    p = ar.load_posts(spark, root, "per_file")
    k = F.col("retweet_count").cast("bigint")
    kind = F.when(k % 3 == 0, "lines").when(k % 3 == 1, "array").otherwise("object")
    return p.select("id_str", kind.alias("kind"), "full_text", F.col("user.id_str").alias("user_id_str"))


@register("scan_flatten", SQL_ARCHIVE + """
SELECT id_str2 AS id_str, CAST(author_id AS VARCHAR) AS "user.id_str", 'user' || CAST(author_id AS VARCHAR) AS "user.screen_name",
  CASE WHEN rt_struct THEN id_str2 END AS "retweeted_status.id_str" FROM x""")
def scan_flatten(spark, d):
    flat = flatten(ar.load_posts(spark, export_events_archive(spark, d)))
    return flat.select("id_str", "`user.id_str`", "`user.screen_name`", "`retweeted_status.id_str`")


@register("scan_posts_projection", SQL_ARCHIVE + f"""
SELECT id_str2 AS id, text2 AS text, strftime(post_datetime, '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
  k AS retweet_count, CAST(trunc(engagement) AS BIGINT) AS favorite_count,
  CAST(trunc(engagement) AS BIGINT) + 10 * k AS weighted_engagement,
  reply_status IS NOT NULL AS is_reply,
  'user' || reply_to AS reply_to_screen_name,
  CAST(length(text2) AS INTEGER) AS char_count
FROM x WHERE length(regexp_replace(text2, '^{fx.WHITESPACE_CLASS}+|{fx.WHITESPACE_CLASS}+$', '', 'g')) > 15""")
def scan_posts_projection(spark, d):
    p = ar.load_posts(spark, export_events_archive(spark, d))
    rt, fav = fx.coerce_count("retweet_count"), fx.coerce_count("favorite_count")
    return p.where(fx.min_length("full_text", 15)).select(
        F.col("id_str").alias("id"), F.coalesce(F.col("full_text"), F.lit("")).alias("text"), "created_at",
        rt.alias("retweet_count"), fav.alias("favorite_count"), fx.weighted_engagement(fav, rt).alias("weighted_engagement"),
        fx.is_reply("in_reply_to_status_id").alias("is_reply"), F.col("in_reply_to_screen_name").alias("reply_to_screen_name"),
        fx.text_length("full_text").alias("char_count"))

# ---------------------------------------------------------------- relation lists


def export_relations(spark, d):
    following, followers = follow_lists(spark, d)
    link = lambda c: F.concat(F.lit("https://example.com/intent/user?user_id="), c)
    paths = {}
    for key, ids in (("following", following), ("follower", followers)):
        rec = F.struct(F.col("account_id").cast("string").alias("accountId"),
                       link(F.col("account_id").cast("string")).alias("userLink"))
        paths[key] = sinks.write_json(ids.select(rec.alias(key)), scratch_path(spark, f"archive-{key}"))
    return paths


@register("scan_relation_ids", "WITH " + SQL_FOLLOW + """
SELECT 'following' AS list, CAST(account_id AS VARCHAR) AS account_id FROM following
UNION ALL SELECT 'follower', CAST(account_id AS VARCHAR) FROM followers""")
def scan_relation_ids(spark, d):
    paths = export_relations(spark, d)
    a = ar.load_relation_ids(spark, paths["following"], "following").select(F.lit("following").alias("list"), "account_id")
    b = ar.load_relation_ids(spark, paths["follower"], "follower").select(F.lit("follower").alias("list"), "account_id")
    return a.unionByName(b)


def mutual_ids(spark, d):
    a, b = follow_lists(spark, d)
    return a.join(b, "account_id", "left_semi").select(F.col("account_id").cast("string").alias("id"))


SQL_MUTUAL = "WITH " + SQL_FOLLOW + """,
m AS (SELECT CAST(account_id AS VARCHAR) AS id FROM following WHERE account_id IN (SELECT account_id FROM followers))"""


@register("scan_json_ids", SQL_MUTUAL + " SELECT id FROM m")
def scan_json_ids(spark, d):
    path = sinks.write_json(mutual_ids(spark, d), scratch_path(spark, "mutual-ids"))
    return spark.read.schema("id string").json(path)


@register("sink_text", SQL_MUTUAL + " SELECT id FROM m")
def sink_text(spark, d):
    path = sinks.write_text_lines(mutual_ids(spark, d), "id", scratch_path(spark, "mutual-ids-txt"))
    return spark.read.text(path).select(F.col("value").alias("id"))

# ---------------------------------------------------------------- account batches


def account_table(spark, d):
    """Account records keyed by id (customers + nation + their latest order)."""
    from postmetrics.operators.joins import latest_per_key
    c = table(spark, d, "customer")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    last = latest_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(last, c["c_custkey"] == last["o_custkey"], "left")
    return j.select(
        F.col("c_custkey").cast("string").alias("id"), F.lower("c_name").alias("username"), F.col("c_name").alias("name"),
        F.col("n_name").alias("location"), F.col("c_mktsegment").alias("description"),
        F.lit(None).cast("string").alias("affiliation"),
        F.col("o_orderkey").cast("string").alias("most_recent_tweet_id"),
        F.floor("c_acctbal").cast("bigint").alias("followers_count"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("tweet_created_at"))


SQL_ACCOUNTS = """
WITH last AS (SELECT o_custkey, o_orderkey, o_orderdate,
                ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
acc AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS id, lower(c.c_name) AS username, c.c_name AS name, n.n_name AS location,
    c.c_mktsegment AS description, CAST(NULL AS VARCHAR) AS affiliation,
    CAST(l.o_orderkey AS VARCHAR) AS most_recent_tweet_id,
    CAST(floor(c.c_acctbal) AS BIGINT) AS followers_count,
    strftime(l.o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS tweet_created_at, c.c_custkey
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN last l ON c.c_custkey = l.o_custkey AND l.rn = 1)"""


def with_batches(df, key: str, size: int = 100):
    """Chunks of ``size`` ids in key order (distributed positions, no single-task window)."""
    idx = with_global_index(df, [F.col(key)], "_i")
    return idx.withColumn("batch", F.floor(F.col("_i") / F.lit(size)).cast("int")).drop("_i")


def write_account_batches(spark, d) -> str:
    """One JSON document per 100-account batch: {data: [...], includes: {tweets: [...]}}.
    Each collect is bounded by the batch size."""
    acc = with_batches(account_table(spark, d).withColumn("id_num", F.col("id").cast("bigint")), "id_num", 100)
    user = F.struct("id", "username", "name", "location", "description", "affiliation", "most_recent_tweet_id",
                    F.struct("followers_count").alias("public_metrics"))
    tweet = F.when(F.col("most_recent_tweet_id").isNotNull(),
                   F.struct(F.col("most_recent_tweet_id").alias("id"), F.col("tweet_created_at").alias("created_at")))
    docs = acc.groupBy("batch").agg(F.collect_list(user).alias("data"),
                                    F.struct(F.collect_list(tweet).alias("tweets")).alias("includes"))
    path = scratch_path(spark, "account-batches")
    docs.write.json(path)  # one line per batch
    return path


@register("scan_multi_json", SQL_ACCOUNTS + " SELECT id, username, followers_count FROM acc")
def scan_multi_json(spark, d):
    users, _ = ar.load_account_batches(spark, write_account_batches(spark, d), one_per_line=True)
    return users.select("id", "username", F.col("public_metrics.followers_count").alias("followers_count"))


@register("proj_struct_flatten_user", SQL_ACCOUNTS + """
SELECT id, username, name, location, description, affiliation, most_recent_tweet_id,
  tweet_created_at AS most_recent_tweet_date, followers_count FROM acc""")
def proj_struct_flatten_user(spark, d):
    users, tweets = ar.load_account_batches(spark, write_account_batches(spark, d), one_per_line=True)
    return ar.flatten_users(users, tweets)


@register("fetch_accounts", SQL_MUTUAL + """,
acc2 AS (SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) AS username, CAST(floor(c_acctbal) AS BIGINT) AS followers_count
         FROM customer)
SELECT m.id, CAST((ROW_NUMBER() OVER (ORDER BY CAST(m.id AS BIGINT)) - 1) // 100 AS INTEGER) AS batch,
  acc2.username, acc2.followers_count
FROM m LEFT JOIN acc2 ON m.id = acc2.id""")
def fetch_accounts(spark, d):
    """Mutual ids in 100-id batches, enriched by a left join with the account table."""
    ids = with_batches(mutual_ids(spark, d).withColumn("_n", F.col("id").cast("bigint")), "_n", 100).drop("_n")
    acc = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"),
                                             F.lower("c_name").alias("username"),
                                             F.floor("c_acctbal").cast("bigint").alias("followers_count"))
    return ids.join(acc, "id", "left").select("id", "batch", "username", "followers_count")



def _directory(ids):
    """Stand-in for the account service: a record per id."""
    return [{"id": i, "username": f"user{i}", "followers_count": int(i) * 7 % 1000} for i in ids]


def _directory_down(ids):
    """The service while the batch that holds customer 201 cannot be fetched."""
    if "201" in ids:
        raise TimeoutError("no answer")
    return _directory(ids)


@register("fetch_accounts_ledger", """
SELECT CAST(c_custkey AS VARCHAR) AS id, b AS batch, 'user' || c_custkey AS username, (c_custkey * 7) % 1000 AS followers_count,
       CASE WHEN b = 2 THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN b = 2 THEN 'failed' ELSE 'done' END AS first_state
FROM (SELECT *, CAST((ROW_NUMBER() OVER (ORDER BY c_custkey) - 1) // 100 AS INTEGER) AS b FROM customer)""")
def fetch_accounts_ledger(spark, d):
    """Accounts of all customers in 100-id batches: in the first run one batch fails and is passed over,
    the second run asks for that one only."""
    wanted = _customer_batches(spark, d).select(F.col("c_custkey").cast("string").alias("id"), F.col("batch").cast("int").alias("batch"))
    path, fields = scratch_path(spark, "accounts"), "id string, username string, followers_count bigint"
    ledger.fetch_batches(spark, wanted, _directory_down, path, fields)
    first = ledger.ledger(spark, path).select("batch", F.col("state").alias("first_state"))
    rows = ledger.fetch_batches(spark, wanted, _directory, path, fields)
    return rows.join(ledger.ledger(spark, path).select("batch", "attempts"), "batch").join(first, "batch")


# ---------------------------------------------------------------- resume


def _customer_batches(spark, d):
    return with_batches(table(spark, d, "customer").select("c_custkey"), "c_custkey", 100)


def _partial_run(spark, d, path, first_batches: int = 3):
    """An earlier, interrupted run: the first batches, and every second row of the next one."""
    b = _customer_batches(spark, d)
    half = (F.col("batch") == first_batches) & (F.col("c_custkey") % 2 == 0)
    sinks.publish(b.where((F.col("batch") < first_batches) | half), path)
    return b


@register("join_anti_resume", """
SELECT c_custkey FROM (SELECT c_custkey, (ROW_NUMBER() OVER (ORDER BY c_custkey) - 1) // 100 AS batch FROM customer)
WHERE batch > 3 OR (batch = 3 AND c_custkey % 2 <> 0)""")
def join_anti_resume(spark, d):
    path = scratch_path(spark, "resume")
    wanted = _partial_run(spark, d, path)
    return wanted.join(sinks.published(spark, path), "c_custkey", "left_anti").select("c_custkey")


@register("sink_resume", """
SELECT c_custkey, CAST((ROW_NUMBER() OVER (ORDER BY c_custkey) - 1) // 100 AS INTEGER) AS batch FROM customer""")
def sink_resume(spark, d):
    path = scratch_path(spark, "resume")
    wanted = _partial_run(spark, d, path)
    final, _ = sinks.resume_batches(spark, wanted, "batch", path, lambda todo: todo, ["c_custkey"], groups=3)
    return final.select("c_custkey", F.col("batch").cast("int").alias("batch"))

# ---------------------------------------------------------------- other sinks


@register("sink_parquet", "WITH " + SQL_ENGINEERED + """
SELECT month, count(*) AS n, CAST(sum(total_engagement) AS BIGINT) AS total_engagement FROM eng GROUP BY month""")
def sink_parquet(spark, d):
    path = sinks.write_parquet(engineered(spark, d, cap=True).drop("post_datetime"), scratch_path(spark, "engineered"), ["month"])
    back = spark.read.parquet(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("total_engagement").alias("total_engagement"))


@register("sink_csv", SQL_PAIRS + """
SELECT model, count(*) AS n, round_even(sum(m / 5.0), 6) AS total_agreement FROM agree GROUP BY model""")
def sink_csv(spark, d):
    p = pairs(spark, d)
    rows = p.select("doc_id", "model", (lb.agreement_matches(p) / F.lit(5.0)).alias("agreement_score"),
                    *[c for f in lb.LABEL_FIELDS for c in (f, f"truth_{f}")])
    path = sinks.write_csv(rows, scratch_path(spark, "evaluation-csv"))
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("agreement_score")).alias("total_agreement"))


@register("scan_csv", f"""
WITH l AS ({SQL_LABELS})
SELECT d.doc_id, CAST(length(d.text) AS INTEGER) AS text_length, l.humor_type, l.has_data_reference
FROM documents d JOIN l ON d.doc_id = l.doc_id""")
def scan_csv(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lab = lb.label_posts(docs, "doc_id", "text")
    out = docs.join(lab, "doc_id")
    path = sinks.write_csv(out, scratch_path(spark, "labelled-csv"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    back = ar.read_labelled_csv(spark, path, ddl)
    return back.select("doc_id", fx.text_length("text").alias("text_length"), "humor_type", "has_data_reference")


@register("scan_csv_inferred", f"""
WITH l AS ({SQL_LABELS})
SELECT d.doc_id, d.text AS text, d.n_chars, d.n_chars / 8.0 AS ratio, CAST('2024-01-01' AS DATE) + CAST(d.doc_id % 300 AS INTEGER) AS day,
  l.humor_type, l.has_data_reference FROM documents d JOIN l ON d.doc_id = l.doc_id""")
def scan_csv_inferred(spark, d):
    """A labelled CSV read without a schema: whole numbers, fractions, dates, flags and texts."""
    docs = table(spark, d, "documents").select(
        "doc_id", "text", "n_chars", (F.col("n_chars") / 8.0).alias("ratio"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")).alias("day"))
    lab = lb.label_posts(docs, "doc_id", "text").select("doc_id", "humor_type", "has_data_reference")
    path = sinks.write_csv(docs.join(lab, "doc_id"), scratch_path(spark, "inferred-csv"))
    return ar.read_inferred_csv(spark, path)


RUN_DDL = "model_used string, total_tweets_classified bigint, date_classified string"


@register("scan_run_metadata", """
SELECT 'complete' AS run, 'keyword_rules' AS model_used, count(*) AS total_tweets_classified, 'unknown' AS date_classified FROM documents
UNION ALL SELECT 'none', 'unknown', 0, 'unknown'""")
def scan_run_metadata(spark, d):
    """Run metadata of a run (without its date) and of a folder that holds none, with placeholders."""
    meta = table(spark, d, "documents").agg(F.count("*").alias("total_tweets_classified")).withColumn("model_used", F.lit("keyword_rules"))
    path = sinks.write_json(meta, scratch_path(spark, "run-metadata"))
    defaults = {"model_used": "unknown", "total_tweets_classified": 0, "date_classified": "unknown"}
    runs = [ar.read_json_metadata(spark, p, RUN_DDL, defaults).select(F.lit(name).alias("run"), "*")
            for name, p in (("complete", path), ("none", scratch_path(spark, "no-metadata")))]
    return runs[0].unionByName(runs[1])


@register("sink_json", """
SELECT 'keyword_rules' AS model_used, count(*) AS total_tweets_classified,
  'Selected model based on agreement with the truth labeler' AS methodology FROM documents""")
def sink_json(spark, d):
    lab = lb.label_posts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    meta = lab.agg(F.count(F.lit(1)).alias("total_tweets_classified")).select(
        F.lit("keyword_rules").alias("model_used"), "total_tweets_classified",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("date_classified"),
        F.lit("Selected model based on agreement with the truth labeler").alias("methodology"))
    path = sinks.write_json(meta, scratch_path(spark, "run-metadata"))
    back = spark.read.schema("model_used string, total_tweets_classified bigint, date_classified string, "
                             "methodology string").json(path)
    return back.select("model_used", "total_tweets_classified", "methodology")


@register("scan_kv_metadata", SQL_PAIRS + """
SELECT model AS selected_model FROM scores ORDER BY mean DESC, model LIMIT 1""")
def scan_kv_metadata(spark, d):
    scores = lb.model_scores(pairs(spark, d))
    best = lb.best_labeler(scores)
    lines = best.select(F.explode(F.array(
        F.concat(F.lit("Selected Model: "), F.col("best_model")),
        F.concat(F.lit("Agreement: "), F.format_number(F.col("agreement") * 100, 1), F.lit("%")),
        F.lit("Methodology: fresh test set, truth labeler as reference"))).alias("value"))
    path = scratch_path(spark, "selected-model")
    lines.coalesce(1).write.text(path)  # three lines
    return ar.read_kv_first_line(spark, path).select(F.col("value").alias("selected_model"))
