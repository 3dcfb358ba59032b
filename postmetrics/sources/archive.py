"""Archive exports: posts (bare or wrapped in ``tweet``), relation lists, account batches.

Shapes accepted by ``load_posts`` (auto-detected from the first line):
JSON lines of wrapped or bare records; a JSON array of either; one object with
a ``tweets`` list (single-line or pretty-printed); any other object is taken as
one record; a scalar document raises ``ValueError``; an empty file gives no rows.  A folder may mix
files of all shapes (``shape="per_file"``).

Whole-document JSON (``multiLine``) is parsed one task per file, so large
archives should be converted once to partitioned parquet (``sinks.write_parquet``);
JSON lines split across tasks.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmetrics.session import path_exists

# Canonical post schema (fields the features read, plus the nested entities).
POST_DDL = """
id_str STRING, id STRING, created_at STRING, full_text STRING, text STRING, lang STRING, source STRING,
favorite_count STRING, retweet_count STRING, reply_count STRING, bookmark_count STRING,
retweeted BOOLEAN, favorited BOOLEAN, truncated BOOLEAN, possibly_sensitive BOOLEAN,
is_quote_status BOOLEAN, quoted_status_id_str STRING, retweeted_status STRUCT<id_str: STRING>,
in_reply_to_status_id_str STRING, in_reply_to_status_id STRING,
in_reply_to_user_id_str STRING, in_reply_to_user_id STRING, in_reply_to_screen_name STRING,
user STRUCT<id_str: STRING, screen_name: STRING>,
display_text_range ARRAY<STRING>,
entities STRUCT<
  hashtags: ARRAY<STRUCT<text: STRING, indices: ARRAY<STRING>>>,
  symbols: ARRAY<STRUCT<text: STRING, indices: ARRAY<STRING>>>,
  urls: ARRAY<STRUCT<url: STRING, expanded_url: STRING, display_url: STRING, indices: ARRAY<STRING>>>,
  user_mentions: ARRAY<STRUCT<name: STRING, screen_name: STRING, indices: ARRAY<STRING>, id_str: STRING, id: STRING>>,
  media: ARRAY<STRUCT<id_str: STRING, type: STRING, media_url_https: STRING, expanded_url: STRING>>>,
extended_entities STRUCT<media: ARRAY<STRUCT<id_str: STRING, id: STRING, type: STRING, url: STRING,
  expanded_url: STRING, display_url: STRING, media_url: STRING, media_url_https: STRING, indices: ARRAY<STRING>>>>
"""


def post_schema() -> T.StructType:
    """The canonical post ``StructType`` (parsed lazily: DDL parsing needs a session)."""
    global _POST_SCHEMA
    if _POST_SCHEMA is None:
        _POST_SCHEMA = T._parse_datatype_string(POST_DDL.replace("\n", " ").strip())
    return _POST_SCHEMA


_POST_SCHEMA = None

RELATION_SCHEMA = "STRUCT<accountId: STRING, userLink: STRING>"

ACCOUNT_BATCH_DDL = """
data ARRAY<STRUCT<id: STRING, username: STRING, name: STRING, location: STRING, description: STRING,
  affiliation: STRING, most_recent_tweet_id: STRING, public_metrics: STRUCT<followers_count: BIGINT>>>,
includes STRUCT<tweets: ARRAY<STRUCT<id: STRING, created_at: STRING>>>
"""


def _wrapper_schema() -> T.StructType:
    POST_SCHEMA = post_schema()
    fields = [T.StructField("tweets", T.ArrayType(T.StructType(
        [T.StructField("tweet", POST_SCHEMA)] + list(POST_SCHEMA.fields)))),
              T.StructField("tweet", POST_SCHEMA)] + list(POST_SCHEMA.fields)
    return T.StructType(fields)


def detect_shape(spark: SparkSession, path: str) -> str:
    """'lines' | 'document' | 'empty' from the first non-blank line of the input.

    Only the first and last characters of that line reach the driver (a single-line
    archive is one line holding the whole document): '[' -> a JSON array document;
    '{' ... '}' -> JSON lines (a one-line object is a one-row JSON-lines file); a
    line opening '{' without closing it -> a pretty-printed document; else an error.
    """
    line = F.trim(F.col("value"))
    first = (spark.read.text(path).where(line != "")
             .select(F.substring(line, 1, 1).alias("a"), F.substring(F.reverse(line), 1, 1).alias("z"))
             .limit(1).collect())
    if not first:
        return "empty"
    a, z = first[0]["a"], first[0]["z"]
    if a == "[":
        return "document"
    if a == "{":
        return "lines" if z == "}" else "document"
    raise ValueError(f"{path}: the first line opens neither a JSON object nor an array")


def file_shapes(spark: SparkSession, path: str) -> DataFrame:
    """file, shape ('lines', 'document' or 'bad') of every file below ``path`` that is not blank.

    One pass over the text without parsing; the first line of a file is the one with the smallest
    offset, whichever task reads it.
    """
    line = F.trim(F.col("value"))
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(line != "").select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        F.struct(F.substring(line, 1, 1).alias("a"), F.substring(F.reverse(line), 1, 1).alias("z")).alias("ends"))
    first = lines.groupBy("file").agg(F.min_by("ends", "at").alias("e"))
    shape = (F.when(F.col("e.a") == "[", "document").when((F.col("e.a") == "{") & (F.col("e.z") == "}"), "lines")
             .when(F.col("e.a") == "{", "document").otherwise("bad"))
    return first.select("file", shape.alias("shape"))


def load_posts(spark: SparkSession, path: str, shape: str = "auto", skip_bad: bool = False) -> DataFrame:
    """Posts with the canonical schema, whatever the archive shape (see module doc).

    ``auto`` takes the shape of the first line for all files; ``per_file`` finds the shape of every
    file below ``path`` (a pass over the text), so one call reads JSON lines, arrays and objects side by
    side; lines still split across tasks.  A line or file that is not JSON of its shape fails the
    read, or is left out if ``skip_bad``.
    """
    if shape == "per_file":
        found = {}
        for r in file_shapes(spark, path).collect():  # a row per file, as the file index of the read holds
            found.setdefault(r["shape"], []).append(unquote(r["file"]))
        if "bad" in found and not skip_bad:
            raise ValueError(f"{found['bad'][0]}: the first line opens neither a JSON object nor an array")
        parts = [_records(spark, sorted(found[k]), k, skip_bad) for k in ("lines", "document") if k in found]
        if not parts:
            return spark.createDataFrame([], post_schema())
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if shape == "auto":
        shape = detect_shape(spark, path)
    if shape == "empty":
        return spark.createDataFrame([], post_schema())
    return _records(spark, path, shape, skip_bad)


def _records(spark: SparkSession, path: str | list[str], shape: str, skip_bad: bool) -> DataFrame:
    POST_SCHEMA = post_schema()
    reader = spark.read.schema(_wrapper_schema()).option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST")
    if shape == "document":
        reader = reader.option("multiLine", True)
    raw = reader.json(path)
    names = [f.name for f in POST_SCHEMA.fields]
    # an object with a ``tweets`` list holds many records, any other row is one
    itself = F.array(F.struct(F.col("tweet"), *[F.col(n) for n in names]))
    records = raw.select(F.explode(F.coalesce(F.col("tweets"), itself)).alias("t"))
    return records.select(F.coalesce(F.col("t.tweet"), F.struct(*[F.col(f"t.{n}") for n in names])).alias("p")).select("p.*")


def load_relation_ids(spark: SparkSession, path: str, key: str, name: str = "account_id") -> DataFrame:
    """Distinct ids of a ``following`` / ``follower`` export (JSON lines of wrapped records)."""
    raw = spark.read.schema(f"{key} {RELATION_SCHEMA}").json(path)
    return raw.select(F.col(f"{key}.accountId").alias(name)).where(F.col(name).isNotNull()).distinct()


def load_account_batches(spark: SparkSession, path: str, one_per_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(users, tweets) from account batches ``{data: [...], includes: {tweets: [...]}}``:
    one document per file, or one per line (files then split across tasks)."""
    raw = spark.read.schema(ACCOUNT_BATCH_DDL.replace("\n", " ")).option("multiLine", not one_per_line).json(path)
    users = raw.select(F.explode("data").alias("u")).select("u.*")
    tweets = raw.select(F.explode(F.coalesce(F.col("includes.tweets"), F.array())).alias("t")).select("t.*")
    return users, tweets


def flatten_users(users: DataFrame, tweet_dates: DataFrame | None = None) -> DataFrame:
    """Nested account records -> the 9-column summary; the most recent post date is a
    left lookup into the included posts (duplicates: one row per id, latest wins)."""
    flat = users.select("id", "username", "name", "location", "description", "affiliation", "most_recent_tweet_id",
                        F.col("public_metrics.followers_count").alias("followers_count"))
    if tweet_dates is None:
        return flat.withColumn("most_recent_tweet_date", F.lit(None).cast("string"))
    lookup = tweet_dates.groupBy("id").agg(F.max("created_at").alias("most_recent_tweet_date"))
    j = flat.join(lookup.withColumnRenamed("id", "_tid"), F.col("most_recent_tweet_id") == F.col("_tid"), "left")
    return j.select("id", "username", "name", "location", "description", "affiliation", "most_recent_tweet_id",
                    "most_recent_tweet_date", "followers_count")


def read_labelled_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled-post CSV with texts containing newlines and quotes."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


#: Rows that the types of a CSV are first guessed from.
CSV_SAMPLE_ROWS = 100_000
_CSV_TYPES = ("boolean", "bigint", "double", "date", "timestamp")


def _fits(column: str, kind: str) -> Column:
    """True where a text can be read as ``kind`` (a missing value can be read as any)."""
    v = F.trim(F.col(f"`{column}`"))
    if kind == "boolean":
        ok = F.lower(v).isin("true", "false")
    elif kind == "bigint":
        ok = v.rlike(r"^[+-]?[0-9]+$") & v.try_cast("bigint").isNotNull()
    elif kind == "date":
        ok = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & v.try_cast("date").isNotNull()
    elif kind == "timestamp":
        ok = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") & v.try_cast("timestamp").isNotNull()
    else:
        ok = v.try_cast("double").isNotNull()
    return F.coalesce(ok, v.isNull())


def _narrowest(row, column: int) -> str:
    """The first type of the lattice boolean < string, bigint < double, date < timestamp that all values fit."""
    fitting = [k for k in _CSV_TYPES if row[f"c{column}_{k}"]]
    return fitting[0] if fitting and row[f"c{column}_known"] else "string"


def _column_types(rows: DataFrame, columns: list[str]) -> list[str]:
    aggs = [F.bool_and(_fits(c, k)).alias(f"c{i}_{k}") for i, c in enumerate(columns) for k in _CSV_TYPES]
    known = [F.count(f"`{c}`").alias(f"c{i}_known") for i, c in enumerate(columns)]
    found = rows.agg(*aggs, *known).first()
    return [_narrowest(found, i) for i in range(len(columns))]


def read_inferred_csv(spark: SparkSession, path: str, on_misfit: str = "widen", sample_rows: int = CSV_SAMPLE_ROWS) -> DataFrame:
    """A CSV with header whose types come from its values.

    The narrowest type of every column (boolean, bigint, double, date, timestamp, else string; string
    for a column without values) is found by one aggregate over the first ``sample_rows`` rows and
    then holds for every row: with ``widen`` a second aggregate over all rows widens the columns whose
    later values do not fit; with ``fail`` such a value fails the read, without that pass.  Empty
    fields are NULL.  Quoted values may hold line breaks (one task per file).
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    columns = raw.columns
    if not columns:
        return raw
    kinds = _column_types(raw.limit(sample_rows), columns)
    if on_misfit == "widen":
        fits = [F.bool_and(_fits(c, k)).alias(f"f{i}") for i, (c, k) in enumerate(zip(columns, kinds)) if k != "string"]
        good = raw.agg(F.lit(True).alias("any"), *fits).first().asDict()
        late = [i for i, k in enumerate(kinds) if k != "string" and good[f"f{i}"] is False]
        if late:
            for i, k in zip(late, _column_types(raw, [columns[i] for i in late])):
                kinds[i] = k

    def typed(c, k):
        v = F.col(f"`{c}`")
        if k == "string":
            return v.alias(c)
        misfit = F.raise_error(F.concat(F.lit(f"{c}: not a {k}: "), v)).cast(k)
        return F.when(_fits(c, k), F.trim(v).try_cast(k)).otherwise(misfit).alias(c)
    return raw.select(*[typed(c, k) for c, k in zip(columns, kinds)])


def read_kv_first_line(spark: SparkSession, path: str, default: str | None = None) -> DataFrame:
    """First 'Label: value' line of a text file -> value (trimmed); ``default`` when the file
    or the line is missing (one row either way)."""
    if not path_exists(spark, path):
        return spark.range(1).select(F.lit(default).cast("string").alias("value"))
    lines = spark.read.text(path).where(F.col("value").contains(": "))
    # file order: the offsets of text partitions grow with their number, and rows inside follow the file
    placed = lines.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"), "value")
    picked = placed.agg(F.min_by(F.trim(F.split(F.col("value"), ": ", 2)[1]), F.struct("f", "at")).alias("value"))
    return picked.select(F.coalesce(F.col("value"), F.lit(default)).alias("value"))


def read_json_metadata(spark: SparkSession, path: str, schema: str, defaults: dict) -> DataFrame:
    """Run metadata (one JSON document, on one or several lines) as one row; a missing file, a broken
    document or a missing field gives the value in ``defaults`` (NULL without one)."""
    if path_exists(spark, path):
        found = spark.read.schema(schema).option("multiLine", True).json(path)
    else:
        found = spark.createDataFrame([], schema)
    # an aggregate without keys: one row for any input; of several documents the first file's counts
    names = [f.name for f in found.schema.fields]
    placed = found.withColumn("_at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))
    one = placed.agg(F.min_by(F.struct(*names), "_at").alias("d"))
    return one.select(*[F.coalesce(F.col("d")[f.name], F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name)
                        for f in found.schema.fields])
