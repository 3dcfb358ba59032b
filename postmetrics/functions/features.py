"""Per-post feature expressions.

Every feature is a native Column expression (JVM side, inside whole-stage
codegen); none needs a Python UDF.  Functions take Columns (or column names)
and return Columns so they compose inside one ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label strings, tier boundaries and thresholds used by the
# engagement reports.  They must be equal to the reference's for equal results.
REPLY_NONE = "none"
REPLY_OWN = "reply_own"
REPLY_OTHER = "reply_other"
TIER_PRE = "tier_pre_upgrade"
TIER_UPGRADED = "tier_upgraded"
TIER_POST = "tier_post_upgrade"
TIER_UPGRADED_START = "2023-09-12"
TIER_POST_UPGRADE_START = "2024-09-12"
WINSORIZE_THRESHOLD = 0.95
RETWEET_PREFIX = "RT @"
LINK_PATTERN = "https://t.co/"
QUOTE_HOST = "twitter.com"
QUOTE_PATH = "/status/"
ARCHIVE_TIME_FORMAT = "MMM dd HH:mm:ss Z yyyy"  # after the leading 'EEE '
ARCHIVE_TIME_WRITE_FORMAT = "EEE MMM dd HH:mm:ss Z yyyy"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- time ---------------------------------------------------------------

def parse_post_time(x) -> Column:
    """Archive ``created_at`` ('Wed Oct 10 20:19:24 +0000 2018') or ISO text -> timestamp.

    Spark's parser refuses the day-of-week letter, so the first four characters are
    dropped before parsing; unparseable text becomes NULL (pandas ``errors='coerce'``).
    """
    s = F.trim(_c(x).cast("string"))
    archive = F.try_to_timestamp(s.substr(F.lit(5), F.length(s)), F.lit(ARCHIVE_TIME_FORMAT))
    iso = F.try_to_timestamp(s)
    return F.coalesce(archive, iso)


def to_zone(ts, tz: str | None) -> Column:
    """Optional shift of a UTC instant into wall-clock time of ``tz``."""
    if not tz or tz.upper() == "UTC":
        return _c(ts)
    return F.from_utc_timestamp(_c(ts), tz)


def weekday_name(ts) -> Column:
    return F.date_format(_c(ts), "EEEE")


def hour_of_day(ts) -> Column:
    return F.hour(_c(ts))


def month_label(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def week_period(ts) -> Column:
    """Monday/Sunday label of the calendar week, e.g. '2024-01-01/2024-01-07'."""
    start = F.to_date(F.date_trunc("week", _c(ts)))
    return F.concat(start.cast("string"), F.lit("/"), F.date_add(start, 6).cast("string"))


def relative_week(ts, event_ts) -> Column:
    """Floor of weeks between ``ts`` and an event instant (-8 days -> week -2)."""
    week_us = 7 * 86400 * 1_000_000
    diff = F.unix_micros(_c(ts)) - F.unix_micros(_c(event_ts))
    return F.floor(diff / F.lit(week_us)).cast("int")


def relative_week_window(ts, event_ts: str, weeks: int) -> Column:
    """Range predicate equivalent to ``relative_week(ts, event) BETWEEN -weeks AND weeks``,
    written on the raw timestamp so Catalyst can push it into the scan."""
    start = F.to_timestamp(F.lit(event_ts)) - F.expr(f"INTERVAL {7 * weeks} DAYS")
    end = F.to_timestamp(F.lit(event_ts)) + F.expr(f"INTERVAL {7 * (weeks + 1)} DAYS")
    return (_c(ts) >= start) & (_c(ts) < end)


def account_tier(ts, upgraded_start, post_start) -> Column:
    """Three period labels; both boundaries belong to the middle period; NULL time -> last."""
    t = _c(ts)
    a = F.to_timestamp(F.lit(upgraded_start)) if isinstance(upgraded_start, str) else upgraded_start
    b = F.to_timestamp(F.lit(post_start)) if isinstance(post_start, str) else post_start
    return (F.when(t < a, F.lit(TIER_PRE))
            .when((t >= a) & (t <= b), F.lit(TIER_UPGRADED))
            .otherwise(F.lit(TIER_POST)))


# --- counts / engagement -----------------------------------------------------

def coerce_count(x) -> Column:
    """Numeric-coerce a count delivered as text: bad or missing -> 0, truncated to bigint."""
    number = _c(x).cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number).try_cast("bigint"), F.lit(0).cast("bigint"))


def total_engagement(likes, retweets, replies, bookmarks) -> Column:
    return _c(likes) + _c(retweets) + _c(replies) + _c(bookmarks)


def weighted_engagement(favorites, retweets) -> Column:
    """favorites + 10 x retweets (the labelling workflow's metric)."""
    return _c(favorites) + F.lit(10) * _c(retweets)


# --- flags ------------------------------------------------------------------

def is_retweet(retweeted_flag, retweeted_status, text) -> Column:
    """First non-null flag; else a present ``retweeted_status`` struct; else text prefix."""
    by_struct = F.when(_c(retweeted_status).isNotNull(), F.lit(True))
    by_text = F.coalesce(_c(text), F.lit("")).startswith(RETWEET_PREFIX)
    return F.coalesce(_c(retweeted_flag), by_struct, by_text)


def is_quote(quote_flag, quoted_id, urls) -> Column:
    """First non-null flag; else a quoted id; else an expanded url of a status link."""
    by_id = F.when(_c(quoted_id).isNotNull(), F.lit(True))
    by_url = F.exists(
        F.coalesce(_c(urls), F.array()),
        lambda u: F.coalesce(u["expanded_url"], F.lit("")).contains(QUOTE_HOST)
        & F.coalesce(u["expanded_url"], F.lit("")).contains(QUOTE_PATH),
    )
    return F.coalesce(_c(quote_flag), by_id, F.when(by_url, F.lit(True)), F.lit(False))


def reply_type(target_user, owner_id) -> Column:
    """'none' without a target, 'reply_own' to the owner (never when owner unknown), else other."""
    t = _c(target_user).cast("string")
    o = _c(owner_id).cast("string")
    own = o.isNotNull() & (o != F.lit("")) & (t == o)
    return (F.when(t.isNull(), F.lit(REPLY_NONE))
            .when(own, F.lit(REPLY_OWN))
            .otherwise(F.lit(REPLY_OTHER)))


def is_reply(in_reply_to_status_id) -> Column:
    return _c(in_reply_to_status_id).isNotNull()


def has_link(text) -> Column:
    # regular-expression match; the dot is a wildcard as in the reference rule
    return F.coalesce(_c(text), F.lit("")).rlike(LINK_PATTERN)


def has_media(media) -> Column:
    return F.coalesce(F.size(_c(media)) > 0, F.lit(False))


def has_question_mark(text) -> Column:
    return F.coalesce(_c(text), F.lit("")).contains("?")


def entity_count(arr) -> Column:
    """Number of entities; NULL or missing list -> 0 (size(NULL) is NULL under ANSI)."""
    return F.coalesce(F.size(_c(arr)), F.lit(0)).cast("int")


def text_length(text) -> Column:
    """Length in code points after NULL -> ''."""
    return F.length(F.coalesce(_c(text), F.lit(""))).cast("int")


# Characters Python's ``str.isspace`` accepts (fixed set; also used by the SQL oracle).
WHITESPACE_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def strip_text(text) -> Column:
    """Python ``str.strip()``: Unicode whitespace on both ends (``trim`` strips spaces only)."""
    s = F.coalesce(_c(text), F.lit(""))
    return F.regexp_replace(s, "^" + WHITESPACE_CLASS + "+|" + WHITESPACE_CLASS + "+$", "")


def stripped_length(text) -> Column:
    """``len(text.strip())`` from two anchored matches (on the text and its reverse),
    so long texts are not rescanned from every whitespace run."""
    s = F.coalesce(_c(text), F.lit(""))
    lead = F.length(F.regexp_extract(s, "^" + WHITESPACE_CLASS + "*", 0))
    trail = F.length(F.regexp_extract(F.reverse(s), "^" + WHITESPACE_CLASS + "*", 0))
    return F.greatest(F.length(s) - lead - trail, F.lit(0))


def min_length(text, k: int) -> Column:
    """Stripped text strictly longer than ``k`` characters."""
    return stripped_length(text) > F.lit(k)


def winsorize(x, cap) -> Column:
    """Upper clip at ``cap``; a NULL value stays NULL, a NULL cap (empty frame) changes nothing."""
    value = _c(x)
    return F.when(value.isNotNull(), F.least(value, _c(cap)))


def ci_equal(a, b) -> Column:
    """Case-insensitive equality."""
    return F.lower(_c(a).cast("string")) == F.lower(_c(b).cast("string"))
