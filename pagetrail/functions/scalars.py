"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_id(url: Column) -> Column:
    """Unsigned 64-bit id of a URL: the first 16 hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(url, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def content_digest(content: Column, stored: Column) -> Column:
    """Hex SHA-256 of kept contents, empty where they are not kept."""
    return F.when(stored & content.isNotNull(), F.sha2(content, 256)).otherwise("")


def epoch_seconds(ts: Column) -> Column:
    """Of a timestamp without zone, read as UTC whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def joined_words(words: Column) -> Column:
    return F.array_join(F.coalesce(words, F.array().cast("array<string>")), " ")


def or_default(value: Column, default: Column | str = "") -> Column:
    """A missing field and a null one take the default alike."""
    return F.coalesce(value, F.lit(default) if isinstance(default, str) else default, F.lit(""))


def session_parts(session_key: Column) -> Column:
    """struct(key, host) of `token@host`, split once at most; null where there are not two parts."""
    parts = F.split(session_key, "@", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("key"), parts[1].alias("host")))


def all_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def age_label(ts: Column, as_of: Column) -> Column:
    """Relative age by whole days, a date from 30 days on."""
    days = F.floor((as_of - ts) / 86400)
    return (
        F.when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 30, F.concat(F.floor(days / 7).cast("string"), F.lit(" weeks ago")))
        .otherwise(F.date_format(F.timestamp_seconds(ts), "MMM d, yyyy"))
    )


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without stemming."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def prompt(title: Column, url: Column, stored: Column) -> Column:
    """Request text for an annotation model; captures whose image is not kept get the image wording."""
    asked = "Answer with title, up to 25 direct_keywords, up to 25 related_keywords and a short description as JSON."
    page = F.format_string("Annotate the page %s titled %s. " + asked, url, title)
    image = F.format_string("Annotate the image captured at %s. " + asked, url)
    return F.when(stored, page).otherwise(image)


def chained_hash(content: Column, chunk: int = 4 << 20) -> Column:
    """h = sha256(h + sha256(chunk)) over the chunks of a binary column, as hex; empty contents give ''."""
    starts = F.when(F.octet_length(content) > 0, F.sequence(F.lit(0), F.ceil(F.octet_length(content) / chunk).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda k: F.substring(content, k * chunk + 1, F.lit(chunk)))
    digest = F.aggregate(parts, F.lit(b""), lambda a, c: F.unhex(F.sha2(F.concat(a, F.unhex(F.sha2(c, 256))), 256)))
    return F.lower(F.hex(digest))
