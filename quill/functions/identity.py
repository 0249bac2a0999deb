"""Identity of documents: addresses, numbers, titles, and the keys made of them. All are expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits that keys depend on.
TRACKING = "utm_|spm|from|source|share"
DROPPED = "[《》“”\"'\\[\\]【】()（）,，.。;；:：\\-_—\\s\\u3000\\u00A0]"
STATE, ISSUERS = "^中华人民共和国", "^(国家发展和改革委员会|国家发展改革委|工业和信息化部|国务院办公厅|国务院)"
ABOUT, KIND = "^.*?关于(?:印发|公布|发布|转发|批复)", "(?:的通知|的批复|的公告|通知|公告|批复).*$"
CORE_LENGTH, TITLE_LENGTH = 10, 16
# End of fixed values.
#: Full-width forms and their plain ones, in order: the part of compatibility normalisation that such titles need.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\s\\u3000\\u00A0]+", " "))


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def canonical_url(c: Column) -> Column:
    """Without fragment, tracking parameters and doubled slashes in the path; scheme and host in lower case."""
    u = F.regexp_replace(clean(c), "#.*$", "")
    u = F.regexp_replace(u, f"(?i)([?&])(?:{TRACKING})[^&]*(?=&|$)", "$1")
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "&+", "&"), "\\?&", "?"), "[?&]+$", "")
    head = F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), "/{2,}", "/")
    query = F.regexp_extract(rest, "(\\?.*)$", 1)
    return or_null(F.when(head == "", u).otherwise(F.concat(F.lower(head), F.when(path == "", "/").otherwise(path), query)))


def sorted_url(c: Column) -> Column:
    """The canonical address with its parameters in order."""
    u = canonical_url(c)
    base, query = F.regexp_extract(u, "^([^?]*)", 1), F.regexp_extract(u, "\\?(.*)$", 1)
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path(c: Column) -> Column:
    return F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def identity_text(c: Column) -> Column:
    """Width folded, lower case, without punctuation and blanks; null if nothing is left."""
    return or_null(F.regexp_replace(F.lower(F.translate(clean(c), WIDE, PLAIN)), DROPPED, ""))


def document_number(c: Column) -> Column:
    return or_null(F.regexp_replace(F.regexp_replace(identity_text(c), STATE, ""), ISSUERS, ""))


def core_title(c: Column) -> Column:
    """The longest title in brackets (the first of equals), else the title without its frame."""
    text = clean(c)
    found = F.regexp_extract_all(text, F.lit("《([^》]{4,120})》"), F.lit(1))
    longest = F.aggregate(found, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    bare = F.regexp_replace(F.regexp_replace(text, ABOUT, ""), KIND, "")
    return identity_text(F.when(F.size(found) > 0, longest).otherwise(bare))


def dedupe_key(number: Column, title: Column, date: Column, url: Column) -> Column:
    """By number, else by core title and date, else by whole title and date, else by address."""
    no, core, whole, u = document_number(number), core_title(title), identity_text(title), canonical_url(url)
    return F.coalesce(
        F.concat(F.lit("policy-no:"), no),
        F.when(F.length(core) >= CORE_LENGTH, F.concat(F.lit("document-title-date:"), date, F.lit(":"), core)),
        F.when(F.length(whole) >= TITLE_LENGTH, F.concat(F.lit("title-date:"), date, F.lit(":"), whole)),
        F.concat(F.lit("url:"), u),
    )


def identity_keys(url: Column, source_url: Column, number: Column, title: Column, date: Column, content_hash: Column) -> Column:
    """All keys by which a document may be known, distinct, in a fixed order."""
    a, b, no, core = canonical_url(F.coalesce(url, source_url)), canonical_url(source_url), document_number(number), core_title(title)
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.concat(F.lit("exact-url:"), a),
                F.concat(F.lit("exact-url:"), b),
                F.concat(F.lit("policy-no:"), no),
                F.when(F.length(core) >= CORE_LENGTH, F.concat(F.lit("document-title-date:"), date, F.lit(":"), core)),
                F.concat(F.lit("content-hash:"), content_hash),
            )
        )
    )


def normal_date(c: Column) -> Column:
    """A day from epoch seconds (10 digits) or milliseconds (13), from year, month and day with any separators, or from ISO text; else null.

    More digits stand for no time. Years may have more than four.
    """
    text = clean(c)
    seconds = F.when(text.rlike("^\\d{10}$"), text.cast("long")).when(text.rlike("^\\d{13}$"), F.floor(text.cast("long") / 1000))
    parts = [F.regexp_extract(text, "^(\\d{4,})[-/.年](\\d{1,2})[-/.月](\\d{1,2})", k) for k in (1, 2, 3)]
    iso = F.when(parts[0] != "", F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")))
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), iso)


def shanghai_minute(ts: Column) -> Column:
    """The minute in Shanghai; Spark's sign before a year of more than four digits is left out."""
    return F.ltrim(F.date_format(F.from_utc_timestamp(ts, "Asia/Shanghai"), "yyyy-MM-dd HH:mm"), F.lit("+"))


def try_id(c: Column) -> Column:
    """A canonical UUID in lower case, or null."""
    return F.when(F.trim(c).rlike("^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lower(F.trim(c)))
