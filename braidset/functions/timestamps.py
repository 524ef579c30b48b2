"""Timestamps kept as text in several ISO shapes: normal form, order key, output forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from braidset.functions.text import full_trim


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ts(c: Column | str) -> Column:
    """Strict ISO form: 'T' separator, at most three fraction digits, colon in the offset."""
    text = full_trim(_col(c))
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2})", "$1T$2")
    text = F.regexp_replace(text, r"(\.\d{3})\d+(Z|[+-]\d{2}:?\d{2}|)$", "$1$2")
    return F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")


def parse_ts(c: Column | str) -> Column:
    """Epoch milliseconds, or null when the text is no ISO date or date-time.

    A date-time without an offset is read as UTC, whatever the session zone is.
    """
    text = F.regexp_replace(normalize_ts(c), r"(T\d{2}:\d{2})(Z|[+-]\d{2}:\d{2}|)$", "$1:00$2")
    zoned = (
        F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01T00:00:00Z")))
        .when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01T00:00:00Z")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)$"), F.concat(text, F.lit("Z")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)(Z|[+-]\d{2}:\d{2})$"), text)
    )
    return F.unix_millis(F.try_to_timestamp(zoned))


def ts_key(c: Column | str) -> Column:
    """Order key: parseable after unparseable, then by instant, then by text; never null."""
    raw = F.coalesce(_col(c), F.lit(""))
    millis = parse_ts(raw)
    return F.struct(
        millis.isNotNull().alias("ok"),
        F.coalesce(millis, F.lit(0)).alias("ms"),
        F.when(millis.isNull(), raw).otherwise(F.lit("")).alias("txt"),
    )


def latest_text(value: Column | str, position: Column | str) -> Column:
    """Aggregate: the latest timestamp text, blanks skipped, lowest position on a tie."""
    v, p = _col(value), _col(position)
    chosen = F.max_by(v, F.when(F.coalesce(v, F.lit("")) != "", F.struct(ts_key(v), (-p).alias("p"))))
    return F.coalesce(chosen, F.lit(""))


def format_utc(c: Column | str) -> Column:
    """Second-precision UTC text of epoch milliseconds."""
    stamp = F.to_utc_timestamp(F.timestamp_millis(_col(c)), F.current_timezone())
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def offset_form(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"Z$", "+00:00")


def iso_local(c: Column | str) -> Column:
    """Session-zone ISO text with a numeric offset and seven fraction digits."""
    return F.date_format(F.timestamp_millis(_col(c)), "yyyy-MM-dd'T'HH:mm:ss.SSS'0000'xxx")
