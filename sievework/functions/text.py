"""Text, number and date helpers.  All are built-in JVM expressions; none is a UDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode calls white space.
WHITE_SPACE = "".join(
    chr(point)
    for point in [
        *range(0x09, 0x0E),
        0x20,
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    ]
)
# Largest whole number the inbound decimal parse step can hold.
_DECIMAL_MAX = "79228162514264337593543950335"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Strip every kind of Unicode white space from both ends."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def clean_text(c: Column | str) -> Column:
    """Trimmed text; a missing value becomes the empty string."""
    return F.coalesce(trim_all(c), F.lit(""))


def null_if_blank(c: Column | str) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(trim_all(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return clean_text(c) == ""


def squash(c: Column | str) -> Column:
    """Spelling-neutral key: trimmed, lower case, without spaces, underscores and hyphens."""
    return F.lower(F.translate(clean_text(c), " _-", ""))


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units.

    Most texts are far shorter than any limit, so the encoded length is only taken
    where the byte length differs from the character length.
    """
    c = col(c)
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise(
        F.floor(F.octet_length(F.encode(c, "UTF-16LE")) / 2)
    )


def one_of(c: Column, allowed: Iterable[str]) -> Column:
    """Case-insensitive membership, false for null."""
    return F.coalesce(F.lower(c).isin([a.lower() for a in allowed]), F.lit(False))


def signed_digits(c: Column | str) -> Column:
    """Digits with thousands commas removed and a trailing sign moved to the front."""
    digits = trim_all(F.replace(col(c), F.lit(","), F.lit("")))
    return F.regexp_replace(digits, r"^([0-9.]+)([+-])$", "$2$1")


def _number_shaped(c: Column) -> Column:
    return c.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$")


def long_from_digits(n: Column | str) -> Column:
    """Whole number from the output of :func:`signed_digits`."""
    n = col(n)
    return F.when(n.rlike(r"^[+-]?\d{1,18}$"), n.try_cast("bigint")).when(
        _number_shaped(n),
        F.bround(n.try_cast("decimal(38,18)"), 0).try_cast("bigint"),
    )


def parse_long(c: Column | str) -> Column:
    """Whole number: commas dropped, fractions rounded half to even, anything else null."""
    return long_from_digits(signed_digits(c))


def digits_overflow(n: Column | str, value: Column | str) -> Column:
    """True where the digits are a readable number that ``value`` could not hold."""
    n = col(n)
    readable = F.abs(n.try_cast("decimal(38,0)")) <= F.lit(_DECIMAL_MAX).cast("decimal(38,0)")
    return col(value).isNull() & (F.length(n) > 18) & _number_shaped(n) & F.coalesce(readable, F.lit(False))


# Accepted dates beyond ISO: month names, slashes and dashes, with an optional time.  One
# cheap test keeps texts that are no date away from the formatters.
_OTHER_DATE = (
    r"^(?:\d{1,4}[/-]\d{1,2}[/-]\d{1,4}|\d{1,2}[ -][A-Za-z]{3}[ -]\d{4}|[A-Za-z]{3,9} \d{1,2}, \d{4})"
    r"(?: \d{1,2}:\d{2}(?::\d{2})?(?: [AaPp][Mm])?)?$"
)
# Sections are tried in turn; a text fits at most one day and one time section.
_OTHER_PATTERN = (
    "[M/d/yyyy][M-d-yyyy][yyyy/M/d][d MMM yyyy][d-MMM-yyyy][MMM d, yyyy][MMMM d, yyyy]"
    "[ h:mm[:ss] a][ H:mm[:ss]]"
)


def timestamp_from_trimmed(t: Column | str) -> Column:
    """Date from text without surrounding white space; see :func:`parse_timestamp`."""
    t = col(t)
    return F.when(
        t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}.*)?$"), t.try_cast("timestamp")
    ).when(t.rlike(_OTHER_DATE), F.try_to_timestamp(t, F.lit(_OTHER_PATTERN)))


def parse_timestamp(c: Column | str) -> Column:
    """Date from a fixed, documented list of shapes (ISO first); anything else is null.

    Offsets are converted to the session time zone, which the library expects to be UTC.
    """
    return timestamp_from_trimmed(trim_all(c))


def round_trip_text(ts: Column | str) -> Column:
    """Seven-digit ISO text of a timestamp, without zone."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'")


def utc_text(ts: Column | str) -> Column:
    """Seven-digit ISO text of a timestamp, marked as UTC."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")


def json_date(ts: Column | str) -> Column:
    """ISO text with only the fraction digits that carry a value."""
    ts = col(ts)
    return F.when(
        F.date_trunc("second", ts) == ts, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.rtrim(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0")))


def first_not_blank(*cs: Column | str) -> Column:
    """First of several texts that is not blank, as given."""
    return F.coalesce(*[F.when(~is_blank(c), col(c)) for c in cs])
