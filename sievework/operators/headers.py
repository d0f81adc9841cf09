"""Header checks and column resolution, one row per file.

A header is short, so the checks are array expressions on the file's own row: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import col, squash, trim_all
from sievework.layout import HEADERS, REQUIRED_HEADERS

# Texts shown for a refused file; "duplicate headers" and "missing required columns" are fixed values.
NO_HEADER = "The file names no columns."
DUPLICATES = "The header has duplicate headers: "
MISSING = "The header has missing required columns: "


# Spelling-neutral form of the known columns.
KNOWN_KEYS = [re.sub("[ _-]", "", h).lower() for h in HEADERS]


def normalized(header: Column | str) -> Column:
    """Spelling-neutral form of a header cell."""
    return squash(header)


def with_header_keys(files: DataFrame, headers: str = "headers") -> DataFrame:
    """Add the cells' keys, and names and keys of the cells that are not blank.

    Later expressions look these arrays up many times, so they are columns of their own.
    """
    cells = F.coalesce(col(headers), F.array().cast("array<string>"))
    named = files.withColumns(
        {
            "header_names": F.filter(F.transform(cells, trim_all), lambda h: h != ""),
            "cell_keys": F.transform(cells, normalized),
        }
    )
    return named.withColumn("header_keys", F.transform("header_names", normalized))


def named_count() -> Column:
    """Number of header cells that are not blank."""
    return F.size("header_names")


def duplicate_headers() -> Column:
    """First spelling of every header that occurs more than once."""
    keys = F.col("header_keys")

    def repeated(name: Column, at: Column) -> Column:
        key = F.get(keys, at)
        first = F.array_position(keys, key) == at + 1
        return first & (F.size(F.array_remove(keys, key)) < F.size(keys) - 1)

    # Few headers repeat a cell; the others need no cell-by-cell comparison.
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.filter("header_names", repeated)).otherwise(F.array().cast("array<string>"))


def missing_headers() -> Column:
    """Required columns that are absent, in layout order."""
    absent = [F.when(~F.array_contains("header_keys", k), F.lit(h)) for h, k in zip(REQUIRED_HEADERS, KNOWN_KEYS)]
    return F.array_compact(F.array(*absent))


def positions() -> Column:
    """For every known column its 1-based place in the header; 0 where it is absent."""
    return F.array(*[F.array_position("cell_keys", k).cast("int") for k in KNOWN_KEYS])


def header_error() -> Column:
    """Why a file is refused as a whole; null when its header is fine."""
    repeated, missing = F.array_join(duplicate_headers(), ", "), F.array_join(missing_headers(), ", ")
    return (
        F.when(named_count() == 0, F.lit(NO_HEADER))
        .when(repeated != "", F.concat(F.lit(DUPLICATES), repeated))
        .when(missing != "", F.concat(F.lit(MISSING), missing))
    )


def check_headers(files: DataFrame, headers: str = "headers") -> DataFrame:
    """Add ``header_error`` and ``positions`` to a table of files."""
    checked = with_header_keys(files, headers).withColumns({"header_error": header_error(), "positions": positions()})
    return checked.drop("header_names", "cell_keys", "header_keys")
