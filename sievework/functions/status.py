"""Workflow status derivation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import clean_text, col, is_blank, squash
from sievework.layout import STATUS_CODES

# Squashed finding type -> first workflow status.  Everything else,
# "obsolete" included, starts as NotYetStarted.
INITIAL_STATUS = {
    "quarantined": "Quarantined",
    "totalpendingquarantined": "TotalPendingQuarantined",
    "restoration": "Restoration",
    "restored": "Restored",
    "deleted": "Deleted",
    "exception": "Exception",
    "exclusion": "Exclusion",
    "notobsolete": "NotObsolete",
    "error": "Error",
}
NOT_STARTED = "NotYetStarted"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.element_at(mapping, key)


def initial_status(finding_type: Column | str) -> Column:
    """Status of a freshly ingested row."""
    return F.coalesce(_lookup(squash(finding_type), INITIAL_STATUS), F.lit(NOT_STARTED))


def initial_status_text(finding_type: Column | str) -> Column:
    """Text stored in the status column of a freshly ingested row."""
    return F.when(squash(finding_type).isin("", "obsolete") & ~_only_marks(finding_type), F.lit(NOT_STARTED)).otherwise(
        clean_text(finding_type)
    )


def _only_marks(c: Column | str) -> Column:
    # "-" squashes to the empty string but is not blank; it is stored as given.
    return (squash(c) == "") & ~is_blank(c)


def stored_status(text: Column | str) -> Column:
    """Status from stored text: a name in any case, a numeric code, or a spelled variant."""
    c = clean_text(text)
    by_name = _lookup(F.lower(c), {k.lower(): k for k in STATUS_CODES})
    by_code = _lookup(c.try_cast("int").cast("string"), {str(v): k for k, v in STATUS_CODES.items()})
    by_spelling = _lookup(
        squash(text),
        {"notobsolete": "NotObsolete", "totalpendingquarantined": "TotalPendingQuarantined"},
    )
    numeric = c.rlike(r"^[+-]?\d{1,9}$")
    return F.coalesce(by_name, F.when(numeric, by_code), by_spelling, F.lit(NOT_STARTED))


def may_reassign(status: Column | str, status_text: Column | str) -> Column:
    """A new finding type may still set the status: nothing has happened to the row yet."""
    return (col(status) == NOT_STARTED) & (F.lower(col(status_text)) == NOT_STARTED.lower())


def guarded_status(status: Column | str, status_text: Column | str, new_type: Column | str) -> Column:
    """Status after the finding type changes; a running lifecycle is left alone."""
    return F.when(may_reassign(status, status_text), initial_status(new_type)).otherwise(col(status))


def guarded_status_text(
    status: Column | str, status_text: Column | str, new_type: Column | str
) -> Column:
    """Status text after the finding type changes."""
    return F.when(may_reassign(status, status_text), initial_status_text(new_type)).otherwise(col(status_text))


def quarantine_path(status: Column | str, location: Column | str) -> Column:
    """Where a quarantined file lies; only known once quarantine is complete."""
    return F.when(col(status) == "QuarantineComplete", col(location))
