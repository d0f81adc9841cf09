"""Failure classification: error kind, message or named condition -> category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import layout
from sievework.functions.text import clean_text, col

# Phrases looked for in the lower-cased message.
LOCKED = ["sharing violation", "locked", "checked out", "in use", "being used by another process"]
READ_ONLY = ["read-only", "readonly", "write protected", "access is denied"]
CONNECTIVITY = [
    "network",
    "unreachable",
    "no such host",
    "cannot access",
    "the network path",
    "unc",
    "host not found",
    "connection refused",
    "certificate",
    "token",
]
THROTTLED = ["throttl", "rate limit", "too many requests", "429"]
UNAVAILABLE = ["unavailable", "not available", "service unavailable"]
CONFLICT = ["conflict", "already exists", "duplicate target"]

# Fixed values: (error kind, phrases or None for any message, category), first match wins.
ERROR_RULES = [
    ("access_denied", None, "PermissionDenied"),
    ("io", LOCKED, "FileLockedOrCheckedOut"),
    ("io", READ_ONLY, "ReadOnlyOrSystemProtected"),
    ("io", CONNECTIVITY, "AuthenticationOrCertificateFailure"),
    ("io", THROTTLED, "RateLimitingOrThrottling"),
    ("not_supported", None, "UnsupportedFileType"),
    ("timeout", None, "AuthenticationOrCertificateFailure"),
    ("cancelled", None, "RetryExhausted"),
    ("invalid_operation", UNAVAILABLE, "RestorationSystemUnavailable"),
    ("invalid_operation", CONFLICT, "RestorationTargetConflict"),
    ("invalid_data", None, "MalformedInputRow"),
]
# Phrases of a validation message -> category, first match wins.
VALIDATION_RULES = [
    (["required", "must not be empty"], "MissingRequiredField"),
    (["invalid", "must be one of"], "InvalidAllowedValue"),
    (["date", "number", "size"], "InvalidDataType"),
]


def mentions(message: Column, phrases: list[str]) -> Column:
    """True where the text contains one of the phrases as a bare substring."""
    return reduce(lambda a, b: a | b, [message.contains(p) for p in phrases])


def error_category(kind: Column | str, message: Column | str) -> Column:
    """Category of a failure from its kind and message."""
    kind, text = col(kind), F.lower(F.coalesce(col(message), F.lit("")))
    result = F
    for name, phrases, category in ERROR_RULES:
        hit = kind == name if phrases is None else (kind == name) & mentions(text, phrases)
        result = result.when(hit, F.lit(category))
    return result.otherwise("Others")


def validation_category(message: Column | str) -> Column:
    """Category of a failed validation from its message."""
    text = F.lower(clean_text(message))
    result = F
    for phrases, category in VALIDATION_RULES:
        result = result.when(mentions(text, phrases), F.lit(category))
    return result.otherwise("ValidationError")


def with_precheck_category(df: DataFrame, condition: str = "condition") -> DataFrame:
    """Add the category of a named pre-check condition (12-row dimension, fixed size)."""
    dim = layout.precheck_dimension(df.sparkSession).select(
        F.col("condition").alias(condition), F.col("category").alias("precheck_category")
    )
    return df.join(F.broadcast(dim), condition, "left")


def with_category_details(df: DataFrame, category: str = "resolved_category") -> DataFrame:
    """Add the actionable flag and priority of a category (26-row dimension, fixed size)."""
    dim = layout.category_dimension(df.sparkSession).withColumnRenamed("category", category)
    return df.join(F.broadcast(dim), category, "left")
