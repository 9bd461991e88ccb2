"""Column functions: digests, identities, normalizers, strict conversions. None of them is a Python UDF."""

from .columns import (
    canonical_url,
    digest,
    first_label,
    iso_micros,
    normalize_identifier,
    percent_encoded,
    record_id,
    snake_case,
    strict_boolean,
    strict_date,
    strict_decimal,
    strict_integer,
    strict_number,
    strict_timestamp,
)

__all__ = [
    "canonical_url",
    "digest",
    "first_label",
    "iso_micros",
    "normalize_identifier",
    "percent_encoded",
    "record_id",
    "snake_case",
    "strict_boolean",
    "strict_date",
    "strict_decimal",
    "strict_integer",
    "strict_number",
    "strict_timestamp",
]
