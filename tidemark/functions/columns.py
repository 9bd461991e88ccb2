"""Column builders for record content: canonical digests, deterministic ids, identifier normalizers, strict conversions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"
IDENTITY = "tidemark-identity-v1"
_BASE32_HEX, _CROCKFORD = "ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHJKMNPQRSTVWXYZ"


def digest(*parts: Column) -> Column:
    """sha256: and the hash of the parts, joined by a separator; nulls are told apart from empty texts."""
    tagged = [F.when(p.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), p.cast("string"))) for p in parts]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(UNIT, *tagged), 256))


def record_id(record_class: str | Column, *keys: Column) -> Column:
    """A deterministic id: 128 bits of a hash of the class and the keys, in base 32."""
    own = F.lit(record_class) if isinstance(record_class, str) else record_class
    h = F.sha2(F.concat_ws(UNIT, F.lit(IDENTITY), own, *[k.cast("string") for k in keys]), 256)
    groups = [F.lpad(F.conv(F.substring(h, 1, 2), 16, 32), 2, "0")]
    groups += [F.lpad(F.conv(F.substring(h, 3 + 5 * i, 5), 16, 32), 4, "0") for i in range(6)]
    return F.concat(F.lit("rec:"), F.translate(F.concat(*groups), _BASE32_HEX, _CROCKFORD))


def canonical_url(value: Column) -> Column:
    """Scheme and host in lower case, without www., default port, fragment and one closing slash; other texts as they are.

    The bytes of path, query and user information stay.
    """
    shape = r"^(?i)(https?)://(?:([^/?#]*)@)?(\[[^\]]+\]|[^:/?#@\[]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
    part = lambda i: F.regexp_extract(value, shape, i)
    scheme, host, port, path = F.lower(part(1)), F.lower(part(3)), part(4), part(5)
    host = F.regexp_replace(host, r"^www\.", "")
    default = ((port == "80") & (scheme == "http")) | ((port == "443") & (scheme == "https"))
    user = F.when(part(2) != "", F.concat(part(2), F.lit("@"))).otherwise(F.when(value.rlike(r"^(?i)https?://@"), F.lit("@")).otherwise(F.lit("")))
    shown = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.when(path == "", F.lit("/")).when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    return F.when(value.rlike(shape), F.concat(scheme, F.lit("://"), user, host, shown, path, part(6))).otherwise(value)


def normalize_identifier(namespace: Column, value: Column) -> Column:
    """The value in the namespace's normal form; blank values are null."""
    trimmed, name = F.trim(value), F.lower(F.trim(namespace))
    squeezed = F.regexp_replace(trimmed, r"\s+", "")
    doi = F.trim(F.regexp_replace(F.regexp_replace(F.lower(trimmed), r"^https?://(dx\.)?doi\.org/", ""), r"^doi\s*:\s*", ""))
    cas = F.upper(F.regexp_replace(F.regexp_replace(trimmed, r"^(?i)cas\s*:\s*", ""), r"\s+", ""))
    normal = (
        F.when(name == "doi", doi)
        .when(name == "inchikey", F.upper(squeezed))
        .when(name == "cas", cas)
        .when(name == "content_hash", F.lower(squeezed))
        .when(name == "canonical_url", canonical_url(trimmed))
        .otherwise(trimmed)
    )
    return F.when(trimmed != "", normal)


def strict_integer(value: Column) -> Column:
    """A 64-bit integer from exact text, else null."""
    return F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value).try_cast("bigint"))


def strict_decimal(value: Column) -> Column:
    """A decimal of at most 15 whole and 3 fractional digits, without rounding, else null."""
    return F.when(F.trim(value).rlike(r"^[+-]?0*[0-9]{1,15}(\.[0-9]{1,3}0*)?$"), F.trim(value).try_cast("decimal(18,3)"))


def strict_number(value: Column) -> Column:
    """A finite double, else null; a number that isn't zero but would become zero is null, and minus zero is zero."""
    shape = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    number = F.trim(value).try_cast("double")
    finite = F.abs(number) < F.lit(float("inf"))
    lost = (number == 0) & F.regexp_replace(F.trim(value), r"[eE].*$", "").rlike("[1-9]")
    return F.when(F.trim(value).rlike(shape) & finite & ~lost, F.when(number == 0, F.lit(0.0)).otherwise(number))


def strict_boolean(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))


def strict_date(value: Column) -> Column:
    return F.when(F.trim(value).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.trim(value).try_cast("date"))


def strict_timestamp(value: Column) -> Column:
    """A UTC timestamp without zone from a date, a local (UTC) date time or one with an offset, else null."""
    text = F.trim(value)
    zone = F.regexp_extract(text, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", 1)
    local = F.regexp_replace(F.regexp_replace(text, r"(Z|(?<=:[0-9.]{2,9})[+-][0-9]{2}:?[0-9]{2})$", ""), "T", " ")
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    minutes = F.when(zone.isin("", "Z"), 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.regexp_extract(zone, "([0-9]{2})$", 1).try_cast("int")))
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
    found = local.try_cast("timestamp_ntz") - F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))
    return F.when(text.rlike(shape), found)


def iso_micros(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def percent_encoded(value: Column | str) -> Column:
    """The text with all but letters, digits and -._~ as percent signs and bytes."""
    own = F.url_encode(F.col(value) if isinstance(value, str) else value)
    # what form encoding does otherwise: spaces, stars and tildes
    return F.replace(F.replace(F.replace(own, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def first_label(*columns: Column) -> Column:
    """The first text that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def snake_case(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_")
