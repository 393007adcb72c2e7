"""Text, hash and number-cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "no value".
PLACEHOLDERS = ["---", "--", "", "-", "n/a", "N/A"]
PRICE = "decimal(20,8)"


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text of a UTC timestamp; microseconds appear only when they are not zero."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")),
        F.lit("+00:00"),
    )


def provenance_hash(source_id: Column, as_of: Column, content_sha: Column) -> Column:
    """sha256 over source, retrieval time and content hash."""
    return F.sha2(F.concat_ws("||", source_id, iso_utc(as_of), content_sha), 256)


def is_placeholder(raw: Column) -> Column:
    return F.trim(raw).isin(PLACEHOLDERS)


def clean_number(raw: Column, as_type: str = PRICE) -> Column:
    """Placeholders become null; thousands separators and a leading plus sign are dropped."""
    stripped = F.regexp_replace(F.regexp_replace(F.trim(raw), ",", ""), r"^\+", "")
    return F.when(is_placeholder(raw), F.lit(None)).otherwise(stripped.try_cast(as_type)).cast(as_type)


def is_bad_number(raw: Column, as_type: str = PRICE) -> Column:
    """True where the text is neither a placeholder nor a number."""
    return raw.isNull() | (~is_placeholder(raw) & clean_number(raw, as_type).isNull())
