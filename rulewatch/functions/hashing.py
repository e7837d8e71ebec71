"""Row hashes.

Two forms exist, on purpose.  The set hash leaves NULLs out; the false-positive
hash writes them as empty text.  Both take the columns in name order and rest on
Spark's cast to string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NOT_HASHED = ("ArchiveDate", "archive_dt", "run_at", "_is_false_positive")


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a finding; NULLs are skipped."""
    names = sorted(c for c in columns if c not in NOT_HASHED)
    return F.sha2(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in names]), 256)


def fp_row_hash(columns: list[str]) -> Column:
    """SHA-256 of a finding as false positives store it; NULL counts as ''."""
    names = sorted(c for c in columns if c not in NOT_HASHED and not c.startswith("_"))
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    return F.sha2(F.concat_ws("|", *values), 256)
