"""CSV export of findings for spreadsheet programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulewatch.functions.predicates import ARCHIVE_TS

BOM = "\ufeff"
FLAG, YES, NO = "FalsoPositivo", "Sim", "Não"  # fixed values


def export_rows(flagged: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Findings as text, newest first, with the false-positive flag in words.

    Every row, unless a caller asks for a number.
    """
    columns = [c for c in flagged.columns if not c.startswith("_")]
    ordered = flagged.orderBy(F.desc(ARCHIVE_TS), *order)
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns],
        F.when(F.col("_is_false_positive"), YES).otherwise(NO).alias(FLAG),
    )


def write_csv(rows: DataFrame, path: str, one_file_rows: int | None = None) -> None:
    """``;`` between values, CRLF between lines, a byte-order mark before the header.

    Each part file is a complete CSV.  ``one_file_rows`` asks for a single file of so
    many rows at most; an export that has more is refused, not cut.
    """
    first, *rest = rows.columns
    marked = rows.toDF(BOM + first, *rest)
    if one_file_rows is not None:
        if rows.limit(one_file_rows + 1).count() > one_file_rows:
            raise ValueError(f"one file holds {one_file_rows} rows at most")
        marked = marked.coalesce(1)
    (
        marked.write.mode("overwrite")
        .option("sep", ";")
        .option("lineSep", "\r\n")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def read_csv(spark, path: str, columns: list[str]) -> DataFrame:
    """An export read back, as text; empty fields stay empty text.

    Values may hold line breaks, so a part file is read as a whole by one task.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = (
        spark.read.schema(schema)
        .option("sep", ";")
        .option("multiLine", True)
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .csv(path)
    )
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])
