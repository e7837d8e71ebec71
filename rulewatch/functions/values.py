"""Value conversions: dates in several formats, labels, JSON-safe output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Day-first dates, dd/MM/yyyy or dd-MM-yyyy, and the same date year-first.
DAY_FIRST, YEAR_FIRST = r"^(\d{2})([/-])(\d{2})\2(\d{4})$", "$4-$3-$1"


def parse_date(column: str | Column) -> Column:
    """A text or date column as date: year-first or day-first; NULL if neither fits.

    Day-first text is turned round and cast.  Trying one format after another
    would raise and catch an error inside Spark for every row that does not fit.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(column.cast("string"), DAY_FIRST, YEAR_FIRST).try_cast("date")


def first_non_empty(*columns: str, default: str | None = None) -> Column:
    """First of the columns that is neither NULL nor empty."""
    options = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.coalesce(*options, F.lit(default))


def from_millis(column: Column) -> Column:
    """Epoch milliseconds, as number or text, to a timestamp."""
    return F.timestamp_millis(column.try_cast("bigint"))


def local_time_label(column: str, zone: str, suffix: str) -> Column:
    """``dd-MMM-yyyy hh:mm:ss a`` in ``zone``, shifted once from UTC."""
    local = F.from_utc_timestamp(F.col(column).cast("timestamp"), zone)
    return F.concat(F.date_format(local, "dd-MMM-yyyy hh:mm:ss a"), F.lit(f" {suffix}"))


def preview(column: str, length: int = 8) -> Column:
    return F.substring(column, 1, length)


def json_safe(column: Column, data_type: T.DataType, offset: str) -> Column:
    """The column in types that JSON can carry, arrays, maps and structs included."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, f"yyyy-MM-dd'T'HH:mm:ss'{offset}'")
    if isinstance(data_type, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(data_type, T.DecimalType):
        return column.cast("double")
    if isinstance(data_type, T.BinaryType):
        # A lenient reading: bytes that are no UTF-8 become replacement marks.
        return F.make_valid_utf8(column.cast("string"))
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda x: json_safe(x, data_type.elementType, offset))
    if isinstance(data_type, T.MapType):
        return F.transform_values(column, lambda k, v: json_safe(v, data_type.valueType, offset))
    if isinstance(data_type, T.StructType):
        return F.when(
            column.isNotNull(),
            F.struct(
                *[
                    json_safe(column.getField(f.name), f.dataType, offset).alias(f.name)
                    for f in data_type.fields
                ]
            ),
        )
    return column


def json_safe_rows(df: DataFrame, offset: str = "+00:00") -> DataFrame:
    """Every column made JSON-safe, driven by the schema."""
    return df.select(
        *[json_safe(F.col(f"`{f.name}`"), f.dataType, offset).alias(f.name) for f in df.schema]
    )
