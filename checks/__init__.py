"""The library's operators on the driver's tables, with a DuckDB query for each."""
