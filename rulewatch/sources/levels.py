"""A log of many small runs as sorted levels.

Each run adds one small part (level 0) to a table.  Parts of one level are merged, ``fanout`` at a
time, into one part of the next, sorted by key and time, with a row written again replacing the
one before it.  So a table of n runs has about ``fanout`` times log(n) parts, however old it is, and a row is
rewritten log(n) times in all.  Which parts are live is in one versioned document for all tables of the
store: a run's rows appear in all of them at once.  A merge that is repeated or interrupted leaves parts
that no document names; one that lost a race to another merge of the same parts is dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from rulewatch.sources.versions import Versions

RUN, SEQUENCE = "_run", "_sequence"  # columns of every stored row: its run's time, and which writing it is
PART_ROWS = 1_000_000  # rows of a file of a merged part


class Levels:
    def __init__(self, spark: SparkSession, folder: str, fanout: int = 8):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.versions = Versions(spark, self.folder)

    def parts(self, table: str, document: dict | None = None) -> list[dict]:
        document = self.versions.current()[1] if document is None else document
        return document.get(table, [])

    def write(self, table: str, rows: DataFrame, level: int = 0, files: int = 1) -> dict:
        """A part that is stored, but not yet live."""
        path, seen = f"{table}/{uuid.uuid4().hex}", Observation()
        rows = rows.coalesce(1) if files == 1 else rows
        span = F.count(F.lit(1)).alias("rows"), F.min(F.unix_micros(RUN)).alias("low"), F.max(F.unix_micros(RUN)).alias("high")
        rows.observe(seen, *span).write.parquet(f"{self.folder}/{path}")
        return {"path": path, "level": level, **seen.get}

    def read(
        self, table: str, schema: T.StructType, keys: list[str], parts: list[dict] | None = None,
        before: int | None = None, whole: bool = False,
    ) -> DataFrame:
        """The live rows with their run times, those written again once; columns an older part lacks are NULL.

        ``before`` (microseconds) leaves out parts, and rows, of runs at that time or later.
        """
        parts = self.parts(table) if parts is None else parts
        parts = [p for p in parts if p["rows"] and (before is None or p["low"] < before)]
        full = T.StructType([*schema.fields, T.StructField(RUN, T.TimestampType()), T.StructField(SEQUENCE, T.LongType())])
        if not parts:
            rows = self.spark.createDataFrame([], full)
        else:
            rows = self.spark.read.schema(full).parquet(*[f"{self.folder}/{p['path']}" for p in parts])
        if before is not None:
            rows = rows.where(F.col(RUN) < F.timestamp_micros(F.lit(before)))
        spans = sorted((p["low"], p["high"]) for p in parts)
        if any(high >= low for (_, high), (low, _) in zip(spans, spans[1:])):  # a run may have been written twice
            every = [c for c in rows.columns if c not in (*keys, RUN)]
            newest = rows.groupBy(*keys, RUN).agg(F.max_by(F.struct(*every), SEQUENCE).alias("_row"))
            rows = newest.select(*keys, RUN, "_row.*").select(*rows.columns)
        return rows if whole else rows.drop(SEQUENCE)

    def stamped(self, rows: DataFrame, run: Column, sequence: int) -> DataFrame:
        return rows.withColumns({RUN: run.cast("timestamp"), SEQUENCE: F.lit(sequence).cast("long")})

    def full(self, table: str, parts: list[dict]) -> list[dict]:
        """Parts of the lowest level that has enough of them."""
        by_level: dict[int, list[dict]] = {}
        for p in parts:
            by_level.setdefault(p["level"], []).append(p)
        return next((ps for _, ps in sorted(by_level.items()) if len(ps) >= self.fanout), [])

    def merge(self, table: str, schema: T.StructType, keys: list[str]) -> int:
        """Merge full levels until none is left; gives the number of merges.  Safe to repeat."""
        done = 0
        while inputs := self.full(table, self.parts(table)):
            rows = self.read(table, schema, keys, inputs, whole=True)
            files = -(-sum(p["rows"] for p in inputs) // PART_ROWS)
            rows = rows.repartitionByRange(files, *keys, RUN) if files > 1 else rows.coalesce(1)
            part = self.write(table, rows.sortWithinPartitions(*keys, RUN), inputs[0]["level"] + 1, files)
            gone = {p["path"] for p in inputs}

            def replace(document: dict, number: int) -> dict | None:
                live = document.get(table, [])
                if not gone <= {p["path"] for p in live}:
                    return None  # merged by someone else meanwhile
                return document | {table: [p for p in live if p["path"] not in gone] + [part]}

            self.versions.update(replace)
            done += 1
        return done

    def unnamed(self, tables: list[str]) -> DataFrame:
        """``path`` of stored parts that the newest document does not name: a plan for cleaning up, deletes nothing."""
        named = {p["path"] for t in tables for p in self.parts(t)}
        fs, path = self.versions._fs, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = []
        for table in tables:
            if fs.exists(path(f"{self.folder}/{table}")):
                found += [f"{table}/{f.getPath().getName()}" for f in fs.listStatus(path(f"{self.folder}/{table}"))]
        return self.spark.createDataFrame([(f,) for f in found if f not in named], "path string")

