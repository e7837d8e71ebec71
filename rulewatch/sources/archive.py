"""Finding archives and event-sourced control tables on Parquet.

What a rule found in a run lies in a folder of that rule and run.  A repeated run of a rule
replaces just that, and neither other rules of the run nor other runs of the day are touched.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import re
import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from rulewatch.functions.hashing import row_hash
from rulewatch.functions.predicates import ARCHIVE_DAY, business_columns
from rulewatch.operators.findings import set_sums
from rulewatch.operators.grouping import latest_per_key
from rulewatch.sources.schemas import common_schema, fit
from rulewatch.sources.versions import Versions

DAY = ARCHIVE_DAY
INDEX, GRAM, GRAM_BITS = "_trigrams", 3, 1 << 15  # the search index: its folder, characters and bits a file
FAILURES = (PySparkException, Py4JJavaError)
CHANGED = ("CANNOT_MERGE_SCHEMAS", "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE")  # Spark's conditions for types that changed


def run_time(run_ts: dt.datetime) -> Column:
    """A run's time; without an offset it is read in the session's time zone, not the machine's."""
    return F.lit(run_ts.isoformat(sep=" ")).cast("timestamp")


@dataclasses.dataclass(frozen=True)
class Moment:
    """A run's time as the session's time zone shows it, whatever offset it was given in."""

    micros: int
    day: str
    clock: str


def moment_of(spark: SparkSession, run_ts: dt.datetime) -> Moment:
    at = run_time(run_ts)
    clock = F.concat(F.date_format(at, "HHmmss"), F.when(F.unix_micros(at) % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""))
    row = spark.range(1).select(F.unix_micros(at), F.date_format(at, "yyyy-MM-dd"), clock).first()
    return Moment(*row)


def run_folder(spark: SparkSession, day: str, run_ts: dt.datetime) -> str:
    at = moment_of(spark, run_ts)
    return f"{day}={at.day}/run_at={at.clock}s"


def stamp(findings: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """Findings with the run time every archived row carries."""
    return findings.withColumn("ArchiveDate", run_time(run_ts))


def write_findings(findings: DataFrame, folder: str, test_id: str, run_ts: dt.datetime) -> str:
    """Write one run's findings, replacing those of the same rule and run; returns their folder."""
    path = findings_path(findings.sparkSession, folder, test_id, run_ts)
    stamp(findings, run_ts).write.mode("overwrite").parquet(path)
    return path


def write_counted(findings: DataFrame, folder: str, test_id: str, run_ts: dt.datetime) -> dict:
    """As ``write_findings``, of flagged findings; gives their counts and sums, observed by the writing job.

    The sums are taken in the tasks that write, of which each counts once, however often it was tried.
    """
    seen = Observation()
    hashed = findings.withColumn("_row_hash", row_hash(findings.columns))
    counted = hashed.observe(seen, *[c.alias(n) for n, c in set_sums().items()]).drop("_row_hash")
    write_findings(counted, folder, test_id, run_ts)
    return seen.get


def findings_path(spark: SparkSession, folder: str, test_id: str, run_ts: dt.datetime) -> str:
    return f"{folder}/{quote(test_id, safe='')}/{run_folder(spark, DAY, run_ts)}"


def read_findings(spark: SparkSession, folder: str, test_id: str) -> DataFrame:
    """A rule's archive over all runs; columns added later are NULL before, see ``Archive.read``."""
    return Archive(spark, folder, test_id).read()


class Archive:
    """The findings of one rule, run by run."""

    def __init__(self, spark: SparkSession, folder: str, test_id: str):
        self.spark, self.folder = spark, f"{folder}/{quote(test_id, safe='')}"

    def runs(self, first_day: str | None = None, last_day: str | None = None) -> list[tuple[str, str, str]]:
        """``(day, clock, path)`` of every run, newest first: names of folders, no file is opened."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        for status in fs.globStatus(path(f"{self.folder}/{DAY}=*/run_at=*")) or []:
            day, clock = (unquote(p.getName().split("=", 1)[1]) for p in (status.getPath().getParent(), status.getPath()))
            if (first_day is None or day >= first_day) and (last_day is None or day <= last_day):
                found.append((day, clock.rstrip("s"), status.getPath().toString()))
        return sorted(found, reverse=True)

    def files(self, runs: list | None = None) -> list[str]:
        """Paths of the runs' files, in their order; names of files are unique, however often a run is repeated."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        every = [f.getPath().toString() for f in fs.globStatus(path(f"{self.folder}/{DAY}=*/run_at=*/*.parquet")) or []]
        of: dict[str, list[str]] = {}
        for f in every:
            of.setdefault(f.rsplit("/", 1)[0], []).append(f)
        return [f for *_, p in (self.runs() if runs is None else runs) for f in of.get(p, [])]

    def read(self, paths: list[str] | None = None, wanted: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """All runs, or those of some folders or files.

        A column that some runs lack is NULL there.  Where types changed, runs are read in groups of one type and
        brought to the least type that takes all values (``schemas.common_type``), whatever was written last;
        ``wanted`` sees the rows before, in their own types.
        """
        paths = [self.folder] if paths is None else paths
        groups = [wanted(self._merged(g)) for g in self._groups(paths)]
        if len(groups) == 1:
            return groups[0]
        schema = common_schema([g.schema for g in groups])
        return functools.reduce(DataFrame.unionByName, [fit(g, schema) for g in groups])

    def _merged(self, paths: list[str]) -> DataFrame:
        return self.spark.read.options(mergeSchema=True, basePath=self.folder).parquet(*paths)

    def _groups(self, paths: list[str]) -> list[list[str]]:
        """Neighbouring runs whose types agree, found by halving: a few reads of footers for each change of type."""
        try:
            self._merged(paths)
            return [paths]
        except FAILURES as problem:
            if not any(c in str(problem) for c in CHANGED) or paths != [self.folder] and len(paths) == 1:
                raise
        paths = [p for *_, p in reversed(self.runs())] if paths == [self.folder] else paths
        half = len(paths) // 2
        return self._groups(paths[:half]) + self._groups(paths[half:])

    def indexed(self) -> DataFrame:
        """``file_name, grams``: the search index, a bitmap for each file."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{INDEX}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "file_name string, grams binary")
        return self.spark.read.schema("file_name string, grams binary").parquet(f"{self.folder}/{INDEX}")

    def index(self) -> None:
        """Add the files that are not in the index yet; may be repeated.

        A file's bitmap has a bit for the hash of each three characters that lie in one value, lower-cased as
        the search does it: a Bloom filter with one hash, of fixed size.
        """
        known = {r["file_name"] for r in self.indexed().select("file_name").collect()}
        new = [f for f in self.files() if f.rsplit("/", 1)[1] not in known]
        if not new:
            return
        parts = []
        for group in self._groups(new):
            rows = self._merged(group)
            values = F.array(*[F.lower(F.col(f"`{c}`").cast("string")) for c in business_columns(rows)], F.lit(None).cast("string"))
            rows = rows.select(F.col("_metadata.file_name").alias("file_name"), F.explode(F.array_distinct(values)).alias("value"))
            starts = F.when(F.length("value") >= GRAM, F.sequence(F.lit(1), F.length("value") - GRAM + 1))
            grams = rows.select("file_name", F.explode(F.transform(starts, lambda i: F.substring(F.col("value"), i, F.lit(GRAM)))).alias("gram"))
            bits = grams.select("file_name", F.pmod(F.xxhash64("gram"), F.lit(GRAM_BITS)).alias("bit")).distinct()
            found = bits.groupBy("file_name").agg(F.bitmap_construct_agg("bit").alias("grams"))
            names = self.spark.createDataFrame([(f.rsplit("/", 1)[1],) for f in group], "file_name string")
            parts.append(names.join(found, "file_name", "left").withColumn("grams", F.coalesce("grams", F.lit(bytes(GRAM_BITS // 8)))))
        functools.reduce(DataFrame.unionByName, parts).coalesce(1).write.mode("append").parquet(f"{self.folder}/{INDEX}")

    def matching(self, text: str | None, files: list[str] | None = None) -> list[str]:
        """The files that may hold a search text; those without an entry in the index may."""
        files = self.files() if files is None else files
        # A wildcard matches anything and a space may lie between two values.
        parts = re.split(r"[%_\\\s]+", (text or "").strip().lower())
        grams = sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})
        if not grams:
            return files
        row = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(GRAM_BITS)).alias("bit"))
        absent = F.lit(False)
        for bit in sorted({r["bit"] for r in row.collect()}):
            byte = F.conv(F.hex(F.substring("grams", bit // 8 + 1, 1)), 16, 10).cast("int")
            absent |= byte.bitwiseAND(F.lit(1 << bit % 8)) == 0
        without = {r["file_name"] for r in self.indexed().where(absent).select("file_name").collect()}
        return [f for f in files if f.rsplit("/", 1)[1] not in without]

    def newest(
        self, limit: int, wanted: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        runs: list | None = None, text: str | None = None,
    ) -> tuple[list[str], bool]:
        """Folders of the newest runs that hold ``limit`` of the rows ``wanted`` keeps, and whether there are more.

        Runs are opened from the newest backwards, one, then two, four and so on, until one row more than the
        limit is found; older ones are never opened.  With a search ``text`` only files that may hold it are.
        """
        runs = self.runs() if runs is None else runs
        if text and text.strip():
            files = self.matching(text, self.files(runs))
            runs = [(f,) for f in files] if len(files) < len(self.files(runs)) else runs
        opened, found, at, width = [], 0, 0, 1
        while at < len(runs) and found <= limit:
            paths = [p for *_, p in runs[at : at + width]]
            found += self.read(paths, wanted).limit(limit + 1 - found).count()
            opened += paths
            at, width = at + width, width * 2
        return opened, found > limit


def replace_by_key(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``target`` with all rows of the new keys replaced.  Publish to a new folder."""
    keys = new.select(key).distinct()
    return target.join(keys, key, "left_anti").unionByName(new, allowMissingColumns=True)


def publish(df: DataFrame, folder: str, version: str) -> DataFrame:
    """Write a new version of a table beside the old ones, make it the current one, and read it.

    Readers of ``read_published`` see the version before until all of this one is written.
    """
    spark, path = df.sparkSession, f"version={quote(version, safe='')}/{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{path}")
    Versions(spark, folder).update(lambda document, number: {"path": path, "version": version})
    return spark.read.parquet(f"{folder}/{path}")


def published(spark: SparkSession, folder: str) -> list[dict]:
    """``number, version, path`` of the versions still known, oldest first."""
    versions = Versions(spark, folder)
    return [{"number": n, **versions.at(n)} for n in versions.numbers()]


def read_published(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """The current version of a published table, or the last one published under a name."""
    found = [v for v in published(spark, folder) if version in (None, v["version"])]
    if not found:
        raise ValueError(f"{folder} has no version {version or ''}".rstrip())
    return spark.read.parquet(f"{folder}/{found[-1]['path']}")


def publish_replaced(new: DataFrame, folder: str, key: str, version: str) -> DataFrame:
    """Replace all rows of the new keys in a published table, one writer after another.

    If another version was published meanwhile, the rows are replaced in that one.
    """
    spark = new.sparkSession

    def change(document: dict, number: int) -> dict:
        path = f"version={quote(version, safe='')}/{uuid.uuid4().hex}"
        target = spark.read.parquet(f"{folder}/{document['path']}") if document else new.limit(0)
        replace_by_key(target, new, key).write.parquet(f"{folder}/{path}")
        return {"path": path, "version": version}

    done = Versions(spark, folder).update(change)
    return spark.read.parquet(f"{folder}/{done['path']}")


def apply_revocations(rows: DataFrame, events: DataFrame, key: str, at: str, revoked: str) -> DataFrame:
    """``active`` per row from an append-only event log: the latest event decides.

    Rows without events keep their own flag.
    """
    latest = latest_per_key(events.select(key, at, "event_type"), [key], [at, "event_type"])
    flags = latest.select(key, (F.col("event_type") != revoked).alias("_active"))
    return rows.join(flags, key, "left").withColumn(
        "active", F.coalesce("_active", "active")
    ).drop("_active")
