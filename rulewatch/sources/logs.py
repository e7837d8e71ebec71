"""The log of runs: one small part a run, and the latest state of every rule.

The run log, the hash log and the outbox are projections of one table of classified runs, so a run appears in
all three at once and a repeated rule replaces its rows in all three.  What a new run is compared with comes
from ``latest``, one row a rule, rewritten by every run: a daily run reads that and nothing older.  Only a run
that is repeated after a later one looks into the levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulewatch.sources.archive import Moment
from rulewatch.sources.levels import RUN, Levels
from rulewatch.sources.schemas import control_schema, to_schema, widen

KEYS = ["test_name"]
RUNS = """
    test_id string, test_name string, description string, responsible_area string, risco_id string, frequency string,
    execution_date timestamp, clean_count long, row_count long, seconds float, threshold int, result string, channel boolean,
    error string, incident_hash string, is_suppressed boolean, is_recurrent boolean, is_continued boolean,
    should_notify boolean, alert_state string, message_id string, payload string"""
LATEST = "test_name string, run_at timestamp, result string, suppressed boolean, hash_at timestamp, incident_hash string"

# Where the columns of the two logs come from.
RUN_LOG = {
    "TestName": "test_name", "Description": "description", "ResponsibleArea": "responsible_area", "RiskId": "risco_id",
    "Frequency": "frequency", "ExecutionDate": "execution_date", "IncidentCount": "clean_count", "IncidentCountRaw": "row_count",
    "ExecutionTimeSec": "seconds", "Threshold": "threshold", "TestResult": "result", "ShouldActivateChannel": "channel",
    "ErrorMessage": "error", "IsSupressed": "is_suppressed", "IsRecurrent": "is_recurrent", "IsContinued": "is_continued",
}
PRIOR = {"tb_tests_executions": ("TestName", "ExecutionDate"), "tb_incident_hashes": ("test_name", "execution_date")}


def run_log_of(runs: DataFrame) -> DataFrame:
    schema = control_schema("tb_tests_executions")
    return runs.select("test_id", *[F.col(RUN_LOG[f.name]).cast(f.dataType).alias(f.name) for f in schema])


def hash_log_of(runs: DataFrame) -> DataFrame:
    """A failed run has no row; a run without findings has one with a NULL hash."""
    schema = control_schema("tb_incident_hashes")
    return runs.where(F.col("result") != "ERROR").select("test_id", *[F.col(f.name).cast(f.dataType) for f in schema])


def outbox_of(runs: DataFrame) -> DataFrame:
    return runs.where("should_notify").select("test_id", "message_id", "test_name", "execution_date", "payload")


def _events(rows: DataFrame, at: str | Column, run: Column, hash_: Column) -> DataFrame:
    at = F.col(at) if isinstance(at, str) else at
    return rows.select("test_name", at.alias("at"), run.alias("run"), hash_.alias("hash"))


NO_RUN = "struct<result:string,suppressed:boolean>"
NO_HASH = "struct<incident_hash:string>"


def latest_of(events: DataFrame) -> DataFrame:
    """The last run and the last hash of every rule, from ``test_name, at, run, hash``."""
    run_at, hash_at = (F.when(F.col(c).isNotNull(), F.col("at")) for c in ("run", "hash"))
    last = events.groupBy("test_name").agg(
        F.max(run_at).alias("run_at"), F.max_by("run", run_at).alias("run"),
        F.max(hash_at).alias("hash_at"), F.max_by("hash", hash_at).alias("hash"),
    )
    return last.select("test_name", "run_at", "run.result", "run.suppressed", "hash_at", "hash.incident_hash")


def previous_of(latest: DataFrame) -> DataFrame:
    """``test_name, _prev_run, _prev_hash`` as ``classify_after`` takes them."""
    return latest.select(
        "test_name",
        F.when(F.col("run_at").isNotNull(), F.struct("result", "suppressed")).alias("_prev_run"),
        F.when(F.col("hash_at").isNotNull(), F.struct("incident_hash")).alias("_prev_hash"),
    )


class RunLog:
    def __init__(self, spark: SparkSession, folder: str, fanout: int = 8):
        self.spark, self.levels = spark, Levels(spark, f"{folder.rstrip('/')}/log", fanout)
        self.schema, self.latest_schema = to_schema(RUNS), to_schema(LATEST)

    def runs(self, before: int | None = None, document: dict | None = None) -> DataFrame:
        return self.levels.read("runs", self.schema, KEYS, self.levels.parts("runs", document), before)

    def read(self, table: str) -> DataFrame:
        """``tb_tests_executions`` or ``tb_incident_hashes``, with ``test_id``, or ``outbox``."""
        if table == "outbox":
            return outbox_of(self.runs())
        mine = {"tb_tests_executions": run_log_of, "tb_incident_hashes": hash_log_of}[table](self.runs())
        older = self._prior(table)
        return mine if older is None else mine.unionByName(older)

    def _prior(self, table: str, before: int | None = None, document: dict | None = None) -> DataFrame | None:
        parts = self.levels.parts(table, document)
        schema = to_schema("test_id string").add("_key", "string")
        for f in control_schema(table):
            schema = schema.add(f)
        return self.levels.read(table, schema, ["_key"], parts, before).drop("_key", RUN) if parts else None

    def adopt(self, rows: DataFrame, table: str) -> None:
        """Take over log rows written elsewhere, of runs before those of this log; columns they lack are NULL."""
        name, at = PRIOR[table]
        rows = widen(rows, to_schema("test_id string").add("_key", "string"))
        rows = widen(rows, control_schema(table)).withColumn("_key", F.col(name))
        rows = rows.select("test_id", "_key", *[F.col(f.name).cast(f.dataType) for f in control_schema(table)])

        def change(document: dict, number: int) -> dict:
            part = self.levels.write(table, self.levels.stamped(rows, F.col(at), number))
            # What is latest must be found anew.
            return {k: v for k, v in document.items() if k != "latest"} | {table: [*document.get(table, []), part]}

        self.levels.versions.update(change)

    def _from_log(self, before: int | None, document: dict) -> DataFrame:
        """The latest state of every rule before a time, from all that is logged."""
        run, hash_ = (F.lit(None).cast(t) for t in (NO_RUN, NO_HASH))
        own = F.when(F.col("result") != "ERROR", F.struct("incident_hash"))
        events = _events(self.runs(before, document), RUN, F.struct("result", F.col("is_suppressed").alias("suppressed")), own)
        executions, hashes = (self._prior(t, before, document) for t in PRIOR)
        if executions is not None:
            rows = executions.withColumnRenamed("TestName", "test_name")
            events = events.unionByName(_events(rows, "ExecutionDate", F.struct(F.col("TestResult").alias("result"), F.col("IsSupressed").alias("suppressed")), hash_))
        if hashes is not None:
            events = events.unionByName(_events(hashes, "execution_date", run, F.struct("incident_hash")))
        return latest_of(events)

    def latest(self, document: dict | None = None) -> DataFrame:
        """The last run and hash of every rule."""
        document = self.levels.versions.current()[1] if document is None else document
        parts = self.levels.parts("latest", document)
        if not parts:
            return self._from_log(None, document)
        return self.levels.read("latest", self.latest_schema, KEYS, parts).drop(RUN)

    def before(self, at: Moment, names: DataFrame) -> DataFrame:
        """The state of the rules of ``names`` just before a run."""
        document = self.levels.versions.current()[1]
        latest = self.latest(document).join(names.select("test_name").distinct(), "test_name", "left_semi")
        now = F.timestamp_micros(F.lit(at.micros))
        known = latest.where(F.coalesce(F.greatest("run_at", "hash_at") < now, F.lit(True)))
        ahead = latest.where(F.greatest("run_at", "hash_at") >= now).select("test_name")
        if ahead.isEmpty():
            return known
        return known.unionByName(self._from_log(at.micros, document).join(ahead, "test_name", "left_semi"))

    def add(self, states: DataFrame, before: DataFrame, at: Moment) -> DataFrame:
        """Log a run's classified rules, of which ``before`` is the state just before it; returns the rows as stored."""
        now = F.timestamp_micros(F.lit(at.micros))
        rows = states.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        part = self.levels.write("runs", self.levels.stamped(rows, now, self.levels.versions.current()[0] + 1))
        stored = self.spark.read.schema(self.schema).parquet(f"{self.levels.folder}/{part['path']}")

        def change(document: dict, number: int) -> dict:
            kept = self.levels.write("latest", self.levels.stamped(self._after(document, stored, before, now), F.col("run_at"), number))
            return document | {"runs": [*document.get("runs", []), part], "latest": [kept]}

        self.levels.versions.update(change)
        self.levels.merge("runs", self.schema, KEYS)
        return stored

    def _after(self, document: dict, stored: DataFrame, before: DataFrame, now: Column) -> DataFrame:
        """``latest`` with a run added: it counts unless a later run, or a later hash, is known."""
        mine = stored.join(before.select("test_name", F.col("hash_at").alias("old_at"), F.col("incident_hash").alias("old_hash")), "test_name", "left")
        hashed = F.col("result") != "ERROR"
        mine = mine.select(
            "test_name", F.col("result").alias("my_result"), F.col("is_suppressed").alias("my_suppressed"),
            F.when(hashed, now).otherwise(F.col("old_at")).alias("my_hash_at"),
            F.when(hashed, F.col("incident_hash")).otherwise(F.col("old_hash")).alias("my_hash"), F.lit(True).alias("mine"),
        )
        joined = self.latest(document).join(mine, "test_name", "full")
        new_run = F.col("mine") & F.coalesce(F.col("run_at") <= now, F.lit(True))
        new_hash = F.col("mine") & F.coalesce(F.col("hash_at") <= now, F.lit(True))
        new_run, new_hash = (F.coalesce(c, F.lit(False)) for c in (new_run, new_hash))
        pick = lambda new, mine_, old: F.when(new, mine_).otherwise(F.col(old)).alias(old)
        return joined.select(
            "test_name", pick(new_run, now, "run_at"), pick(new_run, F.col("my_result"), "result"),
            pick(new_run, F.col("my_suppressed"), "suppressed"),
            pick(new_hash, F.col("my_hash_at"), "hash_at"), pick(new_hash, F.col("my_hash"), "incident_hash"),
        )


def read_log(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A log of a run folder; without runs it is empty."""
    return RunLog(spark, folder).read(table)
