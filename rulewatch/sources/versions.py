"""Versions of a folder's content, switched in one step.

A folder holds small JSON documents ``_versions/<number>.json``; the highest number is what readers see.  A
document is written under another name and renamed, which fails if the number is taken: of two writers
that started from one version, one wins and the other starts again from the winner's.  Data that a
document names is complete before the document is there, so readers see the old or the new version
whole.  The rename is atomic on HDFS and the like; a plain local disk checks and renames.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

KEPT = 20  # versions whose documents stay
TRIES = 50


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/_versions"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))

    def at(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        """Number and document of the newest version; 0 and an empty one before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.at(numbers[-1])) if numbers else (0, {})

    def commit(self, base: int, document: dict) -> bool:
        """Make a document the version after ``base``; false if there is one already."""
        draft, target = self._path(f".{uuid.uuid4().hex}"), self._path(f"{base + 1:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(target).toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), never)
        except Py4JJavaError as problem:
            self._fs.delete(draft, False)
            if "AlreadyExists" not in problem.java_exception.getClass().getName():
                raise
            return False
        for old in self.numbers()[:-KEPT]:
            self._fs.delete(self._path(f"{old:012d}.json"), False)
        return True

    def update(self, change: Callable[[dict, int], dict | None]) -> dict | None:
        """Commit ``change(document, next number)``, from the newest document again after each lost race.

        ``change`` gives None to leave things as they are.
        """
        for _ in range(TRIES):
            base, document = self.current()
            changed = change(document, base + 1)
            if changed is None:
                return None
            if self.commit(base, changed):
                return changed
        raise RuntimeError(f"{self.folder}: other writers were faster {TRIES} times")
