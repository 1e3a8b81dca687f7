"""Small tables that are replaced as a whole, version by version, and keep what was committed whatever dies.

A version's rows are written aside, in a folder of their own. It becomes current by one marker, ``log/<n>``, a small file that names the folder and can be
made only once; markers are numbered without gaps. A writer that dies before its marker changes nothing, a reader sees committed versions
only, and of two writers of one number one wins; the other works on what the winner left and takes the next number. That needs a store whose rename
refuses to replace a file (HDFS and its like; a local folder by a hard link).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Versions:
    """A table under ``path`` with columns ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self._conf)

    def last(self) -> int:
        """The number of the current version, -1 if there is none."""
        root, fs = self._at("log")
        numbers = [int(n) for s in fs.listStatus(root) if (n := s.getPath().getName()).isdigit()] if fs.exists(root) else []
        return max(numbers, default=-1)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the current one if none is named; no rows before the first."""
        number = self.last() if number is None else number
        if number < 0:
            return self.spark.createDataFrame([], self.schema)
        marker = json.loads(self.spark.read.text(f"{self.path}/log/{number}", wholetext=True).first().value)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{marker['rows']}")

    def _publish(self, number: int, rows: str) -> bool:
        """Make the marker; false if there is one."""
        jvm = self.spark._jvm
        final, fs = self._at(f"log/{number}")
        aside, _ = self._at(f"aside/{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"rows": rows}).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        final, aside = fs.makeQualified(final), fs.makeQualified(aside)
        try:
            if final.toUri().getScheme() == "file":
                jvm.java.nio.file.Files.createLink(jvm.java.nio.file.Paths.get(final.toUri()), jvm.java.nio.file.Paths.get(aside.toUri()))
            else:
                no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(aside, final, no_overwrite)
        except Py4JJavaError:
            if fs.exists(final):
                return False
            raise
        return True

    def commit(self, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Replace the current rows by ``make(current rows)``; ``make`` is called again if another writer came first. Returns the new rows."""
        while True:
            number = self.last()
            rows = f"rows/{uuid.uuid4().hex}"
            new = make(self.read(number))
            new.select(*self.read(-1).columns).write.parquet(f"{self.path}/{rows}")
            if self._publish(number + 1, rows):
                return self.read(number + 1)
            lost, fs = self._at(rows)
            fs.delete(lost, True)
