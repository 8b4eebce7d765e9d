"""Finished steps of a long run: one small JSON file per step, beside the run's data.

A file is written under another name and renamed, so a step is either on record as a
whole or not at all; what an unfinished step wrote is written again. Files go through
Hadoop's FileSystem, so they lie in any store that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..session import delete_path


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        context = spark.sparkContext
        self._jvm, self._conf = context._jvm, context._jsc.hadoopConfiguration()

    def _file(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self._conf)

    def done(self, step: str, **facts) -> None:
        """Put a step on record, in place of an earlier record of it."""
        draft, store = self._file(f".{step}.json.draft")
        out = store.create(draft, True)
        out.write(bytearray(json.dumps(facts).encode()))
        out.close()
        final, _ = self._file(f"{step}.json")
        store.delete(final, False)
        if not store.rename(draft, final):
            raise OSError(f"{final} can't be written")

    def steps(self) -> dict[str, dict]:
        """The facts of every step on record."""
        folder, store = self._file("")
        if not store.exists(folder):
            return {}
        found = {}
        for status in store.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                stream = store.open(status.getPath())
                found[name.removesuffix(".json")] = json.loads(bytes(stream.readAllBytes()))
                stream.close()
        return found

    def forget(self) -> None:
        delete_path(self.spark, self.path)
