"""Numbered manifests: what a folder of files means, as small files that are only ever added.

A manifest is written under a number of its own, and whoever comes second to a number fails, so two
writers cannot both follow one state.  It ends with a line feed: one that a crash cut short is not
complete, is passed over, and its number is not used again.  Nothing is overwritten, so a reader
always finds a whole state: the one before or the one after.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer has committed meanwhile."""


class Manifest:
    """The manifests in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Of all manifests, complete or not, latest first."""
        at, files = self._at(self.folder)
        if not files.exists(at):
            return []
        names = [x.getPath().getName() for x in files.listStatus(at)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def value(self, number: int) -> dict | None:
        """None if it is not complete, or gone."""
        at, files = self._at(f"{self.folder}/{number:012d}")
        if not files.exists(at):
            return None
        stream = files.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def latest(self) -> tuple[int, dict] | None:
        """Number and value of the last complete manifest."""
        for n in self.numbers():
            value = self.value(n)
            if value is not None:
                return n, value
        return None

    def commit(self, value: dict, after: int | None = None) -> int:
        """Add a manifest; its number.  ``after`` is the number of the state that it follows: if a complete one came later, ``Taken``."""
        now = self.latest()
        if (now[0] if now else None) != after:
            raise Taken(f"{self.folder}: {now} was committed after {after}")
        number = max([0, *self.numbers()]) + 1
        at, files = self._at(f"{self.folder}/{number:012d}")
        try:
            stream = files.create(at, False)
        except Exception as e:
            raise Taken(f"{self.folder}: number {number} is taken") from e
        try:
            stream.write(bytearray((json.dumps(value) + "\n").encode()))
        finally:
            stream.close()
        return number

    def forget(self, keep: int) -> list[dict]:
        """Delete all but the last ``keep`` complete manifests; the values of those that went."""
        gone, held = [], 0
        for n in self.numbers():
            value = self.value(n)
            held += value is not None
            if value is None or held > keep:
                at, files = self._at(f"{self.folder}/{n:012d}")
                if held:  # what lies after the last complete one may be being written
                    files.delete(at, False)
                gone += [value] if value is not None else []
        return gone
