"""Small states of long work in a folder that outlives the driver: numbered files, each put in place by one rename."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

_NAME = re.compile(r"state-(\d+)\.json$")


class StateFolder:
    """The last states of a fit or stream. A state is there whole or not at all, and the newest whole one counts."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return sorted(int(m[1]) for m in map(_NAME.match, names) if m)

    def put(self, number: int, text: str) -> None:
        """Writes beside, then renames; older states but the last few go."""
        own = self._path(f"{self.folder}/state-{number:012d}.json")
        beside = self._path(f"{self.folder}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(own):  # the same step again, after a restart: the earlier one stands
            self._fs.delete(beside, False)
        elif not self._fs.rename(beside, own):
            raise OSError(f"{own.toString()} could not be put in place")
        for n in self.numbers()[: -self.keep]:
            self._fs.delete(self._path(f"{self.folder}/state-{n:012d}.json"), False)

    def latest(self) -> tuple[int, str] | None:
        found = self.numbers()
        if not found:
            return None
        data = self._fs.open(self._path(f"{self.folder}/state-{found[-1]:012d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        data.close()
        return found[-1], text

    def clear(self) -> None:
        self._fs.delete(self._path(self.folder), True)
