"""Published snapshots: data folders that never change, and a version pointer that readers pin.

A writer puts its data under a fresh name first and then publishes a small JSON file ``versions/v<number>.json`` by a
rename that fails where the number is taken.  Readers open the file of one version and see its folders only, whatever
is published meanwhile.  Works on every file system that Spark writes to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TRIES = 20


class Versions:
    """The version files of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs.Path(f"{self.folder}/versions/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """All published versions, ascending."""
        hits = self._system().globStatus(self._path("v*.json"))
        return sorted(int(h.getPath().getName()[1:-5]) for h in hits or [])

    def read(self, number: int | None = None) -> tuple[int, dict] | None:
        """``(number, content)`` of a version, of the latest one by default; None before the first."""
        known = self.numbers()
        if not known or (number is not None and number not in known):
            return None
        number = known[-1] if number is None else number
        path = self._path(f"v{number:010d}.json")
        size = self._system().getFileStatus(path).getLen()
        stream = self._system().open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") if size else ""
        finally:
            stream.close()
        return number, json.loads(text)

    def commit(self, change: Callable[[dict | None], dict]) -> int:
        """Publish ``change(latest content)`` as the next version; a writer that comes second starts over from the first one's."""
        for _ in range(TRIES):
            last = self.read()
            number = (last[0] if last else 0) + 1
            token = uuid.uuid4().hex
            content = {**change(last[1] if last else None), "token": token}
            waiting = self._path(f"_waiting-{token}")
            stream = self._system().create(waiting, True)
            stream.write(bytearray(json.dumps(content).encode()))
            stream.close()
            if self._rename(waiting, self._path(f"v{number:010d}.json")) and self.read(number)[1]["token"] == token:
                return number
            self._system().delete(waiting, False)
        raise RuntimeError(f"{self.folder}: version not published after {TRIES} tries")

    def _rename(self, source, target) -> bool:
        """Atomic where the file system has an atomic rename; False if the target exists."""
        from py4j.protocol import Py4JJavaError

        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            self._fs.FileContext.getFileContext(source.toUri(), self._conf).rename(source, target, none)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True


def publish(spark: SparkSession, folder: str, frames: dict[str, DataFrame]) -> int:
    """Write ``frames`` and publish them as the next version, next to the names the last one has and ``frames`` has not."""
    paths = write_frames(folder, frames)
    return Versions(spark, folder).commit(lambda last: {"frames": {**(last or {}).get("frames", {}), **paths}})


def write_frames(folder: str, frames: dict[str, DataFrame], *by: str) -> dict[str, str]:
    paths = {name: f"data/{name}-{uuid.uuid4().hex}" for name in frames}
    for name, df in frames.items():
        df.write.mode("errorifexists").partitionBy(*by).parquet(f"{folder}/{paths[name]}")
    return paths


def build_if_absent(spark: SparkSession, folder: str, build: Callable[[], dict[str, DataFrame]], *by: str) -> int:
    """The latest version, built and published first if there is none.  Of two builders at once one is kept."""
    versions = Versions(spark, folder)
    known = versions.read()
    if known:
        return known[0]
    paths = write_frames(folder, build(), *by)
    return versions.commit(lambda last: last if last else {"frames": paths})


def open_snapshot(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The frames of one version (the latest by default); they stay the same while later versions are published."""
    found = Versions(spark, folder).read(version)
    if found is None:
        raise FileNotFoundError(f"{folder}: no version {'published' if version is None else version}")
    return {name: spark.read.parquet(f"{folder}/{path}") for name, path in found[1]["frames"].items()}
