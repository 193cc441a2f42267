"""Tables as folders of snapshots: a change is written beside the old state and becomes the state when a new list of snapshots is made."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Closes a list; one without it is still being written.
_END = "."


class Store:
    """Named tables under a folder. In a transaction all changes become visible together, or none does.

    The state is the newest whole list of names and snapshots. Lists are
    numbered, and the file of a number can be created once: of two writers that
    started from the same state the second is refused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.pending = spark, folder, None
        jvm = spark.sparkContext._jvm
        self.path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([folder, *parts]))
        self.fs = self.path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict[str, str]]:
        """The number of the next list, and what the newest whole one says."""
        lists = sorted(p.getPath().getName() for p in (self.fs.listStatus(self.path("_states")) if self.fs.exists(self.path("_states")) else []))
        lists = [x for x in lists if x.isdigit()]
        for name in reversed(lists):
            rows = [r[0] for r in self.spark.read.text(f"{self.folder}/_states/{name}").collect()]
            if _END in rows:
                return int(lists[-1]) + 1, dict(r.split("\t") for r in rows if r != _END)
        return (int(lists[-1]) + 1 if lists else 0), {}

    def has(self, name: str) -> bool:
        return name in (self.pending if self.pending is not None else self._state()[1])

    def read(self, name: str) -> DataFrame:
        state = self.pending if self.pending is not None else self._state()[1]
        return self.spark.read.parquet(f"{self.folder}/{name}/{state[name]}")

    def write(self, name: str, df: DataFrame) -> None:
        with self.transaction():
            version = uuid.uuid4().hex
            df.write.parquet(f"{self.folder}/{name}/{version}")
            self.pending[name] = version

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """An inner transaction is part of the outer one. An error leaves the state as it was."""
        if self.pending is not None:
            yield
            return
        number, before = self._state()
        self.pending = dict(before)
        try:
            yield
            if self.pending != before:
                self._put(number, "".join(f"{k}\t{v}\n" for k, v in sorted(self.pending.items())) + _END + "\n")
        finally:
            self.pending = None

    def _put(self, number: int, said: str) -> None:
        self.fs.mkdirs(self.path("_states"))
        try:
            out = self.fs.create(self.path("_states", f"{number:012d}"), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise RuntimeError("another writer was first") from e
            raise
        try:
            out.write(bytearray(said.encode()))
        finally:
            out.close()
