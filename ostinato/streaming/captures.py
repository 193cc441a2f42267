"""Live captures: files of samples that something else appends to, read as a stream with offsets, and polled at an interval.

The stream itself carries claims only, rows that say which frames of which file
a batch has; tasks read the samples. An offset is how many frames of each file
have been claimed, so that a query that starts again from its checkpoint claims
what was not claimed, and repeats a batch that didn't end with the same frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

_CLAIM = "source string, path string, first long, frames long"


def _store(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), folder)


class CaptureReader(SimpleDataSourceStreamReader):
    """Claims of at most `most` frames a file and batch, `part` frames a row."""

    def __init__(self, options: dict):
        self.folder, self.size = options["path"], int(options.get("frame", 1024)) * 2
        self.most, self.part = int(options.get("most", 1000)), int(options.get("part", 64))

    def initialOffset(self) -> dict:
        return {}

    def _frames(self) -> dict[str, int]:
        """Whole frames in each file; the last part of one may still be being written."""
        store, root = _store(self.folder)
        found = store.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        return {f.base_name: f.size // self.size for f in found if f.is_file and f.extension == "pcm"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {**start, **{name: min(n, start.get(name, 0) + self.most) for name, n in self._frames().items() if n > start.get(name, 0)}}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A claim for each part of a file, as many as a batch's bound lets through."""
        parts = [(name, first, to) for name, to in sorted(end.items()) for first in range(start.get(name, 0), to, self.part)]
        return iter([(name.rsplit(".", 1)[0], f"{self.folder.rstrip('/')}/{name}", first, min(self.part, to - first)) for name, first, to in parts])


class Captures(DataSource):
    """Files `<source>.pcm` of a folder: 16-bit samples, `frame` of them a frame."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return _CLAIM

    def simpleStreamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def read_frames(claims: DataFrame, frame: int) -> DataFrame:
    """(source, frame, samples) of claims; samples from -1 to 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for source, path, first, frames in zip(p["source"], p["path"], p["first"], p["frames"], strict=True):
                store, at = _store(path)
                with store.open_input_file(at) as f:
                    f.seek(int(first) * frame * 2)
                    x = np.frombuffer(f.read(int(frames) * frame * 2), "<i2").reshape(-1, frame) / 32768.0
                yield pd.DataFrame({"source": source, "frame": np.arange(first, first + frames), "samples": list(x)})

    return claims.mapInPandas(run, "source string, frame long, samples array<double>")


def live(spark: SparkSession, folder: str, frame: int = 1024, most: int = 1000, part: int = 64) -> DataFrame:
    """A stream of frames of the captures in a folder; a batch has at most `most` a file."""
    spark.dataSource.register(Captures)
    claims = spark.readStream.format("captures").option("frame", frame).option("most", most).option("part", part).load(folder)
    # claims come from the driver in one partition
    return read_frames(claims.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), frame)


def poll(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, every: str = "50 milliseconds"):
    """Hand each batch to a function, one batch an interval at most. A batch that was cut off comes again under its number."""
    return stream.writeStream.foreachBatch(handler).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
