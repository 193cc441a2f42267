"""Directory listings, tags and audio of files."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are audio. Fixed values.
EXTENSIONS = ("mp3", "flac", "aiff", "aif", "wav", "ogg", "m4a")
#: Chunk names of a RIFF INFO list by tag. Fixed values.
INFO = {"title": b"INAM", "artist": b"IART", "album": b"IPRD", "genre": b"IGNR", "comment": b"ICMT", "year": b"ICRD", "track_number": b"ITRK"}


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True, known: DataFrame | None = None) -> DataFrame:
    """filepath, filename, file_size and modified of files with such extensions in any case, sorted, without known paths (filepath)."""
    ext = "|".join(extensions)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).drop("content")
    rows = rows.filter(F.lower("path").rlike(rf"\.({ext})$")).select(F.regexp_replace("path", "^file:/*", "/").alias("filepath"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    if known is not None:
        rows = rows.join(known.select("filepath"), "filepath", "left_anti")
    return rows.withColumn("filename", F.regexp_extract("filepath", "([^/]*)$", 1)).orderBy("filepath")


def first_tag(tags: Column, names: tuple[str, ...]) -> Column:
    """The first of several names that a map of tags has."""
    return F.coalesce(*[F.try_element_at(tags, F.lit(n)) for n in names])


def year_of(c: Column) -> Column:
    return F.left(c, F.lit(4)).try_cast("int")


def track_of(c: Column) -> Column:
    """The number before a slash."""
    return F.split(c, "/")[0].try_cast("int")


def read_info(data: bytes) -> dict[str, str]:
    """Tags of the INFO list of a RIFF file."""
    found, names = {}, {v: k for k, v in INFO.items()}
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"INFO":
            i, end = at + 12, min(at + 8 + size, len(data))
            while i + 8 <= end:
                n, s = data[i : i + 4], struct.unpack("<I", data[i + 4 : i + 8])[0]
                if n in names:
                    found[names[n]] = data[i + 8 : i + 8 + s].rstrip(b"\0").decode("utf-8", "replace")
                i += 8 + s + s % 2
        at += 8 + size + size % 2
    return found


def write_info(data: bytes, tags: dict[str, str]) -> bytes:
    """The RIFF file with these tags changed; an empty value deletes a tag, others stay."""
    kept = {k: v for k, v in (read_info(data) | tags).items() if v and k in INFO}
    out, at = b"", 12
    while at + 8 <= len(data):
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        chunk = data[at : at + 8 + size + size % 2]
        if not (chunk[:4] == b"LIST" and chunk[8:12] == b"INFO"):
            out += chunk
        at += 8 + size + size % 2
    if kept:
        items = b""
        for k, v in kept.items():
            raw = v.encode() + b"\0"
            items += INFO[k] + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
        out += b"LIST" + struct.pack("<I", len(items) + 4) + b"INFO" + items
    return data[:4] + struct.pack("<I", len(out) + 4) + b"WAVE" + out


def decode(data: bytes, rate: int = 22_050, offset: float = 0.0, duration: float | None = None) -> np.ndarray:
    """Mono samples of a WAV file at the rate, from offset on, by linear resampling."""
    with wave.open(io.BytesIO(data)) as w:
        own, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        w.setpos(min(w.getnframes(), int(offset * own)))
        raw = w.readframes(w.getnframes() if duration is None else int(duration * own))
    if width == 2:
        x = np.frombuffer(raw, "<i2") / 32768.0
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128.0
    else:
        x = np.frombuffer(raw, "<i4") / 2147483648.0
    x = x.reshape(-1, channels).mean(axis=1)
    return x if own == rate else np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x)


def read_audio(spark: SparkSession, folder: str, rate: int = 22_050, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """path, rate, samples and tags of WAV files; one that can't be read has null samples. Long recordings: cut by offset and duration."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, data in zip(p.path, p.content, strict=True):
                try:
                    rows.append((path, rate, decode(data, rate, offset, duration).tolist(), read_info(data)))
                except (wave.Error, EOFError):
                    rows.append((path, rate, None, {}))
            yield pd.DataFrame(rows, columns=["path", "rate", "samples", "tags"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<double>, tags map<string,string>")
