"""A sink that changes the tags of files: all of a write, or none.

Tasks write new files into a folder aside. The commit first lists there what
replaces what, then moves file by file; one that was cut off can be finished by
the list. An aborted write leaves the files as they were, and nothing aside.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import write_info


def store_of(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote aside, and where it belongs."""

    moves: list[tuple[str, str]]


class TagWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.aside = f"{folder.rstrip('/')}/_tags-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        moves = []
        for r in rows:
            store, path = store_of(r["path"])
            with store.open_input_file(path) as f:
                data = f.read()
            _, aside = store_of(self.aside)
            store.create_dir(aside)
            made = f"{aside}/{uuid.uuid4().hex}"
            with store.open_output_stream(made) as f:
                f.write(write_info(data, dict(r["tags"] or {})))
            moves.append((made, path))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        moves = [m for said in messages if said for m in said.moves]
        store, aside = store_of(self.aside)
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("a file is named twice")
        if moves:
            with store.open_output_stream(f"{aside}/moves.part") as f:
                f.write(json.dumps(moves).encode())
            store.move(f"{aside}/moves.part", f"{aside}/moves.json")
            finish(store, aside)

    def abort(self, messages: list[Written | None]) -> None:
        store, aside = store_of(self.aside)
        if store.get_file_info(aside).type != arrow_fs.FileType.NotFound:
            store.delete_dir(aside)


def finish(store: arrow_fs.FileSystem, aside: str) -> None:
    """Do the moves that a commit listed and that are not done, and clear up."""
    with store.open_input_file(f"{aside}/moves.json") as f:
        moves = json.loads(f.read())
    for made, path in moves:
        if store.get_file_info(made).type == arrow_fs.FileType.File:
            store.move(made, path)
    store.delete_dir(aside)


def recover(folder: str) -> int:
    """Finish the commits of a folder that were cut off, undo writes that never came to one; how many were finished."""
    store, root = store_of(folder.rstrip("/"))
    done = 0
    for found in store.get_file_info(arrow_fs.FileSelector(root)):
        if found.base_name.startswith("_tags-"):
            if store.get_file_info(f"{found.path}/moves.json").type == arrow_fs.FileType.File:
                finish(store, found.path)
                done += 1
            else:
                store.delete_dir(found.path)
    return done


class TaggedFiles(DataSource):
    """Rows (path, tags): the files get these tags. `path`, the option, is their folder, where new files are put aside."""

    @classmethod
    def name(cls) -> str:
        return "tagged_files"

    def schema(self) -> str:
        return "path string, tags map<string,string>"

    def writer(self, schema, overwrite: bool) -> TagWriter:
        return TagWriter(self.options["path"])


def write_tags(spark: SparkSession, folder: str, tags: DataFrame) -> int:
    """Change the tags of files (path, tags), all or none; the number of files. An empty value deletes a tag, others stay; a file may be named once."""
    spark.dataSource.register(TaggedFiles)
    own = tags.select("path", "tags")
    own.write.format("tagged_files").mode("append").save(folder)
    return own.count()
