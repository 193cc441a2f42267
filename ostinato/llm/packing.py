"""Packing token sequences by bounded-space online best fit."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts by a tokenizer's file, as `tokenizers` gives them without special tokens put in.

    A file of ranks with the same vocabulary, if there is one, encodes four
    times as fast and alike (a test runs over all code points), but knows no
    added tokens: texts that hold the string of one go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str):
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.path, self.whole, self.fast = path, None, None
        if ranks:
            with open(ranks, "rb") as lines:
                found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=found, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and not any(t in text for t in self.added):
            return self.fast.encode_ordinary(text)
        self.whole = self.whole or Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens: all full but the first."""
    return [0, *range(n % capacity or capacity, n, capacity)]


class Packer:
    """Best fit into at most `open_bins` open bins, found in a bitset keyed by free space.

    An item goes where it leaves the least free space; without such a bin, a
    new one opens, and if too many are open, the fullest closes. O(1) an item
    for a fixed capacity.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.bins, self.open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """bin and offset of an item of that length."""
        fits = self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            found = self._take(free)
        else:
            free, found = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(found)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return found, self.capacity - free

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return found


def pieces(docs: DataFrame, capacity: int, tokenizer: str, ranks: str | None, pattern: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer, ranks, pattern)
        for b in batches:
            for part, texts in common.by_bytes(b, 1):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    ids = np.array([*enc.ids(text or ""), end_id], np.uint32)
                    starts = cut_points(len(ids), capacity)
                    for k, (i, j) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                        rows.append((doc, k, i, j - i, zlib.crc32(ids[i:j].astype("<u4").tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.lean(run), PIECES)


def pack(docs: DataFrame, capacity: int = 2048, open_bins: int = 512, ahead: int = 1024, pieces_a_task: int = 2**15, tokenizer: str | None = None, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it stands in which sequence of at most `capacity` tokens.

    A document is the ids of its text, null as the empty one, then end_id; only
    longer ones are cut, into full pieces but for the first. Each task packs a
    stream of about pieces_a_task pieces in a seeded order, as they come: of
    `ahead` pieces that came the longest are placed first, and open_bins bins
    are open at most, so a task's memory is the same whatever the input. Rows
    that repeat are packed once each; a null id is kept, rows of one id are
    documents of their own. Other columns are ignored; an empty table gives no
    piece. tokenizer, ranks: files of one vocabulary, found on every executor;
    without a tokenizer given, those of 50k byte-level tokens.
    """
    if not tokenizer:
        tokenizer, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = common.cut(pieces(docs, capacity, tokenizer, ranks, pattern, end_id, id_col, text_col))
    tasks = max(1, -(-made.count() // pieces_a_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(capacity, open_bins), TaskContext.get().partitionId() << 32
        for b in batches:
            for i in range(0, b.num_rows, ahead):
                part = b.slice(i, ahead)
                part = part.take(pa.array(np.argsort(-part.column("length").to_numpy(), kind="stable")))
                at = [packer.put(n) for n in part.column("length").to_pylist()]
                found = [pa.array([first + x for x, _ in at], pa.int64()), pa.array([x for _, x in at], pa.int64())]
                yield pa.record_batch([*part.columns, *found], [*part.schema.names, "sequence_id", "offset"])

    order = [F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32"]
    dealt = made.repartition(tasks, "doc_id", "piece", "ids_crc32").sortWithinPartitions(*order)
    return dealt.mapInArrow(common.lean(run), PIECES + ", sequence_id long, offset long").withColumnRenamed("doc_id", id_col)
