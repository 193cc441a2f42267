"""A stored inverted index: written once, appended to in segments, read by the buckets of the asked words only.

Postings lie in folders by a hash of the word. Within a word they come in blocks
of consecutive ids, the same ranges for all words: a row of the table is a block,
with the word's rows in it and, beside them, how many they are, the greatest
count of the word and the least length of a row. A search first reads these
few numbers: blocks that lack one of the words are out, and so are, once enough
rows are known, those whose best possible score can't reach the rows found.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import snapshots
from . import search

_POSTINGS = "term string, block long, n long, max_tf long, min_len long, entries array<struct<id:long,tf:long,len:long>>, places array<struct<id:long,field:string,position:int>>, bucket int"


class TextIndex:
    """Rows of words under whole-numbered ids. Readers see whole segments only: a segment counts from the commit of the list that names it."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, span: int = 4096, k1: float = 1.2, b: float = 0.75):
        self.spark, self.folder, self.buckets, self.span, self.k1, self.b = spark, folder, buckets, span, k1, b
        self.store = snapshots.Store(spark, folder)
        self._segments: list | None = None
        self._postings: DataFrame | None = None

    def segments(self) -> list:
        """(name, kind, docs, words) of each: kind is `rows`, or `gone` for ids that were taken out."""
        if self._segments is None:
            self._segments = self.store.read("segments").orderBy("name").collect() if self.store.has("segments") else []
        return self._segments

    def _commit(self, segments: list) -> None:
        self.store.write("segments", self.spark.createDataFrame([tuple(s) for s in segments], "name string, kind string, docs long, words long").coalesce(1))
        self._segments = self._postings = None

    def _write(self, rows: DataFrame) -> tuple:
        """A segment of (id, field, position, term)."""
        name = f"segment-{uuid.uuid4().hex}"
        # a row's length is told beside its words: a join with all lengths would be broadcast through the driver
        sized = rows.withColumn("len", F.count(F.lit(1)).over(Window.partitionBy("id")))
        block = F.floor(F.col("id") / self.span).cast("long")
        tf = sized.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.collect_list(F.struct("field", "position")).alias("at"), F.first("len").alias("len")).withColumn("block", block)
        # a block holds at most `span` rows of a word, however common that is
        made = tf.groupBy("term", "block").agg(
            F.count(F.lit(1)).alias("n"),
            F.max("tf").alias("max_tf"),
            F.min("len").alias("min_len"),
            F.array_sort(F.collect_list(F.struct("id", "tf", "len"))).alias("entries"),
            F.array_sort(F.flatten(F.collect_list(F.transform("at", lambda a: F.struct(F.col("id").alias("id"), a["field"].alias("field"), a["position"].alias("position")))))).alias("places"),
        )
        made = made.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % self.buckets).cast("int"))
        made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        held = self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/{name}").select(F.explode("entries").alias("e")).select("e.id", "e.len").distinct()
        docs, words = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        return name, "rows", docs, words

    def append(self, rows: DataFrame, key: str, columns: list[str]) -> None:
        """Index the words of columns of new rows. Ids that the index has already must be taken out first."""
        segment = self._write(search.index(rows.withColumn(key, F.col(key).cast("long")), key, columns))
        if segment[2]:
            self._commit([*self.segments(), segment])

    def remove(self, ids: DataFrame, key: str = "id") -> None:
        """Take rows out: they are found no more; merging drops them."""
        held = self.postings().select(F.explode("entries").alias("e")).select("e.id", "e.len").distinct()
        out = held.join(ids.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
        name = f"gone-{uuid.uuid4().hex}"
        out.write.parquet(f"{self.folder}/{name}")
        docs, words = self.spark.read.schema("id long, len long").parquet(f"{self.folder}/{name}").agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        if docs:
            self._commit([*self.segments(), (name, "gone", docs, words)])

    def merge(self) -> None:
        """One segment of all, with full blocks and without rows that were taken out."""
        if len(self.segments()) > 1:
            rows = self.postings().select("term", F.explode("places").alias("p")).select("p.id", "p.field", "p.position", "term")
            gone = self._gone()
            segment = self._write(rows if gone is None else rows.join(gone, "id", "left_anti"))
            self._commit([segment] if segment[2] else [])

    def clear(self) -> None:
        self._commit([])

    def _gone(self) -> DataFrame | None:
        names = [s["name"] for s in self.segments() if s["kind"] == "gone"]
        return self.spark.read.schema("id long, len long").parquet(*[f"{self.folder}/{n}" for n in names]).select("id") if names else None

    def postings(self) -> DataFrame:
        if self._postings is None:
            names = [s["name"] for s in self.segments() if s["kind"] == "rows"]
            parts = [self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/{n}") for n in names]
            self._postings = parts[0] if parts else self.spark.createDataFrame([], _POSTINGS)
            for p in parts[1:]:
                self._postings = self._postings.unionAll(p)
        return self._postings

    def of_words(self, words: list[str]) -> DataFrame:
        """The postings of some words: only their buckets' files are read."""
        buckets = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return self.postings().filter(F.col("bucket").isin(buckets) & F.col("term").isin(words))

    def search(self, query: str, limit: int = 100, ahead: int = 8) -> DataFrame:
        """(id, score): rows with every word of the query in any field, by BM25 over all fields; ties by id.

        The `ahead` blocks of greatest possible score are scored first; of the
        others only those that could reach the last of `limit` rows found there.
        """
        words = search.terms_of(query)
        found = self.of_words(words)
        docs = sum(s["docs"] if s["kind"] == "rows" else -s["docs"] for s in self.segments())
        mean = sum(s["words"] if s["kind"] == "rows" else -s["words"] for s in self.segments()) / max(docs, 1)
        gone = self._gone()
        live = found.select("term", "block", F.explode("entries").alias("e")).select("term", "block", "e.*")
        if gone is not None:
            live = live.join(gone, "id", "left_anti")
            often = dict(live.groupBy("term").agg(F.count(F.lit(1))).collect())
        else:
            often = dict(found.groupBy("term").agg(F.sum("n")).collect())
        if not words or len(often) < len(words):
            return self.spark.createDataFrame([], "id long, score double")
        rare = F.create_map(*[x for w, n in often.items() for x in (F.lit(w), F.log(F.lit(1 + (docs - n + 0.5) / (n + 0.5))))])[F.col("term")]

        def part(tf: Column, length: Column) -> Column:
            return rare * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / mean))

        heads = found.groupBy("block", "term").agg(F.max("max_tf").alias("tf"), F.min("min_len").alias("len")).groupBy("block").agg(F.count(F.lit(1)).alias("words"), F.sum(part(F.col("tf"), F.col("len"))).alias("bound"))
        heads = heads.filter(F.col("words") == len(words)).select("block", "bound")

        def scored(blocks: DataFrame) -> DataFrame:
            rows = live.join(blocks, "block", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("words"), F.sum(part(F.col("tf"), F.col("len"))).alias("score"))
            return rows.filter(F.col("words") == len(words)).select("id", "score")

        first = [(r["block"], r["bound"]) for r in heads.orderBy(F.desc("bound"), "block").limit(ahead + 1).collect()]
        ordered = lambda df: df.orderBy(F.desc("score"), "id").limit(limit)
        near = ordered(scored(self._blocks([x for x, _ in first[:ahead]])))
        if len(first) <= ahead:
            return near
        held = [tuple(r) for r in near.collect()]
        reach = held[-1][1] if len(held) == limit else 0.0
        # the small subtrahend is for sums that are rounded in another order
        rest = heads.filter(F.col("bound") >= reach - 1e-9).join(self._blocks([x for x, _ in first[:ahead]]), "block", "left_anti")
        return ordered(scored(rest).unionAll(self.spark.createDataFrame(held, "id long, score double")))

    def _blocks(self, blocks: list[int]) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(b,) for b in blocks], "block long"))

    def phrase(self, text: str) -> DataFrame:
        """Ids of rows that have the words one after the other in one field."""
        words = text.lower().split()
        asked = self.spark.createDataFrame(list(enumerate(words)), "i int, term string")
        met = self.of_words(list(dict.fromkeys(words))).select("term", F.explode("places").alias("p")).join(F.broadcast(asked), "term")
        hits = met.groupBy("p.id", "p.field", (F.col("p.position") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(words)).select("id").distinct()
        gone = self._gone()
        return hits if gone is None else hits.join(gone, "id", "left_anti")
