"""Full-text search over several columns with an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(column: str):
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}_]+", " ")), " +"), lambda w: w != "")


def index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, position, term) of all columns; incremental: index new rows and append."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), words(c).alias("terms")) for c in columns]))
    rows = df.select(F.col(key).alias("id"), parts.alias("p")).select("id", "p.field", F.posexplode_outer("p.terms").alias("position", "term"))
    return rows.filter("term is not null")


def terms_of(query: str) -> list[str]:
    return list(dict.fromkeys(w.strip('"').lower() for w in query.split() if w.strip('"')))


def match(idx: DataFrame, query: str, limit: int = 100, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows with every word of the query in any field, by BM25 score over all fields; ties by id."""
    wanted = terms_of(query)
    size = idx.groupBy("id").agg(F.count(F.lit(1)).alias("len"))
    corpus = size.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    tf = idx.filter(F.col("term").isin(wanted)).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    full = tf.groupBy("id").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") == len(wanted)).select("id")
    rare = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = rare * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = tf.join(full, "id", "left_semi").join(F.broadcast(df), "term").join(size, "id").crossJoin(F.broadcast(corpus))
    return scored.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def phrase(idx: DataFrame, text: str) -> DataFrame:
    """Rows that have the words one after the other in one field."""
    wanted = text.lower().split()
    at = F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.lit(i).alias("i")) for i, w in enumerate(wanted)]))
    asked = idx.sparkSession.range(1).select(at.alias("a")).select("a.*")
    met = idx.join(F.broadcast(asked), "term").withColumn("start", F.col("position") - F.col("i"))
    return met.groupBy("id", "field", "start").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(wanted)).select("id").distinct()
