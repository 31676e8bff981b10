"""Structured Streaming: incremental ingest and session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def new_versions(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """One row for each content of each document (doc_id, text, ts), however often it is delivered within `late`."""
    keyed = stream.withColumn("hash", F.sha2("text", 256))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "hash"])


def session_windows(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n) by gaps alone; the batch form also splits at a change of date."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """All that is there now, as appended Parquet; the checkpoint remembers what was read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed(old: DataFrame, new: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """Rows of new that old has not, or has with another value."""
    was = old.select(key, F.struct(F.col(value).alias("v")).alias("was"))
    return new.join(was, key, "left").where(F.col("was").isNull() | ~F.col("was.v").eqNullSafe(F.col(value))).drop("was")


def impact(found: DataFrame, known: DataFrame) -> DataFrame:
    """Cards (name, type, attributes, card, severity) of found entities (name, type, attributes) against known ones with one
    row for each name: unknown names, other types, other attributes; what is known as it is makes none.  Null is empty."""
    key = lambda df: F.lower(F.trim(df["name"]))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    had = known.select(key(known).alias("k"), text("type").alias("t"), text("attributes").alias("a"))
    both = found.where("name <> ''").distinct().withColumn("k", key(found)).join(had, "k", "left")
    card = F.when(F.col("t").isNull(), "new").when(F.col("t") != text("type"), "conflict").when(F.col("a") != text("attributes"), "updated")
    both = both.withColumn("card", card).where("card is not null")
    return both.select("name", "type", "attributes", "card", F.when(F.col("card") == "conflict", "S2").otherwise("S3").alias("severity"))


def merge_stream(stream: DataFrame, folder: str, checkpoint: str):
    """Keep the newest text of each doc_id of a stream (doc_id, text, ts): every micro-batch writes the next version of the
    table and what it changed.  A batch that is run again reads the version before it and writes the same folders anew;
    of rows with one doc_id in a batch the one of greatest ts, then text, counts, and none older than the table's."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("doc_id").agg(F.max(F.struct("ts", "text")).alias("m")).select("doc_id", "m.text", "m.ts")
        old = spark.read.schema(new.schema).parquet(f"{folder}/table/{n - 1}") if n else new.limit(0)
        late = new.join(old.select("doc_id", F.col("ts").alias("had")), "doc_id").where("had > ts")
        new = new.join(late.select("doc_id"), "doc_id", "left_anti")
        fresh = f"{folder}/changes/{n}"
        changed(old, new).write.mode("overwrite").parquet(fresh)
        new = spark.read.schema(new.schema).parquet(fresh)
        old.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{folder}/table/{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
