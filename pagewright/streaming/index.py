"""The index kept up to date from a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import chunking, index as I
from pagewright.sources import store
from pagewright.sources.lists import ENTRY


def entry_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Entries of JSON files as they arrive, with when their file did (arrived)."""
    read = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return read.select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def keep_index(entries: DataFrame, path: str, checkpoint: str, embedder: I.Embedder, model: str, available_now: bool = True, keep: int = 3) -> StreamingQuery:
    """Chunk, embed and upsert each batch of entries into the index at ``path``.

    Of several versions of an entry in a batch the one that arrived last holds. Only
    chunks whose wording the index lacks are embedded; chunks that an entry no longer
    has are deleted. A batch writes the version of its own number, from the one before, so
    a batch that is run again publishes the same; older versions than ``keep`` are removed.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if "arrived" not in rows.columns:
            rows = rows.withColumn("arrived", F.lit(0))
        rows = rows.withColumn("row", F.monotonically_increasing_id())  # a later line of a file is a later version
        said = F.struct(*[c for c in rows.columns if c not in ("id", "arrived", "row")])
        latest = rows.groupBy("id").agg(F.max_by(said, F.struct("arrived", "row")).alias("r")).select("id", "r.*")
        chunks = chunking.chunk_entries(latest).withColumn("hash", I.T.content_hash(F.col("text"), model))
        held = store.latest_before(spark, path, number + 1)
        if held is None:
            store.publish(I.embed(chunks, embedder), path, number + 1)
            return
        fresh = I.embed(I.pending(chunks.drop("hash"), held, model), embedder)
        gone = I.stale(chunks, held.join(latest.select(F.col("id").alias("entry_id")), "entry_id", "left_semi"))
        store.publish(I.upsert(held, fresh, gone), path, number + 1)
        store.expire(spark, path, keep)

    writer = entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(day, event_type, n) of a stream of events (ts, event_type), late ones up to ``lateness`` counted."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().select(
        F.to_date("w.start").alias("day"), "event_type", F.col("count").alias("n")
    )
