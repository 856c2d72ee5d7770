"""Optional: new documents as a stream, chunked as they come, and windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.chunking import line_blocks, pack_blocks


def chunk_stream(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, most: int = 3000) -> StreamingQuery:
    """Chunks every new Parquet file of (doc_id, text) once; stops when all that is there is done."""
    docs = spark.readStream.schema(schema).parquet(folder)

    def batch(df: DataFrame, batch_id: int) -> None:
        pack_blocks(line_blocks(df), most).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean values by type in tumbling windows; works on streams and tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
