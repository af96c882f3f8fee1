"""Late rows of a stream, parked instead of dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.sources import sinks


def split_late(stream: DataFrame, path: str, checkpoint: str, time: str = "ts", late: str = "1 hour") -> StreamingQuery:
    """Write each micro-batch to ``path/on_time`` or, where a row lies further back than ``late`` from the
    newest time of the batches before, to ``path/late``; a null time is late.

    That is the watermark by which windowed aggregations drop rows without a trace.  Every batch is a
    folder of its own, so a batch that is run again after a failure replaces itself.  Its newest time
    goes to ``path/marks``, one row a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks"
        newest = None
        if sinks.exists(spark, marks):
            newest = spark.read.schema("newest timestamp, batch long").parquet(marks).filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")
        is_late = F.col(time).isNull() | F.coalesce(F.col(time) < limit, F.lit(False))
        held, held_path = sinks.written(batch.withColumn("_late", is_late), "batch")
        held.filter("not _late").drop("_late").write.mode("overwrite").parquet(f"{path}/on_time/batch={number}")
        held.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        held.agg(F.max(time).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
        sinks.delete(spark, held_path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_part(spark, path: str, part: str, schema: str) -> DataFrame:
    """The rows that are ``on_time`` or ``late``, with the number of their batch."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/{part}").parquet(f"{path}/{part}")
