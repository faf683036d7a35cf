"""Event-time windows: the same definitions over tables and over streams.

The reference surveyed for this engine has no streams; these are the
operators that Structured Streaming gives the ``events`` table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as an instant: streams need a zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(df: DataFrame, size: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums per window and key; rows later than the watermark are dropped in a stream."""
    return timed(df).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sliding(df: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    return timed(df).withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    return timed(df).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def deduplicated(df: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return timed(df).withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else timed(df).dropDuplicates([key])


def running_totals(stream: DataFrame, by: str = "user_id") -> DataFrame:
    """A running count and sum per key, kept as state between batches."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

    return stream.select(by, "value").groupBy(by).applyInPandasWithState(step, f"{by} bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drained(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, and gives the rows it wrote.

    Progress and rows are kept below the folder, which executors share; a
    batch that runs again writes the same place again, so no row comes twice.
    """
    kind = df.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{batch}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(kind).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
