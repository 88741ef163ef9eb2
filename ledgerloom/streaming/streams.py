"""The same operators over streams: deduplicated alerts, delivery detection, stateful cases, windowed totals and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitor import CaseState


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_per_key(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once; its state is dropped when the watermark passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_totals(stream: DataFrame, time: str, delay: str, width: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums per window of event time and key; later rows than the delay are dropped by the watermark."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def delivery_alerts(stream: DataFrame, sla_minutes: int, delay: str) -> DataFrame:
    """Deliveries once per fingerprint, with whether they came later than their due time plus the SLA."""
    once = once_per_key(stream, ["source", "fingerprint"], "observed_at", delay)
    return once.withColumn("late", F.unix_timestamp("observed_at") - F.unix_timestamp("due_at") > sla_minutes * 60)


def stateful_cases(stream: DataFrame, series: list[str], bound: float, reset: float, cooldown_days: int) -> DataFrame:
    """Case transitions with state carried across batches. Points of a batch are taken in the order of date and id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        points = pd.concat(list(batches)).sort_values(["as_of_date", "point_id"])
        case = CaseState(bound, reset, cooldown_days, *(state.get if state.exists else ()))
        points["transition"] = [case.step(d, None if pd.isna(v) else v) for d, v in zip(points["as_of_date"], points["value"], strict=True)]
        state.update((case.is_open, case.triggered, case.cleared))
        yield points[[*series, "as_of_date", "point_id", "value", "transition"]]

    kinds = dict(stream.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in [*series, "as_of_date", "point_id"]) + ", value double, transition string"
    rows = stream.select(*series, "as_of_date", "point_id", F.col("value").cast("double").alias("value"))
    return rows.groupBy(*series).applyInPandasWithState(step, out, "is_open boolean, triggered date, cleared date", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key: every batch is reduced and appended under its batch id, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """What ``upsert_sink`` holds: the last row of each key over all batches."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), F.struct(order, "batch")).alias("r")).select("r.*")


def delivery_sink(stream: DataFrame, path: str, checkpoint: str, date: str = "as_of_date") -> StreamingQuery:
    """Rows of deliveries with their mode (full, backfill, delta or correction), each batch under its id, so a repeated batch
    replaces itself. ``read_deliveries`` and ``read_corrections`` give what they amount to."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("mode", date).parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_deliveries(spark: SparkSession, path: str, date: str = "as_of_date") -> DataFrame:
    """The present rows: of each date those of its last full or backfill delivery and of the deltas that came with or after it.
    Dates and batches are partitions, so replaced rows are not read."""
    rows = spark.read.parquet(path).where("mode <> 'correction'")
    whole = F.col("mode").isin("full", "backfill")
    last = rows.where(whole).groupBy(date).agg(F.max("batch").alias("__last"))
    joined = rows.join(last, date, "left")
    since = F.coalesce("__last", F.lit(-1))
    return joined.where((whole & (F.col("batch") == since)) | (~whole & (F.col("batch") >= since))).drop("__last", "batch", "mode")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Corrections stay beside what they correct, as revisions numbered by batch."""
    return spark.read.parquet(path).where("mode = 'correction'").withColumnRenamed("batch", "revision").drop("mode")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what is there to the end and read the result; for batch comparisons and backfills."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)
