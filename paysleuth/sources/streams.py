"""Streaming sources and sinks. Files are the tested path; Kafka is the same functions with another format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysleuth.schemas import ENRICHED_TRANSACTION, RAW_TRANSACTION
from paysleuth.session import scratch_path
from paysleuth.sources.tables import decode


def stream_source(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "text",
    schema: T.StructType = RAW_TRANSACTION,
    **options: str,
) -> DataFrame:
    """Decoded events of a stream with the flag ``_bad``; offsets live in the query's checkpoint.

    fmt: "text" (one JSON message per line) or "kafka" (options: kafka.bootstrap.servers, subscribe;
    read from the earliest offset). ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger`` bound a batch.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "earliest", "failOnDataLoss": "true", **options}
    reader = reader.options(**options)
    if fmt == "text":
        reader = reader.schema("value string")
    raw = reader.load(path) if path else reader.load()
    parsed = decode(raw.select(F.col("value").cast("string").alias("value")), "value", schema)
    fields = [F.col(f"_tx.{f}").alias(f) for f in schema.fieldNames()]
    return parsed.select("value", "_bad", *fields)


def stream_source_features(spark: SparkSession, path: str | None = None, fmt: str = "text", **options: str):
    return stream_source(spark, path, fmt, ENRICHED_TRANSACTION, **options)


def good_rows(decoded: DataFrame) -> DataFrame:
    return decoded.filter(~F.col("_bad")).drop("value", "_bad")


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    """One of the given Parquet tables as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_table(stream: DataFrame, checkpoint: str | None = None, path: str | None = None, mode: str = "append"):
    """Run a stream over all available input into a Parquet table and return the table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "sink")
    checkpoint = checkpoint or scratch_path(spark, "offsets")
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, write, checkpoint: str | None = None) -> None:
    """Run a stream over all available input through ``write(batch, batch_id)``."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "offsets")
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_dir(path: str, batch_id: int) -> str:
    """The folder of one micro-batch; writing it with overwrite makes a replayed batch harmless."""
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def split_sinks(good_path: str, dead_path: str):
    """foreachBatch writer for decoded streams: good rows and dead letters to two tables."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good_rows(batch).write.mode("overwrite").parquet(batch_dir(good_path, batch_id))
            batch.filter("_bad").select("value").write.mode("overwrite").parquet(batch_dir(dead_path, batch_id))
        finally:
            batch.unpersist()

    return write
