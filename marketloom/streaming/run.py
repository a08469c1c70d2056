"""Sources, sinks and drivers of streaming queries.

Results land in Parquet under the shared folder, one sub-folder per micro-batch, written
with overwrite: a batch that is replayed after a failure replaces its own output. Nothing
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.settings import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of Parquet files of a folder; the time column becomes TIMESTAMP."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, purpose: str) -> None:
    """Process everything that is available and stop; progress lives in the shared folder."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", shared_dir(spark, f"{purpose}-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batch_folder(root: str, name: str) -> Callable[[DataFrame, int], None]:
    """Sink that stores each micro-batch in its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")

    return write


def collect_batches(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    full = StructType(list(schema.fields)).add("batch", "long")
    return spark.read.schema(full).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch=*")


def previous_batch(spark: SparkSession, root: str, name: str, schema: StructType, batch: int) -> DataFrame | None:
    """What the batch before stored, or None for the first; batch numbers have no gaps."""
    return spark.read.schema(schema).parquet(f"{root}/{name}/batch={batch - 1}") if batch > 0 else None


def to_table(stream: DataFrame, mode: str, purpose: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run to the end and return the table: all rows, or the newest row per key."""
    spark = stream.sparkSession
    root = shared_dir(spark, purpose)
    run_available(stream, batch_folder(root, "rows"), mode, purpose)
    rows = collect_batches(spark, root, "rows", stream.schema)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def replay(df: DataFrame, day: str, delay_seconds: int, files_per_trigger: int | None = None) -> DataFrame:
    """History as a stream: day files, received a declared delay after availability.

    Pacing is the trigger's business and never changes event order or clocks.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "replay")
    d = df.withColumn("received_at", F.col("available_at") + F.make_dt_interval(secs=F.lit(delay_seconds)))
    d.repartition(day).sortWithinPartitions(day, "available_at").write.partitionBy(day).parquet(path)
    schema = StructType([f for f in d.schema.fields if f.name != day]).add(d.schema[day])
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
