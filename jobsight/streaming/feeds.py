"""Streams over files, and running a stream until its input is used up."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsight.session import shared_dir

DELAY_SECONDS = 600
WATERMARK = f"{DELAY_SECONDS} seconds"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream; each file is read once."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


#: Rows that one task of a batch should put into its part of the state.
STATE_ROWS = 250_000


@contextmanager
def _stateful(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """RocksDB state for a stream that starts inside: as many state partitions as the cluster has cores, or more where
    ``rows`` are expected in one batch, since a task holds what its partition gets.

    A stream works on a copy of the session's settings taken when it starts, so these are put back right after.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.shuffle.partitions": str(max(spark.sparkContext.defaultParallelism, -(-rows // STATE_ROWS))),
        "spark.sql.streaming.numRecentProgressUpdates": "10000",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run(
    stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", rows: int = 0
) -> int:
    """Hand every micro-batch to ``on_batch`` until the input is used up. A restart goes on from the checkpoint.

    ``rows`` expected in one batch decide the state partitions of a new checkpoint. Returns the number of rows that came after the watermark had passed them and were dropped.
    """
    spark = stream.sparkSession
    with _stateful(spark, rows):
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .foreachBatch(on_batch)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def parquet_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """Write every batch to its own folder, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch, several subscribers; it is computed once for all of them."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return deliver


def read_batches(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    written = T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])
    return spark.read.schema(written).parquet(folder).drop("batch")


def _last_versions(out: DataFrame, key: Sequence[str] | None) -> DataFrame:
    """All rows, or with a key the last version of every key, as in update mode."""
    if key is None:
        return out.drop("_batch")
    columns = [c for c in out.columns if c not in (*key, "_batch")]
    last = out.groupBy(*key).agg(F.max_by(F.struct(*columns), "_batch").alias("_row"))
    return last.select(*key, "_row.*")


def _last_groups(out: DataFrame, key: Sequence[str]) -> DataFrame:
    """Where every batch writes the whole group of rows of a key: the rows of its last batch."""
    last = out.groupBy(*key).agg(F.max("_batch").alias("_batch"))
    return out.join(last, [*key, "_batch"]).drop("_batch")


def drain(
    stream: DataFrame, purpose: str, mode: str = "append", key: Sequence[str] | None = None, rows: int = 0
) -> DataFrame:
    """Run a stream until its input is used up and return what it wrote; with a key, the last version of every key."""
    spark = stream.sparkSession
    folder = shared_dir(spark, f"stream-{purpose}")
    run(stream, parquet_batches(f"{folder}/out"), f"{folder}/checkpoint", mode, rows)
    return _last_versions(read_batches(spark, stream.schema, f"{folder}/out"), key)


class Replay:
    """A finished table as a stream: its rows land slice by slice of their time, and the stream goes on after each.

    Rows come out of order: each is held back by a part of the watermark's delay that its content decides, so some come
    with the next slice. Every slice is a run from the checkpoint of the one before, and the end of the input, a time
    beyond all rows, moves the watermark past the last of them, so that no row is left waiting.
    """

    def __init__(self, table: DataFrame, time: str, purpose: str, slices: int = 3):
        self.spark, self.table, self.time, self.slices = table.sparkSession, table, time, slices
        self.folder = shared_dir(self.spark, f"replay-{purpose}")
        self.landed, self.ended = f"{self.folder}/landed", f"{self.folder}/ended"
        self.table.limit(0).write.parquet(self.landed)
        self.spark.createDataFrame([], "ts timestamp").write.parquet(self.ended)

    def watermarked(self, rows: DataFrame) -> DataFrame:
        """Rows with their time in ``ts``, the end of the input after them, and the watermark.

        The end comes as a row of nulls with a time, which every processor passes over. Spark starts its watermark at
        the year 1970, so rows of that moment or before are late.
        """
        end = stream_files(self.spark, self.ended, T.StructType([T.StructField("ts", T.TimestampType())]))
        return rows.unionByName(end, allowMissingColumns=True).withWatermark("ts", WATERMARK)

    def _arrivals(self) -> Iterator[DataFrame]:
        held_us = DELAY_SECONDS * 900_000
        us = F.unix_micros(F.col(self.time).cast("timestamp"))
        late = self.table.withColumn("_at", us + F.pmod(F.xxhash64(*self.table.columns), F.lit(held_us)))
        low, high = late.agg(F.min("_at"), F.max("_at")).first()
        if low is None:
            yield self.table
            return
        width = (high - low) // self.slices + 1
        slot = F.coalesce(F.floor((F.col("_at") - low) / width), F.lit(0))
        for k in range(self.slices):
            yield late.filter(slot == k).drop("_at")

    def drain(self, stream: DataFrame, mode: str = "append", group: Sequence[str] | None = None) -> DataFrame:
        """What the stream wrote after all slices and the end; with a group, the rows of its last batch."""
        sink = parquet_batches(f"{self.folder}/out")
        for rows in self._arrivals():
            rows.write.mode("append").parquet(self.landed)
            run(stream, sink, f"{self.folder}/checkpoint", mode)
        last = self.table.select(F.max(F.col(self.time).cast("timestamp")).alias("ts")).filter("ts IS NOT NULL")
        beyond = F.timestamp_seconds(F.floor(F.unix_seconds("ts")) + DELAY_SECONDS + 2)
        last.select(beyond.alias("ts")).write.mode("append").parquet(self.ended)
        run(stream, sink, f"{self.folder}/checkpoint", mode)
        out = read_batches(self.spark, stream.schema, f"{self.folder}/out")
        return out.drop("_batch") if group is None else _last_groups(out, group)
