"""Streams: divergence of running trainings, identity counts, and intake of new media."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cliploom.functions.shared import shared_folder
from cliploom.operators.metrics import EVENTS, WATCH, Watch, warmup_end


def work_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


#: Where streams keep their state: on the executors' disks, with changes in the checkpoint.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Write all that a stream has now to parquet under path, with its checkpoint beside it; called again, it goes on from there."""
    conf = stream.sparkSession.conf
    before = conf.get(ROCKSDB[0], None)
    conf.set(*ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    finally:
        conf.unset(ROCKSDB[0]) if before is None else conf.set(ROCKSDB[0], before)
    query.awaitTermination()


class DivergenceWatch(StatefulProcessor):
    """Feeds each run's steps to its Watch, whose few numbers are the run's state."""

    def __init__(self, threshold: float, detect: int, stop: int, alpha: float) -> None:
        self.limits = (threshold, detect, stop)
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("watch", WATCH)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        new = pd.concat(list(rows)).dropna(subset=["loss"]).sort_values(["step", "loss"])
        watch = Watch(*self.state.get()) if self.state.exists() else Watch()
        if len(new) and new["step"].iloc[0] <= watch.last_step:
            watch = Watch()
        got = []
        if len(new):
            got = watch.feed(new["step"].tolist(), new["loss"].tolist(), self.alpha, int(new["from_step"].iloc[0]), *self.limits)
            self.state.update(watch.as_tuple())
        yield pd.DataFrame([(key[0], *e) for e in got], columns=["run_id", "step", "event", "percent_over"])

    def close(self) -> None:
        pass


def stream_divergence(stream: DataFrame, plan: DataFrame | None = None, threshold: float = 15, detect: int = 150, stop: int = 300, alpha: float = 0.02, warmup: int | None = None, least_warmup: int = 50) -> DataFrame:
    """Divergence events of a stream of (run_id, step, loss), equal to those of divergence_events.

    plan: (run_id, total_steps), the steps that each run will take, from which its warm-up follows as in
    batch; a run without a plan is watched after least_warmup steps, and a fixed `warmup` goes before all plans. A run's
    state is a few numbers in RocksDB. Rows of a micro-batch are taken in order of steps; a first step
    that isn't after the last one seen is a new run of that name, and clears the state. Start it by run_once().
    """
    rows = stream.select(F.col("run_id").cast("long").alias("run_id"), F.col("step").cast("int").alias("step"), F.col("loss").cast("double").alias("loss"))
    if warmup is not None:
        rows = rows.withColumn("from_step", F.lit(warmup))
    elif plan is None:
        rows = rows.withColumn("from_step", F.lit(least_warmup))
    else:
        ends = plan.groupBy(F.col("run_id").cast("long").alias("_run")).agg(warmup_end(F.max("total_steps"), least=least_warmup).alias("from_step"))
        rows = rows.join(ends, F.col("run_id") == F.col("_run"), "left").drop("_run").withColumn("from_step", F.coalesce("from_step", F.lit(least_warmup)))
    watch = DivergenceWatch(threshold, detect, stop, alpha)
    return rows.groupBy("run_id").transformWithStateInPandas(watch, EVENTS, "Append", "None")


def stream_identity_status(stream: DataFrame, sink: str) -> StreamingQuery:
    """Keep a table of appearances of each identity and, in the row without one, of all, as entries (identity) arrive.

    Every micro-batch writes a version of its own under sink; current_status() reads the newest whole one.
    """
    counts = stream.groupBy("identity").agg(F.count("*").alias("appearances"))

    def write(batch: DataFrame, batch_id: int) -> None:
        all_of_them = batch.agg(F.lit(None).cast("string").alias("identity"), F.coalesce(F.sum("appearances"), F.lit(0)).alias("appearances"))
        batch.unionByName(all_of_them).coalesce(1).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{sink.rstrip('/')}-state").trigger(availableNow=True).start()


def current_status(spark: SparkSession, sink: str) -> DataFrame:
    """(identity, appearances) of the newest micro-batch."""
    rows = spark.read.parquet(sink)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")


def status_totals(status: DataFrame, clips: DataFrame, pool: DataFrame, total_slots: int, max_samples: int) -> DataFrame:
    """One row beside the counts: appearances and their cap, clips, and slots of the pool that are still open."""
    seen = status.where(F.col("identity").isNull()).agg(F.coalesce(F.max("appearances"), F.lit(0)).alias("appearances"), F.lit(1).alias("_k"))
    one = lambda df, name: df.agg(F.count("*").alias(name), F.lit(1).alias("_k"))
    rows = seen.join(one(clips, "clips"), "_k").join(one(pool, "pool_remaining"), "_k").drop("_k")
    return rows.withColumns({"cap": F.lit(max_samples).cast("long"), "pool_total": F.lit(total_slots).cast("long")})


def stream_ingest(stream: DataFrame, blocked: DataFrame, sink: str, key: str = "stem", rows: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Append what arrives to sink, each key once, without what is blocked; `rows` turns files into rows.

    Keys that came before are the state of the stream, dealt over its partitions, and the sink is never read.
    """
    new = rows(stream).dropDuplicates([key]).join(blocked.select(key).distinct(), key, "left_anti")
    state = f"{sink.rstrip('/')}-state"
    return new.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(sink)
