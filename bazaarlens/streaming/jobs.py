"""Recurring jobs as streams: seen-state, decisions, price history, listing snapshots.

Progress and state live in the checkpoint folder; batch outputs are folders named by batch id, so
a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from bazaarlens.operators import deals, upsert
from bazaarlens.sources.rules import RuleConfig
from bazaarlens.streaming import snapshots


@dataclass(frozen=True)
class WritePolicy:
    """Which sinks a run may write: a full dry run writes none, a quiet one sends no alerts."""

    state: bool = True
    decisions: bool = True
    alerts: bool = True

    @staticmethod
    def of(full_dry_run: bool = False, quiet: bool = False) -> WritePolicy:
        return WritePolicy(not full_dry_run, not full_dry_run, not (full_dry_run or quiet))


def read_new_files(
    spark: SparkSession, folder: str, schema, name_filter: str = "*.parquet", max_files: int | None = None
) -> DataFrame:
    """New Parquet files of a folder; ``max_files`` bounds one cycle."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_filter)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def unseen(stream: DataFrame, keys: list[str], event_time: str, horizon: str = "30 days") -> DataFrame:
    """First sighting of each key within the horizon; older keys leave the state."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    """Run every ``every``, or once over all that is there."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_files(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return start(stream.writeStream.format("parquet").outputMode("append").option("path", folder), checkpoint, every)


def first_sightings(offers: DataFrame, keys: list[str] = ["listing_id"], horizon: str = "30 days") -> DataFrame:
    """Offers not seen before within the horizon, by the time they arrive.

    Arrival times only grow, so no offer is too late for the state; the state holds one entry for each
    key of the horizon. Null keys count as one key.
    """
    return unseen(offers.withColumn("_arrived", F.current_timestamp()), keys, "_arrived", horizon).drop("_arrived")


#: Where a queue stands after a turn of a cycle: all offers up to (to_cycle, to_ticket) are decided.
HEAD = T.StructType([T.StructField(c, T.LongType()) for c in ("to_cycle", "to_ticket", "batch", "turn")])
#: Tickets of a cycle: the sorted partition in the upper bits, the row in the lower 33.
TICKET_BITS = 33


def decide_stream(
    offers: DataFrame,
    config: RuleConfig,
    folder: str,
    checkpoint: str,
    policy: WritePolicy = WritePolicy(),
    every: str | None = None,
) -> StreamingQuery:
    """Decisions and alerts of each cycle; offers are already free of seen ones (`first_sightings`).

    A cycle decides max_total_items offers at most, oldest cycle first, then by listing_id. The others
    wait in a queue on files: each cycle's offers are appended once (`arrived`, with tickets in
    order), and `heads` says up to which ticket offers are decided, so a cycle writes as much as it
    received, however many wait. `drain` decides what waits after the last cycle. A cycle that is
    run again finds its own head and gives the same decisions; a restart goes on from the last one.

    A full dry run decides each cycle's offers for the rules' sake, but writes nothing in `folder`: no
    queue, no decisions. Give it a checkpoint of its own, as Spark notes there what it has read.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not policy.state:
            return _write(batch, config, folder, (batch_id, 0), policy)
        before, own = _head(spark, folder, (batch_id, 0)), _head(spark, folder, (batch_id, 1))
        if config.max_total_items <= 0 and before is None:
            return _write(batch, config, folder, (batch_id, 0), policy)
        if own == before:
            _append(batch, folder, batch_id)
        _turn(spark, config, folder, (batch_id, 0), policy)

    return start(offers.writeStream.foreachBatch(cycle), checkpoint, every)


def drain(
    spark: SparkSession, config: RuleConfig, folder: str, policy: WritePolicy = WritePolicy(), turns: int | None = None
) -> int:
    """Turns without new offers until none waits (or `turns` of them); the number of turns taken.

    For use while the stream is stopped. They count as further turns of its last cycle.
    """
    taken = 0
    while turns is None or taken < turns:
        last = _last_head(spark, folder)
        if last is None or waiting(spark, folder, last["batch"]).isEmpty():
            break
        _turn(spark, config, folder, (last["batch"], last["turn"] + 1), policy)
        taken += 1
    return taken


def waiting(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """Offers over the cap after a cycle and its further turns, still to be decided."""
    head = _head(spark, folder, (batch_id + 1, 0))
    return _queued(spark, folder, head, (batch_id, (1 << 63) - 1)).drop("_cycle", "_ticket")


def _read(spark: SparkSession, schema, path: str) -> DataFrame:
    """The files of a folder, none if it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _last_head(spark: SparkSession, folder: str, before: tuple[int, int] | None = None):
    rows = _read(spark, HEAD, f"{folder}/heads")
    if before is not None:
        rows = rows.where(_later(F.lit(before[0]), F.lit(before[1]), (F.col("batch"), F.col("turn"))))
    return rows.orderBy(F.desc("batch"), F.desc("turn")).first()


def _head(spark: SparkSession, folder: str, at: tuple[int, int]) -> tuple[int, int] | None:
    """Up to where offers were decided before a turn."""
    row = _last_head(spark, folder, at)
    return None if row is None else (row["to_cycle"], row["to_ticket"])


def _append(batch: DataFrame, folder: str, batch_id: int) -> None:
    """Add a cycle's offers to the queue. The batch is held while it is sorted: sorting reads it twice."""
    rows = batch.persist()
    try:
        queued = rows.orderBy("listing_id").withColumn("_ticket", F.monotonically_increasing_id())
        queued.write.mode("overwrite").parquet(f"{folder}/arrived/_cycle={batch_id}")
    finally:
        rows.unpersist()


def _queued(spark: SparkSession, folder: str, after: tuple[int, int] | None, upto: tuple[int, int]) -> DataFrame:
    """Offers of the queue beyond one place and up to another; other cycles are not read."""
    cycle, ticket = F.col("_cycle"), F.col("_ticket")
    rows = spark.read.parquet(f"{folder}/arrived").where((cycle <= upto[0]) & ~_later(cycle, ticket, upto))
    return rows if after is None else rows.where((cycle >= after[0]) & _later(cycle, ticket, after))


def _later(cycle: Column, ticket: Column, than: tuple) -> Column:
    """Whether one place is beyond another; in parts that reach the scan, which structs do not."""
    return (cycle > than[0]) | ((cycle == than[0]) & (ticket > than[1]))


def _turn(spark: SparkSession, config: RuleConfig, folder: str, at: tuple[int, int], policy: WritePolicy) -> None:
    """Decide the oldest offers of the queue. The head is fixed first, so a repeated turn decides the same."""
    batch_id, turn = at
    before, after = _head(spark, folder, at), _head(spark, folder, (batch_id, turn + 1))
    if after == before:
        after = _advanced(spark, folder, before, batch_id, config.max_total_items)
        path = f"{folder}/heads/batch={batch_id}/turn={turn}"
        spark.createDataFrame([after], "to_cycle long, to_ticket long").coalesce(1).write.mode("overwrite").parquet(path)
    chosen = _queued(spark, folder, before, after).drop("_cycle", "_ticket")
    _write(chosen, config, folder, at, policy)


def _advanced(
    spark: SparkSession, folder: str, before: tuple[int, int] | None, batch_id: int, most: int
) -> tuple[int, int]:
    """The place of the queue that `most` more offers reach (0: its end).

    Tickets run from 0 in each sorted partition, so the sizes of the waiting partitions tell the place:
    one row for each file that waits comes to the driver, no offer does.
    """
    end = (batch_id, (1 << 63) - 1)
    if most <= 0:
        return end
    part = F.shiftright("_ticket", TICKET_BITS)
    sizes = _queued(spark, folder, before, end).groupBy("_cycle", part.alias("part")).agg(
        F.min("_ticket").alias("first"), F.count(F.lit(1)).alias("n")
    )
    for row in sizes.orderBy("_cycle", "part").collect():
        if row["n"] > most:
            return row["_cycle"], row["first"] + most - 1
        most -= row["n"]
        if not most:
            return row["_cycle"], row["first"] + row["n"] - 1
    return end


def _write(chosen: DataFrame, config: RuleConfig, folder: str, at: tuple[int, int], policy: WritePolicy) -> None:
    """Decisions go to their files, and alerts and prices are read from there. Nothing is held in
    memory but, where decisions are not written, the accepted offers."""
    place = f"batch={at[0]}/turn={at[1]}"
    decisions = deals.decide_listings(chosen, config)
    if policy.decisions:
        decisions.write.mode("overwrite").parquet(f"{folder}/decisions/{place}")
        return _write_accepted(
            chosen.sparkSession.read.schema(decisions.schema).parquet(f"{folder}/decisions/{place}"), folder, place, policy
        )
    if not (policy.alerts or policy.state):
        return decisions.write.format("noop").mode("overwrite").save()
    accepted = decisions.where("status = 'ACCEPT'").persist()
    try:
        _write_accepted(accepted, folder, place, policy)
    finally:
        accepted.unpersist()


def _write_accepted(decisions: DataFrame, folder: str, place: str, policy: WritePolicy) -> None:
    if policy.alerts:
        deals.alert_rows(decisions).write.mode("overwrite").parquet(f"{folder}/alerts/{place}")
    if policy.state:
        prices = decisions.where("status = 'ACCEPT'").select("rules", "listing_id", "price", "config")
        prices.write.mode("overwrite").parquet(f"{folder}/prices/{place}")


def snapshot_stream(
    sightings: DataFrame, folder: str, checkpoint: str, every: str | None = None, buckets: int = 64
) -> StreamingQuery:
    """Listing snapshot: the new sightings of each batch merged into the hash buckets that they touch.

    What a batch reads and writes grows with the buckets it touches, not with the table. Running
    a batch again gives the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            snapshots.merge_batch(rows, upsert.upsert_listings, "fingerprint", folder, batch_id, buckets)
            upsert.observations(rows).write.mode("overwrite").parquet(f"{folder}/observations/batch={batch_id}")
        finally:
            rows.unpersist()

    return start(sightings.writeStream.foreachBatch(merge), checkpoint, every)


def latest_snapshot(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    return snapshots.read_snapshot(spark, folder, batch_id)


def price_history(prices: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Bounded history over the appended prices."""
    return deals.newest_per_key(prices, keys, order, limit).drop("place")


def last_batch(query: StreamingQuery) -> int:
    progress = query.lastProgress
    return -1 if progress is None else int(progress["batchId"])


def with_event_time(stream: DataFrame, column: str) -> DataFrame:
    return stream.withColumn("event_time", F.col(column).cast("timestamp"))
