"""Live versions of queries, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lensmill.operators import browse, merge
from lensmill.sources.store import Store


def watch(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 250) -> DataFrame:
    """New Parquet files of a folder, at most so many a batch: the source's back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def live_counts(stream: DataFrame, group: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Counts by group that are emitted again whenever they change."""
    out = stream.groupBy(group).agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).trigger(availableNow=True).start()


def counts_into(stream: DataFrame, group: str, store: Store, table: str, checkpoint: str) -> StreamingQuery:
    """Counts by group, kept in a table of the store: each batch replaces the counts that changed."""
    counts = stream.groupBy(group).agg(F.count("*").alias("n"))
    out = counts.writeStream.outputMode("update").foreachBatch(lambda batch, number: store.upsert(table, batch, group))
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into(stream: DataFrame, store: Store, table: str, *keys: str, time: str, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Each batch's last row of a key, by ``time``, replaces the table's; a batch that is run again changes nothing.

    Of rows with the same key and time the greatest counts, so a repeated batch picks the same.

    With ``seconds`` batches wait for that long (a debounce); without, what is there is taken and
    the query ends.
    """

    def save(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (*keys, time)]
        last = batch.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("r_"))
        store.upsert(table, last.select(*keys, "r_.*").select(*batch.columns), *keys)

    out = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


def live_page(stream: DataFrame, store: Store, table: str, *keys: str, time: str, sort: list[tuple[Column, bool]], size: int, page: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``page``, the first rows of a table in an order, up to date: each batch of changes makes both anew at once.

    sort: (key, descending) pairs, as browse.page() takes them, with a key that makes the order
    total. Later pages are asked for by keyset from the table, as of any version.
    """

    def save(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (*keys, time)]
        last = batch.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("r_")).select(*keys, "r_.*").select(*batch.columns)
        version = store.write(table, merge.replace(store.read(table), last, *keys) if store.exists(table) else last)
        rows = batch.sparkSession.read.parquet(f"{store.root}/{table}/{version}")
        store.publish(**{table: version, page: store.write(page, browse.page(rows, sort, size))})

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_file(stream: DataFrame, store: Store, stage: str, version: int, run: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """A stage over new files that skips what its state says is done, also after a restart."""
    schema = "filePath string, stageId string, status string, modelVersion int"

    def save(batch: DataFrame, number: int) -> None:
        state = store.read("analysis_state") if store.exists("analysis_state") else batch.sparkSession.createDataFrame([], schema)
        done = state.filter((F.col("stageId") == stage) & (F.col("modelVersion") == version))
        result = run(batch.dropDuplicates(["filePath"]).join(done.select("filePath"), "filePath", "left_anti"))
        new = result.select("filePath", F.lit(stage).alias("stageId"), F.lit("DONE").alias("status"), F.lit(version).alias("modelVersion"))
        store.save(analysis_state=merge.replace(state, new, "filePath", "stageId"))

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(stream: DataFrame, time: str, key: str, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One row for each burst of a key: its changes are quiet for the gap before it counts."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("changes")).select(
        key, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("ends_at"), "changes"
    )


def windowed(stream: DataFrame, time: str, group: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and group; rows later than the watermark are dropped (an extension)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")


class Leases(StatefulProcessor):
    """Keyed leases: a claim holds until it is done or its time runs out, then the key is free again."""

    def __init__(self, lease_ms: int = 30 * 60_000):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holder = handle.getValueState("holder", "token string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        for pdf in rows:
            for r in pdf.sort_values("at").to_dict("records"):
                held = self.holder.get() if self.holder.exists() else None
                free = held is None or held[1] <= r["at"]
                if r["action"] == "claim" and free:
                    self.holder.update((r["token"], int(r["at"]) + self.lease_ms))
                    self.handle.registerTimer(int(r["at"]) + self.lease_ms)
                    out.append((key[0], r["token"], "leased"))
                elif r["action"] == "claim":
                    out.append((key[0], r["token"], "refused"))
                elif held is not None and held[0] == r["token"]:
                    self.holder.clear()
                    out.append((key[0], r["token"], "done"))
        yield pd.DataFrame(out, columns=["task", "token", "state"])

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.holder.get() if self.holder.exists() else None
        out = []
        if held is not None and held[1] <= expired.getExpiryTimeInMs():
            self.holder.clear()
            out.append((key[0], held[0], "expired"))
        yield pd.DataFrame(out, columns=["task", "token", "state"])

    def close(self) -> None:
        pass


def leases(stream: DataFrame, lease_ms: int = 30 * 60_000) -> DataFrame:
    """(task, token, state) of a stream of (task, token, action, at): claims are granted, refused, done or expired."""
    return stream.groupBy("task").transformWithStateInPandas(Leases(lease_ms), "task string, token string, state string", "Append", "ProcessingTime")
