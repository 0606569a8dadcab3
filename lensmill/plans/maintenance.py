"""Maintenance runs: batches after a cursor, counters, and a result that is published at once.

A run is a row of ``maintenance_runs``. Each step takes the next candidates by key, appends what
it made to the run's staging table, and moves cursor and counters, all in one change; a run that
was stopped goes on there. When no candidate is left, the result is built from the staging table
and becomes the active generation together with its run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill import schemas
from lensmill.operators import dedup, merge
from lensmill.plans import pipeline
from lensmill.sources import scratch
from lensmill.sources.store import Store

TABLE = "maintenance_runs"


class Maintenance:
    """The task's unfinished run, or a new one with the next generation."""

    def __init__(self, store: Store, task: str, key: str = "filePath"):
        self.store, self.spark, self.task, self.key = store, store.spark, task, key
        self.staging = f"{task.lower()}_staging"
        open_ = None
        if store.exists(TABLE):
            mine = store.read(TABLE).filter(F.col("taskType") == task)
            open_ = mine.filter(F.col("status").isin(pipeline.RUNNING, pipeline.FINALIZING)).orderBy(F.col("generation").desc()).first()
        if open_ is None:
            self.generation = pipeline.next_generation(store.read(TABLE), task).first()[0] if store.exists(TABLE) else 1
            new = self.spark.createDataFrame([(task, self.generation, pipeline.RUNNING, None, 0, 0, 0, False)], schemas.RUNS)
            store.save(**{TABLE: store.read(TABLE).unionByName(new) if store.exists(TABLE) else new})
            self.status, self.cursor = pipeline.RUNNING, None
        else:
            self.generation, self.status, self.cursor = open_["generation"], open_["status"], open_["cursorPath"]

    def _set(self, staged: str | None = None, **values: Column) -> None:
        this = (F.col("taskType") == self.task) & (F.col("generation") == self.generation)
        runs = merge.guarded_update(self.store.read(TABLE), this & F.col("status").isin(pipeline.RUNNING, pipeline.FINALIZING), **values)
        self.store.publish(**{TABLE: self.store.write(TABLE, runs)} | ({self.staging: staged} if staged else {}))

    def step(self, candidates: DataFrame, size: int, work: Callable[[DataFrame], DataFrame]) -> bool:
        """Works on the next ``size`` candidates; False when none was left, and the run is ready to finish.

        Candidates that ``work`` gives no row for count as failed. A step that breaks marks nothing.
        """
        if self.status != pipeline.RUNNING:
            return False
        rows = candidates if self.cursor is None else candidates.filter(F.col(self.key) > self.cursor)
        batch, path = scratch.saved(rows.orderBy(self.key).limit(size))
        seen = batch.agg(F.count("*").alias("n"), F.max(F.col(self.key)).cast("string").alias("last")).first()
        if not seen["n"]:
            self._set(status=F.lit(pipeline.FINALIZING))
            self.status = pipeline.FINALIZING
            scratch.drop(self.spark, path)
            return False
        version = self.store.write(self.staging, work(batch).withColumn("generation", F.lit(self.generation).cast("long")))
        made = self.spark.read.parquet(f"{self.store.root}/{self.staging}/{version}").count()
        had = self.store.pointer().get(self.staging)
        counted = {"scannedCount": seen["n"], "eligibleCount": made, "failedCount": seen["n"] - made}
        self._set(",".join([*([had] if had else []), version]), cursorPath=F.lit(seen["last"]), **{c: F.col(c) + n for c, n in counted.items()})
        self.cursor = seen["last"]
        scratch.drop(self.spark, path)
        return True

    def fail(self) -> None:
        """Ends the run without a result; the active generation stays."""
        self._set(status=F.lit(pipeline.FAILED))
        self.status = pipeline.FAILED

    def finish(self, build: Callable[[DataFrame], dict[str, DataFrame]]) -> bool:
        """Publishes what ``build`` makes of the staged rows; False unless all candidates are done.

        It can be run again after a stop: the tables are made anew and published in one change.
        """
        if self.status != pipeline.FINALIZING:
            return False
        staged = self.store.read(self.staging) if self.store.exists(self.staging) else None
        tables = {} if staged is None else build(staged.filter(F.col("generation") == self.generation).drop("generation"))
        tables = {n: df.withColumn("generation", F.lit(self.generation).cast("long")) for n, df in tables.items()}
        left = {} if staged is None else {self.staging: staged.filter(F.col("generation") != self.generation)}
        pipeline.publish_generation(self.store, TABLE, self.task, self.generation, **tables, **left)
        self.status = pipeline.COMPLETED
        return True


def exact_duplicates(store: Store, media: DataFrame, content: Column, size: int = 1_000_000, steps: int = 8) -> bool:
    """Groups and members of files with equal content, as a run of at most ``steps`` batches; True when published."""
    run = Maintenance(store, "DUPLICATE_EXACT")
    candidates = dedup.repeated_values(media, "fileSize")

    def build(rows: DataFrame) -> dict[str, DataFrame]:
        grouped = dedup.groups(rows, "filePath", "fileSize")
        return {"duplicate_groups": grouped, "duplicate_members": dedup.members(rows, grouped, "filePath")}

    for _ in range(steps):
        if not run.step(candidates, size, lambda batch: batch.select("filePath", "fileSize", F.sha2(content, 256).alias("exact_hash")).filter("exact_hash is not null")):
            return run.finish(build)
    return False
