"""Stage graphs over tables: order, runs that skip what is done, scan runs, published generations."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.operators import merge
from lensmill.sources.store import Store

DONE, FAILED = "DONE", "FAILED"
RUNNING, FINALIZING, COMPLETED = "RUNNING", "FINALIZING", "COMPLETED"


@dataclass
class Stage:
    """A step of analysis: takes (file, ...) rows and returns (filePath, failed, ...) rows."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    after: tuple[str, ...] = ()
    version: int = 1


class CycleError(ValueError):
    """Stages wait for each other."""


def ordered(stages: list[Stage]) -> list[Stage]:
    """Stages after all that they wait for, else in the order given; unknown names are no condition."""
    names = {s.name for s in stages}
    left, out, done = list(stages), [], set()
    while left:
        ready = next((s for s in left if all(d in done for d in s.after if d in names)), None)
        if ready is None:
            raise CycleError(", ".join(s.name for s in left))
        left.remove(ready)
        out.append(ready)
        done.add(ready.name)
    return out


def pending(files: DataFrame, state: DataFrame, stage: Stage) -> DataFrame:
    """Files that the stage has not done in its version."""
    done = state.filter((F.col("stageId") == stage.name) & (F.col("status") == DONE) & (F.col("modelVersion") == stage.version))
    return files.join(done.select("filePath"), "filePath", "left_anti")


@dataclass
class Report:
    stage: str
    files: int = 0
    failed: int = 0
    seconds: float = 0.0
    error: str = ""
    extra: dict = field(default_factory=dict)


def run_stages(files: DataFrame, stages: list[Stage], store: Store, table: str = "analysis_state") -> list[Report]:
    """Runs each stage over its pending files; results and checkpoints are published together.

    A stage that breaks fails as a whole and leaves the others to run. A row with ``failed`` set
    is not checkpointed, so the next run tries only that file again.
    """
    spark, reports = files.sparkSession, []
    empty = spark.createDataFrame([], "filePath string, stageId string, status string, modelVersion int")
    for stage in ordered(stages):
        began, report = time.monotonic(), Report(stage.name)
        try:
            state = store.read(table) if store.exists(table) else empty
            result = stage.run(pending(files, state, stage))
            version = store.write(f"result_{stage.name}", result)
            made = spark.read.parquet(f"{store.root}/result_{stage.name}/{version}")
            ok = made.filter(~F.coalesce("failed", F.lit(False)))
            new = ok.select("filePath", F.lit(stage.name).alias("stageId"), F.lit(DONE).alias("status"), F.lit(stage.version).alias("modelVersion")).distinct()
            counts = made.agg(F.count("*").alias("n"), F.count_if(F.coalesce("failed", F.lit(False))).alias("f")).first()
            report.files, report.failed = counts["n"], counts["f"]
            old = store.read(f"result_{stage.name}") if store.exists(f"result_{stage.name}") else None
            kept = ok if old is None else merge.replace(old, ok, "filePath")
            store.publish(**{f"result_{stage.name}": store.write(f"result_{stage.name}", kept), table: store.write(table, merge.replace(state, new, "filePath", "stageId"))})
        except Exception as e:  # noqa: BLE001  one stage's failure is its own
            report.error = str(e)[:500]
        report.seconds = time.monotonic() - began
        reports.append(report)
    return reports


def progress(state: DataFrame, files: int, stages: list[str], rate: float) -> DataFrame:
    """Per stage: files done and their share; and the whole's percentage and seconds left at a rate of files a second."""
    done = state.filter(F.col("status") == DONE).groupBy("stageId").agg(F.count_distinct("filePath").alias("done"))
    all_stages = state.sparkSession.createDataFrame([(s,) for s in stages], "stageId string")
    rows = all_stages.join(done, "stageId", "left").withColumn("done", F.coalesce("done", F.lit(0))).withColumn("share", F.least(F.lit(1.0), F.col("done") / max(files, 1)))
    whole = rows.agg(F.avg("share").alias("w_"), F.sum(F.lit(files) - F.least("done", F.lit(files))).alias("l_"))
    return rows.join(F.broadcast(whole)).select("stageId", "done", "share", F.floor(F.col("w_") * 100).alias("percent"), (F.col("l_") / max(rate, 1e-9)).alias("seconds_left"))


class ScanRun:
    """A scan of two sources into the media table, with purge of what neither has seen."""

    def __init__(self, store: Store, now: int):
        self.store, self.spark = store, store.spark
        runs = store.read("scan_runs") if store.exists("scan_runs") else None
        last = (runs.agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0] if runs is not None else 0) or 0
        self.generation = max(now, last + 1)
        self.complete, self.batches = {"catalog": False, "files": False}, 0
        self._record(RUNNING)

    def _record(self, status: str) -> None:
        row = self.spark.createDataFrame([(self.generation, status, self.complete["catalog"], self.complete["files"])], "generation long, status string, mediaStoreCompleted boolean, fileSystemCompleted boolean")
        self.status = status
        if self.store.exists("scan_runs"):
            runs = merge.guarded_update(self.store.read("scan_runs"), (F.col("status") == RUNNING) & (F.col("generation") != self.generation), status=F.lit("ABORTED"))
            row = merge.replace(runs, row, "generation")
        self.store.save(scan_runs=row)

    def commit(self, batch: DataFrame) -> None:
        """Adds one batch of scanned rows; it is durable when this returns, and merged with all others."""
        self.store.append("scan_staging", batch.withColumn("stagedGeneration", F.lit(self.generation).cast("long")).withColumn("stagedAt", F.lit(self.batches).cast("long")))
        self.batches += 1

    def merge(self) -> None:
        """Merges the run's batches into the media table, which is written once; of equal paths the last batch counts."""
        if not self.store.exists("scan_staging"):
            return
        staged = self.store.read("scan_staging").filter(F.col("stagedGeneration") == self.generation)
        columns = [c for c in staged.columns if c not in ("stagedGeneration", "stagedAt")]
        last = staged.groupBy("filePath").agg(F.max_by(F.struct(*columns), "stagedAt").alias("r_"))
        self._merge(last.select("r_.*").select(*columns))

    def _merge(self, batch: DataFrame) -> None:
        media = self.store.read("media_items") if self.store.exists("media_items") else batch.limit(0).withColumn("scanGeneration", F.lit(0).cast("long"))
        tombstones = self.store.read("deletion_tombstones") if self.store.exists("deletion_tombstones") else self.spark.createDataFrame([], "filePath string, deletedAtMs long")
        rows = merge.upsert(media, batch, tombstones, self.generation).drop("changed")
        left = self.store.read("scan_staging").filter(F.col("stagedGeneration") > self.generation)
        self.store.save(media_items=merge.replace(media, rows.select(*media.columns), "filePath"), scan_staging=left)

    def source_done(self, name: str) -> None:
        self.complete[name] = True
        self._record(self.status)

    def purge(self) -> bool:
        """Drops rows of other generations, only when both sources are complete and the run still runs."""
        if self.status != RUNNING or not all(self.complete.values()):
            return False
        self.merge()
        media = self.store.read("media_items")
        self.store.save(media_items=media.filter(F.col("scanGeneration") == self.generation))
        self._record(COMPLETED)
        return True


def publish_generation(store: Store, runs_table: str, task: str, generation: int, **tables: DataFrame) -> None:
    """Makes a generation of results the active one of its task, together with its tables."""
    runs = store.read(runs_table)
    this = (F.col("taskType") == task) & (F.col("generation") == generation)
    runs = merge.guarded_update(runs, F.col("taskType") == task, isActive=this)
    runs = merge.guarded_update(runs, this, status=F.lit(COMPLETED))
    store.save(**{runs_table: runs} | tables)


def active_rows(rows: DataFrame, runs: DataFrame, task: str) -> DataFrame:
    """Rows of the task's active generation, as a join with its one run."""
    active = runs.filter((F.col("taskType") == task) & F.col("isActive") & (F.col("status") == COMPLETED)).select("generation")
    return rows.join(F.broadcast(active), "generation", "left_semi")


def next_generation(runs: DataFrame, task: str) -> DataFrame:
    """One row: one more than the largest generation so far."""
    return runs.filter(F.col("taskType") == task).agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("generation"))


def replace_snapshot(store: Store, directories: DataFrame, now: int) -> None:
    """The album snapshot and its version, in one step."""
    version = (store.read("album_snapshot_meta").first()["snapshotVersion"] + 1) if store.exists("album_snapshot_meta") else 1
    meta = store.spark.createDataFrame([(version, now)], "snapshotVersion long, createdAt long")
    store.save(album_snapshot_directories=directories, album_snapshot_meta=meta)


def spark_for(app: str, **conf: str) -> SparkSession:
    """A session with the settings that the library expects: UTC, adaptive execution, skew handling."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=defaults | conf).getOrCreate()
