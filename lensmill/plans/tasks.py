"""Leased work queues as tables: every step takes the queue and returns the changed queue.

The caller saves the result with a Store; there is one writer, so a claim is exclusive once saved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill.functions import hashes, maths
from lensmill.operators import merge

PENDING, LEASED, DONE, FAILED, SUPERSEDED, EXHAUSTED, COMPLETED = "PENDING", "LEASED", "DONE", "FAILED", "SUPERSEDED", "EXHAUSTED", "COMPLETED"
LEASE_MS, ATTEMPTS = 30 * 60_000, 3


def enqueue(queue: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("filePath", "sourceVersion", "pipelineScope")) -> DataFrame:
    """New tasks; a known key stays as it is, but DONE and FAILED start again. SUPERSEDED never does."""
    again = new.select(*keys, F.lit(True).alias("again_"))
    back = F.coalesce("again_", F.lit(False)) & F.col("status").isin(DONE, FAILED)
    kept = queue.join(again, list(keys), "left")
    kept = merge.guarded_update(kept, back, status=F.lit(PENDING), attemptCount=F.lit(0), nextRetryAt=F.lit(0).cast("long"), leaseUntil=F.lit(0).cast("long"), leaseToken=F.lit(None).cast("string"))
    return merge.ignore(kept.drop("again_").select(*queue.columns), new.select(*queue.columns), *keys)


def supersede(queue: DataFrame, current: DataFrame) -> DataFrame:
    """Open tasks of an older version of a file, in the same scope, give way."""
    now = current.select("filePath", "pipelineScope", F.col("sourceVersion").alias("now_"))
    old = F.col("now_").isNotNull() & (F.col("now_") != F.col("sourceVersion")) & (F.col("status") != DONE)
    joined = queue.join(now, ["filePath", "pipelineScope"], "left")
    return merge.guarded_update(joined, old, status=F.lit(SUPERSEDED), leaseToken=F.lit(None).cast("string")).select(*queue.columns)


def recover(queue: DataFrame, now: int) -> DataFrame:
    """Leases that have run out are free again."""
    lost = (F.col("status") == LEASED) & (F.col("leaseUntil") <= now)
    return merge.guarded_update(queue, lost, status=F.lit(PENDING), leaseToken=F.lit(None).cast("string"), leaseUntil=F.lit(0).cast("long"))


def claimable(queue: DataFrame, now: int, limit: int, scope: str | None = None) -> DataFrame:
    """The next tasks: highest priority, then oldest, then least id."""
    ready = queue.filter((F.col("status") == PENDING) & (F.col("nextRetryAt") <= now))
    if scope is not None:
        ready = ready.filter(F.col("pipelineScope") == scope)
    return ready.orderBy(F.col("priority").desc(), F.col("createdAt"), F.col("taskId")).limit(limit)


def claim(queue: DataFrame, now: int, limit: int, token: str, lease_ms: int = LEASE_MS, scope: str | None = None) -> DataFrame:
    """The queue with up to ``limit`` tasks leased to the token."""
    mine = claimable(queue, now, limit, scope).select("taskId", F.lit(True).alias("mine_"))
    joined = queue.join(F.broadcast(mine), "taskId", "left")
    leased = F.coalesce("mine_", F.lit(False))
    return merge.guarded_update(joined, leased, status=F.lit(LEASED), leaseToken=F.lit(token), leaseUntil=F.lit(now + lease_ms).cast("long")).select(*queue.columns)


def _held(token: str) -> Column:
    return (F.col("status") == LEASED) & (F.col("leaseToken") == token)


def heartbeat(queue: DataFrame, token: str, now: int, lease_ms: int = LEASE_MS) -> DataFrame:
    return merge.guarded_update(queue, _held(token), leaseUntil=F.lit(now + lease_ms).cast("long"))


def finish(queue: DataFrame, token: str, done: DataFrame) -> DataFrame:
    """Tasks of the token whose ids are in ``done`` are done."""
    joined = queue.join(done.select("taskId", F.lit(True).alias("d_")), "taskId", "left")
    return merge.guarded_update(joined, _held(token) & F.coalesce("d_", F.lit(False)), status=F.lit(DONE), leaseToken=F.lit(None).cast("string")).select(*queue.columns)


def fail(queue: DataFrame, token: str, failed: DataFrame, now: int, attempts: int = ATTEMPTS, base_ms: int = 60_000, cap_ms: int = 6 * 3_600_000) -> DataFrame:
    """Failed tasks of the token wait longer each time, and after the last attempt are FAILED."""
    joined = queue.join(failed.select("taskId", F.lit(True).alias("f_")), "taskId", "left")
    hit = _held(token) & F.coalesce("f_", F.lit(False))
    more = F.col("attemptCount") + 1 < attempts
    return merge.guarded_update(
        joined,
        hit,
        status=F.when(more, PENDING).otherwise(FAILED),
        nextRetryAt=F.lit(now).cast("long") + maths.backoff(F.col("attemptCount"), base_ms, cap_ms),
        attemptCount=F.col("attemptCount") + 1,
        leaseToken=F.lit(None).cast("string"),
    ).select(*queue.columns)


def promote(queue: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("filePath", "sourceVersion", "pipelineScope")) -> DataFrame:
    """Tasks that somebody waits for: the higher priority, and DONE or FAILED ones are open again."""
    joined = queue.join(wanted.select(*keys, F.col("priority").alias("p_")), list(keys), "left")
    hit = F.col("p_").isNotNull()
    return merge.guarded_update(joined, hit, priority=F.greatest("priority", "p_"), status=F.when(F.col("status").isin(DONE, FAILED), PENDING).otherwise(F.col("status"))).select(*queue.columns)


# Deletions that survive a crash.
DELETE_ATTEMPTS = 8


def bury(tombstones: DataFrame, paths: DataFrame, operation: str, now: int) -> DataFrame:
    """Intents to delete, one per path; a known path starts again."""
    new = paths.select(
        hashes.path_key(F.col("filePath")).alias("pathKey"), "filePath", F.lit(operation).alias("operation"), F.lit(PENDING).alias("state"), F.lit(0).alias("attemptCount"),
        F.lit(0).cast("long").alias("nextRetryAt"), F.lit(0).cast("long").alias("leaseUntil"), F.lit(None).cast("string").alias("leaseToken"), F.lit(now).cast("long").alias("deletedAtMs"),
    ).dropDuplicates(["pathKey"])
    return merge.replace(tombstones, new, "pathKey")


def claim_tombstones(tombstones: DataFrame, now: int, limit: int, token: str, lease_ms: int = 10 * 60_000) -> DataFrame:
    """Leases intents that are due, also those whose lease has run out."""
    free = ((F.col("state") == PENDING) & (F.col("nextRetryAt") <= now)) | ((F.col("state") == LEASED) & (F.col("leaseUntil") <= now))
    mine = tombstones.filter(free).orderBy("deletedAtMs", "pathKey").limit(limit).select("pathKey", F.lit(True).alias("mine_"))
    joined = tombstones.join(F.broadcast(mine), "pathKey", "left")
    return merge.guarded_update(joined, F.coalesce("mine_", F.lit(False)), state=F.lit(LEASED), leaseToken=F.lit(token), leaseUntil=F.lit(now + lease_ms).cast("long")).select(*tombstones.columns)


def settle_tombstones(tombstones: DataFrame, token: str, deleted: DataFrame, now: int) -> DataFrame:
    """Leased intents: deleted paths are COMPLETED, others wait, and after the eighth attempt are EXHAUSTED."""
    joined = tombstones.join(deleted.select("filePath", F.lit(True).alias("d_")), "filePath", "left")
    mine = (F.col("state") == LEASED) & (F.col("leaseToken") == token)
    done, last = F.coalesce("d_", F.lit(False)), F.col("attemptCount") + 1 >= DELETE_ATTEMPTS
    return merge.guarded_update(
        joined,
        mine,
        state=F.when(done, COMPLETED).when(last, EXHAUSTED).otherwise(PENDING),
        nextRetryAt=F.lit(now).cast("long") + maths.backoff(F.col("attemptCount"), 30_000, 6 * 3_600_000),
        attemptCount=F.col("attemptCount") + 1,
        leaseToken=F.lit(None).cast("string"),
    ).select(*tombstones.columns)


def exhume(tombstones: DataFrame, restored: DataFrame) -> DataFrame:
    """Restored paths have no intent any more."""
    return tombstones.join(restored.select("filePath"), "filePath", "left_anti")


def trash(media: DataFrame, paths: DataFrame, now: int) -> DataFrame:
    joined = media.join(paths.select("filePath", F.lit(True).alias("t_")), "filePath", "left")
    return merge.guarded_update(joined, F.coalesce("t_", F.lit(False)), isTrashed=F.lit(True), deletedAtMs=F.lit(now).cast("long")).select(*media.columns)


def untrash(media: DataFrame, paths: DataFrame) -> DataFrame:
    joined = media.join(paths.select("filePath", F.lit(True).alias("t_")), "filePath", "left")
    return merge.guarded_update(joined, F.coalesce("t_", F.lit(False)), isTrashed=F.lit(False), deletedAtMs=F.lit(0).cast("long")).select(*media.columns)
