"""Backup archives: NDJSON per table with a manifest, checked before anything is restored."""

from __future__ import annotations

import json
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

# The contract's tables (entry, required, capability) and the limits of an archive.
TABLES = {
    "media_items": (True, "media.v1"), "faces": (False, "face.v1"), "face_cluster_meta": (False, "face.cluster.v1"), "face_cluster_prototypes": (False, "face.prototype.v1"),
    "media_embeddings": (False, "embedding.v1"), "semantic_index_meta": (False, "semantic.index.v1"), "semantic_cluster_meta": (False, "semantic.cluster.v1"),
    "semantic_cluster_members": (False, "semantic.cluster.v1"), "duplicate_groups": (False, "duplicate.v1"), "duplicate_members": (False, "duplicate.v1"), "analysis_state": (False, "analysis.state.v1"),
    "feature_store": (False, "feature.store.v1"), "plugin_manifest": (False, "plugin.v1"), "deletion_tombstones": (False, "deletion.intent.v1"), "album_snapshot_directories": (False, "snapshot.v1"),
}
KNOWN = frozenset(capability for _, capability in TABLES.values())
TRANSIENT = ("thumbnail_cache_entries", "scan_staging", "scan_runs", "maintenance_runs", "duplicate_exact_staging")
MOST_ENTRIES, MOST_RATIO, MOST_ENTRY, MOST_TOTAL, MOST_LINE = 64, 200, 512 << 20, 1 << 30, 4 << 20
MOST_LEGACY = 100_000
VERSION = 2


class BackupError(ValueError):
    """The archive must not be restored."""


def to_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON lines; binary columns as Base64, nulls written out."""
    columns = [F.base64(F.col(f.name)).alias(f.name) if isinstance(f.dataType, BinaryType) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def from_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """The rows of JSON lines; a line that is no JSON is an error."""
    as_text = ", ".join(f"`{f.name}` {'string' if isinstance(f.dataType, BinaryType) else f.dataType.simpleString()}" for f in schema)
    parsed = lines.select(F.from_json("value", as_text, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select([F.unbase64(F.col(f"r.{f.name}")).alias(f.name) if isinstance(f.dataType, BinaryType) else F.col(f"r.{f.name}").alias(f.name) for f in schema])


def manifest_of(lines: DataFrame) -> DataFrame:
    """One row: lines, bytes with line ends, and a hash that does not depend on the order of the lines."""
    return lines.agg(
        F.count("*").alias("lines"),
        F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"),
        F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(F.sum(F.conv(F.substring(F.sha2("value", 256), i, 13), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in (1, 14, 27, 40)]), 256).alias("sha256"),
    )


def export(tables: dict[str, DataFrame], folder: str) -> dict:
    """Writes each table as NDJSON below the folder, in parallel, and the manifest beside them."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {"version": VERSION, "capabilities": sorted({TABLES[n][1] for n in tables}), "entries": {}}
    for name, df in tables.items():
        if name not in TABLES:
            raise BackupError(f"{name} is not in the contract")
        to_lines(df).write.text(f"{folder}/{name}.ndjson")
        row = manifest_of(spark.read.text(f"{folder}/{name}.ndjson")).first()
        manifest["entries"][name] = {"lines": row["lines"], "bytes": row["bytes"], "sha256": row["sha256"]}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def check_manifest(manifest: dict) -> None:
    if manifest.get("version") != VERSION:
        raise BackupError("unknown version")
    if unknown := set(manifest["capabilities"]) - KNOWN:
        raise BackupError(f"unknown capabilities {sorted(unknown)}")
    if missing := [n for n, (required, _) in TABLES.items() if required and n not in manifest["entries"]]:
        raise BackupError(f"missing tables {missing}")
    if len(manifest["entries"]) > MOST_ENTRIES or sum(e["bytes"] for e in manifest["entries"].values()) > MOST_TOTAL or any(e["bytes"] > MOST_ENTRY for e in manifest["entries"].values()):
        raise BackupError("too large")


def restore(spark: SparkSession, folder: str, schemas: dict[str, StructType], store, now: int = 0) -> dict[str, int]:
    """Checks every entry, stages all tables, and publishes them in one step; the live tables change only then.

    The same step empties the contract's tables that the archive lacks and those that must not
    outlive a restore, seeds the task tables again from the media table (``now`` is their time),
    and switches off index rows whose space has no vectors.
    """
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    check_manifest(manifest)
    staged, counts = {}, {}
    for name, said in manifest["entries"].items():
        lines = spark.read.text(f"{folder}/{name}.ndjson")
        row = manifest_of(lines).first()
        if (row["lines"], row["bytes"], row["sha256"]) != (said["lines"], said["bytes"], said["sha256"]):
            raise BackupError(f"{name} does not match the manifest")
        if lines.filter(F.octet_length("value") > MOST_LINE).limit(1).count():
            raise BackupError(f"{name} has a line that is too long")
        staged[name] = store.write(name, from_lines(lines, schemas[name]))
        counts[name] = row["lines"]
    read = lambda name: spark.read.parquet(f"{store.root}/{name}/{staged[name]}")
    for name in (*TABLES, *TRANSIENT):
        if name not in staged and store.exists(name):
            staged[name] = store.write(name, store.read(name).limit(0))
    if "semantic_index_meta" in counts and "media_embeddings" in counts:
        staged["semantic_index_meta"] = store.write("semantic_index_meta", drop_orphan_spaces(read("semantic_index_meta"), read("media_embeddings")))
    if {"filePath", "mediaType", "isTrashed", "modifiedAtMs", "fileSize"} <= set(read("media_items").columns):
        for name, rows in seeded_tasks(read("media_items"), now).items():
            staged[name] = store.write(name, rows)
    store.publish(**staged)
    return counts


def seeded_tasks(media: DataFrame, now: int) -> dict[str, DataFrame]:
    """Fresh task tables: analysis of every image and a thumbnail of every file, trashed ones left out."""
    live = media.filter(~F.coalesce("isTrashed", F.lit(False)))
    task = [F.xxhash64("filePath").alias("taskId"), "filePath", F.concat_ws(":", "modifiedAtMs", "fileSize").alias("sourceVersion")]
    state = {"priority": F.lit(0), "status": F.lit("PENDING"), "attemptCount": F.lit(0), "nextRetryAt": F.lit(0).cast("long"), "leaseUntil": F.lit(0).cast("long"), "leaseToken": F.lit(None).cast("string"), "createdAt": F.lit(now).cast("long")}
    state = [c.alias(n) for n, c in state.items()]
    return {
        "analysis_tasks": live.filter("mediaType = 'IMAGE'").select(*task, F.lit("core:v1").alias("pipelineScope"), *state),
        "thumbnail_tasks": live.select(*task, F.lit("grid").alias("sizeClass"), "mediaType", *state),
    }


def export_zip(tables: dict[str, DataFrame], folder: str, path: str) -> dict:
    """export() to the folder, and the same as one ZIP file on the driver: the manifest and an entry for each table.

    Lines stream through the driver. An archive's limits are far below what a driver can take;
    beyond them the folder is the backup.
    """
    manifest, spark = export(tables, folder), next(iter(tables.values())).sparkSession
    check_manifest(manifest)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(manifest))
        for name in tables:
            with z.open(f"{name}.ndjson", "w") as out:
                for row in spark.read.text(f"{folder}/{name}.ndjson").toLocalIterator():
                    out.write(f"{row['value']}\n".encode())
    return manifest


def restore_zip(spark: SparkSession, path: str, folder: str, schemas: dict[str, StructType], store, now: int = 0) -> dict[str, int]:
    """restore() from an archive, after checks of its form; ``folder`` is new and shared with the executors."""
    names = check_zip(path)
    with zipfile.ZipFile(path) as z:
        if "manifest.json" not in names or z.getinfo("manifest.json").file_size > MOST_LINE:
            raise BackupError("no manifest, or too large a one")
        manifest = json.loads(z.read("manifest.json"))
        check_manifest(manifest)
        entries = {f"{n}.ndjson" for n in manifest["entries"]}
        if unknown := entries - {f"{n}.ndjson" for n in TABLES}:
            raise BackupError(f"unknown entries {sorted(unknown)}")
        if entries != set(names) - {"manifest.json"}:
            raise BackupError("entries and manifest differ")
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total = 0
        for name in sorted(entries):
            out, size = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), False), 0
            with z.open(name) as source:
                while part := source.read(1 << 20):
                    size, total = size + len(part), total + len(part)
                    if size > MOST_ENTRY or total > MOST_TOTAL:  # whatever the directory of the archive says
                        out.close()
                        raise BackupError(f"the entry {name} is too large")
                    out.write(bytearray(part))
            out.close()
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return restore(spark, folder, schemas, store, now)


def check_zip(path: str) -> list[str]:
    """Names of a ZIP archive's entries, after checks of their number, names, sizes and ratios."""
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
        names = [i.filename for i in infos]
        if len(infos) > MOST_ENTRIES:
            raise BackupError("too many entries")
        if len(set(names)) != len(names):
            raise BackupError("an entry occurs twice")
        for i in infos:
            parts = PurePosixPath(i.filename.replace("\\", "/")).parts
            if i.filename.startswith("/") or ".." in parts or ":" in i.filename:
                raise BackupError(f"the entry {i.filename} leads outside")
            if i.file_size > MOST_ENTRY or i.file_size > MOST_RATIO * max(i.compress_size, 1):
                raise BackupError(f"the entry {i.filename} is too large")
        if sum(i.file_size for i in infos) > MOST_TOTAL:
            raise BackupError("the archive is too large")
        return names


def read_legacy(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of an archive of version 1: one JSON object with an array for each table."""
    shape = ", ".join(f"`{n}` array<struct<{s}>>" for n, s in schemas.items())
    whole = spark.read.schema(shape).json(path, multiLine=True)
    return {n: whole.select(F.explode(n).alias("r")).select("r.*") for n in schemas}


def write_legacy(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON object with all tables, which is all that version 1 knows; larger tables need version 2."""
    if any(df.limit(MOST_LEGACY + 1).count() > MOST_LEGACY for df in tables.values()):
        raise BackupError(f"a table of more than {MOST_LEGACY} rows does not fit into one row")
    spark = next(iter(tables.values())).sparkSession
    out = spark.range(1).select(F.lit(1).alias("version"))
    for name, df in tables.items():
        out = out.join(F.broadcast(df.agg(F.collect_list(F.struct(*df.columns)).alias(name))))
    out.write.json(path)


def drop_orphan_spaces(meta: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Index rows with isActive off where no embedding of their space exists."""
    live = embeddings.select("spaceId").distinct().withColumn("live_", F.lit(True))
    return meta.join(live, "spaceId", "left").withColumn("isActive", F.col("isActive") & F.coalesce("live_", F.lit(False))).drop("live_")
