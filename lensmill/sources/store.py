"""Versioned tables: directories of Parquet versions and one pointer file for all of them.

A change writes new versions beside the old ones and then replaces the pointer, so readers see all
tables of a change or none, and a writer that dies leaves the old state. There is one writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lensmill.operators import merge


class Store:
    """Tables below a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def pointer(self) -> dict[str, str]:
        """The current version of each table."""
        at = self._path(f"{self.root}/current.json")
        if not self._fs.exists(at):
            return {}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/current.json").first()[0])

    def exists(self, name: str) -> bool:
        return name in self.pointer()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{name}/{v}" for v in self.pointer()[name].split(",")])

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to a table without writing those it has again."""
        had = self.pointer().get(name)
        self.publish(**{name: ",".join([*([had] if had else []), self.write(name, df)])})

    def write(self, name: str, df: DataFrame, partition_by: list[str] = ()) -> str:
        """A new version that nothing points to yet."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{version}")
        return version

    def publish(self, **versions: str) -> None:
        """Points to new versions of one or more tables at once."""
        state = json.dumps(self.pointer() | versions)
        temporary, final = self._path(f"{self.root}/new-{uuid.uuid4().hex}"), self._path(f"{self.root}/current.json")
        self._fs.mkdirs(self._path(self.root))
        out = self._fs.create(temporary, True)
        out.write(bytearray(state.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(final), overwrite)

    def save(self, **tables: DataFrame) -> None:
        """Writes and publishes tables together."""
        self.publish(**{name: self.write(name, df) for name, df in tables.items()})

    def upsert(self, name: str, new: DataFrame, *keys: str, policy: str = "replace") -> None:
        """Rows into a table, with conflicts replaced, ignored or refused."""
        if not self.exists(name):
            self.save(**{name: new})
            return
        how: dict[str, Callable] = {"replace": merge.replace, "ignore": merge.ignore, "abort": merge.abort}
        self.save(**{name: how[policy](self.read(name), new, *keys)})

    def delete_where(self, name: str, condition) -> None:
        """Rows for which the condition holds go; a null condition keeps the row."""
        from pyspark.sql import functions as F

        self.save(**{name: self.read(name).filter(~F.coalesce(condition, F.lit(False)))})

    def cascade(self, gone: DataFrame, key: str, names: list[str]) -> None:
        """Rows of several tables whose key is in ``gone`` go, in one change."""
        self.save(**{n: self.read(n).join(gone.select(key), key, "left_anti") for n in names if self.exists(n)})

    def vacuum(self, name: str) -> int:
        """Deletes the versions of a table that nothing points to; their number."""
        current, n = self.pointer().get(name, "").split(","), 0
        for status in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            if status.getPath().getName() not in current:
                self._fs.delete(status.getPath(), True)
                n += 1
        return n
