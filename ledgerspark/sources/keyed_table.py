"""A table that is changed by key: rows lie in buckets of their key, a change rewrites the buckets it touches, and a manifest says which files count.

Files are never changed in place. New keys may be appended in folders of their own; any other change writes new folders for the touched buckets, then a manifest with the next number, by a rename that
fails if another writer was there first; readers take the newest manifest. A batch has a number, and one that was applied before is
left out, so a stream may replay it. Buckets are numbers below ``buckets``: that is all the driver handles. Choose their number so that a bucket, not the
table, fits a task; a bucket's rows of one key are combined before they meet (hot keys are one row each).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer wrote the manifest of this number; read and change again."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """version, batches (the last number by source) and folders (by bucket, one or a list) of the newest manifest."""
        root = self._hadoop(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        names = sorted(n for n in names if n.endswith(".json"))
        if not names:
            return {"version": 0, "batches": {}, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0])

    def read(self, only: list[int] | None = None) -> DataFrame:
        folders = self.manifest()["folders"]
        paths = [p for b, there in folders.items() if only is None or int(b) in only for p in ([there] if isinstance(there, str) else there)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def upsert(self, batch: DataFrame, order: list[str], number: int | None = None, source: str = "") -> bool:
        """Of each key the newest row by order stays, of those there are and those of the batch. False if the batch was applied before."""
        names = [f.name for f in self.schema if f.name != self.key]
        newest = F.max_by(F.struct(*names), F.struct(*order)).alias("r")

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.unionByName(new).groupBy(self.key).agg(newest).select(self.key, "r.*")

        return self._change(batch.select(self.schema.names), batch, change, number, source)

    def replace(self, keys: DataFrame, rows: DataFrame, number: int | None = None, source: str = "") -> bool:
        """All that the keys have goes, and the rows (of those keys) take its place."""
        gone = keys.select(self.key).distinct()

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(gone, self.key, "left_anti").select(self.schema.names).unionByName(new.join(gone, self.key, "left_semi").select(self.schema.names))

        return self._change(rows.select(self.schema.names), keys, change, number, source)

    def append(self, rows: DataFrame, number: int | None = None, source: str = "") -> bool:
        """Rows of keys that the table does not hold yet, one a key, in folders beside those that are there: nothing stored is written again."""
        now = self.manifest()
        if number is not None and number <= now["batches"].get(source, -1):
            return False
        folder = f"{self.path}/data/{now['version'] + 1:08d}-{uuid.uuid4().hex}"
        rows.select(self.schema.names).withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        for name in (s.getPath().getName() for s in self._fs.listStatus(self._hadoop(folder))):
            if name.startswith("_bucket="):
                there = now["folders"].get(name[len("_bucket="):], [])
                now["folders"][name[len("_bucket="):]] = [*([there] if isinstance(there, str) else there), f"{folder}/{name}"]
        return self._counted(now, number, source)

    def _counted(self, now: dict, number: int | None, source: str) -> bool:
        if number is not None:
            now["batches"][source] = number
        now["version"] += 1
        self._swap(now)
        return True

    def _change(self, rows: DataFrame, touching: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], number: int | None, source: str) -> bool:
        now = self.manifest()
        if number is not None and number <= now["batches"].get(source, -1):
            return False
        touched = self.touched(touching)
        if touched:
            old = self.read(touched)
            folder = f"{self.path}/data/{now['version'] + 1:08d}-{uuid.uuid4().hex}"
            change(old, rows).withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            there = {s.getPath().getName() for s in self._fs.listStatus(self._hadoop(folder))}
            for b in touched:
                name = f"_bucket={b}"
                now["folders"].pop(str(b), None)
                if name in there:  # a bucket whose rows all went has no folder
                    now["folders"][str(b)] = f"{folder}/{name}"
        return self._counted(now, number, source)

    def _swap(self, manifest: dict) -> None:
        temporary = self._hadoop(f"{self.path}/manifests/{uuid.uuid4().hex}.tmp")
        final = self._hadoop(f"{self.path}/manifests/{manifest['version']:08d}.json")
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise Conflict(f"version {manifest['version']} of {self.path}")
