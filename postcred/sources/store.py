"""Incremental landing of posts (S5/S6): a table in hash buckets that grows by capture folders.

A merge reads and rewrites the buckets that the new posts fall into and no other.  Every bucket keeps its files in a folder per version;
a small manifest, written last under a rising number, says which version of each bucket counts.  So a merge that
fails half-way changes nothing, readers keep the state they began with, and a lost executor only repeats its tasks.  The number
of buckets is fixed at creation from the bytes of the input.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postcred.schemas import KEY
from postcred.sources.captures import dedup_posts, union_captures

BUCKET_BYTES = 256 << 20


class PostStore:
    """Deduplicated posts under ``path``, one row per key, the latest observation of all merges."""

    def __init__(self, spark: SparkSession, path: str, key=KEY):
        self.spark, self.path, self.key = spark, path.rstrip("/"), tuple(key)

    # ---------------------------------------------------------------- manifests
    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._hadoop(f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        done = []
        for status in fs.listStatus(p):
            child = status.getPath()
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(child, "_SUCCESS")):
                done.append(int(child.getName()))
        return sorted(done)

    def manifest(self, number: int | None = None) -> dict:
        """The newest complete manifest, or that of a given number."""
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no landed posts under {self.path}")
        number = numbers[-1] if number is None else number
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{number:08d}").first()["value"])

    def _publish(self, manifest: dict) -> None:
        df = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        df.coalesce(1).write.text(f"{self.path}/manifests/{manifest['number']:08d}")

    # ------------------------------------------------------------------- tables
    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/data/version={version}/bucket={bucket}"

    def exists(self) -> bool:
        return bool(self._numbers())

    def create(self, posts: DataFrame, input_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> dict:
        """Land the first posts; about one bucket per ``bucket_bytes`` of input."""
        if self.exists():
            raise FileExistsError(self.path)
        n = max(1, -(-int(input_bytes) // bucket_bytes))
        manifest = {"number": 1, "buckets": n, "versions": {}, "schema": dedup_posts(posts, self.key).schema.json()}
        return self._write(dedup_posts(posts, self.key), manifest)

    def merge(self, posts: DataFrame) -> dict:
        """Merge further observations; only the buckets they fall into are read and written anew."""
        old = self.manifest()
        new = dedup_posts(posts, self.key).withColumn("bucket", self._bucket(old["buckets"]))
        staged = f"{self.path}/staged/{old['number'] + 1:08d}"
        new.write.mode("overwrite").parquet(staged)
        new = self.spark.read.schema(new.schema).parquet(staged)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most one row per bucket
        held = [self._folder(b, old["versions"][str(b)]) for b in touched if str(b) in old["versions"]]
        merged = new.drop("bucket")
        if held:
            merged = dedup_posts(union_captures(self._read(held, old), merged), self.key)
        return self._write(merged, {**old, "number": old["number"] + 1, "versions": dict(old["versions"])})

    def _write(self, rows: DataFrame, manifest: dict) -> dict:
        number = manifest["number"]
        target = f"{self.path}/data/version={number}"
        n = manifest["buckets"]
        (rows.withColumn("bucket", self._bucket(n)).repartition(n, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target))
        p, fs = self._hadoop(target)
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if name.startswith("bucket="):
                manifest["versions"][name.removeprefix("bucket=")] = number
        self._publish(manifest)
        return manifest

    def _read(self, folders: list[str], manifest: dict) -> DataFrame:
        from pyspark.sql.types import StructType
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, number: int | None = None) -> DataFrame:
        """The posts as of a manifest (the newest by default)."""
        m = self.manifest(number)
        return self._read([self._folder(int(b), v) for b, v in sorted(m["versions"].items())], m)
