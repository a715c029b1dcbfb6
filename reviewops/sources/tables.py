"""Stored tables that take batches.

Parquet files cannot be changed, so a batch adds files.  A table is a folder;
a commit writes its own rows to ``table_version=<n>/key_bucket=<b>`` there (these
two names are not free for columns).  One manifest per commit, written last
and moved into place, names the live versions of each bucket of all tables, so
a commit is seen whole or not at all and a batch that is replayed adds nothing.

Readers take the last version of each key.  ``compact`` folds the versions of
buckets that have several into one; other buckets are neither read nor
written, and old files stay until ``vacuum``.  Only the manifest is held by
the driver: its size is the number of buckets and open versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewops.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back, so that its readers do not compute it again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Tables:
    """Tables under one folder; ``keys`` names the key columns of a table, tables without take rows only."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], keys: dict[str, list[str]], buckets: int = 64):
        self.spark, self.root, self.schemas, self.keys, self.buckets = spark, root.rstrip("/"), schemas, keys, buckets

    def manifest(self) -> dict:
        """The newest one: version, the last batch, and live versions by table and bucket."""
        fs, p = file_system(self.spark, f"{self.root}/_commits")
        versions = [int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")] if fs.exists(p) else []
        if not versions:
            return {"version": 0, "batch": -1, "live": {}}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, f"{max(versions)}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, tmp = file_system(self.spark, f"{self.root}/_commits/{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = file_system(self.spark, f"{self.root}/_commits/{manifest['version']}.json")[1]
        if fs.exists(final) or not fs.rename(tmp, final):
            raise RuntimeError(f"version {manifest['version']} of {self.root} was written by another job")

    def bucket(self, name: str):
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets)).cast("int") if name in self.keys else F.lit(0)

    def _write(self, name: str, rows: DataFrame, version: int) -> list[int]:
        """Buckets that got rows."""
        path = f"{self.root}/{name}/table_version={version}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name]]).withColumn("key_bucket", self.bucket(name))
        if name in self.keys:
            rows = rows.repartition("key_bucket")
        rows.write.mode("overwrite").partitionBy("key_bucket").parquet(path)
        fs, p = file_system(self.spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("key_bucket="))

    def commit(self, frames: dict[str, DataFrame], batch: int | None = None) -> bool:
        """Add the rows of all frames at once (a keyed frame has each key once); False if ``batch`` was committed before."""
        manifest = self.manifest()
        if batch is not None and batch <= manifest["batch"]:
            return False
        version, live = manifest["version"] + 1, manifest["live"]
        for name, rows in frames.items():
            for b in self._write(name, rows, version):
                live.setdefault(name, {}).setdefault(str(b), []).append(version)
        self._publish({"version": version, "batch": manifest["batch"] if batch is None else batch, "live": live})
        return True

    def read(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """The live rows, the last version of each key (of some buckets only)."""
        live = {int(b): vs for b, vs in self.manifest()["live"].get(name, {}).items() if only is None or int(b) in set(only)}
        cols = [f.name for f in self.schemas[name]]
        parts = [self._files(name, {b: vs for b, vs in live.items() if (len(vs) > 1) == many}, many and name in self.keys) for many in (False, True)]
        return parts[0].select(*cols).unionByName(parts[1].select(*cols))

    def _files(self, name: str, live: dict[int, list[int]], fold: bool) -> DataFrame:
        schema = T.StructType([*self.schemas[name].fields, T.StructField("table_version", T.LongType()), T.StructField("key_bucket", T.IntegerType())])
        paths = [f"{self.root}/{name}/table_version={v}/key_bucket={b}" for b, vs in live.items() for v in vs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        if not fold:
            return rows
        cols, keys = [f.name for f in self.schemas[name]], self.keys[name]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in cols if c not in keys], "table_version"), F.col("table_version")).alias("r"))
        return last.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in cols])

    def compact(self, name: str, versions: int = 1) -> list[int]:
        """Fold the buckets with more than ``versions`` live versions into one each; returns them."""
        manifest = self.manifest()
        buckets = manifest["live"].get(name, {})
        large = [int(b) for b, vs in buckets.items() if len(vs) > versions]
        if not large or name not in self.keys:
            return []
        version = manifest["version"] + 1
        self._write(name, self.read(name, large), version)
        buckets.update({str(b): [version] for b in large})
        self._publish(manifest | {"version": version})
        return sorted(large)

    def merge(self, name: str, source: DataFrame) -> list[int]:
        """I1 on the stored table: only buckets with keys of ``source`` are read and written again; returns them."""
        self.commit({name: source})
        return self.compact(name)

    def vacuum(self) -> int:
        """Delete bucket folders that the newest manifest does not name (no reader may be at work); returns their number."""
        live, gone = self.manifest()["live"], 0
        for name in self.schemas:
            fs, top = file_system(self.spark, f"{self.root}/{name}")
            keep = {f"table_version={v}/key_bucket={b}" for b, vs in live.get(name, {}).items() for v in vs}
            for folder in fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top, "table_version=*/key_bucket=*")) or []:
                path = folder.getPath()
                if f"{path.getParent().getName()}/{path.getName()}" not in keep:
                    gone += bool(fs.delete(path, True))
        return gone
