"""Versioned tables on any file system that Spark reads.

A table is a set of files by bucket, a hash of its key.  A commit writes files for what it changes (whole tables, some buckets
or rows to add) and then one small manifest, whose name holds its number and which only one writer can make.  Readers take the
largest manifest once and see one consistent state.

Accesses are added as small rows of ``touches``; reading memories folds them in, and writing a bucket of memories settles them.
A manifest also holds marks: how far each stream has been taken in, published with what was taken in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.schema import SCHEMA_VERSION, TABLES, StorageError

#: Version 1 had one folder a table and no buckets, marks or touches; from version n to n + 1, a manifest to a manifest.
MIGRATIONS: dict[int, Callable[[dict], dict]] = {1: lambda m: m | {"buckets": 1, "marks": {}, "tables": {k: {"0": [v]} for k, v in m["tables"].items()}}}
#: Key columns: what decides on the bucket, and what must be unique.
KEYS = {"memories": "id", "context_tags": "memory_id", "touches": "id"}
UNIQUE = {"memories": ["id"], "context_tags": ["id"], "edges": ["source_id", "target_id", "relation"], "consolidate_log": ["id"]}
Change = Callable[[DataFrame], DataFrame]


class Store:
    """buckets: of a new store; an old one keeps its own number.  A bucket is what the smallest change to a memory rewrites."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # --- manifests ---

    def versions(self) -> list[int]:
        """The numbers of all manifests."""
        folder = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The number of the newest manifest, 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"schema_version": SCHEMA_VERSION, "buckets": self._buckets, "marks": {}, "tables": {}}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict, base: int) -> int:
        """Makes the manifest base + 1, or raises if there is one: a hard link locally, elsewhere a rename that never replaces."""
        jvm, name = self.spark.sparkContext._jvm, f"{self.path}/manifests/{base + 1}.json"
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        draft, final = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._path(name)
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        try:
            if self._fs.getScheme() == "file":
                jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, draft)])
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, none)
        except Exception as e:
            if self._fs.exists(final):
                raise StorageError(f"version {base} is no longer the newest") from e
            raise
        finally:
            self._fs.delete(draft, False)
        return base + 1

    # --- reading ---

    def _read(self, manifest: dict, name: str, buckets: list[str] | None = None) -> DataFrame:
        parts = manifest["tables"].get(name, {})
        paths = [f"{self.path}/{p}" for b in sorted(parts if buckets is None else set(buckets) & set(parts), key=int) for p in parts[b]]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _state(self, manifest: dict, name: str, buckets: list[str] | None = None) -> DataFrame:
        rows = self._read(manifest, name, buckets)
        touched = manifest["tables"].get("touches", {})
        if name != "memories" or not any(touched.get(b) for b in (touched if buckets is None else buckets)):
            return rows
        new = self._read(manifest, "touches", buckets).groupBy("id").agg(F.max("accessed_at").alias("_t"), F.sum("n").alias("_n"))
        folded = {"accessed_at": F.greatest("accessed_at", "_t"), "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0))}
        return rows.join(new, "id", "left").select(*[folded.get(c, F.col(c)).alias(c) for c in rows.columns])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table at a version (the newest); empty with its schema if it was never written."""
        return self._state(self.manifest(version), name)

    def mark(self, stream: str, version: int | None = None) -> int:
        """The number of the last batch of a stream that was taken in; -1 before the first."""
        return self.manifest(version)["marks"].get(stream, -1)

    def listing(self, version: int | None = None) -> DataFrame:
        """table, bucket, files: what a version consists of."""
        rows = [(t, int(b), len(p)) for t, parts in self.manifest(version)["tables"].items() for b, p in parts.items()]
        return self.spark.createDataFrame(rows, "table string, bucket int, files int")

    # --- writing ---

    def _bucket(self, manifest: dict, name: str, key: str | None = None) -> Column:
        n = manifest["buckets"] if name in KEYS else 1
        return F.pmod(F.xxhash64(key or KEYS[name]), F.lit(n)).cast("int") if n > 1 else F.lit(0)

    def _write(self, manifest: dict, name: str, df: DataFrame) -> dict[str, list[str]]:
        at = f"tables/{name}/{uuid.uuid4().hex}"
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]).withColumn("_b", self._bucket(manifest, name))
        (df.hint("rebalance", "_b") if name in KEYS else df).write.partitionBy("_b").parquet(f"{self.path}/{at}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{at}"))]
        return {n[3:]: [f"{at}/{n}"] for n in names if n.startswith("_b=")}

    def commit(
        self, tables: dict[str, DataFrame], base: int, log: DataFrame | None = None, *, add: dict[str, DataFrame] | None = None,
        change: dict[str, tuple[DataFrame, Change]] | None = None, marks: dict[str, int] | None = None,
    ) -> int:
        """Publishes a new state on top of version ``base``; StorageError if that is no longer the newest.

        tables: new states of whole tables.  add: rows to add, whose keys the caller knows to be new.  change: (keys, function)
        of bucketed tables; only buckets with these keys (the column is named as the table's key) are read, changed and written.
        Unique keys are checked on what was written, before it is published.
        """
        manifest = self.manifest(base)
        if manifest["schema_version"] != SCHEMA_VERSION:
            raise StorageError(f"schema version {manifest['schema_version']}: migrate first")
        state = {t: dict(p) for t, p in manifest["tables"].items()}
        for name, df in tables.items():
            state[name] = self._write(manifest, name, df)
            self._check(name, state[name])
            if name == "memories":
                state["touches"] = {}
        for name, (keys, function) in (change or {}).items():
            hit = [str(r[0]) for r in keys.select(self._bucket(manifest, name).alias("b")).distinct().collect()]
            parts = self._write(manifest, name, function(self._state(manifest, name, hit)))
            self._check(name, parts)
            state[name] = {b: p for b, p in state.get(name, {}).items() if b not in hit} | parts
            if name == "memories":
                state["touches"] = {b: p for b, p in state.get("touches", {}).items() if b not in hit}
        for name, df in (add or {}).items() if log is None else [*(add or {}).items(), ("consolidate_log", log)]:
            parts = self._write(manifest, name, df)
            self._check(name, parts)
            old = state.get(name, {})
            state[name] = old | {b: [*old.get(b, []), *p] for b, p in parts.items()}
        return self._publish(manifest | {"tables": state, "marks": manifest["marks"] | (marks or {})}, base)

    def _check(self, name: str, parts: dict[str, list[str]]) -> None:
        df = self._read({"tables": {name: parts}}, name)
        if name in UNIQUE and not df.groupBy(*UNIQUE[name]).count().filter("count > 1").isEmpty():
            raise StorageError(f"{name}: {', '.join(UNIQUE[name])} must be unique")

    def migrate(self) -> int:
        """Brings a store written under an older schema version up to date; files stay as they are."""
        base = self.version()
        manifest = self.manifest(base)
        if manifest["schema_version"] > SCHEMA_VERSION:
            raise StorageError(f"schema version {manifest['schema_version']} is newer than {SCHEMA_VERSION}")
        if not base or manifest["schema_version"] == SCHEMA_VERSION:
            return base
        for v in range(manifest["schema_version"], SCHEMA_VERSION):
            manifest = MIGRATIONS[v](manifest) | {"schema_version": v + 1}
        return self._publish(manifest, base)
