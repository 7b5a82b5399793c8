"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_MADE: ContextVar[list | None] = ContextVar("made", default=None)
SAMPLE_BITS = 62
#: Rows of a key that one task meets when a large row is fetched for them.
EACH = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Unset on a local master (tests), a temporary folder takes its place; unset on a cluster is an error, since a
    machine-local folder would not be seen by the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="engram-")
    return _LOCAL[app]


@contextmanager
def owned():
    """Ends all workspaces that are made inside, as it ends: what was made of them must be written by then."""
    made: list[Workspace] = []
    outer = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(outer)
        for ws in made:
            ws.end()


class Workspace:
    """Tables of one run of an operator, each cut off from its lineage by a write that outlives any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if (made := _MADE.get()) is not None:
            made.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table that joins and groups by ``key`` need not shuffle again."""
        parts, table = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"engram_{uuid.uuid4().hex}"
        df.repartition(parts, key).write.bucketBy(parts, key).option("path", f"{self.path}/{name}").saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay, and what is read of them here knows its buckets
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def release(self) -> None:
        """Has the driver collect what finished jobs left; between the parts of an operator of many jobs.

        Their plans and metrics otherwise fill the driver's heap up to its limit, however little of it is in use, and the shuffle
        files and broadcasts that Spark's cleaner ties to them stay on the executors.
        """
        self.spark.sparkContext._jvm.System.gc()

    def end(self) -> None:
        """Removes all tables; for when nothing lazy reads them any more."""
        self._delete(self.path)

    def _delete(self, place: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sample_threshold(rows: int, max_rows: int) -> int:
    """Hashes of SAMPLE_BITS bits below this belong to a sample of about ``max_rows`` of ``rows`` rows."""
    return min(1 << SAMPLE_BITS, (max_rows << SAMPLE_BITS) // max(1, rows))


def bounded_sample(rows: DataFrame, max_rows: int, seed: int, *key: str) -> DataFrame:
    """About ``max_rows`` of the rows (all, if there are no more), chosen by hash of ``key``; never none of some."""
    n = rows.count()
    if n <= max_rows:
        return rows
    picked = rows.filter(F.xxhash64(*key, F.lit(seed)).bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1)) < F.lit(sample_threshold(n, max_rows)))
    if picked.isEmpty():
        raise ValueError(f"a sample of {max_rows} of {n} labelled rows is empty")
    return picked


def attach_min(df: DataFrame, key: str, value: str, mins: dict[str, Column], salts: int | None = None) -> DataFrame:
    """Adds to each row the minimum of each of ``mins`` over the rows of its key, and ``group_rows``.

    Keys that no two rows share get nulls and ``group_rows`` null.
    """
    return attach(df, key, value, mins, F.min, salts, 2)


def attach(df: DataFrame, key: str, value: str, mins: dict[str, Column], how, salts: int | None = None, least: int = 1) -> DataFrame:
    """Adds to each row ``how`` (F.min, F.sum) of each expression over the rows of its key, and ``group_rows``.

    A key may hold any share of the rows: rows are dealt by key and a salt from ``value``, taken together by salt first, and
    the result goes back by salt.  There are as many salts as shuffle partitions (32 at least), so a key that holds all rows
    gives a task no more than its share.  Keys of fewer than ``least`` rows, and null keys, get nulls.
    """
    salts = salts or max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    part = df.filter(F.col(key).isNotNull()).groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"), *[how(c).alias(k) for k, c in mins.items()])
    whole = part.groupBy(key).agg(F.sum("_n").alias("group_rows"), F.collect_list("_salt").alias("_salts"), *[how(k).alias(k) for k in mins])
    whole = whole.filter(F.col("group_rows") >= least).withColumn("_salt", F.explode("_salts")).drop("_salts")
    return df.join(whole, [key, "_salt"], "left").drop("_salt")


def dealt(ws: Workspace, pairs: DataFrame, name: str, *keys: str, each: int | None = None) -> DataFrame:
    """pairs, written, with a salt for each of two key columns, by which ``fetched`` brings a large row to them.

    A key may stand in any share of the pairs: its pairs are dealt by the hash of the other key, about ``each`` (EACH) to a salt.
    """
    df = ws.table(pairs, f"{name}-bare")
    for key, other in (keys, keys[::-1]):
        df = attach(df, key, other, {}, F.min).withColumn(f"_of_{key}", F.ceil(F.col("group_rows") / (each or EACH)).cast("int"))
        df = df.drop("group_rows").withColumn(f"_s_{key}", F.pmod(F.xxhash64(other), F.col(f"_of_{key}")).cast("int"))
    return ws.table(df, f"{name}-dealt")


def fetched(rows: DataFrame, pairs: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows (made from ``pairs``, of dealt()) with the columns of the row of ``table`` that has the same ``key``; inner join.

    The table's row is copied once a salt; keys with few pairs have one.
    """
    needed = pairs.groupBy(key).agg(F.max(f"_of_{key}").alias("_of")).join(table, key)
    needed = needed.withColumn(f"_s_{key}", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).drop("_of")
    return rows.join(needed, [key, f"_s_{key}"]).drop(f"_s_{key}", f"_of_{key}")


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(id, component): for each id of the edge list (a, b), the smallest id that it reaches.

    Alternates large-star and small-star steps, each written to the shared folder, until no edge changes; a hub's edges are
    dealt by salt, and its neighbours are never collected.
    """
    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = ws.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    i, last = 0, state(now)
    changed = last[0] > 0
    while changed:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = attach(both, "u", "v", {"m": F.col("v")}, F.min)
        large = low.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low2 = attach(large, "u", "v", {"m": F.col("v")}, F.min)
        small = low2.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        i += 1
        after = ws.table(small, f"{name}-{i}")
        ws.drop(f"{name}-{i - 1}")
        before, now, last = last, after, state(after)
        changed = last != before
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
