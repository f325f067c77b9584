"""What changed between full snapshots of a table.

The index of the last snapshot is a table of keys and 128-bit hashes of the compared values, bucketed by key, so that probing
it with a new snapshot in the same buckets shuffles nothing. A key that is missing there was added, a key of the index that
nobody asked for was removed, a key with another hash was changed. Values are fetched for changed keys only. Then the indexes
are swapped: that of the new snapshot becomes the last one.

`diff_snapshots` runs a whole history through such an index, delivery after delivery; a group that misses a delivery keeps its
entries for the next. `SnapshotIndex` keeps the index in a folder between runs.

Defined results: rows without key, group or snapshot number are left out; of several rows for one key in a
snapshot the last by `latest` holds (nulls lowest, then the greater hash); exact repeats count once; a snapshot
exists if it has any row, even rows without key.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solstrata.session import materialize, work_path

#: Above so many rows a side table is joined by shuffle instead of being sent to every executor.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else as it is. df must be cheap to read."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def value_hash(*columns: Column) -> Column:
    """128-bit hash (a, b) in which a null differs from any value and from its neighbours."""
    parts: list[Column] = []
    for c in columns:
        parts += [c.isNull().cast("int"), F.coalesce(c.cast("string"), F.lit(""))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second half"), *parts, F.hash(*parts)).alias("b"))


def finding_hash() -> Column:
    """Hash of rule, path and severity of a finding; case and blanks of severity and the spelling of paths don't count."""
    path = F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return value_hash(F.col("rule_id"), path, F.lower(F.expr("trim(both ' \\t\\r\\n' from severity)")))


def snapshot_rows(df: DataFrame, group: str, number: str, key: str, hashed: Column, latest: Sequence[str]) -> DataFrame:
    """(group, number, key, hash) with one row per key and snapshot, reduced by partial aggregation."""
    rows = df.where(F.col(group).isNotNull() & F.col(number).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(group).alias("grp"), F.col(number).alias("no"), F.col(key).alias("key"), hashed.alias("hash"), F.struct(*latest).alias("at"))
    return rows.groupBy("grp", "key", "no").agg(F.max(F.struct("at", "hash"))["hash"].alias("hash"))


def snapshot_order(df: DataFrame, group: str, number: str) -> DataFrame:
    """(grp, no, prev_no, next_no): the snapshots of each group and their neighbours among those present."""
    seen = df.where(F.col(group).isNotNull() & F.col(number).isNotNull()).select(F.col(group).alias("grp"), F.col(number).alias("no")).distinct()
    w = Window.partitionBy("grp").orderBy("no")
    return seen.select("grp", "no", F.lag("no").over(w).alias("prev_no"), F.lead("no").over(w).alias("next_no"))


def probe(new: DataFrame, index: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on..., change) from probing `index` (on..., hash) with `new` (on..., hash): added, removed or changed."""
    left = new.select(*on, F.col("hash").alias("new_hash"), F.lit(True).alias("in_new"))
    right = index.select(*on, F.col("hash").alias("old_hash"), F.lit(True).alias("in_old"))
    both = left.join(right, list(on), "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("new_hash") != F.col("old_hash"), "changed")
    return both.select(*on, change.alias("change")).where("change is not null")


def bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """df written to path in buckets of its keys, and read back as a table that knows them; df must be partitioned that way."""
    spark, name = df.sparkSession, f"solstrata_{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *keys)
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)
    return spark.table(name)


def bucket_count(rows: int) -> int:
    """Buckets of about a quarter million rows, at least 8."""
    return max(8, min(16384, -(-rows // 250_000)))


def advance_index(index: DataFrame | None, new: DataFrame, present: DataFrame) -> DataFrame:
    """(grp, key, hash, alive, change): the index (grp, key, hash) after a snapshot (grp, key, hash) of the groups in `present` (grp, is_first).

    A row that was removed is not alive and no longer in the index; change is null for what stayed, for what a group's first
    snapshot has, and for groups that are not present. All three are in the same buckets, so nothing is shuffled.
    """
    on = ["grp", "key"]
    left = new.select(*on, F.col("hash").alias("new_hash"))
    if index is None:
        return left.join(present, "grp").select(*on, F.col("new_hash").alias("hash"), F.lit(True).alias("alive"), F.lit(None).cast("string").alias("change"))
    both = left.join(index.select(*on, F.col("hash").alias("old_hash")), on, "full").join(present, "grp", "left")
    here, in_new, in_old = F.col("is_first").isNotNull(), F.col("new_hash").isNotNull(), F.col("old_hash").isNotNull()
    change = F.when(in_new & ~in_old & ~F.col("is_first"), "added").when(here & in_old & ~in_new, "removed").when(in_new & in_old & (F.col("new_hash") != F.col("old_hash")), "changed")
    return both.select(*on, F.coalesce("new_hash", "old_hash").alias("hash"), (in_new | ~here).alias("alive"), change.alias("change"))


def diff_snapshots(df: DataFrame, group: str, number: str, key: str, hashed: Column, latest: Sequence[str]) -> DataFrame:
    """(grp, no, key, change) for every two snapshots of a group that follow each other; no is the later one's.

    One pass writes all rows in buckets of (group, key), a partition per snapshot number. Then the index of the last snapshots goes
    through the numbers, a job each: probe, and write the index that takes its place together with the changes.
    """
    spark = df.sparkSession
    order = materialize(snapshot_order(df, group, number), "snapshot-order")
    rows = snapshot_rows(df, group, number, key, hashed, latest)
    at, buckets = work_path(spark, "snapshots"), bucket_count(df.select(F.lit(1)).count())
    rows = bucketed(rows.repartition(buckets, "grp", "key").select("grp", "key", "hash", "no"), f"{at}/rows", ["grp", "key"], buckets, ["no"])
    index, out = None, None
    for (no,) in order.select("no").distinct().orderBy("no").toLocalIterator():  # as many as there were deliveries
        present = small_side(order.where(F.col("no") == no).select("grp", F.col("prev_no").isNull().alias("is_first")))
        version = bucketed(advance_index(index, rows.where(F.col("no") == no), present), f"{at}/index-{no}", ["grp", "key"], buckets)
        index = version.where("alive")
        part = version.where("change is not null").select("grp", F.lit(no).cast(order.schema["no"].dataType).alias("no"), "key", "change")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select("grp", "no", "key", F.lit("").alias("change")).limit(0)


def finding_changes(findings: DataFrame) -> DataFrame:
    """(project_root, snapshot_no, fingerprint_id, change) of a table of finding snapshots."""
    changes = diff_snapshots(findings, "project_root", "snapshot_no", "fingerprint_id", finding_hash(), ["suppressed_at", "delivered_at"])
    return changes.select(F.col("grp").alias("project_root"), F.col("no").alias("snapshot_no"), F.col("key").alias("fingerprint_id"), "change")


class SnapshotIndex:
    """The index of the last snapshot, kept in a folder between deliveries.

    Each version is a bucketed table of keys, hash and values in a folder of its own. The version in force is the highest that has a
    file in `commits`, which is made last, in one step, after the changes are written: a run that dies before leaves the old version
    in force, and the delivery can be repeated. Versions before the last one are removed only then.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], compared: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.compared, self.buckets = spark, path.rstrip("/"), list(keys), list(compared), buckets

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        p, fs = self._fs("commits")
        if not fs.exists(p):
            return None
        return max((int(f.getPath().getName()) for f in fs.listStatus(p)), default=None)

    def _commit(self, version: int) -> None:
        p, fs = self._fs(f"commits/{version}")
        fs.create(p, False).close()

    def _forget(self, before: int) -> None:
        p, fs = self._fs("")
        for f in fs.listStatus(p):
            name = f.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) < before:
                fs.delete(f.getPath(), True)

    def _read(self, version: int, like: DataFrame) -> DataFrame:
        name = f"solstrata_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
        clustered = ", ".join(f"`{k}`" for k in self.keys)
        self.spark.sql(f"create table {name} ({columns}) using parquet clustered by ({clustered}) into {self.buckets} buckets location '{self.path}/v{version}'")
        return self.spark.table(name)

    def advance(self, snapshot: DataFrame) -> DataFrame:
        """Take in the next full snapshot; returns (keys..., change, old struct, new struct) against the last one.

        old and new are filled for changed keys only. Of several rows for one key one is kept (the greatest).
        """
        values = self.compared
        rows = snapshot.dropna(subset=self.keys).groupBy(*self.keys).agg(F.max(F.struct(*values)).alias("value"))
        rows = rows.withColumn("hash", value_hash(*[F.col("value")[c] for c in values]))
        last = self.version()
        now = 0 if last is None else last + 1
        new = bucketed(rows.repartition(self.buckets, *self.keys), f"{self.path}/v{now}", self.keys, self.buckets)
        old = self._read(last, new) if last is not None else new.limit(0)
        changes = materialize(probe(new.select(*self.keys, "hash"), old.select(*self.keys, "hash"), self.keys), "snapshot-changes")
        wanted = changes.where("change = 'changed'").select(*self.keys)
        fetched = old.join(wanted, self.keys, "left_semi").select(*self.keys, F.col("value").alias("old"))
        fetched = fetched.join(new.join(wanted, self.keys, "left_semi").select(*self.keys, F.col("value").alias("new")), self.keys)
        out = materialize(changes.join(fetched, self.keys, "left").select(*self.keys, "change", "old", "new"), "snapshot-changes")
        self._commit(now)
        self._forget(now)
        return out
