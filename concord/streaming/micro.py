"""Micro-batches: rows that arrive are pulled into a keyed table; a batch that comes twice changes nothing."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalars import valid_key
from ..operators.apply import upsert
from ..operators.mapping import key_parts
from ..operators.matching import SEPARATOR, last_per_key, with_key
from ..operators.shared import checkpoint
from ..plans.decide import one_way_plan
from ..plans.execute import apply_plan
from ..plans.runs import audit
from ..plans.spec import Definition, DefinitionError
from ..plans.state import job

POINTERS = "batch long, written long, bucket int, path string"
#: Tasks that the rows of a bucket are dealt to when it is written, where there are rows enough.
SLICES = 4


def dealt(batch: DataFrame) -> DataFrame:
    """A batch, read once and kept in as many parts as the session shuffles to. A file of one row group is read by one task, which would otherwise make all of the batch's normal keys, and again for each use.

    It does not pay where keys are plain columns and rows of one key are combined before they are shuffled, as in pull_stream.
    """
    return checkpoint(batch.repartition(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def merge_batch(target: DataFrame, batch: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """target with the last row of each key of the batch, unless the target's own is later."""
    news = last_per_key(batch.dropna(subset=keys), keys, [stamp])
    held = target.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(stamp).alias("_stamp"))
    late = F.col("_stamp").isNotNull() & (F.col("_stamp") > F.col(stamp))
    fresh = news.join(held, [F.col(k) == F.col(f"_{k}") for k in keys], "left").where(~late).select(news.columns)
    return upsert(target, fresh, keys, [stamp])


class VersionedTable:
    """A table in buckets of its keys. A write makes new files for the buckets it touches and then appends pointers to them.

    A bucket's current files are those of its latest pointer: of the largest batch, and if a batch came twice of its last
    writing. key_of gives the column whose hash decides a row's bucket; rows that can match must agree in it.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, key_of: Callable[[DataFrame], Column], buckets: int = 16):
        self.spark, self.folder, self.schema, self.key_of, self.buckets = spark, folder, schema, key_of, buckets
        spark.createDataFrame([], POINTERS).write.mode("append").parquet(f"{folder}/pointers")

    def bucketed(self, df: DataFrame, slices: int = 1, name: str = "_bucket") -> DataFrame:
        """df with its rows' buckets; of slices, slice n is a part of bucket n % buckets."""
        return df.withColumn(name, F.pmod(F.xxhash64(self.key_of(df)), F.lit(self.buckets * slices)).cast("int"))

    def touched(self, df: DataFrame) -> list[int]:
        """Buckets that rows fall into; as many as there are at most."""
        return sorted(r[0] for r in self.bucketed(df).select("_bucket").distinct().collect())

    def current(self) -> dict[int, str]:
        """A folder for each bucket."""
        last = self.spark.read.schema(POINTERS).parquet(f"{self.folder}/pointers").groupBy("bucket").agg(F.max_by("path", F.struct("batch", "written")).alias("path"))
        return {r.bucket: r.path for r in last.collect()}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        paths = sorted(path for k, path in self.current().items() if buckets is None or k in buckets)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch: int, buckets: list[int] | None = None) -> None:
        """The rows that these buckets, or all, have from now on."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        to = list(range(self.buckets)) if buckets is None else buckets
        schema = self.spark.createDataFrame([], self.schema).schema
        # Spark splits what a rebalanced task would have too much of, and puts together what is little
        rows = self.bucketed(df.select(*schema.names), SLICES, "_slice").hint("rebalance", "_slice")
        rows.withColumn("_bucket", F.col("_slice") % self.buckets).drop("_slice").write.partitionBy("_bucket").parquet(path)
        there = {r[0] for r in self.spark.read.schema(StructType([*schema.fields, StructField("_bucket", IntegerType())])).parquet(path).select("_bucket").distinct().collect()}
        empty = f"{path}/none"
        if set(to) - there:
            self.spark.createDataFrame([], self.schema).coalesce(1).write.parquet(empty)
        rows = [(batch, time.time_ns(), k, f"{path}/_bucket={k}" if k in there else empty) for k in to]
        self.spark.createDataFrame(rows, POINTERS).coalesce(1).write.mode("append").parquet(f"{self.folder}/pointers")

    def unused(self) -> list[str]:
        """Folders of earlier versions that no bucket points to; they can be removed once no reader is left."""
        every = {r.path for r in self.spark.read.schema(POINTERS).parquet(f"{self.folder}/pointers").select("path").distinct().collect()}
        return sorted(every - set(self.current().values()))


def pull_stream(stream: DataFrame, table: VersionedTable, keys: list[str], stamp: str, progress: str, **trigger):
    """Starts a query that merges each micro-batch into the table; by default it ends when all that is there has been read. Only touched buckets are rewritten."""

    def merge(batch: DataFrame, number: int) -> None:
        to = table.touched(batch.dropna(subset=keys))
        if to:
            table.write(merge_batch(table.read(to), batch, keys, stamp), number, to)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start()


def pull_batch(table: VersionedTable, batch: DataFrame, number: int, d: Definition, items: str | None = None) -> None:
    """The pull plan of a batch of remote rows against the local table, applied. items is a folder to which its decisions are appended.

    A batch that comes twice finds its own values in the table, so that its plan is all skipped. A batch is no complete read, so that a
    definition that deletes what is missing is refused; so is one with identities, as the table's buckets are those of match keys.
    """
    if d.delete_missing:
        raise DefinitionError("a batch does not tell what is missing")
    if d.identity:
        raise DefinitionError("rows that match by stored ids do not meet in buckets of match keys")
    batch = dealt(batch)
    to = table.touched(with_key(batch, d.remote_keys).where("key is not null").select(F.col("key").alias("_key")))
    if not to:
        return
    local = table.read(to)
    plan = checkpoint(one_way_plan(local, batch, d, "pull"))
    table.write(apply_plan(local, plan, d, "pull"), number, to)
    if items:
        audit(plan, f"batch-{number}", F.lit(None).cast("timestamp")).write.mode("append").parquet(items)


def keyed_by(names: list[str]) -> Callable[[DataFrame], Column]:
    """For a VersionedTable whose rows match by normalised keys: the match key, also of rows that come with it as _key."""
    return lambda df: F.col("_key") if "_key" in df.columns else F.coalesce(_key(df, names), F.lit(""))


def _key(df: DataFrame, names: list[str]) -> Column:
    parts = key_parts(df, names)
    return F.when(valid_key(parts), F.array_join(parts, SEPARATOR))


def pull_plan_stream(stream: DataFrame, table: VersionedTable, d: Definition, progress: str, items: str | None = None, **trigger):
    """Starts a query that applies the pull plan of each micro-batch; the table's key_of is keyed_by the definition's match fields."""
    return stream.writeStream.foreachBatch(lambda batch, number: pull_batch(table, batch, number, d, items)).option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start()


def state_batch(table: VersionedTable, records: DataFrame, number: int, definition: str, **more) -> DataFrame:
    """One batch of a stateful job over the state that batches before have left; returns the batch's items.

    A batch is no complete read, so records that it lacks are not missing. table's rows are the state, in buckets by record_key.
    """
    names = records.select("record_key")
    if "aliases" in records.columns:
        names = names.unionByName(records.select(F.explode("aliases").alias("record_key")))
    to = table.touched(names)
    known = table.read(to)
    done = job(definition, records, known, log_unchanged=True, **more)
    items = checkpoint(done.items.join(records.select("record_key"), "record_key", "left_semi"))
    table.write(done.state, number, to)
    return items
