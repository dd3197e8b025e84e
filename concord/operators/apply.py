"""Writes as new versions of tables: upserts, deletes, id allocation and child rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank
from .matching import last_per_key
from .shared import checkpoint, claim, claims

#: Columns that the storage keeps by itself.
SYSTEM_COLUMNS = ("name", "owner", "creation", "modified", "modified_by", "docstatus", "idx", "_user_tags", "_comments", "_assign", "_liked_by")


def gate(payload: DataFrame, target: DataFrame, keys: list[str], system: tuple[str, ...] = SYSTEM_COLUMNS) -> DataFrame:
    """payload without system columns and those that the target lacks; key columns stay."""
    return payload.select(*[c for c in payload.columns if c in keys or (c in target.columns and c not in system)])


def upsert(target: DataFrame, payload: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """target with payload's rows: columns of the payload are overwritten, others keep their value, new keys are added.

    Of payload rows with one key the last counts. Rows whose key has a null part are ignored.
    """
    own = last_per_key(payload.dropna(subset=keys), keys, list(order)).withColumn("_in", F.lit(True))
    p = own.select(*[F.col(c).alias(f"p_{c}") for c in own.columns])
    on = [F.col(k) == F.col(f"p_{k}") for k in keys]
    both = target.join(p, on, "full_outer")
    hit = F.coalesce("p__in", F.lit(False))
    kinds = dict(target.dtypes)
    return both.select(*[F.when(hit, F.col(f"p_{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in payload.columns else F.col(c) for c in target.columns])


def delete(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), keys, "left_anti").select(target.columns)


def merge_sql(table: str, staged: str, keys: list[str], columns: list[str]) -> str:
    """The statement by which a database applies a staged payload."""
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    rest = [c for c in columns if c not in keys]
    return f"MERGE INTO {table} t USING {staged} s ON {on} WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = s.{c}' for c in rest)} WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join(f's.{c}' for c in columns)})"


def delete_sql(table: str, staged: str, keys: list[str]) -> str:
    """The statement by which a database deletes the rows of staged keys."""
    on = " AND ".join(f"s.{k} = {table}.{k}" for k in keys)
    return f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {staged} s WHERE {on})"


def with_modified(target: DataFrame, written: DataFrame, keys: list[str], column: str) -> DataFrame:
    """target after a write, with the mapped stamp of written rows put over what the storage has set; of rows with one key the latest stamp."""
    stamps = written.dropna(subset=keys).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(column).alias("_stamp"))
    out = target.join(stamps, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    return out.withColumn(column, F.coalesce("_stamp", column)).select(target.columns)


def faulty_keys(payload: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that cannot be addressed, as some key is blank."""
    bad = F.lit(False)
    for k in keys:
        bad = bad | blank(F.col(k))
    return payload.where(bad)


def numbered(df: DataFrame, order: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 in order, with no task that holds them all: ranges are counted, then numbered each by itself.

    The ranges come from a sample, which Spark draws anew for each use, so that rows are kept once with the range they fell into.
    """
    spread = checkpoint(df.repartitionByRange(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part").orderBy(*order)
    counts = spread.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row for each range
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return spread.withColumn("_n", F.row_number().over(local)).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def allocate_ids(new: DataFrame, order: list[str], id_column: str, strategy: str, target: DataFrame | None = None, scope: Column | None = None, start: int | None = None) -> DataFrame:
    """new with ids: payload keeps them, connector_default makes blank ones null, sequence counts from start, max_plus_one from the scope's largest."""
    if strategy == "payload":
        return new
    if strategy == "connector_default":
        return new.withColumn(id_column, F.when(~blank(F.col(id_column)), F.col(id_column)))
    out = numbered(new, order, "_seq")
    if strategy == "sequence":
        return out.withColumn(id_column, F.lit(start) + F.col("_seq") - 1).drop("_seq")
    top = (target.where(scope) if scope is not None else target).agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    return out.join(F.broadcast(top), how="cross").withColumn(id_column, F.col("_top") + F.col("_seq")).drop("_seq", "_top")  # a single row


def reserve_ids(spark: SparkSession, folder: str, name: str, n: int, start: int = 1) -> int:
    """The first of n consecutive ids that no other run gets: a block above the mark that folder keeps under name. What a run reserves and does not use stays unused."""
    while True:
        taken = claims(spark, f"{folder}/{name}")
        k, last = (int(max(taken)), int(taken[max(taken)])) if taken else (0, start - 1)
        if claim(spark, f"{folder}/{name}", f"{k + 1:012d}", str(last + n)):
            return last + 1


def write_back(table: DataFrame, created: DataFrame, key: str, id_column: str) -> DataFrame:
    """table with the ids that created (key, id_column) brings, where they differ."""
    new = created.select(key, F.col(id_column).alias("_new")).where("_new is not null").groupBy(key).agg(F.max("_new").alias("_new"))
    return table.join(new, key, "left").withColumn(id_column, F.coalesce("_new", id_column)).select(table.columns)


def drop_blank_rows(rows: Column, fields: list[str]) -> Column:
    return F.filter(rows, lambda r: F.exists(F.array(*[r[f].cast("string") for f in fields]), lambda v: F.coalesce(v != "", F.lit(False))))


def merge_rows(existing: Column, incoming: Column, fields: list[str], sent: list[str]) -> Column:
    """Child rows by position: sent fields overwrite, others stay, the list grows as needed; blank incoming rows change nothing."""

    def one(old: Column, new: Column) -> Column:
        there = F.exists(F.array(*[new[f].cast("string") for f in sent]), lambda v: F.coalesce(v != "", F.lit(False)))
        return F.struct(*[(F.when(there, new[f]).otherwise(old[f]) if f in sent else old[f]).alias(f) for f in fields])

    kept = F.zip_with(F.coalesce(existing, F.array()), F.coalesce(incoming, F.array()), one)
    return F.filter(kept, lambda r: F.exists(F.array(*[r[f].cast("string") for f in fields]), lambda v: v.isNotNull()))
