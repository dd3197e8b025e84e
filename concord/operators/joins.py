"""Joins whose keys may be very unequally frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are dealt to several tasks at most, and rows from which on a key is. Beyond the HOT_KEYS most frequent
#: ones no key has more than a HOT_KEYS-th of all rows.
HOT_KEYS, HOT_ROWS = 2000, 1000
#: Short rows that are broadcast at most.
FEW_ROWS = 100_000
#: Rows of a chain of joins by one key that a task gets, about.
TASK_ROWS = 200_000


def in_tasks(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by key to so many tasks that each gets about TASK_ROWS of rows, so that a task's memory does not grow with the input. Left alone where the session's partitions suffice."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def hot_keys(counts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """(on, _parts): the most frequent keys of counts (on, n) and how many parts they are dealt to; HOT_KEYS rows at most."""
    parts = F.least(F.ceil(F.col(n) / HOT_ROWS), F.lit(HOT_KEYS)).cast("int").alias("_parts")
    return counts.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n), *on).limit(HOT_KEYS).select(*on, parts)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], member: list[Column], n: str = "n", how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has one row for each key and in n how many rows of left have it.

    The most frequent keys, HOT_KEYS at most, are dealt by a hash of member to as many parts as they have HOT_ROWS rows
    (HOT_KEYS at most), and right's row is sent to each part: no task gets all of a hot key's rows. Only the names of these keys
    are broadcast; hot gives them if they are known. how may be inner or left; rows of left with a null key, which join with
    nothing, are dealt likewise.
    """
    hot = F.broadcast(hot if hot is not None else hot_keys(right, on, n))
    null = F.lit(False)
    for k in on:
        null = null | F.col(k).isNull()
    many = F.when(null, HOT_KEYS).otherwise(F.coalesce("_parts", F.lit(1)))
    left = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*member), many.cast("long")).cast("int")).drop("_parts")
    right = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def join_kept(left: DataFrame, right: DataFrame, on: list[str], member: list[Column], n: str = "n", how: str = "inner") -> DataFrame:
    """join_hot with a right of short rows that is kept, so that it can be counted: it is broadcast if it has FEW_ROWS at most."""
    if right.count() <= FEW_ROWS:
        return left.join(F.broadcast(right), on, how)
    return join_hot(left, right, on, member, n, how)


def dealt_key(df: DataFrame, key: str) -> Column:
    """A text key for an outer join that keeps df: rows without one get one of HOT_KEYS texts that no other side has, so that they do not all meet in a shuffle's null."""
    columns = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*columns), F.lit(HOT_KEYS)).cast("string")))
