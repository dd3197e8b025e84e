"""Sources: tables, queries, user functions, increments, child rows and verified snapshots."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import effective_modified
from ..operators.predicates import predicate


class SourceError(RuntimeError):
    pass


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple | None = None, partitions: int = 8, **options) -> DataFrame:
    """A database table, read in ranges of a numeric, date or time column if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])).option("numPartitions", partitions)
    return reader.load()


def jdbc_query(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def scan(df: DataFrame, columns: list[str] | None = None, filters=None, any_of=None) -> DataFrame:
    """Rows that meet the filters, with the columns needed; both reach the storage."""
    out = df.where(predicate(filters, any_of))
    return out.select(*columns) if columns else out


def user_source(function: Callable[[SparkSession, dict], DataFrame], spark: SparkSession, parameters: dict, required: list[str]) -> DataFrame:
    out = function(spark, parameters)
    if lack := [c for c in required if c not in out.columns]:
        raise SourceError(f"the source lacks {', '.join(lack)}")
    return out


def query_source(spark: SparkSession, text: str, parameters: dict, views: dict[str, DataFrame]) -> DataFrame:
    """A SQL text with named parameters over named tables; an undefined name is an error."""
    if not text.strip():
        raise SourceError("the query is empty")
    return spark.sql(text, args=parameters, **views) if views else spark.sql(text, args=parameters)


def columns_of(source: DataFrame) -> DataFrame:
    """(column, type) of a table or query, from its schema alone: no row is read."""
    return source.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in source.schema.fields], "column string, type string")


def jdbc_columns(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """columns_of a query that a database answers with no row."""
    return columns_of(jdbc_query(spark, url, f"SELECT * FROM ({query}) q WHERE 1 = 0", **options))


def catalog_tables(spark: SparkSession, schema: str, contains: str) -> dict[str, DataFrame]:
    """Tables of a schema of the session's catalog (its name in any case) whose name contains a text, in any case."""
    names = [d.name for d in spark.catalog.listDatabases() if d.name.lower() == schema.lower()]
    found = {f"{n}.{t.name}": spark.table(f"`{n}`.`{t.name}`") for n in names for t in spark.catalog.listTables(n) if contains.lower() in t.name.lower()}
    if not found:
        raise SourceError(f"no table of {schema} has {contains} in its name")
    return found


def union_tables(tables: dict[str, DataFrame], contains: str) -> DataFrame:
    """All tables whose name contains a text, in any case, as one; table says which."""
    hits = [df.withColumn("table", F.lit(n)) for n, df in sorted(tables.items()) if contains.lower() in n.lower()]
    if not hits:
        raise SourceError(f"no table has {contains} in its name")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), hits)


def transformed(source: DataFrame, rule: Callable[[DataFrame], DataFrame], required: list[str]) -> DataFrame:
    """What a user's rule makes of the rows of a source; it must have the columns required."""
    out = rule(source)
    if lack := [c for c in required if c not in out.columns]:
        raise SourceError(f"the rule's rows lack {', '.join(lack)}")
    return out


def tracked(lookups: dict[str, DataFrame]) -> dict[str, dict]:
    """What tells whether tables that user code looks into have changed: a digest of each."""
    return {name: digest(df).first().asDict() for name, df in lookups.items()}


def changed_lookups(before: dict[str, dict], lookups: dict[str, DataFrame]) -> list[str]:
    """Tables that have changed since tracked() looked; a run that used them is to be planned anew."""
    now = tracked(lookups)
    return sorted(n for n in before.keys() | now.keys() if before.get(n) != now.get(n))


def increment(df: DataFrame, modified: str, creation: str | None, watermark: Column | None, assumed: str | None = None, target: str | None = None) -> DataFrame:
    """Rows whose effective stamp is at the watermark or later. The plain comparison before the exact test reaches the storage."""
    if watermark is None:
        return df
    made = F.col(creation) if creation else F.lit(None).cast("string")
    out = df
    kinds = dict(df.dtypes)
    if kinds[modified].startswith("timestamp") and not (assumed and target):
        near = F.col(modified) >= watermark
        out = df.where(near | (F.col(creation) >= watermark)) if creation else df.where(near)
    return out.where(effective_modified(F.col(modified), made, assumed, target) >= watermark)


def grouped(rows: DataFrame, keys: list[str], sums: dict[str, tuple[str, str]], count: str) -> DataFrame:
    """A record for each key of source rows: how many there are, and exact sums (name: column and the decimal type that its values have)."""
    totals = [F.sum(F.col(c).cast(kind)).cast("decimal(38," + kind.rstrip(")").split(",")[1] + ")").alias(name) for name, (c, kind) in sums.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias(count), *totals)


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, position: str, name: str, fields: list[str]) -> DataFrame:
    """Each parent with its child rows in order of position; an empty list if it has none."""
    rows = children.groupBy(F.col(child_key).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(position, *[f for f in fields if f != position]))).alias(name))
    out = parents.join(rows, F.col(parent_key) == F.col("_parent"), "left").drop("_parent")
    return out.withColumn(name, F.coalesce(name, F.array().cast(dict(rows.dtypes)[name])))


def row_hash(df: DataFrame) -> Column:
    """60 bits of MD5 of a row's values as text, in order of their names, which other systems can give too; null is not the same as empty."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(df.columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


MARKS = ("n_rows", "xored", "summed")


def _marks(h: Column) -> list[Column]:
    return [F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xored"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("summed")]


def digest(df: DataFrame) -> DataFrame:
    """One row that tells whether contents are equal, in whatever order: number of rows and two combined hashes."""
    return df.agg(*_marks(row_hash(df)))


# ranges of a key

#: Ranges of a digest tree, and nodes of one level that make one of the next.
RANGES, FAN = 256, 16


def bounds_of(df: DataFrame, key: str, ranges: int = RANGES, rows: int = 20_000) -> list:
    """Where ranges of about equal rows begin, but for the first: from keys drawn by hash, so many rows at most."""
    drawn = df.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(rows).distinct().collect()
    values = sorted(r[0] for r in drawn)
    return sorted({values[len(values) * k // ranges] for k in range(1, ranges)} - {values[0]}) if values else []


def range_of(key: Column, bounds: list) -> Column:
    """The number of a key's range: how many bounds are at or below it; a null key is in the first."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)), F.lit(0)) if bounds else F.lit(0)


def in_ranges(key: Column, bounds: list, wanted: list[int]) -> Column:
    """A condition that the storage can use: whether a key is in one of these ranges."""
    edges = [None, *bounds, None]
    out = F.lit(False)
    for k in wanted:
        low, high = edges[k], edges[k + 1]
        one = (F.lit(True) if low is None else key >= low) & (F.lit(True) if high is None else key < high)
        out = out | (one | key.isNull() if k == 0 else one)
    return out


def range_digests(df: DataFrame, key: str, bounds: list) -> DataFrame:
    """digest of each range that has rows: (range, n_rows, xored, summed)."""
    return df.withColumn("_h", row_hash(df)).groupBy(range_of(F.col(key), bounds).alias("range")).agg(*_marks(F.col("_h")))


def digest_tree(leaves: DataFrame, ranges: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(level, node) and digest of all nodes above ranges, the root last: FAN of them make one. Its size is that of the number of ranges."""
    level = {r["range"]: tuple(r[m] for m in MARKS) for r in leaves.collect()}  # a row for each range
    tree, k, width = {}, 0, ranges
    while True:
        tree |= {(k, node): mark for node, mark in level.items()}
        if width <= 1:
            return tree
        up: dict[int, tuple[int, int, int]] = {}
        for node, (n, x, s) in level.items():
            m, y, t = up.get(node // FAN, (0, 0, 0))
            up[node // FAN] = (n + m, x ^ y, s + t)
        level, k, width = up, k + 1, -(-width // FAN)


def moved_ranges(one: dict, other: dict, ranges: int) -> list[int]:
    """Ranges in which two trees differ, looked for only below nodes that do."""
    top, width = 0, ranges
    while width > 1:
        top, width = top + 1, -(-width // FAN)
    open_ = [0]
    for level in range(top, -1, -1):
        differ = [n for n in open_ if one.get((level, n)) != other.get((level, n))]
        open_ = differ if level == 0 else [c for n in differ for c in range(n * FAN, (n + 1) * FAN)]
    return [n for n in open_ if n < ranges]


def snapshot_in_ranges(read: Callable[[Column | None], DataFrame], folder: str, key: str, bounds: list, tries: int = 3) -> tuple[DataFrame, dict]:
    """A verified snapshot (see snapshot) of a source that may move: only ranges of its key that differ between two reads are read again.

    read gets a condition on the key, or None for all rows, which the source is to apply itself. Each range's rows are files of their
    own. The manifest names the files and has the digest tree.
    """
    ranges = len(bounds) + 1

    def stage(rows: DataFrame) -> str:
        path = f"{folder}/{uuid.uuid4().hex}"
        rows.withColumn("_range", range_of(F.col(key), bounds)).repartition("_range").write.partitionBy("_range").parquet(path)
        return path

    def staged() -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [spark.read.schema(kinds).parquet(p).where(F.col("_range").isin(mine)).drop("_range") for p, mine in held.items()])

    source = read(None)
    spark, columns = source.sparkSession, source.columns
    kinds = spark.createDataFrame([], source.schema).withColumn("_range", F.lit(0)).schema
    held: dict[str, list[int]] = {stage(source): list(range(ranges))}
    tree = digest_tree(range_digests(staged(), key, bounds), ranges)
    seen = digest_tree(range_digests(read(None).select(columns), key, bounds), ranges)
    for _ in range(tries):
        moved = moved_ranges(tree, seen, ranges)
        if not moved:
            return staged(), {"paths": held, "tree": {f"{k}/{n}": m for (k, n), m in tree.items()}, **dict(zip(MARKS, tree.get((max(k for k, _ in tree), 0), (0, 0, 0)) if tree else (0, 0, 0)))}
        again = stage(read(in_ranges(F.col(key), bounds, moved)).select(columns))
        held = {p: [k for k in mine if k not in moved] for p, mine in held.items()} | {again: moved}
        tree = digest_tree(range_digests(staged(), key, bounds), ranges)
        news = digest_tree(range_digests(read(in_ranges(F.col(key), bounds, moved)).select(columns), key, bounds), ranges)
        leaves = {n: m for (k, n), m in tree.items() if k == 0 and n not in moved} | {n: m for (k, n), m in news.items() if k == 0}
        seen = digest_tree(spark.createDataFrame([(n, *m) for n, m in leaves.items()], "range int, n_rows long, xored long, summed long"), ranges)
    raise SourceError("the source keeps changing while it is read")


# ranges of a database's keys


def _sql_value(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S.%f}'"
    return f"DATE '{v:%Y-%m-%d}'" if isinstance(v, dt.date) else str(v)


def _at_least(keys: list[str], bound: tuple) -> str:
    """In order of the keys at the bound or beyond it."""
    parts = []
    for i, k in enumerate(keys):
        same = [f"{c} = {_sql_value(v)}" for c, v in zip(keys[:i], bound)]
        parts.append(" AND ".join([*same, f"{k} {'>=' if i == len(keys) - 1 else '>'} {_sql_value(bound[i])}"]))
    return "(" + " OR ".join(f"({p})" for p in parts) + ")"


def range_predicates(keys: list[str], bounds: list[tuple]) -> list[str]:
    """SQL conditions that deal rows by bounds in the database's order of the keys: each row meets one of them, those of a null key the last."""
    there = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    null = " OR ".join(f"{k} IS NULL" for k in keys)
    edges = [_at_least(keys, b) for b in bounds]
    out = [" AND ".join([there, *([edges[k - 1]] if k else []), *([f"NOT {edges[k]}"] if k < len(edges) else [])]) for k in range(len(edges) + 1)]
    return [*out, null]


def jdbc_ranges(spark: SparkSession, url: str, table: str, keys: list[str], partitions: int = 8, rows: int = 10_000, **options) -> DataFrame:
    """A database table, read in ranges of its keys, several or texts too, of about equal rows.

    Bounds are quantiles of keys drawn by hash, so many rows at most; the database itself puts the bounds in order, so that its
    collation, not Spark's, decides what lies between two of them.
    """
    names = jdbc_query(spark, url, f"SELECT {', '.join(keys)} FROM {table}", **options)
    drawn = names.dropna().orderBy(F.xxhash64(*names.columns), *names.columns).limit(rows).distinct().collect()
    values = sorted(tuple(r) for r in drawn)
    picked = sorted({values[len(values) * k // partitions] for k in range(1, partitions)}) if values else []
    if picked:
        same = " OR ".join("(" + " AND ".join(f"{k} = {_sql_value(v)}" for k, v in zip(keys, b)) + ")" for b in picked)
        order = jdbc_query(spark, url, f"SELECT r.*, ROW_NUMBER() OVER () AS RANK_ FROM (SELECT DISTINCT {', '.join(keys)} FROM {table} WHERE {same} ORDER BY {', '.join(keys)}) r", **options)
        picked = [tuple(r)[:-1] for r in sorted(order.collect(), key=lambda r: r[-1])]
    return spark.read.jdbc(url, table, predicates=range_predicates(keys, picked), properties={k: str(v) for k, v in options.items()})


def snapshot(read: Callable[[], DataFrame], folder: str, origin: dict[str, str] | None = None, tries: int = 3) -> tuple[DataFrame, dict]:
    """The source as staged files whose digest a second read of it confirms; it is read again if it has moved."""
    for _ in range(tries):
        path = f"{folder}/{uuid.uuid4().hex}"
        source = read()
        source.write.parquet(path)
        staged = source.sparkSession.read.parquet(path)
        mark = digest(staged).first().asDict()
        if digest(read().select(staged.columns)).first().asDict() == mark:
            return staged, {"path": path, **mark, **(origin or {})}
    raise SourceError("the source keeps changing while it is read")


def made_from(definition: str, connection: str, query: str) -> dict[str, str]:
    """What a snapshot's manifest says about its origin; only hashes are kept, as a connection may hold secrets."""
    return {k: hashlib.sha256(v.encode()).hexdigest() for k, v in (("definition", definition), ("connection", connection), ("query", query))}


def reusable(spark: SparkSession, manifest: dict | None, wanted: dict[str, str]) -> DataFrame | None:
    """A snapshot that an earlier run left, if it was made from the same definition, connection and query (see made_from) and its files are whole."""
    if lack := {"definition", "connection", "query"} - wanted.keys():
        raise SourceError(f"a snapshot is asked for without its {', '.join(sorted(lack))}")
    if not manifest or any(manifest.get(k) != v for k, v in wanted.items()):
        return None
    staged = spark.read.parquet(manifest["path"])
    return staged if digest(staged).first().asDict() == {k: manifest[k] for k in ("n_rows", "xored", "summed")} else None


def emission_faults(records: DataFrame, key: str, aliases: str | None = None) -> DataFrame:
    """(name, n): keys emitted more than once, counting aliases as names too."""
    names = records.select(F.col(key).alias("name"))
    if aliases:
        names = names.unionByName(records.select(F.explode(aliases).alias("name")))
    return names.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
