"""Writes to what is no Spark table: databases, by staged rows and one transaction, and any other sink, batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .apply import delete_sql, merge_sql

#: Where a database keeps which runs have written to it.
DONE = "written_runs"


class Connection:
    """A database connection of the driver's JVM, for statements about staged rows; rows themselves go from executors."""

    def __init__(self, spark: SparkSession, url: str, driver: str | None = None, user: str | None = None, password: str | None = None):
        if driver:
            spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
        manager = spark._jvm.java.sql.DriverManager
        self.open = manager.getConnection(url, user, password) if user else manager.getConnection(url)

    def run(self, sql: str, *values: str) -> int:
        """Rows changed by a statement."""
        statement = self.open.prepareStatement(sql)
        try:
            for k, v in enumerate(values):
                statement.setString(k + 1, v)
            return statement.executeUpdate()
        finally:
            statement.close()

    def number(self, sql: str, *values: str) -> int:
        statement = self.open.prepareStatement(sql)
        try:
            for k, v in enumerate(values):
                statement.setString(k + 1, v)
            rows = statement.executeQuery()
            rows.next()
            return rows.getInt(1)
        finally:
            statement.close()

    def texts(self, table: str) -> set[str]:
        """The names of a table's text columns, in small letters."""
        found, out = self.open.getMetaData().getColumns(None, None, table.upper(), None), set()
        try:
            while found.next():
                if "CHAR" in found.getString("TYPE_NAME").upper():
                    out.add(found.getString("COLUMN_NAME").lower())
            return out
        finally:
            found.close()

    def has(self, table: str) -> bool:
        found = self.open.getMetaData().getTables(None, None, table.upper(), None)
        try:
            return found.next()
        finally:
            found.close()


def merge_into(upserts: DataFrame | None, url: str, table: str, keys: list[str], run: str, deletes: DataFrame | None = None, driver: str | None = None, user: str | None = None, password: str | None = None) -> tuple[int, int]:
    """Upserts and deletes rows of a database table by keys, all or nothing; (rows merged, rows deleted), zero both if this run has written before.

    Executors write the rows to staging tables, partition by partition. Then the driver merges and deletes in one transaction, which notes the run too: an
    attempt that fails before leaves the table as it was, and one that is repeated finds its note. A task that Spark runs again may stage
    rows twice; only distinct ones are merged. Rows of upserts have keys of their own (the last write of each), and no null in a key. The columns
    merged are those of upserts; others keep their values, and are null in new rows. Staging tables are made anew for each attempt and dropped at its end.
    """
    spark = (upserts if upserts is not None else deletes).sparkSession
    access = {"url": url, **({"driver": driver} if driver else {}), **({"user": user, "password": password} if user else {})}
    connection = Connection(spark, url, driver, user, password)
    staged: list[str] = []
    put: dict[str, str] = {}

    def stage(df: DataFrame, columns: list[str]) -> str:
        """A table of the target's own types for distinct rows; what executors write to has those that Spark gives them."""
        raw, once = (f"stage_{k}_{uuid.uuid4().hex[:12]}" for k in ("raw", "once"))
        connection.run(f"CREATE TABLE {once} AS SELECT {', '.join(columns)} FROM {table} WITH NO DATA")
        staged.append(once)
        df.select(*columns).limit(0).write.format("jdbc").options(**access).option("dbtable", raw).save()
        staged.append(raw)
        df.select(*columns).write.format("jdbc").options(**access).option("dbtable", raw).mode("append").save()
        # Large texts cannot be compared; a value that is too long for the target still fails when it is put into its column.
        texts = connection.texts(once)
        put[once] = f"INSERT INTO {once} SELECT DISTINCT " + ", ".join(f'CAST("{c}" AS VARCHAR(4000))' if c.lower() in texts else f'"{c}"' for c in columns) + f" FROM {raw}"
        return once

    try:
        if not connection.has(DONE):
            connection.run(f"CREATE TABLE {DONE} (run VARCHAR(200) NOT NULL, target VARCHAR(200) NOT NULL, PRIMARY KEY (run, target))")
        wanted = f"SELECT count(*) FROM {DONE} WHERE run = ? AND target = ?"
        if connection.number(wanted, run, table):
            return 0, 0
        news = stage(upserts, upserts.columns) if upserts is not None else None
        gone = stage(deletes, keys) if deletes is not None else None
        connection.open.setAutoCommit(False)
        try:
            connection.run(f"INSERT INTO {DONE} VALUES (?, ?)", run, table)  # of two attempts at once the second fails here
            merged = deleted = 0
            for once, sql in put.items():
                connection.run(sql)
                if once == news:
                    merged = connection.run(merge_sql(table, once, keys, upserts.columns))
                elif once == gone:
                    deleted = connection.run(delete_sql(table, once, keys))
            connection.open.commit()
        except BaseException:
            connection.open.rollback()
            raise
        finally:
            connection.open.setAutoCommit(True)
        return merged, deleted
    finally:
        for name in staged:
            connection.run(f"DROP TABLE {name}")
        connection.open.close()


def put_apart(df: DataFrame, put: Callable[[pd.DataFrame], None], key: str, folder: str, rows: int = 1000) -> DataFrame:
    """Gives df to a sink in batches and returns (key, fault) of the rows that it refuses, each found by itself: a batch that fails is halved until its bad rows stand alone.

    put gets rows and raises if it takes none of them; as tasks may run again, it must stand rows that come twice. What is
    refused is kept in folder, so that the sink is not asked again when the result is read.
    """

    def faults(part: pd.DataFrame) -> Iterator[tuple[object, str]]:
        try:
            put(part)
        except Exception as e:
            if len(part) == 1:
                yield part[key].iloc[0], f"{type(e).__name__}: {e}"
            else:
                half = len(part) // 2
                yield from faults(part.iloc[:half])
                yield from faults(part.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), rows):
                yield pd.DataFrame(faults(batch.iloc[lo : lo + rows]), columns=["key", "fault"])

    schema = f"key {dict(df.dtypes)[key]}, fault string"
    df.mapInPandas(run, schema).write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(schema).parquet(folder).withColumnRenamed("key", key)


def as_errors(plan: DataFrame, faults: DataFrame) -> DataFrame:
    """plan with an error where the sink has refused a record (record_key, fault)."""
    told = faults.groupBy("record_key").agg(F.min("fault").alias("_fault"))
    out = plan.join(told, "record_key", "left")
    bad = F.col("_fault").isNotNull() & F.col("action").isin("created", "updated", "deleted")
    return out.withColumns({"message": F.when(bad, F.col("_fault")).otherwise(F.col("message")), "status": F.when(bad, "error").otherwise(F.col("status")), "action": F.when(bad, "error").otherwise(F.col("action"))}).select(plan.columns)
