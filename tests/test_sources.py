"""Digest trees, snapshots of sources that move, and reads in ranges of a key."""

import pytest
from pyspark.sql import functions as F

from concord.operators import sinks
from concord.sources import tables

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def some(spark, n=400):
    return spark.range(n).select(F.when(F.col("id") % 50 != 0, F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0"))).alias("key"), (F.col("id") * 3).alias("v"), F.when(F.col("id") % 7 == 0, "").alias("note"))


def test_digests_tell_null_from_empty_and_order_from_content(spark):
    one = lambda rows: tuple(tables.digest(spark.createDataFrame(rows, "a string, b string")).first())
    assert one([("x", None), ("y", "")]) == one([("y", ""), ("x", None)]) != one([("x", ""), ("y", "")])
    assert one([("x", "y")]) != one([("y", "x")]) and one([]) == (0, 0, 0) and one([("x", "y")] * 2) != one([])


def test_trees_differ_only_where_rows_do(spark):
    df = some(spark)
    bounds = tables.bounds_of(df, "key", 40)
    assert 30 <= len(bounds) <= 39 and bounds == sorted(bounds)
    ranges = len(bounds) + 1
    tree = lambda d: tables.digest_tree(tables.range_digests(d, "key", bounds), ranges)
    one = tree(df)
    sizes = [m[0] for (k, _), m in one.items() if k == 0]
    assert sum(sizes) == 400 and max(sizes) < 3 * 400 / ranges
    assert tables.moved_ranges(one, tree(df.orderBy(F.desc("v"))), ranges) == []
    changed = df.withColumn("v", F.when(F.col("key") == "k00123", -1).otherwise(F.col("v")))
    hit = sum(b <= "k00123" for b in bounds)
    assert tables.moved_ranges(one, tree(changed), ranges) == [hit]
    assert tables.moved_ranges(one, tree(df.where("key is not null")), ranges) == [0]  # null keys are in the first range
    assert sorted(tables.moved_ranges(one, tree(df.where("key < 'k00300' or key is null")), ranges))[-1] == ranges - 1
    assert tables.moved_ranges({}, {}, 1) == []


def test_a_source_that_moves_is_read_again_only_where_it_did(spark, tmp_path):
    df = some(spark)
    bounds = tables.bounds_of(df, "key", 20)
    versions = [df, df.withColumn("v", F.when(F.col("key") == "k00123", -1).otherwise(F.col("v"))).where("key <> 'k00301' or key is null")]
    asked, read_rows = [], []

    def read(condition):
        source = versions[min(len(asked), 1)]  # it moves between the first read and the second
        out = source if condition is None else source.where(condition)
        asked.append(condition is not None)
        read_rows.append(out.count())
        return out

    staged, manifest = tables.snapshot_in_ranges(read, str(tmp_path), "key", bounds)
    want = sorted(map(str, versions[1].collect()))
    assert sorted(map(str, staged.collect())) == want and manifest["n_rows"] == len(want)
    assert asked == [False, False, True, True] and read_rows[0] == 400 and read_rows[1] == 399 and max(read_rows[2:]) < 80  # two ranges of twenty
    still, _ = tables.snapshot_in_ranges(lambda c: df if c is None else df.where(c), str(tmp_path), "key", [])
    assert still.count() == 400
    n = iter(range(100))
    with pytest.raises(tables.SourceError):
        tables.snapshot_in_ranges(lambda c: df.withColumn("v", F.col("v") + next(n)), str(tmp_path), "key", bounds)
    empty, manifest = tables.snapshot_in_ranges(lambda c: df.limit(0), str(tmp_path), "key", bounds)
    assert empty.count() == 0 and manifest["n_rows"] == 0


def test_conditions_of_composite_keys():
    got = tables.range_predicates(["a", "b"], [("x'y", 3)])
    assert got == ["a IS NOT NULL AND b IS NOT NULL AND NOT ((a > 'x''y') OR (a = 'x''y' AND b >= 3))", "a IS NOT NULL AND b IS NOT NULL AND ((a > 'x''y') OR (a = 'x''y' AND b >= 3))", "a IS NULL OR b IS NULL"]
    assert tables.range_predicates(["a"], []) == ["a IS NOT NULL", "a IS NULL"]


def test_a_database_is_read_in_ranges_of_texts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(600).select(F.concat(F.lit("it's "), F.lpad((F.col("id") * 37 % 600).cast("string"), 4, "0")).alias("K"), (F.col("id") % 4).cast("int").alias("N"), F.col("id").cast("int").alias("V"))
    rows.write.format("jdbc").option("url", url).option("dbtable", "t").option("createTableColumnTypes", "K VARCHAR(20)").options(**DERBY).save()
    c = sinks.Connection(spark, url, DERBY["driver"])
    assert c.run("UPDATE t SET K = NULL WHERE MOD(V, 100) = 99") == 6
    c.open.close()
    for keys in (["K"], ["K", "N"], ["N", "K"]):
        got = tables.jdbc_ranges(spark, url, "t", keys, partitions=6, **DERBY)
        sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sorted(r.V for r in got.collect()) == list(range(600))
        full = sorted(sizes)[1:]  # without those of a null key
        assert len(full) == 6 and max(full) <= 2 * min(full)
    assert tables.jdbc_ranges(spark, url, "(SELECT * FROM t WHERE V < 0) q", ["K"], **DERBY).count() == 0
