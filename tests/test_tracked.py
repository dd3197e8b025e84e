"""Decisions over a stream, in order of stamps, with a restart from the checkpoint; and the same rows as batches give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from concord.plans import state
from concord.streaming import tracked

NEWS = "record_key string, fingerprint string, removed boolean, stamp timestamp"
START = dt.datetime(2026, 3, 1)


def test_rows_out_of_order_are_decided_in_order(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, r.choice("12"), r.random() < 0.3, START + dt.timedelta(minutes=m)) for m, k in enumerate(r.choice("abc") for _ in range(40))]
    end = ("end", "0", False, START + dt.timedelta(days=1))
    parts = [rows[k : k + 10] for k in range(0, 40, 10)]
    for p in parts:
        r.shuffle(p)
    parts[1].append(parts[0][0])  # comes twice, and the second time late or waiting
    query = lambda: tracked.tracked_stream(spark.readStream.schema(NEWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "30 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
    for k, some in enumerate([parts[:2], [*parts[2:], [end]], [[("end", "1", False, START + dt.timedelta(days=2))]]]):  # three starts of one query
        for p in some:
            spark.createDataFrame(p, NEWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query()
    got = spark.read.parquet(f"{tmp_path}/out").where("record_key <> 'end' and decision <> 'late'")
    per_key = {}
    for x in got.orderBy("stamp").collect():
        per_key.setdefault(x.record_key, []).append((x.decision, x.revision, list(x.documents)))
    want = {}
    for k in "abc":
        held = (None, 0, [])
        for _, fingerprint, removed, _ in sorted((x for x in rows if x[0] == k), key=lambda x: x[3]):
            decision, held = tracked.decided(k, held, fingerprint, removed)
            want.setdefault(k, []).append((decision, held[1], held[2]))
    assert per_key == want


def test_one_version_as_in_a_batch(spark):
    known = spark.createDataFrame([("a", "1", 3, ["a-3"], None, None), ("b", "1", 3, [], None, None)], state.StateTable.SCHEMA)
    for key, held in (("a", ("1", 3, ["a-3"])), ("b", ("1", 3, [])), ("c", (None, 0, []))):
        for fingerprint in ("1", "2"):
            for removed in (False, True):
                news = spark.createDataFrame([(key, fingerprint, removed)], "record_key string, fingerprint string, removed boolean")
                done = state.decide(state.prepared(news, known))
                row = state.next_state(done, known).where(F.col("record_key") == key).first()
                decision, after = tracked.decided(key, held, fingerprint, removed)
                assert (done.first().action, row.fingerprint, row.revision, list(row.documents)) == (decision, *after), (key, fingerprint, removed)


def test_many_keys_are_held_in_few_groups(spark, tmp_path):
    """The state store has a row for a group and not for each key, and each key is decided by itself."""
    rows = [(f"k{k}", p, False, START + dt.timedelta(minutes=m)) for k in range(300) for m, p in ((2, "b"), (0, "a"), (1, "a"))]
    end = ("end", "0", False, START + dt.timedelta(days=1))
    for some in (rows[::2], rows[1::2], [end]):
        spark.createDataFrame(some, NEWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = tracked.tracked_stream(spark.readStream.schema(NEWS).parquet(f"{tmp_path}/in"), "30 minutes", 8).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("record_key").agg(F.array_sort(F.collect_list(F.struct("stamp", "decision", "revision"))).alias("r")).collect()
    assert len(got) == 300 and all([(x.decision, x.revision) for x in g.r] == [("create", 1), ("skip", 1), ("replace", 2)] for g in got)
