"""Runs that write: by address, both ways, over databases, states and sinks that fail or are shared."""

import threading

import pytest
from pyspark.sql import functions as F

from concord.operators import apply, matching, shared, sinks
from concord.plans import decide, execute, runs, state
from concord.plans.spec import Definition, DefinitionError, FieldMap, Identity
from concord.streaming import micro

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def now():
    return F.lit("2026-03-17 12:00:00").cast("timestamp")


class Held:
    """A side in memory, which can be told to break when it is written."""

    def __init__(self, df, breaks=()):
        self.df, self.breaks, self.writes = df, list(breaks), 0

    def write(self, new):
        rows = new.collect()
        how = self.breaks.pop(0) if self.breaks else None
        if how == "before":
            raise OSError("broken")
        self.df, self.writes = new.sparkSession.createDataFrame(rows, new.schema), self.writes + 1
        if how == "after":
            raise OSError("broken")

    def side(self):
        return execute.Side(lambda: self.df, self.write)


def planned(*args):
    return shared.checkpoint(decide.one_way_plan(*args))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# one way, by address


def codes(**more):
    return Definition("codes", "push", (FieldMap("code", "code"), FieldMap("status", "state")), ("code",), local_order=("modified",), remote_order=("nr",), **more)


@pytest.fixture
def several(spark):
    """Two local and two remote rows of one code."""
    local = spark.createDataFrame([("T1", "C1", "open", 1), ("T2", "C1", "closed", 2), ("T3", "C2", "new", 1), ("T4", "C2", "newer", 2)], "name string, code string, status string, modified int")
    remote = spark.createDataFrame([(101, "C1", "x"), (202, "C1", "y"), (None, "C9", "z")], "nr int, code string, state string")
    return local, remote


@pytest.mark.parametrize("mode,want", [
    ("first_match", [(101, "C1", "x"), (202, "C1", "closed"), (None, "C2", "newer"), (None, "C9", "z")]), ("all_matches", [(101, "C1", "closed"), (202, "C1", "closed"), (None, "C2", "newer"), (None, "C9", "z")]),
])
def test_rows_are_written_by_their_id_and_never_multiply(several, mode, want):
    local, remote = several
    d = codes(match_mode=mode, remote_id="nr")
    plan = planned(local, remote, d)
    assert {r.address for r in plan.where("action = 'updated'").collect()} == ({"id=202"} if mode == "first_match" else {"id=101", "id=202"})
    after = execute.apply_plan(remote, plan, d, "push")
    assert rows_of(after, "nr", "code", "state") == sorted(want, key=repr)


def test_matches_without_ids_are_one_write(several):
    local, remote = several
    d = codes(match_mode="all_matches", remote_id="nr")
    half = remote.withColumn("nr", F.when(F.col("nr") != 101, F.col("nr")))
    plan = planned(local.where("name = 'T2'"), half, d)
    assert [(r.action, r.address, r.message) for r in plan.collect()] == [("updated", "all=text:C1", "one write for 2 matched rows")]
    assert rows_of(execute.apply_plan(half, plan, d, "push"), "code", "state") == [("C1", "closed"), ("C1", "closed"), ("C9", "z")]
    same = remote.withColumns({"nr": F.lit(None).cast("int"), "state": F.lit("closed")})
    assert [r.action for r in planned(local.where("name = 'T2'"), same, d).collect()] == ["skipped"]
    one = same.withColumn("state", F.when(F.col("code") == "C1", F.lit("closed")).otherwise(F.col("state")))
    assert planned(local.where("name = 'T2'"), one.unionByName(remote.where("nr = 101")), d).where("action = 'updated'").count() == 1  # one of three differs


LINKS = Identity("pk", "rid", "id", "link")


def linked(direction, **more):
    return Definition("links", direction, (FieldMap("code", "code"), FieldMap("status", "state")), ("code",) if direction != "both" else (), identity=LINKS, local_modified="modified", remote_modified="updated_at", remote_creation="created_at", **more)


def test_a_pull_by_stored_ids_changes_keys(spark):
    local = spark.createDataFrame([("F1", "7", "K1", "a", None), ("F2", "8", None, "b", None), ("F3", "", "K3", "c", None)], "pk string, rid string, code string, status string, modified string")
    remote = spark.createDataFrame([("7", "", "K9", "a2", "2026-01-02 00:00:00", None), ("8", "", "K8", "b2", None, None), ("9", "", "K3", "c", None, None), ("5", "", "K5", "e", None, None)], "id string, link string, code string, state string, updated_at string, created_at string")
    d = linked("pull")
    plan = planned(local, remote, d)
    after = execute.apply_plan(local, plan, d, "pull")
    made = after.where("code = 'K5'").first()
    assert made.pk.startswith("links-") and made.rid == "5"
    assert rows_of(after.where("code <> 'K5'"), "pk", "rid", "code", "status") == [("F1", "7", "K9", "a2"), ("F2", "8", "K8", "b2"), ("F3", "9", "K3", "c")]
    assert after.where("pk = 'F1'").first().modified == "2026-01-02 00:00:00"
    again = execute.apply_plan(after, plan, d, "pull")
    assert rows_of(again, *after.columns) == rows_of(after, *after.columns)  # a plan that is applied again changes nothing


def test_pushes_carry_links_and_new_ids(spark):
    local = spark.createDataFrame([("F1", "", "K1", "a", None), ("F2", "4", "K2", "b", "2026-01-02 10:00:00"), ("F3", None, "K3", "c", None)], "pk string, rid string, code string, status string, modified string")
    remote = spark.createDataFrame([(4, "", "K2", "b", None, None)], "id int, link string, code string, state string, updated_at string, created_at string")
    d = linked("push", id_strategy="max_plus_one")
    plan = planned(local, remote, d)
    assert {r.record_key: r.changed_fields for r in plan.where("action = 'updated'").collect()} == {"text:K2": "link"}
    after = execute.apply_plan(remote, plan, d, "push")
    assert rows_of(after, "id", "link", "code", "updated_at") == [(4, "F2", "K2", "2026-01-02 10:00:00"), (5, "F1", "K1", None), (6, "F3", "K3", None)]


def test_values_that_do_not_fit_are_errors(spark, tmp_path):
    local = spark.createDataFrame([("A", "7"), ("B", "abc"), ("C", "x1"), ("D", None)], "name string, status string")
    target = Held(spark.createDataFrame([("A", 7), ("B", 7), ("D", 1)], "id string, state int"))
    d = Definition("typed", "push", (FieldMap("name", "id"), FieldMap("status", "state")), ("name",))
    plan = execute.run_one_way(d, local, target.df, target.write, str(tmp_path), "r", now(), now())
    assert rows_of(plan, "record_key", "action", "message") == [("text:A", "skipped", None), ("text:B", "error", "state: 'abc' is no int"), ("text:C", "error", "state: 'x1' is no int"), ("text:D", "updated", None)]
    assert rows_of(target.df, "id", "state") == [("A", 7), ("B", 7), ("D", None)]


def test_both_ways_are_no_pull(spark, tmp_path):
    d = linked("both")
    with pytest.raises(DefinitionError):
        execute.run_one_way(d, spark.range(1), spark.range(1), print, str(tmp_path), "r", now(), now())
    with pytest.raises(DefinitionError):
        decide.one_way_plan(spark.range(1), spark.range(1), d)
    for more in ({"delete_missing": True}, {"identity": LINKS}):
        with pytest.raises(DefinitionError):
            micro.pull_batch(None, spark.range(1), 0, Definition("d", "pull", (FieldMap("code", "code"),), ("code",), **more))


# both ways

BY_KEY = Definition("keys", "both", (FieldMap("name", "id"), FieldMap("status", "state")), ("name",), local_modified="modified", remote_modified="updated_at", remote_creation="created_at")


def by_key(spark):
    local = spark.createDataFrame([("A", "new", "2026-01-02 00:00:00"), ("B", "old", "2026-01-01 00:00:00"), ("C", "alone", None), ("", "keyless", None)], "name string, status string, modified string")
    remote = spark.createDataFrame([("A", "old", "2026-01-01 00:00:00", None), ("B", "new", "2026-01-02 00:00:00", None), ("D", "alone", None, None)], "id string, state string, updated_at string, created_at string")
    return local, remote


def by_link(spark):
    local = spark.createDataFrame([("F1", "P1", "k", "new", "2026-01-02 00:00:00"), ("F2", "", "m", "made", None), ("F3", "P7", "k", "lost", None), ("F6", "", "k", "same", "2026-01-01 00:00:00")], "pk string, rid string, code string, status string, modified string")
    remote = spark.createDataFrame([("P1", "F1", "k", "old", "2026-01-01 00:00:00", None), ("P2", "", "n", "alone", None, None), ("P3", "F9", "k", "stray", None, None), ("P6", "F6", "k", "same", "2026-01-02 00:00:00", None)], "id string, link string, code string, state string, updated_at string, created_at string")
    return local, remote


PLACES = [(), (("remote", "after"), ("local", "before")), (("local", "after"),)]


@pytest.mark.parametrize("breaks", PLACES)
def test_a_run_of_both_sides_is_resumed(spark, tmp_path, breaks):
    local, remote = (Held(df, [how for side, how in breaks if side == name]) for df, name in zip(by_key(spark), ("local", "remote")))
    go = lambda: execute.run_both(BY_KEY, local.side(), remote.side(), str(tmp_path), "r", now(), now())
    for _ in breaks:
        with pytest.raises(OSError):
            go()
        assert not (tmp_path / "runs").exists()
    plan = go()
    assert rows_of(local.df, "name", "status") == [("", "keyless"), ("A", "new"), ("B", "new"), ("C", "alone"), ("D", "alone")]
    assert rows_of(remote.df, "id", "state") == [("A", "new"), ("B", "new"), ("C", "alone"), ("D", "alone")]
    writes = local.writes, remote.writes
    assert rows_of(go(), "record_key", "action") == rows_of(plan, "record_key", "action") and (local.writes, remote.writes) == writes  # all is done
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 1 and spark.read.parquet(f"{tmp_path}/items").count() == 4
    assert [r.watermark for r in runs.watermarks(spark.read.parquet(f"{tmp_path}/runs")).collect()] != []
    second = execute.run_both(BY_KEY, local.side(), remote.side(), str(tmp_path), "r2", now(), now())
    assert {r.action for r in second.collect()} == {"skipped"}


@pytest.mark.parametrize("breaks", [(("remote", "after"), ("local", "after"))])
def test_links_are_written_back(spark, tmp_path, breaks):
    local, remote = (Held(df, [how for side, how in breaks if side == name]) for df, name in zip(by_link(spark), ("local", "remote")))
    d = linked("both", delete_missing=True, id_strategy="payload")
    numbered = execute.Side(lambda: remote.df, lambda df: remote.write(df.withColumn("id", F.coalesce("id", F.concat(F.lit("P-"), "link")))))  # the storage gives ids
    go = lambda run: execute.run_both(d, local.side(), numbered, str(tmp_path), run, now(), now())
    for _ in breaks:
        with pytest.raises(OSError):
            go("r")
    go("r")
    made = local.df.where("rid = 'P2'").first()
    assert made.pk.startswith("links-")
    assert rows_of(local.df, "pk", "rid", "status") == sorted([("F1", "P1", "new"), ("F2", "P-F2", "made"), ("F6", "P6", "same"), (made.pk, "P2", "alone")])
    assert rows_of(remote.df, "id", "link", "state") == sorted([("P1", "F1", "new"), ("P2", made.pk, "alone"), ("P-F2", "F2", "made"), ("P6", "F6", "same")])
    assert {r.action for r in go("r2").collect()} == {"skipped"}


def test_a_dry_run_writes_nothing(spark, tmp_path):
    local, remote = map(Held, by_key(spark))
    plan = execute.run_both(BY_KEY, local.side(), remote.side(), str(tmp_path), "r", now(), now(), dry_run=True)
    assert plan.count() == 4 and local.writes == remote.writes == 0 and runs.watermarks(spark.read.parquet(f"{tmp_path}/runs")).count() == 0
    with pytest.raises(DefinitionError):
        execute.run_both(codes(), local.side(), remote.side(), str(tmp_path), "r", now(), now())


# filters of keys


def test_rows_that_cannot_match_stay_where_they_are(spark):
    target = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").cast("string").alias("own"))
    target = target.unionByName(spark.createDataFrame([(None, "x"), (None, None)], "key string, own string"))
    source = spark.createDataFrame([("k5", "9"), ("k77", ""), (None, "x"), ("none", None)], "key string, rid string")
    near = matching.might_match(target, source)
    assert {"k5", "k77"} <= {r.key for r in near.collect()} and near.count() < 10
    both = {(r.key, r.own) for r in matching.might_match(target, source, "own", "rid").collect()}
    assert {("k5", "5"), ("k77", "77"), ("k9", "9"), (None, "x")} <= both and len(both) < 12
    assert matching.might_match(target, source.limit(0)).count() == 0


# databases


def rows_in(spark, url, table="T"):
    return rows_of(spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**DERBY).load(), "ID", "STATE", "NOTE")


@pytest.fixture
def database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    c = sinks.Connection(spark, url, DERBY["driver"])
    c.run("CREATE TABLE t (id VARCHAR(20) PRIMARY KEY, state VARCHAR(10), note VARCHAR(10))")
    c.run("INSERT INTO t VALUES ('a', 'old', 'kept'), ('b', 'old', 'kept'), ('z', 'gone', 'n')")
    c.open.close()
    return url


def test_a_database_is_merged_in_one_go(spark, database):
    news = spark.createDataFrame([("b", "new"), ("c", "made"), ("d", None)], "id string, state string").repartition(3)
    news = news.unionByName(news.where("id = 'c'"))  # a task that ran again has staged a row twice
    gone = spark.createDataFrame([("z",), ("nobody",)], "id string")
    assert sinks.merge_into(news, database, "t", ["id"], "run-1", gone, **DERBY) == (3, 1)
    want = [("a", "old", "kept"), ("b", "new", "kept"), ("c", "made", None), ("d", None, None)]
    assert rows_in(spark, database) == sorted(want, key=repr)
    assert sinks.merge_into(news.withColumn("state", F.lit("again")), database, "t", ["id"], "run-1", **DERBY) == (0, 0)  # this run is done
    assert rows_in(spark, database) == sorted(want, key=repr)


def test_an_attempt_that_fails_leaves_nothing(spark, database):
    before = rows_in(spark, database)
    news = spark.createDataFrame([(f"k{i:03}", "new") for i in range(200)], "id string, state string").repartition(4)
    broken = news.withColumn("state", F.when(F.col("id") == "k150", F.raise_error(F.lit("lost executor"))).otherwise(F.col("state")))
    with pytest.raises(Exception, match="lost executor"):
        sinks.merge_into(broken, database, "t", ["id"], "run-2", **DERBY)
    too_long = news.withColumn("state", F.lit("far too long a value"))
    with pytest.raises(Exception):
        sinks.merge_into(too_long, database, "t", ["id"], "run-2", **DERBY)
    assert rows_in(spark, database) == before
    assert sinks.merge_into(news, database, "t", ["id"], "run-2", **DERBY) == (200, 0)
    assert len(rows_in(spark, database)) == 203
    c = sinks.Connection(spark, database, DERBY["driver"])
    assert c.number("SELECT count(*) FROM sys.systables WHERE tablename LIKE 'STAGE%'") == 0
    c.open.close()


def test_a_sink_tells_bad_rows_apart(spark, tmp_path):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("record_key"), F.col("id").alias("v")).repartition(2)
    sink = str(tmp_path / "sink")

    def put(part):
        import uuid
        from pathlib import Path

        if (part["v"] % 250 == 7).any():
            raise ValueError("no such value")
        Path(sink).mkdir(exist_ok=True)
        (Path(sink) / uuid.uuid4().hex).write_text("\n".join(part["record_key"]))

    told = sinks.put_apart(df, put, "record_key", str(tmp_path / "told"), rows=300)
    assert rows_of(told, "record_key", "fault") == [(f"k{i}", "ValueError: no such value") for i in (257, 507, 7, 757)]
    taken = [line for f in (tmp_path / "sink").iterdir() for line in f.read_text().split("\n")]
    assert len(taken) == len(set(taken)) == 996
    plan = df.select("record_key", F.lit("updated").alias("action"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("message"))
    assert sinks.as_errors(plan, told).where("action = 'error' and status = 'error' and message like 'ValueError%'").count() == 4


# names and numbers that jobs share


def test_ids_are_reserved_once(spark, tmp_path):
    got, lock = [], threading.Lock()

    def take(n):
        first = apply.reserve_ids(spark, str(tmp_path), "customers", n, start=100)
        with lock:
            got.append((first, first + n))

    threads = [threading.Thread(target=take, args=(n,)) for n in (5, 1, 7, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got.sort()
    assert got[0][0] == 100 and all(a[1] == b[0] for a, b in zip(got, got[1:])) and got[-1][1] == 116
    assert shared.claim(spark, str(tmp_path / "c"), "x", "one") and not shared.claim(spark, str(tmp_path / "c"), "x", "two") and shared.claims(spark, str(tmp_path / "c")) == {"x": "one"}
    ids = apply.allocate_ids(spark.range(3), ["id"], "new", "sequence", start=apply.reserve_ids(spark, str(tmp_path), "customers", 3))
    assert [r.new for r in ids.orderBy("id").collect()] == [116, 117, 118]


NEWS = "record_key string, fingerprint string, removed boolean"


def test_of_two_jobs_one_wins(spark, tmp_path):
    table = state.StateTable(spark, str(tmp_path))
    one = lambda rows, **more: state.run_state(table, "d", spark.createDataFrame(rows, NEWS), **more)
    assert one([("a", "1", False), ("b", "1", False), ("c", "1", False)]).counters.first().created == 3

    def interfering(df):
        """The rule of a slow job: while it plans, another job changes a."""
        if not interfered:
            interfered.append(True)
            one([("a", "other", False), ("b", "1", False), ("c", "1", False)])
        return df.withColumn("action", F.when(F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")), "skip").when(F.size("documents") > 0, "replace").otherwise("create"))

    interfered = []
    slow = one([("a", "mine", False), ("b", "mine", False), ("c", "1", False), ("d", "1", False)], rule=interfering)
    assert {r.record_key: (r.action, r.message) for r in slow.items.collect()} == {"a": ("error", "state has changed since"), "b": ("updated", "replace"), "d": ("created", "create")}
    version, last = table.read()
    assert version == 3 and {r.record_key: (r.fingerprint, r.revision) for r in last.collect()} == {"a": ("other", 2), "b": ("mine", 2), "c": ("1", 1), "d": ("1", 1)}
    assert one([("a", "mine", False), ("b", "mine", False), ("c", "1", False), ("d", "1", False)]).counters.first().updated == 1  # planned anew it goes through
