import datetime as dt

import pytest
from pyspark.sql import functions as F

from concord.functions import scalars
from concord.operators import apply, mapping, matching, predicates
from concord.plans import decide, execute, runs, state
from concord.plans.spec import Definition, DefinitionError, Fallback, FieldMap, Identity
from concord.sources import tables
from concord.streaming import micro

STAMP = dt.datetime(2026, 3, 17, 12)
H, S, MS = dt.timedelta(hours=1), dt.timedelta(seconds=1), dt.timedelta(milliseconds=1)


@pytest.mark.parametrize("local,remote,since,tie,outcome", [
    (STAMP, STAMP - 2 * H, STAMP - H, "manual", "local_changed"), (STAMP - 2 * H, STAMP, STAMP - H, "manual", "remote_changed"), (STAMP, STAMP - S, None, "manual", "local_newest"), (STAMP, STAMP + S, None, "manual", "remote_newest"),
    (STAMP, STAMP + 50 * MS, None, "manual", "manual"), (STAMP, STAMP, None, "local", "local_tie"), (STAMP, STAMP, None, "remote", "remote_tie"),
])
def test_conflicts(spark, local, remote, since, tie, outcome):
    df = spark.createDataFrame([(local, remote, since)], "l timestamp_ntz, r timestamp_ntz, s timestamp_ntz")
    got = df.select(decide.resolve_conflict(F.col("l"), F.col("r"), F.col("s") if since else None, 100, "newest_wins", tie)).first()[0]
    assert got == outcome


def tasks(direction="push", **more):
    return Definition("tasks", direction, (FieldMap("name", "id"), FieldMap("status", "state")), ("name",), local_modified="modified", remote_modified="updated_at", remote_creation="created_at", **more)


@pytest.fixture
def pair(spark):
    local = spark.createDataFrame([("A", "open", "2026-03-17 10:00:00"), ("B", "done", "2026-03-17 09:00:00"), ("C", "closed", "2026-03-17 11:00:00"), ("", "open", "2026-03-17 11:00:00"), (None, "x", None)], "name string, status string, modified string")
    remote = spark.createDataFrame([("D", "open", "2026-03-17 10:30:00", None), ("B", "done", "2026-03-17 10:00:00", None), ("C", "open", "2026-03-17 11:30:00", None)], "id string, state string, updated_at string, created_at string")
    return local, remote


def plan_of(df):
    return sorted((r.record_key or "", r.action, r.write_direction or "", r.changed_fields) for r in df.collect())


def test_push_and_pull(pair):
    assert plan_of(decide.one_way_plan(*pair, tasks())) == [("", "error", "push", ""), ("", "error", "push", ""), ("text:A", "created", "push", ""), ("text:B", "skipped", "push", ""), ("text:C", "updated", "push", "status")]
    assert plan_of(decide.one_way_plan(*pair, tasks("pull", create_new=False))) == [("text:B", "skipped", "pull", ""), ("text:C", "updated", "pull", "status"), ("text:D", "skipped", "pull", "")]


def test_both_ways(pair):
    got = plan_of(decide.both_ways_plan(*pair, tasks("both"), F.lit("2026-03-17 09:30:00").cast("timestamp_ntz")))
    assert got == [("text:A", "created", "push", ""), ("text:B", "skipped", "", ""), ("text:C", "updated", "pull", "status"), ("text:D", "created", "pull", "")]


def test_plan_apply_plan_is_all_skipped(spark, pair):
    local, remote = pair
    plan = decide.one_way_plan(local.where("name <> ''"), remote, tasks()).where("action in ('created', 'updated')")
    payload = plan.select(F.from_json("payload", "id string, state string").alias("p")).select("p.*")
    after = apply.upsert(remote, payload, ["id"])
    assert {a for _, a, _, _ in plan_of(decide.one_way_plan(local.where("name <> ''"), after, tasks()))} == {"skipped"}
    assert {r.id for r in decide.deletions(local, after, tasks(), "push").select(F.col("record_key").alias("id")).collect()} == {"text:D"}
    assert runs.counters(plan).first().processed == 2


def test_images_and_row_rule(pair):
    plan = decide.one_way_plan(*pair, tasks(), images=True).where("record_key = 'text:C'")
    assert '"state":"open"' in plan.first().remote_before
    out = decide.apply_row_rule(decide.one_way_plan(*pair, tasks()).where("record_key = 'text:B'"), lambda df: df.withColumns({"changed": F.lit(True), "note": F.lit("by rule")})).first()
    assert (out.action, out.message) == ("updated", "by rule")


IDENTITY_CASES = [
    ([("F1", "P1"), ("F2", "P1")], [("P1", "")]), ([("F1", "")], [("P1", "F1"), ("P2", "F1")]), ([("F1", "P1"), ("F1", "P2")], [("P1", "F1"), ("P2", "F1")]),
    ([("F1", "P1"), ("F2", "P1")], [("P1", "F1"), ("P1", "F2")]), ([("F1", "P1"), ("F2", "P1")], []), ([], [("P1", "F1"), ("P2", "F1")]), ([("F1", ""), ("F2", "P1")], [("P1", "F1")]),
]


@pytest.mark.parametrize("local,remote", IDENTITY_CASES)
def test_identity_conflicts_leave_only_the_healthy_pair(spark, local, remote):
    l = spark.createDataFrame([*local, ("F9", "P9")], "pk string, rid string")  # noqa: E741
    r = spark.createDataFrame([*remote, ("P9", "F9")], "rid string, link string")
    pairs, conflicts, _ = matching.identity_pairs(l, r)
    assert [(x.pk, x.rid) for x in pairs.collect()] == [("F9", "P9")]
    assert conflicts.count() > 0


def test_value_maps(spark):
    df = spark.createDataFrame([("1",), ("01.0",), ("9",), (None,)], "v string")
    values = lambda *a: [r[0] for r in df.select(mapping.map_value(F.col("v"), *a)).collect()]
    assert values([("1", "Open"), (None, "none")]) == ["Open", "Open", "9", "none"]
    assert values([("1", None)], Fallback("constant", "x")) == [None, None, "x", "x"]
    assert values([], Fallback("null")) == [None] * 4
    assert mapping.reverse_pairs([(None, "2"), ("F", "1"), ("G", "1")]) == [("2", None), ("1", "G")]


@pytest.mark.parametrize("broken", [
    dict(direction="sideways"), dict(match_fields=()), dict(match_fields=("nope",)), dict(mapping=(FieldMap("a", "x"), FieldMap("a", "y"))), dict(mapping=(FieldMap("a", "x"), FieldMap("b", "x"))), dict(direction="both"),
    dict(remote_modified="x", remote_creation="y"), dict(remote_modified="m", remote_creation="m"), dict(match_fields=(), identity=Identity("a", "b", "c", "")), dict(delete_missing=True, read_query="select 1"), dict(id_strategy="sequence"), dict(value_map={"z": ()}),
])
def test_definitions_are_checked(broken):
    with pytest.raises(DefinitionError):
        Definition(**dict(name="d", direction="push", mapping=(FieldMap("a", "x"), FieldMap("b", "y", "<-")), match_fields=("a",)) | broken)


def test_ids_are_consecutive_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = apply.allocate_ids(df, ["k"], "new", "sequence", start=5).orderBy("k").collect()
    assert [r.new for r in got] == list(range(5, 1005))


def test_ids_are_consecutive_where_ranges_are_sampled(spark):
    """Rows with a column besides the order, and more of them than a sample takes."""
    df = spark.range(200_000, numPartitions=4).select(F.col("id").alias("n"), (-F.col("id")).alias("k"))
    got = apply.allocate_ids(df, ["k"], "new", "sequence", start=5)
    assert got.where("new <> 5 + 199999 - n").count() == 0
    assert got.select("new").distinct().count() == 200_000


def test_child_rows_merge_by_position(spark):
    kind = "array<struct<code: string, note: string>>"
    df = spark.createDataFrame([([("a", "x"), ("b", "y")], [(None, "n"), (None, ""), (None, "z")])], f"old {kind}, new {kind}")
    got = df.select(apply.merge_rows(F.col("old"), F.col("new"), ["code", "note"], ["note"])).first()[0]
    assert [tuple(r) for r in got] == [("a", "n"), ("b", "y"), (None, "z")]


def test_state_sequence(spark):
    """10, 10, 20, 10, none, none, 10: create, skip, replace, replace, reverse, skip, create."""
    known = spark.createDataFrame([], "record_key string, fingerprint string, revision int, documents array<string>, state string, alias_of string")
    actions, reversed_ = [], 0
    for value in ["10", "10", "20", "10", None, None, "10"]:
        news = spark.createDataFrame([("k", value or "gone", value is None)], "record_key string, fingerprint string, removed boolean")
        decided = state.decide(state.prepared(news, known))
        actions.append(decided.first().action)
        reversed_ += state.reversals(decided, spark.createDataFrame([], "reversal_of string"), "d").count()
        known = spark.createDataFrame(state.next_state(decided, known).collect(), known.schema)
    assert actions == ["create", "skip", "replace", "replace", "reverse", "skip", "create"]
    assert reversed_ == 3
    assert len(known.first().documents) == 1
    assert state.stale_plans(decided, known).first().action == "error"


def test_snapshots(spark, tmp_path):
    staged, manifest = tables.snapshot(lambda: spark.range(10).withColumn("v", F.col("id") * 2), str(tmp_path))
    origin = tables.made_from("d", "jdbc:x", "select 1")
    _, manifest = tables.snapshot(lambda: spark.range(10).withColumn("v", F.col("id") * 2), str(tmp_path), origin)
    assert staged.count() == 10 and tables.reusable(spark, manifest, origin).count() == 10
    assert tables.reusable(spark, manifest, tables.made_from("d", "jdbc:y", "select 1")) is None
    assert tables.reusable(spark, manifest | {"n_rows": 11}, origin) is None and tables.reusable(spark, None, origin) is None
    with pytest.raises(tables.SourceError):
        tables.reusable(spark, manifest, {"query": "q"})
    moving = iter(range(100))
    with pytest.raises(tables.SourceError):
        tables.snapshot(lambda: spark.range(next(moving)), str(tmp_path))


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).select(F.col("id").cast("int").alias("K"), F.col("id").cast("string").alias("V")).write.format("jdbc").option("url", url).option("dbtable", "t").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    got = tables.jdbc_table(spark, url, "t", "K", (0, 100), 4, **driver)
    assert got.rdd.getNumPartitions() == 4 and got.where("K >= 90").count() == 10
    assert tables.jdbc_query(spark, url, "SELECT K FROM t WHERE K < 5", **driver).count() == 5


def test_sources(spark):
    with pytest.raises(tables.SourceError):
        tables.user_source(lambda s, p: s.range(p["n"]), spark, {"n": 3}, ["id", "x"])
    with pytest.raises(tables.SourceError):
        tables.query_source(spark, " ", {}, {})
    rows = spark.createDataFrame([("a", ["b"]), ("b", []), ("a", [])], "k string, al array<string>")
    assert {(r.name, r.n) for r in tables.emission_faults(rows, "k", "al").collect()} == {("a", 2), ("b", 2)}
    assert spark.range(5).where(predicates.predicate({"id": [">", 1]}, [["id", "=", 2], ["id", "=", 4]])).count() == 2
    with pytest.raises(ValueError):
        predicates.predicate([["id", "~", 1]])


def test_stale_and_expired_runs(spark):
    at = lambda h, m=0: dt.datetime(2026, 3, 17, h, m)
    rows = [("a", "Queued", at(10), None, None, None), ("b", "Running", at(10), at(10, 30), None, None), ("c", "Running", at(10), at(11, 30), None, None), ("d", "Running", at(10), at(10), None, at(11, 30)), ("e", "Success", None, None, None, None)]
    df = spark.createDataFrame(rows, "run string, status string, creation timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, modified timestamp_ntz")
    got = {r.run: r.status for r in runs.recovered(df, F.lit("2026-03-17 11:00:00").cast("timestamp_ntz")).collect()}
    assert got == {"a": "Skipped", "b": "Error", "c": "Running", "d": "Running", "e": "Success"}
    cut = F.lit("2026-01-01").cast("timestamp_ntz")
    assert [r.run for r in runs.expired(df, cut, cut).collect()] == ["e"]


# plans as one


def test_one_way_deletes_are_part_of_the_plan(pair):
    got = plan_of(decide.one_way_plan(*pair, tasks(delete_missing=True)))
    assert ("text:D", "deleted", "push", "") in got and len(got) == 6


def test_all_matches_by_identity_then_key(spark):
    source = matching.with_key(spark.createDataFrame([("a", "1"), ("b", ""), ("c", "9"), (None, None)], "code string, rid string"), ["code"])
    target = matching.with_key(spark.createDataFrame([("x", "01"), ("y", "1"), ("b", "5"), ("b", "6"), ("c", "7")], "tc string, id string"), ["tc"])
    got = sorted((r.code or "", r.t_tc or "", r.match_kind) for r in matching.match_identity_all(source, target, "rid", "id").collect())
    assert got == [("", "", "none"), ("a", "x", "id"), ("a", "y", "id"), ("b", "b", "key"), ("b", "b", "key"), ("c", "c", "key")]


def test_keyless_rows_are_dealt(spark):
    source = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("text:"), F.col("id").cast("string"))).alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = matching.match_all(source, source).groupBy(F.spark_partition_id().alias("at")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in out) == 4000 and max(r["count"] for r in out) < 1600  # of 4 partitions


LINKS = Identity("pk", "rid", "id", "link")


def linked(**more):
    return Definition("links", "both", (FieldMap("status", "state"),), identity=LINKS, local_modified="modified", remote_modified="updated_at", remote_creation="created_at", **more)


@pytest.mark.parametrize("delete", [False, True])
def test_identity_plan(spark, delete):
    l = spark.createDataFrame([("F1", "P1", "open", "2026-03-17 12:00:00"), ("F2", "", "new", None), ("F3", "P7", "lost", None), ("F4", "P4", "x", None), ("F5", "P4", "y", None), ("F6", "", "same", "2026-03-17 10:00:00")], "pk string, rid string, status string, modified string")  # noqa: E741
    r = spark.createDataFrame([("P1", "F1", "done", "2026-03-17 10:00:00", None), ("P2", "", "alone", None, None), ("P3", "F9", "stray", None, None), ("P4", "", "z", None, None), ("P6", "F6", "same", "2026-03-17 11:00:00", None)], "id string, link string, state string, updated_at string, created_at string")
    plan = decide.identity_plan(l, r, linked(delete_missing=delete))
    got = sorted((x.record_key, x.action, x.write_direction or "", x.changed_fields) for x in plan.collect())
    want = [('{"local":"F1","remote":"P1"}', "updated", "push", "status"), ('{"local":"F2"}', "created", "push", ""), ('{"local":"F4","remote":"P4"}', "conflict", "", ""), ('{"local":"F5","remote":"P4"}', "conflict", "", ""), ('{"local":"F6","remote":"P6"}', "updated", "pull", "rid"), ('{"remote":"P2"}', "created", "pull", "")]
    gone = [('{"local":"F3","remote":"P7"}', "deleted", "pull", ""), ('{"local":"F9","remote":"P3"}', "deleted", "push", "")]
    assert got == sorted(want + (gone if delete else []))
    made = {x.record_key: x.payload for x in plan.where("action = 'created'").collect()}
    assert '"link":"F2"' in made['{"local":"F2"}'] and '"rid":"P2"' in made['{"remote":"P2"}']
    assert decide.identity_plan(l.limit(0), r.limit(0), linked()).count() == 0


def test_choices_are_checked(spark):
    items = spark.createDataFrame([("a", "conflict"), ("b", "updated"), ("c", "conflict"), ("d", "conflict")], "record_key string, action string").withColumns({"status": F.col("action"), "write_direction": F.lit(None).cast("string"), "payload": F.lit('{"to_local": {"x": 1}, "to_remote": {"y": 2}}')})
    choices = spark.createDataFrame([("a", "push"), ("b", "push"), ("c", "sideways"), ("d", "push"), ("d", "pull"), ("e", "pull"), (None, "pull")], "record_key string, choice string")
    told = {r.record_key: r.fault for r in decide.refusals(items, choices).collect()}
    assert told == {"b": "the item is no open conflict", "c": "no direction is chosen", "d": "both directions are chosen", "e": "there is no such item", None: "the item has no key"}
    assert [(r.record_key, r.payload, r.status) for r in decide.apply_resolutions(items, choices).collect()] == [("a", '{"y":2}', "success")]
    assert decide.apply_resolutions(items, choices, dry_run=True).count() == decide.apply_resolutions(items, choices, update_existing=False).count() == 0


# runs from end to end


class Held:
    """A target in memory."""

    def __init__(self, df):
        self.df, self.writes = df, 0

    def write(self, new):
        self.df, self.writes = new.sparkSession.createDataFrame(new.collect(), new.schema), self.writes + 1


def test_a_run_applies_logs_and_moves_the_watermark_last(spark, pair, tmp_path):
    local, remote = pair
    target, d, at = Held(remote), tasks(delete_missing=True), lambda h: F.lit(f"2026-03-17 {h}:00:00").cast("timestamp_ntz")
    go = lambda run, h, **more: execute.run_one_way(d, local.where("name <> ''"), target.df, target.write, str(tmp_path), run, at(h), at(h), **more)
    marks = lambda: [r.watermark for r in runs.watermarks(spark.read.parquet(f"{tmp_path}/runs")).collect()]
    dry = go("r1", 10, dry_run=True)
    assert target.writes == 0 and marks() == [] and spark.read.parquet(f"{tmp_path}/items").count() == dry.count() == 4
    assert plan_of(go("r2", 11)) == plan_of(dry)
    assert sorted((r.id, r.state) for r in target.df.collect()) == [("A", "open"), ("B", "done"), ("C", "closed")]
    assert marks() == [STAMP - H]
    assert {a for _, a, _, _ in plan_of(go("r3", 12))} == {"skipped"}

    def broken(df):
        raise OSError("disk is full")

    with pytest.raises(OSError):
        execute.run_one_way(d, local, target.df, broken, str(tmp_path), "r4", at(13), at(13))
    assert marks() == [STAMP] and [r.status for r in spark.read.parquet(f"{tmp_path}/runs").where("run = 'r4'").collect()] == ["Error"]


def test_a_source_that_breaks_deletes_nothing(spark, pair, tmp_path):
    local, remote = pair
    target = Held(remote)
    broken = local.withColumn("status", F.raise_error(F.lit("lost connection")).cast("string"))
    with pytest.raises(Exception, match="lost connection"):
        execute.run_one_way(tasks(delete_missing=True), broken, remote, target.write, str(tmp_path), "r", F.lit(STAMP), F.lit(STAMP))
    assert target.writes == 0


def test_rules_after_a_write(pair):
    plan = decide.one_way_plan(*pair, tasks())
    out = execute.after_write(plan, lambda df: df.withColumn("note", F.concat(F.lit("mail to "), "record_key")))
    assert {(r.record_key, r.message) for r in out.where("action <> 'error'").collect()} == {("text:A", "mail to text:A"), ("text:B", None), ("text:C", "mail to text:C")}


STATE = "record_key string, fingerprint string, revision int, documents array<string>, state string, alias_of string"
NEWS = "record_key string, fingerprint string, removed boolean, aliases array<string>"


def test_a_second_stateful_run_changes_nothing(spark):
    """Absorbed keys settle once; two claims on one key, a claim on another's and a split are errors."""
    known = spark.createDataFrame([("b", "1", 3, ["b-3"], "{}", None), ("x", None, 2, [], None, "other"), ("y", None, 2, [], None, "other")], STATE)
    news = spark.createDataFrame([("a", "1", False, ["b", "c"]), ("d", "1", False, ["z"]), ("e", "1", False, ["z"]), ("f", "1", False, ["x"]), ("h", "1", False, ["g"]), ("y", "1", False, []), ("g", "1", False, ["g"])], NEWS)
    first = state.job("d", news, known)
    after = spark.createDataFrame(first.state.collect(), first.state.schema)
    got = {r.record_key: (r.revision, list(r.documents), r.alias_of) for r in after.collect()}
    assert got == {"a": (1, ["a-1"], None), "b": (4, [], "a"), "c": (1, [], "a"), "g": (1, ["g-1"], None), "x": (2, [], "other"), "y": (2, [], "other")}
    faults = {r.record_key: r.fault for r in first.decided.where("action = 'error'").collect()}
    assert faults == {"d": "alias is claimed twice", "e": "alias is claimed twice", "f": "alias is owned elsewhere", "h": "alias is emitted too", "y": "record was absorbed"}
    assert [r.reversal_of for r in first.reversals.collect()] == ["b-3"]
    second = state.job("d", news, after)
    assert sorted(map(str, second.state.collect())) == sorted(map(str, after.collect()))
    assert second.items.where("action <> 'error'").count() == 0 and second.counters.first().skipped == 2 and second.counters.first().error == 5


def test_stateful_guards_and_decisions(spark):
    known = spark.createDataFrame([(k, "0", 1, [f"{k}-1"], "{}", None) for k in "abcdef"], STATE)
    news = spark.createDataFrame([(k, "1", False) for k in "abcdefg"], "record_key string, fingerprint string, removed boolean")
    targets = spark.createDataFrame([("a", "a-1", "C", 1, "m", False), ("b", "b-1", "X", 1, "m", False), ("c", "c-1", "C", 2, "m", False), ("d", "d-1", "C", 1, "m", True), ("e", "e-1", "C", 0, "m", False), ("f", "f-1", "C", 1, "m", False), ("g", "g-7", "C", 1, "m", False)], "record_key string, name string, company string, docstatus int, modified string, reversed boolean")
    out = state.job("d", news, known, targets, company="C").decided
    assert {r.record_key: (r.action, r.fault) for r in out.collect()} == {"a": ("replace", None), "b": ("error", "document of another company"), "c": ("error", "document was cancelled outside"), "d": ("error", "document was reversed outside"), "e": ("error", "a document is not submitted"), "f": ("replace", None), "g": ("replace", None)}
    moved = targets.withColumn("modified", F.when(F.col("name") == "f-1", "later").otherwise(F.col("modified")))
    assert {r.record_key: r.fault for r in state.stale_plans(out, known, moved).where("record_key in ('a', 'f')").collect()} == {"a": None, "f": "a document has changed since"}
    rule = lambda df: df.withColumns({"action": F.when(F.col("record_key") == "a", "skip").when(F.col("record_key") == "f", "dance").when(F.col("record_key") == "g", "create").otherwise("skip"), "state": F.when(F.col("record_key") == "a", "[1]").otherwise('{"n": 1}')})
    ruled = {r.record_key: r.fault for r in state.job("d", news, known, targets, rule=rule).decided.collect()}
    assert ruled["a"] == "the state is no object" and ruled["f"] == "no such action" and ruled["g"] == "create would make a second document"
    held = state.job("d", news.where("record_key = 'a'").withColumn("warnings", F.array(F.lit("odd"), F.lit("old"))), known, targets, rule=lambda df: df.withColumn("action", F.lit("skip"))).items.where("record_key = 'a'").first()
    assert (held.action, held.message, held.warns) == ("skipped", "skip | odd; old", True)


def test_previews_put_warnings_before_writes(spark):
    df = spark.createDataFrame([("a", "skipped", False), ("b", "updated", False), ("c", "skipped", True), ("d", "error", False), ("e", "conflict", False)], "record_key string, action string, warns boolean")
    assert [r.record_key for r in runs.preview(df, 4).collect()] == ["d", "e", "c", "b"]
    assert runs.sample(df, 2).count() == 2 and runs.warning_count(df.withColumn("warnings", F.when(F.col("warns"), F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")))).first().warnings == 1


# smaller parts


def test_stamps_and_targets(spark):
    d = tasks(remote_zone="Europe/Berlin", local_zone="UTC")
    df = spark.createDataFrame([("a", True), ("b", False)], "id string, new boolean")
    made = mapping.stamp_remote(df, d, F.lit("2026-01-01 10:00:00"), F.lit("2026-01-01 09:00:00"), F.col("new")).orderBy("id").collect()
    assert [(r.updated_at, r.created_at) for r in made] == [("2026-01-01 11:00:00", "2026-01-01 10:00:00"), ("2026-01-01 11:00:00", None)]
    assert mapping.stamp_local(df, d, F.lit("2026-01-01 11:00:00")).first().modified == "2026-01-01 10:00:00"
    target = spark.createDataFrame([("a", "storage"), ("b", "storage")], "id string, modified string")
    put = apply.with_modified(target, spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3")], "id string, modified string"), ["id"], "modified")
    assert sorted(map(tuple, put.collect())) == [("a", "2"), ("b", "storage")]


def test_write_keys_ids_and_gates(spark):
    df = spark.createDataFrame([("7", "k"), ("", "k"), (None, "k")], "rid string, k string")
    assert [r[0] for r in df.select(matching.write_key(F.col("rid"), F.concat(F.lit("code="), "k"))).collect()] == ["id=7", "code=k", "code=k"]
    assert [r.rid for r in apply.allocate_ids(df, ["k"], "rid", "connector_default").collect()] == ["7", None, None]
    assert apply.allocate_ids(df, ["k"], "rid", "payload") is df
    assert apply.faulty_keys(df, ["rid"]).count() == 2
    wide = spark.createDataFrame([("i", "n", "t", "v")], "id string, name string, _user_tags string, v string")
    assert apply.gate(wide, wide, ["id"]).columns == ["id", "v"]
    assert apply.merge_sql("t", "s", ["id"], ["id", "v"]) == "MERGE INTO t t USING s s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v)"
    assert {r.value for r in matching.identity_missing(spark.createDataFrame([("F1", "P9")], "pk string, rid string"), spark.createDataFrame([("P1", "F7"), ("P2", "F1")], "rid string, link string"), "remote").select(F.col("rid").alias("value")).collect()} == {"P1"}


def test_needs_of_definitions():
    d = tasks(identity=Identity("pk", "rid", "id", "link"), local_order=("modified",))
    assert d.required("local") == ["name", "status", "modified", "pk", "rid"] and "link" in d.required("remote")
    assert d.fetch_keys() == ["id"] and tasks().fetch_keys() == ["id"]
    nested = Definition("n", "pull", (FieldMap("items.1.code", "c"), FieldMap("items", "all"), FieldMap("x", "y")), ("x",))
    assert nested.diff_fields(("items",)) == ["items.1.code", "x"]


def test_columns_catalogs_rules_and_lookups(spark, tmp_path):
    assert [tuple(r) for r in tables.columns_of(spark.range(1)).collect()] == [("id", "bigint")]
    url, driver = f"jdbc:derby:{tmp_path}/db2;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(3).select(F.col("id").cast("int").alias("K")).write.format("jdbc").option("url", url).option("dbtable", "t").options(**driver).save()
    assert [r.column for r in tables.jdbc_columns(spark, url, "SELECT K FROM t", **driver).collect()] == ["K"]
    spark.sql("CREATE DATABASE IF NOT EXISTS Plant")
    spark.range(2).write.mode("overwrite").saveAsTable("plant.dim_a")
    assert list(tables.catalog_tables(spark, "PLANT", "DIM")) == ["plant.dim_a"]
    with pytest.raises(tables.SourceError):
        tables.catalog_tables(spark, "plant", "nothing")
    assert tables.transformed(spark.range(3), lambda df: df.withColumn("v", F.col("id") * 2), ["v"]).count() == 3
    with pytest.raises(tables.SourceError):
        tables.transformed(spark.range(3), lambda df: df, ["v"])
    before = tables.tracked({"a": spark.range(3), "b": spark.range(4)})
    assert tables.changed_lookups(before, {"a": spark.range(3), "b": spark.range(5)}) == ["b"]


# micro-batches


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    t = micro.VersionedTable(spark, str(tmp_path), "k long, s long, v string", lambda df: F.col("k"), buckets=4)
    batches = [spark.createDataFrame(rows, t.schema) for rows in ([(k, 1, "a") for k in range(20)], [(1, 2, "b"), (1, 3, "c"), (2, 0, "late"), (None, 9, "x"), (99, 1, "n")])]

    def put(number):
        to = t.touched(batches[number].dropna(subset=["k"]))
        t.write(micro.merge_batch(t.read(to), batches[number], ["k"], "s"), number, to)
        return {r.k: r.v for r in t.read().collect()}

    first = put(0)
    assert first == {k: "a" for k in range(20)} and put(0) == first
    paths = t.current()
    second = put(1)
    assert second == first | {1: "c", 99: "n"} and put(1) == second
    untouched = set(range(4)) - set(t.touched(batches[1].dropna(subset=["k"])))
    assert all(t.current()[k] == paths[k] for k in untouched) and t.unused()


def test_pull_plans_of_batches(spark, tmp_path):
    d = tasks("pull")
    t = micro.VersionedTable(spark, f"{tmp_path}/t", "name string, status string, modified string", micro.keyed_by(["name"]))
    t.write(spark.createDataFrame([("001", "open", None), ("B", "done", None), ("", "blank", None)], t.schema), -1)
    batch = spark.createDataFrame([("1", "closed"), ("C", "new"), ("B", "done"), (None, "?")], "id string, state string").withColumn("updated_at", F.lit(None).cast("string"))
    for _ in range(2):
        micro.pull_batch(t, batch, 0, d, f"{tmp_path}/items")
        assert sorted((r.name, r.status) for r in t.read().collect()) == [("", "blank"), ("001", "closed"), ("B", "done"), ("C", "new")]
    actions = spark.read.parquet(f"{tmp_path}/items").groupBy("action").count().collect()
    assert {r.action: r["count"] for r in actions} == {"updated": 1, "created": 1, "skipped": 4, "error": 2}


def test_a_batch_is_read_once_and_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    """A file of one row group is one task: its rows' keys and plan must not all be worked out there, nor the file be read for each use."""
    t = micro.VersionedTable(spark, f"{tmp_path}/t", "name string, status string, modified string", micro.keyed_by(["name"]))
    t.write(spark.createDataFrame([(f"{n}", "open", None) for n in range(60)], t.schema), -1)
    read, parts, plan = spark.sparkContext.accumulator(0), [], micro.one_way_plan

    def row(n):
        read.add(1)
        return f"0{n}", "closed", None

    def planned(local, batch, *more):
        parts.append(batch.select(F.spark_partition_id()).distinct().count())
        return plan(local, batch, *more)

    monkeypatch.setattr(micro, "one_way_plan", planned)
    micro.pull_batch(t, spark.createDataFrame(spark.sparkContext.parallelize(range(100), 1).map(row), "id string, state string, updated_at string"), 0, tasks("pull"))
    assert sorted((int(r.name), r.status) for r in t.read().collect()) == [(n, "closed") for n in range(100)]
    assert read.value == 100 and parts == [4]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    t = micro.VersionedTable(spark, str(tmp_path), "k long", lambda df: F.col("k"), buckets=2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were rows enough
    try:
        t.write(spark.range(2000).toDF("k"), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {k: t.read([k]).select(F.input_file_name()).distinct().count() for k in (0, 1)}
    assert all(n > 1 for n in files.values()) and sum(files.values()) <= 2 * micro.SLICES
    assert all(t.bucketed(t.read([k])).where(F.col("_bucket") != k).isEmpty() for k in (0, 1))
    assert t.read().count() == t.read().distinct().count() == 2000 and t.touched(t.read([1])) == [1]


def test_keyed_state_over_batches(spark, tmp_path):
    """State is the table between batches: each batch's job starts from what the one before has left."""
    t = micro.VersionedTable(spark, str(tmp_path), STATE, lambda df: F.col("record_key"), buckets=2)
    seen = []
    for number, value in enumerate(["10", "10", "20", None, "10"]):
        news = spark.createDataFrame([("k", value or "gone", value is None)], "record_key string, fingerprint string, removed boolean")
        seen.append(micro.state_batch(t, news, number, "d").first().action)
    assert seen == ["created", "skipped", "updated", "updated", "created"]
    assert [(r.record_key, r.revision, len(r.documents)) for r in t.read().collect()] == [("k", 4, 1)]


def test_a_filter_on_a_plan_compares_rows_once(spark):
    """A condition on action is not folded into what it is made of, so that records are compared once and not once for each mention."""
    both = Definition("d", "both", (FieldMap("k", "id"), FieldMap("a", "b")), ("k",), local_modified="m", remote_modified="n", remote_creation="c")
    rows = lambda names: spark.createDataFrame([("1", "x", STAMP, STAMP), ("2", "y", STAMP + H, STAMP)], names)
    local, remote = rows("k string, a string, m timestamp_ntz, o timestamp_ntz"), rows("id string, b string, n timestamp_ntz, c timestamp_ntz")
    compared = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    for plan in (decide.both_ways_plan(local, remote, both), decide.one_way_plan(local, remote, both, "push")):
        assert 0 < compared(plan.where("action = 'updated'")) <= compared(plan)


def test_keys_of_digits_are_as_other_numbers(spark):
    """The short way for digits gives what the patterns give, alone and as a part of a key."""
    texts = ["7", "007", " 7\t", "+7", "7.0", "000", "-0", "123456789012345678", "0001234567890123456789", "1e3", "x7", "7\u0085", "", "  ", None, "2026-03-17T12:00:00Z"]
    df = spark.createDataFrame([(t,) for t in texts], "k string")
    for text, key, part, number in df.select("k", scalars.norm_key(F.col("k")), mapping.key_parts(df, ["k"])[0], F.concat(F.lit("number:"), scalars.norm_number(F.col("k")))).collect():
        assert key == part and (number is None or key == number) and (key is None) == (text is None), text
    assert df.select(mapping.key_parts(df, ["k"])).distinct()._jdf.queryExecution().optimizedPlan().toString().count("|\\s+$") <= 4  # trimmed once: grouped by, given out, and both times named


def test_a_state_job_has_tasks_as_it_has_rows(spark, monkeypatch):
    """More rows than the session's partitions should hold are dealt to more tasks, with the same items."""
    key = F.concat(F.lit("r"), F.col("id").cast("string")).alias("record_key")
    known = spark.range(100).select(key, F.lit("1").alias("fingerprint"), F.lit(1).alias("revision"), F.array(F.lit("d")).alias("documents"), F.lit("{}").alias("state"), F.lit(None).cast("string").alias("alias_of"))
    news = spark.range(50, 150).select(key, F.lit("2").alias("fingerprint"), F.lit(False).alias("removed"))
    items = lambda job: sorted(map(tuple, job.items.select("record_key", "action", "message").collect()))
    want = items(state.job("d", news, known))
    monkeypatch.setattr("concord.operators.joins.TASK_ROWS", 10)
    job = state.job("d", news, known)
    assert job.decided.rdd.getNumPartitions() == 20
    assert items(job) == want and len(want) == 150
