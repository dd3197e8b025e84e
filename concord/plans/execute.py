"""Runs: a plan is made, applied and logged, in an order that leaves no half-done run behind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import blank, shift_zone
from ..operators.apply import allocate_ids, write_back
from ..operators.joins import dealt_key
from ..operators.matching import address, with_key
from ..operators.shared import checkpoint
from .decide import both_ways_plan, identity_plan, one_way_plan
from .runs import audit, counters, finished
from .spec import Definition, DefinitionError


WRITES = ("created", "updated", "deleted")


def apply_plan(target: DataFrame, plan: DataFrame, d: Definition, way: str) -> DataFrame:
    """The target after what a plan writes to it: created rows are added, of updated ones the changed fields are set, deleted ones go.

    A row is written by the address that the plan has for it: its id or, where it has none, its raw keys, whose rows are written alike; a
    write for several matches goes to all rows of the normal key. Of several writes to one row, and of several new rows of one key, the last by the
    source's order counts, so that an update never adds rows and a new row is never added twice. A new row that is there already (by its key
    or, in plans by identities, by its link) is updated instead: a run that is resumed may apply its plan again. New rows without an id get one
    as the definition says. Where the definition has stamps, written rows get the source's, in the target's zone.

    Errors, conflicts and skips change nothing. Columns that are not mapped stay, and are null in new rows.
    """
    own_id, keys, link = d.own_id(way), d.target_keys(way), d.link(way)
    fields, kinds = d.written(way), dict(target.dtypes)
    deep = lambda f: kinds[f].startswith(("array", "struct", "map"))
    kind = ", ".join(f"`{f}` {kinds[f] if deep(f) else 'string'}" for f in fields if f in kinds)
    ordinal = "ordinal" in plan.columns
    order = F.struct(*([F.col("ordinal")] if ordinal else []), F.xxhash64("payload"))
    p = plan.where(F.col("action").isin(*WRITES) & (F.col("write_direction") == way))
    what = F.struct(F.col("action"), F.from_json("payload", kind).alias("new"), F.transform("changes", lambda c: c["field"]).alias("changed"), "source_modified", "source_creation", F.col("create_key").alias("key"))
    p = p.select("address", "create_key", order.alias("_order"), what.alias("w"))

    def last(df: DataFrame, by: str) -> DataFrame:
        return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.max_by("w", "_order").alias("w"), F.max("_order").alias("_order"))

    # what stands for a row that is there: of plans by identities of both sides its link, else its normal key
    by_link = d.direction == "both" and d.identity is not None
    known = target.withColumn("_known", F.nullif(F.trim(F.col(link).cast("string")), F.lit(""))) if by_link else with_key(target, keys, "_known") if keys else target.withColumn("_known", F.lit(None).cast("string"))
    there = known.withColumn("_at", address(F.col, own_id, keys)).where("_known is not null and _at is not null").select("_known", "_at")
    new = last(p.where("w.action = 'created'"), "create_key")
    named = p.where(F.col("address").isNotNull() & ~F.col("address").startswith("all=")).select("address", "_order", "w")
    by_key = p.where(F.col("w.action") == "created")
    if d.match_mode == "all_matches":
        by_key = by_key.unionByName(p.where(F.col("address").startswith("all=")).withColumn("create_key", F.expr("substring(address, 5)")))
    again = last(by_key, "create_key").join(there, F.col("create_key") == F.col("_known")).select(F.col("_at").alias("address"), "_order", "w")
    writes = last(named.unionByName(again), "address").select("address", "w")
    own = target.withColumn("_address", address(F.col, own_id, keys))
    both = own.withColumn("_dealt", dealt_key(own, "_address")).join(writes, F.col("_dealt") == F.col("address"), "left").where(F.coalesce(F.col("w.action") != "deleted", F.lit(True)))
    zones = (d.local_zone, d.remote_zone) if way == "push" else (d.remote_zone, d.local_zone)
    modified, creation = (d.remote_modified, d.remote_creation) if way == "push" else (d.local_modified, None)

    def value(c: str, old: Column, is_new: Column) -> Column:
        hit = F.col("w").isNotNull()
        if c in (modified, creation):
            stamp = shift_zone(F.col("w.source_modified" if c == modified else "w.source_creation"), *zones).try_cast(kinds[c])
            return F.when(hit & (is_new if c == creation else F.lit(True)), F.coalesce(stamp, old)).otherwise(old).alias(c)
        if c not in fields:
            return old.alias(c)
        put = F.col("w.new")[c] if deep(c) else F.col("w.new")[c].try_cast(kinds[c])
        return F.when(hit & ((F.col("w.action") == "created") | F.array_contains("w.changed", fields[c])), put).otherwise(old).alias(c)

    kept = both.select(*[value(c, F.col(f"`{c}`"), F.lit(False)) for c in target.columns])
    added = new.join(there.select("_known").distinct(), F.col("create_key") == F.col("_known"), "left_anti")
    added = added.select("create_key", *[value(c, F.lit(None).cast(kinds[c]), F.lit(True)) for c in target.columns])
    return kept.unionByName(_numbered(added, target, d, way).select(target.columns))


def _numbered(added: DataFrame, target: DataFrame, d: Definition, way: str) -> DataFrame:
    """New rows (create_key and the target's columns) with ids, where they bring none: remote ones as the definition's strategy says, local ones a hash of what they are created for."""
    own_id, kinds = d.own_id(way), dict(target.dtypes)
    if own_id is None or own_id not in kinds:
        return added
    if way == "push":
        if d.id_strategy not in ("sequence", "max_plus_one"):
            return added
        lack = added.where(blank(F.col(own_id)))
        made = allocate_ids(lack, ["create_key"], own_id, d.id_strategy, target, start=d.sequence_start)
        return made.withColumn(own_id, F.col(own_id).cast(kinds[own_id])).unionByName(added.where(~blank(F.col(own_id))))
    if kinds[own_id] != "string":
        return added
    name = F.concat(F.lit(f"{d.name}-"), F.substring(F.sha2(F.col("create_key"), 256), 1, 20))
    return added.withColumn(own_id, F.when(blank(F.col(own_id)), name).otherwise(F.col(own_id)))


@dataclass(frozen=True)
class Side:
    """A table of one side: how it is read as it is now, and how it is replaced."""

    read: Callable[[], DataFrame]
    write: Callable[[DataFrame], None]


INTENTS = "run string, side string, phase string, noted_at timestamp"


class Intents:
    """What a run has begun and done, side by side: a row for each side and phase, appended as it happens."""

    def __init__(self, spark: SparkSession, log: str, run: str):
        self.spark, self.path, self.run = spark, f"{log}/intents", run

    def noted(self) -> set[tuple[str, str]]:
        spark = self.spark
        spark.createDataFrame([], INTENTS).write.mode("append").parquet(self.path)  # so that there is a table to read
        return {(r.side, r.phase) for r in spark.read.schema(INTENTS).parquet(self.path).where(F.col("run") == self.run).select("side", "phase").distinct().collect()}  # a few rows

    def note(self, side: str, phase: str) -> None:
        self.spark.range(1).select(F.lit(self.run).alias("run"), F.lit(side).alias("side"), F.lit(phase).alias("phase"), F.current_timestamp().alias("noted_at")).write.mode("append").parquet(self.path)

    def once(self, side: str, work: Callable[[], None]) -> None:
        """Does what is not noted as done; what was begun and broke off is done again."""
        if (side, "done") not in self.noted():
            self.note(side, "begun")
            work()
            self.note(side, "done")


def run_both(d: Definition, local: Side, remote: Side, log: str, run: str, started_at: Column, finished_at: Column, watermark: Column | None = None, full: bool = True, dry_run: bool = False) -> DataFrame:
    """Plans both directions (by keys, or by identities if the definition has them), writes the remote side, then the local one, and logs; returns the plan.

    The plan is kept in the log's folder before anything is written, and each phase notes that it has begun and that it is done:
    remote, local, links, items, run. A run that breaks off is called again by its name: it takes the plan that is kept, leaves out what is done,
    and does again what was begun, which changes nothing that is there already (see apply_plan). With identities, rows created on the remote side are
    read again for the ids they have got, which the local rows keep, and those created on the local side likewise. The run's own
    row comes last and alone moves the watermark; a dry run plans and logs only.
    """
    if d.direction != "both":
        raise DefinitionError("a run of both sides needs a definition of both directions")
    spark = local.read().sparkSession
    intents, kept = Intents(spark, log, run), f"{log}/plans/{run}"

    def planned() -> None:
        ours, theirs = local.read(), remote.read()
        plan = identity_plan(ours, theirs, d, watermark, full) if d.identity else both_ways_plan(ours, theirs, d, watermark)
        plan.write.mode("overwrite").parquet(kept)

    intents.once("plan", planned)
    plan = spark.read.parquet(kept)
    if not dry_run:
        intents.once("remote", lambda: remote.write(apply_plan(remote.read(), plan, d, "push")))

        def to_local() -> None:
            out = apply_plan(local.read(), plan, d, "pull")
            if d.identity:
                i = d.identity
                made = plan.where("action = 'created' and write_direction = 'push'").select(F.col("create_key").alias(i.local_pk))
                ids = remote.read().select(F.trim(F.col(i.remote_link).cast("string")).alias(i.local_pk), F.col(i.remote_id).cast("string").alias(i.local_remote_id)).where(F.col(i.local_remote_id).isNotNull())
                out = write_back(out, ids.join(made, i.local_pk, "left_semi"), i.local_pk, i.local_remote_id)
            local.write(out)

        intents.once("local", to_local)
        if d.identity and (i := d.identity):

            def links() -> None:
                made = plan.where("action = 'created' and write_direction = 'pull'").select(F.col("create_key").alias("_rid"))
                ids = local.read().select(F.trim(F.col(i.local_remote_id).cast("string")).alias("_rid"), F.col(i.local_pk).cast("string").alias(i.remote_link)).join(made, "_rid", "left_semi")
                theirs = remote.read().withColumn("_rid", F.trim(F.col(i.remote_id).cast("string")))
                remote.write(write_back(theirs, ids, "_rid", i.remote_link).drop("_rid"))

            intents.once("links", links)
    intents.once("items", lambda: audit(plan, run, started_at).write.mode("append").parquet(f"{log}/items"))
    intents.once("run", lambda: finished(counters(plan), d.name, run, started_at, finished_at, dry_run).write.mode("append").parquet(f"{log}/runs"))
    return plan


def run_one_way(d: Definition, local: DataFrame, remote: DataFrame, write: Callable[[DataFrame], None], log: str, run: str, started_at: Column, finished_at: Column, dry_run: bool = False, rule: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Plans a push or pull, applies it, and returns the plan; log is a folder with the tables items and runs. A definition of both directions is refused (see run_both).

    The order is fixed: the plan is made and kept, so that both sides have been read to their end before anything, deletes
    above all, is written; then write gets the target's new rows; then a row for each decision is appended; the run's own row comes
    last and alone moves the watermark. A run that fails leaves a row of status Error. A dry run plans and logs, and neither
    writes nor moves the watermark. rule gets the plan and "written" and may add to messages after inserts and updates.
    """
    spark, way = local.sparkSession, d.direction
    if way == "both":
        raise DefinitionError("a definition of both directions is run by run_both")
    try:
        plan = checkpoint(one_way_plan(local, remote, d))
        if not dry_run:
            write(apply_plan(remote if way == "push" else local, plan, d, way))
            plan = rule(plan, "written") if rule else plan
        audit(plan, run, started_at).write.mode("append").parquet(f"{log}/items")
    except Exception:
        none = spark.createDataFrame([], plan_schema())
        failed = finished(counters(none), d.name, run, started_at, finished_at, dry_run).withColumn("status", F.lit("Error"))
        failed.write.mode("append").parquet(f"{log}/runs")
        raise
    finished(counters(plan), d.name, run, started_at, finished_at, dry_run).write.mode("append").parquet(f"{log}/runs")
    return plan


def plan_schema() -> str:
    return "action string, status string"


def after_write(plan: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's rule over what was inserted or updated; it adds note, which joins the message."""
    done = rule(plan.where(F.col("action").isin("created", "updated")))
    done = done.withColumn("message", F.nullif(F.concat_ws(" | ", "message", "note"), F.lit(""))).select(plan.columns)
    return done.unionByName(plan.where(~F.col("action").isin("created", "updated")))
