"""Runs: counters, status, previews, retention and the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("created", "updated", "deleted", "skipped", "conflict", "error")
DONE = ("Success", "Partial Error", "Needs Review", "Error", "Skipped")
ACTIVE = ("Queued", "Running")


def counters(plan: DataFrame) -> DataFrame:
    """One row: processed, success and a count for each action."""
    return plan.agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "success").alias("success"), *[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])


def status_of(errors: Column, conflicts: Column) -> Column:
    return F.when(errors > 0, "Partial Error").when(conflicts > 0, "Needs Review").otherwise("Success")


def summary(counts: DataFrame) -> DataFrame:
    text = F.format_string("processed %d, created %d, updated %d, deleted %d, skipped %d, conflicts %d, errors %d", *[F.col(c) for c in ("processed", "created", "updated", "deleted", "skipped", "conflict", "error")])
    return counts.withColumns({"run_status": status_of(F.col("error"), F.col("conflict")), "summary": text})


def warning_count(plan: DataFrame, warnings: str = "warnings") -> DataFrame:
    return plan.agg(F.count_if(F.size(warnings) > 0).alias("warnings"))


def preview(plan: DataFrame, limit: int) -> DataFrame:
    """The most telling items: errors, then conflicts, what warns (if the plan has warns or warnings), writes and skips, by key."""
    warns = F.col("warns") if "warns" in plan.columns else F.size("warnings") > 0 if "warnings" in plan.columns else F.lit(False)
    rank = F.when(F.col("action") == "error", 0).when(F.col("action") == "conflict", 1).when(warns, 2).when(F.col("action") == "skipped", 4).otherwise(3)
    return plan.withColumn("priority", rank).orderBy("priority", F.col("record_key").asc_nulls_first()).limit(limit)


def sample(source: DataFrame, limit: int) -> DataFrame:
    """The first rows of a source, as it reads them."""
    return source.limit(limit)


def latest_runs(runs: DataFrame) -> DataFrame:
    return runs.where("finished_at is not null").groupBy("definition").agg(F.max("finished_at").alias("finished_at"))


def expired(runs: DataFrame, success_cutoff: Column, other_cutoff: Column) -> DataFrame:
    """Ended runs that finished (else began) at their cutoff or before, or have no date."""
    ended = F.coalesce("finished_at", "creation")
    return runs.where(F.col("status").isin(*DONE) & (ended.isNull() | (ended <= F.when(F.col("status") == "Success", success_cutoff).otherwise(other_cutoff))))


def without(items: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    return items.join(gone.select(on).distinct(), on, "left_anti").select(items.columns)


def cleared(rows: DataFrame, gone: DataFrame, reference: str, key: str) -> DataFrame:
    """rows with reference null where it names a removed one."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return rows.join(ids, F.col(reference) == F.col("_gone"), "left").withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).select(rows.columns)


def recovered(runs: DataFrame, cutoff: Column) -> DataFrame:
    """Active runs without a sign of life after the cutoff end: queued ones as Skipped, running ones as Error."""
    seen = F.coalesce("modified", "started_at", "creation")
    stale = F.col("status").isin(*ACTIVE) & F.coalesce(seen <= cutoff, F.lit(False))
    return runs.withColumn("status", F.when(stale & (F.col("status") == "Queued"), "Skipped").when(stale, "Error").otherwise(F.col("status")))


def overdue(definitions: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Enabled definitions whose next run is due, or whose last one ended before the previous tick."""
    last = latest_runs(runs).withColumnRenamed("finished_at", "last_finished")
    due = F.when(F.col("next_run_at").isNotNull(), F.col("next_run_at") <= now).otherwise(F.col("last_finished").isNull() | (F.col("last_finished") < F.col("previous_tick")))
    return definitions.join(last, "definition", "left").where(F.col("enabled") & F.coalesce(due, F.lit(False)))


def watermarks(runs: DataFrame) -> DataFrame:
    """Of each definition the start of its last run that succeeded and was no dry run."""
    return runs.where("status = 'Success' and not dry_run").groupBy("definition").agg(F.max_by("started_at", F.struct("started_at", "run")).alias("watermark"))


def audit(plan: DataFrame, run: str, started_at: Column) -> DataFrame:
    """A row for each decision of a plan, as an append to the items of all runs."""
    kept = [c for c in ("definition", "direction", "write_direction", "action", "status", "message", "record_key", "change_count", "changed_fields", "changes", "payload", "local_before", "remote_before") if c in plan.columns]
    return plan.select(F.lit(run).alias("run"), started_at.alias("started_at"), *kept)


def finished(counts: DataFrame, definition: str, run: str, started_at: Column, finished_at: Column, dry_run: bool = False) -> DataFrame:
    """The run's own row: appended last, when all else is written, it alone moves the watermark, and only on success of a run that was not dry."""
    s = summary(counts)
    return s.select(F.lit(run).alias("run"), F.lit(definition).alias("definition"), F.col("run_status").alias("status"), "summary", started_at.alias("started_at"), finished_at.alias("finished_at"), F.lit(dry_run).alias("dry_run"), "processed", *ACTIONS)
