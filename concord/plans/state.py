"""Keyed state with revisions: what is tracked for each record, and what a new version of it changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import idempotency_key
from ..operators.joins import in_tasks
from ..operators.shared import checkpoint, claim, claims
from .runs import counters

DECISIONS = ("create", "reverse", "replace", "skip", "error")


def prepared(records: DataFrame, state: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """records (record_key, fingerprint, ...) with their state, and with targets found by key where there is none yet."""
    s = state.select("record_key", F.col("fingerprint").alias("old_fingerprint"), "revision", "documents", "state", F.col("state").alias("old_state"), F.col("documents").alias("old_documents"), F.lit(True).alias("known"))
    none = F.array().cast("array<string>")
    out = records.join(s, "record_key", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "revision": F.coalesce("revision", F.lit(0)), "documents": F.coalesce("documents", none), "old_documents": F.coalesce("old_documents", none)})
    if targets is None:
        return out
    found = targets.groupBy("record_key").agg(F.array_sort(F.collect_set("name")).alias("found"))
    out = out.join(found, "record_key", "left")
    return out.withColumn("documents", F.when(~F.col("known") & F.col("found").isNotNull(), F.col("found")).otherwise(F.col("documents"))).drop("found")


def alias_faults(records: DataFrame, state: DataFrame) -> DataFrame:
    """(record_key, fault): an alias claimed twice, emitted as a record too, or owned elsewhere; and records that were absorbed."""
    claims = records.select("record_key", F.explode("aliases").alias("alias")).where("alias <> record_key")
    twice = claims.join(claims.groupBy("alias").agg(F.countDistinct("record_key").alias("n")).where("n > 1"), "alias").select("record_key", F.lit("alias is claimed twice").alias("fault"))
    emitted = claims.join(records.select(F.col("record_key").alias("alias")), "alias").select("record_key", F.lit("alias is emitted too").alias("fault"))
    owned = claims.join(state.where("alias_of is not null").select(F.col("record_key").alias("alias"), "alias_of"), "alias").where("alias_of <> record_key").select("record_key", F.lit("alias is owned elsewhere").alias("fault"))
    split = records.join(state.where("alias_of is not null").select("record_key"), "record_key", "left_semi").select("record_key", F.lit("record was absorbed").alias("fault"))
    return twice.unionByName(emitted).unionByName(owned).unionByName(split).distinct()


def alias_documents(records: DataFrame, state: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(record_key, alias_documents): documents of the records that each one absorbs; of those never seen, the targets of their key."""
    claims = records.select("record_key", F.explode("aliases").alias("alias")).where("alias <> record_key")
    docs = state.select(F.col("record_key").alias("alias"), F.explode("documents").alias("document"))
    if targets is not None:
        docs = docs.unionByName(targets.join(state.select("record_key"), "record_key", "left_anti").select(F.col("record_key").alias("alias"), F.col("name").alias("document")))
    return claims.join(docs, "alias").groupBy("record_key").agg(F.array_sort(F.collect_set("document")).alias("alias_documents"))


def target_documents(prepared_: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """Current rows of the tracked documents, in order of name."""
    names = prepared_.select("record_key", F.explode("documents").alias("name"))
    return names.join(targets.select("name", *columns), "name").groupBy("record_key").agg(F.array_sort(F.collect_list(F.struct("name", *columns))).alias("existing"))


def guarded(documents: DataFrame, company: str | None = None) -> DataFrame:
    """(record_key, fault) from document rows (record_key, name, company, docstatus, reversed)."""
    fault = F.when(F.lit(company is not None) & (F.col("company") != F.lit(company)), "document of another company").when(F.col("docstatus") == 2, "document was cancelled outside").when(F.col("reversed"), "document was reversed outside")
    return documents.withColumn("fault", fault).where("fault is not null").groupBy("record_key").agg(F.min("fault").alias("fault"))


def decide(prepared_: DataFrame, rule: Callable[[DataFrame], DataFrame] | None = None, create_new: bool = True, update_existing: bool = True) -> DataFrame:
    """prepared rows with action and fault. rule adds action (and may change state); without it a new record is created,
    a changed one replaced, a record of no payload reversed and an unchanged one skipped.

    Rows that come with a fault, and decisions that the state forbids, are errors: create needs create_new and no document,
    replace needs create_new too, reverse and replace need documents, update_existing and, where existing has them, that all are
    submitted; a state must be a JSON object.
    """
    if rule:
        out = rule(prepared_)
    else:
        has = F.size("documents") > 0
        out = prepared_.withColumn("action", F.when(F.col("removed"), F.when(has, "reverse").otherwise("skip")).when(~has, "create").when(F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")), "skip").otherwise("replace"))
    has, action = F.size("documents") > 0, F.col("action")
    known = F.col("fault") if "fault" in prepared_.columns else F.lit(None).cast("string")
    open_ = F.exists("existing", lambda x: F.coalesce(x["docstatus"] != 1, F.lit(True))) if "existing" in prepared_.columns else F.lit(False)
    fault = (
        F.when(known.isNotNull(), known)
        .when(action.isNull() | ~action.isin(*DECISIONS), "no such action")
        .when(action == "error", F.col("message") if "message" in out.columns else F.lit("error"))
        .when(action.isin("create", "replace") & F.lit(not create_new), "creating is off")
        .when((action == "create") & has, "create would make a second document")
        .when(action.isin("reverse", "replace") & (~has | F.lit(not update_existing)), "nothing to change")
        .when(action.isin("reverse", "replace") & open_, "a document is not submitted")
        .when(F.col("state").isNotNull() & ~F.coalesce(F.trim("state").startswith("{") & F.try_parse_json("state").isNotNull(), F.lit(False)), "the state is no object")
    )
    return out.withColumns({"fault": fault, "action": F.when(fault.isNotNull(), "error").otherwise(action)})


def reversals(decided: DataFrame, existing: DataFrame, definition: str) -> DataFrame:
    """A reversal for each tracked document of records to be reversed or replaced, unless there is one. Its key makes a replay harmless."""
    rows = decided.where(F.col("action").isin("reverse", "replace")).select("record_key", "revision", F.explode("documents").alias("reversal_of"))
    rows = rows.join(existing.select("reversal_of").distinct(), "reversal_of", "left_anti")
    return rows.withColumn("idempotency_key", idempotency_key(F.lit(definition), F.col("record_key"), F.col("revision"), F.col("reversal_of")))


def next_state(decided: DataFrame, state: DataFrame) -> DataFrame:
    """The state table after a run: the revision rises only where fingerprint, state or documents have changed; aliases are redirected.

    An alias that already points to its record and has no documents is settled and stays as it is. Errors change nothing.
    """
    new_docs = F.when(F.col("action").isin("create", "replace"), F.array(F.concat_ws("-", "record_key", (F.col("revision") + 1).cast("string")))).when(F.col("action") == "reverse", F.array().cast("array<string>")).otherwise(F.col("documents"))
    fine = decided.where("action <> 'error'")
    own = fine.withColumn("new_documents", new_docs)
    changed = ~F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")) | (F.col("new_documents") != F.col("old_documents")) | ~F.col("state").eqNullSafe(F.col("old_state"))
    own = own.select("record_key", "fingerprint", (F.col("revision") + changed.cast("int")).alias("revision"), F.col("new_documents").alias("documents"), "state", F.lit(None).cast("string").alias("alias_of"))
    columns = ["record_key", "fingerprint", "revision", "documents", "state", "alias_of"]
    if "aliases" in decided.columns:
        taken = fine.select(F.col("record_key").alias("owner"), F.explode("aliases").alias("record_key")).where("owner <> record_key").distinct()
        old = state.select("record_key", "revision", "alias_of", (F.size("documents") > 0).alias("has"))
        moved = taken.join(old, "record_key", "left").where(F.coalesce("has", F.lit(True)) | ~F.col("alias_of").eqNullSafe(F.col("owner")))
        none = F.lit(None).cast("string")
        own = own.unionByName(moved.select("record_key", none.alias("fingerprint"), (F.coalesce("revision", F.lit(0)) + 1).alias("revision"), F.array().cast("array<string>").alias("documents"), none.alias("state"), F.col("owner").alias("alias_of")))
    rest = state.join(own.select("record_key"), "record_key", "left_anti").select(*columns)
    return own.select(*columns).unionByName(rest)


def stale_plans(decided: DataFrame, current: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """decided with an error where state, or a target (name, modified) that it was planned with, has moved since.

    What was planned with is the row's revision and its existing documents.
    """
    now = current.select("record_key", F.col("revision").alias("_now"))
    out = decided.join(now, "record_key", "left").withColumn("_fault", F.when(F.coalesce("_now", F.lit(0)) != F.col("revision"), "state has changed since"))
    if targets is not None:
        seen = decided.select("record_key", F.explode("existing").alias("e")).select("record_key", F.col("e.name").alias("name"), F.col("e.modified").alias("_was"))
        moved = seen.join(targets.select("name", "modified"), "name", "left").where(~F.col("_was").eqNullSafe(F.col("modified"))).select("record_key").distinct().withColumn("_moved", F.lit(True))
        out = out.join(moved, "record_key", "left").withColumn("_fault", F.coalesce("_fault", F.when(F.col("_moved"), "a document has changed since"))).drop("_moved")
    return out.withColumns({"fault": F.coalesce("_fault", "fault"), "action": F.when(F.col("_fault").isNotNull(), "error").otherwise(F.col("action"))}).drop("_now", "_fault")


def logged(decided: DataFrame, log_unchanged: bool = False) -> DataFrame:
    """Items worth a row: not the unchanged ones (state, documents and all aliases settled as before), unless they warn."""
    quiet = (F.col("action") == "skip") & F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")) & F.col("state").eqNullSafe(F.col("old_state")) & (F.col("documents") == F.col("old_documents"))
    if "unsettled" in decided.columns:
        quiet = quiet & ~F.col("unsettled")
    if "warnings" in decided.columns:
        quiet = quiet & (F.size("warnings") <= 0)
    return decided if log_unchanged else decided.where(~quiet)


def unseen(state: DataFrame, records: DataFrame) -> DataFrame:
    """Records that a complete read lacks: an error each; their documents stay."""
    return state.where("alias_of is null").join(records.select("record_key").distinct(), "record_key", "left_anti").select("record_key", "documents", F.lit("error").alias("action"), F.lit("missing in the source").alias("fault"))


@dataclass(frozen=True)
class Job:
    """What one run of a stateful job comes to: decisions, items to log, reversals to write, the state after it and its counts."""

    decided: DataFrame
    items: DataFrame
    reversals: DataFrame
    state: DataFrame
    counters: DataFrame


#: Runs count a decision as one of their actions.
ACTION_OF = {"create": "created", "replace": "updated", "reverse": "updated", "skip": "skipped", "error": "error"}


def job(definition: str, records: DataFrame, state: DataFrame, targets: DataFrame | None = None, reversed_: DataFrame | None = None, rule: Callable[[DataFrame], DataFrame] | None = None, company: str | None = None, columns: list[str] = (), create_new: bool = True, update_existing: bool = True, log_unchanged: bool = False) -> Job:
    """A whole stateful run over a complete read of records (record_key, fingerprint, removed, and if there are aliases and warnings).

    Each record meets its state, or where it has none the targets (record_key, name, company, docstatus, modified, reversed) of
    its key; documents of absorbed records join its own. Faulty aliases, records that were absorbed, and documents of another company
    or cancelled or reversed outside are errors before rule decides; existing has the documents' columns for it. Warnings are
    carried to the items' message. Records of the state that the read lacks are errors, and keep their documents.
    """
    none = F.array().cast("array<string>")
    # all joins by record_key are in one stage, where each keeps its sorted rows
    n = records.select("record_key").count() + state.select("record_key").count()
    records, by_key = in_tasks(records, "record_key", n), in_tasks(state, "record_key", n)
    own = prepared(records, by_key, targets)
    own = own if "aliases" in records.columns else own.withColumn("aliases", none)
    faults = alias_faults(own.select("record_key", "aliases"), state)
    more = alias_documents(own.select("record_key", "aliases"), state, targets)
    own = own.join(more, "record_key", "left").withColumn("documents", F.array_distinct(F.concat("documents", F.coalesce("alias_documents", none)))).drop("alias_documents")
    if targets is not None:
        names = list(dict.fromkeys(["company", "docstatus", "modified", *columns]))
        documents = own.select("record_key", F.explode("documents").alias("name")).join(targets.drop("record_key"), "name")
        faults = faults.unionByName(guarded(documents, company))
        own = own.join(target_documents(own, targets, names), "record_key", "left")
        own = own.withColumn("existing", F.coalesce("existing", F.array().cast(dict(own.dtypes)["existing"])))
    first = faults.groupBy("record_key").agg(F.min("fault").alias("fault"))
    unsettled = own.select("record_key", F.explode("aliases").alias("alias")).where("alias <> record_key").join(state.select(F.col("record_key").alias("alias"), "alias_of", (F.size("documents") > 0).alias("has")), "alias", "left")
    unsettled = unsettled.where(F.coalesce("has", F.lit(True)) | ~F.col("alias_of").eqNullSafe(F.col("record_key"))).select("record_key").distinct().withColumn("unsettled", F.lit(True))
    own = own.join(first, "record_key", "left").join(unsettled, "record_key", "left").withColumn("unsettled", F.coalesce("unsettled", F.lit(False)))
    decided = decide(own, rule, create_new, update_existing)
    return _come_to(definition, decided, records, by_key, reversed_, log_unchanged)


def _come_to(definition: str, decided: DataFrame, records: DataFrame, state: DataFrame, reversed_: DataFrame | None, log_unchanged: bool) -> Job:
    """What decisions come to over a state."""
    seen = records.select("record_key").unionByName(decided.where("action <> 'error'").select(F.explode("aliases").alias("record_key")))
    lost = unseen(state, seen)
    warn = F.concat_ws("; ", "warnings") if "warnings" in records.columns else F.lit("")
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_OF.items() for x in kv]), F.col("action"))
    shown = lambda df: df.withColumns({"message": F.concat_ws(" | ", F.coalesce("fault", "action"), F.nullif(warn, F.lit(""))), "decision": F.col("action"), "action": action}).select("record_key", "action", "decision", "message", (warn != "").alias("warns"))
    gone = lost.select("record_key", F.lit("error").alias("action"), F.lit("error").alias("decision"), F.col("fault").alias("message"), F.lit(False).alias("warns"))
    items = shown(logged(decided, log_unchanged)).unionByName(gone)
    counted = shown(decided).unionByName(gone).withColumn("status", F.when(F.col("action") == "error", "error").when(F.col("action") == "skipped", "skipped").otherwise("success"))
    done = reversed_ if reversed_ is not None else decided.sparkSession.createDataFrame([], "reversal_of string")
    return Job(decided, items, reversals(decided, done, definition), next_state(decided, state), counters(counted))


class StateTable:
    """A state table in versions, of which each is committed by one job only: by taking its number."""

    SCHEMA = "record_key string, fingerprint string, revision int, documents array<string>, state string, alias_of string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> tuple[int, DataFrame]:
        """The last version and its rows; 0 and none if there is no version yet."""
        done = claims(self.spark, f"{self.folder}/commits")
        if not done:
            return 0, self.spark.createDataFrame([], self.SCHEMA)
        last = max(done)
        return int(last), self.spark.read.schema(self.SCHEMA).parquet(done[last])

    def commit(self, after: int, rows: DataFrame) -> bool:
        """Makes rows the version after the one that was read; False, and nothing is changed, if another job has been faster."""
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], self.SCHEMA).columns).write.parquet(path)
        return claim(self.spark, f"{self.folder}/commits", f"{after + 1:012d}", path)


def moved_since(before: DataFrame, now: DataFrame) -> DataFrame:
    """(record_key): records whose state another job has written, made or taken away between two versions."""
    was, is_ = (df.select("record_key", F.struct("fingerprint", "revision", "documents", "state", "alias_of").alias(name)) for df, name in ((before, "_was"), (now, "_is")))
    return was.join(is_, "record_key", "full_outer").where(~F.col("_was").eqNullSafe(F.col("_is"))).select("record_key")


def run_state(table: StateTable, definition: str, records: DataFrame, targets: Callable[[], DataFrame] | None = None, reversed_: DataFrame | None = None, log_unchanged: bool = False, **more) -> Job:
    """A whole stateful job whose state is written only over the state that it was planned with.

    If another job has committed since, what that job has written is compared with what this one was planned with: records (and those that absorb them) whose
    state has moved, and those whose target documents have, become errors and keep what the other job has left; the others are put over the
    new state and committed again, until no job comes between. targets is read again each time.
    """
    version, known = table.read()
    found = targets() if targets else None
    first = job(definition, records, known, found, reversed_, log_unchanged=log_unchanged, **more)
    decided = checkpoint(first.decided)
    done = _come_to(definition, decided, records, known, reversed_, log_unchanged)
    while not table.commit(version, done.state):
        version, now = table.read()
        moved = moved_since(known, now)
        names = decided.select("record_key", F.explode(F.array_append("aliases", F.col("record_key"))).alias("_name"))
        stale = names.join(moved.withColumnRenamed("record_key", "_name"), "_name", "left_semi").select("record_key").distinct().withColumn("_moved", F.lit(True))
        late = decided.join(stale, "record_key", "left")
        again = late.withColumns({"fault": F.when(F.col("_moved"), F.coalesce("fault", F.lit("state has changed since"))).otherwise(F.col("fault")), "action": F.when(F.col("_moved"), "error").otherwise(F.col("action"))}).drop("_moved")
        if targets:
            seen = again.select("record_key", F.explode("existing").alias("e")).select("record_key", F.col("e.name").alias("name"), F.col("e.modified").alias("_old"))
            other = seen.join(targets().select("name", "modified"), "name", "left").where(~F.col("_old").eqNullSafe(F.col("modified"))).select("record_key").distinct().withColumn("_moved", F.lit(True))
            again = again.join(other, "record_key", "left").withColumns({"fault": F.coalesce("fault", F.when(F.col("_moved"), "a document has changed since")), "action": F.when(F.col("_moved"), "error").otherwise(F.col("action"))}).drop("_moved")
        done = _come_to(definition, checkpoint(again), records, now, reversed_, log_unchanged)
    return done
