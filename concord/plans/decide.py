"""Plans: every record classified as created, updated, deleted, skipped, conflict or error, with its changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank, changed_fields, changed_since, compare_modified, effective_modified, fit
from ..operators.diff import CHANGES, field_changes, worked_out
from ..operators.joins import join_hot
from ..operators.mapping import project
from ..operators.matching import address, identity_pairs, key_set, last_per_key, match_all, match_first, match_identity_all, match_identity_first, might_match, missing, pair_by_token, prefixed, with_key
from ..operators.shared import checkpoint
from .spec import Definition, DefinitionError

PLAN = ["definition", "direction", "write_direction", "action", "status", "message", "record_key", "match_kind", "change_count", "changed_fields", "changes", "payload", "local_before", "remote_before"]
#: By what a plan is applied: the target row's address (null for a new one), what a new row is known by should it be there already,
#: the source's stamps as text, and the source's order, by which the last of several writes to one row counts.
APPLIED = ["address", "create_key", "source_modified", "source_creation", "ordinal"]


def resolve_conflict(local: Column, remote: Column, watermark: Column | None, buffer_ms: int = 100, policy: str = "newest_wins", tie_breaker: str = "manual") -> Column:
    """Which side wins, from effective stamps: {local,remote}_{changed,newest,tie}, manual or unsupported."""
    l, r = changed_since(local, watermark), changed_since(remote, watermark)  # noqa: E741
    side = compare_modified(local, remote, buffer_ms)
    tie = {"local": "local_tie", "remote": "remote_tie"}.get(tie_breaker, "manual")
    out = F.when(l & ~r, "local_changed").when(r & ~l, "remote_changed")
    if policy != "newest_wins":
        return out.otherwise("unsupported")
    return out.when(side == "local", "local_newest").when(side == "remote", "remote_newest").otherwise(tie)


def _classified(d: Definition, way: str, valid: Column, matched: Column, changes: Column) -> dict[str, Column]:
    """action, status and message of a one-way record. A pull whose updates are off skips a match before it is compared."""
    n = F.size(changes)
    action = F.when(~valid, "error").when(~matched, F.lit("created" if d.create_new else "skipped"))
    if way == "pull" and not d.update_existing:
        action = action.otherwise("skipped")
    else:
        action = action.when(n == 0, "skipped").otherwise("updated" if d.update_existing else "skipped")
    message = F.when(~valid, "match key is missing or blank").when(~matched & F.lit(not d.create_new), "creating is off").when(matched & (n > 0) & F.lit(not d.update_existing), "updating is off")
    return {"action": action, "status": F.when(action == "error", "error").otherwise("success"), "message": message}


def misfits(new: dict[str, Column], kinds: dict[str, str]) -> Column:
    """Which new values the target's columns cannot hold, as text; null if all fit. A value that does not fit must not become null in silence."""
    told = [F.when(v.isNotNull() & v.cast("string").try_cast(kinds[f]).isNull(), F.concat(F.lit(f"{f}: '"), fit(v.cast("string"), 40), F.lit(f"' is no {kinds[f]}"))) for f, v in new.items() if f in kinds and not kinds[f].startswith(("array", "struct", "map", "string", "binary"))]
    return F.nullif(F.concat_ws("; ", *told), F.lit("")) if told else F.lit(None).cast("string")


def _refused(out: DataFrame, told: Column) -> DataFrame:
    """Writes of values that do not fit are errors instead."""
    bad = F.col("action").isin("created", "updated") & told.isNotNull()
    return out.withColumns({"message": F.when(bad, told).otherwise(F.col("message")), "status": F.when(bad, "error").otherwise(F.col("status")), "action": F.when(bad, "error").otherwise(F.col("action"))})


def _as_one(met: DataFrame, d: Definition, target: DataFrame, own_id: str | None, order: list[str]) -> DataFrame:
    """Matches of one source row that cannot be written one by one, as some lack an id, as one row: one write by key covers them all.

    Rows of the target that share a key are counted within tasks, and what they say about it is sent to hot keys in parts. The
    row kept is the last match; it counts as changed if any match differs.
    """
    has = ~blank(F.col(own_id)) if own_id else F.lit(False)
    groups = checkpoint(target.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min(has).alias("_each")).where("n > 1 and not _each").select("key", "n"))
    alone = [F.lit(False).alias("_all"), F.lit(None).cast("long").alias("_n")]
    if groups.isEmpty():
        return met.select("*", *alone)
    met = checkpoint(met)
    by_key = join_hot(met.where("match_kind = 'key'"), groups, ["key"], [F.xxhash64(F.to_json("_row"))])
    last = F.struct((F.size("changes") > 0).cast("int"), *[F.col(f"t_{c}") for c in order], F.xxhash64(*[F.col(c) for c, kind in met.dtypes if c.startswith("t_") and "map<" not in kind]))
    many = by_key.groupBy("key", F.md5(F.to_json("_row")).alias("_source")).agg(F.max_by(F.struct(*met.columns), last).alias("r"), F.max("n").alias("_n"))
    one = many.select("r.*", F.lit(True).alias("_all"), "_n")
    others = met.where("match_kind = 'key'").join(groups.select("key"), "key", "left_anti").select(*met.columns, *alone)
    return one.unionByName(others).unionByName(met.where("match_kind <> 'key'").select("*", *alone))


def _row_json(df: DataFrame, prefix: str, but: set[str]) -> Column:
    names = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :] not in but]
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c[len(prefix) :]) for c in names]), {"ignoreNullFields": "false"})


def one_way_plan(local: DataFrame, remote: DataFrame, d: Definition, way: str | None = None, images: bool = False, prefetch: bool = False) -> DataFrame:
    """The plan of a push or a pull. images adds the rows before the write as JSON.

    If the definition deletes what is missing, target rows whose key no source row has are part of the plan; both sides must then
    be read completely. With prefetch, target rows that no source row can match are left out before they are shuffled, by a filter
    of the source's keys (see might_match). A definition of both directions is no one-way plan, unless way says which half is meant.
    """
    way = way or d.direction
    if way not in ("push", "pull"):
        raise DefinitionError("a definition of both directions has no one-way plan")
    source, target = (local, remote) if way == "push" else (remote, local)
    source_keys, target_keys = (list(d.match_fields), d.remote_keys) if way == "push" else (d.remote_keys, list(d.match_fields))
    order = list(d.remote_order if way == "push" else d.local_order)
    source_order = list(d.local_order if way == "push" else d.remote_order)
    flat = with_key(source, source_keys)
    own = project(flat.withColumn("_row", F.struct(*source.columns)), d, way, keep=["key", "_row"])
    own = stamp_links(own, d, way) if d.identity else own
    fields = [c for c in own.columns if c not in ("key", "_row")]
    own = own.select("key", "_row", F.struct(*[F.col(f"`{f}`") for f in fields]).alias("_payload"))
    if way == "pull":
        own = own.where("key is null").unionByName(last_per_key(own.withColumn("_order", F.struct(*[F.col("_row")[c] for c in d.remote_order]) if d.remote_order else F.lit(0)), ["key"], ["_order"]).drop("_order")) if d.match_mode == "first_match" else own
    whole, target = target, with_key(target, target_keys)
    if d.identity:
        ids = (d.identity.local_remote_id, d.identity.remote_id) if way == "push" else (d.identity.remote_id, d.identity.local_remote_id)
        own = own.withColumn("_id", F.col("_row")[ids[0]])
        near = might_match(target, own, ids[1], "_id") if prefetch else target
        met = match_identity_first(own, near, "_id", ids[1], order) if d.match_mode == "first_match" else match_identity_all(own, near, "_id", ids[1])
    else:
        near = might_match(target, own) if prefetch else target
        met = match_first(own, near, order) if d.match_mode == "first_match" else match_all(own, near)
        met = met.withColumn("match_kind", F.when(F.col("t_key").isNotNull(), "key").otherwise("none"))
    typed = dict(target.dtypes)
    new, old = {f: F.col("_payload")[f] for f in fields if f in target.columns}, {f: F.col(f"t_{f}") for f in fields if f in target.columns}
    stamps = tuple(s for s in (d.local_modified, d.local_creation, d.remote_modified, d.remote_creation) if s)
    rename = {m.remote: m.local for m in d.mapped(way)} if way == "push" else {}
    kinds = {f: ("boolean" if k == "boolean" else k if k.startswith(("array", "struct", "map")) else "string") for f, k in typed.items()}
    matched = F.col("match_kind") != "none"
    met = worked_out(met, changes=F.when(matched, field_changes(new, old, kinds, stamps, rename)).otherwise(F.array().cast(CHANGES)))
    columns = met.columns
    grouped = d.match_mode == "all_matches"
    met = _as_one(met, d, near, d.own_id(way), order) if grouped else met
    by_id = matched & (F.col("match_kind") == "id")
    out = met.withColumns(_classified(d, way, F.col("key").isNotNull() | by_id, matched, F.col("changes")))
    if grouped:
        out = out.withColumn("message", F.when(F.col("_all") & (F.col("action") == "updated"), F.concat(F.lit("one write for "), F.col("_n").cast("string"), F.lit(" matched rows"))).otherwise(F.col("message")))
    out = _refused(out, misfits(new, typed))
    before = _row_json(met.select(*columns), "t_", {"key"})
    source_json = F.to_json(F.col("_row"))
    extra = {"local_before": source_json if way == "push" else before, "remote_before": before if way == "push" else source_json} if images else {"local_before": F.lit(None).cast("string"), "remote_before": F.lit(None).cast("string")}
    at = F.when(matched, address(lambda c: F.col(f"t_{c}"), d.own_id(way), target_keys))
    at = F.when(F.col("_all"), F.concat(F.lit("all="), F.col("key"))).otherwise(at) if grouped else at
    row = lambda c: F.col("_row")[c].cast("string") if c and c in source.columns else F.lit(None).cast("string")
    modified, creation = (d.local_modified, d.local_creation) if way == "push" else (d.remote_modified, d.remote_creation)
    applied = {"address": at, "create_key": F.col("key"), "source_modified": row(modified), "source_creation": row(creation), "ordinal": F.struct(*[F.col("_row")[c].alias(c) for c in source_order], F.xxhash64(source_json).alias("_hash"))}
    out = _planned(out.withColumns({"payload": F.to_json("_payload", {"ignoreNullFields": "false"}), "write_direction": F.lit(way), **extra, **applied}), d, F.col("key"))
    return out.unionByName(deletions(*((local, whole) if way == "push" else (whole, remote)), d, way), allowMissingColumns=True) if d.delete_missing and d.match_fields else out


def _planned(df: DataFrame, d: Definition, key: Column) -> DataFrame:
    return df.withColumns({"definition": F.lit(d.name), "direction": F.lit(d.direction), "record_key": key, "change_count": F.size("changes"), "changed_fields": fit(changed_fields(F.col("changes")))}).select(*PLAN, *[c for c in APPLIED if c in df.columns])


def deletions(local: DataFrame, remote: DataFrame, d: Definition, way: str) -> DataFrame:
    """The plan's deletes: target rows whose key the complete source lacks."""
    source, target = (local, remote) if way == "push" else (remote, local)
    names = (list(d.match_fields), d.remote_keys) if way == "push" else (d.remote_keys, list(d.match_fields))
    gone = missing(with_key(target, names[1]), key_set(with_key(source, names[0])))
    none = F.lit(None).cast("string")
    out = gone.withColumns({"action": F.lit("deleted" if d.delete_missing else "skipped"), "status": F.lit("success"), "message": F.lit("missing in the source"), "match_kind": F.lit("none"), "changes": F.array().cast("array<struct<field: string, old: string, new: string>>"), "payload": none, "write_direction": F.lit(way), "local_before": none, "remote_before": none, "address": address(F.col, d.own_id(way), names[1])})
    return _planned(out, d, F.col("key"))


def _sides(local: DataFrame, remote: DataFrame, d: Definition) -> tuple[DataFrame, DataFrame]:
    """Both sides with their key, their row and what they would write on the other side; links are stamped where the definition has identities."""
    left = project(with_key(local, list(d.match_fields)) if d.match_fields else local.withColumn("key", F.lit(None).cast("string")), d, "push", keep=[F.col("key"), F.struct(*local.columns).alias("_row")])
    right = project(with_key(remote, d.remote_keys) if d.match_fields else remote.withColumn("key", F.lit(None).cast("string")), d, "pull", keep=[F.col("key"), F.struct(*remote.columns).alias("_row")])
    if d.identity:
        left, right = stamp_links(left, d, "push"), stamp_links(right, d, "pull")
    payload = lambda df: df.select("key", "_row", F.struct(*[c for c in df.columns if c not in ("key", "_row")]).alias("payload"))
    return payload(left), payload(right)


def stamp_links(df: DataFrame, d: Definition, way: str) -> DataFrame:
    """Projected rows with the other side's link: a push carries the local id, a pull the remote one; a blank id stamps nothing."""
    source, target = (d.identity.local_pk, d.identity.remote_link) if way == "push" else (d.identity.remote_id, d.identity.local_remote_id)
    own = F.col("_row")[source]
    old = F.col(target) if target in df.columns else F.lit(None)
    return df.withColumn(target, F.when(~blank(own), own.cast("string")).otherwise(old.cast("string")))


def _compared(pairs: DataFrame, d: Definition, watermark: Column | None) -> DataFrame:
    """A plan's columns for pairs (l__row, l_payload, r__row, r_payload; a side that is not there is null) by what changes either way and who wins."""
    l, r = F.col("l__row"), F.col("r__row")  # noqa: E741
    to_remote, to_local = (list(dict(pairs.select(f"{c}.*").dtypes)) for c in ("l_payload", "r_payload"))
    theirs, ours = pairs.select("r__row.*").columns, pairs.select("l__row.*").columns
    push = field_changes({f: F.col("l_payload")[f] for f in to_remote if f in theirs}, {f: r[f] for f in to_remote if f in theirs}, rename={m.remote: m.local for m in d.mapped("push")})
    pull = field_changes({f: F.col("r_payload")[f] for f in to_local if f in ours}, {f: l[f] for f in to_local if f in ours})
    stamp_l = effective_modified(l[d.local_modified], l[d.local_creation]) if d.local_creation else effective_modified(l[d.local_modified], F.lit(None))
    stamp_r = effective_modified(r[d.remote_modified], r[d.remote_creation], d.remote_zone, d.local_zone)
    out = worked_out(pairs, push=push, pull=pull, outcome=resolve_conflict(stamp_l, stamp_r, watermark, d.buffer_ms, d.policy, d.tie_breaker))
    alone_l, alone_r = r.isNull(), l.isNull()
    same = (F.size("push") == 0) & (F.size("pull") == 0)
    to_remote_wins = F.col("outcome").startswith("local")
    conflict = F.col("outcome").isin("manual", "unsupported")
    action = F.when(alone_l | alone_r, F.lit("created" if d.create_new else "skipped")).when(same, "skipped").when(conflict, "conflict").when((to_remote_wins & (F.size("push") == 0)) | (~to_remote_wins & (F.size("pull") == 0)), "skipped").otherwise("updated" if d.update_existing else "skipped")
    way = F.when(alone_l, "push").when(alone_r, "pull").when(same | conflict, F.lit(None)).when(to_remote_wins, "push").otherwise("pull")
    none = F.lit(None).cast("string")
    changes = F.when(alone_l | alone_r | same, F.array().cast(CHANGES)).when(F.col("outcome").startswith("remote"), F.col("pull")).otherwise(F.col("push"))
    # A conflict carries what either choice would write.
    choices = F.to_json(F.struct(F.col("r_payload").alias("to_local"), F.col("l_payload").alias("to_remote")), {"ignoreNullFields": "false"})
    payload = F.when(conflict & ~same & ~alone_l & ~alone_r, choices).when(way == "push", F.to_json("l_payload", {"ignoreNullFields": "false"})).when(way == "pull", F.to_json("r_payload", {"ignoreNullFields": "false"}))
    ours_at, theirs_at = address(lambda c: l[c], d.own_id("pull"), d.target_keys("pull")), address(lambda c: r[c], d.own_id("push"), d.target_keys("push"))
    from_ = lambda side, c: side[c].cast("string") if c else none
    applied = {
        "address": F.when(~alone_l & (way == "push"), theirs_at).when(~alone_r & (way == "pull"), ours_at),
        "source_modified": F.when(way == "push", from_(l, d.local_modified)).when(way == "pull", from_(r, d.remote_modified)), "source_creation": F.when(way == "push", from_(l, d.local_creation)).when(way == "pull", from_(r, d.remote_creation)),
    }
    out = out.withColumns({"action": action, "status": F.when(action == "conflict", "conflict").otherwise("success"), "message": F.when(alone_l | alone_r | same, none).otherwise(F.col("outcome")), "changes": changes, "payload": payload, "write_direction": way, "local_before": none, "remote_before": none, **applied})
    theirs_kinds, ours_kinds = (dict(pairs.select(f"{x}.*").dtypes) for x in ("r__row", "l__row"))
    told = F.when(F.col("write_direction") == "push", misfits({f: F.col("l_payload")[f] for f in to_remote}, theirs_kinds)).when(F.col("write_direction") == "pull", misfits({f: F.col("r_payload")[f] for f in to_local}, ours_kinds))
    return _refused(out, told)


def both_ways_plan(local: DataFrame, remote: DataFrame, d: Definition, watermark: Column | None = None) -> DataFrame:
    """Pairs of one key, compared in both directions; a side alone is created on the other, a difference goes to the side that wins."""
    left, right = _sides(local, remote, d)
    left = left.select(F.col("key").alias("token"), "_row", "payload", *[F.col("_row")[c].alias(f"_o{i}") for i, c in enumerate(d.local_order)])
    right = right.select(F.col("key").alias("token"), "_row", "payload", *[F.col("_row")[c].alias(f"_o{i}") for i, c in enumerate(d.remote_order)])
    pairs = pair_by_token(left, right, [f"_o{i}" for i in range(len(d.local_order))], [f"_o{i}" for i in range(len(d.remote_order))])
    out = _compared(pairs, d, watermark)
    return _planned(out.withColumns({"match_kind": F.when(F.col("l_token").isNull() | F.col("r_token").isNull(), "none").otherwise("key"), "create_key": F.col("token")}), d, F.col("token"))


def identity_plan(local: DataFrame, remote: DataFrame, d: Definition, watermark: Column | None = None, full: bool = True) -> DataFrame:
    """The both-way plan by stored ids: conflicts, pairs, deletes (of a full read, if the definition has them) and creates, as one table.

    Ids that rows claim twice or contradict each other on are conflicts, and every row that touches such an id stays out. A pair
    is compared in both directions, its links included. A row whose link leads nowhere is deleted or left alone, never created
    anew; one without a link is created on the other side, and its payload carries the link. Links of one id are enough for a pair.
    record_key is the JSON of the local and the remote id.
    """
    i = d.identity
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    l_ids = local.select(text(i.local_pk).alias("pk"), text(i.local_remote_id).alias("rid"))
    r_ids = remote.select(text(i.remote_id).alias("rid"), text(i.remote_link).alias("link"))
    pairs, conflicts, poisoned = map(checkpoint, identity_pairs(l_ids, r_ids))  # each is asked several times
    left, right = _sides(local, remote, d)
    left = prefixed(left.withColumns({"pk": F.nullif(F.trim(F.col("_row")[i.local_pk].cast("string")), F.lit("")), "rid": F.nullif(F.trim(F.col("_row")[i.local_remote_id].cast("string")), F.lit(""))}), "l_")
    right = prefixed(right.withColumns({"rid": F.nullif(F.trim(F.col("_row")[i.remote_id].cast("string")), F.lit("")), "link": F.nullif(F.trim(F.col("_row")[i.remote_link].cast("string")), F.lit(""))}), "r_")
    bad = {k: poisoned.where(F.col("kind") == k).select(F.col("value").alias(f"_{k}")) for k in ("local", "remote")}
    clean = lambda df, ours, theirs: df.join(bad["local"], F.col(ours) == F.col("_local"), "left_anti").join(bad["remote"], F.col(theirs) == F.col("_remote"), "left_anti")
    met = pairs.join(left, F.col("pk") == F.col("l_pk")).join(right, F.col("rid") == F.col("r_rid"))
    paired = pairs.select("pk").withColumn("_p", F.lit(True)), pairs.select("rid").withColumn("_p", F.lit(True))
    alone_l = clean(left, "l_pk", "l_rid").join(paired[0], F.col("l_pk") == F.col("pk"), "left_anti")
    alone_r = clean(right, "r_link", "r_rid").join(paired[1], F.col("r_rid") == F.col("rid"), "left_anti")
    rows = met.select(*left.columns, *right.columns).withColumn("match_kind", F.lit("id"))
    rows = rows.unionByName(alone_l.where("l_rid is null").withColumn("match_kind", F.lit("none")), allowMissingColumns=True)
    rows = rows.unionByName(alone_r.where("r_link is null").withColumn("match_kind", F.lit("none")), allowMissingColumns=True)
    ids = lambda pk, rid: F.to_json(F.struct(F.col(pk).alias("local"), F.col(rid).alias("remote")))
    out = _planned(_compared(rows, d, watermark).withColumn("create_key", F.coalesce("l_pk", "r_rid")), d, ids("l_pk", "r_rid"))
    none = F.lit(None).cast("string")
    plain = {"match_kind": F.lit("none"), "changes": F.array().cast(CHANGES), "payload": none, "local_before": none, "remote_before": none}
    told = conflicts.withColumns({"action": F.lit("conflict"), "status": F.lit("conflict"), "write_direction": none, **plain})
    out = out.unionByName(_planned(told, d, ids("pk", "rid")), allowMissingColumns=True)
    if d.delete_missing and full:
        gone = alone_l.where("l_pk is not null and l_rid is not null").select(F.col("l_pk").alias("pk"), F.col("l_rid").alias("rid"), F.lit("pull").alias("write_direction"))
        gone = gone.unionByName(alone_r.where("r_rid is not null and r_link is not null").select(F.col("r_link").alias("pk"), F.col("r_rid").alias("rid"), F.lit("push").alias("write_direction")))
        at = F.concat(F.lit("id="), F.when(F.col("write_direction") == "pull", F.col("pk")).otherwise(F.col("rid")))
        gone = gone.withColumns({"action": F.lit("deleted"), "status": F.lit("success"), "message": F.lit("missing on the other side"), "address": at, **plain})
        out = out.unionByName(_planned(gone, d, ids("pk", "rid")), allowMissingColumns=True)
    return out


def apply_row_rule(df: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's rule over the matched rows of a plan; it adds changed (boolean) and note. A skip that it changes is an update."""
    out = rule(df)
    return out.withColumns({"action": F.when((F.col("action") == "skipped") & F.col("changed"), "updated").otherwise(F.col("action")), "message": F.coalesce("note", "message")}).drop("changed", "note")


def refusals(items: DataFrame, choices: DataFrame, dry_run: bool = False, update_existing: bool = True) -> DataFrame:
    """(record_key, fault): choices (record_key, choice) that cannot be applied to a run's items, and why."""
    chosen = choices.groupBy("record_key").agg(F.max("choice").alias("choice"), F.countDistinct("choice").alias("_n"))
    found = chosen.join(items.groupBy("record_key").agg(F.max("action").alias("_action")), "record_key", "left")
    fault = (
        F.when(F.lit(dry_run), "the run was dry")
        .when(F.lit(not update_existing), "updating is off")
        .when(F.col("record_key").isNull(), "the item has no key")
        .when(F.col("_action").isNull(), "there is no such item")
        .when(F.col("_action") != "conflict", "the item is no open conflict")
        .when(F.col("_n") > 1, "both directions are chosen")
        .when(F.col("choice").isNull() | ~F.col("choice").isin("push", "pull"), "no direction is chosen")
    )
    return found.select("record_key", fault.alias("fault")).where("fault is not null")


def apply_resolutions(items: DataFrame, choices: DataFrame, dry_run: bool = False, update_existing: bool = True) -> DataFrame:
    """Open conflicts of a real run with a reviewer's choice (record_key, choice = push or pull): updated, with the chosen payload.

    Choices that refusals() names are left out.
    """
    fine = choices.join(refusals(items, choices, dry_run, update_existing).select("record_key"), "record_key", "left_anti")
    picked = fine.where("record_key is not null").select("record_key", "choice").distinct()
    out = items.where("action = 'conflict'").join(picked, "record_key")
    chosen = F.when(F.col("choice") == "push", F.get_json_object("payload", "$.to_remote")).otherwise(F.get_json_object("payload", "$.to_local"))
    return out.withColumns({"payload": chosen, "write_direction": F.col("choice"), "action": F.lit("updated"), "status": F.lit("success")}).select(items.columns)


__all__ = ["apply_resolutions", "apply_row_rule", "both_ways_plan", "deletions", "identity_plan", "one_way_plan", "refusals", "resolve_conflict"]
