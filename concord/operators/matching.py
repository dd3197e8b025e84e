"""Pairing rows of two sides by normalised keys or by stored identities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank, norm_key, valid_key
from .joins import dealt_key
from .mapping import key_parts
from .shared import checkpoint

SEPARATOR = "\x1f"


def with_key(df: DataFrame, names: list[str], key: str = "key") -> DataFrame:
    """df with one text for its match key, null where a part is missing or blank."""
    parts = key_parts(df, names)
    return df.withColumn(key, F.when(valid_key(parts), F.array_join(parts, SEPARATOR)))


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by order and then by the whole row; combined on the map side, so that a hot key is no burden."""
    row = F.struct(*df.columns)
    by = F.struct(*order, F.xxhash64(*df.columns)) if order else F.xxhash64(*df.columns)
    return df.where(F.col(keys[0]).isNotNull()).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, by).alias("r")).select("r.*")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in df.columns])


def match_all(source: DataFrame, target: DataFrame, key: str = "key") -> DataFrame:
    """Each source row with every target row of equal key (columns t_*), or with none. Keyless rows are dealt over all tasks."""
    t = prefixed(target.where(F.col(key).isNotNull()), "t_")
    return source.withColumn("_dealt", dealt_key(source, key)).join(t, F.col("_dealt") == F.col(f"t_{key}"), "left").drop("_dealt")


def match_first(source: DataFrame, target: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """Each source row with the last target row of equal key."""
    return match_all(source, last_per_key(target, [key], order), key)


def match_identity_first(source: DataFrame, target: DataFrame, source_id: str, target_id: str, order: list[str], key: str = "key") -> DataFrame:
    """By the stored id; by key only where that finds nothing. match_kind is id, key or none; the target's columns are t_*."""
    ids = last_per_key(target.withColumn("_id", norm_key(F.col(target_id))).where("_id <> ''"), ["_id"], order)
    by_id = F.struct(*target.columns)
    i = ids.select(F.col("_id").alias("_tid"), by_id.alias("_by_id"))
    k = last_per_key(target, [key], order).select(F.col(key).alias("_tkey"), by_id.alias("_by_key"))
    out = source.withColumn("_sid", F.nullif(norm_key(F.col(source_id)), F.lit("")))
    out = out.withColumns({"_sid": dealt_key(out, "_sid"), "_key": dealt_key(out, key)}).join(i, F.col("_sid") == F.col("_tid"), "left").join(k, F.col("_key") == F.col("_tkey"), "left")
    kind = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_key").isNotNull(), "key").otherwise("none")
    out = out.withColumns({"match_kind": kind, "_t": F.coalesce("_by_id", "_by_key")})
    return out.select(*source.columns, "match_kind", *[F.col("_t")[c].alias(f"t_{c}") for c in target.columns])


def match_identity_all(source: DataFrame, target: DataFrame, source_id: str, target_id: str, key: str = "key") -> DataFrame:
    """match_identity_first with every target row: all of the stored id, and only where there is none all of the key."""
    out = source.withColumn("_sid", F.nullif(norm_key(F.col(source_id)), F.lit("")))
    ids = target.withColumn("_tid", F.nullif(norm_key(F.col(target_id)), F.lit(""))).where("_tid is not null")
    known = ids.select(F.col("_tid").alias("_known")).distinct().withColumn("_hit", F.lit(True))
    out = out.withColumn("_dealt", dealt_key(out, "_sid")).join(known, F.col("_dealt") == F.col("_known"), "left").drop("_dealt", "_known")
    by_id = out.where("_hit").join(prefixed(ids, "t_"), F.col("_sid") == F.col("t__tid")).withColumn("match_kind", F.lit("id"))
    by_key = match_all(out.where("_hit is null"), target, key)
    by_key = by_key.withColumn("match_kind", F.when(F.col(f"t_{key}").isNotNull(), "key").otherwise("none"))
    names = [*source.columns, "match_kind", *[f"t_{c}" for c in target.columns]]
    return by_id.select(names).unionByName(by_key.select(names))


def pair_by_token(local: DataFrame, remote: DataFrame, local_order: list[str], remote_order: list[str], token: str = "token") -> DataFrame:
    """Full pairing of the last rows of each token: columns token, l_* and r_*."""
    left, right = prefixed(last_per_key(local, [token], local_order), "l_"), prefixed(last_per_key(remote, [token], remote_order), "r_")
    return left.join(right, F.col(f"l_{token}") == F.col(f"r_{token}"), "full_outer").withColumn(token, F.coalesce(f"l_{token}", f"r_{token}"))


def candidates(local: DataFrame, remote: DataFrame, pk: str, local_id: str | None = None, remote_id: str | None = None, key: str = "key") -> DataFrame:
    """Local rows that could match some remote row, by key or by identity; each once."""
    out = local.join(remote.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi").select(local.columns)
    if local_id and remote_id:
        ids = remote.select(norm_key(F.col(remote_id)).alias("_id")).where("_id <> ''").distinct()
        out = out.unionByName(local.withColumn("_id", norm_key(F.col(local_id))).join(ids, "_id", "left_semi").select(local.columns))
    return out.dropDuplicates([pk])


#: Bits of a filter of keys (a power of two), and of one of its rows, which is as Spark's bitmaps are. A filter has two hashes: 16 MiB at most.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def key_filter(values: DataFrame) -> DataFrame:
    """(which, row, bits): a filter of the one column of values; at most 2 * FILTER_BITS / ROW_BITS rows, whatever the number of values."""
    v = F.col(values.columns[0])
    places = F.array(*[F.struct(F.lit(k).alias("which"), (F.pmod(F.xxhash64(F.lit(k), v), F.lit(FILTER_BITS)) + 1).alias("at")) for k in (0, 1)])
    set_ = values.where(v.isNotNull()).select(F.explode(places).alias("p"))
    return set_.groupBy("p.which", F.bitmap_bucket_number("p.at").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p.at")).alias("bits"))


def in_filter(df: DataFrame, value: Column, filter_: DataFrame, name: str) -> DataFrame:
    """df with name: whether value may be one of the filter's. False is certain; true is wrong for about (values / FILTER_BITS)^2 of other values."""
    hit, columns = F.lit(True), df.columns
    for k in (0, 1):
        at = F.pmod(F.xxhash64(F.lit(k), value), F.lit(FILTER_BITS)) + 1
        row = filter_.where(F.col("which") == k).select(F.col("row").alias(f"_row{k}"), F.col("bits").alias(f"_bits{k}"))
        df = df.withColumn(f"_at{k}", at).join(F.broadcast(row), F.bitmap_bucket_number(f"_at{k}") == F.col(f"_row{k}"), "left")
        bit = F.bitmap_bit_position(f"_at{k}")
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{k}"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = hit & F.coalesce(F.bit_get(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return df.select(*columns, (value.isNotNull() & hit).alias(name))


def might_match(target: DataFrame, source: DataFrame, target_id: str | None = None, source_id: str | None = None, key: str = "key") -> DataFrame:
    """Target rows that some source row may match, by key or by identity; those that cannot are left out where they lie, before any shuffle.

    Pays where the source is an increment and the target is large. Only filters of fixed size are broadcast.
    """
    out = in_filter(target, F.col(key), checkpoint(key_filter(source.select(key))), "_near")
    if target_id and source_id:
        ids = checkpoint(key_filter(source.select(F.nullif(norm_key(F.col(source_id)), F.lit("")).alias("id"))))
        out = in_filter(out, F.nullif(norm_key(F.col(target_id)), F.lit("")), ids, "_known").withColumn("_near", F.col("_near") | F.col("_known"))
    return out.where("_near").select(target.columns)


def missing(target: DataFrame, source: DataFrame, key: str = "key") -> DataFrame:
    """Target rows whose key no source row has; source must be read completely. Rows without a valid key stay out."""
    return target.where(F.col(key).isNotNull()).join(source.select(key).distinct(), key, "left_anti").select(target.columns)


def key_set(df: DataFrame, key: str = "key") -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(key).distinct()


def write_units(matches: DataFrame, source_key: list[str], target_id: str) -> DataFrame:
    """Which writes several matches need: one for each if all of a source row's matches have an id, else one by key.

    matches has a row per source and target row; the result has unit = id or key. One by key keeps one row of each source row.
    """
    per = matches.groupBy(*source_key).agg(F.min((~blank(F.col(target_id))).cast("int")).alias("_all"), F.min(F.struct(*[c for c in matches.columns if c not in source_key])).alias("_one"))
    single = per.where("coalesce(_all, 0) = 0").select(*source_key, "_one.*").withColumn("unit", F.lit("key"))
    each = matches.join(per.where("_all = 1").select(*source_key), source_key, "left_semi").withColumn("unit", F.lit("id"))
    return each.unionByName(single)


def write_key(remote_id: Column, keys: Column) -> Column:
    """How a remote row is addressed: by its id, else by its raw keys."""
    return F.when(~blank(remote_id), F.concat(F.lit("id="), remote_id.cast("string"))).otherwise(keys)


def address(value: Callable[[str], Column], own_id: str | None, keys: list[str]) -> Column:
    """write_key of a row whose columns value gives: by its own id if it has one, else by its raw keys; null if some key is null."""
    raw = F.lit(None).cast("string")
    if keys:
        parts = [value(k).cast("string") for k in keys]
        raw = F.when(~reduce(lambda a, b: a | b, [p.isNull() for p in parts]), F.concat(F.lit("key="), F.to_json(F.array(*parts))))
    return write_key(value(own_id), raw) if own_id else raw


# Identities: local (pk, rid) against remote (rid, link), all texts or null.


def identity_duplicates(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(side, kind, value, n): ids that more than one row of a side claims."""

    def dup(df: DataFrame, side: str, col: str, kind: str) -> DataFrame:
        return df.where(~blank(F.col(col))).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(side).alias("side"), F.lit(kind).alias("kind"), "value", "n")

    return dup(local, "local", "pk", "local").unionByName(dup(local, "local", "rid", "remote")).unionByName(dup(remote, "remote", "rid", "remote")).unionByName(dup(remote, "remote", "link", "local"))


def _poison(rows: DataFrame) -> DataFrame:
    """(kind, value): every id that rows name; local ones of kind local, remote ones of kind remote."""
    both = F.array(F.struct(F.lit("local").alias("kind"), F.col("a").alias("value")), F.struct(F.lit("remote").alias("kind"), F.col("b").alias("value")))
    return rows.select(F.explode(both).alias("p")).select("p.*").where(~blank(F.col("value"))).distinct()


def identity_pairs(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, conflicts, poisoned): pairs (pk, rid, found_by) free of conflicts; conflicts (side, pk, rid, message); poisoned (kind, value).

    A pair is found by either link. Rows that claim an id another row of their side claims, and rows whose links
    contradict each other, are conflicts, and all ids that they name block every pair that touches them, in whatever order.
    """
    l = local.select(F.nullif(F.trim("pk"), F.lit("")).alias("pk"), F.nullif(F.trim("rid"), F.lit("")).alias("rid"))  # noqa: E741
    r = remote.select(F.nullif(F.trim("rid"), F.lit("")).alias("rid"), F.nullif(F.trim("link"), F.lit("")).alias("link"))
    dups = identity_duplicates(l, r).select("side", "kind", "value")

    def claims(rows: DataFrame, side: str, of: list[tuple[str, str]]) -> DataFrame:
        out = None
        for col, kind in of:
            d = dups.where((F.col("side") == side) & (F.col("kind") == kind)).select(F.col("value").alias(col))
            hit = rows.join(d, col, "left_semi").select("pk", "rid")
            out = hit if out is None else out.unionByName(hit)
        return out.distinct().select(F.lit(side).alias("side"), "pk", "rid", F.lit("an id is claimed by several rows").alias("message"))

    as_local = r.select(F.col("link").alias("pk"), "rid")
    first = claims(l, "local", [("pk", "local"), ("rid", "remote")]).unionByName(claims(as_local, "remote", [("rid", "remote"), ("pk", "local")]))
    poison0 = _poison(first.select(F.col("pk").alias("a"), F.col("rid").alias("b")))
    by_id = l.where("rid is not null").join(r.withColumnRenamed("link", "r_link"), "rid").select("pk", "rid", F.col("rid").alias("l_rid"), "r_link", F.lit("id").alias("found_by"))
    by_link = l.withColumnRenamed("rid", "l_rid").join(r.where("link is not null").withColumnRenamed("link", "pk"), "pk").select("pk", "rid", "l_rid", F.col("pk").alias("r_link"), F.lit("link").alias("found_by"))
    found = by_id.unionByName(by_link)
    wrong = F.when(F.col("r_link").isNotNull() & (F.col("r_link") != F.col("pk")), "the remote row links to another local row").when(F.col("l_rid").isNotNull() & (F.col("l_rid") != F.col("rid")), "the local row links to another remote row")
    second = found.withColumn("message", wrong).where("message is not null")
    ids = F.array(F.struct(F.col("pk").alias("a"), F.col("rid").alias("b")), F.struct(F.col("r_link").alias("a"), F.col("l_rid").alias("b")))
    poison1 = _poison(second.select(F.explode(ids).alias("i")).select("i.*"))
    poisoned = poison0.unionByName(poison1).distinct()
    conflicts = first.unionByName(second.select(F.lit("pair").alias("side"), "pk", "rid", "message")).distinct()
    pairs = found.groupBy("pk", "rid").agg(F.min("found_by").alias("found_by"))
    pairs = pairs.join(poisoned.where("kind = 'local'").select(F.col("value").alias("pk")), "pk", "left_anti").join(poisoned.where("kind = 'remote'").select(F.col("value").alias("rid")), "rid", "left_anti")
    return pairs.select("pk", "rid", "found_by"), conflicts, poisoned


def identity_missing(local: DataFrame, remote: DataFrame, side: str = "local") -> DataFrame:
    """Rows with both ids set whose counterpart neither link finds: to be deleted."""
    l = local.where(~blank(F.col("pk")) & ~blank(F.col("rid")))  # noqa: E741
    r = remote.where(~blank(F.col("rid")) & ~blank(F.col("link")))
    if side == "local":
        links = remote.select(F.col("link").alias("pk")).where(~blank(F.col("pk"))).distinct()
        return l.join(remote.select("rid").distinct(), "rid", "left_anti").join(links, "pk", "left_anti").select(local.columns)
    ids = local.select("rid").where(~blank(F.col("rid"))).distinct()
    return r.join(local.select(F.col("pk").alias("link")).distinct(), "link", "left_anti").join(ids, "rid", "left_anti").select(remote.columns)
