"""The queries of the reconciliation engine over the test tables, and SQL that gives the same rows.

Two-sided data is derived from the customer table: ``sides`` makes the local rows and an edited remote copy by integer
arithmetic, and LOCAL_SQL and REMOTE_SQL say the same in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as fn
from .operators import apply, mapping, matching, predicates
from .operators.diff import field_changes
from .operators.shared import checkpoint, shared_folder
from .plans import decide, execute, runs, state
from .plans.spec import Definition, Fallback, FieldMap, Identity
from .sources import tables
from .streaming import micro, tracked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    minutes = F.make_dt_interval(mins=(k * 37 % 40320).cast("int"))
    modified = F.lit("2026-03-01 00:00:00").cast("timestamp_ntz") + minutes
    creation = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    money = F.col("c_acctbal").cast("decimal(15,2)")
    local = c.where(k % 11 != 0).select(
        k.alias("n"), F.concat(F.lit("C-"), k.cast("string")).alias("name"), F.when(k % 97 == 0, "").otherwise(F.lpad(k.cast("string"), 9, "0")).alias("code"), F.col("c_mktsegment").alias("segment"), money.alias("bal"),
        modified.alias("modified"), creation.alias("creation"), F.when(k % 3 == 0, k.cast("string")).alias("partner_nr"),
    )
    stamp = modified + F.make_dt_interval(hours=((k % 7) - 3).cast("int")) + F.make_dt_interval(secs=F.when(k % 29 == 0, F.lit(0.05)).otherwise(F.lit(0.0)).cast("decimal(18,6)"))
    mapped = mapping.map_value(F.col("c_mktsegment"), [("AUTOMOBILE", "1"), ("BUILDING", "2"), ("FURNITURE", "3"), ("HOUSEHOLD", "4")], Fallback("constant", "5"))
    remote = c.where(k % 13 != 0).select(k.alias("id"), F.when(k % 17 != 0, mapped).alias("state"), F.when(k % 5 == 0, money + 1).otherwise(money).cast("decimal(15,2)").alias("balance"), stamp.alias("updated_at"), creation.alias("created_at"))
    again = remote.where("id % 19 = 0").withColumn("updated_at", F.col("updated_at") + F.expr("interval 1 day"))
    return local, remote.unionByName(again)


LOCAL_SQL = """l AS (
  SELECT c_custkey AS n, 'C-' || c_custkey AS name, CASE WHEN c_custkey % 97 = 0 THEN '' ELSE lpad(c_custkey::VARCHAR, 9, '0') END AS code, c_mktsegment AS segment, c_acctbal::DECIMAL(15,2) AS bal,
    TIMESTAMP '2026-03-01' + to_minutes((c_custkey * 37 % 40320)::INT) AS modified, TIMESTAMP '2026-01-01' AS creation, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR END AS partner_nr
  FROM customer WHERE c_custkey % 11 <> 0)"""
REMOTE_SQL = """r0 AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 17 <> 0 THEN CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1' WHEN 'BUILDING' THEN '2' WHEN 'FURNITURE' THEN '3' WHEN 'HOUSEHOLD' THEN '4' ELSE '5' END END AS state,
    (c_acctbal::DECIMAL(15,2) + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END)::DECIMAL(15,2) AS balance,
    TIMESTAMP '2026-03-01' + to_minutes((c_custkey * 37 % 40320)::INT) + to_hours((c_custkey % 7 - 3)::INT) + to_milliseconds(CASE WHEN c_custkey % 29 = 0 THEN 50 ELSE 0 END) AS updated_at, TIMESTAMP '2026-01-01' AS created_at
  FROM customer WHERE c_custkey % 13 <> 0),
r AS (SELECT * FROM r0 UNION ALL SELECT id, state, balance, updated_at + INTERVAL 1 DAY, created_at FROM r0 WHERE id % 19 = 0),
rl AS (SELECT id, arg_max(state, updated_at) AS state0, max(updated_at) AS updated_at, any_value(balance) AS balance, any_value(state) AS state FROM r GROUP BY id)"""
BOTH_SQL = f"WITH {LOCAL_SQL}, {REMOTE_SQL}"
#: The remote value of a local segment.
TO_STATE = "CASE l.segment WHEN 'AUTOMOBILE' THEN '1' WHEN 'BUILDING' THEN '2' WHEN 'FURNITURE' THEN '3' WHEN 'HOUSEHOLD' THEN '4' ELSE '5' END"
TO_SEGMENT = "CASE rl.state WHEN '1' THEN 'AUTOMOBILE' WHEN '2' THEN 'BUILDING' WHEN '3' THEN 'FURNITURE' WHEN '4' THEN 'HOUSEHOLD' WHEN '5' THEN 'MACHINERY' ELSE NULL END"
PAIRS = (("AUTOMOBILE", "1"), ("BUILDING", "2"), ("FURNITURE", "3"), ("HOUSEHOLD", "4"), ("MACHINERY", "5"))


def definition(direction: str, **more) -> Definition:
    return Definition(
        name="customers", direction=direction, match_fields=("code",), mapping=(FieldMap("code", "id"), FieldMap("segment", "state"), FieldMap("bal", "balance")), value_map={"segment": PAIRS},
        local_modified="modified", local_creation="creation", remote_modified="updated_at", remote_creation="created_at", local_order=("modified", "name"), remote_order=("updated_at",), **more,
    )


def flat(plan: DataFrame, *more: str) -> DataFrame:
    return plan.select("record_key", "action", "status", "write_direction", "change_count", "changed_fields", *more)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# values

#: How an order's key is written, as Spark and DuckDB say it, and its number in DuckDB.
FORMS = [
    ("padded", "lpad(k, 12, '0')", "lpad(k, 12, '0')", "k"),
    ("signed", "concat('+', k, '.00')", "'+' || k || '.00'", "k"),
    ("spaced", "concat(' -', k, '.50\t')", "' -' || k || '.50' || chr(9)", "'-' || k || '.5'"),
    ("tiny", "concat(k, 'e-20')", "k || 'e-20'", "'0.' || repeat('0', 20 - length(k)) || rtrim(k, '0')"),
    ("huge", "concat(k, '.0E+25')", "k || '.0E+25'", "k || repeat('0', 25)"),
    ("double", "cast(cast(concat('1e', 20 + n % 3) as double) as string)", "'1.0E' || (20 + n % 3)", "'1' || repeat('0', (20 + n % 3)::INT)"),
    ("word", "concat('x', k)", "'x' || k", "NULL"),
    ("stamp", "concat('2026-03-17T12:00:0', n % 10, '+02:00')", "'2026-03-17T12:00:0' || (n % 10) || '+02:00'", "NULL"),
    ("blank", "' '", "' '", "NULL"),
]
_forms_sql = "WITH o AS (SELECT o_orderkey + 1 AS n, (o_orderkey + 1)::VARCHAR AS k FROM orders), f AS (" + " UNION ALL ".join(f"SELECT n, '{kind}' AS kind, {form} AS form, {number} AS number FROM o" for kind, _, form, number in FORMS) + ")"


def _with_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("n"), (F.col("o_orderkey") + 1).cast("string").alias("k"))
    forms = F.array(*[F.struct(F.lit(kind).alias("kind"), F.expr(form).alias("form")) for kind, form, _, _ in FORMS])
    return o.select("n", F.explode(forms).alias("f")).select("n", "f.*")


@query(f"{_forms_sql} SELECT n, kind, form, number FROM f")
def norm_number_forms(spark, sf_dir):
    return _with_forms(spark, sf_dir).withColumn("number", fn.norm_number(F.col("form")))


@query(f"{_forms_sql} SELECT n, kind, CASE kind WHEN 'word' THEN 'text:' || form WHEN 'stamp' THEN 'datetime:2026-03-17T10:00:0' || (n % 10) || '.000000+00:00' WHEN 'blank' THEN '' ELSE 'number:' || number END AS key FROM f")
def norm_key_forms(spark, sf_dir):
    return _with_forms(spark, sf_dir).select("n", "kind", fn.norm_key(F.col("form")).alias("key"))


@query("SELECT o_orderkey, 'number:' || (o_orderkey * 2) AS key, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS stamp, o_orderdate >= TIMESTAMP '1996-01-01' AS changed FROM orders")
def scalar_forms(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit(" 00"), (F.col("o_orderkey") * 2).cast("string"), F.lit(".00\t"))
    eff = fn.effective_modified(F.lit(None).cast("string"), F.col("o_orderdate"))
    return o.select("o_orderkey", fn.norm_key(text).alias("key"), fn.norm_datetime_key(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("stamp"), fn.changed_since(eff, F.lit("1996-01-01").cast("timestamp_ntz")).alias("changed"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}') AS print, sha256('[\"docs\",\"' || doc_id || '\"]') AS state_name FROM documents")
def fingerprints(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cols = ["doc_id", "lang", "source", "n_chars"]
    text = fn.canonical_json({c: F.col(c) for c in cols}, dict(d.dtypes))
    return d.select("doc_id", fn.fingerprint(text).alias("print"), fn.state_name(F.lit("docs"), F.col("doc_id").cast("string")).alias("state_name"))


@query("SELECT doc_id, '[\"number:' || doc_id || '\",\"text:' || source || '\"]' AS record_key, 'recon:' || sha256('[\"docs\",\"' || doc_id || '\",\"1\",\"' || source || '\"]') AS idempotency_key FROM documents")
def record_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fn.record_key(mapping.key_parts(d, ["doc_id", "source"])).alias("record_key"), fn.idempotency_key(F.lit("docs"), F.col("doc_id").cast("string"), F.lit(1), F.col("source")).alias("idempotency_key"))


# projections


@query(f"{BOTH_SQL} SELECT n, code AS id, {TO_STATE} AS state, bal AS balance FROM l")
def push_projection(spark, sf_dir):
    local, _ = sides(spark, sf_dir)
    return mapping.project(local, definition("push"), "push", keep=["n"])


@query(f"{BOTH_SQL} SELECT id AS code, {TO_SEGMENT.replace('rl.', '')} AS segment, balance AS bal, updated_at FROM r")
def pull_projection(spark, sf_dir):
    _, remote = sides(spark, sf_dir)
    return mapping.project(remote, definition("pull"), "pull", keep=["updated_at"])


@query(f"{BOTH_SQL} SELECT id, CASE WHEN state IS NULL THEN 'none' WHEN state IN ('1', '2') THEN 'low' WHEN state = '3' THEN NULL ELSE state END AS kept, CASE WHEN state IN ('1', '2') THEN 'low' ELSE 'other' END AS constant FROM r")
def value_map_null_and_fallback(spark, sf_dir):
    _, remote = sides(spark, sf_dir)
    padded = F.when(F.col("state").isNotNull(), F.concat(F.lit("0"), F.col("state"), F.lit(".0")))
    # Padded numbers hit by their value; null and a null result can be mapped.
    kept = mapping.map_value(padded, [("1", "low"), ("2", "low"), ("3", None), ("4", "4"), ("5", "5"), (None, "none")])
    return remote.select("id", kept.alias("kept"), mapping.map_value(padded, [("1", "low"), ("2", "low")], Fallback("constant", "other")).alias("constant"))


@query("SELECT c_custkey, c_name || ' of ' || n_name AS title, length(c_name || ' of ' || n_name)::INT AS size FROM customer JOIN nation ON c_nationkey = n_nationkey")
def computed_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return mapping.computed(c, [("title", "concat(c_name, ' of ', n_name)"), ("size", "length(title)")]).select("c_custkey", "title", "size")


#: 01:00 UTC of the last Sunday of a month, given by its last day.
_last_sunday = lambda month, day, hour=1: f"(make_timestamp(year(o_orderdate), {month}, {day}, {hour}, 0, 0) - to_days(dayofweek(make_date(year(o_orderdate), {month}, {day}))::INT))"
#: Summer time in Berlin (from 1981) ends in October, before 1996 in September; in New York (1987 to 2006) it lasts from the first Sunday of April to the last of October.
_SUMMER = f"o_orderdate >= {_last_sunday(3, 31)} AND o_orderdate < CASE WHEN year(o_orderdate) < 1996 THEN {_last_sunday(9, 30)} ELSE {_last_sunday(10, 31)} END"
_SUMMER_WEST = f"o_orderdate >= make_timestamp(year(o_orderdate), 4, 1, 7, 0, 0) + to_days(((7 - dayofweek(make_date(year(o_orderdate), 4, 1))) % 7)::INT) AND o_orderdate < {_last_sunday(10, 31, 6)}"


def _in_zone(spark, sf_dir, zone: str, name: str) -> DataFrame:
    hours = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", hours)
    return o.select("o_orderkey", F.date_format(fn.shift_zone(F.col("o_orderdate"), "UTC", zone).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias(name))


_BY_HOUR = "(SELECT o_orderkey, o_orderdate + to_hours((o_orderkey % 24)::INT) AS o_orderdate FROM orders)"


@query(f"SELECT o_orderkey, strftime(o_orderdate + to_hours(CASE WHEN {_SUMMER_WEST} THEN -4 ELSE -5 END), '%Y-%m-%d %H:%M:%S') AS new_york FROM {_BY_HOUR}")
def zone_conversion(spark, sf_dir):
    """All orders, at all hours."""
    return _in_zone(spark, sf_dir, "America/New_York", "new_york")


@query(f"SELECT o_orderkey, strftime(o_orderdate + to_hours(CASE WHEN {_SUMMER} THEN 2 ELSE 1 END), '%Y-%m-%d %H:%M:%S') AS berlin FROM {_BY_HOUR}")
def zone_conversion_all_year(spark, sf_dir):
    """All orders, at all hours."""
    return _in_zone(spark, sf_dir, "Europe/Berlin", "berlin")


def _orders_with_lines(spark, sf_dir) -> DataFrame:
    return tables.with_children(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", "l_linenumber", "items", ["l_linenumber", "l_partkey", "l_shipdate"])


@query("SELECT o_orderkey, count(l_orderkey)::INT AS n_items, coalesce(min(l_linenumber), 0) AS first_line, sum(l_partkey)::BIGINT AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def child_rows(spark, sf_dir):
    o = _orders_with_lines(spark, sf_dir)
    parts = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["l_partkey"])
    return o.select("o_orderkey", F.size("items").alias("n_items"), F.coalesce(F.try_element_at("items", F.lit(1))["l_linenumber"], F.lit(0)).alias("first_line"), F.when(F.size("items") > 0, parts).alias("parts"))


@query("WITH p AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS i FROM lineitem) SELECT o_orderkey, max(l_partkey) FILTER (i = 1) AS first_part, max(l_partkey) FILTER (i = 2) AS second_part FROM orders LEFT JOIN p ON o_orderkey = l_orderkey GROUP BY 1")
def nested_read(spark, sf_dir):
    o = _orders_with_lines(spark, sf_dir)
    return o.select("o_orderkey", mapping.read_path(o, "items.1.l_partkey").alias("first_part"), mapping.read_path(o, "items.2.l_partkey").alias("second_part"))


@query("SELECT n_nationkey, 2 AS n_rows, n_name AS first_code, NULL::VARCHAR AS first_note, NULL::VARCHAR AS second_code, 'of ' || n_regionkey AS second_note FROM nation")
def nested_write(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("items.1.code"), F.concat(F.lit("of "), F.col("n_regionkey").cast("string")).alias("items.2.note"))
    out = mapping.write_paths(n, "items")
    at = lambda k, f: F.try_element_at("items", F.lit(k))[f]
    return out.select("n_nationkey", F.size("items").alias("n_rows"), at(1, "code").alias("first_code"), at(1, "note").alias("first_note"), at(2, "code").alias("second_code"), at(2, "note").alias("second_note"))


# matching


def _keyed(spark, sf_dir):
    local, remote = sides(spark, sf_dir)
    return matching.with_key(local, ["code"]), matching.with_key(remote, ["id"])


@query(f"{BOTH_SQL} SELECT l.n, rl.id, rl.updated_at FROM l LEFT JOIN rl ON l.code <> '' AND l.n = rl.id")
def match_first(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    return matching.match_first(local, remote, ["updated_at"]).select("n", F.col("t_id").alias("id"), F.col("t_updated_at").alias("updated_at"))


@query(f"{BOTH_SQL} SELECT l.n, r.id, r.updated_at FROM l LEFT JOIN r ON l.code <> '' AND l.n = r.id")
def match_all(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    return matching.match_all(local, remote).select("n", F.col("t_id").alias("id"), F.col("t_updated_at").alias("updated_at"))


@query(f"{BOTH_SQL} SELECT l.n, rl.id, CASE WHEN rl.id IS NULL THEN 'none' WHEN partner_nr IS NOT NULL THEN 'id' ELSE 'key' END AS match_kind FROM l LEFT JOIN rl ON l.n = rl.id AND (partner_nr IS NOT NULL OR code <> '')")
def match_identity_first(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    return matching.match_identity_first(local, remote, "partner_nr", "id", ["updated_at"]).select("n", F.col("t_id").alias("id"), "match_kind")


@query(f"{BOTH_SQL} SELECT l.n, l.name FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.id % 2 = 0 AND r.id = l.n AND (l.code <> '' OR l.partner_nr IS NOT NULL))")
def candidate_semi_join(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    return matching.candidates(local, remote.where("id % 2 = 0"), "name", "partner_nr", "id").select("n", "name")


@query(f"{BOTH_SQL} SELECT coalesce(l.n, rl.id) AS n, l.name, rl.updated_at FROM (SELECT * FROM l WHERE code <> '') l FULL OUTER JOIN rl ON l.n = rl.id")
def token_full_outer(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    out = matching.pair_by_token(local.withColumnRenamed("key", "token"), remote.withColumnRenamed("key", "token"), ["modified"], ["updated_at"])
    return out.select(F.coalesce("l_n", "r_id").alias("n"), F.col("l_name").alias("name"), F.col("r_updated_at").alias("updated_at"))


@query(f"{BOTH_SQL} SELECT DISTINCT id FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE code <> '' AND l.n = r.id)")
def delete_missing_push(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    return matching.missing(remote, matching.key_set(local)).select("id").distinct()


@query(f"{BOTH_SQL} SELECT n, name FROM l WHERE code <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE l.n = r.id)")
def delete_missing_pull(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    return matching.missing(local, matching.key_set(remote)).select("n", "name")


@query(f"{BOTH_SQL}, m AS (SELECT l.n, CASE WHEN r.id % 4 <> 0 THEN r.id END AS rid, r.updated_at, min(CASE WHEN r.id % 4 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l.n) AS every FROM l JOIN r ON l.n = r.id AND l.code <> '') SELECT n, CASE every WHEN 1 THEN 'id' ELSE 'key' END AS unit, count(*) FILTER (every = 1) + max(CASE every WHEN 0 THEN 1 ELSE 0 END) AS writes FROM m GROUP BY 1, 2")
def multi_match_write_units(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    met = matching.match_all(local, remote).where("t_id is not null").select("n", F.when(F.col("t_id") % 4 != 0, F.col("t_id")).alias("rid"), F.col("t_updated_at").alias("updated_at"))
    return matching.write_units(met, ["n"], "rid").groupBy("n", "unit").agg(F.count("*").alias("writes"))


def _identities(spark, sf_dir):
    """Local (pk, rid) and remote (rid, link) with contradictions sown in."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    local = c.where(k % 11 != 0).select(F.concat(F.lit("C-"), k.cast("string")).alias("pk"), F.when(k % 23 == 0, (k - 1).cast("string")).when(k % 3 == 0, k.cast("string")).otherwise("").alias("rid"))
    remote = c.where(k % 13 != 0).select(k.cast("string").alias("rid"), F.when(k % 31 == 0, F.concat(F.lit("C-"), (k + 1).cast("string"))).when(k % 2 == 0, F.concat(F.lit("C-"), k.cast("string"))).otherwise("").alias("link"))
    return local, remote


IDENTITY_SQL = """WITH l AS (SELECT 'C-' || c_custkey AS pk, nullif(CASE WHEN c_custkey % 23 = 0 THEN (c_custkey - 1)::VARCHAR WHEN c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE '' END, '') AS rid FROM customer WHERE c_custkey % 11 <> 0),
r AS (SELECT c_custkey::VARCHAR AS rid, nullif(CASE WHEN c_custkey % 31 = 0 THEN 'C-' || (c_custkey + 1) WHEN c_custkey % 2 = 0 THEN 'C-' || c_custkey ELSE '' END, '') AS link FROM customer WHERE c_custkey % 13 <> 0),
ld AS (SELECT rid FROM l WHERE rid IS NOT NULL GROUP BY 1 HAVING count(*) > 1), rd AS (SELECT link FROM r WHERE link IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
f1 AS (SELECT 'local' AS side, pk, rid, 'an id is claimed by several rows' AS message FROM l WHERE rid IN (FROM ld) UNION SELECT 'remote', link, rid, 'an id is claimed by several rows' FROM r WHERE link IN (FROM rd)),
found AS (SELECT l.pk, r.rid, l.rid AS l_rid, r.link AS r_link, 'id' AS found_by FROM l JOIN r ON l.rid = r.rid UNION ALL SELECT l.pk, r.rid, l.rid, r.link, 'link' FROM l JOIN r ON r.link = l.pk),
f2 AS (SELECT *, CASE WHEN r_link <> pk THEN 'the remote row links to another local row' WHEN l_rid <> rid THEN 'the local row links to another remote row' END AS message FROM found),
bad AS (SELECT * FROM f2 WHERE message IS NOT NULL),
poison AS (SELECT kind, value FROM (SELECT 'local' AS kind, pk AS value FROM f1 UNION SELECT 'remote', rid FROM f1 UNION SELECT 'local', pk FROM bad UNION SELECT 'local', r_link FROM bad UNION SELECT 'remote', rid FROM bad UNION SELECT 'remote', l_rid FROM bad) WHERE value IS NOT NULL)"""


@query(f"{IDENTITY_SQL} SELECT pk, rid, min(found_by) AS found_by FROM found WHERE pk NOT IN (SELECT value FROM poison WHERE kind = 'local') AND rid NOT IN (SELECT value FROM poison WHERE kind = 'remote') GROUP BY 1, 2")
def identity_pairs(spark, sf_dir):
    return matching.identity_pairs(*_identities(spark, sf_dir))[0]


@query(f"{IDENTITY_SQL} SELECT * FROM f1 UNION SELECT 'pair', pk, rid, message FROM bad")
def identity_conflicts(spark, sf_dir):
    return matching.identity_pairs(*_identities(spark, sf_dir))[1]


@query(f"{IDENTITY_SQL} SELECT kind, value FROM poison")
def identity_poison(spark, sf_dir):
    return matching.identity_pairs(*_identities(spark, sf_dir))[2]


@query(f"{IDENTITY_SQL} SELECT pk, rid FROM l WHERE rid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.rid = l.rid) AND NOT EXISTS (SELECT 1 FROM r WHERE r.link = l.pk)")
def identity_delete_missing(spark, sf_dir):
    return matching.identity_missing(*_identities(spark, sf_dir), side="local")


# plans

_MATCHED = "rl.id IS NOT NULL AND l.code <> ''"
_STATE_CHANGED, _BAL_CHANGED = f"({TO_STATE} IS DISTINCT FROM rl.state)", "(l.bal IS DISTINCT FROM rl.balance)"


@query(f"""{BOTH_SQL} SELECT l.n, field, old, new FROM l JOIN rl ON l.code <> '' AND l.n = rl.id, LATERAL (SELECT 'segment' AS field, rl.state AS old, {TO_STATE} AS new WHERE {_STATE_CHANGED} UNION ALL SELECT 'bal', rl.balance::VARCHAR, l.bal::VARCHAR WHERE {_BAL_CHANGED})""")
def field_diff(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    pushed = matching.with_key(local, ["code"]).transform(lambda x: mapping.project(x, definition("push"), "push", keep=["n", "key"]))
    met = matching.match_first(pushed, remote, ["updated_at"]).where("t_key is not null")
    fields = ["state", "balance"]
    changes = field_changes({f: F.col(f) for f in fields}, {f: F.col(f"t_{f}") for f in fields}, rename={"state": "segment", "balance": "bal"})
    return met.select("n", F.explode(changes).alias("c")).select("n", "c.*")


_ONE_WAY = """action, CASE action WHEN 'error' THEN 'error' ELSE 'success' END AS status, '{way}' AS write_direction, n AS change_count, names AS changed_fields"""


def _push_sql() -> str:
    return f"""{BOTH_SQL}, p AS (SELECT l.n AS k, l.code, CASE WHEN {_MATCHED} THEN ({_STATE_CHANGED}::INT + {_BAL_CHANGED}::INT) ELSE 0 END AS n, rl.id,
      CASE WHEN {_MATCHED} THEN concat_ws(', ', CASE WHEN {_STATE_CHANGED} THEN 'segment' END, CASE WHEN {_BAL_CHANGED} THEN 'bal' END) ELSE '' END AS names FROM l LEFT JOIN rl ON l.n = rl.id AND l.code <> ''),
    q AS (SELECT *, CASE WHEN code = '' THEN 'error' WHEN id IS NULL THEN 'created' WHEN n = 0 THEN 'skipped' ELSE 'updated' END AS action FROM p)"""


@query(f"{_push_sql()} SELECT CASE WHEN code <> '' THEN 'number:' || k END AS record_key, {_ONE_WAY.format(way='push')} FROM q")
def push_plan(spark, sf_dir):
    return flat(decide.one_way_plan(*sides(spark, sf_dir), definition("push")))


_SEG_CHANGED = f"({TO_SEGMENT} IS DISTINCT FROM l.segment)"
_PULL_SQL = f"""{BOTH_SQL}, ll AS (SELECT * FROM l WHERE code <> ''), p AS (SELECT rl.id AS k, l.n AS ln, CASE WHEN l.n IS NOT NULL THEN ({_SEG_CHANGED}::INT + {_BAL_CHANGED}::INT) ELSE 0 END AS n,
      CASE WHEN l.n IS NOT NULL THEN concat_ws(', ', CASE WHEN {_SEG_CHANGED} THEN 'segment' END, CASE WHEN {_BAL_CHANGED} THEN 'bal' END) ELSE '' END AS names FROM rl LEFT JOIN ll l ON l.n = rl.id),
    q AS (SELECT *, CASE WHEN ln IS NULL THEN 'created' WHEN n = 0 THEN 'skipped' ELSE 'updated' END AS action FROM p)"""


@query(f"{_PULL_SQL} SELECT 'number:' || k AS record_key, {_ONE_WAY.format(way='pull')} FROM q")
def pull_plan(spark, sf_dir):
    return flat(decide.one_way_plan(*sides(spark, sf_dir), definition("pull")))


@query(f"{_PULL_SQL} SELECT 'number:' || k AS record_key, CASE WHEN ln IS NULL THEN 'created' ELSE 'skipped' END AS action FROM q")
def pull_plan_without_updates(spark, sf_dir):
    return decide.one_way_plan(*sides(spark, sf_dir), definition("pull", update_existing=False)).select("record_key", "action")


@query(f"{_push_sql()} SELECT CASE WHEN code <> '' THEN 'number:' || k END AS record_key, action FROM q UNION ALL SELECT 'number:' || id, 'deleted' FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE code <> '' AND l.n = r.id)")
def push_plan_with_deletes(spark, sf_dir):
    return decide.one_way_plan(*sides(spark, sf_dir), definition("push", delete_missing=True)).select("record_key", "action")


WATERMARK = "2026-03-10 00:00:00"
_L_CH, _R_CH = f"l.modified >= TIMESTAMP '{WATERMARK}'", f"rl.updated_at >= TIMESTAMP '{WATERMARK}'"
_APART = "abs(date_diff('microsecond', rl.updated_at, l.modified))"
_OUTCOME = f"CASE WHEN {_L_CH} AND NOT {_R_CH} THEN 'local_changed' WHEN {_R_CH} AND NOT {_L_CH} THEN 'remote_changed' WHEN {_APART} <= 100000 THEN 'manual' WHEN l.modified > rl.updated_at THEN 'local_newest' ELSE 'remote_newest' END"


@query(f"{BOTH_SQL} SELECT l.n, {_OUTCOME} AS outcome FROM l JOIN rl ON l.n = rl.id AND l.code <> ''")
def resolve_conflict_grid(spark, sf_dir):
    local, remote = _keyed(spark, sf_dir)
    met = matching.match_first(local, remote, ["updated_at"]).where("t_id is not null")
    l, r = fn.effective_modified(F.col("modified"), F.col("creation")), fn.effective_modified(F.col("t_updated_at"), F.col("t_created_at"))  # noqa: E741
    return met.select("n", decide.resolve_conflict(l, r, F.lit(WATERMARK).cast("timestamp_ntz")).alias("outcome"))


_BOTH_PLAN = f"""{BOTH_SQL}, ll AS (SELECT * FROM l WHERE code <> ''), p AS (
    SELECT coalesce(l.n, rl.id) AS k, l.n AS ln, rl.id AS rn, {_OUTCOME} AS outcome, ({_STATE_CHANGED}::INT + {_BAL_CHANGED}::INT) AS np, ({_SEG_CHANGED}::INT + {_BAL_CHANGED}::INT) AS nq FROM ll l FULL OUTER JOIN rl ON l.n = rl.id),
  q AS (SELECT *, CASE WHEN ln IS NULL OR rn IS NULL THEN 'created' WHEN np = 0 AND nq = 0 THEN 'skipped' WHEN outcome = 'manual' THEN 'conflict' WHEN outcome LIKE 'local%' THEN CASE WHEN np = 0 THEN 'skipped' ELSE 'updated' END WHEN nq = 0 THEN 'skipped' ELSE 'updated' END AS action FROM p)"""
_BOTH_WAY = "CASE WHEN rn IS NULL THEN 'push' WHEN ln IS NULL THEN 'pull' WHEN (np = 0 AND nq = 0) OR outcome = 'manual' THEN NULL WHEN outcome LIKE 'local%' THEN 'push' ELSE 'pull' END"


def _both(spark, sf_dir) -> DataFrame:
    return decide.both_ways_plan(*sides(spark, sf_dir), definition("both"), F.lit(WATERMARK).cast("timestamp_ntz"))


@query(f"{_BOTH_PLAN} SELECT 'number:' || k AS record_key, action, CASE action WHEN 'conflict' THEN 'conflict' ELSE 'success' END AS status, {_BOTH_WAY} AS write_direction FROM q")
def both_plan(spark, sf_dir):
    return _both(spark, sf_dir).select("record_key", "action", "status", "write_direction")


@query(f"{_BOTH_PLAN} SELECT 'number:' || k AS record_key, l.segment AS local_segment, {TO_SEGMENT} AS remote_segment, {TO_STATE} AS to_state FROM q JOIN ll l ON l.n = q.k JOIN rl ON rl.id = q.k WHERE action = 'conflict'")
def manual_payloads(spark, sf_dir):
    c = _both(spark, sf_dir).where("action = 'conflict'")
    back = {a: b for b, a in PAIRS}
    state_ = F.get_json_object("payload", "$.to_remote.state")
    local_segment = F.try_element_at(F.create_map(*[F.lit(x) for kv in back.items() for x in kv]), state_)
    return c.select("record_key", local_segment.alias("local_segment"), F.get_json_object("payload", "$.to_local.segment").alias("remote_segment"), state_.alias("to_state"))


@query(f"{_BOTH_PLAN} SELECT 'number:' || k AS record_key, CASE k % 2 WHEN 0 THEN 'push' ELSE 'pull' END AS write_direction, 'updated' AS action, CASE k % 2 WHEN 0 THEN {TO_STATE} ELSE {TO_SEGMENT} END AS written FROM q JOIN ll l ON l.n = q.k JOIN rl ON rl.id = q.k WHERE action = 'conflict'")
def apply_resolution(spark, sf_dir):
    plan = checkpoint(_both(spark, sf_dir))  # a reviewer's choices come when the run is done
    n = F.regexp_extract("record_key", r"(\d+)$", 1).cast("long")
    choices = plan.select("record_key", F.when(n % 2 == 0, "push").otherwise("pull").alias("choice"))
    out = decide.apply_resolutions(plan, choices)
    return out.select("record_key", "write_direction", "action", F.coalesce(F.get_json_object("payload", "$.state"), F.get_json_object("payload", "$.segment")).alias("written"))


def _identity_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The two sides with the links of _identities; of a remote row that comes twice the last."""
    local, remote = sides(spark, sf_dir)
    n, k = F.col("n"), F.col("id")
    local = local.withColumn("partner_nr", F.when(n % 23 == 0, (n - 1).cast("string")).when(n % 3 == 0, n.cast("string")).otherwise(""))
    link = F.when(k % 31 == 0, F.concat(F.lit("C-"), (k + 1).cast("string"))).when(k % 2 == 0, F.concat(F.lit("C-"), k.cast("string"))).otherwise("")
    return local, matching.last_per_key(remote, ["id"], ["updated_at"]).withColumn("link", link)


_LINKED = LOCAL_SQL.replace("l AS (", "bl AS (", 1) + ", " + REMOTE_SQL.replace("\nr AS (", "\nbr AS (").replace("FROM r GROUP", "FROM br GROUP")
_IDENTITY_PLAN = f"""{IDENTITY_SQL}, {_LINKED}, ok AS (SELECT DISTINCT pk, rid FROM found WHERE pk NOT IN (SELECT value FROM poison WHERE kind = 'local') AND rid NOT IN (SELECT value FROM poison WHERE kind = 'remote')),
  lc AS (SELECT pk, rid FROM l WHERE pk NOT IN (SELECT value FROM poison WHERE kind = 'local') AND (rid IS NULL OR rid NOT IN (SELECT value FROM poison WHERE kind = 'remote')) AND pk NOT IN (SELECT pk FROM ok)),
  rc AS (SELECT rid, link FROM r WHERE rid NOT IN (SELECT value FROM poison WHERE kind = 'remote') AND (link IS NULL OR link NOT IN (SELECT value FROM poison WHERE kind = 'local')) AND rid NOT IN (SELECT rid FROM ok)),
  d AS (SELECT ok.pk, ok.rid, {_OUTCOME} AS outcome, {_STATE_CHANGED}::INT + {_BAL_CHANGED}::INT + (i.link IS DISTINCT FROM ok.pk)::INT AS np, {_SEG_CHANGED}::INT + {_BAL_CHANGED}::INT + (j.rid IS DISTINCT FROM ok.rid)::INT AS nq
    FROM ok JOIN bl l ON l.name = ok.pk JOIN rl ON rl.id::VARCHAR = ok.rid JOIN r i ON i.rid = ok.rid JOIN l j ON j.pk = ok.pk),
  q AS (SELECT pk, rid, CASE WHEN np = 0 AND nq = 0 THEN 'skipped' WHEN outcome = 'manual' THEN 'conflict' WHEN outcome LIKE 'local%' THEN CASE WHEN np = 0 THEN 'skipped' ELSE 'updated' END WHEN nq = 0 THEN 'skipped' ELSE 'updated' END AS action,
      CASE WHEN (np = 0 AND nq = 0) OR outcome = 'manual' THEN NULL WHEN outcome LIKE 'local%' THEN 'push' ELSE 'pull' END AS way, CASE WHEN np = 0 AND nq = 0 THEN 0 WHEN outcome LIKE 'remote%' THEN nq ELSE np END AS n FROM d
    UNION ALL SELECT pk, rid, 'conflict', NULL, 0 FROM (SELECT * FROM f1 UNION SELECT 'pair', pk, rid, message FROM bad)
    UNION ALL SELECT pk, NULL, 'created', 'push', 0 FROM lc WHERE rid IS NULL UNION ALL SELECT NULL, rid, 'created', 'pull', 0 FROM rc WHERE link IS NULL
    UNION ALL SELECT pk, rid, 'deleted', 'pull', 0 FROM lc WHERE rid IS NOT NULL UNION ALL SELECT link, rid, 'deleted', 'push', 0 FROM rc WHERE link IS NOT NULL)"""


@query(f"{_IDENTITY_PLAN} SELECT pk, rid, action, way AS write_direction, n AS change_count FROM q")
def identity_plan(spark, sf_dir):
    d = Definition(
        name="customers", direction="both", mapping=(FieldMap("segment", "state"), FieldMap("bal", "balance")), identity=Identity("name", "partner_nr", "id", "link"), value_map={"segment": PAIRS}, delete_missing=True,
        local_modified="modified", local_creation="creation", remote_modified="updated_at", remote_creation="created_at",
    )
    plan = decide.identity_plan(*_identity_sides(spark, sf_dir), d, F.lit(WATERMARK).cast("timestamp_ntz"))
    return plan.select(F.get_json_object("record_key", "$.local").alias("pk"), F.get_json_object("record_key", "$.remote").alias("rid"), "action", "write_direction", "change_count")


@query(f"{_push_sql()} SELECT count(*) AS processed, count(*) FILTER (action <> 'error') AS success, count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated, 0::BIGINT AS deleted, count(*) FILTER (action = 'skipped') AS skipped, 0::BIGINT AS conflict, count(*) FILTER (action = 'error') AS error FROM q")
def run_counters(spark, sf_dir):
    return runs.counters(decide.one_way_plan(*sides(spark, sf_dir), definition("push")))


@query(f"{_push_sql()} SELECT CASE WHEN count(*) FILTER (action = 'error') > 0 THEN 'Partial Error' ELSE 'Success' END AS run_status, format('processed {{}}, created {{}}, updated {{}}, deleted 0, skipped {{}}, conflicts 0, errors {{}}', count(*), count(*) FILTER (action = 'created'), count(*) FILTER (action = 'updated'), count(*) FILTER (action = 'skipped'), count(*) FILTER (action = 'error')) AS summary FROM q")
def run_status(spark, sf_dir):
    return runs.summary(runs.counters(decide.one_way_plan(*sides(spark, sf_dir), definition("push")))).select("run_status", "summary")


@query(f"{_push_sql()} SELECT CASE WHEN code <> '' THEN 'number:' || k END AS record_key, action, CASE action WHEN 'error' THEN 0 WHEN 'skipped' THEN 4 ELSE 3 END AS priority FROM q ORDER BY priority, record_key NULLS FIRST LIMIT 40")
def preview_top_k(spark, sf_dir):
    return runs.preview(decide.one_way_plan(*sides(spark, sf_dir), definition("push")), 40).select("record_key", "action", "priority")


@query(f"{BOTH_SQL} SELECT n, coalesce(CASE WHEN code <> '' THEN 'code=' || code END, name) AS shown, CASE WHEN length(repeat(name, 30)) > 140 THEN substr(repeat(name, 30), 1, 137) || '...' ELSE repeat(name, 30) END AS fitted FROM l")
def display_keys(spark, sf_dir):
    local, _ = sides(spark, sf_dir)
    return local.select("n", fn.display_key({"code": F.col("code")}, {}, F.col("name")).alias("shown"), fn.fit(F.repeat("name", F.lit(30))).alias("fitted"))


# runs that write


@query(f"""{BOTH_SQL} SELECT CASE WHEN r.id % 4 <> 0 THEN r.id * 10 + (r.updated_at <> rl.updated_at)::INT END AS nr, r.id AS code, CASE WHEN l.n IS NULL THEN r.state ELSE {TO_STATE} END AS state, CASE WHEN l.n IS NULL THEN r.balance ELSE l.bal END AS balance
  FROM r JOIN rl USING (id) LEFT JOIN l ON l.n = r.id AND l.code <> ''
  UNION ALL SELECT NULL, n, {TO_STATE}, bal FROM l WHERE code <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE r.id = l.n)""")
def apply_push_all_matches(spark, sf_dir):
    """Customers are pushed to all rows of their key: each by its own nr, or at once where one has none. One in ten comes twice, and the later one counts."""
    local, remote = sides(spark, sf_dir)
    last = matching.last_per_key(remote, ["id"], ["updated_at"]).select("id", F.col("updated_at").alias("last"))
    nr = F.when(F.col("id") % 4 != 0, F.col("id") * 10 + (F.col("updated_at") != F.col("last")).cast("int"))
    remote = remote.join(last, "id").select(nr.alias("nr"), F.col("id").alias("code"), "state", "balance")
    early = local.where("n % 10 = 0").withColumns({"modified": F.col("modified") - F.expr("interval 1 day"), "segment": F.lit("MACHINERY"), "bal": F.lit(0).cast("decimal(15,2)")})
    d = Definition("customers", "push", (FieldMap("code", "code"), FieldMap("segment", "state"), FieldMap("bal", "balance")), ("code",), match_mode="all_matches", value_map={"segment": PAIRS}, local_order=("modified", "name"), remote_id="nr")
    return execute.apply_plan(remote, checkpoint(decide.one_way_plan(local.unionByName(early), remote, d)), d, "push")


_PULLED = f"(r.id IS NOT NULL AND (l.code = '' OR l.n % 6 = 0 OR l.partner_nr IS NULL OR {TO_SEGMENT.replace('rl.', 'r.')} IS DISTINCT FROM l.segment OR l.bal <> r.balance))"


@query(f"""{BOTH_SQL}, m AS (SELECT * REPLACE (CASE WHEN n % 6 = 0 THEN 'X' || n ELSE code END AS code) FROM l)
  SELECT l.n, CASE WHEN r.id IS NOT NULL AND (l.code = '' OR l.n % 6 = 0) THEN r.id::VARCHAR ELSE l.code END AS code, CASE WHEN r.id IS NULL THEN l.segment ELSE {TO_SEGMENT.replace('rl.', 'r.')} END AS segment,
    CASE WHEN r.id IS NULL THEN l.bal ELSE r.balance END AS bal, CASE WHEN r.id IS NULL THEN l.partner_nr ELSE r.id::VARCHAR END AS partner_nr, CASE WHEN {_PULLED} THEN r.updated_at ELSE l.modified END AS modified
  FROM m l LEFT JOIN rl r ON l.n = r.id AND (l.partner_nr IS NOT NULL OR l.code <> '')
  UNION ALL SELECT NULL, id::VARCHAR, {TO_SEGMENT}, balance, id::VARCHAR, updated_at FROM rl WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.n = rl.id AND (m.partner_nr IS NOT NULL OR m.code <> ''))""")
def apply_identity_pull(spark, sf_dir):
    """Customers are pulled to the rows that hold their id, also where the code has changed, else to those of their code; links are kept."""
    local, remote = sides(spark, sf_dir)
    local = local.withColumn("code", F.when(F.col("n") % 6 == 0, F.concat(F.lit("X"), F.col("n").cast("string"))).otherwise(F.col("code")))
    d = definition("pull", identity=Identity("name", "partner_nr", "id", "link"))
    plan = checkpoint(decide.one_way_plan(local, remote.withColumn("link", F.lit("")), d))
    return execute.apply_plan(local, plan, d, "pull").select("n", "code", "segment", "bal", "partner_nr", "modified")


@query(f"""{_push_sql()} SELECT CASE WHEN code <> '' THEN 'number:' || k END AS record_key, CASE WHEN k % 7 = 0 THEN 'error' ELSE action END AS action, CASE WHEN k % 7 = 0 OR action = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN action = 'error' THEN 'match key is missing or blank' WHEN k % 7 = 0 THEN 'state: ''odd'' is no int' END AS message FROM q""")
def error_items(spark, sf_dir):
    """Values that the target's columns cannot hold are error items of their own, and the other records go on."""
    local, remote = sides(spark, sf_dir)
    local = local.withColumn("segment", F.when(F.col("n") % 7 == 0, "odd").otherwise(F.col("segment")))
    return decide.one_way_plan(local, remote.withColumn("state", F.col("state").cast("int")), definition("push")).select("record_key", "action", "status", "message")


class Files:
    """A side that is a folder for each version."""

    def __init__(self, df: DataFrame, folder: str):
        self.spark, self.folder = df.sparkSession, folder
        self.write(df)

    def write(self, df: DataFrame) -> None:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.path = path

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def side(self) -> execute.Side:
        return execute.Side(self.read, self.write)


@query(f"""{_BOTH_PLAN}, w AS (SELECT *, {_BOTH_WAY} AS way FROM q)
  SELECT 'local' AS side, l.n AS k, CASE WHEN w.way = 'pull' AND action = 'updated' THEN {TO_SEGMENT} ELSE l.segment END AS what, CASE WHEN w.way = 'pull' AND action = 'updated' THEN rl.balance ELSE l.bal END AS bal FROM l LEFT JOIN w ON w.ln = l.n AND l.code <> '' LEFT JOIN rl ON rl.id = w.k
  UNION ALL SELECT 'local', k, {TO_SEGMENT}, rl.balance FROM w JOIN rl ON rl.id = k WHERE way = 'pull' AND action = 'created'
  UNION ALL SELECT 'remote', r.id, CASE WHEN w.way = 'push' AND action = 'updated' THEN {TO_STATE} ELSE r.state END, CASE WHEN w.way = 'push' AND action = 'updated' THEN l.bal ELSE r.balance END FROM r LEFT JOIN w ON w.rn = r.id LEFT JOIN ll l ON l.n = w.k
  UNION ALL SELECT 'remote', k, {TO_STATE}, l.bal FROM w JOIN ll l ON l.n = k WHERE way = 'push' AND action = 'created'""")
def both_run(spark, sf_dir):
    """Both sides after a run that writes both."""
    at = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    local, remote = (Files(df, f"{at}/{name}") for df, name in zip(sides(spark, sf_dir), ("local", "remote")))
    now = F.lit("2026-04-01 00:00:00").cast("timestamp")
    execute.run_both(definition("both"), local.side(), remote.side(), f"{at}/log", "r1", now, now, F.lit(WATERMARK).cast("timestamp_ntz"))
    ours = local.read().select(F.lit("local").alias("side"), F.coalesce("n", F.col("code").cast("long")).alias("k"), F.col("segment").alias("what"), "bal")
    return ours.unionByName(remote.read().select(F.lit("remote").alias("side"), F.col("id").alias("k"), F.col("state").alias("what"), F.col("balance").alias("bal")))


@query(f"""{_PULL_SQL} SELECT 'number:' || k AS record_key, action, names AS changed_fields FROM q JOIN rl ON rl.id = k WHERE rl.updated_at >= TIMESTAMP '2026-03-20'""")
def prefetch_pull_plan(spark, sf_dir):
    """The pull plan of an increment; local rows that it cannot touch are left out before they are shuffled."""
    local, remote = sides(spark, sf_dir)
    news = tables.increment(remote, "updated_at", None, F.lit("2026-03-20 00:00:00").cast("timestamp_ntz"))
    return decide.one_way_plan(local, news, definition("pull"), prefetch=True).select("record_key", "action", "changed_fields")


# writes


@query(f"""{BOTH_SQL}, base AS (SELECT id, state, balance FROM rl WHERE id % 3 <> 0), pay AS (SELECT id, balance + 10 AS balance FROM rl WHERE id % 2 = 0)
SELECT coalesce(base.id, pay.id) AS id, base.state, coalesce(pay.balance, base.balance)::DECIMAL(15,2) AS balance FROM base FULL OUTER JOIN pay ON base.id = pay.id""")
def merge_upsert(spark, sf_dir):
    _, remote = sides(spark, sf_dir)
    last = matching.last_per_key(remote, ["id"], ["updated_at"]).select("id", "state", "balance")
    payload = last.where("id % 2 = 0").select("id", (F.col("balance") + 10).cast("decimal(15,2)").alias("balance"), F.lit("x").alias("owner"))
    target = last.where("id % 3 <> 0")
    return apply.upsert(target, apply.gate(payload, target, ["id"]), ["id"])


@query(f"{BOTH_SQL} SELECT id, updated_at FROM r WHERE id % 4 <> 0")
def merge_delete(spark, sf_dir):
    _, remote = sides(spark, sf_dir)
    return apply.delete(remote, remote.where("id % 4 = 0").select("id"), ["id"]).select("id", "updated_at")


@query(f"{BOTH_SQL} SELECT n, (SELECT max(id) FROM r WHERE state = '1') + row_number() OVER (ORDER BY n) AS new_id FROM l WHERE partner_nr IS NULL")
def allocate_ids_scoped(spark, sf_dir):
    local, remote = sides(spark, sf_dir)
    return apply.allocate_ids(local.where("partner_nr is null").select("n"), ["n"], "new_id", "max_plus_one", remote.withColumnRenamed("id", "new_id"), F.col("state") == "1")


@query(f"{BOTH_SQL} SELECT n, 500 + row_number() OVER (ORDER BY n DESC) - 1 AS new_id FROM l WHERE partner_nr IS NULL")
def allocate_ids_sequence(spark, sf_dir):
    local, _ = sides(spark, sf_dir)
    new = local.where("partner_nr is null").select("n", (-F.col("n")).alias("o"))
    return apply.allocate_ids(new, ["o"], "new_id", "sequence", start=500).select("n", "new_id")


@query(f"{BOTH_SQL} SELECT n, CASE WHEN partner_nr IS NULL AND n % 2 = 0 THEN (n + 1000000)::VARCHAR ELSE partner_nr END AS partner_nr FROM l")
def id_write_back(spark, sf_dir):
    local, _ = sides(spark, sf_dir)
    created = local.where("partner_nr is null and n % 2 = 0").select("n", (F.col("n") + 1_000_000).cast("string").alias("partner_nr"))
    return apply.write_back(local, created, "n", "partner_nr").select("n", "partner_nr")


def _turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 != 1, F.col("text")).otherwise(F.lit("")))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


@query("SELECT conv_id, count(*) FILTER (turn % 3 <> 1 AND text <> '')::INT AS kept FROM conversations GROUP BY 1")
def child_drop_blank(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", F.size(apply.drop_blank_rows(F.col("turns"), ["text"])).alias("kept"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, CASE WHEN turn % 3 <> 1 THEN text ELSE '' END)::INT AS position, role, CASE WHEN turn % 3 <> 1 AND text <> '' THEN '+' || text ELSE '' END AS text FROM conversations")
def child_merge_by_position(spark, sf_dir):
    """Incoming rows send only the text, marked; blank ones change nothing."""
    t = _turns(spark, sf_dir)
    incoming = F.transform("turns", lambda r: F.struct(F.lit(None).cast("string").alias("role"), F.when(r["text"] != "", F.concat(F.lit("+"), r["text"])).otherwise("").alias("text")))
    merged = apply.merge_rows(F.col("turns"), incoming, ["role", "text"], ["text"])
    return t.select("conv_id", F.posexplode(merged).alias("p", "r")).select("conv_id", (F.col("p") + 1).alias("position"), "r.role", "r.text")


# sources


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
def delta_scan(spark, sf_dir):
    return tables.increment(table(spark, sf_dir, "orders"), "o_orderdate", None, F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 AND (o_orderpriority LIKE '1%' OR o_custkey IN (1, 2, 3))")
def filter_dsl(spark, sf_dir):
    return tables.scan(table(spark, sf_dir, "orders"), ["o_orderkey"], {"o_orderstatus": "O", "o_totalprice": [">", 1000]}, [["o_orderpriority", "like", "1%"], ["o_custkey", "in", [1, 2, 3]]])


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 500 AND o_orderstatus <> 'F' AND o_orderpriority IS NOT NULL AND o_orderpriority NOT LIKE '5%'")
def scope_predicates(spark, sf_dir):
    p = predicates.predicate([["o_custkey", "between", (10, 500)], ["o_orderstatus", "!=", "F"], ["o_orderpriority", "is", "set"], ["o_orderpriority", "not like", "5%"]])
    return table(spark, sf_dir, "orders").where(p).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) AND l_shipdate IS NOT NULL QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1 ORDER BY 1, 2 LIMIT 51")
def keyset_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    once = rows.join(predicates.keyset_faults(rows, ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"], "left_anti")
    return predicates.keyset_page(once, ["l_orderkey", "l_linenumber"], 50, [100, 2]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL")
def keyset_faults(spark, sf_dir):
    return predicates.keyset_faults(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1996 AND o_totalprice > 200000")
def parameterised_query(spark, sf_dir):
    text = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE year(o_orderdate) = :year AND IDENTIFIER(:price) > :least"
    return tables.query_source(spark, text, {"year": 1996, "price": "o_totalprice", "least": 200000}, {"orders": table(spark, sf_dir, "orders")})


@query("SELECT 'customer' AS source, c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def union_discovered_tables(spark, sf_dir):
    found = {"dim_customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")), "DIM_supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")), "part": table(spark, sf_dir, "part")}
    return tables.union_tables(found, "dim_").select(F.lower(F.substring("table", 5, 20)).alias("source"), "id", "label")


def _digest_sql(names: list[str], source: str, by: str = "") -> str:
    text = ", ".join(f"coalesce('=' || {c}::VARCHAR, '-')" for c in sorted(names))
    return f"SELECT {by + ' AS range, ' if by else ''}count(*) AS n_rows, bit_xor(h) AS xored, sum(h % 2147483648)::BIGINT AS summed FROM (SELECT *, ('0x' || left(md5(concat_ws(chr(31), {text})), 15))::BIGINT AS h FROM {source}) {'GROUP BY 1' if by else ''}"


@query(_digest_sql(["event_id", "ts", "user_id", "event_type", "value", "props"], "events"))
def snapshot_digest(spark, sf_dir):
    return tables.digest(table(spark, sf_dir, "events"))


@query(_digest_sql(["event_id", "ts", "user_id", "event_type", "value", "props"], "events", "CASE WHEN event_type < 'click' THEN 0 WHEN event_type < 'pz' THEN 1 WHEN event_type < 'signup' THEN 2 ELSE 3 END"))
def range_digests(spark, sf_dir):
    """The leaves of a digest tree: a digest for each range of a text key."""
    return tables.range_digests(table(spark, sf_dir, "events"), "event_type", ["click", "pz", "signup"])


@query("SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice::DECIMAL(15,2)) AS total FROM lineitem GROUP BY 1")
def group_source_records(spark, sf_dir):
    return tables.grouped(table(spark, sf_dir, "lineitem"), ["l_orderkey"], {"total": ("l_extendedprice", "decimal(15,2)")}, "n_lines")


# state


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What is tracked for orders, and their new versions: one in five changed, one in seven removed, one in eleven new."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("number:"), F.col("o_orderkey").cast("string")).alias("record_key"))
    print_ = lambda v: F.sha2(F.concat_ws("/", "k", F.lit(v)), 256)
    known = o.where("k % 11 <> 0").select("record_key", print_("1").alias("fingerprint"), F.lit(1).alias("revision"), F.array(F.concat("record_key", F.lit("-1"))).alias("documents"), F.lit("{}").alias("state"), F.lit(None).cast("string").alias("alias_of"))
    news = o.where("k % 13 <> 0").select("k", "record_key", F.when(F.col("k") % 5 == 0, print_("2")).otherwise(print_("1")).alias("fingerprint"), (F.col("k") % 7 == 0).alias("removed"))
    return known, news


def _decided(spark, sf_dir) -> DataFrame:
    known, news = _versions(spark, sf_dir)
    return state.decide(state.prepared(news, known))


_STATE_SQL = """WITH o AS (SELECT o_orderkey AS k, 'number:' || o_orderkey AS record_key FROM orders), d AS (
  SELECT *, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 11 <> 0 THEN 'reverse' ELSE 'skip' END WHEN k % 11 = 0 THEN 'create' WHEN k % 5 = 0 THEN 'replace' ELSE 'skip' END AS action FROM o WHERE k % 13 <> 0)"""


@query(f"{_STATE_SQL} SELECT record_key, CASE WHEN d.k IS NULL THEN 1 ELSE (CASE WHEN o.k % 11 = 0 THEN 0 ELSE 1 END) + (CASE WHEN o.k % 11 = 0 OR o.k % 5 = 0 OR action IN ('reverse', 'replace', 'create') THEN 1 ELSE 0 END) END AS revision, CASE WHEN d.k IS NULL THEN 1 WHEN action = 'reverse' THEN 0 WHEN action = 'skip' AND o.k % 11 = 0 THEN 0 ELSE 1 END AS n_documents FROM o LEFT JOIN d USING (record_key) WHERE d.k IS NOT NULL OR o.k % 11 <> 0")
def state_plan_revisions(spark, sf_dir):
    known, _ = _versions(spark, sf_dir)
    return state.next_state(_decided(spark, sf_dir), known).select("record_key", "revision", F.size("documents").alias("n_documents"))


@query(f"{_STATE_SQL} SELECT record_key, record_key || '-1' AS reversal_of, 'recon:' || sha256('[\"orders\",\"' || record_key || '\",\"1\",\"' || record_key || '-1\"]') AS idempotency_key FROM d WHERE action IN ('reverse', 'replace') AND k % 10 <> 5")
def reversals(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 5").select(F.concat(F.lit("number:"), F.col("o_orderkey").cast("string"), F.lit("-1")).alias("reversal_of"))
    return state.reversals(_decided(spark, sf_dir), done, "orders").select("record_key", "reversal_of", "idempotency_key")


@query(f"{_STATE_SQL} SELECT o.record_key, 'missing in the source' AS fault FROM o LEFT JOIN d USING (record_key) WHERE d.k IS NULL AND o.k % 11 <> 0")
def state_missing(spark, sf_dir):
    known, news = _versions(spark, sf_dir)
    return state.unseen(known, news).select("record_key", "fault")


@query(f"{_STATE_SQL} SELECT record_key, action FROM d WHERE NOT (action = 'skip' AND k % 11 <> 0 AND k % 5 <> 0)")
def state_unchanged(spark, sf_dir):
    return state.logged(_decided(spark, sf_dir)).select("record_key", "action")


def _with_aliases(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders that absorb the next one, some of it contradictory."""
    known, news = _versions(spark, sf_dir)
    near = lambda d: F.concat(F.lit("number:"), (F.col("k") + d).cast("string"))
    aliases = F.when(F.col("k") % 20 == 0, F.array(near(1), near(2))).when(F.col("k") % 20 == 19, F.array(near(2))).otherwise(F.array().cast("array<string>"))
    return known, news.where("k % 20 not in (1, 2)").withColumn("aliases", aliases)


@query("WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 20 NOT IN (1, 2)), a AS (SELECT k, k + 1 AS x FROM o WHERE k % 20 = 0 UNION ALL SELECT k, k + 2 FROM o WHERE k % 20 IN (0, 19)), t AS (SELECT x FROM a GROUP BY x HAVING count(DISTINCT k) > 1) SELECT DISTINCT 'number:' || k AS record_key, 'alias is claimed twice' AS fault FROM a WHERE x IN (FROM t) UNION SELECT DISTINCT 'number:' || k, 'alias is emitted too' FROM a WHERE x IN (SELECT k FROM o)")
def state_aliases(spark, sf_dir):
    known, news = _with_aliases(spark, sf_dir)
    return state.alias_faults(news, known)


@query("SELECT 'number:' || k AS record_key, string_agg('number:' || x || '-1', ',' ORDER BY 'number:' || x || '-1') AS documents FROM (SELECT o_orderkey AS k, unnest([o_orderkey + 1, o_orderkey + 2]) AS x FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey % 13 <> 0 UNION ALL SELECT o_orderkey, o_orderkey + 2 FROM orders WHERE o_orderkey % 20 = 19 AND o_orderkey % 13 <> 0) WHERE x IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <> 0) GROUP BY 1")
def alias_documents(spark, sf_dir):
    known, news = _with_aliases(spark, sf_dir)
    return state.alias_documents(news, known).select("record_key", F.array_join("alias_documents", ",").alias("documents"))


def _absorbing(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders of which one in twenty absorbs the next one, and some of those are claimed twice."""
    known, news = _versions(spark, sf_dir)
    near = lambda d: F.array(F.concat(F.lit("number:"), (F.col("k") + d).cast("string")))
    aliases = F.when(F.col("k") % 20 == 0, near(1)).when(F.col("k") % 100 == 19, near(2)).otherwise(F.array().cast("array<string>"))
    return known, news.where("k % 20 <> 1").withColumns({"aliases": aliases, "warnings": F.when(F.col("k") % 50 == 3, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>"))})


_JOB_SQL = """WITH o AS (SELECT o_orderkey AS k FROM orders), known AS (SELECT k FROM o WHERE k % 11 <> 0), news AS (SELECT k FROM o WHERE k % 13 <> 0 AND k % 20 <> 1),
  a AS (SELECT k, k + 1 AS x FROM news WHERE k % 20 = 0 UNION ALL SELECT k, k + 2 FROM news WHERE k % 100 = 19), twice AS (SELECT x FROM a GROUP BY 1 HAVING count(DISTINCT k) > 1),
  n AS (SELECT news.k, (news.k IN (FROM known))::INT AS old, coalesce((SELECT count(*) FROM a WHERE a.k = news.k AND a.x IN (FROM known)), 0) AS extra, news.k IN (SELECT k FROM a WHERE x IN (FROM twice)) AS bad, news.k IN (SELECT k FROM a) AS takes FROM news),
  d AS (SELECT *, CASE WHEN bad THEN 'error' WHEN k % 7 = 0 THEN CASE WHEN old + extra > 0 THEN 'reverse' ELSE 'skip' END WHEN old + extra = 0 THEN 'create' WHEN old = 1 AND k % 5 <> 0 THEN 'skip' ELSE 'replace' END AS action FROM n),
  s AS (SELECT *, CASE action WHEN 'create' THEN 1 WHEN 'replace' THEN 1 WHEN 'reverse' THEN 0 ELSE old + extra END AS docs FROM d WHERE action <> 'error'),
  own AS (SELECT k, old + (old = 0 OR k % 5 = 0 OR action IN ('create', 'replace') OR docs <> old)::INT AS revision, docs AS n_documents, NULL::BIGINT AS alias_of FROM s),
  moved AS (SELECT a.x AS k, (a.x IN (FROM known))::INT + 1 AS revision, 0 AS n_documents, a.k AS alias_of FROM a WHERE a.k NOT IN (SELECT k FROM d WHERE bad)),
  lost AS (SELECT k FROM known WHERE k NOT IN (FROM news) AND k NOT IN (SELECT k FROM moved))"""


@query(f"{_JOB_SQL}, every AS (SELECT * FROM own UNION ALL SELECT * FROM moved), rest AS (SELECT * FROM every UNION ALL SELECT k, 1, 1, NULL FROM known WHERE k NOT IN (SELECT k FROM every)) SELECT 'number:' || k AS record_key, revision, n_documents, 'number:' || alias_of AS alias_of FROM rest")
def state_job(spark, sf_dir):
    """The state after a whole run."""
    known, news = _absorbing(spark, sf_dir)
    return state.job("orders", news, known).state.select("record_key", "revision", F.size("documents").alias("n_documents"), "alias_of")


@query(f"{_JOB_SQL} SELECT 'number:' || k AS record_key, CASE action WHEN 'create' THEN 'created' WHEN 'skip' THEN 'skipped' WHEN 'error' THEN 'error' ELSE 'updated' END AS action, CASE WHEN bad THEN 'alias is claimed twice' ELSE action END || CASE WHEN k % 50 = 3 THEN ' | odd' ELSE '' END AS message FROM d WHERE NOT (action = 'skip' AND old = 1 AND extra = 0 AND k % 5 <> 0 AND NOT takes) OR k % 50 = 3 UNION ALL SELECT 'number:' || k, 'error', 'missing in the source' FROM lost")
def state_job_items(spark, sf_dir):
    """What a whole run logs."""
    known, news = _absorbing(spark, sf_dir)
    return state.job("orders", news, known).items.select("record_key", "action", "message")


# runs


def _runs(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.try_element_at(F.array(*map(F.lit, ["Success", "Partial Error", "Needs Review", "Error", "Skipped", "Queued", "Running"])), (k % 7 + 1).cast("int"))
    begin = F.col("o_orderdate")
    return o.select(k.alias("run"), F.concat(F.lit("def-"), (F.col("o_custkey") % 40).cast("string")).alias("definition"), status.alias("status"), begin.alias("creation"), begin.alias("started_at"), F.when(k % 4 != 0, begin + F.expr("interval 1 hour")).alias("finished_at"), begin.alias("modified"), (k % 6 == 0).alias("dry_run"))


RUNS_SQL = """WITH runs AS (SELECT o_orderkey AS run, 'def-' || (o_custkey % 40) AS definition, (['Success', 'Partial Error', 'Needs Review', 'Error', 'Skipped', 'Queued', 'Running'])[o_orderkey % 7 + 1] AS status, o_orderdate AS creation, o_orderdate AS started_at, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 1 HOUR END AS finished_at, o_orderkey % 6 = 0 AS dry_run FROM orders),
gone AS (SELECT * FROM runs WHERE status NOT IN ('Queued', 'Running') AND coalesce(finished_at, creation) <= CASE status WHEN 'Success' THEN TIMESTAMP '1997-01-01' ELSE TIMESTAMP '1996-01-01' END)"""


def _expired(spark, sf_dir) -> DataFrame:
    return runs.expired(_runs(spark, sf_dir), F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz"))


@query(f"{RUNS_SQL} SELECT run, status FROM gone")
def expired_runs(spark, sf_dir):
    return _expired(spark, sf_dir).select("run", "status")


@query(f"{RUNS_SQL} SELECT l_orderkey AS run, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT run FROM gone)")
def cascade_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", "l_partkey")
    return runs.without(items, _expired(spark, sf_dir), "run")


@query(f"{RUNS_SQL} SELECT l_partkey, l_linenumber, CASE WHEN l_orderkey IN (SELECT run FROM gone) THEN NULL ELSE l_orderkey END AS ref FROM lineitem")
def cleared_references(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", F.col("l_orderkey").alias("ref"))
    return runs.cleared(rows, _expired(spark, sf_dir), "ref", "run")


@query(f"{RUNS_SQL} SELECT run, CASE WHEN status IN ('Queued', 'Running') AND started_at <= TIMESTAMP '1997-01-01' THEN CASE status WHEN 'Queued' THEN 'Skipped' ELSE 'Error' END ELSE status END AS status FROM runs")
def stale_runs(spark, sf_dir):
    return runs.recovered(_runs(spark, sf_dir), F.lit("1997-01-01").cast("timestamp_ntz")).select("run", "status")


@query(f"{RUNS_SQL}, defs AS (SELECT n_nationkey, 'def-' || n_nationkey AS definition, n_nationkey % 5 <> 0 AS enabled, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '1998-01-01' + to_days(n_nationkey - 10) END AS next_run_at FROM nation), last AS (SELECT definition, max(finished_at) AS f FROM runs GROUP BY 1) SELECT definition FROM defs LEFT JOIN last USING (definition) WHERE enabled AND CASE WHEN next_run_at IS NOT NULL THEN next_run_at <= TIMESTAMP '1998-01-01' ELSE f IS NULL OR f < TIMESTAMP '1998-07-25' END")
def due_definitions(spark, sf_dir):
    k = F.col("n_nationkey")
    defs = table(spark, sf_dir, "nation").select(F.concat(F.lit("def-"), k.cast("string")).alias("definition"), (k % 5 != 0).alias("enabled"), F.when(k % 2 == 0, F.lit("1998-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=k - 10)).alias("next_run_at"), F.lit("1998-07-25").cast("timestamp_ntz").alias("previous_tick"))
    return runs.overdue(defs, _runs(spark, sf_dir), F.lit("1998-01-01").cast("timestamp_ntz")).select("definition")


@query(f"{RUNS_SQL} SELECT definition, max(started_at) AS watermark FROM runs WHERE status = 'Success' AND NOT dry_run GROUP BY 1")
def watermark(spark, sf_dir):
    return runs.watermarks(_runs(spark, sf_dir))


# streaming


@query("SELECT user_id, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_pull_equals_batch(spark, sf_dir):
    """Three files arrive one by one and are merged by user; the latest event of each stays, late rows lose."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("stamp"), "ts", "value")
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events.repartition(3, "event_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    merged = micro.VersionedTable(spark, f"{at}/table", events.schema, lambda df: F.col("user_id"))
    micro.pull_stream(stream, merged, ["user_id"], "stamp", f"{at}/progress").awaitTermination()
    return merged.read().select("user_id", "event_id", "ts", "value")


@query("SELECT c_custkey, c_mktsegment AS segment, (CASE WHEN c_custkey % 3 = 0 THEN c_acctbal::DECIMAL(15,2) + 5 ELSE c_acctbal::DECIMAL(15,2) END)::DECIMAL(15,2) AS bal FROM customer")
def stream_pull_plan(spark, sf_dir):
    """Remote customers arrive in three files, one in three with a new balance; two in five are new to the local table. Each batch's pull plan is applied."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(15,2)").alias("bal"))
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    remote = c.select(F.concat(F.lit("00"), F.col("c_custkey").cast("string")).alias("id"), F.col("segment").alias("state"), F.when(F.col("c_custkey") % 3 == 0, F.col("bal") + 5).otherwise(F.col("bal")).cast("decimal(15,2)").alias("balance"))
    remote.repartition(3, "id").write.parquet(f"{at}/in")
    d = Definition("customers", "pull", (FieldMap("c_custkey", "id"), FieldMap("segment", "state"), FieldMap("bal", "balance")), ("c_custkey",))
    local = micro.VersionedTable(spark, f"{at}/table", c.schema, micro.keyed_by(["c_custkey"]))
    local.write(c.where("c_custkey % 5 < 3"), -1)
    stream = spark.readStream.schema(remote.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    micro.pull_plan_stream(stream, local, d, f"{at}/progress").awaitTermination()
    return local.read()


@query("""WITH e AS (SELECT DISTINCT user_id, ts, event_type FROM events), d AS (SELECT *, lag(event_type) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
  c AS (SELECT *, CASE WHEN before IS NULL THEN 'create' WHEN before = event_type THEN 'skip' ELSE 'replace' END AS decision FROM d)
  SELECT user_id::VARCHAR AS record_key, ts AS stamp, decision, (count(*) FILTER (decision <> 'skip') OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING))::INT AS revision FROM c""")
def stream_tracked_state(spark, sf_dir):
    """What each event means for its user's state; three files arrive, out of order, and then a mark that is later than all of them."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("record_key"), F.col("event_type").alias("fingerprint"), F.lit(False).alias("removed"), F.col("ts").cast("timestamp").alias("stamp"))
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last = events.agg(F.max("stamp").alias("stamp")).select(F.lit("mark").alias("record_key"), F.lit("").alias("fingerprint"), F.lit(False).alias("removed"), (F.col("stamp") + F.expr("interval 3651 days")).alias("stamp"))
    # files of one folder need not come in the order of their rows, so that nothing is decided before the mark, with which the query is started again
    for part in (events.repartition(3, "stamp"), last):
        part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        tracked.tracked_stream(stream, "3650 days").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(tracked.ITEMS).parquet(f"{at}/out").where("record_key <> 'mark'")
    return found.select("record_key", F.col("stamp").cast("timestamp_ntz").alias("stamp"), "decision", "revision")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
