"""Secret scans by an incremental blob ledger.

Each version of a file is addressed by the hash of its content. A ledger keeps which blob has been scanned by which
version of which rule, and what was found; only pairs it lacks are scanned, once for all paths that hold the blob, and
findings are joined back to every path. All of it is built-in functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from ..operators.shared import checkpoint, shared_folder


@dataclass(frozen=True)
class Rule:
    """A pattern and, by a second pattern that a whole match must meet, what of its matches counts. A new version is scanned anew."""

    kind: str
    version: int
    pattern: str
    keep: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?"
#: In the order in which spans of equal start are listed. Of access and hex the least length is in the pattern, which gives the same spans.
RULES = [
    Rule("assign", 1, _KEY + "[A-Za-z0-9+/_.=-]+", "^" + _KEY + "[A-Za-z0-9+/_.=-]{8,}$"),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]{32,}"),
]
_SPAN = "array<struct<start: int, rank: int, kind: string, end: int>>"


#: Values that are added up in one go where sums of all values before each are made (see before).
BLOCK = 32


def let(value: Column, use) -> Column:
    """use(value) with value found once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column) -> Column:
    """For each value of an array of whole numbers the sum of those before it, from sums of BLOCK values and of BLOCK such sums, so that the work is in proportion to their number."""
    add = lambda array, lo, hi: F.aggregate(F.sequence(lo, hi), F.lit(0).cast("long"), lambda acc, i: acc + F.get(array, i))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    sums = lambda array: F.transform(F.sequence(F.lit(0), block(F.size(array) - 1)), lambda b: add(array, b * BLOCK, F.least((b + 1) * BLOCK, F.size(array)) - 1))
    # up to and with the value itself, which is taken off again: a range is never empty
    inside = lambda array, i: add(array, block(i) * BLOCK, i) - F.get(array, i)

    def whole(v: Column) -> Column:
        tops = lambda one, two: let(F.transform(two, lambda x, k: add(two, F.lit(0), k) - x), lambda top: F.transform(v, lambda _, i: F.get(top, block(block(i))) + inside(one, block(i)) + inside(v, i)))
        return let(sums(v), lambda one: let(sums(one), lambda two: tops(one, two)))

    return F.when(F.size(values) > 0, let(values, whole)).otherwise(F.array().cast("array<bigint>"))


def _places(pieces: Column) -> Column:
    """From pieces (gap, n, match), match after match, array<struct<start, end, match>>."""
    at = before(F.transform(pieces, lambda x: (x["gap"] + x["n"]).cast("long")))
    place = lambda x, b: F.struct((b + x["gap"]).cast("int").alias("start"), (b + x["gap"] + x["n"]).cast("int").alias("end"), x["match"].alias("match"))
    return F.zip_with(pieces, at, place)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The kept matches of a rule, leftmost and non-overlapping, in code points with end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    gaps = F.split(text, rule.pattern, -1)
    pieces = F.filter(F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("match"))), lambda x: x["match"].isNotNull())
    at = let(pieces, _places)
    kept = F.filter(at, lambda s: s["match"].rlike(rule.keep)) if rule.keep else at
    out = F.transform(kept, lambda s: F.struct(s["start"], F.lit(rank), F.lit(rule.kind), s["end"])).cast(_SPAN)
    return F.when(text.rlike(rule.pattern), out).otherwise(F.array().cast(_SPAN))


class Ledger:
    """Scanned pairs of blob and rule version, with findings: a table in a folder, to which each scan appends.

    Without a path the ledger is kept in the folder that driver and executors share.
    """

    SCHEMA = f"blob binary, rules array<string>, spans {_SPAN}"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
        self.add(spark.createDataFrame([], self.SCHEMA))  # so that there is a table to read

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def add(self, new: DataFrame) -> None:
        """Keeps new rows; what a failed scan has written does not count."""
        new.write.mode("append").parquet(self.path)


#: Blobs whose hashes are broadcast at most, when a scan asks for their texts (about 100 bytes each), and findings likewise.
FEW_BLOBS, FEW_SPANS = 200_000, 200_000


def address(text: Column) -> Column:
    """A text's blob: the SHA-256 of its content. A null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def look(versions: DataFrame, ledger: Ledger, rules: list[Rule] = RULES) -> DataFrame:
    """Scans what the ledger lacks of versions (text), adds it to the ledger and returns (blob, n): the number of versions of each blob.

    The ledger is asked by hash which pairs of blob and rule version it lacks. Texts move only for these, and are scanned once
    however many versions hold them. The hashes of unseen blobs are broadcast if they are FEW_BLOBS at most; otherwise texts
    are sent to their hash, where repeated ones of a partition are sent once, and meet them there.
    """
    own = versions.select(F.coalesce("text", F.lit("")).alias("text"), address(F.col("text")).alias("blob"))
    names = {r.name: r for r in rules}
    counts = checkpoint(own.groupBy("blob").agg(F.count("*").alias("n")))
    seen = ledger.read().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    lacking = F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>")))
    asked = checkpoint(counts.join(seen, "blob", "left").select("blob", lacking.alias("rules")).where(F.size("rules") > 0))
    few = asked.count() <= FEW_BLOBS
    texts = own.join(F.broadcast(asked.select("blob")), "blob", "left_semi") if few else own
    texts = texts.groupBy("blob").agg(F.first("text").alias("text")).join(F.broadcast(asked) if few else asked, "blob")
    none = F.array().cast(_SPAN)
    parts = [F.when(F.array_contains("rules", name), spans(F.col("text"), r, k)).otherwise(none) for k, (name, r) in enumerate(names.items())]
    ledger.add(texts.select("blob", "rules", F.concat(*parts).alias("spans")))
    return counts


def scan(versions: DataFrame, ledger: Ledger, rules: list[Rule] = RULES) -> DataFrame:
    """versions (text and any other columns) with blob and spans in place of text: what rules find in each version.

    Pairs of blob and rule version that the ledger lacks are scanned (see look); what it has of older rule versions does not
    count. spans are ordered by start, then rule. A null text is an empty one. Columns called blob or spans are
    replaced. Versions that are repeated get their findings each. An empty table gives an empty one.
    """
    own = versions.withColumn("blob", address(F.col("text"))).drop("text", "spans")
    return with_findings(own, findings(look(versions, ledger, rules), ledger, rules))


def findings(counts: DataFrame, ledger: Ledger, rules: list[Rule] = RULES) -> DataFrame:
    """(blob, n, spans): of blobs with n versions what rules have found, by what the ledger has of them; none without a finding."""
    asked = F.transform(F.array_intersect("rules", F.array(*[F.lit(r.name) for r in rules])), lambda r: F.substring_index(r, "@", 1))
    found = ledger.read().select("blob", F.filter("spans", lambda s: F.array_contains(asked, s["kind"])).alias("spans")).where(F.size("spans") > 0)
    # repeated ones are next to each other once all are sorted; comparing each with all others would take the square of their number
    every = F.array_sort(F.flatten(F.collect_list("spans")))
    found = found.groupBy("blob").agg(every.alias("spans")).withColumn("spans", let(F.col("spans"), lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, i - 1)))))
    return checkpoint(found.join(counts, "blob").select("blob", "n", "spans"))


def with_findings(own: DataFrame, found: DataFrame) -> DataFrame:
    """own (blob and others) with spans; broadcast if there are FEW_SPANS spans and blobs at most."""
    few = found.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0] <= FEW_SPANS
    others = [F.col(f"`{c}`") for c, kind in own.dtypes if "map<" not in kind and "variant" not in kind]
    out = own.join(F.broadcast(found.drop("n")), "blob", "left") if few else join_hot(own, found, ["blob"], others, how="left").drop("n")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))


def listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Every document is a path's only version: the first scan sees those that came first, the second all, and scans what the first has not seen.
    ledger = Ledger(spark)
    look(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), ledger)
    out = scan(docs, ledger)
    return out.select("doc_id", *[number(r.kind).alias(f"n_{r.kind}") for r in RULES], F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p(kind, rank, pat) AS (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+')),
m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, text, regexp_extract_all(text, (SELECT pat FROM p WHERE rank = 0)) AS ms FROM d
  UNION ALL SELECT doc_id, 'access', 1, text, regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 'hex', 2, text, regexp_extract_all(text, '[0-9a-f]{32,}') FROM d
), cut AS (
  SELECT doc_id, kind, rank, ms, CASE rank
    WHEN 0 THEN string_split_regex(text, (SELECT pat FROM p WHERE rank = 0))
    WHEN 1 THEN string_split_regex(text, 'AKIA[A-Z0-9]+')
    ELSE string_split_regex(text, '[0-9a-f]{32,}') END AS gaps FROM m WHERE len(ms) > 0
), each AS (
  SELECT doc_id, kind, rank, ms[i] AS m,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM cut)
), kept AS (
  SELECT doc_id, kind, rank, start::BIGINT AS start, (start + length(m))::BIGINT AS stop FROM each
  WHERE (rank = 0 AND length(regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8
     OR rank = 1 AND length(m) >= 16 OR rank = 2)
), agg AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM kept GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)
"""
