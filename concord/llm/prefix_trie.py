"""The prefix trie of conversations that are rebuilt from a base's head and their own rest.

A turn is known by its reference (128 bits of a hash of role and text) and a sequence of turns by a product of them that can be composed:
``(n, B^n, sum of t_i * B^(i-1))`` modulo a prime, in several lanes. Products of stored conversations are taken once, in pieces that many tasks
compose; those of rebuilt ones follow from a base's head and a conversation's own rest by arithmetic, so that no text is ever copied, joined or
even sent. Rows of one depth and product are a node once it is verified that they name the same last turn: a product and its last turn give the
product of what comes before, so that nodes agree turn by turn down to the root. Should two different sequences have one product, all is done again with other bases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from ..operators.shared import checkpoint
from .common import crc_sql

PRIME, LANES = (1 << 31) - 1, 3
#: Ids of conversations that end in one node, joined in one row.
ENDS = 4096
SPACE = "[\\x20\\x09-\\x0D]+"


def bases(seed: int) -> list[int]:
    return [2 + int.from_bytes(hashlib.sha256(f"{seed} {k}".encode()).digest()[:4]) % (PRIME - 3) for k in range(LANES)]


def lanes(prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in range(LANES)]


# products of stored conversations


def n_words(text: Column) -> Column:
    """The number of words, which white space (U+0020, U+0009 to U+000D) sets apart."""
    return F.length(F.regexp_replace(F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "x"), SPACE, ""))


def stored_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, ref, words): what is asked of the texts, where they lie."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    own = conversations.where("conv_id is not null")
    return own.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("ref"), n_words(text).cast("long").alias("words"))


def _products(base: list[int]):
    """Of rows in order of conversation and turn, products within this partition: up to a turn (h) and before it (g), and the words before it.

    begun marks rows of the conversation that the partition begins with, which may go on from the one before.
    """

    def powers(b: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(b, len(out), PRIME)) % PRIME])
        return out[:n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None
        k, words, sums = 0, 0, [0] * LANES  # of the conversation that the batch before has left open
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            refs = np.frombuffer(b"".join(batch.column("ref").to_pylist()), np.uint32).reshape(n, 4)
            ends = np.cumsum(batch.column("words").to_numpy())
            before = ends - batch.column("words").to_numpy()
            first = int(conv[0]) if first is None else first
            new = np.append(conv[0] != last, conv[1:] != conv[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # of each row's conversation; -1 where it goes on from the batch before
            open_ = begin < 0
            local = np.arange(n) - np.maximum(begin, 0)
            at = local + np.where(open_, k, 0)
            upto, prior = [], []
            for lane, b in enumerate(base):
                # at most a batch of values below 2^31 is added up before the remainder is taken
                shift = np.where(open_, pow(b, k, PRIME), 1).astype(np.uint64)
                term = refs[:, lane].astype(np.uint64) % PRIME * powers(b, n)[local] % PRIME * shift % PRIME
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
                left = np.uint64(sums[lane])
                since = total[np.maximum(begin, 0)]
                carried = np.where(open_, left, np.uint64(0))
                upto.append((total[1:] - since + carried) % PRIME)
                prior.append((total[:-1] - since + carried) % PRIME)
            words_before = before - before[np.maximum(begin, 0)] + np.where(open_, words, 0)
            last, k, words, sums = conv[-1], int(at[-1]) + 1, int(words_before[-1] + ends[-1] - before[-1]), [int(x[-1]) for x in upto]
            ref = refs.view(np.int64)
            columns = {"conv_id": conv, "part": np.full(n, part, np.int32), "k": (at + 1).astype(np.int64), "begun": conv == first, "r0": ref[:, 0], "r1": ref[:, 1], "before": words_before, "words": ends - before}
            columns |= {name: x.astype(np.int32) for name, x in zip([*lanes("h"), *lanes("g")], [*upto, *prior])}
            yield pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in columns.items()})

    return run


PRODUCT = "conv_id long, part int, k long, begun boolean, r0 long, r1 long, before long, words long, " + ", ".join(f"{x} int" for x in [*lanes("h"), *lanes("g")])


def _composed(base: list[int]):
    """What comes before each piece of a conversation, from the products of its pieces."""

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        rows, n, words, sums = [], 0, 0, [0] * LANES
        for piece in pieces.sort_values("part").itertuples():
            weights = [pow(b, n, PRIME) for b in base]
            rows.append((piece.conv_id, piece.part, n, words, *sums, *weights))
            sums = [(s + w * int(getattr(piece, h))) % PRIME for s, w, h in zip(sums, weights, lanes("h"))]
            n, words = n + int(piece.k), words + int(piece.all_words)
        return pd.DataFrame(rows, columns=["conv_id", "part", "n0", "words0", *lanes("s"), *lanes("w")])

    return run


def products(turns: DataFrame, base: list[int]) -> DataFrame:
    """(conv_id, pos, r0, r1, before, words, h*, g*): for each stored turn its position, its reference, and the product up to it and before it.

    Turns are dealt by ranges of conversation and turn, so that a long conversation is several tasks' work. Each takes the products of its piece; those of
    conversations that several pieces share, one a piece at most, are composed and put in front.
    """
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("ref")]
    spread = turns.repartitionByRange(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = checkpoint(spread.select("conv_id", "ref", "words").mapInArrow(_products(base), PRODUCT))
    shared = rows.where("begun").select("conv_id").distinct()  # one for each partition at most
    pieces = rows.join(F.broadcast(shared), "conv_id").groupBy("conv_id", "part").agg(F.max("k").alias("k"), F.sum("words").alias("all_words"), *[F.max_by(h, "k").alias(h) for h in lanes("h")])
    fronts = pieces.groupBy("conv_id").applyInPandas(_composed(base), "conv_id long, part int, n0 long, words0 long, " + ", ".join(f"{x} long" for x in [*lanes("s"), *lanes("w")]))
    met = rows.join(F.broadcast(fronts.where("n0 > 0")), ["conv_id", "part"], "left")
    put = lambda kind, k: F.when(F.col("n0").isNull(), F.col(f"{kind}{k}").cast("long")).otherwise((F.col(f"s{k}") + F.col(f"w{k}") * F.col(f"{kind}{k}")) % PRIME).alias(f"{kind}{k}")
    of = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias("pos" if c == "k" else c)
    return met.select("conv_id", of("k", "n0"), "r0", "r1", of("before", "words0"), "words", *[put("h", k) for k in range(LANES)], *[put("g", k) for k in range(LANES)])


# rebuilt conversations


def _packed(prefix: str) -> list[Column]:
    """Three lanes as two numbers."""
    a, b, c = lanes(prefix)
    return [(F.col(a) * (1 << 31) + F.col(b)).alias(f"{prefix}a"), F.col(c).cast("long").alias(f"{prefix}b")]


def rebuilt(stored: DataFrame, base_of: Column, head: Column, most: int, base: list[int]) -> tuple[DataFrame, DataFrame]:
    """(members, convs): a row for each rebuilt conversation and depth, the root included, and a row for each conversation with its length and words.

    Only the first most turns of bases meet other conversations, as numbers.
    """
    of = stored.select("*", head.cast("long").alias("head"))
    at_head = F.col("pos") == F.col("head")
    upto = [F.coalesce(F.max(F.when(at_head, F.col(h))), F.lit(0)).alias(f"own_{h}") for h in lanes("h")]
    convs = of.groupBy("conv_id", "head").agg(F.max("pos").alias("n_own"), F.max(F.col("before") + F.col("words")).alias("own_words"), F.coalesce(F.max(F.when(at_head, F.col("before") + F.col("words"))), F.lit(0)).alias("cut_words"), *upto)
    convs = convs.withColumn("base", base_of.cast("long"))
    turn = F.struct("pos", "r0", "r1", "before", "words", *lanes("h"), *lanes("g"))
    asked = convs.where("head > 0").groupBy("base").agg(F.count("*").alias("n"))
    heads = stored.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(asked, "base").groupBy("base", "n").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # most turns each
    met = join_hot(convs, heads, ["base"], [F.col("conv_id")], how="left").drop("n", "base")
    used = F.slice(F.coalesce("turns", F.array().cast(met.schema["turns"].dataType)), 1, F.col("head").cast("int"))
    met = met.withColumn("turns", used).withColumn("taken", F.size("turns").cast("long"))
    end = F.get("turns", (F.col("taken") - 1).cast("int"))
    of_end = lambda c: F.coalesce(F.when(F.col("taken") > 0, end[c]), F.lit(0))
    met = met.withColumns({"head_words": of_end("before") + of_end("words"), **{f"head_{h}": of_end(h) for h in lanes("h")}, "len": F.col("taken") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))})
    convs = checkpoint(met.withColumn("all_words", F.col("head_words") + F.when(F.col("n_own") > F.col("head"), F.col("own_words") - F.col("cut_words")).otherwise(0)))
    out = ["conv_id", "depth", "last", "r0", "r1", "before"]
    zero = F.lit(0).cast("long")
    top = [zero.alias("depth"), (F.col("len") == 0).alias("last"), *[F.lit(None).cast("long").alias(c) for c in ("r0", "r1")], zero.alias("before")]
    root = convs.select("conv_id", *top, *[zero.alias(f"{p}{x}") for p in "hg" for x in "ab"])
    front = convs.select("conv_id", "len", F.posexplode("turns").alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "len", "t.*")
    front = front.withColumn("last", F.col("depth") == F.col("len")).select(*out, *_packed("h"), *_packed("g"))
    back = [[pow(pow(b, -1, PRIME), k, PRIME) for k in range(most + 1)] for b in base]
    own = join_hot(of.where("pos > head").drop("head"), convs.drop("turns", "own_words", "all_words"), ["conv_id"], [F.col("pos")], n="n_own")
    moved = lambda x, k: F.col(f"head_h{k}") + F.pmod(F.col(f"{x}{k}") - F.col(f"own_h{k}"), F.lit(PRIME)) * F.get(F.array(*map(F.lit, back[k])), (F.col("head") - F.col("taken")).cast("int"))
    own = own.select("conv_id", (F.col("taken") + F.col("pos") - F.col("head")).alias("depth"), "len", "r0", "r1", (F.col("head_words") + F.col("before") - F.col("cut_words")).alias("before"), *[(moved(x, k) % PRIME).alias(f"{x}{k}") for x in "hg" for k in range(LANES)])
    own = own.withColumn("last", F.col("depth") == F.col("len")).select(*out, *_packed("h"), *_packed("g"))
    return root.unionByName(front).unionByName(own), convs.select("conv_id", "len", "all_words")


# nodes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node, which come in order, joined in rows of ENDS at most."""
    node, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [node[0]], "ha": [node[1]], "hb": [node[2]], "first": [ids[0]], "n": [len(ids)], "ids": [",".join(map(str, ids))]})

    for batch in batches:
        for *key, conv in zip(*[batch.column(c).to_pylist() for c in ("depth", "ha", "hb", "conv_id")]):
            if ids and (key != node or len(ids) == ENDS):
                yield out()
                ids = []
            node = key
            ids.append(conv)
    if ids:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids of several rows, which come in order; that of one id alone is not told."""
    node, n, digest = None, 0, None

    def out() -> Iterator[pa.RecordBatch]:
        if n > 1:
            yield pa.RecordBatch.from_pydict({"depth": [node[0]], "ha": [node[1]], "hb": [node[2]], "ends_sha256": [digest.hexdigest()]})

    for batch in batches:
        for *key, m, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "ha", "hb", "n", "ids")]):
            if key != node:
                yield from out()
                node, n, digest = key, 0, hashlib.sha256()
            digest.update((("," if n else "") + ids).encode())
            n += m
    yield from out()


def ends_of(members: DataFrame) -> DataFrame:
    """(depth, ha, hb, ends_sha256) of nodes in which several conversations end. Ids are sorted and joined by ranges; a node's last task gets one row for ENDS of them."""
    order = ["depth", "ha", "hb", "conv_id"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = members.where("last").select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_chunks, "depth long, ha long, hb long, first long, n long, ids string")
    return chunks.repartition(*order[:3]).sortWithinPartitions(*order[:3], "first").drop("first").mapInArrow(_digests, "depth long, ha long, hb long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, base_of: Column, head: Column, most: int) -> DataFrame:
    """A row for each node of the prefix trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations has conv_id, turn, role and text; turns are ordered by turn (null first), then by reference. base_of and head, of conv_id, say which
    conversation gives the first turns and how many (0 to most): a conversation is rebuilt from those of the base's turns, as far as there are, and what follows as
    many of its own. A node is named by the smallest of its members (conv_id) and its depth. n_convs counts members, n_children nodes one turn
    deeper, n_leaves childless nodes below or at it; saved_tokens is the number of words that its subtree need not hold again: each node's members but one, times the words
    of its last turn; ends_sha256 is the digest of the ids that end in it.

    Sums over subtrees are sums over members: each conversation brings the words of what it shares with smaller ones, less what comes before the node, and a leaf if it is
    the smallest that ends in a childless node. So nothing is walked level by level, whatever the depth. Hot conversations, bases and nodes (the root has all) are
    counted within tasks or dealt to several.

    A null role or text is an empty one, rows with a null conv_id are left out, repeated rows are turns each. A conversation whose base is absent has
    only its own rest, and may be turnless, which makes it a member of the root. Other columns are ignored. An empty table gives an empty one.
    """
    turns = stored_turns(conversations)
    for seed in count():
        base = bases(seed)
        members, convs = rebuilt(products(turns, base), base_of, head, most, base)
        members = checkpoint(members)
        node = members.groupBy("depth", "ha", "hb").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("ga").alias("ga"), F.first("gb").alias("gb"), F.min("before").alias("before"), F.count_if("last").alias("n_ends"),
            F.min(F.when(F.col("last"), F.col("conv_id"))).alias("one_end"), *[f(c).alias(f"{c}_{k}") for c in ("r0", "r1") for k, f in (("min", F.min), ("max", F.max))],
        )
        nodes = checkpoint(node.withColumn("same", F.expr("r0_min <=> r0_max and r1_min <=> r1_max")).drop("r0_min", "r0_max", "r1_min", "r1_max"))
        if nodes.where("not same").isEmpty():
            break
    at = ["depth", "ha", "hb"]
    many = nodes.where("n_convs > 1")
    # What each conversation shares with smaller ones ends where it first names a node; from f on it is alone.
    own = nodes.groupBy("conv_id").agg(F.min("before").alias("q"), F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).alias("f"), F.max((F.col("n_ends") == F.col("n_convs")).cast("int")).alias("leaf"))
    own = convs.join(own, "conv_id", "left").select("conv_id", (F.col("len") + 1).alias("n"), F.coalesce("q", "all_words").alias("q"), "f", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    shared = join_hot(members.select("conv_id", *at), own, ["conv_id"], [F.col("depth")]).where("f is null or depth < f")
    sums = shared.groupBy(*at).agg(F.sum("q").alias("q"), F.min_by("q", "conv_id").alias("own_q"), F.sum("leaf").alias("leaves"))
    parents = many.select((F.col("depth") + 1).alias("depth"), F.col("ha").alias("ga"), F.col("hb").alias("gb"), F.col("conv_id").alias("above"), F.col("n_convs").alias("n"))
    nodes = checkpoint(join_hot(nodes.drop("same"), parents, ["depth", "ga", "gb"], [F.col("conv_id")], how="left").drop("n"))
    children = nodes.where("above is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("ga").alias("ha"), F.col("gb").alias("hb")).agg(F.count("*").alias("children"))
    full = nodes.where("n_convs > 1").join(sums, at).join(children, at, "left").join(ends_of(members), at, "left")
    alone = nodes.where("n_convs = 1")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id")
    digest = F.sha2(F.coalesce(F.col("one_end").cast("string"), F.lit("")), 256)
    full = full.select("conv_id", "depth", parent, "n_convs", F.coalesce("children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("q") - F.col("own_q") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", digest).alias("ends_sha256"))
    alone = alone.select("conv_id", "depth", parent, "n_convs", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), digest.alias("ends_sha256"))
    return full.unionByName(alone)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), c - c % 20, F.crc32(c.cast("string")) % 4, 3)


OP12_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, pos, 0 AS own, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos, 1, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
r AS (SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, string_agg(sha256(strlen(role)::VARCHAR || ':' || role || text), '') OVER w AS node FROM b
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
m AS MATERIALIZED (
  SELECT conv_id, depth, node, words, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM (SELECT * FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c)),
n AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, left(node, greatest(length(node) - 64, 0)) AS above, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS MATERIALIZED (SELECT above AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT n.node, sum((u.n_convs - 1) * u.words) AS saved, count(*) FILTER (k.node IS NULL) AS leaves FROM n JOIN n u ON u.depth >= n.depth AND left(u.node, length(n.node)) = n.node LEFT JOIN k ON k.node = u.node GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n p ON n.depth > 0 AND p.node = n.above AND p.depth = n.depth - 1
"""
