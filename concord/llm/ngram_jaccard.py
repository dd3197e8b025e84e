"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes its set of hashed word n-grams, and a signature of MinHash values of 8 bits each. Texts with equal
   sets are one class from here on.
2. Classes whose values agree in a whole band are candidates. Bands are cut so that a pair at the threshold agrees in none
   with a probability of at most ``miss``.
3. Within each band's group the values of a pair are compared step by step; as soon as the posterior probability that
   its similarity reaches the threshold is below ``tolerance``, the pair is dropped. What stays ties classes into clusters.
4. Each cluster's pairs are pruned alike and then verified on the exact sets. Large groups of both kinds are dealt in
   blocks that meet in pairs, and pairs never become rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_hot
from ..operators.shared import checkpoint
from .common import FOLD, FOLDED, U64, connected_components, group_starts, in_blocks, local_components, slices, whole_groups, window_hashes, word_hashes, word_spans

BAND = 5  # values (bytes) of a band
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 18  # of one of the two chunks of a block


def bands_for(threshold: float, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**BAND)))


def least_matches(threshold: float, steps: list[int], tolerance: float) -> list[int]:
    """For each number of compared values the fewest that may agree: with fewer, the posterior probability of reaching
    the threshold is below tolerance. The prior is uniform; unequal minima agree in 8 bits once in 256."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in steps:
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() >= tolerance * like.sum():
                out.append(m)
                break
    return out


class Pruner:
    def __init__(self, threshold: float, width: int, tolerance: float, step: int = 36):
        self.cuts = [*range(0, width, step), width]
        self.least = least_matches(threshold, self.cuts[1:], tolerance)

    def keep(self, sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Positions of the pairs that no step drops."""
        at, agree = np.arange(len(left)), np.zeros(len(left), np.int32)
        for lo, hi, least in zip(self.cuts, self.cuts[1:], self.least):
            agree = agree + (sig[left[at], lo:hi] == sig[right[at], lo:hi]).sum(1, dtype=np.int32)
            stay = agree >= least
            at, agree = at[stay], agree[stay]
        return at


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-grams of words; of all its words if it has fewer than n."""
    for _, data, offsets in slices(texts):
        data = FOLD[data]
        starts, ends, row = word_spans(data, offsets, FOLDED)
        words = word_hashes(data, starts, ends)
        grams = window_hashes(words, n)
        edge = np.searchsorted(row, np.arange(len(offsets)))
        for lo, hi in zip(edge, edge[1:]):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield window_hashes(words[lo:hi], int(hi - lo))
            else:
                yield np.zeros(0, U64)


def _factors(width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, 1 << 31, width, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, width, np.uint32)


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    x = (grams >> U64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        least = np.minimum(least, (a[:, None] * x[None, lo : lo + 2048] + b[:, None]).min(1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def class_of(grams: np.ndarray) -> str:
    """A name of 128 bits for a set of n-grams."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest()


def _signatures(n: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _factors(width)
        for batch in batches:
            out: list[tuple] = [(class_of(g), len(g), minhash(g, a, b)) if len(g) else (None, 0, None) for g in shingle_sets(batch.column("text"), n)]
            name, size, sig = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "name": pa.array(name, pa.string()), "n_shingles": pa.array(size, pa.int64()), "sig": pa.array(sig, pa.binary())})

    return run


def _matrix(sig: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(-1, width)


def _bands(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column("sig"), width).reshape(batch.num_rows, width // BAND, BAND).astype(np.int64)
            key = np.broadcast_to(np.arange(width // BAND), sig.shape[:2]).copy()
            for k in range(BAND):
                key = key << 8 | sig[:, :, k]
            yield pa.RecordBatch.from_pydict({"band": pa.array(key.ravel()), "cid": pa.array(np.repeat(batch.column("cid").to_numpy(), width // BAND))})

    return run


def _pairs(group: np.ndarray, chunk: np.ndarray, within: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group, some at a time; in a block of two chunks only those across. group: where each row's group ends."""
    alive, lag, held, n = np.arange(len(group)), 1, [], 0
    while True:
        alive = alive[alive + lag < group[alive]]
        if len(alive):
            meet = alive[within[alive] | (chunk[alive] != chunk[alive + lag])]
            held.append((meet, meet + lag))
            n += len(meet)
        if n > 50_000 or not len(alive):
            if n:
                yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
        if not len(alive):
            return
        lag += 1


def _ties(width: int, pruner: Pruner):
    """From blocks of a band's group, links (a, b) that tie together what no step of the comparison keeps apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys := ["band", "block_i", "block_j"]):
            starts = group_starts(table, keys)
            ends = np.repeat(np.append(starts[1:], table.num_rows), np.diff(np.append(starts, table.num_rows)))
            sig, cid = _matrix(table["sig"].combine_chunks(), width), table["cid"].to_numpy()
            label = np.arange(len(cid))
            for left, right in _pairs(ends, table["chunk"].to_numpy(), table["block_i"].to_numpy() == table["block_j"].to_numpy()):
                at = pruner.keep(sig, left, right)
                label = label[local_components(len(cid), label[left[at]], label[right[at]])[label]] if len(at) else label
                label = label[label]
            tied = np.flatnonzero(label != np.arange(len(cid)))
            if len(tied):
                yield pa.RecordBatch.from_pydict({"a": pa.array(cid[tied]), "b": pa.array(cid[label[tied]])})

    return run


def _members(n: int):
    """The sets of n-grams of the texts that stand for their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [g.tobytes() if class_of(g) == c else None for g, c in zip(shingle_sets(batch.column("text"), n), batch.column("name").to_pylist())]
            table = batch.drop_columns(["text"]).append_column("grams", pa.array(grams, pa.binary()))
            yield table.filter(table.column("grams").is_valid())

    return run


def shared_counts(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams the sets of each pair share."""
    if len(left) <= 2 * len(grams):
        return np.array([len(np.intersect1d(grams[i], grams[j], assume_unique=True)) for i, j in zip(left, right)], np.int64)
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[count[column[order]] > 1]
    column = np.unique(column[order], return_inverse=True)[1]
    total = np.zeros((len(grams), len(grams)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        part = slice(*np.searchsorted(column, [lo, lo + 1024]))
        has = np.zeros((len(grams), 1024), np.float32)
        has[owner[order[part]], column[part] - lo] = 1
        total += has @ has.T
    return total[left, right].astype(np.int64)


def _verified(width: int, pruner: Pruner, threshold: float):
    """From blocks of clusters: for each class how many documents its partners there stand for, and a tie to the least class it reaches."""
    ratio = Fraction(threshold).limit_denominator(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys := ["cluster", "block_i", "block_j"], rows=1):
            starts = group_starts(table, keys)
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows)):
                part = table.slice(lo, hi - lo)
                name = part["name"].to_numpy()
                once = np.append(True, name[1:] != name[:-1])  # a class comes twice if its document does
                part = part.filter(pa.array(once)).combine_chunks()
                name, docs, chunk = part["name"].combine_chunks(), part["n_docs"].to_numpy(), part["chunk"].to_numpy()
                sig = _matrix(part["sig"].combine_chunks(), width)
                grams = [np.frombuffer(g, U64) for g in part["grams"].to_pylist()]
                size = np.array([len(g) for g in grams])
                within = np.broadcast_to(part["block_i"][0] == part["block_j"][0], len(name))
                links, label = np.zeros(len(name), np.int64), np.arange(len(name))
                kept = [(left[at], right[at]) for left, right in _pairs(np.full(len(name), len(name)), chunk, within) for at in [pruner.keep(sig, left, right)]]
                left, right = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, int), np.zeros(0, int))
                if len(left):
                    shared = shared_counts(grams, left, right)
                    near = shared * ratio.denominator >= (size[left] + size[right] - shared) * ratio.numerator
                    left, right = left[near], right[near]
                    np.add.at(links, left, docs[right])
                    np.add.at(links, right, docs[left])
                    label = local_components(len(name), left, right)
                yield pa.RecordBatch.from_pydict({"name": name, "links": pa.array(links), "root": name.take(pa.array(label))})

    return run


def ngram_jaccard(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-7, miss: float = 1e-6) -> DataFrame:
    """(doc_id, class_id, n_links, n_shingles, set_id) for each row of docs (doc_id, text; other columns are ignored).

    Words are runs of digits, letters a-z (A-Z folded) and characters beyond ASCII; a text is the set of its n-grams of
    words, or of all its words in a row if it has fewer than n. Documents link where the Jaccard similarity of these
    sets reaches the threshold. n_links counts the other documents linked directly, class_id is the smallest doc_id that
    links reach, set_id the smallest one with the same set.

    A null text, or one without a word, links with nothing (n_shingles 0). Rows that repeat a doc_id count as documents
    of their own; doc_id is an integer. A row whose doc_id is null takes no part: class_id and set_id null, n_links 0. An empty table gives an
    empty one. A link is missed with a probability of about miss + tolerance; what is reported is exact.
    """
    width = BAND * bands_for(threshold, miss)
    pruner = Pruner(threshold, width, tolerance)
    own = docs.where("doc_id is not null").select("doc_id", "text")
    sigs = checkpoint(own.mapInArrow(_signatures(n, width), "doc_id long, name string, n_shingles long, sig binary"))
    classes = sigs.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    # cid is short for the name where classes only become candidates: should two classes share one, they are candidates of each other's.
    classes = checkpoint(classes.withColumn("cid", F.xxhash64("name")))

    bands = classes.select("cid", "sig").mapInArrow(_bands(width), "band long, cid long")
    often = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    grouped = join_hot(bands, often, ["band"], [F.col("cid")]).join(classes.select("cid", "sig"), "cid")
    blocks = in_blocks(grouped, "band", "cid", F.ceil(F.col("n") / BLOCK_ROWS)).drop("n")
    keys = ["band", "block_i", "block_j"]
    ties = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_ties(width, pruner), "a long, b long")
    clusters = connected_components(ties)
    clusters = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())

    members = clusters.select(F.col("node").alias("cid"), F.col("component").alias("cluster")).join(classes, "cid")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"), F.count("*").alias("n"))
    members = join_hot(members, sizes, ["cluster"], [F.col("name")]).select("name", "cluster", "rep", "n_docs", "sig", "blocks")
    texts = own.join(members.hint("shuffle_hash"), own.doc_id == members.rep).select("name", "cluster", "n_docs", "sig", "blocks", "text")
    sets = texts.mapInArrow(_members(n), "name string, cluster long, n_docs long, sig binary, blocks long, grams binary")
    keys = ["cluster", "block_i", "block_j"]
    blocks = in_blocks(sets, "cluster", "name", F.col("blocks")).drop("blocks").repartition(*keys).sortWithinPartitions(*keys, "name")
    verified = checkpoint(blocks.mapInArrow(_verified(width, pruner, threshold), "name string, links long, root string"))

    links = verified.groupBy("name").agg(F.sum("links").alias("links"))
    joined = connected_components(verified.select(F.col("name").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("name", "rep", "n_docs").join(links, "name", "left").join(joined.withColumnRenamed("node", "name"), "name", "left")
    of_class = of_class.withColumn("component", F.coalesce("component", "name"))
    least = of_class.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    of_class = join_hot(of_class, least, ["component"], [F.col("name")]).select("name", "class_id", "rep", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("n_docs").alias("n"))
    out = join_hot(sigs.select("doc_id", "name", "n_shingles"), of_class, ["name"], [F.col("doc_id")], how="left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_shingles", F.coalesce("rep", "doc_id").alias("set_id"))
    null = F.lit(None).cast("long")
    apart = docs.where("doc_id is null").select("doc_id", null.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_shingles"), null.alias("set_id"))
    return out.unionByName(apart)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=0.8, n=5)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), g AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS grams FROM w
), s AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g WHERE len(grams) > 0),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 5 >= (a.n + b.n - count(*)) * 4
), r AS (SELECT doc_id, doc_id AS reach FROM g UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT doc_id, min(reach) AS class_id FROM r GROUP BY 1),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM p GROUP BY 1),
e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(grams)) AS set_id FROM g WHERE len(grams) > 0)
SELECT g.doc_id, c.class_id, coalesce(l.n_links, 0) AS n_links, len(g.grams) AS n_shingles, coalesce(e.set_id, g.doc_id) AS set_id
FROM g JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN e USING (doc_id)
"""
