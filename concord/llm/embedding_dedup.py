"""Embedding near-duplicates by an exact metric range join.

Of unit vectors a cosine of c is a distance of sqrt(2 - 2c), and the join looks for pairs within that range. Pivots, drawn
per label, partition the vectors: each is at home in the cell of its nearest pivot. By the triangle inequality a vector v
can be within r of one at home in cell j only if it is at most r beyond the plane between any pivot i and j:
(d(v, j)^2 - d(v, i)^2) / (2 d(i, j)) <= r. There it is replicated, and each cell is joined by itself: home vectors with
each other and with visitors, in blocks. Of two cells only one gets the other's vectors, so that each pair meets once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_hot, join_kept
from ..operators.shared import checkpoint
from .common import connected_components, group_starts, local_components, whole_groups

#: A label of n vectors has about 2 + sqrt(n) / PIVOTS pivots.
PIVOTS = 8
#: Vectors that meet a copy of their label's pivots at a time; rows of a block of home vectors, and of its cell's vectors.
DEAL_ROWS, HOME_ROWS, CELL_ROWS = 4096, 1024, 4096


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; all of one length. They are first scaled by a power of two, so that no square overflows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def visits(far: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each vector, whether each vector goes to each cell) from squared distances to the pivots.

    A vector goes to its home, and to those cells it may have partners in that are the ones of the two to get visitors.
    """
    home, near = far.argmin(1), np.ones(far.shape, bool)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    for i in range(len(pivots)):
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (far - far[:, [i]]) / (2 * apart[i])
        near &= ~(beyond > reach + 1e-9)  # equal pivots part nothing
    i, j = home[:, None], np.arange(len(pivots))[None, :]
    return home, near & ((i < j) == ((i + j) % 2 == 0)) & (i != j) | (i == j)


def _cells(reach: float):
    """Each vector at home in a cell (home true) and replicated to those that it visits; rows come dealt with their label's pivots in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys := ["family", "deal"], rows=1):
            starts = group_starts(table, keys)
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows)):
                group = table.slice(lo, hi - lo)
                is_pivot = group["is_pivot"].to_numpy(zero_copy_only=False)
                pivots, part = _matrix(group.filter(pa.array(is_pivot))["embedding"]), group.filter(pa.array(~is_pivot)).combine_chunks()
                if not part.num_rows:
                    continue
                home, to = visits(np.maximum(2 - 2 * _matrix(part["embedding"]) @ pivots.T, 0), pivots, reach)
                at, cell = np.nonzero(to)
                out = part.select(["cid", "family", "n", "embedding"]).take(pa.array(at))
                out = out.append_column("cell", pa.array(cell.astype(np.int32))).append_column("home", pa.array(home[at] == cell))
                yield from out.combine_chunks().to_batches(max_chunksize=CELL_ROWS)

    return run


def _links(cosine: float):
    """From blocks of cells: for each vector how many vectors its partners there stand for, and ties (to roots) for all.

    is_home rows meet the is_cell rows of the block; of two home vectors each meets the other, a visitor is met once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys := ["family", "cell", "block", "part"], rows=1):
            starts = group_starts(table, keys)
            for lo, hi in zip(starts, np.append(starts[1:], table.num_rows)):
                group = table.slice(lo, hi - lo)
                x, size, home = _matrix(group["embedding"]), group["n"].to_numpy(), group["home"].to_numpy(zero_copy_only=False)
                left = np.flatnonzero(group["is_home"].to_numpy(zero_copy_only=False))
                right = np.flatnonzero(group["is_cell"].to_numpy(zero_copy_only=False))
                links, ties = np.zeros(len(x), np.int64), []
                for at in range(0, len(left), 256):
                    near = x[left[at : at + 256]] @ x[right].T >= cosine
                    near &= left[at : at + 256, None] != right[None, :]
                    i, j = np.nonzero(near)
                    i, j = left[i + at], right[j]
                    np.add.at(links, i, size[j])
                    met = ~home[j]  # a visitor is at home elsewhere, where this pair does not meet
                    np.add.at(links, j[met], size[i[met]])
                    ties.append((i, j))
                i, j = (np.concatenate(t) for t in zip(*ties)) if ties else (np.zeros(0, int), np.zeros(0, int))
                label = local_components(len(x), i, j)
                told = pa.array(np.flatnonzero((links > 0) | (label != np.arange(len(x)))))
                name = group["cid"].combine_chunks()
                yield pa.RecordBatch.from_pydict({"cid": name.take(told), "links": pa.array(links).take(told), "root": name.take(pa.array(label).take(told))})

    return run


def name_of(*parts: Column) -> Column:
    """A text of 128 bits for equal values."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), *parts))), 16, "0") for seed in (1, 2)])


def cells(classes: DataFrame, cosine: float) -> DataFrame:
    """(cid, family, n, embedding, cell, home): classes (cid, family, n, embedding, h) in the cells of their family, and as visitors.

    Pivots are those of a family whose h, a hash of 30 bits, is least or largest, and about sqrt(its size) / PIVOTS more, those of small h.
    """
    wide = 1 << 30
    sizes = classes.groupBy("family").agg(F.count("*").alias("rows"), F.min("h").alias("least"), F.max("h").alias("most"))
    own = join_kept(classes, checkpoint(sizes), ["family"], [F.col("cid")], n="rows")
    deals = F.ceil(F.col("rows") / DEAL_ROWS).cast("int")
    drawn = F.sqrt("rows") / PIVOTS / F.col("rows") * wide
    pivots = own.where(F.col("h").isin(F.col("least"), F.col("most")) | (F.col("h") < drawn)).withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).withColumn("is_pivot", F.lit(True))
    dealt = own.withColumn("deal", F.pmod(F.xxhash64("cid", F.lit("deal")), deals.cast("long")).cast("int")).withColumn("is_pivot", F.lit(False))
    names = ["cid", "family", "n", "embedding", "deal", "is_pivot"]
    both = pivots.select(names).unionByName(dealt.select(names)).repartition("family", "deal").sortWithinPartitions("family", "deal", F.desc("is_pivot"))
    kind = f"cid string, family string, n long, embedding {dict(classes.dtypes)['embedding']}, cell int, home boolean"
    return both.mapInArrow(_cells(math.sqrt(2 - 2 * cosine)), kind)


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label; other columns are ignored).

    Rows of equal label (of any type that can be compared, not null) and equal vector length link where their cosine, in double
    precision, is at least cosine. n_links counts the other rows linked directly, component_id is the smallest vec_id that
    links reach, kept says that it is the row's own.

    A vector that is null, empty or zero or has a null or non-finite component, and one whose label or vec_id is null,
    links with nothing (component_id is its vec_id, kept unless that is null). Equal vectors of a label are joined as one
    and count as often as they occur; rows that repeat a vec_id count each. An empty table gives an empty one.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    kind = dict(vectors.dtypes)["embedding"]
    own = vectors.select("vec_id", F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("embedding"), "label")
    own = own.withColumn("usable", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    # A family is a label and a length; vectors are equal by a name of 128 bits.
    used = own.where("usable").withColumn("family", name_of(F.col("label"), F.size("embedding"))).withColumn("cid", name_of(F.col("family"), F.col("embedding")))
    classes = used.groupBy("cid").agg(F.first("family").alias("family"), F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = checkpoint(classes.withColumn("h", F.pmod(F.xxhash64("cid"), F.lit(1 << 30))))

    placed = cells(classes.select("cid", "family", "n", "embedding", "h"), cosine)
    # Home vectors of a cell are dealt to blocks and its vectors to parts; each block meets each part once.
    sizes = placed.groupBy("family", "cell").agg(F.ceil(F.count_if("home") / HOME_ROWS).cast("int").alias("blocks"), F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts"), F.count("*").alias("rows"))
    dealt = join_kept(placed, checkpoint(sizes), ["family", "cell"], [F.col("cid")], n="rows").where("blocks > 0").withColumn("deal", F.xxhash64("cid", F.lit("cell")))
    dealt = dealt.withColumns({"own_block": F.when(F.col("home"), F.pmod("deal", F.col("blocks").cast("long")).cast("int")), "own_part": F.pmod(F.xxhash64("deal"), F.col("parts").cast("long")).cast("int")})
    as_cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.col("own_part").alias("part"), F.coalesce(F.col("own_block") == b, F.lit(False)).alias("is_home"), F.lit(True).alias("is_cell")))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own_part"))
    as_home = F.when(F.col("home"), F.transform(others, lambda p: F.struct(F.col("own_block").alias("block"), p.alias("part"), F.lit(True).alias("is_home"), F.lit(False).alias("is_cell"))))
    kind = "array<struct<block: int, part: int, is_home: boolean, is_cell: boolean>>"
    dealt = dealt.withColumn("to", F.explode(F.concat(as_cell.cast(kind), F.coalesce(as_home.cast(kind), F.array().cast(kind))))).select("cid", "family", "cell", "home", "n", "embedding", "to.*")
    keys = ["family", "cell", "block", "part"]
    found = checkpoint(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links(cosine), "cid string, links long, root string"))

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    of = classes.select("cid", "least", "n").join(links, "cid", "left").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    of = join_hot(of, least, ["component"], [F.col("cid")], n="classes").select("cid", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "n")
    out = join_hot(used.select("vec_id", "cid"), of, ["cid"], [F.col("vec_id")]).select("vec_id", "n_links", "component_id")
    alone = own.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93
), r AS (SELECT vec_id, vec_id AS reach FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.reach = p.a),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1), l AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY 1)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN l USING (vec_id)
"""
