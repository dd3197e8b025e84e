"""Substring deduplication by level-wise doubling.

A window of ``min_words`` words can only be repeated if the shorter windows in it are. Each level looks for repeated
windows of one length among what the level before has left, and only around these are windows of twice that length
tried, up to ``min_words`` or until no candidate survives. Below ``min_words`` a level needs one window in each stretch
of ``min_words`` words: the one of least hash, which equal stretches share, so that a level of length n shuffles about
2 / (min_words - n + 2) rows a word. At ``min_words`` itself every surviving window is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import checkpoint
from .common import SPACED, U64, mix, slices, sliding_min, window_hashes, word_hashes, word_spans

#: One document in so many tells which windows are frequent: those that SEEN of them hold, the FREQUENT most frequent ones at most.
#: Windows around a frequent one are first compared within so many parts of the documents.
EVERY, SEEN, FREQUENT, PARTS = 64, 32, 2000, 512
#: Sets apart the second 64 bits of a whole window's hash from the first.
SECOND = U64(0x5851F42D4C957F2D)


def _words(texts: pa.Array):
    """(first row, row of each word, hash of each word) of slices of texts."""
    for lo, data, offsets in slices(texts):
        starts, ends, row = word_spans(data, offsets, SPACED)
        yield lo, row, word_hashes(data, starts, ends)


def _inside(row: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words lie in one row."""
    return row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.zeros(0, bool)


def _live(words: np.ndarray, row: np.ndarray, window: int, length: int, of: np.ndarray) -> np.ndarray:
    """Which windows lie in one row and have their least window of this length among those of."""
    live = _inside(row, window)
    return live & np.isin(sliding_min(window_hashes(words, length), window - length + 1), of) if len(live) else live


def _rows(batch: pa.RecordBatch, take: np.ndarray, h: np.ndarray, more: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64))} | {"doc_id": batch.column("doc_id").take(pa.array(take))} | more)


def _again(row: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of these windows, in order of row and start, occur further to the front of their row."""
    order = np.lexsort((g, h, row))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return again


def _candidates(window: int, before: int | None, length: int, frequent: np.ndarray):
    """Windows of this length among those that the level before (its length) has left; the hash and document and, for
    whole windows, more of the hash, the start, whether the document has it before and whether it holds a frequent shorter window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, row, words in _words(batch.column("text")):
                if len(words) < window:
                    continue
                n = int(row[-1]) + 1
                live = _live(words, row, window, before, batch.column("repeated").slice(lo, n).flatten().to_numpy(zero_copy_only=False).view(U64)) if before else _inside(row, window)
                if not live.any():
                    continue
                h = window_hashes(words, length)
                if length == window:
                    g = window_hashes(mix(words ^ SECOND), length)
                    at = np.flatnonzero(live)
                    first = np.searchsorted(row, row[at], "left")
                    more = {"g": g[at].view(np.int64), "start": (at - first).astype(np.int32), "again": _again(row[at], h[at], g[at]), "often": _live(words, row, window, before, frequent)[at]}
                    yield _rows(batch, row[at] + lo, h[at], {k: pa.array(v) for k, v in more.items()})
                else:
                    width = window - length + 1
                    least = np.where(live, sliding_min(h, width), U64(0))
                    around = np.concatenate([np.zeros(width - 1, U64), ~U64(0) - least, np.zeros(width - 1, U64)])
                    around[: width - 1] = around[len(around) - width + 1 :] = ~U64(0)
                    most = ~U64(0) - sliding_min(around, width)  # of the windows that hold each position
                    at = np.flatnonzero((most == h) & (most > 0))
                    yield _rows(batch, row[at] + lo, h[at], {})

    return run


def _repeated(frequent: np.ndarray):
    """Of rows sorted by h those whose h comes more than once, or is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, False  # the last row of the batch before, and whether it repeats the one in front of it
        for batch in batches:
            table = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
            if not table.num_rows:
                continue
            h = table["h"].to_numpy()
            same = h[1:] == h[:-1]
            keep = np.append(before, same) | np.append(same, False)
            keep |= np.isin(h.view(U64), frequent)
            before = bool(same[-1]) if len(same) else before
            yield from table.slice(0, len(h) - 1).filter(pa.array(keep[:-1])).to_batches()
            held, last = table.slice(len(h) - 1).to_batches()[0], keep[-1:]
        if held is not None:
            yield from pa.Table.from_batches([held]).filter(pa.array(last)).to_batches()

    return run


def _cut(window: int):
    """Counts and what is kept of each text, from the starts of the windows that occur earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts")):
                words = (text.as_py() or "").encode().split()
                kept = words
                if starts.is_valid and len(starts.values):
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(edge, np.minimum(at, len(words)), 1)
                    np.add.at(edge, np.minimum(at + window, len(words)), -1)
                    kept = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(digest, pa.string())})

    return run


def substring_dedup(docs: DataFrame, min_words: int = 20, first_length: int = 10) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each text without the words of windows that occur earlier.

    docs has doc_id and text; other columns are ignored. A word goes if some window of min_words words that covers it
    also starts earlier: in a document of smaller doc_id, or in the same one further to the front. kept_text is the
    words left, joined by one space. first_length, doubled again and again, must give min_words.

    A null text has no words; a text of fewer than min_words words stays whole. Rows that repeat a doc_id count as one
    document: a start that goes in one of them goes in all. A row whose doc_id is null comes before or after no other and
    stays whole. doc_id is an integer. An empty table gives an empty one. Windows are equal by 128 bits of hash.
    """
    length = first_length
    while length < min_words:
        length *= 2
    if length != min_words or not 1 <= first_length < min_words:
        raise ValueError("min_words must be first_length, doubled at least once")
    every = docs.select("doc_id", "text")
    own = every.where("doc_id is not null")
    length, before, source, frequent = first_length, None, own, np.zeros(0, U64)
    while length < min_words:
        # What is frequent only decides where rows go: it is told from whole documents, one in EVERY, and what is missed is no less exact.
        some = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(EVERY)) == 0).mapInArrow(_candidates(min_words, before, length, frequent), "h long, doc_id long")
        often = [r.h for r in some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()]
        found = source.mapInArrow(_candidates(min_words, before, length, frequent), "h long, doc_id long")
        frequent = np.sort(np.array(often, np.int64).view(U64))
        found = found.repartition(F.when(F.col("h").isin(often), F.xxhash64("doc_id")).otherwise(F.col("h")) if often else F.col("h")).sortWithinPartitions("h")
        repeated = found.mapInArrow(_repeated(frequent), "h long, doc_id long").groupBy("doc_id").agg(F.collect_set("h").alias("repeated"))
        source = own.join(checkpoint(repeated), "doc_id").select("doc_id", "text", "repeated")
        length, before = length * 2, length
    # Of a window around a frequent one the first of each part meet once more. One exchange of the texts serves this and the cut.
    found = source.mapInArrow(_candidates(min_words, before, min_words, frequent), "h long, doc_id long, g long, start int, again boolean, often boolean")
    found = found.withColumn("part", F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).otherwise(F.lit(-1)))
    found = found.withColumn("first", F.min("doc_id").over(Window.partitionBy("h", "g", "part")))
    heads = found.where("part >= 0 and not again and doc_id = first").withColumn("first", F.min("doc_id").over(Window.partitionBy("h", "g")))
    later = found.where("again or doc_id > first").unionByName(heads.where("doc_id > first"))
    later = later.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    cut = own.join(later, "doc_id", "left").select("doc_id", "text", "starts")
    alone = every.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))
    return cut.unionByName(alone).mapInArrow(_cut(min_words), "doc_id long, n_words long, n_removed long, kept_text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=20, first_length=10)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
