"""What several operators share: words and windows of whole Arrow batches, checkpoints, components, blocks of pairs.

Texts reach Python as Arrow buffers. Words are found and hashed for all rows of a slice at once, on the UTF-8 bytes,
so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import hot_keys, join_hot
from ..operators.shared import checkpoint

U64 = np.uint64
#: Rows of an Arrow batch that carries whole texts; bounds what a Python worker holds.
TEXT_ROWS = "256"
#: Bytes of text that are taken apart at a time (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20


def _bytes_of(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        table[lo : hi + 1] = True
    return table


#: Bytes of a word when words are what white space (U+0020, U+0009 to U+000D) leaves.
SPACED = ~_bytes_of((0x20, 0x20), (0x09, 0x0D))
#: Bytes of a word when words are runs of digits, small letters and all beyond ASCII; texts are folded first.
FOLDED = _bytes_of((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: A-Z to a-z, other bytes unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
#: For bytes.translate(): A-Z folded, and all that is not of a word is a space.
FOLD_WORDS = bytes(int(FOLD[b]) if FOLDED[FOLD[b]] else 0x20 for b in range(256))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows in this session from now on, as rows may hold whole texts. Queries ask for it in a session of their own, pipeline stages in the one that they get; operators leave the session as it is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)


def small_session(spark: SparkSession) -> SparkSession:
    """A session as this one is, but with Arrow batches of few rows; this one is left as it is."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name) and own.conf.get(name, None) != value:
            own.conf.set(name, value)
    small_batches(own)
    return own


#: The remainders of CRC-32 for four bits at a time.
_CRC = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's bytes, in SQL."""
    half = lambda x: f"xor(({x}) >> 4, {_CRC}[(({x}) & 15) + 1])"
    of_bytes = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {of_bytes}), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


# words


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins and the last ends. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about size bytes."""
    data, at = buffers(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1))
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends (exclusive), and its row; no word crosses rows."""
    inside = of_word[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of x bears on all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes, from running sums over at most SLICE_BYTES (or one word) at a time."""
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = data[base : ends[hi - 1]]
        power, inverse = _power_tables(max(SLICE_BYTES, len(part)) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[s]) * inverse[s])
        lo = hi
    return out


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of each left part followed by its right part."""
    return mix(left * U64(0xD6E8FEB86659FD93) + right)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row; callers mask windows that cross rows."""
    if len(words) < n:
        return np.zeros(0, U64)
    if n % 2 == 0:
        half = window_hashes(words, n // 2)
        return join_hashes(half[: len(words) - n + 1], half[n // 2 :])
    out = np.full(len(words) - n + 1, U64(n))
    for k in range(n):
        out = out * U64(0xD6E8FEB86659FD93) + words[k : k + len(out)]
    return mix(out)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    n, have, least = len(a) - width + 1, 1, a
    if n <= 0:
        return a[:0]
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[:n], least[width - have :][:n]) if have < width else least


# groups


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Batches, sorted by keys, dealt anew so that no group is split between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(group_starts(table, keys)[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def in_blocks(df: DataFrame, group: str, member: str, chunks: Column) -> DataFrame:
    """Rows of a large group dealt to blocks that meet in pairs, so that any two members share just one block.

    A group in c chunks makes c * (c + 1) / 2 blocks; a row goes to c of them, and carries its own chunk. Pairs are
    compared where chunk differs, or all of them where block_i = block_j.
    """
    return (
        df.withColumn("chunks", chunks.cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64(F.col(member), F.lit("chunk")), F.col("chunks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("block_i", F.least("chunk", "other"))
        .withColumn("block_j", F.greatest("chunk", "other"))
        .drop("other", "chunks")
    )


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links left-right reach."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], least)
        np.minimum.at(label, label[right], least)
        label = label[label]
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            open_ = label[left] != label[right]
            if not open_.any():
                break
            left, right = left[open_], right[open_]
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b) that is not its component's least: component is the least node that it reaches.

    Alternating large-star and small-star rounds; each is two grouped minima and joins on the node, and is kept in the
    checkpoint folder. A round begins with the nodes that have very many links, if there are any: these links are dealt to
    several tasks. Nodes with no edge to another do not appear. Nulls must be filtered by the caller.
    """
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    spark, seen = edges.sparkSession, None

    def met(left: DataFrame, right: DataFrame, key: str, member: str, hot: list) -> DataFrame:
        if not hot:
            return left.join(right, key)
        known = spark.createDataFrame(hot, f"{key} {dict(left.dtypes)[key]}, _parts int")
        return join_hot(left, right, [key], [F.col(member)], hot=known)

    while True:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        hot = [tuple(r) for r in hot_keys(both.groupBy("x").agg(F.count("*").alias("n")), ["x"]).collect()]  # HOT_KEYS at most
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = met(both, least, "x", "y", hot).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = checkpoint(met(large, root, "u", "v", hot).select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct())
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
