"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the windows of the benchmark's items. A table of shifts over blocks of two words lets the search
skip positions where no test string can end; where the shift is 0, the block's bucket names the test strings that end
so, and direct comparison confirms them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import checkpoint
from .common import FOLD_WORDS

#: Test strings in one search table; a larger benchmark is searched in several tables, one after the other.
TABLE_WINDOWS = 200_000


class WuManber:
    """Finds test strings, all of m words, in lists of words."""

    def __init__(self, strings: list[tuple[bytes, ...]], m: int):
        self.m, self.block = m, min(2, m)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], int]] = {}
        for k, s in enumerate(strings):
            for end in range(self.block, m + 1):
                b = s[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, m), m - end)
            self.bucket.setdefault(s[m - self.block :], {})[s[: m - self.block]] = k

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, test string) of each occurrence, by start."""
        m, size, far = self.m, self.block, self.m - self.block + 1
        shift, bucket = self.shift, self.bucket
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - size : end])
            skip = shift.get(block, far)
            if skip:
                end += skip
                continue
            k = bucket.get(block, {}).get(tuple(words[end - m : end - size]))
            if k is not None:
                yield end - m, k
            end += 1


def folded_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z folded) and characters beyond ASCII."""
    return text.encode().translate(FOLD_WORDS).split() if text else []


def windows(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [tuple(words)] if words else []


def _tables(items: Iterator[tuple[str | None, str | None]], n: int) -> Iterator[tuple[list[str | None], dict]]:
    """Search tables of at most TABLE_WINDOWS test strings, with the items' ids: per length the strings and the items of each. The first may be empty."""
    first = True
    ids: list[str | None] = []
    strings: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    count = 0
    for item, text in items:
        own = windows(folded_words(text), n)
        if not own:
            continue
        ids.append(item)
        for w in own:
            of = strings.setdefault(len(w), {}).setdefault(w, [])
            if not of or of[-1] != len(ids) - 1:
                of.append(len(ids) - 1)
        count += len(own)
        if count >= TABLE_WINDOWS:
            yield ids, strings
            ids, strings, count, first = [], {}, 0, False
    if ids or first:
        yield ids, strings


def _search(shared):
    """The number of words of each text, and occurrences of one table's strings in it: spans of words, and the items."""

    @F.pandas_udf("n_words long, spans array<struct<start: int, end: int>>, items array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids, strings = shared.value
        finders = [(WuManber(list(by), m), list(by.values())) for m, by in strings.items()]
        for texts in batches:
            numbers, spans, items = [], [], []
            for text in texts:
                words, found, at = folded_words(text), set(), []
                for finder, of in finders:
                    for start, k in finder.find(words):
                        if at and at[-1][0] <= start <= at[-1][1]:
                            at[-1] = (at[-1][0], max(at[-1][1], start + finder.m))
                        else:
                            at.append((start, start + finder.m))
                        found.update(of[k])
                numbers.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in at])
                items.append(sorted({ids[k] for k in found} - {None}))
            yield pd.DataFrame({"n_words": numbers, "spans": spans, "items": items})

    return search


def covered(spans):
    """How many positions an array of spans (start, end) covers, each once."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).cast("long").alias("n"), F.greatest(acc["to"], s["end"]).alias("to")),
    )
    return step["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs with n_words, hit_spans, n_hit, items and contaminated added (a column of such a name is replaced).

    docs has text, benchmark has item_id and text; other columns are kept or ignored. Test strings are the windows of n
    words of each item, or the whole item if it has fewer. A word of a document is hit if an occurrence covers it; items
    (sorted as strings) are those with an occurring window; hit_spans are runs of words, end exclusive.

    A null or empty text, or one without words, has no hits; such an item is no test string. An item whose id is null marks words
    and is in no list; items that repeat an id are one item. An empty benchmark contaminates nothing, and an empty table
    gives an empty one. Rows that repeat are judged each.

    The benchmark is dealt into tables of TABLE_WINDOWS windows (and those of a table's last item). Driver and workers
    hold one table at a time: between two tables what was found so far is kept in the checkpoint folder, with its document.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hit_spans", "n_hit", "items", "contaminated")
    rows = ((r.item_id, r.text) for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator())
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*own, F.array().cast("array<struct<start: int, end: int>>").alias("_spans"), F.array().cast("array<string>").alias("_items"))
    for k, table in enumerate(_tables(rows, n)):
        found = (checkpoint(out) if k else out).withColumn("_found", _search(spark.sparkContext.broadcast(table))(F.col("text")))
        out = found.select(*own, F.col("_found.n_words").alias("_n_words"), *[F.concat(f"_{c}", f"_found.{c}").alias(f"_{c}") for c in ("spans", "items")])
    out = out.select(*own, F.col("_n_words").alias("n_words"), F.array_sort("_spans").alias("hit_spans"), F.array_sort(F.array_distinct("_items")).alias("items"))
    return out.withColumn("n_hit", covered(F.col("hit_spans"))).withColumn("contaminated", F.col("n_hit") > 0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS m, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM b WHERE len(words) > 0)
), m AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(words[i:i + m - 1], ' ') AS gram
  FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, m WHERE len(words) >= m)
), hit AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw USING (m, gram)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
