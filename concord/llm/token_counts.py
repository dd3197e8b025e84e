"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. A link leads from a node to where matching goes on when no longer piece is
found, and says how many pieces the greedy match has completed on the way, so that a word is counted in one pass over its
bytes, without building or trying pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Words of which a worker remembers the count.
KNOWN_WORDS = 500_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str, special: tuple[str, ...] = ("<|endoftext|>",)) -> list[bytes]:
    """Pieces of a byte-level vocabulary file, as bytes."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    letters = byte_letters()
    return [bytes(letters[c] for c in p) for p in pieces if p not in special]


class LongestMatch:
    """Counts the pieces of greedy longest-match segmentation. Bytes that begin no piece count as a piece each."""

    def __init__(self, vocabulary: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in {*vocabulary, *(bytes([b]) for b in range(256))} - {b""}:
            node = 0
            for b in piece:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = self.next[node][b]
            ends[node] = True
        self.link, self.popped = [0] * len(ends), [0] * len(ends)
        level = [(0, b, n) for b, n in self.next[0].items()]
        while level:  # by depth, as links lead to shorter strings
            for parent, b, node in level:
                if ends[node]:
                    self.popped[node] = 1
                    continue
                at, count = self.link[parent], self.popped[parent]
                while b not in self.next[at]:
                    count += self.popped[at]
                    at = self.link[at]
                self.link[node], self.popped[node] = self.next[at][b], count
            level = [(node, b, n) for _, _, node in level for b, n in self.next[node].items()]

    def count(self, word: bytes) -> int:
        next_, link, popped = self.next, self.link, self.popped
        node = pieces = 0
        for b in word:
            while b not in next_[node]:
                pieces += popped[node]
                node = link[node]
            node = next_[node][b]
        while node:
            pieces += popped[node]
            node = link[node]
        return pieces


def token_counts(docs: DataFrame, vocabulary: list[bytes], pattern: str) -> DataFrame:
    """docs with n_words and n_tokens added; columns of such names are replaced.

    Each match of pattern in the text is a word; n_tokens sums over them the pieces into which greedy longest match cuts
    the word's UTF-8 bytes. A null or empty text has 0 of both; texts are counted whole. Repeated rows and ties make no
    difference, and an empty table gives an empty one. The vocabulary is broadcast and does not grow with the data.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        words, automaton = regex.compile(pattern), LongestMatch(shared.value)
        known: dict[str, int] = {}
        for texts in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            rows = []
            for text in texts:
                found = words.findall(text) if text else []
                for w in set(found).difference(known):
                    known[w] = automaton.count(w.encode())
                rows.append((len(found), sum(map(known.__getitem__, found))))
            yield pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    return docs.drop("n_words", "n_tokens").withColumn("_c", count("text")).select("*", "_c.*").drop("_c")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN).select("doc_id", "n_words", "n_tokens")
