"""Order-preserving packing by dynamic programming.

Documents, as tokens and an end mark, follow each other in the order of their rows. Cuts are chosen at document or
sentence boundaries, so that padding plus penalties for truncated documents are least. A transition's cost is linear in
both cuts, so that a monotone queue gives the best predecessor of each cut; sequences whose length is a power of two need
no padding and are tried besides.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import FOLD, SPACED, slices, word_hashes, word_spans

#: What a cut costs, in tokens of padding.
AT_SENTENCE, INSIDE_SENTENCE = 6, 48
#: What a sequence costs besides, so that short ones do not abound where they happen to need no padding.
A_SEQUENCE = 16
#: Between two boundaries that are further apart, cuts inside the sentence are allowed at this distance.
INSIDE_EVERY = 128
#: Tokens that are packed together; bounds a task's memory.
STRETCH = 1 << 20
#: Distinct units after which a worker keeps only those met again.
KNOWN_WORDS = 250_000


def best_cuts(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Positions in at of the cuts that cost least; at: token offsets of allowed cuts, the first 0 and the last the end.

    Neighbouring cuts are at most size apart. cost is that of cutting there; padding is size less the tokens between two
    cuts, or nothing where these are a power of two. Of equal costs the latest predecessor wins.
    """
    exact: dict[int, list[int]] = {}  # for each cut the earlier ones at a distance that needs no padding
    for power in (1 << k for k in range(size.bit_length())):
        place = np.minimum(np.searchsorted(at, at - power), len(at) - 1)
        there = np.flatnonzero(at[place] == at - power)
        for k, i in zip(there.tolist(), place[there].tolist()):
            exact.setdefault(k, []).append(i)
    best, back, queue = [0], [0], deque([(0, 0)])
    offsets, costs = at.tolist(), cost.tolist()
    for k in range(1, len(offsets)):
        t = offsets[k]
        while offsets[queue[0][1]] < t - size:
            queue.popleft()
        value, j = queue[0]
        least = value + size - t
        for i in exact.get(k, ()):
            if best[i] <= least:
                least, j = best[i], i
        best.append(least + costs[k] + A_SEQUENCE)
        back.append(j)
        value = best[k] + t
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, k))
    cuts, k = [], len(offsets) - 1
    while k:
        cuts.append(k)
        k = back[k]
    return cuts[::-1]


class Encoder:
    """Token ids of texts, found for each distinct unit once.

    A unit is what white space leaves, cut further where letters meet ASCII digits or signs, if it has no apostrophe and
    nothing beyond ASCII but the letters of Latin-1: the tokenizer's own pattern never crosses these places. Units are
    cut and hashed for a whole slice at once; new runs of letters go to the tokenizer as one text, whose ids
    fall apart at the tokens that end a word. A text that holds one of the tokenizer's added tokens, which rank before all
    that, goes to the tokenizer whole.
    """

    def __init__(self, spec: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.marks = [t["content"].encode().lower() for t in json.loads(spec).get("added_tokens") or []]
        words = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.known: dict[int, bytes] = {}
        self.before: dict[int, bytes] = {}
        self.end = np.array([end_id], "<u4").tobytes()

    def _learn(self, names: list[int], units: list[bytes], letters: list[bool]) -> None:
        runs = [(n, u) for n, u, a in zip(names, units, letters) if a]
        for lo in range(0, len(runs), 4096):
            part = runs[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode(b" ".join(u for _, u in part).decode(), add_special_tokens=False).ids, "<u4")
            cuts = np.append(0, np.flatnonzero(self.ends_word[ids]) + 1)
            if len(cuts) != len(part) + 1:
                raise ValueError("the tokenizer does not end each word with a token of its own")
            raw = ids.tobytes()
            self.known.update((n, raw[4 * i : 4 * j]) for (n, _), i, j in zip(part, cuts.tolist(), cuts[1:].tolist()))
        rest = [(n, u) for n, u, a in zip(names, units, letters) if not a]
        for (n, _), e in zip(rest, self.tokenizer.encode_batch([u.decode() for _, u in rest], add_special_tokens=False)):
            self.known[n] = np.array(e.ids, "<u4").tobytes()

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Folded bytes; begin, end and row of each unit; whether it is a run of letters, and whether a sentence ends with it."""
        low, lead = FOLD[data], data == 0xC3
        second = np.append(False, lead[:-1]) if len(data) else lead
        low[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
        letter = ((low >= 0x61) & (low <= 0x7A)) | (data >= 0x80)
        odd = (data == 0x27) | ((data >= 0x80) & ~lead & ~(second & (data != 0x97) & (data != 0xB7)))
        starts, ends, row = word_spans(data, offsets, SPACED)
        odds = np.append(0, np.cumsum(odd))
        whole = odds[ends] > odds[starts]
        change = np.zeros(len(data) + 1, np.int8)
        change[starts[whole]] += 1
        change[ends[whole]] -= 1
        within = np.cumsum(change[:-1], dtype=np.int8) > 0
        cut = np.append(False, (letter[1:] != letter[:-1]) & SPACED[data[1:]] & SPACED[data[:-1]] & ~within[1:]) if len(data) else odd
        cut[starts] = True
        begin = np.flatnonzero(cut)
        word = np.searchsorted(starts, begin, "right") - 1
        last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        end = np.where(last, ends[word], np.append(begin[1:], 0)) if len(word) else begin
        after = data[np.minimum(ends, len(data) - 1)] if len(data) else data
        final = data[ends - 1] if len(ends) else data
        sentence = (final == 0x2E) | (final == 0x21) | (final == 0x3F) | (after == 0x0A)
        return low, begin, end, row[word], letter[begin] & ~whole[word], last & sentence[word]

    def encode(self, texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """Each text's ids (little-endian 32-bit) with the end mark, and the numbers of ids up to which sentences reach."""
        for _, data, offsets in slices(texts):
            low, begin, end, row, letters, sentence = self._units(data, offsets)
            names, first, which = np.unique(word_hashes(low, begin, end), return_index=True, return_inverse=True)
            if len(self.known) > KNOWN_WORDS:
                self.known, self.before = {}, self.known
            listed = names.tolist()
            new = []
            for k, n in enumerate(listed):
                if n not in self.known:
                    if (ids := self.before.get(n)) is None:
                        new.append(k)
                    else:
                        self.known[n] = ids
            if new:
                at = first[new]
                raw = low.tobytes()
                self._learn([listed[k] for k in new], [raw[i:j] for i, j in zip(begin[at].tolist(), end[at].tolist())], letters[at].tolist())
            parts = [self.known[n] for n in listed]
            size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            flat, at = np.frombuffer(b"".join(parts), "<u4"), np.append(0, np.cumsum(size))
            length = size[which]
            upto = np.append(0, np.cumsum(length))
            ids = flat[np.repeat(at[which] - upto[:-1], length) + np.arange(upto[-1])]
            edge = np.searchsorted(row, np.arange(len(offsets)))
            folded = low.tobytes()
            at = [m.start() for mark in self.marks if mark in folded for m in re.finditer(re.escape(mark), folded)]
            marked = set((np.searchsorted(offsets, at, "right") - 1).tolist())
            for k, (lo, hi) in enumerate(zip(edge, edge[1:])):
                if k in marked:
                    yield self._plain(data[offsets[k] : offsets[k + 1]].tobytes().decode()) + self.end, np.zeros(0, np.int64)
                else:
                    yield ids[upto[lo] : upto[hi]].tobytes() + self.end, upto[lo + 1 : hi + 1][sentence[lo:hi]] - upto[lo]

    def _plain(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = False
        try:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True


def _packed(shared, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, end_id)
        sequence = TaskContext.get().partitionId() << 40
        docs: list[tuple[int, bytes, np.ndarray]] = []
        held = 0

        def pack() -> pa.RecordBatch:
            """Packs the documents held; the last sequence may be short, and is cut at powers of two if that costs less."""
            nonlocal sequence
            starts = np.cumsum([0] + [len(ids) // 4 for _, ids, _ in docs])
            at = np.concatenate([starts] + [s + ends for s, (_, _, ends) in zip(starts, docs)])
            rank = np.zeros(len(at), np.int64)
            rank[len(starts) :] = AT_SENTENCE
            gap_from = np.unique(at)
            every = min(INSIDE_EVERY, size)
            wide = np.flatnonzero(np.diff(gap_from) > every)
            inside = [np.arange(gap_from[k] + every, gap_from[k + 1], every) for k in wide]
            tail = [starts[-1] - np.cumsum([1 << k for k in range(size.bit_length() - 1)])] if starts[-1] >= size else []
            at = np.concatenate([at, *inside, *tail])
            rank = np.append(rank, np.full(len(at) - len(rank), INSIDE_SENTENCE))
            order = np.lexsort((rank, at))
            at, rank = at[order], rank[order]
            once = np.append(True, at[1:] != at[:-1])
            at, rank = at[once], rank[once]
            cuts = at[best_cuts(at, rank, size)]
            edges = np.unique(np.concatenate([starts, cuts]))
            begin, length = edges[:-1], np.diff(edges)
            doc = np.searchsorted(starts, begin, "right") - 1
            seq = np.searchsorted(cuts, begin, "right")
            seq_start = np.append(0, cuts)[seq]
            inner = begin - starts[doc]
            crc = [zlib.crc32(docs[d][1][4 * s : 4 * (s + n)]) for d, s, n in zip(doc, inner, length)]
            batch = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([docs[d][0] for d in doc], pa.int64()), "start": pa.array(inner), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(np.diff(starts)[doc]), "sequence_id": pa.array(sequence + seq), "offset": pa.array(begin - seq_start), "ids": pa.array([docs[d][1][4 * s : 4 * (s + n)] for d, s, n in zip(doc, inner, length)], pa.binary()),
            })
            sequence += len(cuts)
            return batch

        for batch in batches:
            for doc_id, (ids, ends) in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                docs.append((doc_id, ids, ends))
                held += len(ids) // 4
                if held >= STRETCH:
                    yield pack()
                    docs, held = [], 0
        if docs:
            yield pack()

    return run


def pack(docs: DataFrame, tokenizer_json: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """Pieces of documents (doc_id, text; other columns are ignored) in sequences of at most size tokens.

    A row per piece: doc_id, start and length in its document's tokens, ids_crc32, doc_tokens, sequence_id, offset in
    its sequence, and ids (little-endian 32-bit). Each token is in one piece; a sequence's pieces follow each other from
    offset 0. size is a power of two. Each partition packs its rows in their order and in stretches of STRETCH tokens
    (and the rest of a document), with no shuffle. Docs are to be read from a table: its rows come in the same order
    when a lost task runs again.

    A null or empty text is its end mark alone; a text is never cut short. Rows that repeat a doc_id are documents of
    their own, and a null doc_id stays null; doc_id is an integer. An empty table gives an empty one.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    with open(tokenizer_json, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(_packed(shared, end_id, size), schema)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096).drop("ids")
