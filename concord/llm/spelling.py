"""Spelling variants: words that differ from a more frequent one by one edit.

A word's letters are counted; by the counts of a few classes of letters words fall into cells. One edit moves a word to a cell whose
counts differ by one letter more, less or exchanged, so that each cell is compared with itself and with cells of its own and
the next length that are one such step away. Two cells' letter counts are multiplied block by block: a Gram matrix gives all
squared distances, which one edit leaves at two at most, and what remains is compared letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_kept
from ..operators.shared import checkpoint
from .common import crc_sql

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(65, 91)}
#: One run in so many (by its hash) has a letter deleted.
DELETED = 97
#: Code points of a text that are taken apart at a time, and words that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 1 << 17
#: Letter counts are by code point modulo LETTERS, where each letter of RUN has its own; cells are by code point modulo CLASSES.
LETTERS, CLASSES = 160, 4
#: Words of a block, and letters in all of them.
BLOCK_WORDS, BLOCK_LETTERS = 2048, 1 << 18
#: Lengths up to which products of letter counts are exact in single precision.
EXACT = 2000


# words


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text of about this size that cut no run in two."""
    at = 0
    while at < len(text):
        m = RUN.match(text, at + size)
        end = m.end() if m else at + size
        yield text[at:end]
        at = end


def _counted(least: int):
    """Counts words of at least so many letters: within a task, and in parts of HELD words at most."""

    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                begun = zlib.crc32(f"{name}:".encode())
                for piece in pieces(text.as_py() or ""):
                    for run_, n in Counter(RUN.findall(piece)).items():
                        word = run_.lower() if run_.isascii() else run_.translate(SMALL)
                        h = zlib.crc32(word.encode(), begun)
                        if h % DELETED == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                        if len(word) >= least:
                            total[word] += n
                    if len(total) >= HELD:
                        yield out(total)
                        total = Counter()
        yield out(total)

    return run


def words_of(docs: DataFrame, least: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n) of docs (doc_id, text): words of at least so many letters that come at least so many times. Each task counts before words are sent."""
    counted = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text").mapInArrow(_counted(least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# cells


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words one after the other, and the length of each word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(w) for w in words], np.int64)


def counts_of(words: list[str], modulo: int) -> np.ndarray:
    codes, lengths = codes_of(words)
    at = np.repeat(np.arange(len(words)), lengths) * modulo + codes % modulo
    return np.bincount(at, minlength=len(words) * modulo).reshape(len(words), modulo)


def steps(classes: int) -> np.ndarray:
    """What takes a word's cell to the cells where it is compared: its own, those of one letter less, and half of those of one exchanged."""
    one = np.eye(classes, dtype=np.int64)
    exchanged = [one[j] - one[i] for i in range(classes) for j in range(i + 1, classes)]
    return np.array([np.zeros(classes, np.int64), *-one, *exchanged])


def _celled(classes: int):
    """(word, n, cell, home): a row for each cell where a word is compared; home is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = steps(classes)
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            cells = counts_of(words, classes)[None] + ways[:, None]  # way, word, class
            for k, cell in enumerate(cells):
                there = np.flatnonzero((cell >= 0).all(1))
                names = [".".join(map(str, c)) for c in cell[there].tolist()]
                take = pa.array(there)
                yield pa.RecordBatch.from_pydict({"word": batch.column("word").take(take), "n": batch.column("n").take(take), "cell": pa.array(names, pa.string()), "home": pa.array([k == 0] * len(there), pa.bool_())})

    return run


class Block:
    """Words of one length and cell (part of a large one), and what is near them so far."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n, self.length = words, n, len(words[0])
        self.codes = codes_of(words)[0].reshape(len(words), self.length)
        kind = np.float32 if self.length < EXACT else np.float64
        self.counts = counts_of(words, LETTERS).astype(kind)
        self.square = (self.counts**2).sum(1)
        self.near: dict[str, list] = {}

    def tell(self, word: str, n: int, other: str) -> None:
        best = self.near.setdefault(word, [0, 0, ""])
        best[0] += 1
        if n > best[1] or (n == best[1] and other < best[2]):
            best[1:] = n, other

    def compare(self, words: list[str], n: list[int], own: bool = False) -> None:
        """Finds pairs of words of the block and others, which have its length or one letter more; own are the block's own, each pair of which counts once."""
        at = {k: [i for i, w in enumerate(words) if len(w) == self.length + k] for k in (0, 1)}
        for k, rows in at.items():
            step = max(1, min(BLOCK_WORDS, BLOCK_LETTERS // (self.length + k)))
            for lo in range(0, len(rows), step):
                self._compare([words[i] for i in rows[lo : lo + step]], [n[i] for i in rows[lo : lo + step]], k, lo if own else None)

    def _compare(self, words: list[str], n: list[int], longer: int, first: int | None) -> None:
        counts = counts_of(words, LETTERS).astype(self.counts.dtype)
        distance = self.square[:, None] + (counts**2).sum(1) - 2 * (self.counts @ counts.T)
        i, j = np.nonzero(distance <= 2)
        if first is not None:
            i, j = i[i < j + first], j[i < j + first]
        codes = codes_of(words)[0].reshape(len(words), self.length + longer)
        step = max(1, (1 << 22) // self.length)
        for lo in range(0, len(i), step):
            a, b = i[lo : lo + step], j[lo : lo + step]
            one = self._one_edit(self.codes[a], codes[b])
            for x, y in zip(a[one].tolist(), b[one].tolist()):
                self.tell(self.words[x], n[y], words[y])
                self.tell(words[y], self.n[x], self.words[x])

    @staticmethod
    def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which rows of b are those of a with one letter replaced or, where b is longer, inserted."""
        length = a.shape[1]
        if b.shape[1] == length:
            return (a != b).sum(1) == 1
        before, after = a != b[:, :-1], a != b[:, 1:]
        same = np.where(before.any(1), before.argmax(1), length)  # letters that agree from the front
        last = np.where(after.any(1), length - after[:, ::-1].argmax(1), 0)  # where those that agree to the end begin
        return last <= same


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is near each word, of rows (word, n, cell, part, later) ordered by cell, part and later: a block's words first, then those that it is compared with."""
    key, own, block = None, [], None

    def done() -> Iterator[pa.RecordBatch]:
        if block is not None and block.near:
            near = block.near.values()
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(block.near.keys(), pa.string()), "n_near": pa.array([x[0] for x in near], pa.int64()), "form_n": pa.array([x[1] for x in near], pa.int64()), "form": pa.array([x[2] for x in near], pa.string()),
            })

    def begun() -> Block | None:
        if not own:
            return None
        made = Block([w for w, _ in own], [n for _, n in own])
        made.compare(made.words, made.n, own=True)
        return made

    for batch in batches:
        words, n, cells, parts, later = (batch.column(c).to_pylist() for c in ("word", "n", "cell", "part", "later"))
        lo = 0
        while lo < len(words):
            here, hi = (cells[lo], parts[lo], later[lo]), lo
            while hi < len(words) and (cells[hi], parts[hi], later[hi]) == here:
                hi += 1
            if here[:2] != key:
                block = block or begun()
                yield from done()
                key, own, block = here[:2], [], None
            if not here[2]:
                own += zip(words[lo:hi], n[lo:hi])
            else:
                block = block or begun()
                if block is not None:
                    block.compare(words[lo:hi], n[lo:hi])
                    if len(block.near) > 4 * BLOCK_WORDS:
                        yield from done()
                        block.near = {}
            lo = hi
    block = block or begun()
    yield from done()


def near_words(words: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(word, n_near, form, form_n): of words (word, n; each once, none empty) those with near ones, how many these are, and the most frequent one (ties: the first by code points).

    A cell of more than BLOCK_WORDS words (or BLOCK_LETTERS letters) is several blocks, by a hash of the word; those words that are compared with it meet each
    block by themselves, and a task holds one block and a part of them. Blocks give counts and the best word for each word, not pairs. Cells that are several blocks are one in
    BLOCK_WORDS words at most, and are broadcast.
    """
    rows = words.select("word", "n").mapInArrow(_celled(classes), "word string, n long, cell string, home boolean")
    sizes = rows.where("home").groupBy("cell").agg(F.count("*").alias("rows"), F.max(F.length("word")).alias("long"))
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_WORDS), F.ceil(F.col("rows") * F.col("long") / BLOCK_LETTERS)).cast("int")
    large = sizes.select("cell", parts.alias("parts")).where("parts > 1")
    rows = rows.join(F.broadcast(large), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("word"), F.col("parts").cast("long")).cast("int")))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("own", F.col("parts") - 1))))
    rows = rows.select("word", "n", "cell", "part", (~F.col("part").eqNullSafe(F.col("own"))).alias("later"))
    found = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "later").mapInArrow(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): where forms of forms end. Each round doubles how far all words have gone; a form that many words share meets them in several tasks."""
    at = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        asked = at.groupBy("root").agg(F.count("*").alias("n"))
        onward = checkpoint(asked.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"))
        if onward.isEmpty():
            return at
        at = checkpoint(join_kept(at, onward, ["root"], [F.col("word")], how="left").select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(docs: DataFrame, least: int = 5, least_n: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of docs (doc_id, text), the more frequent near word that each stands for, and where forms end.

    A run of letters is lower-cased in A-Z; one in DELETED (by the hash of doc_id and run) loses a letter. Words are those of at least so many letters and
    occurrences. Two are near if one letter inserted, deleted or replaced makes one the other. A word's form is its most frequent near word (ties: the
    first by code points) if that has at least so many times its occurrences.

    A null text has no runs, a null doc_id counts as an empty one, repeated rows count each. Texts are taken apart in pieces, whatever their length. Other
    columns are ignored. An empty table gives an empty one.
    """
    words = checkpoint(words_of(docs, least, least_n))
    near = words.join(near_words(words), "word", "left")
    stands = F.col("form_n") >= times * F.col("n")
    near = checkpoint(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(stands, F.col("form")).alias("form"), F.when(stands, F.col("form_n")).alias("form_n")))
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
low AS (SELECT doc, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY 1, 2),
hashed AS (SELECT *, doc || ':' || run AS named, {crc_sql("(doc || ':' || run)")} AS h FROM low),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
near AS MATERIALIZED (SELECT word, count(*) AS n_near, min((-n, other)) AS best FROM pairs GROUP BY 1),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n
  FROM words w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM forms JOIN ends USING (word)
"""
