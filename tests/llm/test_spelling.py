"""Spelling variants against brute force, blocks cut small, long words, chains of forms and odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concord.llm import spelling

DOCS = "doc_id long, text string"


def one_edit(a, b):
    """Tried letter by letter: whether one insertion, deletion or replacement makes a of b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w, x in out.items():
        while out[x[1]][0]:
            x[1] = out[x[1]][0]
    return sorted((w, *x) for w, x in out.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def some_docs(n=120, seed=1):
    r = random.Random(seed)
    stems = ["".join(r.choice("aaabcdeéÀ÷sst") for _ in range(r.randint(4, 8))) for _ in range(40)]

    def word():
        w = r.choice(stems)
        for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
            k, c = r.randrange(len(w)), r.choice("abcdeést")
            w = r.choice((w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :])) or "x"
        return r.choice((w, w, w.upper(), w.title()))

    return [(i, r.choice((" ", "-", "1\n", "ł", "😀")).join(word() for _ in range(r.randint(0, 120)))) for i in range(n)]


@pytest.mark.parametrize("block_words,block_letters,classes", [(2048, 1 << 18, 4), (3, 1 << 18, 4), (50, 60, 2), (2048, 1 << 18, 1)])
def test_by_brute_force(spark, monkeypatch, block_words, block_letters, classes):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", block_letters)
    rows = some_docs()
    words = brute_words(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {tuple(r) for r in spelling.words_of(df).collect()}
    assert got == set(words.items()) and len(words) > 150
    near = {r.word: tuple(r)[1:] for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), classes).collect()}
    want = {w: (n_near, *min(((-words[x], x) for x in words if one_edit(w, x)))) for w, _, _, _, n_near, _ in brute(words) if n_near}
    assert near == {w: (k, form, -n) for w, (k, n, form) in want.items()}


def test_all_columns_and_chains(spark):
    rows = some_docs(seed=2)
    # forms of forms: abcdef (48) is what abcdex (24) stands for, and so on
    chain = ["abcdef", "abcdex", "abcdyx", "abczyx", "abwzyx"]
    rows += [(1000 + k, f"{w} " * (48 >> k)) for k, w in enumerate(chain)]
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(rows, DOCS)))
    assert got == brute(brute_words(rows))
    root = {r[0]: r[2] for r in got}
    assert root["abwzyx"] == root["abczyx"] == "abcdef"


def test_long_chains_and_shared_forms(spark, monkeypatch):
    from concord.operators import joins

    monkeypatch.setattr(joins, "FEW_ROWS", -1)
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    forms = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(70)] + [(f"x{i}", "w000") for i in range(40)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w070" for w, _ in forms}


def test_long_words_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    monkeypatch.setattr(spelling, "HELD", 5)
    r = random.Random(4)
    text = " ".join("".join(r.choice("abé1 -") for _ in range(r.randint(1, 30))) for _ in range(60))
    assert all(re.findall(spelling.RUN, text) == [x for p in spelling.pieces(text, k) for x in re.findall(spelling.RUN, p)] for k in (1, 2, 7, 100, 10_000))
    long = "".join(r.choice("abcdefé") for _ in range(30_000))
    rows = [(1, f"{long} {long} {long}"), (2, f"{long[:-1]} " * 6), (3, f"{long[:20_000]}z{long[20_001:]} " * 12), (4, "ab" * 200_000 + " x")]
    assert rows_of(spelling.spelling_variants(spark.createDataFrame(rows, DOCS))) == brute(brute_words(rows))


def test_many_classes_of_code_points(spark):
    # words of other letters, where two letters may share a count
    words = {"привет": 3, "привёт": 8, "приве": 3, "ариве": 9, "漢字漢字漢": 4, "漢字漢字": 9, "漢字字漢漢": 5, "😀😀😀😀😀": 3, "😀😀😀😀": 7, "a": 1, "b": 5}
    got = {r.word: tuple(r)[1:] for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    want = {w: [x for x in words if one_edit(w, x)] for w in words}
    assert got == {w: (len(x), min(x, key=lambda y: (-words[y], y)), max(words[y] for y in x)) for w, x in want.items() if x}


def test_odd_rows(spark):
    rows = [(None, "token " * 4), (None, None), (1, None), (2, ""), (3, "toker " * 9), (3, "toker " * 9), (4, "12 ..."), (5, "abcd abcd abcd")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("word", "n", "cell", "form", "root", "doc", "n_near")})
    assert rows_of(spelling.spelling_variants(df)) == brute(brute_words(rows))
    empty = spelling.spelling_variants(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
