"""The prefix trie against a trie built turn by turn, with pieces cut small, colliding products and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from concord.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def reference(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, reference(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        whole[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * words
    return sorted(
        (of[0], len(node), members[node[:-1]][0] if node else None, len(of), children[node], leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in of if whole[c] == node).encode()).hexdigest())
        for node, of in members.items()
    )


def trie(df):
    c = F.col("conv_id")
    return prefix_trie.conversation_trie(df, c - c % 20, F.crc32(c.cast("string")) % 4, 3)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def conversations(n=150, seed=1, long=9):
    r = random.Random(seed)
    said = [(r.choice(["user", "assistant", "", None]), r.choice(["", None, "a b", "a  b\tc", " é d 😀 "])) for _ in range(5)]
    stems = [[r.choice(said) for _ in range(long)] for _ in range(4)]
    rows = []
    for c in r.sample(range(-40, 400), n):
        turns = r.choice(stems)[: r.randint(1, long)] + [r.choice(said) for _ in range(r.choice((0, 0, 0, 1, 3)))]
        at = r.sample(range(1000), len(turns))
        rows += [(c, k if i or r.random() < 0.9 else None, *t) for i, (k, t) in enumerate(zip(sorted(at), turns))]
    r.shuffle(rows)
    return rows


@pytest.fixture
def few_rows_a_batch(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("seed", [1, 2])
def test_by_brute_force(spark, seed):
    rows = conversations(seed=seed)
    assert rows_of(trie(spark.createDataFrame(rows, TURNS))) == brute(rows)


def test_long_conversations_in_many_pieces(spark, few_rows_a_batch, monkeypatch):
    from concord.operators import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 4)
    monkeypatch.setattr(prefix_trie, "ENDS", 2)
    rows = conversations(n=20, seed=3)
    r = random.Random(5)
    said = [("user", r.choice("abc")) for _ in range(400)]
    rows += [(c, k, *t) for c in (500, 501, 502) for k, t in enumerate(said)]
    rows += [(c, 1, "user", "same") for c in range(1000, 1060)]
    assert rows_of(trie(spark.createDataFrame(rows, TURNS))) == brute(rows)


def test_products_that_collide_are_taken_anew(spark, monkeypatch):
    real, asked = prefix_trie.bases, []

    def bases(seed):
        asked.append(seed)
        return [1] * prefix_trie.LANES if seed == 0 else real(seed)  # sums that do not tell the order

    monkeypatch.setattr(prefix_trie, "bases", bases)
    rows = [(20 * c, k, "user", t) for c, text in enumerate(["xabz", "xbaz", "xab", "yab"]) for k, t in enumerate(text)]
    assert rows_of(trie(spark.createDataFrame(rows, TURNS))) == brute(rows)
    assert asked == [0, 1]


def test_products_compose(spark, few_rows_a_batch):
    """Each product is what a plain loop gives, whatever the pieces."""
    rows = conversations(n=25, seed=7, long=40)
    base = prefix_trie.bases(0)
    got = {(x.conv_id, x.pos): tuple(x[f"h{k}"] for k in range(3)) + tuple(x[f"g{k}"] for k in range(3)) + (x.before, x.words) for x in prefix_trie.products(prefix_trie.stored_turns(spark.createDataFrame(rows, TURNS)), base).collect()}
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, reference(role or "", text or ""), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    want = {}
    for c, turns in own.items():
        h, n, before = [0] * 3, 0, 0
        for _, _, ref, words in sorted(turns):
            g = list(h)
            h = [(x + int.from_bytes(ref[4 * k : 4 * k + 4], "little") * pow(base[k], n, prefix_trie.PRIME)) % prefix_trie.PRIME for k, x in enumerate(h)]
            n += 1
            want[c, n] = (*h, *g, before, words)
            before += words
    assert got == want


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (40, 1, "user", "hi there"), (40, 1, "user", "hi there"), (40, None, None, None), (43, 2, "b", "z"), (43, 2, "a", "z"), (7, 1, "user", "w " * 60_000), (0, 5, "user", ""), (61, 1, "user", "alone"), (-3, 1, "user", "below"), (62, None, "", "")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("depth", "ref", "pos", "part", "before", "words", "head", "base", "last", "n", "ha", "n_convs")})
    got = rows_of(trie(df))
    assert got == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)  # turnless conversations end in the root
    empty = trie(df.limit(0))
    assert empty.count() == 0 and empty.columns == COLUMNS
