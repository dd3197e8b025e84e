"""The pipeline's stages on a small corpus, and the whole of it against the operators' own promises."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_stages(spark, tmp_path):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    test = text(12)
    base = text(60)
    rows = [(i, text(50), "en") for i in range(20)] + [(20, base, "en"), (21, base + " omega", "en"), (22, base, "en"), (23, text(5) + " " + test + " " + text(5), "en"), (24, text(30) + ' token = "0123456789abcdef0123" ' + text(20), "en"), (25, "12 34 !!", None), (26, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "pack" or docs.columns == columns
        kept[name] = {x.doc_id for x in docs.select("doc_id").collect()}
    everyone = set(range(20)) | {20, 23, 24}
    assert kept["language_id"] == everyone | {21, 22}
    assert kept["ngram_jaccard"] == everyone
    assert kept["decontaminate"] == kept["secret_scan"] == kept["pack"] == everyone - {23}
    clean = {x.doc_id: x for x in spark.read.parquet(f"{tmp_path}/secret_scan").collect()}
    assert "0123456789" not in clean[24].text and corpus_pipeline.REMOVED in clean[24].text and clean[24].n_chars == len(clean[24].text)
    assert all(clean[i].text == t for i, t, _ in rows if i < 20)
    out = corpus_pipeline.run(spark, str(tmp_path))
    columns = [c for c in out.columns if c != "sequence_id"]
    assert sorted(map(str, out.select(columns).collect())) == sorted(map(str, docs.select(columns).collect()))


def test_run_by_brute_force(spark, tmp_path):
    """Each stage read plainly from its rule, on one corpus with copies, benchmark passages, secrets, odd texts and repeated rows."""
    import re
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    import public_tokenizers
    from concord.llm import language_id
    from test_operators import base_spans, brute_language, brute_links

    r = random.Random(41)
    text = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) for _ in range(n))
    tests = [text(14), "omega psi"]
    rows = [(i, text(r.randint(5, 120)), r.choice(["en", "en", None])) for i in range(60)]
    rows += [(100 + i, " ".join(rows[i][1].split()[:-1] + ["changed"]), "en") for i in range(0, 40, 3)]
    rows += [(200, text(20) + " " + tests[0] + " end", "en"), (201, "Omega, PSI", "en"), (202, f"{text(30)} token=abcdefgh99 password : 'hunter2hunter2' {'0123456789abcdef' * 2} {text(5)}", "en"), (203, None, "en"), (204, "", None), (205, "1 2 3", "en"), (206, rows[5][1], None), (206, rows[5][1], None), (207, "word " * 20_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "extra": F.lit("clash")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(tests)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = language_id.learn(docs.where(~language_id.held_out()))
    left = [(i, t) for i, t, _ in rows for lang, score in [brute_language(t, known)] if lang != "und" and score >= language_id.MARGIN]
    _, links = brute_links(dict(left).items())
    heads = set()
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        heads |= {i} if i == min(seen) else set()
    left = [(i, t) for i, t in left if i in heads]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + 10]) for t in tests for w in [words(t)] for k in range(max(1, len(w) - 9))}
    left = [(i, t) for i, t in left if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in (2, 10) for k in range(len(w) - n + 1))]
    clean = []
    for i, t in left:
        out, to = "", 0
        for start, _, _, end in base_spans(t):
            if end > to:
                out, to = out + (t[to:start] + corpus_pipeline.REMOVED if start >= to else ""), end
        clean.append((i, out + t[to:]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in clean)
    before = spark.conf.get(corpus_pipeline.BATCH)
    pieces = {}
    for x in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda x: (x.sequence_id, x.offset)):
        pieces.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, bytes(x.ids)))
    assert spark.conf.get(corpus_pipeline.BATCH) == before
    assert sorted((i, zlib.crc32(b"".join(b for _, b in sorted(ps)))) for (i, _), ps in pieces.items()) == want
    assert 202 in dict(want) and not {200, 201, 203, 204, 205} & set(dict(want))


def test_stages_of_empty_tables_and_nulls(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "some words of a test")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (None, "alpha beta gamma delta", "en", None, None), (2, "alpha beta gamma", "en", None, 7), (2, "alpha beta gamma", "en", None, 7)], kind)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
        n = stage(spark, odd, str(tmp_path)).count()
        assert n == {"language_id": 3, "ngram_jaccard": 5, "decontaminate": 5, "secret_scan": 5, "pack": 5}[name]
