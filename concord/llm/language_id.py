"""Language identification by compression: a text is of the language whose dictionary lets zstandard make it smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


UNKNOWN = "und"
#: Bytes of a language's dictionary, of what one labelled text gives to it, and of all dictionaries together: the sample that is
#: learned from is bounded by these. With very many languages each has a smaller dictionary, of one piece at least.
DICTIONARY_BYTES, PIECE_BYTES, ALL_BYTES = 1 << 16, 1 << 11, 1 << 24
LEVEL = 5
#: Folded bytes that are compressed at a time, each time from the dictionary alone: what a dictionary saves is bounded, so
#: that over one long run its share, and with it the score, would fall with the text's length.
CHUNK_BYTES = 1 << 14
#: A prediction is rejected if the runner-up's size is larger by a smaller share than this.
MARGIN = 0.005

#: Small letters and all beyond ASCII stay, the rest is a space.
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(LETTERS).split())


def learn(labelled: DataFrame, by: str = "doc_id") -> dict[str, bytes]:
    """A dictionary for each lang of labelled (lang, text and the column named by), most frequent language first.

    Of each language pieces of PIECE_BYTES characters at most are taken, from texts in order of a hash, until they give
    DICTIONARY_BYTES, or its part of ALL_BYTES if that is less. Rows of null lang or text are left out, repeated pieces count once, and no rows (an empty
    table) give no dictionary.
    More languages than ALL_BYTES has pieces are an error, as then lang is no language.
    """
    rows = labelled.where("lang is not null and text is not null")
    most = ALL_BYTES // PIECE_BYTES
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most + 1).collect()}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    if not counts:
        return {}
    size = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    want = 16 * size // PIECE_BYTES  # so many as short texts give less than a piece
    order = F.xxhash64(F.col(by).cast("string"), "text")
    known = F.broadcast(labelled.sparkSession.createDataFrame([(k, min(1.0, want / n)) for k, n in counts.items()], "lang string, share double"))  # a row for each language
    drawn = rows.join(known, "lang").where(F.pmod(order, F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", order.alias("h"), F.substring("text", 1, PIECE_BYTES).alias("piece")).distinct()
    pieces = {k: bytearray() for k in counts}
    # Only the first of each language reach the driver: 4 characters for each byte of a dictionary, as folding leaves less.
    upto = F.sum(F.length("piece")).over(Window.partitionBy("lang").orderBy("h", "piece").rowsBetween(Window.unboundedPreceding, -1))
    first = drawn.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < 4 * size).select("lang", "h", "piece")
    for r in first.orderBy("h", "lang", "piece").limit(4 * want * len(counts)).collect():
        if len(pieces[r.lang]) < size and (p := folded(r.piece)):
            pieces[r.lang] += p + b" "
    return {k: bytes(p[:size]) for k, p in pieces.items() if p}


def predicted(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """struct<lang, score>: the language of least compressed size and by what share the next one is larger; ties go to the more frequent language."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        made = []
        for name, content in dictionaries.items():
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            made.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)))

        def one(t: str | None) -> tuple[str, float]:
            if not made or not t or not any(map(str.isalpha, t)):
                return UNKNOWN, 0.0
            data = folded(t)
            sizes = [sum(len(c.compress(data[i : i + CHUNK_BYTES])) for i in range(0, len(data), CHUNK_BYTES)) for _, c in made]
            least = min(sizes)
            at = sizes.index(least)
            next_ = min(sizes[:at] + sizes[at + 1 :], default=2 * least)
            return made[at][0], 1 - least / next_

        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang", "score"])

    return predict(text)


def language_id(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected added; columns of such names are replaced.

    docs has text; no other column bears on the prediction. lang_pred is `und`, rejected, where the text is null or
    empty or has no letter, or nothing was learned. Otherwise it is the best language even if rejected, which is where
    score is below margin. Repeated rows are told each, and an empty table gives an empty one. Texts are compressed whole, in chunks whose sizes are added up. With one language all are of it, with score 0.5.
    """
    out = docs.drop("lang_pred", "score", "rejected").withColumn("_p", predicted(F.col("text"), dictionaries))
    return out.withColumns({"lang_pred": F.col("_p.lang"), "score": F.col("_p.score"), "rejected": (F.col("_p.lang") == UNKNOWN) | (F.col("_p.score") < margin)}).drop("_p")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    return language_id(docs.select("doc_id", "text"), dictionaries).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
