"""A corpus from raw documents to training sequences: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import small_batches
from concord.llm.decontaminate import contamination
from concord.llm.language_id import held_out, language_id, learn
from concord.llm.ngram_jaccard import ngram_jaccard
from concord.llm.pack import pack
from concord.llm.secrets import Ledger, address, findings, look, with_findings
from concord.operators.shared import shared_folder

#: SQL for run()'s rows: SQL has neither the compressor nor the tokenizer.
ORACLE_SQL = None

#: The session's setting that the stages change (see small_batches); run puts it back.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What stands for a secret in a text.
REMOVED = "[secret]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; a rejected one goes, as does one whose text is null or has no letter. Repeated rows stay or go together."""
    small_batches(spark)
    dictionaries = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return language_id(docs, dictionaries).where(~F.col("rejected")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles with a similarity of 0.8 or more tie together, the one of smallest doc_id.

    Rows that repeat a doc_id stay or go together; one whose doc_id is null stays.
    """
    small_batches(spark)
    heads = ngram_jaccard(docs, threshold=0.8, n=5).where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi").select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test string of the benchmark. Null and empty texts hold none; repeated rows stay or go together."""
    small_batches(spark)
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret's span replaced; spans that overlap are replaced as one. n_chars is counted anew where text has changed.

    A null or empty text stays as it is, repeated rows stay repeated, and an empty table gives an empty one.
    """
    ledger = Ledger(spark)
    found = findings(look(docs, ledger), ledger)
    out = with_findings(docs.select(F.struct("*").alias("row"), "text", address(F.col("text")).alias("blob")), found)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("to"))
    kept = lambda acc, s: F.array_append(acc["parts"], F.concat(F.substring("text", acc["to"] + 1, s["start"] - acc["to"]), F.lit(REMOVED)))
    cut = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.when(s["end"] <= acc["to"], acc).otherwise(
            F.struct(F.when(s["start"] < acc["to"], acc["parts"]).otherwise(kept(acc, s)).alias("parts"), s["end"].alias("to"))
        ),
    )
    out = out.withColumn("cut", F.when(F.size("spans") > 0, cut))
    clean = F.when(F.col("cut").isNotNull(), F.concat(F.array_join("cut.parts", ""), F.expr("substring(text, cut.to + 1)"))).otherwise(F.col("text"))
    out = out.withColumn("clean", clean)
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("cut").isNotNull(), F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens. A null text is an empty one; repeated rows are packed each; no documents give no pieces."""
    small_batches(spark)
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)


STAGES = [("language_id", language), ("ngram_jaccard", near_duplicates), ("decontaminate", decontaminated), ("secret_scan", without_secrets), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over all documents; what each returns is kept in the shared folder spark.checkpoint.dir. Columns beyond those of documents come along until they are packed."""
    at, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
            docs = spark.read.parquet(f"{at}/{name}")
    finally:
        spark.conf.set(BATCH, before)
    return docs
