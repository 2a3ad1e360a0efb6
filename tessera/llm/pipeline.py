"""From raw documents to token ids: quality, near duplicates, repeated passages, benchmark passages, encoding.

Each stage gets what its predecessor kept (as Parquet, reread), works on all of it, and returns the columns of documents; the
last returns what the corpus is made of: ids and digests of each document. run() writes each stage's result into the folder
that driver and executors share, so a lost executor costs no more than its tasks.

Null, empty and very long texts, repeated rows and extra columns are handled as the operators say; an empty table passes through
all stages as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard, passages, quality, shared
from tessera.sources import files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good (score 0.5 or more); it is fitted on labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(shared.packed(docs), quality.train(docs, labels))
    return shared.unpacked(scored.where("score >= 0.5"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return jaccard.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of 50 words or more that a document with a smaller id has; where nothing is
    cut, the text stays as it is, and a document of which nothing is left goes."""
    found = passages.remove(shared.packed(docs), passages.suffix_repeats(docs))
    cut = F.col("n_removed") > 0
    kept = found.where(~cut | (F.col("n_removed") < F.col("n_words"))).withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n = F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__rest.n_chars"))
        kept = kept.withColumn("__rest", F.col("__rest").withField("n_chars", n))
    return shared.unpacked(kept, docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    clean = decontaminate.decontaminate(shared.packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return shared.unpacked(clean, docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit) and digests of ids and of the text decoded from them."""
    rows = bpe.encode_and_decode(docs.select("doc_id", "text"))
    n = (F.octet_length("token_ids") / 4).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_passages", drop_benchmark_passages),
    ("encode", encode_tokens),
]

#: SQL can express neither the trained classifier nor byte-level BPE; tests/llm compares all stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        place = shared.folder(spark, f"stage-{name}")
        stage(spark, files.spread(docs), sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
