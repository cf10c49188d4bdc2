"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import bitslices, hmm, licences, mixing, pieces, quality, sharding, similar, sketches, suffixes
from taskloom.llm._store import Workspace

#: Production parameters of the mixture; what a target does not name is "*".
MIXTURE = mixing.Mixture(
    targets={
        "source": {"src0": 0.2, "src1": 0.08, "src2": 0.08, "src3": 0.08, "*": 0.56},
        "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
        "topic": {"legal": 0.04, "table": 0.05, "contact": 0.03, "prose": 0.88},
    },
    keep=0.6,
)

#: The tokenizer's file among the public vocabularies; its bytes go to the executors with the task.
PIECE_MODEL = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Topics by what a text holds, the first that does; what holds none of it is prose.
TOPICS = {
    "table": r" \| ",
    "legal": r"(?i)\b(licen[cs]ed?|copyright|all rights reserved)\b",
    "contact": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+|https?://",
}


#: What a text must hold somewhere for a topic's pattern to match: most texts are told by that alone.
HINTS = {"table": (" | ",), "contact": ("@", "http")}


def topic(text: F.Column) -> F.Column:
    """A document's topic, told from its whole text; null and empty texts are prose."""
    text, found = F.coalesce(text, F.lit("")), F.lit("prose")
    for name, pattern in reversed(TOPICS.items()):
        matched = F.regexp_like(text, F.lit(pattern))
        if name in HINTS:
            matched = functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in HINTS[name]]) & matched
        found = F.when(matched, F.lit(name)).otherwise(found)
    return found


def op1_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # Words and topics are told once and written: the raking needs them of all rows, and so does the draw.
    told = docs.select("doc_id", "source", "lang", topic(F.col("text")).alias("topic"), mixing.word_count(F.col("text")).alias("n_tokens"))
    told = Workspace(spark, "mixture").save(told, "told")
    kept = mixing.sample(told, MIXTURE, F.col("n_tokens"))
    return kept.select(
        "doc_id",
        "source",
        "lang",
        "topic",
        "n_tokens",
        F.round("mix_weight", 6).alias("weight"),
        F.round("mix_probability", 6).alias("probability"),
    )


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return bitslices.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.jaccard_components(documents(spark, sf_dir), size=4, percent=85, counts=True)


def remainder(key: str, of: int) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(documents(spark, sf_dir), remainder("doc_id", 7) == 2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = quality.classify(docs, labels, remainder("doc_id", 5) != 0)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_edits(documents(spark, sf_dir).select("doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return suffixes.dedupe_substrings(docs, size=13, digests=True)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(PIECE_MODEL), "rb") as f:
        model = f.read()
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pieces.encode(docs, model, digests=True).drop("text")


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    thin = documents(spark, sf_dir).select(
        "doc_id",
        "source",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text).alias("text_md5"),
    )
    placed = sharding.shard(thin, shards=8, group="text_md5")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_to_targets": op1_mix_to_targets,
    "op2_top_k": op2_top_k,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_hmm_scores": op4_hmm_scores,
    "op5_quality": op5_quality,
    "op6_fingerprints": op6_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_licences": op8_licences,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_stratified_shards": op10_stratified_shards,
}
