"""A corpus pipeline of five stages over documents; each is written as Parquet and read again by the next.

1. quality: texts that the quality classifier rejects go.
2. near_duplicates: of each group of near copies (five-word shingles, Jaccard
   index of 0.8 or more) the document with the smallest doc_id stays.
3. repeated_passages: passages of 50 words or more that a document with a
   smaller doc_id has as well are cut out of the text.
4. mixture: documents are sampled so that their words meet the target shares.
5. sentencepiece: texts are encoded and decoded again.

All stages but the last return the columns of documents, and columns that documents
have besides, whatever their names. In every stage null and empty texts are
documents without words: the classifier scores them as such, they are nobody's copy,
nothing is cut out of them, they weigh nothing in the mixture and are drawn like the others of
their cell, and have no pieces. Very long texts are read whole. Rows with a null
doc_id stay in stages 2 and 3 and share a draw in stage 4; rows that repeat a doc_id are one document there, which
stays, goes and is cut as one. Of copies that tie the smallest doc_id stays. Empty tables stay empty.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import mixing, pieces, quality, queries, similar, suffixes
from taskloom.llm._store import Workspace

#: Words of the shortest passage that is cut out as repeated.
PASSAGE = 50
#: The mixture of the registered query, but more of the words are kept.
MIXTURE = dataclasses.replace(queries.MIXTURE, keep=0.8, columns=("__weight", "__probability"))


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = quality.classify(docs, labels, queries.remainder("doc_id", 5) != 0, names=("__score", "__predicted"))
    return scored.where("__predicted = 1").select(*columns(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = similar.jaccard_components(docs, size=5, percent=80)
    return docs.join(groups.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*columns(docs))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.dedupe_substrings(docs, size=PASSAGE, names=("__n_words", "__n_removed"))
    length = F.when(F.col("__n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = mixing.sample(docs, MIXTURE, mixing.word_count(F.col("text")), values={"topic": queries.topic(F.col("text"))})
    return kept.select(*columns(docs))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(queries.PIECE_MODEL), "rb") as f:
        model = f.read()
    made = pieces.encode(docs.select("doc_id", "lang", "source", "text"), model, ids="ids", decoded="decoded")
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", by_quality),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("mixture", mixed),
    ("sentencepiece", tokenised),
]

#: SQL can't express the classifier; the stages are tested against brute force on small fixtures.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    work = Workspace(spark, "pipeline")
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
