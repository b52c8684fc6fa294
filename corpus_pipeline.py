"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, source mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one before kept. The two quality stages
drop what they reject, the third keeps the smallest id of each group of near duplicates, the fourth keeps all documents
and puts them in the order of the mix (files and rows ascend in it), the last encodes whole texts and gives each its
``position`` in that order, as reading files back promises none. All but the last
return the columns of ``docs``, extra ones included; extra columns may have any names. Null texts fail the quality
rules; empty tables give empty tables; rows of equal id count as one document and stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm import bpe, mixing, neardup, quality_classifier, quality_rules
from cubespark.llm.common import small, written
from cubespark.llm.sampling import id_modulo

BASE = ("doc_id", "text", "lang", "source", "n_chars")
#: Least quality score of a document that stays.
QUALITY = 0.3


def _filtered(docs: DataFrame, verdict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that a verdict on their base columns keeps; all others travel in a struct, whatever their names."""
    base = [c for c in docs.columns if c in BASE]
    extra = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in BASE] or [F.lit(0).alias("none")]).alias("_extra")
    kept = verdict(docs.select(*base, extra))
    return kept.select(*[F.col(c if c in BASE else f"_extra.`{c}`").alias(c) for c in docs.columns])


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _filtered(docs, lambda d: quality_rules.judge(d).filter("kept"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_modulo("doc_id", 5) != 0)
    # The rules leave hardly any document of quality 0, so it learns from all labelled ones, as op8 does.
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.train(whole, labels)
    return _filtered(docs, lambda d: quality_classifier.score(d, model).filter(F.col("score") >= QUALITY))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs.select("doc_id", "text"))
    gone = written(found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "copies")
    return docs.join(small(gone), "doc_id", "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The schedule is worked out on ids and sources; texts move once to their place and once into order.
    places = mixing.mix(docs.select("doc_id", "source")).groupBy(F.col("doc_id").alias("_id")).agg(F.min("position").alias("_position"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    placed = packed.join(small(written(places, "places")), F.col("_row.doc_id").eqNullSafe(F.col("_id")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "_position").sortWithinPartitions("_position").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    done = done.select(
        "doc_id",
        "source",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
    # The schedule depends on ids and sources alone, so these small rows get the places of the mixing stage.
    mixed = mixing.mix(written(done, "encoded"))
    return mixed.select(*done.columns, "position")


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("encoding", encode),
]
#: SQL can't fit the models; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not encode:
            docs = written(docs, "stage")
    return docs
