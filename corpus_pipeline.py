"""A corpus pipeline of five stages: documents in, token ids out.

Each stage takes all that the one before kept and is written as Parquet in the shared folder before the next reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm import bpe, decontaminate, line_templates, quality, simhash, word_sets
from pixelweir.llm.common import read, shared_folder
from pixelweir.llm.native import SPACES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from `labels`."""
    return quality.keep(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in the first document that holds them; documents without a word left go."""
    cut = line_templates.drop_templates(docs, keep_first=True)
    kept = cut.filter(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) != "")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: first of fingerprints that link, then of texts whose 5-word Jaccard similarity is 0.8 or more, of which fingerprints alone miss many."""
    return word_sets.keep_one(docs, earlier=simhash.fates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no `benchmark` item, whole or edited."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digests, and the digest of what they decode to."""
    return bpe.encode_decode(docs, keep=("ids",), memory=80_000).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The learned rules, components and merges aren't SQL; tests/llm compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{top}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
