"""Corpus pipeline: raw documents to sampled token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before it kept; its result is written as Parquet and read again as the next
stage's input.  The first four return the columns of ``documents``:

1. ``language_id`` drops documents without a recognisable language: without a
   letter, or whose words do not fit the languages learned (texts of several
   learned languages stay);
2. ``quality_rules`` drops documents that a quality rule rejects;
3. ``near_dedup`` keeps one document of each near-duplicate group
   (five-word shingles, similarity 0.8);
4. ``mix_sources`` repeats and drops documents so that each source's words come
   near its target, in the order of the curriculum;
5. ``encode`` returns two distinct sampled segmentations of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from staylens.llm import langid, minhash, mixing, quality, unigram
from staylens.llm.registry import PIECE_MODEL, held_out
from staylens.plans.materialize import materialize

#: Least fit of a document's words to the languages of their spans (0 chance, 1 as the training texts).
MIN_LANG_FIT = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.filter(~held_out()))
    found = langid.identify(docs, model, keep=docs.columns)
    return found.filter((found["lang_pred"] != langid.UND) & (found["lang_fit"] >= MIN_LANG_FIT)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_cascade(docs).filter("__kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, width=5, percent=80, bands=32)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unigram.encode(docs, unigram.load(PIECE_MODEL), k=2, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL can express neither the language model nor the sampled segmentations; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
