"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet, and that is read as the next stage's ``docs``. All stages but the
last return the columns of ``documents``. ``labels`` of the folder says which
documents are trusted, and weighs them in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import forest, line_dedup, mixing, packing, quality
from basketry.llm.common import stored
from basketry.llm.queries import label_weights, trusted, word_bpe
from basketry.sources.tables import read_table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a Kneser-Ney model of trusted text finds too unlikely in their language."""
    return quality.filter_documents(docs, trusted(spark, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that at least ten documents have, but for each line's first occurrence: no text leaves the corpus."""
    return line_dedup.dedup_lines(docs, min_docs=10, min_chars=1, keep_first=True)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group that is linked by five-word Jaccard similarity of 0.8 or more."""
    return forest.one_of_each(docs, similarity=0.8, length=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents until sources have their shares; a document stands as often as it is taken."""
    return mixing.mix_documents(docs, quality=label_weights(spark, sf_dir), weights=(1, 2, 3), share=1.0, cap=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048."""
    return packing.pack_documents(docs, word_bpe, size=2048)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: SQL has none of the tokenizer, the language model and the sampling keys; tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; the packed pieces."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, start=1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage-{number}")
    return docs
