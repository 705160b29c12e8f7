"""A corpus pipeline over ``documents``.

Each stage calls one operator on all rows that the stage before it kept; its
rows are written and reread. Null and empty texts fail the quality rules, so
only the first stage meets them; of repeated rows the near-dedup keeps one, of
ties between near duplicates the row with the smallest doc_id, then the smaller
hash. Other columns go along as they are up to packing. An empty table stays
empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filmloom.llm import common, mixing, packing, quality, similar, suffixes

#: Passages of this many bytes (about 43 words) that repeat are cut out.
PASSAGE = 256


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    return quality.passing(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard 0.8), that of the smallest doc_id.

    SimHash fingerprints by deletion variants first, then the pairs that are too far apart for them.
    """
    return similar.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once."""
    return suffixes.strip_repeats(docs, suffixes.Repeats(length=PASSAGE))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat_documents(docs)


def pack_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids in batches: doc_id, piece, n_tokens, bucket, batch, slot, padding, ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing", mix_sources),
    ("packing", pack_buckets),
]

#: Fingerprints, robust estimates and drawn roundings are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
