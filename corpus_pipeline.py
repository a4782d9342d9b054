"""Corpus preparation: quality rules, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; the mix repeats a
document as often as it takes it. A duplicate is dropped only in favour of a kept one, since each stage
judges what its predecessor kept.

Near-duplicates are texts whose fingerprints over pairs of words differ in five bits or fewer under
either of two seeds: on 48 pairs of five-word similarity 0.8 or more in 9,296 texts that finds 43.

Cases: a null text is an empty text, which the quality rules reject; where it is handed to a later stage,
empty texts are near-duplicates of each other, have size 0 and pack as one end token; a null source is a
source of its own; a null doc_id stays a row, and stands behind rows with one where a single row of a group
is kept; of rows that repeat an id and text the one with the least digest of all columns is kept; ties
elsewhere go by hashes of the rows; very long texts are judged, fingerprinted and counted whole, and cut
in packing alone; further columns, whatever their names and types, pass through all stages but the last;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coterie.llm import mixing, packing, quality, simhash
from coterie.llm.base import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisers, word-window counts, fingerprints and the packing plan have no SQL form; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
