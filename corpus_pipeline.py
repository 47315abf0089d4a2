"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays, passages that repeat
across documents are cut, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.

Defined results: a null text stays null through the first two stages and is empty from the third on; documents that a
stage empties are kept with an empty text; rows that repeat an id share one decision. An empty table gives
empty results. Further columns of the input are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstats.llm import common, near_dedup, packing, suffix_dedup, toxicity
from tillstats.llm.queries import WORD_FILE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic (operator 7)."""
    return toxicity.keep_clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 6)."""
    return near_dedup.keep_first(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a smaller document already has (operator 9)."""
    return suffix_dedup.trimmed(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids (operator 2)."""
    return packing.pack(docs, public_tokenizers.path(WORD_FILE), packing.SEQUENCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Scores, sketches and packing have no SQL form; tests/llm/test_brute_force.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table, each written as Parquet and read again; a stage's rows go once the next has its own."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = common.new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            common.remove(spark, before)
        before = out
    # the last stage writes its pieces before it returns, so the rows they came from may go too
    packed = STAGES[-1][1](spark, docs, sf_dir)
    common.remove(spark, before)
    return packed
