"""A training-data pipeline over `documents`: each stage is one operator of framelake.llm.

A stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet
and read again as the next stage's docs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import discard, materialize, recording
from framelake.llm.language_id import UNDETERMINED, identify, learn
from framelake.llm.mixing import mix
from framelake.llm.near_dedup import near_duplicates
from framelake.llm.sentencepiece_bpe import encode_documents
from framelake.llm.substring_dedup import remove_repeats

#: A document whose nearest language profile is farther than this share of the longest distance leaves is rejected.
LEAST_SCORE = 0.1
#: A column for numbers of rows, which no table has.
ROW = "__row_of_stage"


def numbered(docs: DataFrame) -> DataFrame:
    """docs, stored, with a number for each row in the order of doc_id, nulls last: keys may be null or repeat, numbers don't."""
    by = [F.col("doc_id").asc_nulls_last(), F.xxhash64(*docs.columns)]
    return materialize(docs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(ROW, F.monotonically_increasing_id()), "numbered")


_left: list[DataFrame] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stages before it have stored: their results are written by then.

    So a stage's result, which is read lazily, must be written before the next stage begins, and a process runs one pipeline at a time.
    """

    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(*_left)
        _left.clear()
        with recording(_left):
            return work(spark, docs, sf_dir)

    return stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles learned from the labelled documents; what has no letters (nulls and empty texts too), or is near no profile, goes.

    Rows with a null or repeated key stay or go by their own texts.
    """
    known = identify(docs, learn(docs))
    return known.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


@_stage
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest key; rows with a null key come last, and rows that repeat a key
    are documents like others, so of equal ones one stays. A document without words has no duplicates and stays."""
    rows = numbered(docs)
    kept = materialize(near_duplicates(rows, key=ROW).where("kept").select(F.col(ROW).alias("__kept")), "kept")
    return rows.join(kept, rows[ROW] == kept["__kept"], "left_semi").select(*docs.columns)


@_stage
def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat in a document with a smaller key (nulls last) are cut out, and a document that is left without words goes; n_chars follows the text."""
    out = remove_repeats(numbered(docs), key=ROW)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, whatever its key; documents without words are never taken. n_chars follows the text."""
    return mix(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row of the mix, begin and end included, with their number and digests of them and of the text that they decode to."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [("language ID", language), ("MinHash near-dedup", near_duplicate), ("substring dedup", substring), ("mixing", mixing), ("SentencePiece encoding", encoding)]

#: Signatures, draws and tokens are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; an empty table gives none. What a stage has stored goes when the next one has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
