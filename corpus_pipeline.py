"""The corpus pipeline: five operators, each on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``.  ``run`` writes each stage's rows to the shared folder and reads them
back, so a lost executor costs one stage's work at most.

Every stage gives an empty result for empty tables, passes other columns through whatever their
names, and takes texts of any length whole.  A null text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontam, minhash, mixing, quality, token_files
from touchline.llm.queries import END_ID, vocabulary
from touchline.llm.shared import documents, stash, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, scores below one half go.

    Empty and null texts are scored like others; equal texts score alike, so repeats stay or go
    together.  Without any label every score is one half, and all stay.
    """
    stats = stash(quality.document_statistics(docs), "stats")
    return quality.keep_good(docs, quality.fit(quality.labelled(stats, table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the document with the smallest id stays.

    Texts without words are nobody's duplicates.  A null id stays, and rows that repeat the id that
    stays stay with it.
    """
    return minhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Items without a word or an id match nothing.  Rows that share an id go together; a null id stays.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out to their targets; a document may stand several times.

    Null is a source of its own.  Texts without words are drawn at their source's rate like others; rows
    that repeat an id are drawn alike.
    """
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus as token files, read back: one row per document of the mix.

    Rows of one id stand together, a null id first; an empty or null text is its end id alone.
    """
    manifest = token_files.write_tokens(docs, vocabulary(), END_ID)
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", source_mix),
    ("tokens", token_output),
]

#: SQL expresses neither the classifier nor the tokeniser; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
