"""The corpus pipeline: documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet and reads it again as the next stage's docs. All stages
but the last return the columns of ``documents``, whatever their order. An
empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontam, langid, mixing, simhash, token_files
from granary.llm.scratch import quoted, written
from granary.sources.tables import read_table

#: A document whose language score is lower is rejected, like one without letters. The score is how far the text is on
#: the way from the mean of all languages to the members of its own, so it means the same for any number of languages.
LEAST_LANGUAGE_SCORE = 0.12


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents go whose language is undetermined (null or empty text, or no letter) or whose score is below 0.12.

    Rows without lang are no training rows; where no row has one, none stays.
    Null ids and repeated rows are judged like any other; columns named like
    the prediction's stay as they are.
    """
    names = ("_stage_lang", "_stage_score")  # beside whatever columns there are
    sure = langid.identified(docs, names).where((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= LEAST_LANGUAGE_SCORE))
    return sure.select(*quoted(docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each component one row stays, that of the smallest doc_id. Five-word shingle sets of similarity 0.8 link too.

    Null and empty texts have one fingerprint and are one component. Of rows
    that share the smallest doc_id the first by a hash of the row stays; rows
    without a doc_id stay only where their component has no named row, one of
    each fingerprint.
    """
    return simhash.one_of_each(docs, similarity=0.8)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents go that align with a benchmark item.

    Decided row by row: null and empty texts stay, repeated rows stay or go
    together, null ids don't matter; without any item all rows stay.
    """
    return decontam.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as the mix of the sources' target weights takes it.

    Null sources are one source. Null and empty texts give no word and go.
    Repeated rows and rows without an id each have a place of their own.
    """
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files: written in ascending doc_id order (nulls first), read back, and reported by document.

    Null and empty texts hold the end id alone; repeated rows are each written.
    """
    return token_files.written_digests(docs)


STAGES = [
    ("language_id", keep_identified),
    ("simhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", keep_uncontaminated),
    ("mixing", mix),
    ("token_files", tokens),
]

#: Kernels, alignment and tokenizers are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on all that the one before it kept."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
