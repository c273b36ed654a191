"""A corpus pipeline of five stages, each on all that the one before kept. Counted as part of stratagraph.llm.

All stages but the last return rows of docs with all their columns, whatever these are called; an empty table stays empty. Null
and empty texts are texts without words: they are scored as such, one of them stays as a copy of the others, they are linked
with nothing, and the mix never takes them. Null doc_ids: see each stage. Null lang and n_chars are passed on, null sources are one source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm import bpe, exact_dedup, mixing, near_dedup, quality
from stratagraph.llm.common import Scratch, table

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranking scores at or above its cut. Each row is scored by its text alone, so repeated and
    null doc_ids do no harm; equal texts stay or go together. Without labels of both kinds all stay."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the smallest doc_id; null comes last. Of rows that repeat that doc_id one
    stays, whichever."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more), that of the smallest doc_id. Rows without a
    doc_id stay, and all rows of a doc_id that stays."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the fair queue takes them, some twice, some not at all, in order of virtual finish time; ties go by a hash.
    Repeated and null doc_ids are queued row by row."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes, for each row of the mix, repeated ones too; a null
    doc_id stays null."""
    return bpe.bpe_digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("source mixing", mix_stage),
    ("byte-level BPE", bpe_stage),
]

#: No SQL: the learnt ranking, the near-duplicate components and the BPE merges have no form in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is a Parquet table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    out = STAGES[-1][1](spark, docs, sf_dir)
    return scratch.tied_to(out)
