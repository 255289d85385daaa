"""A training-data pipeline over ``documents``: five operators, each on all that the one before kept.

Toxic documents go, exact copies go (the smallest doc_id of equal texts stays), near copies go (the
smallest doc_id of a group stays; shingles of five words, similarity 0.8), sources are mixed to their
target weights (a row is repeated or left out), and the texts are encoded with byte-level BPE. Each
stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever else they are named.

Defined results, for every stage: null text counts as empty; texts of any length are read whole; rows
with a null or repeated doc_id are documents of their own; an empty table gives an empty table; columns
beyond doc_id, text and source are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.llm import byte_bpe, common, exact_dedup, mixing, near_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score stays below the threshold. Equal texts get equal scores; empty ones stay."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts (white space runs count as one space): that of the smallest
    doc_id, null last; of rows equal in both the first by a digest of all columns. Null and empty texts
    are copies of each other."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, null last. Texts without words are
    near to nothing and stay."""
    return near_dedup.drop_near_copies(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row 0 to 3 times, so that each source's words come near its target. The null source is a source
    of its own; rows without words may stay or go, they weigh nothing (all stay as often as the whole
    part of their source's rate says, none more)."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with n_tokens, ids, ids_sha256 and decoded_sha256; underscores go after a name that docs has."""
    own = byte_bpe.with_ids(docs)
    fields = [f.name for f in own.schema[-1].dataType.fields]
    named = zip(fields, common.free(docs.columns, *fields))
    return own.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(own.columns[-1]).getField(f).alias(name) for f, name in named))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: The toxicity classifier and the random mix aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
