"""The corpus pipeline: toxic documents, copies and near copies go, the rest is mixed and packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.dedup import dedup
from tidemark.llm.jaccard import near_duplicates
from tidemark.llm.mixing import Mixture, mix_documents
from tidemark.llm.packing import pack
from tidemark.llm.shared import BATCH_BYTES, FEW_ROWS, PLACE, READ_ROWS, SMALL_BATCH, Scratch, with_place, without_rows
from tidemark.llm.token_counts import vocabulary
from tidemark.llm.toxicity import REJECT, fit, score_toxicity

#: Each document at most once; nine tenths of the tokens, so that only sources above their weight are cut.
MIXTURE = Mixture(budget_per_mille=900, max_epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection score.

    Whole rows go through Python workers here, when what is returned is written: the session's batches are made small,
    those of the Parquet reader too, for this stage and those after it.
    """
    spark.conf.set(BATCH_BYTES, str(SMALL_BATCH))
    spark.conf.set(READ_ROWS, str(FEW_ROWS))
    scored = score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.filter(F.col("score") < REJECT).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 over five-word shingles, the row with the smallest doc_id.

    Rows are told apart by file and position, as ids may repeat or be null; of equal ids the first row stays,
    and a row without an id only if its whole group has none.
    """
    scratch = Scratch(spark, "near-copies")
    try:
        placed = with_place(docs)
    except AnalysisException:  # not read from files
        docs = scratch.table(docs, "rows")
        placed = with_place(docs)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *PLACE)
    groups = near_duplicates(placed.select(row.alias("doc_id"), "text"))
    own, kept = ([F.col(f"{c}.{p}") for p in PLACE] for c in ("doc_id", "component_id"))
    gone = groups.filter((own[0] != kept[0]) | (own[1] != kept[1]))
    return without_rows(docs, scratch.table(gone.select(*own), "gone"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of each source by the weights of its domain, language and name."""
    return mix_documents(docs, MIXTURE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    return pack(docs, 2048, *vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]
#: Tokens are not SQL's to count: the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
