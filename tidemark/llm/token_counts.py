"""Token counts of whole texts by rank-synchronous array merging (see bpe)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import merger

#: Texts whose ids are held at a time.
TEXTS = 256


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of consecutive rows."""
    for lo in range(0, len(texts), TEXTS):
        yield lo, texts.slice(lo, TEXTS)


def vocabulary() -> tuple[str, str]:
    """Path and pre-token pattern of the byte-level vocabulary of the production queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def with_token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and n_tokens of every row.

    A null or empty text has no tokens. Rows with equal or null ids each give a row. Other columns are not
    read, so their names do not matter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path, pattern)
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                _, counts = m.encode_array(texts)
                yield pa.record_batch([batch.column(0).slice(lo, len(texts)), batch.column(2).slice(lo, len(texts)), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), n_bytes.alias("n_bytes")).mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary())
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
