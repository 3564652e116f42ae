"""Token counts: batch encoding in an Arrow function that returns lengths only.

Spark hands over batches by rows; within them the library gets runs of about
``subwords.CALL_BYTES`` bytes, and texts are cut at boundaries no token crosses.
Only the lengths return to the JVM.

Defined cases: a null text counts as empty, with no bytes and no tokens; special
strings inside a text are handled as the library does by default; repeated rows
are counted each; extra columns pass through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import documents, tokenizer_path

LIMIT = 1024


def token_count(text: Column, path: str) -> Column:
    """The number of tokens that the tokenizer file at ``path`` gives for ``text``."""

    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        from lociweave.llm.subwords import token_counts

        return pa.array(token_counts(texts, path), pa.int64())

    return lengths(text)


def with_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    counted = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")).withColumn("n_tokens", token_count(F.col(text), path))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return with_counts(docs, tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op6_tokens": op6_tokens}
ORACLE: dict[str, str] = {}
