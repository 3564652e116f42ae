"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, without a ring
table; one more shard takes rows only into itself, and only its fair part. The
slot of a row, its place in its shard, is gapless from 0 in the order of the key, or
of a column that the caller names.

Defined cases: a null key counts as 0; a key that is no whole number counts as its
hash; rows with one key share a shard and get different slots; a null text has no
bytes (size 16, checksum 0); extra columns pass through, and those called like a result
are replaced by it; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.llm.common import documents, opened
from lociweave.llm.ranking import ranked

SHARDS = 40
ROW_BYTES = 16
#: Fixed value: the multiplier of the published jump hash.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        with np.errstate(over="ignore"):
            state[live] = state[live] * _MULTIPLIER + np.uint64(1)
        step = np.float64(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        nxt = ((at[live] + 1) * step).astype(np.int64)
        live, nxt = live[nxt < shards], nxt[nxt < shards]
        at[live] = nxt
    return at


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return jumped(F.coalesce(key, F.lit(0)).cast("bigint"))


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, order: str | None = None) -> DataFrame:
    """``docs`` with ``shard``, ``slot`` and ``grown_shard`` (the shard if there were one more); slots follow ``order``, a number, or else the key."""
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    held = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_id"), (F.col(key) if whole else F.xxhash64(key)).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    held = held.withColumn("_shard", shard_of(F.when(F.col("_id").isNotNull(), F.col("_key")), shards))
    if order:
        held = held.withColumn("_order", F.col("_row").getField(order))
    out = ranked(held, "_shard", "_order" if order else "_key", "_slot", [F.xxhash64("_text"), F.col("_id")])
    return opened(out, docs.columns, {"shard": F.col("_shard"), "slot": F.col("_slot"), "grown_shard": shard_of(F.when(F.col("_id").isNotNull(), F.col("_key")), shards + 1)})


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(t) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    out = sharded(rows, text="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op2_sharding": op2_sharding}
ORACLE: dict[str, str] = {}
