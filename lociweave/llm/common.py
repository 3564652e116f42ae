"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    master, where one machine is the whole cluster, gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, *paths: str) -> None:
    """Removes tables of the shared folder that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(spark: SparkSession, *paths: str) -> None:
    """``removed``, and has the driver let go of shuffles that nothing refers to."""
    removed(spark, *paths)
    # the context's cleaner removes what the collectors of both sides find unreachable
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; unlike a checkpoint it keeps columnar size."""
    return held_at(df, name)[0]


def held_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written`` with the table's path, for a caller that drops it once it has been read."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Up to so many ids (16 bytes each, about) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def checked(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` with a broadcast hint where their number, counted here, allows it."""
    return F.broadcast(ids) if ids.count() <= most else ids


def opened(held: DataFrame, columns: list[str], made: dict[str, Column], row: str = "_row") -> DataFrame:
    """The caller's ``columns`` out of the struct ``row`` with the columns ``made``, which replace those of their names.

    An operator carries the caller's row in one struct, so the names of its own columns never meet the caller's.
    """
    # in two steps, as an alias of one select can be seen by the other columns of it
    done = held.select(F.col(row).alias("_held"), *[v.alias(f"_made_{k}") for k, v in enumerate(made.values())])
    return done.select(*[F.col("_held").getField(c).alias(c) for c in columns if c not in made], *[F.col(f"_made_{k}").alias(n) for k, n in enumerate(made)])


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores as keep them apart from ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def without(text: Column, chars: str) -> Column:
    """``text`` with all of ``chars`` removed; a byte search for each is faster than ``translate``."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """Spark deals out the cores; the tokenizers library must not start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
