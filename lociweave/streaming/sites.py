"""Site counts and strain frequencies kept up to date from streams of reads or events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def site_counts(reads: DataFrame) -> DataFrame:
    """Running depth and alternate reads of each site and sample, from (species, contig, pos, sample, is_alt).

    Sums are partial before the shuffle, in a stream as in a batch; write in
    ``update`` mode to get the sites that changed.
    """
    return reads.groupBy("species", "contig", "pos", "sample").agg(F.count(F.lit(1)).alias("depth"), F.sum(F.when(F.col("is_alt"), 1).otherwise(0)).alias("alt"))


def windowed_frequency(events: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Frequency by species, subject and window of event time; state older than ``late`` is dropped."""
    w = F.window(time, window)
    got = events.withWatermark(time, late).groupBy(w, "species", "subject_id").agg(F.avg(F.when(F.col("derived"), 1.0).otherwise(0.0)).alias("freq"), F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.start").alias("start"), "species", "subject_id", "freq", "n")
