"""SNVs that move together, clustered without a matrix of all of them in one task.

SNVs with a distance below ``near``, one of them perhaps with its allele turned, are
links; clusters are then taken greedily from the links, the densest SNV first. To find the
links, SNVs are cut into blocks and pairs of blocks are compared, a group each. For SNVs
that every sample covers, a projection tells which blocks need no comparison: the mean
frequency of two linked SNVs, folded at one half, differs by no more than their depths
allow.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from lociweave.functions import kernels as K
from lociweave.operators import analyses as N
from lociweave.operators.diversity import with_freq
from lociweave.operators.resampling import balanced_centroids
from lociweave.session import cut

SITE = ("species", "contig", "pos")
#: SNVs of a block, about, and stretches of the projection that blocks are cut by.
BLOCK = 2048
STRETCHES = 32
#: A depth class's stretch with less than this part of a block's SNVs is no block of its own.
FEW = 32


def best_covered(rows: DataFrame, most: int) -> DataFrame:
    """(site, mean): the ``most`` sites of each species with the highest mean depth, of equals the first by place.

    A histogram of the mean depths, in whole reads, says which are in for sure; only those in
    the last bin that still fits are ranked.
    """
    means = rows.groupBy(*SITE).agg(F.avg("depth").alias("mean")).withColumn("_bin", F.floor("mean"))
    sizes = means.groupBy("species", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("species").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    room = sizes.withColumn("_room", F.lit(most) - F.coalesce(F.sum("_n").over(above), F.lit(0))).filter("_room > 0").select("species", "_bin", "_room", "_n")
    held = means.join(room, ["species", "_bin"])
    sure = held.filter("_n <= _room")
    last = Window.partitionBy("species").orderBy(F.desc("mean"), "contig", "pos")
    edge = held.filter("_n > _room").withColumn("_r", F.row_number().over(last)).filter("_r <= _room").drop("_r")
    return sure.unionByName(edge).select(*SITE, "mean")


def snv_vectors(rows: DataFrame) -> DataFrame:
    """(site, mean, fs, ds): frequency and depth of each SNV in the samples of its species, by name; 0 where a sample has none."""
    names = rows.groupBy("species").agg(F.array_sort(F.collect_set("sample")).alias("_all"))
    held = rows.groupBy(*SITE).agg(F.map_from_entries(F.collect_list(F.struct("sample", F.struct("f", "depth")))).alias("_m"), F.avg("depth").alias("mean"))
    at = lambda c: F.transform("_all", lambda s: F.coalesce(F.try_element_at("_m", s)[c].cast("double"), F.lit(0.0)))
    return held.join(names, "species").select(*SITE, "mean", at("f").alias("fs"), at("depth").alias("ds"))


def _blocks(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``block``, and of each block its depth class and range of projections; blocks of SNVs with gaps or from sparse ranges (class -1) have none."""
    least = F.array_min("ds")
    total = F.aggregate("fs", F.lit(0.0), lambda s, x: s + x) / F.size("fs")
    rows = vectors.withColumn("_key", F.least(total, 1 - total)).withColumn("_class", F.when(least > 0, F.floor(F.log2(F.greatest(least, F.lit(1.0))))).otherwise(F.lit(-1)).cast("int"))
    rows = rows.withColumn("_part", F.when(F.col("_class") < 0, F.lit(0)).otherwise(F.floor(F.col("_key") * 2 * STRETCHES)).cast("int"))
    # cells of few SNVs would be met one by one: they are compared with all others instead
    cells = rows.groupBy("species", "_class", "_part").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(cells, ["species", "_class", "_part"])
    few = (F.col("_n") < BLOCK // FEW) | (F.col("_class") < 0)
    rows = rows.withColumn("_part", F.when(few, 0).otherwise(F.col("_part"))).withColumn("_class", F.when(few, -1).otherwise(F.col("_class"))).drop("_n")
    sizes = rows.groupBy("species", "_class", "_part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_subs"))
    return rows.join(sizes, ["species", "_class", "_part"]).withColumn("block", F.struct("_class", "_part", F.pmod(F.xxhash64("contig", "pos"), F.col("_subs")).alias("_sub"))).drop("_class", "_part", "_subs")


def _tiles(rows: DataFrame, near: float) -> DataFrame:
    """(species, a, b): blocks that may have a link between them, one row each way round; a table of blocks, not of SNVs."""
    blocks = rows.groupBy("species", "block").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
    one = blocks.select("species", F.col("block").alias("a"), F.col("_lo").alias("_lo1"), F.col("_hi").alias("_hi1"))
    two = blocks.select("species", F.col("block").alias("b"), F.col("_lo").alias("_lo2"), F.col("_hi").alias("_hi2"))
    gap = F.greatest(F.col("_lo1") - F.col("_hi2"), F.col("_lo2") - F.col("_hi1"), F.lit(0.0))
    # a link's frequencies differ by a mean square below near / 2 over the two depths, and their means by no more than its root
    reads = F.pow(F.lit(2.0), F.col("a._class")) + F.pow(F.lit(2.0), F.col("b._class"))
    open_ = (F.col("a._class") < 0) | (F.col("b._class") < 0)
    return one.join(two, "species").filter(F.col("a") <= F.col("b")).filter(open_ | (gap * gap <= near / 2 / reads + 1e-9)).select("species", "a", "b")


def near_pairs(f1: np.ndarray, d1: np.ndarray, f2: np.ndarray, d2: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, turned): which rows lie nearer than ``near``, as they are or with one turned, and whether turned is nearer.

    One row against all others at a time, samples first, so that what a step touches stays in the processor's cache.
    """
    f, d = np.ascontiguousarray(f2.T), np.ascontiguousarray(d2.T)
    s, v, depth, out = np.empty_like(f), np.empty_like(f), np.empty_like(f), []
    for i in range(len(f1)):
        np.add(d1[i][:, None], d, out=depth)
        both = []
        for own in (f1[i][:, None], 1 - f1[i][:, None]):
            np.subtract(own, f, out=v)
            v *= v
            v *= depth
            np.add(own, f, out=s)
            s *= 2 - s
            # both alleles of both are fixed alike there: nothing is known
            alike = s <= 0
            known = len(f) - alike.sum(axis=0)
            np.copyto(s, np.inf, where=alike)
            v /= s
            with np.errstate(invalid="ignore"):
                both.append(2 * v.sum(axis=0) / known)
        with np.errstate(invalid="ignore"):
            j = np.flatnonzero(np.fmin(*both) < near)
            out.append((np.full(len(j), i), j, both[1][j] < both[0][j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, dtype=int),) * 3


_LINK = "species string, contig_1 string, pos_1 bigint, contig_2 string, pos_2 bigint, turned boolean"


def _linker(near: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        width = len(t["fs"][0])
        f, d = (t[c].combine_chunks().flatten().to_numpy().reshape(-1, width) for c in ("fs", "ds"))
        contig, pos = np.array(t["contig"].to_pylist(), dtype=object), t["pos"].to_numpy()
        one = np.flatnonzero(side != 2)
        two = np.flatnonzero(side != 1)
        i, j, turned = near_pairs(f[one], d[one], f[two], d[two], near)
        i, j = one[i], two[j]
        if (side == 0).any():  # a block with itself: each pair once
            keep = i <= j
            i, j, turned = i[keep], j[keep], turned[keep]
        names = [c.split()[0] for c in _LINK.split(", ")]
        return pa.Table.from_arrays([pa.array([t["species"][0].as_py()] * len(i), pa.string()), pa.array(contig[i], pa.string()), pa.array(pos[i], pa.int64()), pa.array(contig[j], pa.string()), pa.array(pos[j], pa.int64()), pa.array(turned.astype(bool))], names)

    return run


def links(vectors: DataFrame, near: float = 3.5) -> DataFrame:
    """(species, contig_1, pos_1, contig_2, pos_2, turned) of all linked SNVs, each two once, and of each SNV that has a frequency between 0 and 1 somewhere with itself."""
    rows = _blocks(vectors).persist(StorageLevel.DISK_ONLY)
    tiles = _tiles(rows, near)
    same = F.col("a") == F.col("b")
    one = tiles.select("species", "a", "b", F.col("a").alias("block"), F.when(same, 0).otherwise(1).alias("side"))
    two = tiles.filter(~same).select("species", "a", "b", F.col("b").alias("block"), F.lit(2).alias("side"))
    held = one.unionByName(two).join(rows.select(*SITE, "block", "fs", "ds"), ["species", "block"])
    tile = F.concat_ws("|", *[F.col(f"{s}.{c}").cast("string") for s in ("a", "b") for c in ("_class", "_part", "_sub")])
    return held.select(*SITE, "fs", "ds", "side", tile.alias("tile")).groupBy("species", "tile").applyInArrow(_linker(near), _LINK)


def near_rows(f1: np.ndarray, d1: np.ndarray, f2: np.ndarray, d2: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of the first SNVs, which of the second lie nearer than ``near`` and which of all lie nearer turned; the same from either side, to the last bit."""
    f, d = np.ascontiguousarray(f2.T), np.ascontiguousarray(d2.T)
    gap, both, depth = np.empty_like(f), np.empty_like(f), np.empty_like(f)

    def distance(v: np.ndarray, s: np.ndarray) -> np.ndarray:
        # both alleles of both are fixed alike there: nothing is known, and v is 0
        alike = s <= 0
        s += alike
        v *= depth
        v /= s
        return 2 * v.sum(axis=0) / (len(f) - alike.sum(axis=0))

    with np.errstate(invalid="ignore"):
        for own, reads in zip(f1, d1, strict=True):
            np.add(reads[:, None], d, out=depth)
            np.subtract(own[:, None], f, out=gap)
            gap *= gap
            np.add(own[:, None], f, out=both)
            away = 1 - both
            away *= away
            both *= 2 - both
            back = distance(away, 1 - gap)
            forward = distance(gap, both)
            yield np.fmin(forward, back) < near, back < forward


def _matrices(t: pa.Table | pa.RecordBatch, rows: np.ndarray) -> list[np.ndarray]:
    """Frequencies and depths of the given ``rows``, which are of one species."""
    return [pc.list_flatten(t.column(c).take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), -1) for c in ("fs", "ds")]


def _link_bits(sides: DataFrame, near: float) -> DataFrame:
    """(site, with, bits): for each SNV of a tile and the block ``with`` that it meets there, a bit for each place ``at`` of that block, set for a link.

    Sides are 1 and 2, or 0 for SNVs of one block; rows without a link are left out.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, at = t["side"].to_numpy(), t["at"].to_numpy()
        own, other = (np.flatnonzero(side != k) for k in (2, 1))
        own, other = own[np.argsort(at[own])], other[np.argsort(at[other])]
        parts = [(own, other, 2)] if (side == 0).any() else [(own, other, 2), (other, own, 1)]
        near_of = np.zeros((len(own), len(other)), dtype=bool)
        if len(own) and len(other):
            for k, (on, _) in enumerate(near_rows(*_matrices(t, own), *_matrices(t, other), near)):
                near_of[k] = on
        out = []
        for (rows, met, far), m in zip(parts, (near_of, near_of.T), strict=False):
            some = np.flatnonzero(m.any(axis=1)) if len(met) else np.zeros(0, dtype=np.int64)
            packed = np.packbits(m[some], axis=1)
            block = t["two" if far == 2 else "one"].take(pa.array(np.zeros(len(some), dtype=np.int64)))
            out.append(t.select(list(SITE)).take(pa.array(rows[some])).append_column("with", block).append_column("bits", pa.array([x.tobytes() for x in packed], pa.binary())))
        return pa.concat_tables(out)

    spark = sides.sparkSession
    # tiles are small and take long, so their number of tasks must not follow from their bytes
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return sides.repartition(tasks, "species", "one", "two").groupBy("species", "one", "two").applyInArrow(run, "species string, contig string, pos bigint, with string, bits binary")


def _counted(bits: DataFrame, among: DataFrame) -> DataFrame:
    """(site, n): to how many SNVs of ``among`` (a row stands for ``w``) each SNV is linked, if any."""

    @F.pandas_udf("long")
    def weighed(bits: pd.Series, ats: pd.Series, ws: pd.Series) -> pd.Series:
        out = np.zeros(len(bits), dtype=np.int64)
        # rows of one block have equal lists, and most batches few blocks
        for _, on in pd.Series(np.arange(len(bits))).groupby([bits.map(len).to_numpy(), ats.map(lambda x: x.tobytes()).to_numpy()]):
            on = on.to_numpy()
            sets = np.unpackbits(np.frombuffer(b"".join(bits.to_numpy()[on]), dtype=np.uint8).reshape(len(on), -1), axis=1)
            # sums of counts below 2^53 are exact
            out[on] = sets[:, ats.iloc[on[0]]].astype(np.float64) @ np.asarray(ws.iloc[on[0]], dtype=np.float64)
        return pd.Series(out)

    lists = among.groupBy("species", F.col("block").alias("with")).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("_l"))
    held = bits.join(lists.select("species", "with", F.col("_l.at").alias("_at"), F.col("_l.w").alias("_w")), ["species", "with"])
    return held.select(*SITE, weighed("bits", "_at", "_w").alias("n")).groupBy(*SITE).agg(F.sum("n").alias("n")).filter("n > 0")


def _linked_to(seeds: dict[str, tuple], near: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that are linked to their species' seed, with whether turned and how many links the seed has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            species = np.array(batch.column("species").to_pylist(), dtype=object)
            for name in sorted(seeds.keys() & set(species)):
                rows = np.flatnonzero(species == name)
                f, d, size = seeds[name]
                ((on, turned),) = near_rows(f, d, *_matrices(batch, rows), near)
                held = batch.take(pa.array(rows[on]))
                yield held.append_column("turned", pa.array(turned[on])).append_column("size", pa.array(np.full(on.sum(), size)))

    return run


def snv_clusters(vectors: DataFrame, near: float = 3.5, share: float = 0.25, least: int = 10, most: int = 10) -> DataFrame:
    """(site, cluster, turned): up to ``most`` clusters of a species, numbered from 0.

    The SNV with the most links among those still free is a seed (of equal ones that of the
    least mean depth, then the last by place); of its links those stay that are linked to more
    than ``share`` of them all. A seed with fewer than ``least`` links ends its species.

    SNVs of equal vectors have equal links and go one way, so the last of them by place stands
    for all. Links, which may be as many as pairs of SNVs, are kept as bits; a round takes
    those of the SNVs that leave off the counts. The driver gets the seeds, a row a species.
    """
    spark = vectors.sparkSession
    last = F.max(F.struct("contig", "pos"))
    alike = vectors.groupBy("species", "mean", "fs", "ds").agg(last.alias("_last"), F.count(F.lit(1)).alias("w"))
    blocks = cut(_blocks(cut(alike.select("species", "_last.contig", "_last.pos", "mean", "fs", "ds", "w"))))
    named = lambda c: F.concat_ws("|", *[F.col(f"{c}.{x}").cast("string") for x in ("_class", "_part", "_sub")])
    tiles = cut(_tiles(blocks, near).select("species", named("a").alias("one"), named("b").alias("two")))
    # a block has about BLOCK rows
    rows = blocks.select(*SITE, "mean", "fs", "ds", "w", named("block").alias("block"))
    rows = cut(rows.withColumn("at", F.row_number().over(Window.partitionBy("species", "block").orderBy("contig", "pos")) - 1))
    same = F.col("one") == F.col("two")
    side = lambda x, n, held: rows.withColumnRenamed("block", x).join(held, ["species", x]).select(*SITE, "fs", "ds", "at", n.alias("side"), "one", "two")
    sides = side("one", F.when(same, 0).otherwise(1), tiles).unionByName(side("two", F.lit(2), tiles.filter(~same)))
    bits = cut(_link_bits(sides, near))
    free, parts = cut(rows.join(_counted(bits, rows), list(SITE))), []
    for k in range(most):
        densest = free.groupBy("species").agg(F.max(F.struct("n", (-F.col("mean")).alias("_m"), "contig", "pos", "fs", "ds")).alias("_s")).filter(F.col("_s.n") >= least)
        seeds = {r["species"]: (np.array([r["fs"]]), np.array([r["ds"]]), r["n"]) for r in densest.select("species", "_s.*").collect()}
        if not seeds:
            break
        group = free.drop("n")
        schema = T.StructType([*group.schema.fields, T.StructField("turned", T.BooleanType()), T.StructField("size", T.LongType())])
        group = cut(group.mapInArrow(_linked_to(seeds, near), schema))
        inside = _counted(bits.join(group.select(*SITE), list(SITE), "left_semi"), group).withColumnRenamed("n", "_in")
        kept = cut(group.join(inside, list(SITE)).filter(F.col("_in") > share * F.col("size")))
        parts.append(kept.select("species", "mean", "fs", "ds", F.lit(k).cast("bigint").alias("cluster"), "turned"))
        if k + 1 < most:
            left = free.join(kept.select(*SITE), list(SITE), "left_anti")
            gone = _counted(bits, kept).withColumnRenamed("n", "_gone")
            free = cut(left.join(gone, list(SITE), "left").withColumn("n", F.col("n") - F.coalesce("_gone", F.lit(0))).drop("_gone").filter("n > 0"))
    if not parts:
        return spark.createDataFrame([], "species string, contig string, pos bigint, cluster bigint, turned boolean")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return vectors.join(out, ["species", "mean", "fs", "ds"]).select(*SITE, "cluster", "turned")


def strain_sites(counts: DataFrame, snvs: int = 20_000, least_depth: int = 5) -> DataFrame:
    """(site, sample, f, depth) of the ``snvs`` best covered sites of each species."""
    rows = with_freq(counts).filter(F.col("depth") >= least_depth).select(*SITE, "sample", "f", "depth")
    return rows.join(best_covered(rows, snvs).select(*SITE), list(SITE), "left_semi")


def _turned(f: str = "f", turned: str = "turned") -> F.Column:
    return F.when(F.col(turned), 1 - F.col(f)).otherwise(F.col(f))


def strain_frequencies(members: DataFrame, whole: DataFrame, draws: int = 1000) -> DataFrame:
    """(species, strain, sample, freq, quantile_25, quantile_75, lower_ci, upper_ci) from (species, cluster, sample, f) of the clusters' SNVs.

    The interval is that of means of 100 drawn SNVs; a group is one strain's SNVs in one
    sample. A species of ``whole`` (species, sample) without clusters is one strain, at a
    frequency of 1 in all its samples.
    """

    def interval(t: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(t["f"].to_numpy())
        strain, sample = int(t["cluster"].iloc[0]), t["sample"].iloc[0]
        lo, hi = K.bootstrap_mean(x, [strain, *sample.encode()], draws)
        return pd.DataFrame([[t["species"].iloc[0], strain, sample, x.mean(), *np.percentile(x, [25, 75]), lo, hi]], columns=["species", "strain", "sample", "freq", "quantile_25", "quantile_75", "lower_ci", "upper_ci"])

    schema = "species string, strain bigint, sample string, freq double, quantile_25 double, quantile_75 double, lower_ci double, upper_ci double"
    got = members.select("species", "cluster", "sample", "f").groupBy("species", "cluster", "sample").applyInPandas(interval, schema)
    alone = whole.select("species", "sample").distinct().join(members.select("species").distinct(), "species", "left_anti")
    one = F.lit(1.0)
    return got.unionByName(alone.select("species", F.lit(0).cast("bigint").alias("strain"), "sample", *[one.alias(c) for c in ("freq", "quantile_25", "quantile_75", "lower_ci", "upper_ci")]))


def strains(counts: DataFrame, snvs: int = 20_000, least_depth: int = 5, **options) -> DataFrame:
    """(species, strain, sample, freq, quantile_25, quantile_75, lower_ci, upper_ci): the clusters of each species' best covered SNVs as strains."""
    rows = strain_sites(counts, snvs, least_depth)
    clusters = snv_clusters(snv_vectors(rows), **options)
    members = rows.join(clusters, list(SITE)).withColumn("f", _turned())
    return strain_frequencies(members, rows)


def strain_chain(counts: DataFrame, samples: DataFrame, inoculum: str, snvs: int = 20_000, least_depth: int = 5, near: float = 3.5, **options) -> DataFrame:
    """(species, strain, sample, freq, snvs, place): from counts to ordered strains.

    The best covered SNVs are clustered; the clusters' mean frequencies are centroids, to
    which every SNV of the species is then assigned that is near enough to one; centroids are
    turned until their sums over clusters are nearest to 1; a strain's frequency in a sample
    is the mean of its SNVs, turned alike; strains stand by their frequency in the inoculum.
    """
    every = with_freq(counts).filter(F.col("depth") >= least_depth).select(*SITE, "sample", "f", "depth")
    rows = strain_sites(counts, snvs, least_depth)
    clusters = snv_clusters(snv_vectors(rows), near=near, **options)
    centroids = rows.join(clusters, list(SITE)).groupBy("species", "cluster", "sample").agg(F.avg(_turned()).alias("f"), F.avg("depth").alias("depth")).persist(StorageLevel.DISK_ONLY)
    balanced = balanced_centroids(centroids).select("species", "cluster", F.col("turned").alias("_b")).distinct()
    assigned = N.assigned(every, centroids, near).join(balanced, ["species", "cluster"]).withColumn("turned", F.col("turned") != F.col("_b"))
    freqs = every.join(assigned.select(*SITE, "cluster", "turned"), list(SITE)).groupBy("species", "cluster", "sample").agg(F.avg(_turned()).alias("freq"), F.count(F.lit(1)).alias("snvs"))
    named = freqs.withColumnRenamed("cluster", "strain").join(samples.select("sample", "subject_id"), "sample")
    order = N.strain_order(named, inoculum)
    return named.join(order, ["species", "strain"]).select("species", "strain", "sample", "freq", "snvs", "place")
