"""Grouped inference: numpy kernels over Arrow batches, each group of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import expr
from lociweave.functions import kernels as K

SITE = ("species", "contig", "pos")
_SEED = 0x7FFFFFFF


def trajectory_pvalues(counts: DataFrame, draws: int = 10_000) -> DataFrame:
    """P-value of every site's trajectory; the seed follows from the site, so a retry gives the same."""
    lists = counts.groupBy(*SITE).agg(F.array_sort(F.collect_list(F.struct("sample", "alt", "depth"))).alias("s")).select(*SITE, F.transform("s", lambda x: x["alt"]).alias("alts"), F.transform("s", lambda x: x["depth"]).alias("depths"), F.xxhash64(*SITE).alias("seed"))

    @F.pandas_udf("double")
    def pvalue(alts: pd.Series, depths: pd.Series, seed: pd.Series) -> pd.Series:
        out, seeds, sizes = np.empty(len(alts)), seed.to_numpy() & _SEED, alts.map(len).to_numpy()
        for n in np.unique(sizes):
            on = np.flatnonzero(sizes == n)
            out[on] = K.trajectory_pvalues(np.stack(alts.to_numpy()[on]), np.stack(depths.to_numpy()[on]), seeds[on], draws)
        return pd.Series(out)

    return lists.select(*SITE, pvalue("alts", "depths", "seed").alias("pvalue"))


def polymorphic(counts: DataFrame, level: float = 0.05) -> DataFrame:
    """Counts whose minor reads errors alone do not explain; each distinct (alt, depth) is computed once."""
    tail = expr.binomial_tail(F.least("alt", F.col("depth") - F.col("alt")), F.col("depth"), K.ERROR)
    table = counts.select("alt", "depth").distinct().withColumn("pvalue", tail).filter(F.col("pvalue") < level)
    return counts.join(table, ["alt", "depth"])


def smoothed_spectra(sfs: DataFrame, rounds: int = 100) -> DataFrame:
    """(species, sample, f, share) by expectation maximisation over a sample's (depth, alt) cells."""

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        p = K.smoothed_spectrum(t["depth"].to_numpy(), t["alt"].to_numpy(), t["n"].to_numpy(float), rounds)
        return pd.DataFrame({"species": t["species"].iloc[0], "sample": t["sample"].iloc[0], "f": np.arange(1, len(p) + 1) / (len(p) + 1), "share": p})

    cells = sfs.groupBy("species", "sample", "depth", "alt").agg(F.sum("n").alias("n"))
    return cells.groupBy("species", "sample").applyInPandas(fit, "species string, sample string, f double, share double")


def clades(pairs: DataFrame, value: str, height: float) -> DataFrame:
    """Average-linkage clades of a species' samples; the matrix has the square of a cohort's size."""

    def cluster(t: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(t["sample_1"]) | set(t["sample_2"]))
        at = {s: i for i, s in enumerate(names)}
        d = np.full((len(names), len(names)), t[value].max() if len(t) else 0.0)
        i, j = t["sample_1"].map(at), t["sample_2"].map(at)
        d[i, j] = d[j, i] = t[value]
        return pd.DataFrame({"species": t["species"].iloc[0], "sample": names, "clade": K.cut_tree(K.upgma(d), len(names), height)})

    return pairs.select("species", "sample_1", "sample_2", value).groupBy("species").applyInPandas(cluster, "species string, sample string, clade long")


def ordination(pairs: DataFrame, value: str, k: int = 2) -> DataFrame:
    """Classical scaling of a dissimilarity between the samples of a cohort."""

    def scale(t: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(t["sample_1"]) | set(t["sample_2"]))
        at = {s: i for i, s in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        i, j = t["sample_1"].map(at), t["sample_2"].map(at)
        d[i, j] = d[j, i] = t[value]
        xy, share = K.classical_mds(d, k)
        return pd.DataFrame({"sample": names, "x": xy[:, 0], "y": xy[:, 1], "share_x": share[0], "share_y": share[1]})

    return pairs.select("sample_1", "sample_2", value, F.lit(1).alias("_one")).groupBy("_one").applyInPandas(scale, "sample string, x double, y double, share_x double, share_y double")


def sequential_anova(rows: DataFrame, by: list[str], value: str, factors: list[str]) -> DataFrame:
    """(by, factor, df, sum_sq, f, pvalue): sequential analysis of variance of each group over ``factors``.

    Spark sums the rows of each cell of the factors up to its count, mean and squared
    distances, with partial sums before the shuffle; the model is fitted to those cells, as
    many as the factors have combinations, however many rows there are. Rows with a null
    value or factor take no part.
    """
    n = F.count(F.lit(1))
    cells = rows.select(*by, value, *factors).dropna(subset=[value, *factors]).groupBy(*by, *factors).agg(n.alias("_n"), F.avg(value).alias("_mean"), (F.var_pop(value) * n).alias("_within"))

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(factors)
        got = K.sequential_anova(t["_mean"].to_numpy(float), [t[f].to_numpy() for f in factors], t["_n"].to_numpy(), float(t["_within"].sum()))
        return pd.DataFrame({**{b: t[b].iloc[0] for b in by}, "factor": [*factors, "residual"], "df": [g[0] for g in got], "sum_sq": [g[1] for g in got], "f": [g[2] for g in got], "pvalue": [g[3] for g in got]})

    return cells.groupBy(*by).applyInPandas(fit, ", ".join(f"{b} string" for b in by) + ", factor string, df long, sum_sq double, f double, pvalue double")


def variance_explained(rows: DataFrame, value: str, factors: list[str]) -> DataFrame:
    """Each factor's share of a species' variance, factors added in turn."""
    got = sequential_anova(rows, ["species"], value, factors)
    whole = F.sum("sum_sq").over(Window.partitionBy("species"))
    return got.select("species", "factor", "df", F.try_divide("sum_sq", whole).alias("share"), "pvalue")


def signed_rank_tests(pairs: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """(by, n, pvalue, estimate, lower, upper): paired signed-rank test of each group's differences, with the interval of their centre; a group is a cohort's pairs."""

    def test(t: pd.DataFrame) -> pd.DataFrame:
        x = np.sort((t[first] - t[second]).to_numpy(float))
        return pd.DataFrame([[*(t[b].iloc[0] for b in by), len(x), K.signed_rank(x), *K.signed_rank_interval(x)]], columns=[*by, "n", "pvalue", "estimate", "lower", "upper"])

    return pairs.select(*by, first, second).dropna().groupBy(*by).applyInPandas(test, ", ".join(f"{b} string" for b in by) + ", n bigint, pvalue double, estimate double, lower double, upper double")


def fixation_errors(sfs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Expected false flips of each pair of samples, from their spectra: each sample's chances once, then a sum over bins."""

    def parts(t: pd.DataFrame) -> pd.DataFrame:
        got = K.fixation_parts(t["depth"].to_numpy(), t["alt"].to_numpy(), t["n"].to_numpy(float))
        return pd.DataFrame({"species": t["species"].iloc[0], "sample": t["sample"].iloc[0], "p": [got[0].tolist()], "low": [got[1].tolist()], "high": [got[2].tolist()]})

    each = sfs.select("species", "sample", "depth", "alt", "n").groupBy("species", "sample").applyInPandas(parts, "species string, sample string, p array<double>, low array<double>, high array<double>")
    both = pairs.select("sample_1", "sample_2")
    for k in (1, 2):
        side = each.select("species", F.col("sample").alias(f"sample_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("p", "low", "high")])
        both = both.join(side, f"sample_{k}" if k == 1 else ["species", f"sample_{k}"])
    term = lambda z: (z["p_1"] + z["p_2"]) / 2 * (z["low_1"] * z["high_2"] + z["high_1"] * z["low_2"])
    names = [f"{c}_{k}" for c in ("p", "low", "high") for k in (1, 2)]
    return both.select("species", "sample_1", "sample_2", F.aggregate(F.arrays_zip(*names), F.lit(0.0), lambda s, z: s + term(z)).alias("expected"))
