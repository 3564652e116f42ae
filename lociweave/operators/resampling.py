"""Random draws, greedy clusterings and tests by permutation. Draws by a hash are relational; kernels run over groups of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.functions import kernels as K
from lociweave.operators.analyses import PAIR, drawn, one


def hash_number(*keys: str | Column, seed: int = 0) -> Column:
    """The first 32 bits of ``drawn`` as a number."""
    return F.conv(F.substring(drawn(*keys, seed=seed), 1, 8), 16, 10).cast("bigint")


def permutation_test(rows: DataFrame, by: list[str], label: str, value: str, key: str, trials: int = 199, seed: int = 0) -> DataFrame:
    """(by, gap, pvalue): the difference of the two labels' means, and the share of shuffled labels with one as large, (k + 1) / (n + 1).

    A trial ranks a group's rows by a hash and gives the first of them the true label.
    """
    n1, n = F.sum(F.col(label).cast("int")), F.count(F.lit(1))
    m1, m0 = F.avg(F.when(F.col(label), F.col(value))), F.avg(F.when(~F.col(label), F.col(value)))
    seen = rows.groupBy(*by).agg(n1.alias("_n1"), n.alias("_n"), F.sum(value).alias("_sum"), F.abs(m1 - m0).alias("gap")).filter("_n1 > 0 and _n1 < _n")
    each = rows.select(*by, key, value).join(seen.select(*by, "_n1"), by).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    w = Window.partitionBy(*by, "trial").orderBy(drawn(key, "trial", seed=seed), key)
    sums = each.withColumn("_r", F.row_number().over(w)).filter("_r <= _n1").groupBy(*by, "trial").agg(F.sum(value).alias("_s"))
    back = sums.join(seen, by).withColumn("_g", F.abs(F.col("_s") / F.col("_n1") - (F.col("_sum") - F.col("_s")) / (F.col("_n") - F.col("_n1"))))
    return back.groupBy(*by, "gap").agg(((one(F.col("_g") >= F.col("gap") - 1e-9) + 1) / (trials + 1)).alias("pvalue"))


def control_genes(genes: DataFrame, draws: int = 10, apart: int = 5, seed: int = 0) -> DataFrame:
    """(gene_number, draw, control): genes of the same list more than ``apart`` numbers away, drawn by a hash; a draw that is nearer is left out.

    ``genes`` has the distinct gene numbers; the list is numbered once, so a draw is a lookup and not a pair of all genes.
    """
    every = genes.agg(F.count(F.lit(1)).alias("_all"))
    # a rank over the genes of a species, some thousands
    place = genes.select(F.col("gene_number").alias("control"), (F.row_number().over(Window.orderBy("gene_number")) - 1).alias("_at"))
    # one row beside each gene
    asked = genes.join(F.broadcast(every), F.lit(True)).select("gene_number", "_all", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("_at", hash_number("gene_number", "draw", seed=seed) % F.col("_all"))
    return asked.join(place, "_at").filter(F.abs(F.col("gene_number") - F.col("control")) > apart).select("gene_number", "draw", "control")


def clade_enrichment(rows: DataFrame, clade: str, flag: str) -> DataFrame:
    """(clade, k, n, lrt): twice the log-likelihood gain of a share of its own for the clade against one for all."""
    k, n = one(F.col(flag)), F.count(F.lit(1))
    got = rows.groupBy(clade).agg(k.alias("k"), n.alias("n"))
    every = got.agg(F.sum("k").alias("_k"), F.sum("n").alias("_n"))
    both = got.join(F.broadcast(every), F.lit(True))
    ll = lambda a, b: F.when((a > 0) & (a < b), a * F.log(a / b) + (b - a) * F.log(1 - a / b)).otherwise(F.lit(0.0))
    rest_k, rest_n = F.col("_k") - F.col("k"), F.col("_n") - F.col("n")
    gain = ll(F.col("k"), F.col("n")) + ll(rest_k, F.nullif(rest_n, F.lit(0))) - ll(F.col("_k"), F.col("_n"))
    return both.select(clade, "k", "n", (2 * gain).alias("lrt"))


def sweep_prevalence(changes: DataFrame, freqs: DataFrame, private: DataFrame) -> DataFrame:
    """Changes with the prevalence of the allele that swept: 0 for private SNVs and unknown sites, turned where the allele was lost."""
    site = ["species", "contig", "pos"]
    rows = changes.join(freqs.select(*site, "freq"), site, "left").join(private.select(*site).distinct().withColumn("_p", F.lit(True)), site, "left")
    f = F.when(F.col("_p"), F.lit(0.0)).otherwise(F.coalesce("freq", F.lit(0.0)))
    return rows.select(*changes.columns, F.when(F.col("f1") > F.col("f2"), 1 - f).otherwise(f).alias("prevalence"))


def halves(rates: DataFrame, n: str, seed: int = 0) -> DataFrame:
    """``rates`` with ``n`` dealt to two halves, each count by a fair draw of its own by a hash: bits of one number, 32 counts each."""
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / 32).cast("int") - 1, F.lit(0)))
    bits = lambda k: F.bit_count(hash_number(*PAIR, k, seed=seed).bitwiseAND(F.expr(f"shiftleft(1L, cast(least(32, {n} - 32 * k) as int)) - 1")))
    rows = rates.withColumn("k", F.explode(words))
    got = rows.withColumn("_b", F.when(F.col(n) > 0, bits(F.col("k"))).otherwise(0)).groupBy(*rates.columns).agg(F.sum("_b").cast("bigint").alias("half_1"))
    return got.withColumn("half_2", F.col(n) - F.col("half_1"))


def window_intervals(bins: DataFrame, low: int, high: int, draws: int = 500) -> DataFrame:
    """(species, ratio, lower, upper): pooled ratio of the bins in a window of distance, its interval by drawing bins by their counts."""

    def boot(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("bin")
        rng, p = np.random.default_rng(23), t["n"].to_numpy(float)
        weights = rng.multinomial(int(p.sum()), p / p.sum(), draws) / np.maximum(p, 1)
        got = (weights @ t["num"].to_numpy()) / np.maximum(weights @ t["den"].to_numpy(), 1e-300)
        return pd.DataFrame([[t["species"].iloc[0], t["num"].sum() / t["den"].sum(), *np.percentile(got, [2.5, 97.5])]], columns=["species", "ratio", "lower", "upper"])

    rows = bins.filter(F.col("bin").between(low, high)).select("species", "bin", "num", "den", "n")
    return rows.groupBy("species").applyInPandas(boot, "species string, ratio double, lower double, upper double")


def clades_within(pairs: DataFrame, clades: DataFrame, value: str, height: float) -> DataFrame:
    """Average-linkage clades inside each clade of (species, sample, clade)."""

    def cluster(t: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(t["sample_1"]) | set(t["sample_2"]))
        at = {s: i for i, s in enumerate(names)}
        d = np.full((len(names), len(names)), float(t[value].max()))
        i, j = t["sample_1"].map(at), t["sample_2"].map(at)
        d[i, j] = d[j, i] = t[value]
        return pd.DataFrame({"species": t["species"].iloc[0], "clade": t["clade"].iloc[0], "sample": names, "subclade": K.cut_tree(K.upgma(d), len(names), height)})

    a, b = (clades.select("species", F.col("sample").alias(f"sample_{k}"), F.col("clade").alias(f"_c{k}")) for k in (1, 2))
    inside = pairs.join(a, ["species", "sample_1"]).join(b, ["species", "sample_2"]).filter("_c1 = _c2").select("species", F.col("_c1").cast("bigint").alias("clade"), "sample_1", "sample_2", value)
    return inside.groupBy("species", "clade").applyInPandas(cluster, "species string, clade long, sample string, subclade long")


def close_haplotypes(a: str, b: str, most: int) -> str | None:
    """``a`` with its unknown letters (N) from ``b``, if the known ones differ at no more than ``most`` places."""
    if sum(x != y and x != "N" and y != "N" for x, y in zip(a, b, strict=True)) > most:
        return None
    return "".join(y if x == "N" else x for x, y in zip(a, b, strict=True))


def clump(names: list[str], sizes: list[int], most: int) -> list[tuple[str, int, int]]:
    """(haplotype, size, members) of clumps: haplotypes by size and name, each joining the first clump within ``most``, which it completes."""
    out: list[list] = []
    for name, size in sorted(zip(names, sizes, strict=True), key=lambda x: (-x[1], x[0])):
        for c in out:
            filled = close_haplotypes(c[0], name, most)
            if filled is not None:
                c[0], c[1], c[2] = filled, c[1] + size, c[2] + 1
                break
        else:
            out.append([name, size, 1])
    return [tuple(c) for c in out]


def clumped(counts: DataFrame, most: int = 1) -> DataFrame:
    """(species, gene_id, haplotype, n, members) of each gene's clumps of (haplotype, n); a gene has a cohort's haplotypes at most."""

    def made(t: pd.DataFrame) -> pd.DataFrame:
        got = clump(t["haplotype"].tolist(), t["n"].tolist(), most)
        return pd.DataFrame({"species": t["species"].iloc[0], "gene_id": t["gene_id"].iloc[0], "haplotype": [g[0] for g in got], "n": [g[1] for g in got], "members": [g[2] for g in got]})

    return counts.select("species", "gene_id", "haplotype", "n").groupBy("species", "gene_id").applyInPandas(made, "species string, gene_id string, haplotype string, n long, members long")


def clustered_descriptions(rows: DataFrame, by: str, most: int = 2) -> DataFrame:
    """(by, description, cluster): sorted descriptions, each joining the cluster whose first one is within ``most`` letters."""

    def made(t: pd.DataFrame) -> pd.DataFrame:
        firsts, out = [], []
        for x in sorted(set(t["description"])):
            far = lambda y, x=x: sum(a != b for a, b in zip(x, y, strict=False)) + abs(len(x) - len(y))
            k = next((k for k, y in enumerate(firsts) if far(y) <= most), len(firsts))
            firsts += [x] if k == len(firsts) else []
            out.append((t[by].iloc[0], x, k))
        return pd.DataFrame(out, columns=[by, "description", "cluster"])

    return rows.select(by, "description").groupBy(by).applyInPandas(made, f"{by} string, description string, cluster long")


def metric_scaling(pairs: DataFrame, value: str, rounds: int = 300, starts: int = 8) -> DataFrame:
    """(sample, x, y, stress): scaling by majorisation, the best of some seeded starts; the samples of a cohort."""

    def place(d: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
        x = np.random.default_rng(seed).standard_normal((len(d), 2))
        far = lambda: np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        for _ in range(rounds):
            e = far()
            b = -np.where(e > 0, d / np.where(e > 0, e, 1), 0)
            np.fill_diagonal(b, 0)
            np.fill_diagonal(b, -b.sum(1))
            x = b @ x / len(d)
        return float(((far() - d) ** 2).sum() / 2), x

    def scale(t: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(t["sample_1"]) | set(t["sample_2"]))
        at = {s: i for i, s in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        i, j = t["sample_1"].map(at), t["sample_2"].map(at)
        d[i, j] = d[j, i] = t[value]
        stress, x = min((place(d, 42 + k) for k in range(starts)), key=lambda p: p[0])
        return pd.DataFrame({"sample": names, "x": x[:, 0], "y": x[:, 1], "stress": stress})

    return pairs.select("sample_1", "sample_2", value, F.lit(1).alias("_one")).groupBy("_one").applyInPandas(scale, "sample string, x double, y double, stress double")


def balanced_centroids(centroids: DataFrame) -> DataFrame:
    """(species, cluster, sample, f, turned): the centroid whose turning brings the sums over clusters nearest to 1 is turned, while that helps."""

    def turn(t: pd.DataFrame) -> pd.DataFrame:
        wide = t.pivot(index="cluster", columns="sample", values="f").sort_index()
        f, turned = wide.fillna(0).to_numpy(), np.zeros(len(wide), dtype=bool)
        known = wide.notna().to_numpy()
        off = lambda g: float(np.abs(np.where(known, g, 0).sum(0) - 1).sum())
        best = off(f)
        while True:
            tries = [off(np.where(np.arange(len(f))[:, None] == k, 1 - f, f)) for k in range(len(f))]
            k = int(np.argmin(tries)) if tries else 0
            if not tries or tries[k] >= best - 1e-12:
                break
            f, best = np.where(np.arange(len(f))[:, None] == k, 1 - f, f), tries[k]
            turned[k] = ~turned[k]
        rows = [(t["species"].iloc[0], int(c), s, float(f[i, j]), bool(turned[i])) for i, c in enumerate(wide.index) for j, s in enumerate(wide.columns) if known[i, j]]
        return pd.DataFrame(rows, columns=["species", "cluster", "sample", "f", "turned"])

    return centroids.select("species", "cluster", "sample", "f").groupBy("species").applyInPandas(turn, "species string, cluster long, sample string, f double, turned boolean")
