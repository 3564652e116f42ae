"""Resampling without gathering: Poisson bootstraps of sums, counts split in half, labels permuted as bit sets.

A bootstrap gives each row a weight drawn from a Poisson law of mean 1 by a hash of the
row and of the replicate. So replicates are sums of rows, which Spark adds up with
partial sums where the rows are; no task sees all rows of a group, and the same rows
get the same weights on every engine and on every retry.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociweave.operators.analyses import PAIR, drawn
from lociweave.operators.resampling import halves

#: A hash of 128 bits holds as many weights, of 16 bits each.
WORDS = 8
#: How many of 65,536 draws of 16 bits lie below 1, 2, ... events at a mean of 1.
POISSON = [int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]


def poisson_weight(word: Column) -> Column:
    """The number of events that 16 random bits stand for."""
    return sum((F.when(word >= t, 1).otherwise(0) for t in POISSON), F.lit(0))


def weighted(rows: DataFrame, key: list[str], draws: int, seed: int = 0) -> DataFrame:
    """``rows`` with ``rep`` from 0 and the weight ``w`` above 0 that a row has in that replicate."""
    hashed = rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // WORDS) - 1)))).withColumn("_h", drawn(*key, "_c", seed=seed))
    words = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.conv(F.substring(F.col("_h"), 4 * i + 1, F.lit(4)), 16, 10).cast("int"))
    each = hashed.select(*rows.columns, "_c", F.posexplode(words).alias("_i", "_u"))
    out = each.select(*rows.columns, (WORDS * F.col("_c") + F.col("_i")).alias("rep"), poisson_weight(F.col("_u")).alias("w"))
    return out.filter((F.col("rep") < draws) & (F.col("w") > 0))


def _interval(value: str) -> list[Column]:
    return [F.percentile(value, q).alias(n) for n, q in (("lower", 0.025), ("upper", 0.975))]


def bootstrap_ratios(rows: DataFrame, by: list[str], key: list[str], num: str, den: str, draws: int = 500, seed: int = 0, pseudo: float = 0.0) -> DataFrame:
    """(by, ratio, lower, upper): the ratio of a group's sums, and the central 95 % of it over replicates.

    ``key`` tells rows apart; ``pseudo`` is added to both sums. A replicate without a denominator has no ratio.
    """
    ratio = lambda a, b: F.try_divide(a + pseudo, F.nullif(b + pseudo, F.lit(0.0)))
    held = rows.select(*dict.fromkeys([*by, *key]), F.col(num).cast("double").alias("_num"), F.col(den).cast("double").alias("_den"))
    seen = held.groupBy(*by).agg(ratio(F.sum("_num"), F.sum("_den")).alias("ratio"))
    reps = weighted(held, key, draws, seed).groupBy(*by, "rep").agg(ratio(F.sum(F.col("w") * F.col("_num")), F.sum(F.col("w") * F.col("_den"))).alias("_r"))
    return seen.join(reps.groupBy(*by).agg(*_interval("_r")), by, "left")


def cumulative_intervals(rows: DataFrame, by: list[str], key: list[str], at: str, num: str, den: str, cuts: list[float], draws: int = 500, seed: int = 0) -> DataFrame:
    """(by, cut, n_below, below, below_lower, below_upper, above, above_lower, above_upper): ratios of sums over the rows with ``at`` up to each cut, and beyond it.

    Rows are counted by the first cut they do not pass, so a replicate is a few sums
    however many rows there are; these are then cumulated.
    """
    first = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(at))).alias("_bin")
    held = rows.select(*dict.fromkeys([*by, *key]), first, F.col(num).cast("double").alias("_num"), F.col(den).cast("double").alias("_den"))
    seen = held.withColumn("rep", F.lit(-1)).withColumn("w", F.lit(1))
    sums = seen.unionByName(weighted(held, key, draws, seed)).groupBy(*by, "rep", "_bin").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("_num", "_den")], F.sum("w").alias("_n"))
    part = lambda k, c, up: F.sum(F.when(F.col("_bin") <= k if up else F.col("_bin") > k, F.col(c)))
    told = F.array(*[F.struct(F.lit(float(c)).alias("cut"), *[part(k, x, up).alias(f"{x}_{side}") for x in ("_num", "_den", "_n") for side, up in (("below", True), ("above", False))]) for k, c in enumerate(cuts)])
    each = sums.groupBy(*by, "rep").agg(told.alias("_t")).select(*by, "rep", F.explode("_t").alias("_t")).select(*by, "rep", "_t.*")
    each = each.select(*by, "rep", "cut", F.coalesce("_n_below", F.lit(0)).alias("_k"), *[F.try_divide(f"_num_{s}", F.nullif(F.col(f"_den_{s}"), F.lit(0.0))).alias(s) for s in ("below", "above")])
    own = F.col("rep") == -1
    ends = [F.percentile(F.when(~own, F.col(s)), q).alias(f"{s}_{n}") for s in ("below", "above") for n, q in (("lower", 0.025), ("upper", 0.975))]
    got = each.groupBy(*by, "cut").agg(F.max(F.when(own, F.col("_k"))).alias("n_below"), *[F.max(F.when(own, F.col(s))).alias(s) for s in ("below", "above")], *ends)
    return got.select(*by, "cut", "n_below", *[f"{s}{e}" for s in ("below", "above") for e in ("", "_lower", "_upper")])


def halved_selection(rates: DataFrame, seed: int = 0) -> DataFrame:
    """(pair, n_syn, n_non, ds, dnds, ds_other, expected_non): dN/dS of each pair with one half of its synonymous changes, and its divergence by the other.

    ``rates`` has muts, revs and their opportunities by type (4D, 1D). Every synonymous
    change falls into a half by a fair draw of its own (a hash of the pair), so the axis
    ``ds`` and the denominator of ``dnds`` share no noise. One pseudocount, spread over the
    sites of both, keeps ratios finite; ``expected_non`` is the number of nonsynonymous
    changes that the second half leads one to expect at a ratio of 1.
    """
    at = lambda kind, c: F.sum(F.when(F.col("type") == kind, c).otherwise(0)).cast("bigint")
    n, sites = F.col("muts") + F.col("revs"), F.col("mut_opportunities") + F.col("rev_opportunities")
    each = rates.groupBy(*PAIR).agg(at("4D", n).alias("n_syn"), at("4D", sites).alias("l_syn"), at("1D", n).alias("n_non"), at("1D", sites).alias("l_non")).filter("l_syn > 0 and l_non > 0")
    both = halves(each, "n_syn", seed=seed)
    half = F.col("l_syn") / 2
    pseudo = 1 / (half + F.col("l_non"))
    other = F.col("half_2") / half
    dnds = (pseudo + F.col("n_non") / F.col("l_non")) / (pseudo + other)
    return both.select(*PAIR, "n_syn", "n_non", (F.col("half_1") / half).alias("ds"), dnds.alias("dnds"), other.alias("ds_other"), (other * F.col("l_non")).alias("expected_non"))


# labels ------------------------------------------------------------------------

#: Trials in one word of a bit set.
TRIAL_BITS = 32


def permuted_labels(members: DataFrame, by: str, flag: str, trials: int, seed: int = 0) -> DataFrame:
    """(by, sample, words): bit t of the words tells whether the sample has the label in trial t, of which trial 0 is the truth.

    A trial ranks a group's samples by a hash and gives as many of the first ones the label as have it.
    """
    n = F.sum(F.col(flag).cast("int")).over(Window.partitionBy(by))
    each = members.select(by, "sample", F.col(flag).alias("_flag"), n.alias("_n")).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(trials))))
    w = Window.partitionBy(by, "_t").orderBy(drawn(by, "sample", "_t", seed=seed), "sample")
    on = F.when(F.col("_t") == 0, F.col("_flag")).otherwise(F.row_number().over(w) <= F.col("_n"))
    bits = each.select(by, "sample", "_t", on.alias("_on")).groupBy(by, "sample", F.floor(F.col("_t") / TRIAL_BITS).alias("_w")).agg(F.sum(F.when(F.col("_on"), F.expr(f"shiftleft(1L, cast(_t % {TRIAL_BITS} as int))")).otherwise(F.lit(0).cast("bigint"))).alias("_b"))
    return bits.groupBy(by, "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_b"))), lambda x: x["_b"]).alias("words"))


def _within(by: str, trials: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            # two samples share a label where their bits agree
            words = [b[c].flatten().to_numpy().astype("<u4").reshape(b.num_rows, -1) for c in ("words_1", "words_2")]
            same = np.unpackbits((~(words[0] ^ words[1])).view(np.uint8), axis=1, bitorder="little")[:, : trials + 1].astype(np.float64)
            value, groups = b["value"].to_numpy(), np.array(b[by].to_pylist(), dtype=object)
            for g in set(groups.tolist()):
                at = groups == g
                got = np.stack([value[at] @ same[at], same[at].sum(axis=0), np.full(trials + 1, value[at].sum()), np.full(trials + 1, float(at.sum()))])
                sums[g] = sums.get(g, 0) + got
        for g, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * (trials + 1), pa.string()), pa.array(np.arange(trials + 1), pa.int32()), *[pa.array(x, pa.float64()) for x in s]], [by, "trial", "within", "n_within", "total", "n"])

    return run


def permuted_fst(pairs: DataFrame, labels: DataFrame, value: str, flag: str, trials: int = 199, seed: int = 0, by: str = "species") -> DataFrame:
    """(by, fst, pvalue): one less the mean of ``value`` within the two labels over that of all pairs, and the share of shuffled labels that reach it, (k + 1) / (n + 1).

    All trials come from one pass over the pairs: labels are bit sets, a task adds up a
    vector of trials for each group, and Spark adds these up. Groups need two samples of
    each label.
    """
    names = pairs.select(by, F.explode(F.array("sample_1", "sample_2")).alias("sample")).distinct().join(labels.select("sample", flag), "sample")
    enough = names.groupBy(by).agg(F.sum(F.col(flag).cast("int")).alias("_a"), F.count(F.lit(1)).alias("_b")).filter("_a >= 2 and _b - _a >= 2").select(by)
    bits = permuted_labels(names.join(enough, by, "left_semi"), by, flag, trials, seed)
    one, two = (bits.select(by, F.col("sample").alias(f"sample_{k}"), F.col("words").alias(f"words_{k}")) for k in (1, 2))
    both = pairs.select(by, "sample_1", "sample_2", F.col(value).cast("double").alias("value")).join(one, [by, "sample_1"]).join(two, [by, "sample_2"])
    parts = both.select(by, "value", "words_1", "words_2").mapInArrow(_within(by, trials), f"{by} string, trial int, within double, n_within double, total double, n double")
    sums = parts.groupBy(by, "trial").agg(*[F.sum(c).alias(c) for c in ("within", "n_within", "total", "n")])
    fst = 1 - F.try_divide(F.col("within") / F.col("n_within"), F.nullif(F.col("total") / F.col("n"), F.lit(0.0)))
    told = sums.select(by, "trial", fst.alias("_f")).withColumn("fst", F.max(F.when(F.col("trial") == 0, F.col("_f"))).over(Window.partitionBy(by)))
    hit = F.when((F.col("trial") > 0) & (F.col("_f") >= F.col("fst") - 1e-9), 1).otherwise(0)
    return told.groupBy(by, "fst").agg(((F.sum(hit) + 1) / F.lit(float(trials + 1))).alias("pvalue"))
