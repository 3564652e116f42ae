"""Principal coordinates of a cohort by block power iteration over the covariances of its pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Up to so many samples the block of vectors is broadcast.
MOST_BROADCAST = 200_000


def _oriented(v: np.ndarray) -> np.ndarray:
    """Each axis with its largest entry positive."""
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def principal_axes(cov: DataFrame, k: int = 2, extra: int = 6, rounds: int = 200, tolerance: float = 1e-8, by: str = "species") -> DataFrame:
    """(by, sample, axis, coordinate, share): the first ``k`` axes of each group's covariance (by, sample_1, sample_2, cov).

    ``cov`` has a row for each two samples and for each sample with itself; pairs without
    one count as 0. A round multiplies the matrix, which stays distributed, with a block of
    ``k + extra`` vectors, a row a sample, and the vectors alone come back to be made
    orthogonal. It ends when the axes have settled. The extra vectors also take up
    eigenvalues that gaps in the data can make negative.
    """
    spark = cov.sparkSession
    whole = cov.select(by, "sample_1", "sample_2", "cov")
    whole = whole.unionByName(whole.filter(F.col("sample_1") != F.col("sample_2")).select(by, F.col("sample_2").alias("sample_1"), F.col("sample_1").alias("sample_2"), "cov")).persist(StorageLevel.DISK_ONLY)
    diagonal = whole.filter(F.col("sample_1") == F.col("sample_2")).select(by, "sample_1", "cov").orderBy(by, "sample_1").collect()
    names: dict[str, list[str]] = {}
    trace: dict[str, float] = {}
    for g, s, c in diagonal:
        names.setdefault(g, []).append(s)
        trace[g] = trace.get(g, 0.0) + c
    rng = np.random.default_rng(1)
    block = {g: np.linalg.qr(rng.standard_normal((len(s), min(k + extra, len(s)))))[0] for g, s in names.items()}
    axes: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    width = max((q.shape[1] for q in block.values()), default=0)
    for _ in range(rounds if names else 0):
        rows = [(g, s, *map(float, q[i]), *[0.0] * (width - q.shape[1])) for g, q in block.items() for i, s in enumerate(names[g])]
        vectors = spark.createDataFrame(rows, f"{by} string, sample_2 string, " + ", ".join(f"q{c} double" for c in range(width)))
        # a row a sample: its number is known here
        vectors = F.broadcast(vectors) if len(rows) <= MOST_BROADCAST else vectors
        got = whole.join(vectors, [by, "sample_2"]).groupBy(by, "sample_1").agg(*[F.sum(F.col("cov") * F.col(f"q{c}")).alias(f"q{c}") for c in range(width)]).toPandas()
        settled = True
        for g, t in got.groupby(by):
            q = block[g]
            z = t.set_index("sample_1").loc[names[g]][[f"q{c}" for c in range(q.shape[1])]].to_numpy()
            # the axes as the block sees them
            ritz = q.T @ z
            values, inside = np.linalg.eigh((ritz + ritz.T) / 2)
            now = _oriented(q @ inside[:, ::-1][:, :k])
            before = axes.get(g, (None, None))[1]
            whole_space = q.shape[1] == len(names[g])
            settled &= whole_space or (before is not None and float(np.abs(now - before).max()) < tolerance)
            axes[g] = (values[::-1][:k], now)
            block[g] = np.linalg.qr(z)[0]
        if settled:
            break
    whole.unpersist()
    out = [(g, s, c + 1, float(v[i, c] * max(w[c], 0.0) ** 0.5), float(w[c] / trace[g]) if trace[g] else None) for g, (w, v) in axes.items() for i, s in enumerate(names[g]) for c in range(v.shape[1])]
    return spark.createDataFrame(out, f"{by} string, sample string, axis int, coordinate double, share double")
