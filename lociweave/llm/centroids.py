"""Centroid clustering by Sort-means, in whole numbers.

Each round orders the other centroids by their distance from every centroid. A
vector scans them in the order of its previous centroid and stops at the first one
that lies strictly beyond twice its distance from that centroid: by the triangle
inequality none from there on can be as near, ties included, so the result is that of
a full scan. A round is one pass: tasks assign their vectors and add up what they
assigned to each centroid, one row a task and centroid; Spark adds these rows up, and
only ``k`` sums of as many components as a vector has come to the driver. Distances,
sums and the rounded means are exact integers.

The assignment of the round before is read with the vectors, as a table in the shared
folder, so a lost executor costs its own tasks; a table is dropped once the next one
stands.

Defined cases: rows whose vector is null, of another length, or holds a null or a
non-finite component are left out; a null id stands after all others where first
centroids are chosen, and is a row like any other; repeated rows count as often as they
stand, and first centroids of one id are ordered by their components; fewer vectors
than ``k`` give as many centroids; an empty table stays empty; the result holds the id
and the columns made here, no other column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import held_at, removed
from lociweave.llm.vectors import finite, matrix, squares, whole

K = 40
ROUNDS = 5
DIMENSIONS = 64
SEED = 2


def nearest(x: np.ndarray, centers: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of ``x`` (of equally near ones the first) and its squared distance, scanned from ``before``."""
    gaps = np.stack([squares(centers, c) for c in centers])
    order = np.argsort(gaps, axis=1, kind="stable")
    at, least = np.array(before, dtype=np.int64), squares(x, centers[before])
    for own in np.unique(before):
        rows = np.flatnonzero(before == own)
        # farthest first, so that those which scan on are always the first ones
        rows = rows[np.argsort(-least[rows], kind="stable")]
        y, reach, best, found = x[rows], -4 * least[rows], least[rows], at[rows]
        for c in order[own]:
            live = int(np.searchsorted(reach, -gaps[own, c], side="right"))
            if not live:
                break
            if c != own:
                d = squares(y[:live], centers[c])
                take = np.flatnonzero((d < best[:live]) | ((d == best[:live]) & (c < found[:live])))
                best[take], found[take] = d[take], c
        at[rows], least[rows] = found, best
    return at, least


_ASSIGNED = "_cluster int, _distance bigint, _n bigint, _sums array<bigint>"


def _assigner(centers: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centers.shape
        counts, sums, kinds = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64), None
        names = ["_row", "_v", "_cluster", "_distance", "_n", "_sums"]
        longs = pa.list_(pa.int64())
        for b in batches:
            if not b.num_rows:
                continue
            x, kinds = matrix(b["_v"]), (b["_row"].type, b["_v"].type)
            at, least = nearest(x, centers, b["_cluster"].to_numpy())
            np.add.at(sums, at, x)
            counts += np.bincount(at, minlength=k)
            nothing = [pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, longs)]
            yield pa.RecordBatch.from_arrays([b["_row"], b["_v"], pa.array(at, pa.int32()), pa.array(least, pa.int64()), *nothing], names)
        if kinds:
            full = np.flatnonzero(counts)
            added = pa.array([s.tolist() for s in sums[full]], longs)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(full), kinds[0]), pa.nulls(len(full), kinds[1]), pa.array(full, pa.int32()), pa.nulls(len(full), pa.int64()), pa.array(counts[full], pa.int64()), added], names)

    return run


def moved(added: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The centroids after a round: each component's exact sum over the count, rounded down; those without vectors stay."""
    parts = added.select("_cluster", F.col("_n").cast("decimal(38,0)").alias("n"), F.posexplode("_sums").alias("dim", "s"))
    out = centers.copy()
    for r in parts.groupBy("_cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["_cluster"], r["dim"]] = int(r["s"]) // int(r["n"])
    return out


def clustered(rows: DataFrame, vector: str, centers: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(``_row``, ``_v``, ``_cluster``, ``_distance``) after ``rounds`` rounds and one more assignment, with the last centroids.

    ``vector`` holds whole numbers, as many in each row as a centroid has; ``_row`` is
    a struct of the other columns. The rows stand in the shared folder.
    """
    spark = rows.sparkSession
    others = [c for c in rows.columns if c != vector]
    state, path = rows.select(F.struct(*others).alias("_row"), F.col(vector).alias("_v"), F.lit(0).alias("_cluster")), None
    for k in range(rounds + 1):
        kept = f"_row {state.schema['_row'].dataType.simpleString()}, _v array<int>, {_ASSIGNED}"
        state, new = held_at(state.select("_row", "_v", "_cluster").mapInArrow(_assigner(centers), kept), "assigned")
        if path:
            removed(spark, path)
        path, added = new, state.filter(F.col("_n").isNotNull())
        state = state.filter(F.col("_n").isNull())
        if k < rounds:
            centers = moved(added, centers)
    return state.select("_row", "_v", "_cluster", "_distance"), centers


def sort_means(rows: DataFrame, id: str, vector: str, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Each vector's id, cluster and squared distance, with the inertia of its cluster and of all, and its centroid's checksum.

    The first centroids are the vectors with the ``k`` smallest SHA-256 of ``seed:id``.
    """
    spark = rows.sparkSession
    kept = rows.filter((F.size(vector) == dimensions) & finite(F.col(vector))).select(F.col(id).alias("id"), whole(F.col(vector)).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    kind = rows.schema[id].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string").withColumnRenamed("id", id)
    out, centers = clustered(kept, "v", np.array([r["v"] for r in first], dtype=np.int64), rounds)
    spread = {r["_cluster"]: r["d"] for r in out.groupBy("_cluster").agg(F.sum(F.col("_distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole_sum = sum(spread.values(), Decimal(0))
    told = [(c, int(d), int(whole_sum), hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()) for c, d in sorted(spread.items())]
    facts = spark.createDataFrame(told, "_cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row a centroid, k at most
    out = out.join(F.broadcast(facts), "_cluster")
    return out.select(F.col("_row.id").alias(id), F.col("_cluster").alias("cluster"), F.col("_distance").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def _sql() -> str:
    parts = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {K}))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, k.v AS v, min(struct_pack(d := list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v), c := c.c)) AS b
 FROM (SELECT row_number() OVER () AS row, * FROM kept) k CROSS JOIN c{r} c GROUP BY row, vec_id, k.v)""")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (SELECT c, list(floor(s / n) ORDER BY i) AS v FROM (SELECT b.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i) GROUP BY b.c, i) GROUP BY c)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c AS c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.c = m.c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, b.c AS cluster, b.d::BIGINT AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(list_transform(c{ROUNDS}.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON b.c = c{ROUNDS}.c"""


QUERIES = {"op12_centroids": op12_centroids}
ORACLE = {"op12_centroids": _sql()}
