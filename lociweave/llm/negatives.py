"""Hard-negative mining over k-means inverted lists, exact.

Every row stands in the list of one centroid (``centroids.clustered``: fitted on all
rows, starting from the ``lists`` rows with the smallest hashes), and each list stores
its radius, the largest distance of a row from its centroid. By Cauchy-Schwarz an
anchor's score with any row of a list lies within ``anchor . centroid`` plus and minus
``|anchor| * radius``. What is searched for an anchor, its positives and then for each
positive its negatives, is a need: a window of scores, a rule on labels, and how many
rows. A need visits the lists by their upper bound, cut at the top of its window. It
skips lists whose bounds lie outside the window and stops at the first list whose bound
is strictly below its kth score; ties are kept, so nothing is missed. Distributed, the
visits come in waves: the best list of all needs first, then those of the others that
the kth scores found so far leave over.

Anchors are searched in blocks of ``BLOCK``, whose vectors and bounds go out with the
tasks; the lists are never shuffled, each task reads its part of the lists that are
visited at all and returns the best rows of every need, at most as many as needed.

Defined cases: rows whose id, label or vector is null, or that hold a null or a
non-finite component, take no part; shorter vectors count as padded with zeros;
repeated rows are rows of their own, so a copy of an anchor is a candidate, and an
anchor that is repeated has its results as often; equal scores go by the smaller id; an
anchor without positives has no rows, a positive without negatives neither; an empty
table stays empty; columns besides the id, the label and the vector are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociweave.llm.centroids import clustered
from lociweave.llm.common import held_at, removed, scratch
from lociweave.llm.vectors import finite, matrix, products, whole

LISTS = 64
FIT_ROUNDS = 2
#: So many anchors are searched at once, about; and so many scores are held at once in a task.
BLOCK = 4096
CELLS = 2_000_000
POSITIVES = 5
NEGATIVES = 10
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90

_FOUND = "need int, score bigint, id bigint"
_LEAST = np.iinfo(np.int64).min


class Needs:
    """What is searched at once: for each need its anchor, the window of scores and the kth score found so far."""

    def __init__(self, anchors: dict[str, np.ndarray], of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.vectors, self.labels, self.rows = anchors["v"], anchors["label"], anchors["row"]
        self.of, self.low, self.high, self.same, self.k = of, low, high, same, k
        self.kth = np.full(len(of), _LEAST)

    def bounds(self, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """The most that a list can give each need; minus infinity where the list's bounds lie outside its window."""
        mid = products(self.vectors, centers).astype(np.float64)
        reach = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))[:, None] * radii[None, :]
        reach = reach * (1 + 1e-9) + 1e-9 * np.abs(mid) + 1  # above any rounding
        top, bottom = (mid + reach)[self.of], (mid - reach)[self.of]
        high, low = self.high[:, None].astype(np.float64), self.low[:, None].astype(np.float64)
        return np.where((top >= low) & (bottom <= high) & (radii[None, :] >= 0), np.minimum(top, high), -np.inf)


def best_rows(needs: Needs, which: np.ndarray, x: np.ndarray, labels: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows ``x`` the first ``k`` for each of the needs ``which``: (need, score, id)."""
    out = []
    step = max(1, CELLS // max(1, len(x)))
    for lo in range(0, len(which), step):
        part = which[lo : lo + step]
        anchors, at = np.unique(needs.of[part], return_inverse=True)
        scores = products(needs.vectors[anchors], x)
        alike = needs.labels[anchors][:, None] == labels[None, :]
        fits = alike & (needs.rows[anchors][:, None] != rows[None, :]) if needs.same else ~alike
        scores, fits = scores[at], fits[at]
        fits &= (scores >= np.maximum(needs.low[part], needs.kth[part])[:, None]) & (scores <= needs.high[part][:, None])
        if len(x) > needs.k:
            held = np.where(fits, scores, _LEAST)
            fits &= scores >= np.partition(held, len(x) - needs.k, axis=1)[:, len(x) - needs.k][:, None]
        r, c = np.nonzero(fits)
        s = scores[r, c]
        order = np.lexsort((ids[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < needs.k
        out.append((part[r[first]], s[first], ids[c[first]]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.empty(0, dtype=np.int64),) * 3


def _searcher(needs: Needs, visits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, at = matrix(b["v"]), b["at"].to_numpy()
            labels, rows, ids = (b[c].to_numpy() for c in ("label", "row", "id"))
            for list_ in np.unique(at):
                which, mine = np.flatnonzero(visits[:, list_]), at == list_
                if len(which):
                    need, score, id = best_rows(needs, which, x[mine], labels[mine], rows[mine], ids[mine])
                    yield pa.RecordBatch.from_arrays([pa.array(need, pa.int32()), pa.array(score, pa.int64()), pa.array(id, pa.int64())], ["need", "score", "id"])

    return run


def _firsts(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each need, with their ``rank`` from 1; a task has sent k rows of a list at most."""
    order = Window.partitionBy("need").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(lists: DataFrame, needs: Needs, centers: np.ndarray, radii: np.ndarray) -> tuple[DataFrame | None, list[str]]:
    """(need, score, id, rank) of all needs, and the scratch tables that it stands on."""
    spark, paths, found = lists.sparkSession, [], None
    bounds = needs.bounds(centers, radii)
    open_ = np.isfinite(bounds)
    best = np.zeros_like(open_)
    best[np.arange(len(bounds)), bounds.argmax(axis=1)] = True
    for wave in ("best", "others"):
        visits = open_ & (best if wave == "best" else ~best & (bounds >= needs.kth[:, None].astype(np.float64)))
        used = np.flatnonzero(visits.any(axis=0))
        if not len(used):
            continue
        seen, path = held_at(lists.filter(F.col("at").isin(used.tolist())).mapInArrow(_searcher(needs, visits), _FOUND), "found")
        paths.append(path)
        found = seen if found is None else found.unionByName(seen)
        if wave == "best":
            # a row a need of this block
            kth = _firsts(found, needs.k).filter(F.col("rank") == needs.k).select("need", "score").toArrow()
            needs.kth[kth["need"].to_numpy()] = kth["score"].to_numpy()
    return (None if found is None else _firsts(found, needs.k)), paths


def _block(anchors: DataFrame) -> dict[str, np.ndarray]:
    got = anchors.orderBy("id", "row").toArrow().combine_chunks()
    vectors = got["v"].combine_chunks()
    return {"v": matrix(vectors), **{c: got[c].to_numpy() for c in ("id", "label", "row")}}


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(rows: DataFrame, anchors: Column, id: str, vector: str, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, lists: int = LISTS) -> DataFrame:
    """For each row that meets ``anchors`` and each of its first ``positives`` rows of its label, the first ``negatives`` rows of other labels with a score in the window."""
    spark = rows.sparkSession
    base = rows.filter(F.col(id).isNotNull() & label.isNotNull() & finite(F.col(vector)))
    base = base.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole(F.col(vector)).alias("v"), anchors.alias("is_anchor"))
    width = base.agg(F.max(F.size("v")).alias("w")).first()["w"]
    if not width:
        return spark.createDataFrame([], RESULT)
    base = base.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(width) - F.size("v")))).withColumn("row", F.monotonically_increasing_id())
    first = base.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(lists).collect()
    listed, centers = clustered(base, "v", np.array([r["v"] for r in first], dtype=np.int64), FIT_ROUNDS)
    listed = listed.select("_row.*", F.col("_v").alias("v"), F.col("_cluster").alias("at"), F.col("_distance").alias("away"))
    table, at = held_at(listed.repartitionByRange("at", "id").sortWithinPartitions("at", "id"), "lists")
    # one number a list
    radii = np.full(len(centers), -1.0)
    for r in table.groupBy("at").agg(F.max("away").alias("r")).collect():
        radii[r["at"]] = float(r["r"]) ** 0.5
    chosen, result = table.filter("is_anchor"), scratch(spark, "negatives")
    blocks = -(-chosen.count() // BLOCK)
    for b in range(blocks):
        block = _block(chosen.filter(F.pmod(F.xxhash64("id", "row"), F.lit(blocks)) == b))
        if not len(block["id"]):
            continue
        n = len(block["id"])
        needs = Needs(block, np.arange(n), np.full(n, _LEAST), np.full(n, np.iinfo(np.int64).max), True, positives)
        found, used = search(table, needs, centers, radii)
        # at most ``positives`` rows an anchor of this block
        got = found.orderBy("need", "rank").toArrow() if found is not None else None
        removed(spark, *used)
        if got is None or not got.num_rows:
            continue
        of, score, positive = (got[c].to_numpy() for c in ("need", "score", "id"))
        needs = Needs(block, of.astype(np.int64), -(-(low * score) // 100), (high * score) // 100, False, negatives)
        found, used = search(table, needs, centers, radii)
        if found is not None:
            told = pa.table({"need": pa.array(np.arange(len(of)), pa.int32()), "anchor_id": block["id"][of], "positive_id": positive, "positive_score": score})
            facts = spark.createDataFrame(told)
            out = found.join(F.broadcast(facts), "need").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out.write.mode("append").parquet(result)
        removed(spark, *used)
    spark.createDataFrame([], RESULT).write.mode("append").parquet(result)
    removed(spark, at)
    return spark.read.schema(RESULT).parquet(result)


def op11_hardnegatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, label = F.col("vec_id"), F.col("label")
    given = F.when(id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), id % 100 == 0, "vec_id", "embedding", given)


_SQL = f"""
WITH whole AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS (SELECT row, vec_id, label, list_resize(v, (SELECT max(len(v)) FROM whole), 0) AS v FROM whole),
scores AS MATERIALIZED (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
 FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.row <> b.row),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES}),
found AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.id) AS rank
 FROM positives p JOIN scores n ON p.anchor = n.anchor AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= {NEGATIVES}"""

QUERIES = {"op11_hardnegatives": op11_hardnegatives}
ORACLE = {"op11_hardnegatives": _SQL}
