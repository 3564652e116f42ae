"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a hashed order, are cut into blocks of ``BLOCK_ROWS``. Weights are
rounded to whole parts of a period of ``PERIOD`` slots (more for more sources), so a share is
off by less than 1 / ``PERIOD``. With a parts of P, block k of a source is released at
``floor(k P / a)`` and due at ``ceil((k + 1) P / a)``; in every slot the released
block with the earliest deadline runs. Every prefix then holds each source to
within less than one block of its share. The schedule repeats after P slots, so
one period, a table of P entries, is all that the driver computes; a block's slot
follows from it by arithmetic, and the rows are never collected.

No row is dropped: when a source has run out, the period of the remaining ones,
with their weights as they are, goes on from there.

Defined cases: sources without a weight get ``DEFAULT_WEIGHT``; a null source is a
source of its own; repeated rows get different positions; extra columns pass
through, and those called like a result are replaced by it; an empty table stays
empty. Weights must be positive; a weight below half a part counts as one part.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import checked, documents, opened
from lociweave.llm.ranking import insertion, ranked

BLOCK_ROWS = 32
DEFAULT_WEIGHT = 10
#: Slots of a period, unless there are so many sources that they need more: each source has ``ROOM`` slots then.
PERIOD = 10_000
ROOM = 4


def parts(weights: dict) -> dict:
    """Whole parts of a period, by largest remainders and one at least; without a common divisor."""
    total, slots = sum(Fraction(w) for w in weights.values()), max(PERIOD, ROOM * len(weights))
    exact = {s: Fraction(w) * slots / total for s, w in weights.items()}
    whole = {s: max(1, math.floor(x)) for s, x in exact.items()}
    spare = slots - sum(whole.values())
    for s in sorted(exact, key=lambda s: (-(exact[s] - math.floor(exact[s])), str(s)))[: max(0, spare)]:
        whole[s] += 1
    shrink = math.gcd(*whole.values()) if whole else 1
    return {s: w // shrink for s, w in whole.items()}


def period(weights: dict, most: int | None = None) -> list:
    """The source of each slot of one period of ``sum(weights)`` slots (or its first ``most``): EDF over the released blocks."""
    total = sum(weights.values())
    waiting = [(0, str(s), k, s) for k, s in enumerate(sorted(weights, key=str))]
    heapq.heapify(waiting)
    done, ready, out = dict.fromkeys(weights, 0), [], []
    for slot in range(min(total, most or total)):
        while waiting and waiting[0][0] <= slot:
            _, name, k, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), name, k, s))
        _, name, k, s = heapq.heappop(ready)
        out.append(s)
        done[s] += 1
        heapq.heappush(waiting, (done[s] * total // weights[s], name, k, s))
    return out


class Phase(NamedTuple):
    """A run of slots with one set of sources: by source its parts of ``length``, its slots in a period, its first block and how many it runs."""

    at: int
    weights: dict
    places: dict
    first: dict
    ran: dict
    length: int


def phases(blocks: dict, weights: dict) -> list[Phase]:
    """The schedule, up to the last block of the last source."""
    left, at, out = {s: n for s, n in blocks.items() if n}, 0, []
    while left:
        live = {s: weights[s] for s in left}
        shrink = math.gcd(*live.values())
        live = {s: w // shrink for s, w in live.items()}
        length = sum(live.values())
        plan = period(live, sum(left.values()) + len(left))
        places = {s: [] for s in live}
        for i, s in enumerate(plan):
            places[s].append(i)
        # the slot of a source's last block, where the plan reaches it; the phase ends after the first such slot
        ends = [(left[s] - 1) // live[s] * length + places[s][(left[s] - 1) % live[s]] for s in live if (left[s] - 1) % live[s] < len(places[s])]
        slots = min(ends) + 1
        ran = {s: slots // length * live[s] + bisect_left(places[s], slots % length) for s in live}
        out.append(Phase(at, live, places, {s: blocks[s] - left[s] for s in live}, ran, length))
        at += slots
        left = {s: n - ran[s] for s, n in left.items() if n > ran[s]}
    return out


def _tables(spark: SparkSession, runs: list[Phase]) -> tuple[DataFrame, DataFrame]:
    """Phases by source, and slots by phase, source and place in the period; both grow with sources only, by ``PERIOD`` for each phase."""
    rows = [(s, number, p.first[s], p.first[s] + p.ran[s], p.at, w, p.length) for number, p in enumerate(runs) for s, w in p.weights.items() if p.ran[s]]
    slots = [(s, number, k, at) for number, p in enumerate(runs) for s in p.weights for k, at in enumerate(p.places[s][: p.ran[s]])]
    return (
        spark.createDataFrame(rows, "_src string, _phase int, _from long, _to long, _start long, _weight long, _period long"),
        spark.createDataFrame(slots, "_source string, _run int, _k long, _place long"),
    )


def _short(counts: dict, runs: list[Phase], block_rows: int) -> list[tuple[int, int]]:
    """(slot, missing rows) of the last block of each source that is not full, by slot."""
    out = []
    for p in runs:
        for s, w in p.weights.items():
            last = -(-counts[s] // block_rows) - 1
            if counts[s] % block_rows and p.first[s] <= last < p.first[s] + p.ran[s]:
                k = last - p.first[s]
                out.append((p.at + k // w * p.length + p.places[s][k % w], block_rows - counts[s] % block_rows))
    return sorted(out)


def mixed(docs: DataFrame, weights: dict | None = None, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot``, ``mix_share`` and ``mix_position``.

    Release and deadline count from the start of the block's phase. ``mix_position``
    orders all rows, gapless from 0. One row for each source reaches the driver.
    """
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source).cast("string")).count().collect()}
    shares = {s: (weights or {}).get(s, DEFAULT_WEIGHT) for s in counts}
    if any(w <= 0 for w in shares.values()):
        raise ValueError("weights must be positive")
    runs = phases({s: -(-n // block_rows) for s, n in counts.items()}, parts(shares))
    table, slots = (checked(t) for t in _tables(spark, runs))
    rows = docs.select(F.struct("*").alias("_row"), F.col(source).cast("string").alias("_of"), F.xxhash64(key).alias("_hash"), F.col(key).alias("_key"))
    rows = ranked(rows, "_of", "_hash", "_rank", [F.col("_key")], uniform=True)
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / block_rows))
    rows = rows.join(table, F.col("_of").eqNullSafe(F.col("_src")) & (F.col("_block") >= F.col("_from")) & (F.col("_block") < F.col("_to")))
    rows = rows.withColumn("_b", F.col("_block") - F.col("_from"))
    rows = rows.join(slots, F.col("_src").eqNullSafe(F.col("_source")) & (F.col("_phase") == F.col("_run")) & (F.col("_b") % F.col("_weight") == F.col("_k")))
    slot = F.col("_start") + F.floor(F.col("_b") / F.col("_weight")) * F.col("_period") + F.col("_place")
    rows = rows.withColumn("_slot", slot.cast("bigint"))
    gaps = _short(counts, runs, block_rows)
    missing = F.lit(0)
    if gaps:
        # rows missing in all short blocks of earlier slots
        upto = [0, *accumulate(m for _, m in gaps)]
        missing = F.get(F.array(*[F.lit(m) for m in upto]), insertion([s + 1 for s, _ in gaps], F.col("_slot")))
    return opened(
        rows,
        docs.columns,
        {
            "mix_block": F.col("_block"),
            "mix_slot": F.col("_slot"),
            "mix_release": F.floor(F.col("_b") * F.col("_period") / F.col("_weight")).cast("bigint"),
            "mix_deadline": F.ceil((F.col("_b") + 1) * F.col("_period") / F.col("_weight")).cast("bigint"),
            "mix_share": F.col("_weight") / F.col("_period"),
            "mix_position": (F.col("_slot") * block_rows + F.col("_rank") % block_rows - missing).cast("bigint"),
        },
    )


#: Production weights: the first sources are wanted more often; others get the default.
WEIGHTS = {"src0": 40, "src1": 20, "src2": 20, "src3": 15}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir).select("doc_id", "source"), WEIGHTS)
    return out.select("doc_id", "source", "mix_share", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")


QUERIES = {"op3_mixing": op3_mixing}
ORACLE: dict[str, str] = {}
