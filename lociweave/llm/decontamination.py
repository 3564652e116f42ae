"""Benchmark decontamination by spaced-seed hashing.

A mask names positions that count; the words at the others may differ. For every mask
and position the words that count are hashed, for the benchmark and for the corpus,
and equal hashes are hits. A hit names a diagonal (place in the document less place in
the item), and the words along it are compared: a document overlaps an item where a
stretch of ``OVERLAP`` words or more, or of four fifths of a shorter item's words, has
at least four fifths of its words equal. Items below ``WHOLE`` words must stand whole.

The masks miss nothing. A stretch of 13 words or more with four fifths equal holds one
of 13 to 25 words (of two halves one has four fifths), and wherever the unequal words
of those stand, one of ``LONG`` fits between them; likewise ``SHORT`` for the
stretches of 7 words or more that an item of ``WHOLE`` to 15 words asks for.

The corpus side is filtered where it is read: a bitmap of the benchmark's hashes,
of at most ``MOST_BITS`` bits whatever the benchmark's size, leaves out windows
that cannot match; below ``MOST_KEYS`` hashes the sorted hashes leave only hits.
Documents with hits, a small part, are written out and joined with the benchmark
by hash, so the benchmark itself is never broadcast by this code.

Defined cases: null and empty texts have no words and never match, nor do items
without a word; equal rows give one result row for an id and item; null ids are an id;
extra columns of the corpus are ignored by ``overlaps`` and pass through ``clean``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.llm.common import ascii_lower, documents, written

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The most words that a mask spans.
SPAN = 12
#: The spaced seeds for items of 16 words or more, and for those from ``WHOLE`` on; 1 counts.
LONG = ("1111011", "110100010011", "110101011", "1110111")
SHORT = ("111011", "11111", "1101011", "1111001")
WHOLE = 8
OVERLAP = 13
MOST_KEYS = 4_000_000
MOST_BITS = 28
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1) | 1 for k in range(SPAN)], dtype=np.uint64)


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each word of a text, in order."""
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mask_keys(hashes: np.ndarray, offsets: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in ``hashes`` of all windows within one text, and the windows' keys under ``mask``."""
    span, n = len(mask), len(hashes)
    if n < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    key = np.full(n - span + 1, number + 1, dtype=np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            key += hashes[k : n - span + 1 + k] * _ODD[k]
            key ^= key >> np.uint64(29)
    ends = np.repeat(offsets[1:], np.diff(offsets)) - offsets[0]
    at = np.flatnonzero(np.arange(n - span + 1) + span <= ends[: n - span + 1])
    return at, key[at] * np.uint64(0xD6E8FEB86659FD93)


#: Masks with the least and most words of the items they are for.
Masks = list[tuple[str, int, int]]


def masks_for(sizes: list[int]) -> Masks:
    """What items of these numbers of words need."""
    out = [(m, 16, 1 << 30) for m in LONG] if any(n >= 16 for n in sizes) else []
    out += [(m, WHOLE, 15) for m in SHORT] if any(WHOLE <= n < 16 for n in sizes) else []
    return out + [("1" * n, n, n) for n in sorted(set(sizes)) if 0 < n < WHOLE]


def _item_keys(items: DataFrame, masks: Masks) -> DataFrame:
    """(item_id, mask, key, at) of every window under the masks that an item's size asks for."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            hashes = np.asarray(lists.flatten()).view(np.uint64)
            sizes = np.diff(offsets)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            first = (offsets - offsets[0])[:-1]
            for number, (mask, least, most) in enumerate(masks):
                at, key = mask_keys(hashes, offsets, mask, number)
                own = (sizes[rows[at]] >= least) & (sizes[rows[at]] <= most)
                at, key = at[own], key[own]
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows[at])), pa.array(np.full(len(at), number), pa.int32()), pa.array(key.view(np.int64)), pa.array((at - first[rows[at]]).astype(np.int32))],
                        names=["item_id", "mask", "key", "at"],
                    )

    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("mask", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType())])
    return items.mapInArrow(keys, schema)


def _filter(keys: DataFrame) -> tuple[int, bytes, bytes]:
    """(bits, bitmap, sorted keys or nothing): bounded, however many keys there are."""
    n = keys.count()
    bits = min(MOST_BITS, max(16, int(n * 512).bit_length()))
    places = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    table = np.zeros(max(1, (1 << bits) >> 6), dtype=np.int64)
    for part in places.toLocalIterator(prefetchPartitions=False):
        table[part["w"]] = part["b"]
    exact = b""
    if n <= MOST_KEYS:
        got = keys.select("key").distinct().toPandas()["key"].to_numpy(dtype=np.int64)
        exact = np.sort(got.view(np.uint64)).tobytes()
    return bits, table.tobytes(), exact


def _hits(docs: DataFrame, masks: Masks, held) -> DataFrame:
    """(_id, _row, words, mask, key, at) of the texts with a window that the filter lets through."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, table, exact = held.value
        table, exact = np.frombuffer(table, dtype=np.uint64), np.frombuffer(exact, dtype=np.uint64)
        for batch in batches:
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            hashes = np.asarray(lists.flatten()).view(np.uint64)
            found = []
            for number, (mask, _, _) in enumerate(masks):
                at, key = mask_keys(hashes, offsets, mask, number)
                p = key >> np.uint64(64 - bits)
                on = np.flatnonzero((table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1))
                at, key = at[on], key[on]
                if len(exact) and len(key):
                    same = exact[np.minimum(np.searchsorted(exact, key), len(exact) - 1)] == key
                    at, key = at[same], key[same]
                found.append((np.full(len(at), number, dtype=np.int32), key, at))
            number, key, at = (np.concatenate([f[k] for f in found]) for k in range(3))
            if not len(at):
                continue
            row = np.searchsorted(offsets[1:] - offsets[0], at, side="right")
            order = np.argsort(row, kind="stable")
            number, key, at, row = number[order], key[order], at[order], row[order]
            rows, counts = np.unique(row, return_counts=True)
            cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            start = (offsets - offsets[0])[row]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), lists.take(take)]
                + [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (number, key.view(np.int64), (at - start).astype(np.int32))],
                names=["_id", "_row", "words", "mask", "key", "at"],
            )

    field = lambda n, t: T.StructField(n, t)
    schema = T.StructType(
        [field("_id", docs.schema["_id"].dataType), field("_row", T.LongType()), field("words", T.ArrayType(T.LongType())), field("mask", T.ArrayType(T.IntegerType())), field("key", T.ArrayType(T.LongType())), field("at", T.ArrayType(T.IntegerType()))]
    )
    return docs.mapInArrow(probe, schema)


def longest_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, size, matches) of the longest stretch with at least four fifths true; the first of equally long ones."""
    n = len(equal)
    if not n:
        return 0, 0, 0
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    # the least sum so far falls, so the first place at or below a later sum is found by halving
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums, side="left")
    sizes = np.arange(n + 1) - first
    end = int(np.argmax(sizes))
    start = int(first[end])
    return start, end - start, int(np.sum(equal[start:end]))


def _longest(doc: Column, item: Column) -> Column:
    """``longest_stretch`` of two equally long word lists as ``whole``, its size, and without its unequal ends."""

    @F.arrow_udf("struct<whole:int,start:int,size:int,matches:int>")
    def found(a: pa.Array, b: pa.Array) -> pa.Array:
        lists = []
        for x in (a, b):
            ends = np.asarray(x.offsets).astype(np.int64)
            lists.append((np.asarray(x.flatten()), ends - ends[0]))
        (va, oa), (vb, ob) = lists
        got = []
        for k in range(len(a)):
            equal = va[oa[k] : oa[k + 1]] == vb[ob[k] : ob[k + 1]]
            start, size, matches = longest_stretch(equal)
            on = np.flatnonzero(equal[start : start + size])
            got.append((size, start + on[0], on[-1] + 1 - on[0], matches) if len(on) else (0, 0, 0, 0))
        cols = np.array(got, dtype=np.int32).reshape(-1, 4)
        return pa.StructArray.from_arrays([pa.array(cols[:, k]) for k in range(4)], names=["whole", "start", "size", "matches"])

    return found(doc, item)


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per id and item whose texts overlap: of the diagonals' longest stretches without their unequal ends the one with the most equal words, where it starts in both, its words and matches."""
    spark = docs.sparkSession
    bench = written(items.select(F.col(item_key).alias("item_id"), word_hashes(F.col(item_text)).alias("item_words")).filter(F.size("item_words") > 0), "items")
    sizes = [r[0] for r in bench.select(F.least(F.size("item_words"), F.lit(16)).alias("n")).distinct().collect()]
    masks = masks_for(sizes)
    keys = written(_item_keys(bench, masks), "item_keys")
    held = spark.sparkContext.broadcast(_filter(keys))
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_row"), word_hashes(F.col(text)).alias("words"))
    found = written(_hits(rows, masks, held), "hits")
    hits = found.select("_id", "_row", F.explode(F.arrays_zip("mask", "key", "at")).alias("h")).select("_id", "_row", F.col("h.mask").alias("mask"), F.col("h.key").alias("key"), F.col("h.at").alias("_at"))
    lines = hits.join(keys, ["mask", "key"]).select("_id", "_row", "item_id", (F.col("_at") - F.col("at")).alias("_line")).distinct()
    lines = written(lines, "lines")
    texts = found.select(F.col("_id").alias("_id2"), F.col("_row").alias("_row2"), "words").dropDuplicates(["_id2", "_row2"])
    both = lines.withColumnRenamed("item_id", "_item").join(bench, F.col("_item").eqNullSafe(F.col("item_id"))).drop("_item")
    both = both.join(written(texts, "texts"), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_row") == F.col("_row2")))
    doc_from, item_from = F.greatest(F.col("_line"), F.lit(0)), F.greatest(-F.col("_line"), F.lit(0))
    size = F.least(F.size("words") - doc_from, F.size("item_words") - item_from)
    run = both.select(
        "_id", "item_id", F.size("item_words").alias("n_item_words"), doc_from.alias("_d"), item_from.alias("_i"), F.slice("words", doc_from + 1, size).alias("_a"), F.slice("item_words", item_from + 1, size).alias("_b")
    )
    n = F.col("n_item_words")
    need = F.when(n < WHOLE, n).otherwise(F.least(F.lit(OVERLAP), F.ceil(n * 4 / 5)))
    good = run.withColumn("_run", _longest(F.col("_a"), F.col("_b"))).filter(F.when(n < WHOLE, F.col("_run.matches")).otherwise(F.col("_run.whole")) >= need)
    best = good.groupBy("_id", "item_id").agg(
        F.max(F.struct(F.col("_run.matches").alias("matched_words"), F.col("_run.size").alias("overlap_words"), (-(F.col("_d") + F.col("_run.start"))).alias("_ds"), (F.col("_i") + F.col("_run.start")).alias("item_start"), "n_item_words")).alias("b")
    )
    return best.select(F.col("_id").alias(key), F.col("item_id").alias(item_key), "b.n_item_words", "b.overlap_words", "b.matched_words", (-F.col("b._ds")).alias("doc_start"), "b.item_start", (F.col("b.matched_words") / F.col("b.overlap_words")).alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id overlaps no item."""
    bad = written(overlaps(docs, items, key, text).select(F.col(key).alias("_bad")).distinct(), "contaminated")
    held = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"))
    return held.join(bad, F.col("_key").eqNullSafe(F.col("_bad")), "left_anti").select("_row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLE: dict[str, str] = {}
