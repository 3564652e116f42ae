"""SimHash near-duplicates by multi-index hashing.

Fingerprints: the JVM hashes a text's word shingles; an Arrow function takes the
majority of each bit. Rows with equal fingerprints are one class, and only classes
are linked: the 64 bits are two segments, and of two fingerprints at 3 or fewer
bits one segment differs in at most one. Each class looks up, for both segments,
its value and the values with one more bit set (of two segments that differ in
one bit, one has it unset), and the matches are verified over all 64 bits.
Components of the links carry the smallest id of their members.

Defined cases: a null or empty text has fingerprint zero, which links like any
other; fewer words than a shingle are one shingle; a null id never becomes a
component's id unless all are null; repeated rows get equal results; extra
columns pass through ``kept``; an empty table stays empty.

``kept`` drops near copies of whole texts and asks for more than equal bits: it takes
``SEEDS`` fingerprints of 5-word shingles, looks up the same balls in all their
segments, verifies the complete distance and then the shingles' similarity. That
links most copies cheaply; an exact prefix-filter join on the shingles then compares
what may still be a copy and is not linked yet, so no pair is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import ascii_lower, checked, cut, documents, dropped, fresh, held_at, words_of, written
from lociweave.llm.components import components

SHINGLE = 3
BITS = 3
_HALF = (1 << 32) - 1


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the number whose bits are set in over half of them; 0 for an empty run.

    A table spreads the 8 bits of a byte over the 8 bytes of one number; up to 255
    of those are summed without a carry.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full].astype(np.int64)
    starts = np.cumsum(n) - n
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    byte = np.arange(256, dtype=np.uint64)
    spread = sum(((byte >> np.uint64(j)) & np.uint64(1)) << np.uint64(8 * j) for j in range(8))
    octets = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(spread[octets[:, k]], cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for j in range(8):
            out[full] |= (2 * sums[:, j] > n).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each shingle, repeats included; of all words if they are fewer; none of none."""

    def hashed(w: Column, i: Column) -> Column:
        parts = [w]
        for k in range(1, size):
            parts += [F.lit(" "), F.get(words, i + k)]
        return F.xxhash64(F.concat(*parts))

    many = F.slice(F.transform(words, hashed), F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))
    few = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= size, many).otherwise(few)


def _majority_of(hashes: Column) -> Column:
    @F.arrow_udf("long")
    def bits(lists: pa.Array) -> pa.Array:
        counts = np.diff(np.asarray(lists.offsets))
        return pa.array(majority(np.asarray(lists.flatten()).view(np.uint64), counts).view(np.int64), pa.int64())

    return bits(hashes)


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """``docs`` with the 64-bit fingerprint of ``text`` as a signed number."""
    words, hashes = fresh([*docs.columns, name], "_words", "_hashes")
    held = docs.withColumn(words, words_of(ascii_lower(F.col(text))))
    return held.withColumn(hashes, shingle_hashes(F.col(words), size)).drop(words).withColumn(name, _majority_of(F.col(hashes))).drop(hashes)


def _segment(fp: Column, s: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if s else fp).bitwiseAND(F.lit(_HALF))


def links(classes: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): distinct fingerprints at ``BITS`` or fewer differing bits, each pair once."""
    keyed, probes = [], []
    for s in (0, 1):
        seg = _segment(F.col(fp), s)
        keyed.append(classes.select(F.lit(s).alias("s"), seg.alias("key"), F.col(fp).alias("b")))
        flips = F.transform(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(F.col("_seg"), i) == 0), lambda i: F.col("_seg").bitwiseOR(F.element_at(F.array(*[F.lit(1 << k) for k in range(32)]), i + 1)))
        ball = F.concat(F.array(F.col("_seg")), flips)
        probes.append(classes.select(F.col(fp).alias("a"), seg.alias("_seg")).select(F.lit(s).alias("s"), "a", F.explode(ball).alias("key")))
    table, asked = keyed[0].union(keyed[1]), probes[0].union(probes[1])
    met = asked.join(table, ["s", "key"])
    apart = F.col("a").bitwiseXOR(F.col("b"))
    same = _segment(F.col("a"), 0) == _segment(F.col("b"), 0)
    same_high = _segment(F.col("a"), 1) == _segment(F.col("b"), 1)
    # equal segments meet from both sides; a pair that the low segment finds is not taken again from the high one
    once = F.when(F.col("s") == 0, ~same | (F.col("a") < F.col("b"))).otherwise((~same_high | (F.col("a") < F.col("b"))) & (F.bit_count(_segment(apart, 0)) > 1))
    return met.filter((F.col("a") != F.col("b")) & (F.bit_count(apart) <= BITS) & once).select("a", "b")


def grouped(rows: DataFrame, key: str, fp: str) -> DataFrame:
    """``rows`` with ``component_id``: the smallest ``key`` reachable over links of ``fp``."""
    classes = cut(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least")))
    roots = components(links(classes), "a", "b")
    rooted = cut(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id")))
    known = cut(rooted.join(least, F.col("root") == F.col("of")).select(F.col("fp").alias("_fp"), "component_id"))
    return rows.join(known, F.col(fp) == F.col("_fp"), "left").drop("_fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp, component_id) of every row of ``docs``."""
    held = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    found = grouped(written(fingerprinted(held, "_text", "fp", size).select("_id", "fp"), "fingerprints"), "_id", "fp")
    return found.select(F.col("_id").alias(key), "fp", "component_id")


#: The stage that drops near copies: words of a shingle, Jaccard similarity from which a copy counts, fingerprints of a text.
COPY_SHINGLE = 5
COPY_SHARE = 0.8
SEEDS = 8
#: Of the bits of all fingerprints, the part that may differ before shingles are compared.
APART = 0.22
#: Shingles that this many groups of a sample of every ``SAMPLED``-th have come last in the order of prefixes; which ones do changes the cost only.
COMMON = 2
SAMPLED = 8
MOST_COMMON = 200_000
#: Classes of one block of a shared shingle; every block meets every block.
BLOCK = 256


def _many(hashes: Column) -> Column:
    """Fingerprints under ``SEEDS`` mixings of the shingle hashes."""

    @F.arrow_udf("array<long>")
    def bits(lists: pa.Array) -> pa.Array:
        counts = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten()).view(np.uint64)
        out = np.empty((len(counts), SEEDS), dtype=np.uint64)
        for s in range(SEEDS):
            h = flat + np.uint64(0x9E3779B97F4A7C15 * (s + 1) & ((1 << 64) - 1))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, s] = majority(h ^ (h >> np.uint64(31)), counts)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, SEEDS, dtype=np.int32)), pa.array(out.view(np.int64).ravel()))

    return bits(hashes)


def _meetings(classes: DataFrame) -> DataFrame:
    """(a, b): each class with one class of every bucket of its balls, apart in at most ``APART`` of all bits; classes by their hashes.

    A bucket is a segment of a fingerprint and its value. Only one class, by a hash
    that differs between buckets, stands for a bucket, so a group of copies gives as
    many rows as it has members and not their pairs.
    """
    segs = F.flatten(F.transform("fps", lambda x: F.array(_segment(x, 0), _segment(x, 1))))
    keyed = classes.select(F.xxhash64("c").alias("k"), "fps", F.posexplode(segs).alias("s", "seg"))
    table = keyed.groupBy("s", F.col("seg").alias("key")).agg(F.min_by(F.struct(F.col("k").alias("b"), F.col("fps").alias("_fps")), F.xxhash64("k", "s")).alias("_b"))
    table, path = held_at(table.select(F.col("s").alias("_s"), F.col("key").alias("_key"), "_b.b", "_b._fps"), "buckets")
    ones = F.array(*[F.lit(1 << k) for k in range(32)])
    flips = F.transform(F.filter(ones, lambda o: F.col("seg").bitwiseAND(o) == 0), lambda o: F.col("seg").bitwiseOR(o))
    asked = keyed.select("s", F.col("k").alias("a"), F.explode(F.concat(F.array("seg"), flips)).alias("key"))
    met = asked.join(table, (F.col("s") == F.col("_s")) & (F.col("key") == F.col("_key"))).filter("a != b").select("a", "b", "_fps").dropDuplicates(["a", "b"])
    mine = classes.select(F.xxhash64("c").alias("_c"), "fps")
    far = F.aggregate(F.zip_with("fps", "_fps", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    out = written(met.join(mine, F.col("a") == F.col("_c")).filter(far <= int(APART * 64 * SEEDS)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "meetings")
    dropped(classes.sparkSession, path)
    return out


def _common(docs: DataFrame, groups: DataFrame, key: str, text: str) -> np.ndarray:
    """Shingles that are common in a sample of the groups (c, least, root), one text of each, without their top bit, sorted.

    The sample grows with the groups, so a shingle that is not common is in about as many of
    them at every size of corpus; copies of one group count once.
    """
    sampled = lambda c: F.pmod(F.xxhash64(c), F.lit(SAMPLED)) == 0
    ones = written(groups.filter((F.col("c") == F.col("root")) & sampled("c")).select(F.xxhash64("c").alias("_k"), F.col("least").alias("_least")), "sampled")
    words = docs.select(F.col(key).alias("_id"), words_of(ascii_lower(F.col(text))).alias("_w")).withColumn("_c", F.md5(F.array_join("_w", " "))).filter(sampled("_c"))
    some = words.join(checked(ones), F.col("_id").eqNullSafe(F.col("_least")) & (F.xxhash64("_c") == F.col("_k")))
    shingles = some.select(F.explode(F.array_distinct(shingle_hashes(F.col("_w"), COPY_SHINGLE))).alias("h"))
    found = shingles.groupBy("h").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON).toPandas()["h"]
    return np.unique(found.to_numpy(dtype=np.int64) & np.int64((1 << 63) - 1))


def _spare(n):
    """Shingles of a prefix beyond the fifth that may differ: so many of it are shared with any copy."""
    return n // 20 + 1


def _prefix(hashes: Column, common) -> Column:
    """The number of a text's distinct shingles, then the first fifth of them and ``_spare`` more, common ones last.

    In any order of all shingles, the first k shared ones of two sets of a Jaccard similarity of
    ``COPY_SHARE`` or more are among the first n / 5 + k of each, as at most a fifth of n
    shingles is not shared. So the two prefixes share the lesser ``_spare`` of them.
    """

    @F.arrow_udf("array<long>")
    def firsts(lists: pa.Array) -> pa.Array:
        offsets = np.asarray(lists.offsets).astype(np.int64)
        low = np.asarray(lists.flatten()) & np.int64((1 << 63) - 1)
        last = np.frombuffer(common.value, dtype=np.int64)
        if len(last) and len(low):
            low = np.where(last[np.minimum(np.searchsorted(last, low), len(last) - 1)] == low, low | np.int64(-1 << 63), low)
        low, out = low.view(np.uint64), []
        for k in range(len(lists)):
            held = np.unique(low[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]])
            out += [np.array([len(held)], dtype=np.uint64), held[: len(held) // 5 + _spare(len(held))]]
        sizes = np.array([len(x) for x in out], dtype=np.int64).reshape(-1, 2).sum(axis=1)
        flat = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int64)))

    return firsts(hashes)


def _prefixes(docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """(c, root, n, at, t): of each class of ``groups`` (c, least, root), by hashes, the shingles t at the places ``at`` of its prefix; it has n shingles in all."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, groups, key, text).tobytes())
    words = docs.select(words_of(ascii_lower(F.col(text))).alias("_w"))
    rows = words.select(F.md5(F.array_join("_w", " ")).alias("_c"), _prefix(shingle_hashes(F.col("_w"), COPY_SHINGLE), common).alias("firsts"))
    each = rows.groupBy("_c").agg(F.first("firsts").alias("firsts")).join(groups.select("c", "root"), F.col("_c") == F.col("c"))
    each = written(each.select(F.xxhash64("c").alias("c"), F.xxhash64("root").alias("root"), "firsts"), "prefixes")
    places = F.posexplode(F.slice("firsts", F.lit(2), F.size("firsts") - 1)).alias("at", "t")
    return each.select("c", "root", F.get("firsts", F.lit(0)).cast("int").alias("n"), places)


def _opened(tokens: DataFrame) -> tuple[DataFrame, str]:
    """(c, root, n, ats, ts, fs, gone), and where it is: the open shingles of the prefix of each class that may have a partner.

    ``tokens`` is that of ``_prefixes``, or a part of it that holds all open shingles. A shingle
    whose classes all have one root is closed, and links nothing. Partners have four fifths of
    a class's n shingles at least, so the first n / 25 + 1 shared ones are in both prefixes and
    open. What is closed and stands before as many open ones is shared with no partner: ``gone``
    of the n are not, and a class with more than a fifth gone has no partner.
    """
    count = tokens.groupBy(F.col("t").alias("_t")).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("f")).filter("_lo != _hi").select("_t", "f")
    open_, path = held_at(count, "open")
    rows = tokens.join(checked(open_), F.col("t") == F.col("_t")).drop("_t")
    held = rows.groupBy("c", "root", "n").agg(F.array_sort(F.collect_list(F.struct("at", "t", "f"))).alias("o"))
    most = F.floor(F.col("n") / 25).cast("int")
    held = held.filter(F.size("o") > most).withColumn("gone", F.get("o.at", most) - most).filter(F.lit(5) * (F.col("n") - F.col("gone")) >= F.lit(4) * F.col("n"))
    out = held_at(held.select("c", "root", "n", F.col("o.at").alias("ats"), F.col("o.t").alias("ts"), F.col("o.f").alias("fs"), "gone"), "opened")
    dropped(tokens.sparkSession, path)
    return out


def _rare(part: float) -> Column:
    """Of the open shingles of ``_opened`` among the first ``part`` of all n and n / 25 + 1 more, all but the n / 25 that most classes have."""
    most = F.floor(F.col("n") / 25).cast("int")
    first = F.filter(F.arrays_zip("fs", "ts", "ats"), lambda x: x["ats"] <= F.floor(F.col("n") / part) + most)
    order = F.array_sort(F.transform(first, lambda x: F.struct(x["fs"].alias("f"), x["ts"].alias("t"))))
    return F.slice(order, F.lit(1), F.greatest(F.size(order) - most, F.lit(0)))["t"]


def _fit(a: str, b: str) -> Column:
    """Whether two classes' sizes, and what is gone of each, allow a similarity of ``COPY_SHARE``."""
    left = F.lit(9) * F.least(F.col(f"n_{a}") - F.col(f"gone_{a}"), F.col(f"n_{b}") - F.col(f"gone_{b}"))
    return (F.col(f"root_{a}") != F.col(f"root_{b}")) & (left >= F.lit(4) * (F.col(f"n_{a}") + F.col(f"n_{b}")))


def _side(x: str) -> list[Column]:
    return [F.col(k).alias(f"{k}_{x}") for k in ("c", "root", "n", "gone")]


def _central(held: DataFrame) -> DataFrame:
    """(a, b): of the classes of ``_opened``, each with that one of each of its shingles of which least is gone, where both may be copies.

    As many rows as shingles at most. The text that a large group's members were made from
    has the least gone; members that met it in no bucket find it here.
    """
    tokens = lambda of, x: held.select(F.explode(of).alias(f"t_{x}"), *_side(x))
    best = tokens(F.col("ts"), "b").groupBy("t_b").agg(F.min(F.struct("gone_b", "c_b", "root_b", "n_b")).alias("_b"))
    best, path = held_at(best.select("t_b", "_b.*"), "central")
    met = tokens(_rare(5), "a").join(best, F.col("t_a") == F.col("t_b")).filter(_fit("a", "b"))
    out = written(met.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct(), "nearest")
    dropped(held.sparkSession, path)
    return out


def _unlinked(tokens: DataFrame) -> DataFrame:
    """(a, b): of classes with different roots, all pairs whose prefixes, sizes and places allow a similarity of ``COPY_SHARE``.

    ``tokens`` is as in ``_opened``. Of two partners the smaller one has at most a ninth of its
    shingles alone and the larger one a fifth, so the first n / 25 + 1 shared ones (n of the
    smaller) are among as many more than a ninth of the smaller one's; in any order of
    these, the last n / 25 need not meet, and most common ones are spared. The larger one's
    are all met. The classes of a shingle are dealt into blocks, and each two blocks meet in
    a group of their own; the pairs found are then counted on all open shingles of both.
    """
    spark = tokens.sparkSession
    held, held_path = _opened(tokens)
    larger = F.filter(F.arrays_zip("ts", "ats"), lambda x: x["ats"] <= F.floor(F.col("n") / 5) + F.floor(F.col("n") / 25))["ts"]
    kept, kept_path = held_at(held.select("c", "root", "n", "gone", F.lit(True).alias("small"), F.explode(_rare(9)).alias("t")).union(held.select("c", "root", "n", "gone", F.lit(False), F.explode(larger))), "tokens")
    still = kept.groupBy(F.col("t").alias("_t")).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.max("small").alias("_small"), F.count(F.when(~F.col("small"), 1)).alias("f"))
    still, path = held_at(still.filter("_lo != _hi and _small").select("_t", F.ceil(F.col("f") / BLOCK).cast("int").alias("blocks")), "still")
    kept = kept.join(checked(still), F.col("t") == F.col("_t")).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    every = F.explode(F.expr("sequence(0, blocks - 1)"))
    left = kept.filter("small").select("t", F.col("own").alias("i"), every.alias("j"), *_side("a"))
    right = kept.filter("not small").select("t", every.alias("i"), F.col("own").alias("j"), *_side("b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("c_a") < F.col("c_b")))
    met = left.join(right, ["t", "i", "j"]).filter(smaller & _fit("a", "b"))
    pairs = written(met.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct(), "met")
    dropped(spark, path, kept_path)
    whole = lambda x: held.select(F.col("c").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in ("n", "ts", "ats")])
    both = pairs.join(whole("a"), "a").join(whole("b"), "b").withColumn("shared", F.array_intersect("ts_a", "ts_b"))
    # prefixes stand in one order, so the first shared shingle is the first one on both sides
    at = lambda x: F.get(f"ats_{x}", (F.array_position(f"ts_{x}", F.get("shared", F.lit(0))) - 1).cast("int"))
    spare = lambda n: F.floor(F.col(n) / 20) + 1
    # of what is from the first shared shingle on, enough must be left
    fits = F.lit(9) * F.least(F.col("n_a") - at("a"), F.col("n_b") - at("b")) >= F.lit(4) * (F.col("n_a") + F.col("n_b"))
    out = written(both.filter((F.size("shared") >= F.least(spare("n_a"), spare("n_b"))) & fits).select("a", "b"), "unlinked")
    dropped(spark, held_path)
    return out


def _rerooted(held: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The shingles of ``_opened`` as ``_unlinked`` takes them, with the roots that ``groups`` (c, least, root) have after links ``pairs`` (a, b) between classes."""
    root = lambda x: groups.select(F.col("c").alias(x), F.xxhash64("root").alias(f"root_{x}"))
    moved = written(components(pairs.join(root("a"), "a").join(root("b"), "b"), "root_a", "root_b"), "moved")
    now = held.join(checked(moved.withColumnRenamed("root", "_to")), F.col("root") == F.col("node"), "left").withColumn("_now", F.coalesce("_to", "root"))
    return now.select("c", F.col("_now").alias("root"), "n", F.explode(F.arrays_zip("ats", "ts")).alias("_o")).select("c", "root", "n", F.col("_o.ats").alias("at"), F.col("_o.ts").alias("t"))


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """Those of ``pairs`` whose shingles have a Jaccard similarity of ``COPY_SHARE`` or more."""
    asked = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = written(classes.join(asked, "c", "left_semi").select("c", F.col("least").alias("_least")), "wanted")
    texts = docs.join(checked(wanted), F.col(key).eqNullSafe(F.col("_least"))).select("c", words_of(ascii_lower(F.col(text))).alias("_w"))
    sets = texts.filter(F.md5(F.array_join("_w", " ")) == F.col("c")).select("c", F.array_distinct(shingle_hashes(F.col("_w"), COPY_SHINGLE)).alias("h"))
    sets, path = held_at(sets.groupBy("c").agg(F.first("h").alias("h")), "sets")
    both = pairs.join(sets.withColumnRenamed("h", "ha"), F.col("a") == F.col("c")).drop("c").join(sets.withColumnRenamed("h", "hb"), F.col("b") == F.col("c"))
    shared = F.size(F.array_intersect("ha", "hb"))
    out = written(both.filter(shared >= COPY_SHARE * (F.size("ha") + F.size("hb") - shared)).select("a", "b"), "linked")
    dropped(docs.sparkSession, path)
    return out


def _named(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) by class for (a, b) by the classes' hashes; classes of one hash are all named, and told apart where they are compared."""
    name = lambda x: classes.select(F.xxhash64("c").alias(x), F.col("c").alias(f"_{x}"))
    return written(pairs.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), "named")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _c, _stay): every row's key, the class of its words, and the smallest key of its group of near copies.

    Texts with equal words are a class. Classes are compared by their sets of
    ``COPY_SHINGLE``-word shingles and linked from a Jaccard similarity of ``COPY_SHARE`` on;
    a group is what links reach. Those that meet in a bucket are compared first, then each
    with the most central one of its shingles, then all others that share enough shingles of
    their prefixes and are in different groups still.
    Tables that are read to the end are dropped on the way.
    """
    docs, key, text = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_id", "_text"
    spark = docs.sparkSession
    words = docs.select(F.col(key).alias("_id"), words_of(ascii_lower(F.col(text))).alias("_w"))
    rows = words.select("_id", F.md5(F.array_join("_w", " ")).alias("_c"), shingle_hashes(F.col("_w"), COPY_SHINGLE).alias("_h"))
    rows, path = held_at(rows.withColumn("fps", _many(F.col("_h"))).drop("_h"), "classed")
    classes = written(rows.groupBy(F.col("_c").alias("c")).agg(F.min("_id").alias("least"), F.first("fps").alias("fps")), "classes")
    ids = written(rows.select("_id", "_c"), "ids")
    dropped(spark, path)
    linked = _linked(docs, classes, _named(_meetings(classes), classes), key, text)
    roots = components(linked, "a", "b")
    groups = written(classes.select("c", "least").join(roots, F.col("c") == F.col("node"), "left").select("c", "least", F.coalesce("root", "c").alias("root")), "groups")
    held, path = _opened(_prefixes(docs, groups, key, text))
    near = _linked(docs, classes, _named(_central(held), classes), key, text)
    more = _linked(docs, classes, _named(_unlinked(_rerooted(held, near, groups)), classes), key, text)
    dropped(spark, path)
    roots = components(linked.union(near).union(more), "a", "b")
    rooted = written(classes.select("c", "least").join(roots, F.col("c") == F.col("node"), "left").select("c", "least", F.coalesce("root", "c").alias("root")), "rooted")
    least = written(rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("_stay")), "least")
    known = written(rooted.join(least, F.col("root") == F.col("of")).select(F.col("c").alias("_of"), "_stay"), "known")
    return ids.join(known, F.col("_c") == F.col("_of")).select("_id", "_c", "_stay")


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: the one with the smallest key of each group stays.

    Rows with a null key stay. Of rows that share key and words one stays.
    """
    found = written(copies(docs, key, text), "copies")
    gone = written(found.filter((F.col("_id") != F.col("_stay")) & F.col("_stay").isNotNull()).select(F.col("_id").alias("_gone"), F.col("_c").alias("_words")).distinct(), "gone")
    named = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.md5(F.array_join(words_of(ascii_lower(F.col(text))), " ")).alias("_words_of"))
    left = named.join(checked(gone), (F.col("_key") == F.col("_gone")) & (F.col("_words_of") == F.col("_words")), "left_anti")
    twice = found.filter("_id is not null").groupBy("_id", "_c").count().filter("count > 1").limit(1).count()
    if twice:
        left = left.filter("_key is not null").dropDuplicates(["_key", "_words_of"]).unionByName(left.filter("_key is null"))
    return left.select("_row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE: dict[str, str] = {}
