"""Token-id output compressed by Re-Pair, with random access.

Documents are encoded in ascending order of their id and cut into blocks of about
``BLOCK_IDS`` ids at document ends. Within a block, pairs of neighbours are replaced
by nonterminals, the more frequent one where two overlap, again and again, until no
pair is left whose rule would take less room than it saves. No pair includes the end
id (nor an equal id in a text), so a document's codes stand by themselves.

File format: a Parquet table, one row a block.

* ``part``, ``block``: their order is the order of the ids; ``first``: ids of the
  same part before the block; ``n_ids``: ids in it.
* ``keys``, ``id_counts``, ``code_counts``: for each document its key, ids and codes.
* ``rules``: for nonterminal ``BASE + i`` its left and right code, little-endian
  unsigned 32-bit; ``lengths``: how many ids it expands to, likewise.
* ``low``, ``high``: the codes' lower 16 bits and the rest, little-endian unsigned
  16-bit and 8-bit.

With the lengths the codes that hold any range of ids are found without expanding
the others (``ids_at``).

Defined cases: a null or empty text is the end id alone; rows that share an id
come in the order of their texts' hash, equal rows in any order; a null id comes
first; an empty table makes no blocks; extra columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.llm.common import documents, scratch, tokenizer_path

END = 2
BLOCK_IDS = 1 << 19
#: Nonterminals start here, above the ids of the tokenizer.
BASE = 1 << 16
#: Bytes of a rule with its length, and of a code: a rule must replace more than their quotient.
RULE_BYTES, CODE_BYTES = 12, 3
#: Codes of the format, 24 bits; only one text of some 80 million ids or more could ask for more.
MOST_CODES = 1 << 24
LEAST_COUNT = RULE_BYTES // CODE_BYTES + 1


def _by_pair(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the pairs, whether a pair differs from the one before in it)."""
    n = len(left)
    at_bits = max(1, int(n - 1).bit_length())
    bits = max(1, int(max(left.max(), right.max())).bit_length())
    pairs = (left.astype(np.uint64) << np.uint64(bits)) | right.astype(np.uint64)
    if 2 * bits + at_bits <= 64:
        # places ride along in the low bits, which is faster than sorting them by a key
        pairs = np.sort((pairs << np.uint64(at_bits)) | np.arange(n, dtype=np.uint64))
        order = (pairs & np.uint64((1 << at_bits) - 1)).astype(np.int64)
        pairs >>= np.uint64(at_bits)
    else:
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
    return order, np.concatenate([[True], pairs[1:] != pairs[:-1]])


def _chosen(group: np.ndarray, counts: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in order with their ``group`` and the groups' ``counts``: (pairs whose group, without overlaps with itself, is frequent enough; pairs to replace).

    ``joined`` says whether a pair overlaps the one before it. A pair is replaced where its
    group has more occurrences than the groups of the pairs that overlap it. Of a run
    of overlapping equal pairs every other one counts.
    """
    again = np.flatnonzero(joined[1:] & (group[1:] == group[:-1])) + 1
    starts = np.concatenate([[True], np.diff(again) > 1]) if len(again) else np.zeros(0, dtype=bool)
    first = (again[starts] - 1)[np.cumsum(starts) - 1]
    odd = again[(again - first) % 2 == 1]
    counts = counts - np.bincount(group[odd], minlength=len(counts))
    # frequent groups in order, the others nothing; equally frequent ones are told apart by their number
    worth = np.flatnonzero(counts >= LEAST_COUNT)
    rank = np.zeros(len(counts), dtype=np.int32)
    rank[worth[np.argsort(counts[worth], kind="stable")]] = np.arange(1, len(worth) + 1)
    strength = rank[group]
    left, right = np.zeros_like(strength), np.zeros_like(strength)
    np.multiply(strength[:-1], joined[1:], out=left[1:])
    np.multiply(strength[1:], joined[1:], out=right[:-1])
    if len(again):
        # all of a run have the neighbours of the run
        left[again] = left[first]
        last = again[np.append(starts[1:], True)]
        right[again] = right[last][np.cumsum(starts) - 1]
        right[first[starts]] = right[last]
    on = (strength > left) & (strength > right)
    on[odd] = False
    return strength > 0, np.flatnonzero(on)


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, rules, lengths) of a block of ids.

    A pair that is too rare stays so, as counts of old pairs only fall: a round looks at
    pairs that were frequent enough and at those with a nonterminal of the last round.
    """
    codes, n = ids.astype(np.uint32), len(ids)
    rules, sizes = [np.zeros((0, 2), dtype=np.uint32)], np.ones(0, dtype=np.uint32)
    # the neighbours of each place that is left; a replaced pair leaves its first place
    after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, dtype=bool)
    at = np.flatnonzero((codes[:-1] != END) & (codes[1:] != END))
    while len(at):
        next_ = after[at]
        left, right = codes[at], codes[next_]
        order, new = _by_pair(left, right)
        group = np.empty(len(at), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        worth, on = _chosen(group, np.diff(np.append(starts, len(at))), np.append(False, next_[:-1] == at[1:]))
        of = group[on]
        taken = np.bincount(of, minlength=len(starts)) >= LEAST_COUNT
        kept = taken[of]
        hit, of = at[on[kept]], of[kept]
        if not len(hit) or BASE + len(sizes) + int(taken.sum()) > MOST_CODES:
            break
        firsts = order[starts[taken]]
        pair = np.stack([left[firsts], right[firsts]], axis=1)
        codes[hit] = (BASE + len(sizes) + np.cumsum(taken) - 1)[of]
        sizes = np.concatenate([sizes, (_lengths(pair[:, 0], sizes) + _lengths(pair[:, 1], sizes)).astype(np.uint32)])
        rules.append(pair)
        dead = after[hit]
        alive[dead] = False
        after[hit] = after[dead]
        inner = hit[after[hit] < n]
        before[after[inner]] = inner
        still = at[worth]
        live = np.zeros(n, dtype=bool) if 64 * len(at) > n else None
        near = np.concatenate([still[alive[still]], hit, before[hit[before[hit] >= 0]]])
        if live is None:
            at = np.unique(near)
        else:
            live[near] = True
            at = np.flatnonzero(live)
        at = at[after[at] < n]
        at = at[(codes[at] != END) & (codes[after[at]] != END)]
    return codes[alive], np.concatenate(rules), sizes


def _lengths(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many ids each code stands for."""
    n = np.ones(len(codes), dtype=np.int64)
    rule = codes >= BASE
    n[rule] = lengths[codes[rule].astype(np.int64) - BASE]
    return n


def expand(codes: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that ``codes`` stand for: each code goes to its place, a rule's parts to theirs."""
    n = _lengths(codes, lengths)
    ends = np.cumsum(n)
    out, at = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32), ends - n
    while len(codes):
        plain = codes < BASE
        out[at[plain]] = codes[plain]
        at, pair = at[~plain], rules[codes[~plain].astype(np.int64) - BASE]
        left, right = pair[:, 0], pair[:, 1]
        at, codes = np.concatenate([at, at + _lengths(left, lengths)]), np.concatenate([left, right])
    return out


def ids_at(codes: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block, expanding only the codes that hold them."""
    n = _lengths(codes, lengths)
    ends = np.cumsum(n)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    skip = start - (ends[a] - n[a] if a < len(ends) else start)
    return expand(codes[a:b], rules, lengths)[skip : skip + stop - start]


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, rules, lengths) of a row of the file."""
    codes = np.frombuffer(row["low"], dtype="<u2").astype(np.uint32) | (np.frombuffer(row["high"], dtype="u1").astype(np.uint32) << np.uint32(16))
    return codes, np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2), np.frombuffer(row["lengths"], dtype="<u4")


def _schema(key: T.DataType) -> T.StructType:
    f = T.StructField
    return T.StructType(
        [f("part", T.IntegerType()), f("block", T.IntegerType()), f("first", T.LongType()), f("n_ids", T.LongType()), f("keys", T.ArrayType(key)), f("id_counts", T.ArrayType(T.LongType())), f("code_counts", T.ArrayType(T.LongType()))]
        + [f(n, T.BinaryType()) for n in ("rules", "lengths", "low", "high")]
    )


def _blocks(rows: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
    """Blocks from (keys, ids, ids per document), in order."""
    keys, ids, counts, held, first, block = [], [], [], 0, 0, 0

    def made() -> pa.RecordBatch:
        flat, n = np.concatenate(ids), np.concatenate(counts)
        codes, rules, lengths = compress(flat)
        # the end id is in no pair, so a document's end is the end of a code
        each = np.diff(np.concatenate([[0], np.searchsorted(np.cumsum(_lengths(codes, lengths)), np.cumsum(n)) + 1]))
        one = lambda v, t=None: pa.array([v], t)
        names = pa.concat_arrays(keys)
        return pa.RecordBatch.from_arrays(
            [
                one(part, pa.int32()), one(block, pa.int32()), one(first, pa.int64()), one(len(flat), pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), one(n.tolist(), pa.list_(pa.int64())), one(each.tolist(), pa.list_(pa.int64())),
                one(rules.astype("<u4").tobytes(), pa.binary()), one(lengths.astype("<u4").tobytes(), pa.binary()), one((codes & 0xFFFF).astype("<u2").tobytes(), pa.binary()), one((codes >> 16).astype("u1").tobytes(), pa.binary()),
            ],
            names=["part", "block", "first", "n_ids", "keys", "id_counts", "code_counts", "rules", "lengths", "low", "high"],
        )

    for names, flat, n in rows:
        ends, at, done = np.cumsum(n), 0, 0
        while at < len(n):
            # documents that fill the block, one at least
            to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_IDS - held, side="right")))
            if held and done + BLOCK_IDS - held < ends[at]:
                to = at
            if to > at:
                keys.append(names.slice(at, to - at))
                ids.append(flat[done : ends[to - 1]])
                counts.append(n[at:to])
                held += int(ends[to - 1]) - done
                at, done = to, int(ends[to - 1])
            if at < len(n) or held >= BLOCK_IDS:
                yield made()
                first, block = first + held, block + 1
                keys, ids, counts, held = [], [], [], 0
    if held:
        yield made()


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``text`` in ascending order of ``key`` and write the blocks to ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from lociweave.llm.subwords import token_ids

        def rows():
            for batch in batches:
                ids, n = token_ids(batch.column(1), tokenizer)
                out = np.full(len(ids) + len(n), END, dtype=np.uint32)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                yield batch.column(0), out, n + 1

        yield from _blocks(rows(), TaskContext.get().partitionId())

    order = [F.col(key).asc_nulls_first(), F.col("_tie").asc_nulls_first()]
    ordered = docs.select(key, text, F.xxhash64(text).alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order).select(key, text)
    ordered.mapInArrow(encode, _schema(docs.schema[key].dataType)).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, key: T.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files at ``path``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names) if n != "keys"}
                ids = expand(*unpack(row)).astype("<u4")
                n = np.array(row["id_counts"], dtype=np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), n.tolist(), strict=True)]
                lists = batch.column("keys")
                keys = lists.flatten().slice(lists.offsets[i].as_py() - lists.offsets[0].as_py(), len(n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), row["part"], dtype=np.int32)), keys, pa.array(row["first"] + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "doc_id", "in_part", "n_tokens", "ids_crc32"]
                )

    f = T.StructField
    schema = T.StructType([f("part", T.IntegerType()), f("doc_id", key), f("in_part", T.LongType()), f("n_tokens", T.LongType()), f("ids_crc32", T.LongType())])
    files = spark.read.schema(_schema(key)).parquet(path)
    # one row a part, not a block or document
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = files.mapInArrow(decode, schema).join(before, "part")
    return rows.select("doc_id", (F.col("before") + F.col("in_part")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def op9_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir).select("doc_id", "text"), scratch(spark, "ids")
    write(docs, path, tokenizer_path("word_bpe_49k.json"))
    return read(spark, path, docs.schema["doc_id"].dataType)


QUERIES = {"op9_repair": op9_repair}
ORACLE: dict[str, str] = {}
