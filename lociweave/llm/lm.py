"""LM scoring: a causal self-attention model over subword ids, learned from the corpus.

1. Texts are read once, in blocks of about ``BLOCK_BYTES``; a block gives its texts as
   numbers of its distinct words, and these with their counts in training texts.
2. The counts are summed by word, and every distinct word is encoded once. The words
   of each block, their counts and ids, and the block's texts meet in one task of
   bounded size, which makes the base scores, the texts as subword ids and the
   counts of neighbouring ids in training texts.
3. The neighbours' counts of all blocks, summed, make the model's vocabulary and
   tables. Like the words' counts they cover every training text whole.
4. The model learns in one pass over all windows of all training texts, whatever the
   size of the corpus. The pass has ``ROUNDS`` rounds: step 2 gives every training text
   one of them as its turn and writes the turns apart, so a round reads its own texts
   only. All partitions of a round learn from the same weights; the weights are averaged
   by their number of windows, in two levels and by parts of the weight vector, so no
   task holds all copies.
5. All texts go through the model in overlapping windows.

The driver holds the model and its tables, whose sizes are set by ``attention.PLACES``
and the tokenizer, never words or texts.

Defined cases: a null or empty text is its end alone; a null id counts as the
empty string for the split; without training texts the base score is 0 and the
model knows nothing; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.llm import attention
from lociweave.llm.common import documents, dropped, scratch, tokenizer_path

BLOCK_BYTES = 20 << 20
ROUNDS = 6
RATE = 2e-2
PARTS = 4096
#: Left and right of the split, by the checksum of the id.
FOLDS, HELD = 7, 2
#: Neighbours in a block are counted in a square table up to so many cells, else by sorting.
CELLS = 1 << 24
#: The kinds of rows that steps 1 and 2 write.
TEXT, WORD, PAIR = 0, 1, 2


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words per text, code of each word, distinct words)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    coded = lists.flatten().dictionary_encode()
    codes, words = np.asarray(coded.indices), coded.dictionary
    empty = np.flatnonzero(np.asarray(pc.equal(words, "")))
    if len(empty):
        on = codes != empty[0]
        owner, codes = owner[on], codes[on]
    return np.bincount(owner, minlength=len(texts)), codes, words


def _strings(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.large_string()), "")


def _pairs(ids: np.ndarray, before: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(``a * size + b``, count) of all neighbours a, b; ``before`` stands before the first."""
    if not len(ids):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    used = np.flatnonzero(np.bincount(np.append(ids, before), minlength=size))
    if len(used) ** 2 > CELLS:
        return np.unique(np.append(before, ids[:-1]).astype(np.int64) * size + ids, return_counts=True)
    at = np.zeros(size, dtype=np.int64)
    at[used] = np.arange(len(used))
    near = at[ids]
    cells = np.bincount(np.append(at[before], near[:-1]) * len(used) + near, minlength=len(used) ** 2)
    on = np.flatnonzero(cells)
    return used[on // len(used)] * size + used[on % len(used)], cells[on]


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each run of ``counts`` numbers as bytes."""
    offsets = np.append(0, np.cumsum(counts)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``_binary`` packed: all numbers and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    data = column.buffers()[2]
    held = np.frombuffer(data, dtype=kind, offset=int(offsets[0]), count=int(offsets[-1] - offsets[0]) // width) if data is not None and len(offsets) else np.zeros(0, dtype=kind)
    return held, np.diff(offsets) // width


def _id_kind(size: int) -> str:
    return "<u2" if size < 1 << 16 else "<u4"


def _fields(kinds: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


def _rows(k: int, many: int, types: dict[str, pa.DataType], **columns: pa.Array) -> pa.RecordBatch:
    """Rows of one kind; columns that are not given are null."""
    made = [pa.array(np.full(many, k, np.int32)) if n == "kind" else columns[n] if n in columns else pa.nulls(many, t) for n, t in types.items()]
    return pa.RecordBatch.from_arrays(made, names=list(types))


def _split(docs: DataFrame, path: str) -> None:
    """Step 1: texts as ``codes`` (the numbers' low 16 bits) and ``high`` (the rest), and words with their number ``at``."""
    schema = _fields({"kind": T.IntegerType(), "block": T.LongType(), "doc_id": docs.schema["doc_id"].dataType, "held_out": T.BooleanType(), "word": T.StringType(), "at": T.LongType(), "n": T.LongType(), "codes": T.BinaryType(), "high": T.BinaryType()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, filled, parts = TaskContext.get().partitionId(), 0, 0, []

        def close(id_type):
            types = dict(zip(schema.names, [pa.int32(), pa.int64(), id_type, pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True))
            block, texts = part * PARTS + number, pa.concat_arrays([p[0] for p in parts])
            docs_of, held = pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            parts.clear()
            counts, codes, words = _words(texts)
            del texts
            of = lambda n: pa.array(np.full(n, block, np.int64))
            n = np.bincount(codes[np.repeat(~held, counts)], minlength=len(words)).astype(np.int64)
            some = np.flatnonzero(np.bincount(codes, minlength=len(words)))
            for a in range(0, len(some), 50_000):
                at = some[a : a + 50_000]
                yield _rows(WORD, len(at), types, block=of(len(at)), word=words.take(pa.array(at)).cast(pa.string()), at=pa.array(at), n=pa.array(n[at]))
            yield _rows(TEXT, len(held), types, block=of(len(held)), doc_id=docs_of, held_out=pa.array(held), codes=_binary((codes & 0xFFFF).astype("<u2"), counts), high=_binary((codes >> 16).astype("<u2"), counts))

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            texts, held = _strings(batch.column(1)), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            ends = np.cumsum(np.asarray(pc.binary_length(texts)))
            at = 0
            while at < len(texts):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES - filled, side="right")))
                parts.append((texts.slice(at, to - at), batch.column(0).slice(at, to - at), held[at:to]))
                filled += int(ends[to - 1]) - done
                at = to
                if filled >= BLOCK_BYTES:
                    yield from close(id_type)
                    number, filled = number + 1, 0
        if parts:
            yield from close(id_type)

    docs.mapInArrow(read, schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)


def _encoded(words: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """``words`` with ``ids``, the subword ids of each as bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lociweave.llm.subwords import forget, token_ids

        for batch in batches:
            ids, n = token_ids(batch.column(0), tokenizer)
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(ids.astype(_id_kind(size)), n)], names=["word", "c", "ids"])
            forget(tokenizer)

    return words.select("word", "c").mapInArrow(encode, "word string, c long, ids binary")


def _coded(texts: DataFrame, words: DataFrame, path: str, size: int, ends: int, denominator: float) -> None:
    """Step 2, by block: ``base``, ``n_tokens`` and ``n_known`` of each text and its ids, and the counts of neighbours. ``ends`` training texts have an end."""
    kind = texts.schema["doc_id"].dataType
    schema = _fields({"kind": T.IntegerType(), "doc_id": kind, "held_out": T.BooleanType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "base": T.DoubleType(), "ids": T.BinaryType(), "at": T.LongType(), "n": T.LongType(), "turn": T.IntegerType()})

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        types = dict(zip(schema.names, [pa.int32(), left.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()], strict=True))
        if not left.num_rows:
            return pa.Table.from_batches([_rows(TEXT, 0, types)])
        low, n = _numbers(left.column("codes").combine_chunks(), "<u2")
        codes = low.astype(np.int64) | (_numbers(left.column("high").combine_chunks(), "<u2")[0].astype(np.int64) << 16)
        at = np.asarray(right.column("at").combine_chunks())
        pool, sizes = _numbers(right.column("ids").combine_chunks(), _id_kind(size)) if right.num_rows else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))
        row = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=np.int64)
        row[at] = np.arange(len(at))
        codes = row[codes]
        c = np.append(np.asarray(right.column("c").combine_chunks()).astype(np.float64), 0.0)
        # sums of texts from running sums, which are exact for counts and good to twelve digits for a block's logarithms
        stops = np.cumsum(n)
        sums = lambda v: np.diff(np.append(0, np.cumsum(v))[np.append(0, stops)])
        known = sums((c > 0)[codes]) + int(ends > 0)
        base = sums(np.log10(c + 1)[codes]) + np.log10(ends + 1.0) - (n + 1) * denominator
        ids, m = _sequences(codes, n, pool, sizes, size - 1)
        held = np.asarray(left.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), dtype=bool)
        pairs, times = _pairs(ids[np.repeat(~held, m)], size - 1, size)
        turn = _turns(held, left.column("block")[0].as_py())
        named = _rows(TEXT, len(n), types, doc_id=left.column("doc_id").combine_chunks(), held_out=pa.array(held), n_tokens=pa.array((n + 1).astype(np.int64)), n_known=pa.array(known), base=pa.array(base), ids=_binary(ids.astype(_id_kind(size)), m), turn=pa.array(turn))
        del ids, codes, pool
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches([named, _rows(PAIR, len(pairs), types, at=pa.array(pairs.astype(np.int64)), n=pa.array(times.astype(np.int64)), turn=pa.array(np.full(len(pairs), ROUNDS, np.int32)))])

    texts.groupBy("block").cogroup(words.groupBy("of")).applyInArrow(made, schema).write.partitionBy("kind", "turn").option("compression", "zstd").parquet(path)


def _turns(held: np.ndarray, block: int) -> np.ndarray:
    """The round that learns from each text of a block: the training texts take turns, not all blocks from the same one on; held-out texts have ``ROUNDS``."""
    return np.where(held, ROUNDS, (np.cumsum(~held) + block) % ROUNDS).astype(np.int32)


def _sequences(codes: np.ndarray, counts: np.ndarray, pool: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with its end, and how many each has, from the ids and sizes of the words."""
    # the end of a text is one more word
    pool, sizes = np.append(pool.astype(np.uint32), np.uint32(end)), np.append(sizes, 1)
    stops = np.cumsum(counts)
    codes = np.insert(codes, stops, len(sizes) - 1)
    ids = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), pa.array(pool)).take(pa.array(codes)).flatten()
    ends = np.append(0, np.cumsum(sizes[codes]))
    firsts = stops - counts + np.arange(len(counts))
    return np.asarray(ids), ends[firsts + counts + 1] - ends[firsts]


def _counted(pairs: DataFrame, size: int) -> tuple[attention.Vocabulary, attention.Tables, int]:
    """Step 3: the vocabulary, the tables and the number of training ids. The driver gets a row an id, then at most ``PLACES`` squared."""
    found = pairs.groupBy((F.col("at") % size).alias("id")).agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, dtype=np.int64)
    counts[found["id"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    vocabulary = attention.Vocabulary(counts)
    held, side = pairs.sparkSession.sparkContext.broadcast(vocabulary.place), attention.PLACES

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums = held.value.astype(np.int64), None
        for batch in batches:
            at, n = (np.asarray(batch.column(k)) for k in (0, 1))
            cells = np.bincount(place[at // size] * side + place[at % size], weights=n, minlength=side * side)
            sums = cells if sums is None else sums + cells
        if sums is not None:
            on = np.flatnonzero(sums)
            for a in range(0, len(on), 100_000):
                some = on[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some].astype(np.int64))], names=["cell", "n"])

    cells = pairs.select("at", "n").mapInArrow(placed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    square = np.zeros(side * side)
    square[np.asarray(cells["cell"])] = np.asarray(cells["n"])
    return vocabulary, attention.Tables(vocabulary.mass, square.reshape(side, side)), int(counts.sum())


def _round(texts: DataFrame, held, params: attention.Params, size: int, number: int, rate: float) -> attention.Params:
    """One round of learning with the vocabulary and tables in ``held``; as many numbers as the model has reach the driver."""
    given = texts.sparkSession.sparkContext.broadcast(params)
    weights = len(attention.packed(params))
    chunk = 1 << 12

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, tables = held.value
        learner, seen, part = attention.Learner(given.value, tables, rate), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, n = _numbers(batch.column(0), _id_kind(size))
            if not len(ids):
                continue
            stops, rng, a = np.cumsum(n), np.random.default_rng(part * 31 + number), 0
            while a < len(n):
                # some texts at a time: windows take many times the room of ids
                done = int(stops[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(stops, done + (1 << 19), side="right")))
                inputs, targets = attention.windows(vocabulary.place[ids[done : int(stops[b - 1])]], n[a:b])
                mixed = rng.permutation(len(inputs))
                learner.learn(inputs[mixed], targets[mixed])
                seen, a = seen + len(inputs), b
        if seen:
            flat = attention.packed(learner.p).astype(np.float64) * seen
            for k in range(0, weights, chunk):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k // chunk], pa.int32()), pa.array([part % 64], pa.int32()), pa.array([float(seen)]), pa.array([flat[k : k + chunk].tobytes()], pa.binary())], names=["chunk", "lane", "n", "sums"]
                )

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), dtype=np.float64) for v in table.column("sums"))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "lane": table.column("lane").slice(0, 1), "n": pa.array([float(pc.sum(table.column("n")).as_py())]), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, lane int, n double, sums binary"
    sums = texts.select("ids").mapInArrow(learn, schema).groupBy("chunk", "lane").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema).toPandas().sort_values("chunk")
    given.destroy()
    if not len(sums):
        return params
    flat = np.concatenate([np.frombuffer(v, dtype=np.float64) / n for v, n in zip(sums["sums"], sums["n"], strict=True)])
    return attention.unpacked(flat, params) if np.isfinite(flat).all() else params


Model = tuple[attention.Vocabulary, attention.Tables, attention.Params]


def learned(table: DataFrame, size: int) -> Model:
    """Steps 2 and 3 over what step 1 wrote."""
    spark = table.sparkSession
    vocabulary, tables, places = _counted(table.filter(f"kind = {PAIR}").select("at", "n"), size)
    held, params = spark.sparkContext.broadcast((vocabulary, tables)), attention.initial()
    texts = table.filter(f"kind = {TEXT}")
    for number in range(ROUNDS if places else 0):
        params = _round(texts.filter(f"turn = {number}"), held, params, size, number, RATE * (1 - number / ROUNDS))
    held.destroy()
    return vocabulary, tables, params


def scored(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords) of every row, by a model learned here or by ``model``."""
    from lociweave.llm.subwords import tokenizer as load

    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD, F.lit(False))
    path, size = scratch(spark, "lm-words"), load(tokenizer).get_vocab_size() + 1
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    _split(source, path)
    kind = source.schema["doc_id"].dataType
    schema = _fields({"block": T.LongType(), "doc_id": kind, "held_out": T.BooleanType(), "word": T.StringType(), "at": T.LongType(), "n": T.LongType(), "codes": T.BinaryType(), "high": T.BinaryType(), "kind": T.IntegerType()})
    table = spark.read.schema(schema).parquet(path)
    texts, words = table.filter(f"kind = {TEXT}"), table.filter(f"kind = {WORD}").select(F.col("block").alias("of"), "word", "at", "n")
    ends = texts.filter("not held_out").count()
    counted = scratch(spark, "lm-counts")
    _encoded(words.groupBy("word").agg(F.sum("n").alias("c")), tokenizer, size).write.parquet(counted)
    counts = spark.read.schema("word string, c long, ids binary").parquet(counted)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)) + ends, F.count(F.when(F.col("c") > 0, 1)) + int(ends > 0)).first()
    known = words.select("of", "word", "at").join(counts, "word").select("of", "at", "c", "ids")
    split, path = path, scratch(spark, "lm-ids")
    _coded(texts.select("block", "doc_id", "held_out", "codes", "high"), known, path, size, ends, float(np.log10(total + 1 * (distinct + 1))))
    dropped(spark, split, counted)
    schema = _fields({"doc_id": kind, "held_out": T.BooleanType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "base": T.DoubleType(), "ids": T.BinaryType(), "at": T.LongType(), "n": T.LongType(), "kind": T.IntegerType(), "turn": T.IntegerType()})
    table = spark.read.schema(schema).parquet(path)
    held = spark.sparkContext.broadcast(model or learned(table, size))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tables, params = held.value
        reader = attention.Reader(params, tables)
        for batch in batches:
            ids, m = _numbers(batch.column(5), _id_kind(size))
            stops, a = np.cumsum(m), 0
            while a < len(m):
                # some texts at a time: windows take many times the room of ids
                done = int(stops[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(stops, done + (1 << 19), side="right")))
                part = ids[done : int(stops[b - 1])]
                lp = reader.log_probs(vocabulary.place[part], m[a:b]) + vocabulary.extra[part]
                sums = np.add.reduceat(lp, np.cumsum(m[a:b]) - m[a:b]) / attention.LOG10
                own = [batch.column(k).slice(a, b - a) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*own[:4], pa.array(np.full(b - a, int(total), dtype=np.int64)), own[4], pa.array(sums), pa.array(m[a:b].astype(np.int64))], names=out.names)
                a = b

    out = _fields({"doc_id": kind, "held_out": T.BooleanType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType(), "n_subwords": T.LongType()})
    return table.filter(f"kind = {TEXT}").select("doc_id", "held_out", "n_tokens", "n_known", "base", "ids").mapInArrow(score, out)


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op1_lm": op1_lm}
ORACLE: dict[str, str] = {}
