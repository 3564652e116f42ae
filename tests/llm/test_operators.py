"""Each operator against brute force over the small corpus, with its odd cases."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lociweave.llm import attention, components, decontamination, licenses, linededup, lm, mixing, quality, ranking, registry, repair, sharding, simhash, subwords, tokens
from lociweave.llm.common import tokenizer_path
from tests.llm.cases import BENCHMARK, DOCUMENTS, lower, words


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], EMPTY).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(folder / "embeddings.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_row_has_a_result(spark, small, name):
    got = registry.QUERIES[name](spark, small)
    if name.startswith(("op8", "op11", "op12", "op13")):
        return
    assert Counter(r[0] for r in got.select("doc_id").collect()) == Counter(d[0] for d in DOCUMENTS)


def test_lm(spark, small):
    got = lm.op1_lm(spark, small).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    toks = [(d[0], [*words(lower(d[1])), None]) for d in DOCUMENTS]
    c = Counter(w for d, ws in toks if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in toks)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def random_model(seed, size):
    """A model with weights that matter, over ids up to ``size``; its vocabulary has ids without a place."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 9, size)
    vocabulary = attention.Vocabulary(counts)
    pairs = rng.poisson(0.02, (attention.PLACES, attention.PLACES)).astype(float)
    tables = attention.Tables(vocabulary.mass, pairs)
    params = attention.initial(seed)
    params["ug"], params["bg"] = params["ug"] * 40, rng.standard_normal(attention.GROUPS).astype(np.float32)
    return vocabulary, tables, params


def score_by_hand(ids, model):
    """Log10 probability of ids: plain loops over windows, places and earlier places."""
    vocabulary, tables, p = model
    p = {k: v.astype(float) for k, v in p.items()}
    at = [0, *(int(vocabulary.place[i]) for i in ids)]
    total = 0.0
    for t, i in enumerate(ids):
        start = t // attention.STEP * attention.STEP - attention.CONTEXT
        reads = [at[k] if 0 <= k < len(at) else 0 for k in range(start, t + 1)]
        x = [p["emb"][r] + p["pos"][k] for k, r in enumerate(reads)]
        q = x[-1] @ p["wq"] / np.sqrt(attention.DIM)
        weights = [math.exp(float(q @ (v @ p["wk"]))) for v in x]
        c = sum(w * (v @ p["wv"]) for w, v in zip(weights, x, strict=True)) / sum(weights)
        y = x[-1] + c @ p["wo"]
        h = y + np.maximum(y @ p["w1"] + p["b1"], 0) @ p["w2"]
        z = h @ p["ug"] + p["bg"] + tables.prior[at[t]]
        place = int(vocabulary.place[i])
        total += z[tables.group[place]] - math.log(np.exp(z).sum()) + tables.within[at[t], place] + vocabulary.extra[i]
    return total / math.log(10)


def test_lm_score_by_hand(spark, small):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    size = tk.get_vocab_size() + 1
    model = random_model(5, size)
    got = lm.scored(spark.read.parquet(f"{small}/documents.parquet"), path, model=model).collect()
    by = {}
    for d in DOCUMENTS:
        by.setdefault(d[0], []).append(tk.encode(d[1] or "", add_special_tokens=False).ids + [size - 1])
    done = 0
    for r in got:
        if r["n_subwords"] < 400:
            assert any(len(ids) == r["n_subwords"] and r["score"] == pytest.approx(score_by_hand(ids, model), rel=1e-4) for ids in by[r["doc_id"]])
            done += 1
    assert done > 30


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_lm_beats_the_base_on_held_out_texts(spark, size):
    got = lm.op1_lm(spark, f"/root/testdata/{size}").groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert len(got) == 2 and all(r["s"] > r["b"] for r in got)


def test_lm_rounds_read_their_own_texts_and_together_all(spark):
    from lociweave.llm.common import shared_dir

    ids = list(range(100_000, 100_300))
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    texts = spark.createDataFrame([(k, f"some words of text {k} " * (1 + k % 7)) for k in ids], "doc_id long, text string").repartition(3)
    assert lm.scored(texts, tokenizer_path("word_bpe_49k.json")).count() == len(ids)
    made = [n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n not in before and n.startswith("lm-ids")]
    assert len(made) == 1
    folder = f"{shared_dir(spark)}/{made[0]}/kind={lm.TEXT}"
    turns = {t: [r["doc_id"] for r in spark.read.parquet(f"{folder}/turn={t}").select("doc_id").collect()] for t in range(lm.ROUNDS + 1)}
    held = {k for k in ids if zlib.crc32(str(k).encode()) % 7 == 2}
    assert set(turns[lm.ROUNDS]) == held
    learned = [turns[t] for t in range(lm.ROUNDS)]
    assert Counter(k for t in learned for k in t) == Counter(set(ids) - held)
    assert max(map(len, learned)) - min(map(len, learned)) <= 3


def test_lm_gradients_are_slopes():
    """Each gradient against the loss a little to both sides, and texts that end within a window."""
    rng = np.random.default_rng(4)
    _, tables, params = random_model(4, 3000)
    tables.prior = tables.prior.astype(float)
    params = {k: v.astype(float) * (0.1 if k == "ug" else 1) for k, v in params.items()}
    inputs, targets = attention.windows(rng.integers(0, attention.PLACES, 200), np.array([1, 30, 24, 145]))
    assert (targets < 0).any()
    grads = attention.gradients(params, tables, inputs, targets)[1]
    assert set(grads) == set(params)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(abs(g)), g.shape)
        sides = []
        for step in (1e-5, -1e-5):
            moved = params[k].copy()
            moved[at] += step
            sides.append(attention.gradients(params | {k: moved}, tables, inputs, targets)[0])
        assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3)


def test_lm_without_training_texts(spark):
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    got = lm.scored(spark.createDataFrame([(k, "some words") for k in held], "doc_id long, text string"), tokenizer_path("word_bpe_49k.json")).collect()
    assert len(got) == len(held) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in got)


def test_neighbours_are_counted_both_ways(monkeypatch):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50, 3000)
    want = Counter(zip([99, *ids[:-1].tolist()], ids.tolist(), strict=True))
    for cells in (lm.CELLS, 1):
        monkeypatch.setattr(lm, "CELLS", cells)
        pairs, n = lm._pairs(ids, 99, 100)
        assert {(int(p) // 100, int(p) % 100): int(k) for p, k in zip(pairs, n, strict=True)} == want


def test_attention_is_a_causal_distribution():
    vocabulary, tables, p = random_model(0, 4000)
    rng = np.random.default_rng(0)
    reader = attention.Reader(p, tables)
    places, n = rng.integers(0, 300, 200), np.array([1, 60, 139])
    before = reader.log_probs(places, n)
    changed = places.copy()
    changed[150] = 7
    after = reader.log_probs(changed, n)
    assert np.allclose(before[:150], after[:150]) and not np.allclose(before[151:160], after[151:160])
    total = 0.0
    for i in range(4000):
        k = vocabulary.place[i]
        total += np.exp(reader.log_probs(np.array([3, k]), np.array([2]))[1] + vocabulary.extra[i])
    assert total == pytest.approx(1, abs=1e-3)


def test_attention_gradients():
    rng = np.random.default_rng(1)
    _, tables, p = random_model(3, 4000)
    p = {k: v.astype(float) for k, v in p.items()}
    n = np.array([90])
    i, t = attention.windows(rng.integers(0, 200, 90), n)
    _, g = attention.gradients(p, tables, i, t)
    for k in p:
        at, e = np.abs(g[k]).argmax(), 1e-5
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k].ravel()[at] += e
        down[k].ravel()[at] -= e
        slope = (attention.gradients(up, tables, i, t)[0] - attention.gradients(down, tables, i, t)[0]) / (2 * e)
        assert g[k].ravel()[at] == pytest.approx(slope, abs=1e-4), k


def test_attention_learns_what_pairs_do_not_tell():
    # after 0 comes what stood two places before
    rng = np.random.default_rng(4)
    heads = rng.integers(1, 40, 3000)
    places = np.stack([heads, np.zeros(3000, dtype=np.int64), heads], axis=1).ravel()
    n = np.full(60, 150)
    pairs = np.bincount(np.append(0, places[:-1]) * attention.PLACES + places, minlength=attention.PLACES**2).reshape(attention.PLACES, -1).astype(float)
    mass = np.bincount(places, minlength=attention.PLACES) + 1.0
    tables = attention.Tables(mass / mass.sum(), pairs)
    p = attention.initial()
    learner = attention.Learner(p, tables, 1e-2)
    i, t = attention.windows(places, n)
    for _ in range(30):
        learner.learn(i, t)
    assert attention.Reader(learner.p, tables).log_probs(places, n).mean() > attention.Reader(p, tables).log_probs(places, n).mean() + 0.5


def jump_by_hand(key, shards):
    key, b, j = key & ((1 << 64) - 1), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, small):
    got = sharding.op2_sharding(spark, small).collect()
    want = Counter()
    for d in DOCUMENTS:
        raw = (d[1] or "").encode()
        want[(d[0], len(raw) + 16, zlib.crc32(raw), "key", jump_by_hand(d[0] or 0, 40), jump_by_hand(d[0] or 0, 41))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jump_keys():
    keys = np.arange(-500, 3000, dtype=np.int64).view(np.uint64)
    for n in (1, 2, 7, 40, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_by_hand(int(k), n) for k in keys]


def test_ranking_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LEAST_RANGES", 7)
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") * 7919) % 300).alias("o"))
    got = {}
    for r in ranking.ranked(df, "g", "o", "k").collect():
        got.setdefault(r["g"], []).append((r["k"], -1 if r["o"] is None else r["o"]))
    for v in got.values():
        v.sort()
        assert [k for k, _ in v] == list(range(len(v))) and [o for _, o in v] == sorted(o for _, o in v)


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 40, "b": 20, "c": 20, "d": 15, "e": 7}])
def test_period_deviates_by_less_than_a_block(weights):
    plan, total = mixing.period(weights), sum(weights.values())
    assert Counter(plan) == weights
    seen = Counter()
    for t, s in enumerate(plan):
        seen[s] += 1
        for x, w in weights.items():
            assert abs(seen[x] - (t + 1) * w / total) < 1


def test_parts_of_a_period():
    got = mixing.parts({k: 1 / p for k, p in enumerate((9973, 9967, 9949))})
    assert sum(got.values()) <= mixing.PERIOD and max(got.values()) - min(got.values()) < 20
    assert mixing.parts({"a": 40, "b": 20}) == {"a": 6667, "b": 3333} and mixing.parts({"a": 3, "b": 1}) == {"a": 3, "b": 1}
    assert min(mixing.parts({"a": 1, "b": 1e-9}).values()) == 1
    many = mixing.parts(dict.fromkeys(range(30_000), 1))
    assert set(many.values()) == {1}


def test_mixing(spark):
    n = {"a": 70, "b": 33, "c": 5, None: 12}
    df = spark.createDataFrame([(f"{s}{k}", s, 1) for s, c in n.items() for k in range(c)], "doc_id string, source string, weight long").withColumnRenamed("weight", "extra")
    got = mixing.mixed(df, {"a": 6, "b": 3, "c": 1, None: 2}, block_rows=4).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(sum(n.values()))) and Counter(r["source"] for r in got) == n
    slots = sorted({(r["mix_slot"], r["source"], r["mix_block"], r["mix_release"], r["mix_deadline"]) for r in got}, key=lambda x: x[0])
    assert [s[0] for s in slots] == list(range(len(slots)))
    first = [s for s in slots if s[0] < 12]
    assert all(s[3] <= s[0] < s[4] for s in first)
    with pytest.raises(ValueError):
        mixing.mixed(df, {"a": -1})


def mixed_by_hand(rows, weights, block_rows):
    """{row: (block, release, deadline, slot, share, position)} of (key, source) rows, one slot after the other."""
    order = {}
    for key, source in rows:
        order.setdefault(source, []).append(key)
    for source, keys in order.items():
        keys.sort(key=lambda k: (xxhash.xxh64_intdigest(int(k).to_bytes(8, "little", signed=True), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(int(k).to_bytes(8, "little", signed=True), seed=42) >> 63), k))
    whole = mixing.parts({s: weights.get(s, mixing.DEFAULT_WEIGHT) for s in order})
    left = {s: -(-len(k) // block_rows) for s, k in order.items()}
    done, out, slot, position = dict.fromkeys(order, 0), {}, 0, 0
    while any(left.values()):
        live = {s: whole[s] for s in order if left[s]}
        shrink = math.gcd(*live.values())
        live = {s: w // shrink for s, w in live.items()}
        total, ran, t = sum(live.values()), dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            ready = [s for s in live if ran[s] * total // live[s] <= t]
            s = min(ready, key=lambda s: (-(-(ran[s] + 1) * total // live[s]), str(s)))
            for k in order[s][done[s] * block_rows : (done[s] + 1) * block_rows]:
                out[k] = (done[s], ran[s] * total // live[s], -(-(ran[s] + 1) * total // live[s]), slot, live[s] / total, position)
                position += 1
            ran[s], done[s], left[s], slot, t = ran[s] + 1, done[s] + 1, left[s] - 1, slot + 1, t + 1
    return out


@pytest.mark.parametrize("folder", ["small", "/root/testdata/sf0.01"])
def test_mixing_of_whole_documents_by_hand(spark, small, folder):
    import os

    folder = small if folder == "small" else folder
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is not null").select("doc_id", "source").dropDuplicates(["doc_id"])
    for rows_ in (4, mixing.BLOCK_ROWS):
        got = {r["doc_id"]: (r["mix_block"], r["mix_release"], r["mix_deadline"], r["mix_slot"], r["mix_share"], r["mix_position"]) for r in mixing.mixed(docs, mixing.WEIGHTS, block_rows=rows_).collect()}
        assert got == mixed_by_hand([(r["doc_id"], r["source"]) for r in docs.collect()], mixing.WEIGHTS, rows_)


def test_tiny_and_odd_weights(spark):
    docs = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(300)], "doc_id long, source string")
    got = mixing.mixed(docs, {"a": 1 / 9973, "b": 1 / 9967, "c": 1e-7}, block_rows=4).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(300))


def test_quality(spark, small):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.op4_quality(spark, small).collect())
    want = Counter()
    for d in DOCUMENTS:
        t, w = d[1] or "", words(d[1])
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[(d[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert got == want


def test_quality_keeps_prose_and_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("n_words", F.lit("mine"))
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {3, 13, 23, 33, 43} <= ids and not ids & {10 * k + 3 for k in range(18, 26)}


NAMES = "_row _key _id _text _hash _hashes _words _words_of _keys _alike _lines _all _full _gone _bad _c c d r k b fp least root node weight period _at _group _order _first _in _rank _block _slot _of _shard _tie _sub shard slot mix_position n_words clean_text".split()


@pytest.mark.parametrize("made", ["mixed", "sharded", "deduplicated", "kept", "clean", "judge", "keep", "fingerprinted"])
def test_names_of_extra_columns_do_not_matter(spark, small, made):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    run = {
        "mixed": lambda d: mixing.mixed(d, mixing.WEIGHTS), "sharded": sharding.sharded, "deduplicated": linededup.deduplicated, "kept": simhash.kept, "clean": lambda d: decontamination.clean(d, items),
        "judge": quality.judge, "keep": quality.keep, "fingerprinted": simhash.fingerprinted,
    }[made]
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id is not null and doc_id < 200").dropDuplicates(["doc_id"])
    plain = run(docs)
    extra = [n for n in NAMES if n not in set(plain.columns) - set(docs.columns)]
    got = run(docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in extra]))
    assert set(got.columns) == set(plain.columns) | set(extra)
    for r in got.select(*extra).distinct().collect():
        assert all(r[n] == f"mine {n}" for n in extra)
    assert rows(got.select(*plain.columns).withColumns({c: F.col(c).cast("string") for c in plain.columns})) == rows(plain.withColumns({c: F.col(c).cast("string") for c in plain.columns}))


def fingerprint(text, size=3):
    w = words(lower(text))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_simhash(spark, small):
    fps = [(d[0], fingerprint(d[1])) for d in DOCUMENTS]
    nodes = {f for _, f in fps}
    root = groups([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3], nodes)
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    want = Counter((d, f"{f:016x}", least.get(root[f])) for d, f in fps)
    assert of(simhash.op5_simhash(spark, small), "doc_id", "fingerprint", "component_id") == want


def test_links_are_all_found(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            f = int(b)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                f ^= 1 << int(bit)
            fps.add(f)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    want = {frozenset((signed(a), signed(b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert {frozenset(r) for r in got} == want and len(got) == len(want)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + k, 401 + k) for k in range(40)] + [(500, 500 + k) for k in range(1, 60)]
    root = groups(edges, {x for e in edges for x in e})
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {n: r for n, r in root.items() if n != r}


def jaccard(a, b):
    s = []
    for t in (a, b):
        w = words(lower(t))
        s.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set())
    return 1.0 if words(lower(a)) == words(lower(b)) else len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_near_copies_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = Counter(r["doc_id"] for r in simhash.kept(docs).collect())
    ids = sorted({d[0]: d[1] for d in DOCUMENTS if d[0] is not None}.items())
    root = groups([(i, j) for i, a in ids for j, b in ids if i < j and jaccard(a, b) >= 0.8], [i for i, _ in ids])
    want = Counter(i for i, _ in ids if root[i] == i)
    want[None] = 2
    assert got == want


def varied(seed, n, share, chain):
    """Texts of 60 words, each from an earlier one (the last one in a chain) by ``share`` substitutions."""
    rng = np.random.default_rng(seed)
    out = [[f"w{x}" for x in rng.integers(0, 10**9, 60)]]
    for _ in range(n - 1):
        t = list(out[-1] if chain else out[0])
        for at in rng.choice(60, share, replace=False):
            t[at] = f"w{rng.integers(0, 10**9)}"
        out.append(t)
    return [" ".join(t) for t in out]


def test_near_copies_at_the_threshold_are_all_found(spark, monkeypatch):
    # one substitution inside gives 5 of 56 shingles: 51 / 61 = 0.836; two mostly 46 / 66
    texts = [t for k in range(40) for t in varied(k, 2, 1, False)] + varied(77, 30, 1, True) + varied(78, 30, 2, False)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    close = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and jaccard(a, b) >= 0.8]
    assert sum(0.8 <= jaccard(texts[i], texts[j]) < 0.85 for i, j in close) > 30
    root = groups(close, range(len(texts)))
    assert {r["_id"]: r["_stay"] for r in simhash.copies(docs).collect()} == {k: root[k] for k in range(len(texts))}


def test_members_of_a_large_group_meet_its_centre_not_each_other(spark, monkeypatch):
    rng = np.random.default_rng(31)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 150)]
    texts = [" ".join(base)]
    for k in range(150):
        t = list(base)
        for at in rng.choice(150, 1 + k % 9, replace=False):
            t[at] = f"w{rng.integers(0, 10**9)}"
        texts.append(" ".join(t))
    docs, met, write = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], simhash.written

    def counted(df, name):
        out = write(df, name)
        met.extend([out.count()] if name in ("nearest", "met") else [])
        return out

    monkeypatch.setattr(simhash, "written", counted)
    # nothing is linked by the buckets, so all is left to the shingles
    monkeypatch.setattr(simhash, "APART", 0.0)
    got = {r["_id"]: r["_stay"] for r in simhash.copies(docs).collect()}
    root = groups([(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and jaccard(a, b) >= 0.8], range(len(texts)))
    assert got == {k: root[k] for k in range(len(texts))} and sum(r == 0 for r in root.values()) > 40
    assert sum(met) < 4 * len(texts)


@pytest.mark.parametrize("block", [1, 256])
def test_every_pair_of_a_shared_shingle_is_compared(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    held = [(k, k if k < 12 else 12, 15, 0, 7) for k in range(15)]
    got = sorted(map(tuple, simhash._unlinked(spark.createDataFrame(held, "c long, root long, n int, at int, t long")).collect()))
    assert got == [(a[0], b[0]) for a in held for b in held if a[0] < b[0] and a[1] != b[1]]


def test_recall_of_near_copies_by_similarity(spark):
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(120):
        base = [f"w{x}" for x in rng.integers(0, 10**9, rng.integers(40, 160))]
        other = list(base)
        for at in rng.choice(len(base), rng.integers(1, 1 + len(base) // 40), replace=False):
            other[at] = f"w{rng.integers(0, 10**9)}"
        texts += [" ".join(base), " ".join(other)]
    got = {r["_id"]: r["_stay"] for r in simhash.copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bands = Counter()
    for k in range(0, len(texts), 2):
        near = jaccard(texts[k], texts[k + 1])
        assert (got[k + 1] == k) == (near >= 0.8), near
        bands[int(near * 20)] += 1
    assert all(bands[b] >= 3 for b in (16, 17, 18)) and sum(n for b, n in bands.items() if b < 16) >= 3


def test_tokens(spark, small):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for d in DOCUMENTS:
        n = len(tk.encode(d[1] or "", add_special_tokens=False).ids)
        want[(d[0], len((d[1] or "").encode()), n, n > 1024)] += 1
    assert rows(tokens.op6_tokens(spark, small)) == want


ODD = ["", " ", "  a", "a  b", " a b ", "a\tb\nc d", "it's don't ' s", "A.B. C, D.", "<|endoftext|>x <|ENDOFTEXT|> <|startoftext|>", "İstanbul ΣΑΣ. ǅ ﬁ", "é a ́b", " x y 　z", "１２ ² ½.", "\x1c a\x85b", "👍🏽 ok. é, ü.", "a\r\nb \r\n c", "日本 語", None]


def test_subwords_are_the_librarys():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ODD + [d[1] for d in DOCUMENTS]
    for _ in range(2):
        path = tokenizer_path("byte_bpe_50k.json")
        tk = Tokenizer.from_file(path)
        assert subwords.token_counts(pa.array(texts), path).tolist() == [len(tk.encode(t or "", add_special_tokens=False).ids) for t in texts]
        path = tokenizer_path("word_bpe_49k.json")
        tk = Tokenizer.from_file(path)
        ids, n = subwords.token_ids(pa.array(texts), path)
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [tk.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_licenses(spark, small):
    got = {}
    for r in licenses.op7_licenses(spark, small).collect():
        got[r["doc_id"]] = r
    by = {d[0]: d for d in DOCUMENTS}
    for i, d in by.items():
        if i is None:
            continue
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d[1]))
        at = [(k, v) for p, v in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({v for _, v in at})))
        more = set()
        for label, t in licenses.TEMPLATES:
            every = re.findall(r"[a-z0-9]+", t.lower())
            want, width = set(every), -(-len(every) * 5 // 4)
            if any(10 * len(set(w[k : k + width]) & want) >= 8 * len(want) for k in range(len(w))):
                more.add(label)
        assert r["labels"] == ",".join(sorted(more | {v for _, v in at})) and 0 <= r["score"] <= 1


def test_decontamination(spark, small):
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.op8_decontamination(spark, small).collect()}
    leaks = {(d[0], k) for d in DOCUMENTS for k, t in BENCHMARK if t and t in (d[1] or "")}
    assert leaks and leaks <= set(got)
    swapped = next(d[0] for d in DOCUMENTS if d[1] and "changed" in d[1] and d[0] > 123)
    assert (swapped, 5) in got and 0.8 <= got[swapped, 5]["similarity"] < 1
    assert set(got) == leaks | {(swapped, 5)}
    left = {r["doc_id"] for r in decontamination.clean(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert left == {d[0] for d in DOCUMENTS} - {d for d, _ in got}


def overlaps_by_hand(docs, items):
    """{(doc, item): (item words, overlap, matches, doc start, item start)} by all stretches of all diagonals."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = {}
    for i, a in docs:
        for k, b in items:
            a_, b_ = split(a), split(b)
            need = len(b_) if len(b_) < 8 else min(13, -(-len(b_) * 4 // 5))
            for line in range(-len(b_) + 1, len(a_)):
                d, m = max(line, 0), max(-line, 0)
                n = min(len(a_) - d, len(b_) - m)
                e = [a_[d + x] == b_[m + x] for x in range(n)]
                size, start = max(((y - x, -x) for x in range(n) for y in range(x + 1, n + 1) if 5 * sum(e[x:y]) >= 4 * (y - x)), default=(0, 0))
                on = [x for x in range(-start, -start + size) if e[x]]
                if b_ and on and (len(on) if len(b_) < 8 else size) >= need:
                    got = (len(on), on[-1] + 1 - on[0], -(d + on[0]), m + on[0])
                    out[i, k] = max(out.get((i, k), got), got)
    sizes = {k: len(split(b)) for k, b in items}
    return {(i, k): (sizes[k], v[1], v[0], -v[2], v[3]) for (i, k), v in out.items()}


def test_overlaps_by_hand(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 40)}"
    items, docs = [], []
    for k, n in enumerate([1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, 26]):
        item = [word() for _ in range(n)]
        items.append((k, " ".join(item)))
        for swaps in (0, 1, 2, 3, 4):
            part = list(item)
            for at in rng.choice(n, min(n, swaps), replace=False):
                part[at] = "other"
            docs.append((len(docs), " ".join([word() for _ in range(rng.integers(0, 6))] + part + [word() for _ in range(rng.integers(0, 6))])))
    items += [(50, None), (51, ""), (52, "...")]
    docs += [(1000, None), (1001, "")]
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = overlaps_by_hand(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["n_item_words"], r["overlap_words"], r["matched_words"], r["doc_start"], r["item_start"]) for r in got} == want
    assert len(want) > 60


def test_substituted_items_are_all_found(spark):
    rng = np.random.default_rng(9)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**9, 15))) for k in range(100)]
    docs = []
    for k, t in items:
        for swaps in (1, 2, 3):
            part = t.split(" ")
            for at in rng.choice(15, swaps, replace=False):
                part[at] = "other"
            docs.append((3 * k + swaps - 1, "before it " + " ".join(part) + " after it"))
    got = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(3 * k + s, k) for k in range(100) for s in range(3)}


def test_masks_fit_between_any_unequal_words():
    from itertools import combinations

    for masks, sizes in ((decontamination.SHORT, range(7, 26)), (decontamination.LONG, range(13, 22))):
        ones = [[k for k, c in enumerate(m) if c == "1"] for m in masks]
        for n in sizes:
            for off in combinations(range(n), n // 5):
                assert any(not set(off) & {a + k for k in m} for m in ones for a in range(n - m[-1]))


def test_longest_stretch():
    rng = np.random.default_rng(5)
    for _ in range(300):
        e = rng.random(rng.integers(0, 30)) < 0.8
        want = max((j - i for i in range(len(e)) for j in range(i + 1, len(e) + 1) if 5 * e[i:j].sum() >= 4 * (j - i)), default=0)
        start, size, matches = decontamination.longest_stretch(e)
        assert size == want and matches == e[start : start + size].sum() and 5 * matches >= 4 * size


def test_substitutions_near_the_edges(spark):
    item = [f"w{k}" for k in range(16)]
    docs = [" ".join("other" if k == at else w for k, w in enumerate(item)) for at in range(16)]
    long = [f"v{k}" for k in range(40)]
    # 12 equal words, and apart from them 15 words with one substitution, on one diagonal
    docs.append(" ".join(w if k < 12 or 20 <= k < 35 and k != 27 else f"x{k}" for k, w in enumerate(long)))
    made = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    items = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(long))], "item_id long, text string")
    got = decontamination.overlaps(made, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, 0) for k in range(16)} | {(16, 1)}
    assert all(r["overlap_words"] >= 13 and r["similarity"] >= 0.8 for r in got)


def test_licenses_over_lines_and_by_row(spark):
    import textwrap

    wrapped = {k: "some words before\n" + "\n".join(textwrap.wrap("Anyone. " + t + " and more.", 70 if k % 2 else 20)) for k, (_, t) in enumerate(licenses.TEMPLATES)}
    docs = list(wrapped.items()) + [(90, "the rights of all are reserved by the state"), (91, "Released under the MIT License."), (91, "nothing of the kind here"), (92, "far\n" * 50 + "licensed " + "x " * 30 + "under the mit license"), (93, None)]
    got = licenses.scanned(spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_b": F.lit(1), "labels": F.lit("x")})).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["labels"])
    assert all(licenses.TEMPLATES[k][0] in by[k][0].split(",") for k in wrapped)
    assert by[90] == [""] and sorted(by[91]) == ["", "mit"] and by[93] == [""]
    assert by[92] == ["mit"]


def most_left(codes):
    """The count, without overlaps with itself, of the most frequent pair that holds no end."""
    counts, last = Counter(), {}
    for i, pair in enumerate(zip(codes[:-1].tolist(), codes[1:].tolist(), strict=True)):
        if repair.END not in pair and not (pair[0] == pair[1] and last.get(pair) == i - 1):
            counts[pair] += 1
            last[pair] = i
    return max(counts.values(), default=0)


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    cases = [(rng.zipf(1.3, n) % 700).astype(np.uint32) for n in (0, 1, 2, 60, 5000, 60_000)]
    phrase = rng.integers(3, 200, 40)
    cases += [np.full(5000, 7), np.tile([5, 6], 3000), np.tile(phrase, 300), np.concatenate([np.append(rng.permutation(phrase[:8]), 2) for _ in range(500)])]
    for x in cases:
        x = np.append(x, 2).astype(np.uint32)
        codes, rules, lengths = repair.compress(x.copy())
        assert (repair.expand(codes, rules, lengths) == x).all()
        # no rule that would save more than it takes is left out, and every rule is used
        assert most_left(codes) * repair.CODE_BYTES <= repair.RULE_BYTES
        assert (lengths == [len(repair.expand(np.array([repair.BASE + k], dtype=np.uint32), rules, lengths)) for k in range(len(rules))]).all()
        assert set(range(len(rules))) <= {int(c) - repair.BASE for c in np.concatenate([codes, rules.ravel()])}
        for a, b in rng.integers(0, len(x) + 1, (20, 2)):
            a, b = sorted((int(a), int(b)))
            assert (repair.ids_at(codes, rules, lengths, a, b) == x[a:b]).all()


def test_repair_sorts_pairs_with_and_without_places():
    rng = np.random.default_rng(6)
    for high in (50, 1 << 31):
        left, right = (rng.integers(0, 20, (2, 3000)) * (high // 20)).astype(np.uint32)
        order, new = repair._by_pair(left, right)
        pairs = left[order].astype(np.uint64) << np.uint64(32) | right[order]
        assert (np.diff(pairs.astype(np.float64)) >= 0).all() and new.sum() == len(np.unique(pairs)) and sorted(order) == list(range(3000))


def test_one_document_is_read_through_lengths(spark, small, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"])
    repair.write(docs, str(tmp_path / "ids"), path)
    texts, seen = {r["doc_id"]: r["text"] for r in docs.collect()}, 0
    for row in spark.read.parquet(str(tmp_path / "ids")).collect():
        codes, rules, lengths = repair.unpack(row)
        for k, doc in enumerate(row["keys"]):
            start = sum(row["id_counts"][:k])
            ids = repair.ids_at(codes, rules, lengths, start, start + row["id_counts"][k]).tolist()
            # the document's own codes alone give the same
            first = sum(row["code_counts"][:k])
            own = repair.expand(codes[first : first + row["code_counts"][k]], rules, lengths).tolist()
            assert ids == own == [*tk.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
            seen += 1
    assert seen == len(texts)


def test_repair_files(spark, small, monkeypatch):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = sorted(repair.op9_repair(spark, small).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    by = {}
    for d in DOCUMENTS:
        ids = np.array([*tk.encode(d[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        by.setdefault(d[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in by[r["doc_id"]]
        at += r["n_tokens"]


def test_line_dedup(spark, small):
    got = {r["doc_id"]: r for r in linededup.op10_linededup(spark, small).collect() if r["doc_id"] is not None}
    docs = sorted({d[0]: d[1] for d in DOCUMENTS if d[0] is not None}.items())
    seen, gone = {}, {}
    windows = []
    for i, t in docs:
        full = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n")) if words(x)]
        for s in range(len(full)):
            for e in range(s + 1, len(full) + 1):
                if sum(len(words(x)) for _, x in full[s:e]) >= linededup.MIN_WORDS:
                    windows.append((i, s, e, "\n".join(x for _, x in full[s:e]), [k for k, _ in full[s:e]]))
    for i, s, e, body, lines in sorted(windows, key=lambda w: w[:3]):
        if body in seen and seen[body] != (i, s):
            gone.setdefault(i, set()).update(lines)
        seen.setdefault(body, (i, s))
    assert {i: r["deleted_lines"] for i, r in got.items()} == {i: ",".join(map(str, sorted(gone.get(i, ())))) for i, _ in docs}
    assert any(gone.values())


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    # SQL joins on the id, so only rows with one of their own
    rows_ = [d for d in dict.fromkeys(DOCUMENTS) if d[0] is not None]
    df = spark.createDataFrame(rows_, EMPTY).toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT * FROM df")
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame(rows_, EMPTY).write.parquet(f"{folder}/documents.parquet")
    for t in ("embeddings", "pages"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE TABLE {t} AS FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    norm = lambda x: "null" if x is None or x != x else str(x) if isinstance(x, bool | str) or type(x).__name__ == "bool_" else f"{float(x):.9g}"
    got, want = registry.QUERIES[name](spark, folder).toPandas(), con.sql(registry.ORACLE[name]).df()
    table = lambda t: Counter(tuple("null" if v is None or str(v) in ("nan", "<NA>", "None") else norm(v) for v in r) for r in t[sorted(t.columns)].itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and table(got) == table(want)
