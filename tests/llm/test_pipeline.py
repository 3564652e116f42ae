"""The pipeline's stages, one after the other, and their effects."""

import re
from collections import Counter

from tests.llm.cases import BENCHMARK, DOCUMENTS, words


def test_stages(spark, small):
    import corpus_pipeline
    from lociweave.llm import quality

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "benchmark leaks", "mixture", "shards"]
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, small)
        sizes.append(docs.count())
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns)
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5] > 0
    got = corpus_pipeline.run(spark, small)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert quality.keep(spark.createDataFrame(DOCUMENTS[:5], spark.read.parquet(f"{small}/documents.parquet").schema)).count() == 5


def quality_by_hand(text):
    from lociweave.llm import quality

    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    per = lambda a, b: a / b if b else None
    metrics = {
        "n_words": len(w), "chars_per_word": per(sum(map(len, w)), len(w)), "symbols_per_word": per(len(re.findall(r"[#*$%&|<>]", t)), len(w)), "stop_words_per_word": per(sum(x in quality.STOP_FORMS for x in w), len(w)),
        "dup_lines_per_line": per(len(lines) - len(set(lines)), len(lines)), "ellipsis_lines_per_line": per(sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines), len(lines)),
    }
    bad = [r.name for r in quality.RULES if (m := metrics[r.metric]) is not None and ((r.least is not None and m < r.least) or (r.most is not None and m > r.most))]
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and not bad


def test_every_stage_by_hand(spark, small):
    import corpus_pipeline
    from lociweave.llm import mixing
    from tests.llm.test_operators import groups, jaccard, jump_by_hand, mixed_by_hand, overlaps_by_hand

    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"])
    left = {r["doc_id"]: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    run = lambda name, rows: steps[name](spark, spark.createDataFrame(rows, docs.schema), small).collect()
    ids = lambda rows: {r["doc_id"] for r in rows}

    got = run("quality rules", list(left.values()))
    assert ids(got) == {i for i, r in left.items() if quality_by_hand(r["text"])} and len(got) < len(left)
    left = {r["doc_id"]: r for r in got}
    got = run("near copies", list(left.values()))
    root = groups([(a, b) for a in left for b in left if a < b and jaccard(left[a]["text"], left[b]["text"]) >= 0.8], left)
    assert ids(got) == {i for i in left if root[i] == i} and len(got) < len(left)
    left = {r["doc_id"]: r for r in got}
    got = run("benchmark leaks", list(left.values()))
    bad = {i for i, _ in overlaps_by_hand([(i, r["text"]) for i, r in left.items()], BENCHMARK)}
    assert ids(got) == set(left) - bad and bad
    left = {r["doc_id"]: r for r in got}
    got = run("mixture", list(left.values()))
    assert {r["doc_id"]: r for r in got} == left
    place = {i: p[5] for i, p in mixed_by_hand([(i, r["source"]) for i, r in left.items()], mixing.WEIGHTS, mixing.BLOCK_ROWS).items()}
    got = run("shards", got)
    assert {r["doc_id"]: (r["mix_position"], r["shard"], r["grown_shard"]) for r in got} == {i: (place[i], jump_by_hand(i, 40), jump_by_hand(i, 41)) for i in left}
    for k in {r["shard"] for r in got}:
        own = sorted((r for r in got if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own))) and [r["mix_position"] for r in own] == sorted(r["mix_position"] for r in own)


def test_shards_hold_the_mixture(spark, small):
    import corpus_pipeline
    from lociweave.llm import mixing

    sources = ["src0"] * 600 + ["src1"] * 600 + ["src2"] * 600 + ["src3"] * 2200
    made = spark.createDataFrame([(k, f"text {k}", "en", s, 6) for k, s in enumerate(sources)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.shards(spark, corpus_pipeline.mixture(spark, made, small), small).select("shard", "slot", "source", "mix_position").collect()
    by_shard = {}
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        by_shard.setdefault(r["shard"], []).append(r)
    assert sorted(r["mix_position"] for r in got) == list(range(len(sources)))
    for rows in by_shard.values():
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        assert [r["mix_position"] for r in rows] == sorted(r["mix_position"] for r in rows)
    first = [r["source"] for rows in by_shard.values() for r in rows[:20]]
    for s, w in mixing.WEIGHTS.items():
        assert abs(first.count(s) / len(first) - w / sum(mixing.WEIGHTS.values())) < 0.05


def test_the_rest_works_without_this_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{top}/lociweave", tmp_path / "lociweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and q; e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
