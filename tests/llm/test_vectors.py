"""Hard negatives, Sort-means and WARC bundles against brute force, with their odd cases."""

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lociweave.llm import centroids, negatives, vectors, warc
from tests.llm.cases import EMBEDDINGS, PAGES


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def negatives_by_hand(data, positives=5, wanted=10):
    kept = [(k, i, (c + 1) % 10 if i % 7 == 0 else c, whole(v) + [0] * (64 - len(v))) for k, (i, v, c) in enumerate(data) if i is not None and c is not None and fine(v)]
    out = Counter()
    for k, i, c, v in kept:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, n, d) for n, j, d, w in kept if n != k)
        for s, j, _, _ in [x for x in scored if x[3] == c][:positives]:
            fit = [x for x in scored if x[3] != c and 30 * -s <= 100 * -x[0] <= 90 * -s][:wanted]
            out.update((i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit))
    return out


def test_negatives_by_hand(spark, small):
    assert rows(negatives.op11_hardnegatives(spark, small)) == negatives_by_hand(EMBEDDINGS)


def test_negatives_in_blocks_and_few_lists(spark, small, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "CELLS", 500)
    data = spark.read.parquet(f"{small}/embeddings.parquet").withColumn("row", F.lit("clash")).withColumn("at", F.lit(1))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(data, F.col("vec_id") % 100 == 0, "vec_id", "embedding", label, positives=3, negatives=4, lists=5)
    assert rows(got) == negatives_by_hand(EMBEDDINGS, 3, 4)


def test_lists_beyond_the_bounds_are_skipped():
    rng = np.random.default_rng(3)
    hubs = rng.integers(-100, 100, (8, 16))
    x = np.repeat(hubs, 30, axis=0) + rng.integers(-3, 4, (240, 16))
    at, least = centroids.nearest(x, hubs, np.zeros(240, dtype=np.int64))
    radii = np.array([np.sqrt(least[at == c].max()) for c in range(8)])
    anchors = {"v": x[::40], "label": np.zeros(6, dtype=np.int64), "row": np.arange(0, 240, 40)}
    of, n = np.arange(6), 6
    needs = negatives.Needs(anchors, of, np.full(n, 10_000), np.full(n, 30_000), False, 4)
    bounds = needs.bounds(hubs, radii)
    scores = x[::40] @ x.T
    assert np.isneginf(bounds).any()
    for c in range(8):
        inside = scores[:, at == c]
        assert (np.minimum(inside.max(axis=1), 30_000) <= bounds[:, c])[np.isfinite(bounds[:, c])].all()
        closed = np.isneginf(bounds[:, c])
        assert not ((inside[closed] >= 10_000) & (inside[closed] <= 30_000)).any()


def centroids_by_hand(data, k=40, rounds=5, dims=64):
    kept = [(i, np.array(whole(v))) for i, v, _ in data if v is not None and len(v) == dims and fine(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    centers = [v for _, v in order[:k]]
    for r in range(rounds + 1):
        far = np.array([[int(((v - c) ** 2).sum()) for c in centers] for _, v in kept])
        at = far.argmin(axis=1)
        if r < rounds:
            centers = [np.array([sum(int(x) for x in col) // int((at == c).sum()) for col in zip(*[kept[n][1] for n in np.flatnonzero(at == c)], strict=True)]) if (at == c).any() else centers[c] for c in range(len(centers))]
    least = far.min(axis=1)
    told = {c: hashlib.sha256(",".join(str(int(x)) for x in centers[c]).encode()).hexdigest() for c in range(len(centers))}
    return Counter((i, int(a), int(d), int(least[at == a].sum()), int(least.sum()), told[int(a)]) for (i, _), a, d in zip(kept, at, least, strict=True))


def test_centroids_by_hand(spark, small):
    assert rows(centroids.op12_centroids(spark, small)) == centroids_by_hand(EMBEDDINGS)


def test_fewer_vectors_than_centroids(spark):
    data = [(k, [float(k), 1.0], "a") for k in (5, 5, 9)] + [(None, [0.5, 0.5], "b"), (4, [1.0], "c")]
    got = centroids.sort_means(spark.createDataFrame(data, "vec_id long, embedding array<double>, cluster string"), "vec_id", "embedding", k=10, rounds=2, dimensions=2)
    assert {(r["vec_id"], r["distance"]) for r in got.collect()} == {(5, 0), (9, 0), (None, 0)} and got.count() == 4
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("spread", [2, 40, 1000])
def test_scans_from_any_centroid_find_the_first_nearest(spread):
    rng = np.random.default_rng(spread)
    x, centers = rng.integers(-spread, spread, (500, 3)), rng.integers(-spread, spread, (25, 3))
    far = np.array([[((a - c) ** 2).sum() for c in centers] for a in x])
    for before in (np.zeros(500, dtype=np.int64), rng.integers(0, 25, 500), far.argmin(axis=1)):
        at, least = centroids.nearest(x, centers, before)
        assert (at == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_whole_numbers(spark):
    df = spark.createDataFrame([([0.1, -0.1, 0.0, 8191.99],), ([1e9],), ([None, 1.0],), (None,), ([float("inf")],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.finite(F.col("v"))).collect()] == [True, True, False, False, False]
    assert df.limit(1).select(vectors.whole(F.col("v"))).first()[0] == [25, -26, 0, 2097149]
    with pytest.raises(Exception, match="beyond"):
        df.filter(F.size("v") == 1).select(vectors.whole(F.col("v"))).collect()


def test_products_are_exact_beyond_doubles():
    a = np.full((2, 64), (1 << 28) + 1, dtype=np.int64)
    assert vectors.products(a, a).tolist() == [[64 * ((1 << 28) + 1) ** 2] * 2] * 2


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def archive_by_hand(data, least=0):
    order, out = {}, Counter()
    for k, (i, _, html) in sorted(enumerate(data), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0])):
        size, first = len((html or "").encode()), order.setdefault(sha(html), (k, i))
        out[(i, size, sha(html), *(("revisit", first[1]) if size >= least and first[0] != k else ("response", None)))] += 1
    return out


def test_archive_by_hand(spark, small):
    assert rows(warc.op13_warc(spark, small)) == archive_by_hand(PAGES)


@pytest.mark.parametrize("least", [0, 1, 10, 1_000_000])
def test_archive_round_trip(spark, small, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 6000)
    path, pages = str(tmp_path / "archive"), spark.read.parquet(f"{small}/pages.parquet").withColumn("row", F.lit("clash")).repartition(3)
    index = warc.write(pages, path, least=least)
    got = warc.records(spark, path).cache()
    told = Counter((None if r["id"] is None else int(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in got.collect())
    assert told == archive_by_hand(PAGES, least)
    # the index leads to the same records; a revisit names a response of the archive
    assert rows(index.select("record_id", "bundle", "frame", "offset", "digest", "record_type")) == rows(got.select("record_id", "bundle", "frame", "offset", "payload_digest", "record_type"))
    assert got.filter("record_type = 'revisit'").join(got.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record")), "refers_to_record", "left_anti").count() == 0
    assert index.select("bundle").distinct().count() > 3
    # any id is found again with the whole payload, copies too
    wanted = spark.createDataFrame([(3,), (5,), (100,), (71,), (200,), (201,), (205,), (999,)], "page_id long")
    found = Counter((r["page_id"], bytes(r["payload"]).decode()) for r in warc.lookup(spark, path, wanted).collect())
    assert found == Counter((i, h or "") for i, _, h in PAGES if i in (3, 5, 100, 71, 200, 201, 205))
    # a plain decompressor reads a bundle as one stream of records, and frames cover it up to the seek table
    for file in (tmp_path / "archive" / "bundles").iterdir():
        data = file.read_bytes()
        frames = warc.frames_of(lambda at, n, data=data: data[at : at + n], len(data))
        plain = b"".join(zstandard.ZstdDecompressor().decompress(data[at : at + n]) for at, n in frames)
        assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data[: sum(frames[-1])]) == plain
        assert [x[2]["WARC-Record-ID"] for x in warc.parsed(plain)] == [r["record_id"] for r in index.filter(F.col("bundle") == file.name).orderBy("frame", "offset").collect()]
    urls = {r["url"] for r in got.collect() if r["id"] is None}
    assert urls == {"http://x%20y%0D%0AWARC-Type:%20evil", "ü"}


def test_damaged_payloads_and_tables_are_found(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(spark.createDataFrame([(1, "u", "a page that is long enough")], "page_id long, url string, html string"), path)
    bundle = next((tmp_path / "archive" / "bundles").iterdir())
    data = bundle.read_bytes()
    (start, length), = warc.frames_of(lambda at, n: data[at : at + n], len(data))
    plain = zstandard.ZstdDecompressor().decompress(data[start : start + length]).replace(b"long enough", b"long enougH")
    packed = zstandard.ZstdCompressor().compress(plain)
    bundle.write_bytes(packed + warc.seek_table([(len(packed), len(plain))]))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.records(spark, path).collect()
    for wrong in (b"", data[:-1], data[: len(data) - 17], data + data[-9:]):
        with pytest.raises(ValueError, match="seek table"):
            warc.frames_of(lambda at, n, wrong=wrong: wrong[at : at + n], len(wrong))
