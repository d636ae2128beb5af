import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slidestream.llm import simhash
from slidestream.llm.components import connected_components
from tests.llm import data


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(fps, ids, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                parent[find(a)] = find(b)
    least = {}
    for k in range(len(fps)):
        r = find(k)
        least[r] = min([x for x in (least.get(r), ids[k]) if x is not None], default=None)
    return [least[find(k)] for k in range(len(fps))]


def test_fingerprints():
    for t in data.texts():
        if t is None or len(t) < 5000:
            assert simhash.fingerprint(t or "") == plain_fingerprint(t)


def test_documents(spark):
    df, rows = data.documents(spark)
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect())
    fps = [simhash.fingerprint(t or "") for _, t, *_ in rows]
    want = sorted((str(i), f, c) for (i, *_), f, c in zip(rows, fps, plain_components(fps, [i for i, *_ in rows])))
    assert got == want


def near_fps(n, seed=3):
    """Groups of fingerprints a few bits apart, chains, and far ones."""
    rng = np.random.default_rng(seed)
    out = set(rng.integers(0, 1 << 63, n, dtype=np.uint64).tolist())
    for c in list(out)[:4]:
        x = c
        for k in range(n // 4):
            x = c if k % 3 else x
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [16, 4096])
def test_links_lose_nothing(spark, bucket_rows):
    """Also where buckets are over the limit and are compared part by part."""
    fps = near_fps(400)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node % 2**64: r.component for r in connected_components(simhash.links(df, bucket_rows=bucket_rows)).collect()}
    want = plain_components(fps, list(range(len(fps))))
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, []).append(f)
    for members in groups.values():
        assert len({found.get(f, f) for f in members}) == 1
    assert len({found.get(f, f) for f in fps}) == len(groups)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 7])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    a = np.array(near_fps(300, radius), np.uint64)
    b = rng.permutation(a)[:270]
    got = {(int(x), int(y)) for i, j in simhash.near_pairs(a, b, radius, chunk_cells=64) for x, y in zip(i, j)}
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius))}
    assert got == want


def test_forest_with_sides():
    fps = np.array([0, 1, 3, 7, 15, 0xFFFF << 40], np.uint64)
    i, root = simhash.forest(fps, np.zeros(6, np.int64), np.array([1, 1, 1, 2, 2, 2], np.int8), 1)
    assert set(zip(i.tolist(), root.tolist())) == {(3, 2)}  # 3 and 7 alone differ by one bit over the parts
    big = np.array(near_fps(120), np.uint64)
    group = np.repeat([0, 1], [len(big) - 30, 30])
    i, root = simhash.forest(big, group, np.zeros(len(big), np.int8), 3, small=8)
    j, other = simhash.forest(big, group, np.zeros(len(big), np.int8), 3, small=500)
    assert dict(zip(i.tolist(), root.tolist())) == dict(zip(j.tolist(), other.tolist()))


def test_masks_cover_every_choice():
    for changed in ((0, 20, 40), (1, 2, 3), (63, 31, 11), (5,)):
        bits = sum(1 << b for b in changed)
        assert any(not m & bits for m in simhash.masks())


def test_components_of_chain_and_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 60)] + [(3, 3), (1, 2), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in range(7, 60)}, 1: 1, 2: 1}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    df, rows = data.documents(spark)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    fps = [simhash.fingerprint(t or "") for _, t, *_ in rows]
    named = [(i, c) for (i, *_), c in zip(rows, plain_components(fps, [i for i, *_ in rows])) if i is not None]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in named}) and ids.count(None) == 1


def test_empty(spark):
    assert simhash.near_duplicates(data.empty(spark)).count() == 0 and simhash.near_dedup(data.empty(spark)).count() == 0
    assert simhash.fingerprints(spark.createDataFrame([(1, None)], "doc_id int, text string")).select(F.sum("fp")).first()[0] == 0
