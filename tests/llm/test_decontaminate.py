import random
from collections import Counter

import numpy as np
import pytest

from slidestream.llm import decontaminate as d
from slidestream.llm.common import WordHashes, lower_words, shingle_hashes
from tests.llm import data

RNG = random.Random(9)
ITEMS = [(k, data.prose(RNG, n)) for k, n in enumerate((16, 20, 33, 60, 5, 3, 1, 45))] + [(90, None), (91, ""), (None, "no id")]


def planted():
    rng = random.Random(10)
    body = lambda n: data.prose(rng, n)
    long = ITEMS[3][1].split(" ")
    near = list(long)
    near[-1] = "changed"
    return [body(80) + " " + ITEMS[0][1] + " " + body(40), ITEMS[1][1].upper(), ITEMS[2][1].replace(" ", "\n"), body(10) + " " + " ".join(near), " ".join(long[:-1]), " ".join(long[:30]) + " " + body(30), ITEMS[4][1], ITEMS[5][1] + " end", ITEMS[7][1] + " x " + ITEMS[0][1], body(300), ITEMS[1][1] + " " + ITEMS[1][1]]


def shingles(words, width=5):
    if not words:
        return Counter()
    w = min(width, len(words))
    return Counter(tuple(words[k : k + w]) for k in range(len(words) - w + 1))


def plain(rows):
    out = set()
    for i, t, *_ in rows:
        words = lower_words(t or "")
        for item, text in ITEMS:
            target = lower_words(text or "")
            if item is None or not target or not words:
                continue
            n = min(len(target), len(words))
            b = shingles(target)
            for s in range(len(words) - n + 1):
                a = shingles(words[s : s + n])
                shared = sum((a & b).values())
                if shared / (sum(a.values()) + sum(b.values()) - shared) >= 0.8:
                    out.add((str(i), item))
                    break
    return out


@pytest.mark.parametrize(("block_chars", "broadcast"), [(400, 9), (150, 1), (1 << 20, 1)])
def test_matches(spark, block_chars, broadcast):
    """Broadcast in several blocks, routed to stored blocks, broadcast in one."""
    df, rows = data.documents(spark, planted() + [t for t in data.texts() if t is None or len(t) < 3000])
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = d.contamination(df, bench, block_chars=block_chars, most_broadcast=broadcast).collect()
    assert {(str(r.doc_id), r.item_id) for r in got} == plain(rows)
    assert all(0.8 <= r.similarity <= 1 and r.distance <= d.RADIUS for r in got)
    dirty = {i for i, _ in plain(rows)}
    clean = d.decontaminate(df, bench, block_chars=block_chars, most_broadcast=broadcast)
    assert clean.columns == df.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, *_ in rows if str(i) not in dirty)


def test_fingerprints_of_windows():
    h = shingle_hashes(WordHashes().of(lower_words(data.prose(random.Random(3), 40))), 5)
    for size in (1, 7, len(h)):
        got = d.window_fingerprints(h, size)
        for s in range(len(h) - size + 1):
            want = sum((2 * sum(int(x) >> b & 1 for x in h[s : s + size]) > size) << b for b in range(64))
            assert int(got[s]) == want


@pytest.mark.parametrize("radius", [3, 7, 11, 15, 19])
def test_lookup_finds_all_in_radius(radius):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    c = d.SizeClass.build(9, list(range(50)), [np.array([f, f, f], np.uint64) for f in fps], radius)
    assert c.fps.tolist() == fps.tolist()
    probes = []
    for f in fps.tolist():
        for n in (0, 5, radius, radius + 1):
            probes.append(f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    w, k, dist = c.lookup(np.array(probes, np.uint64), radius)
    want = np.bitwise_count(np.array(probes, np.uint64)[:, None] ^ fps[None, :])
    assert set(zip(w.tolist(), k.tolist(), dist.tolist())) == {(int(a), int(b), int(want[a, b])) for a, b in zip(*np.nonzero(want <= radius))}


def test_the_index_selects():
    """Of random fingerprints almost none pass, and few are looked at for an item."""
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    c = d.SizeClass.build(9, list(range(20)), [np.array([f], np.uint64) for f in fps], d.RADIUS)
    probes = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert len(c.lookup(probes, d.RADIUS)[0]) < 1e-4 * 20 * len(probes)


def test_similarities():
    rng = random.Random(12)
    for _ in range(200):
        row = np.array([rng.randrange(6) for _ in range(rng.randint(1, 40))], np.uint64)
        item, size = Counter(rng.randrange(7) for _ in range(rng.randint(1, 12))), rng.randint(1, len(row))
        for s, got in enumerate(d.similarities(row, size, item)):
            own = Counter(row[s : s + size].tolist())
            shared = sum((own & item).values())
            assert got == shared / (size + sum(item.values()) - shared)


def test_recall_of_edited_items():
    """Windows of similarity 0.8 and more, by edits of words, against trying every window: at least 0.95 are found, all from 0.9."""
    rng, found, near = random.Random(13), [], []
    items = [(k, data.prose(rng, n)) for k, n in enumerate([20, 30, 45, 60, 80, 120] * 8)]
    index = d.Index(items)
    for item, text in items:
        for _ in range(6):
            words = text.split(" ")
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(words))
                words[k : k + rng.randint(0, 1)] = ["new"] * rng.randint(0, 1)
            whole = data.prose(rng, 25).split(" ") + words + data.prose(rng, 25).split(" ")
            target, n = shingles(lower_words(text)), len(text.split(" "))
            low = lower_words(" ".join(whole))
            top = max((s := sum((shingles(low[k : k + n]) & target).values())) / (2 * sum(target.values()) - s) for k in range(len(low) - n + 1))
            if top >= 0.8:
                got = {i: s for i, s, *_ in index.matches(WordHashes().of(low), 0.8)}
                found.append(item in got)
                if top >= 0.9:
                    near.append(got.get(item) == top)
    assert len(found) > 100 and sum(found) >= 0.95 * len(found) and all(near)


def test_repeated_words_take_little_memory():
    """A million repeated words against an item of a thousand of them, and against one that shares one shingle."""
    import time
    import tracemalloc

    index = d.Index([(1, "spam " * 1000), (2, "spam " * 5 + "other words " * 20), (3, "ham " * 300)])
    words = WordHashes().of(lower_words("spam " * 1_000_000))
    tracemalloc.start()
    began = time.time()
    got = list(index.matches(words, 0.8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, s, p, n) for i, s, p, n, _ in got] == [(1, 1.0, 0, 1000)] and peak < 500_000_000 and time.time() - began < 120


def test_empty_sides(spark):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert d.contamination(data.empty(spark), bench).count() == 0
    df, rows = data.documents(spark)
    none = spark.createDataFrame([], "item_id int, text string")
    assert d.contamination(df, none).count() == 0 and d.decontaminate(df, none).count() == len(rows)
