import os
import random
import re

import zstandard

from slidestream.llm import quality as q
from tests.llm import data


def plain(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    marked = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


CASES = ["a b c a b c", "x y\nx y\n \nx y ", "a b c d a b c", "#*$%&|<> <<", "　 wide \x85", "\x0b\x0ca", *["w " * n for n in (2, 3, 4, 49, 50)]]


def test_documents(spark):
    df, rows = data.documents(spark, CASES + data.texts())
    want = []
    for i, t, *_ in rows:
        c = plain(t or "")
        want.append((str(i), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    got = q.quality(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)
    assert q.quality(data.empty(spark)).count() == 0


def test_bands():
    c = zstandard.ZstdCompressor(level=q.LEVEL)
    rng = random.Random(1)
    syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 4))) for _ in range(150)]
    prose = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(3000))
    assert q.compression(prose, c)[3]
    assert not q.compression("the same words over and over " * 300, c)[3]
    noise = "".join(chr(33 + b % 94) for b in os.urandom(20_000))
    assert not q.compression(noise, c)[3]
    assert not q.compression(prose[:9000] + "na " * 1500 + prose[9000:], c)[3]  # one stretch of it repeats


def test_limits_fall_with_length():
    sizes = [64 << k for k in range(15)]
    lows, highs = zip(*(q.limits(n) for n in sizes))
    assert list(highs) == sorted(highs, reverse=True) and all(a < b for a, b in zip(lows, highs))
    assert q.limits(0) == q.limits(1) and q.limits(1 << 30) == q.limits(1 << 20)


def test_chunks():
    assert q.chunks(b"x" * 2000) == [] and [len(x) for x in q.chunks(b"x" * 5000)] == [2048, 2952]
    assert [len(x) for x in q.chunks(b"x" * 5200)] == [2048, 2048, 1104]
    assert b"".join(q.chunks(bytes(range(256)) * 30)) == bytes(range(256)) * 30


#: Lengths as powers of two, lowest and highest ratio of prose: the operator's documented parameter. Fixed values.
BAND = [(6, 0.50, 1.20), (7, 0.52, 1.00), (8, 0.52, 0.90), (9, 0.50, 0.82), (10, 0.475, 0.76), (11, 0.455, 0.70), (12, 0.435, 0.66), (13, 0.415, 0.64), (14, 0.395, 0.62), (15, 0.38, 0.60), (16, 0.37, 0.60), (20, 0.33, 0.60)]


def band(size):
    import math

    at = math.log2(size)
    if at <= BAND[0][0]:
        return BAND[0][1:]
    for (a, low, high), (b, low2, high2) in zip(BAND, BAND[1:]):
        if at <= b:
            part = (at - a) / (b - a)
            return low + part * (low2 - low), high + part * (high2 - high)
    return BAND[-1][1:]


def test_verdict_by_its_definition(spark):
    """Ratios and ``kept`` by stretches of bytes and a plain interpolation."""
    rng = random.Random(7)
    long = data.prose(rng, 4000)
    noise = "".join(chr(33 + rng.randrange(94)) + (" " if k % 7 == 0 else "") for k in range(8000))
    cases = [None, "", "short", *[data.prose(rng, n) for n in (49, 50, 60, 200, 400, 900)], long, long[:9000] + " na" * 1500 + long[9000:], noise, "the same words over and over " * 300, long[:4000] + noise[:3000], long[:4096], long[:5119], long[:5121]]
    got = {r.doc_id: r for r in q.quality(spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")).collect()}
    seen = set()
    for i, t in enumerate(cases):
        raw = (t or "").encode()
        ratio = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
        parts = [raw[a : a + 2048] for a in range(0, len(raw), 2048)]
        if len(parts) > 1 and len(parts[-1]) < 1024:
            parts[-2:] = [parts[-2] + parts[-1]]
        parts = parts if len(parts) > 1 else []
        ratios = [(ratio(x), band(len(x))) for x in [raw, *parts] if x]
        inside = bool(raw) and all(low <= r <= high for r, (low, high) in ratios)
        n, _, _, _, repeats = plain(t or "")
        failed = n < 50 or 100 * repeats > 50 * n
        assert (got[i].kept, got[i].base_failed) == (inside and not failed, failed), i
        if raw:
            chunked = [r for r, _ in ratios[1:]] or [ratios[0][0]]
            assert (got[i].ratio, got[i].chunk_low, got[i].chunk_high) == (ratios[0][0], min(chunked), max(chunked))
        seen.add((inside, failed))
    assert seen == {(True, True), (True, False), (False, True), (False, False)}
