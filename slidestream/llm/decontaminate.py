"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index lookup, exact check.

For each benchmark item, windows of as many words as it has slide over every document. Their fingerprints are looked up in the items of
that size: 64 bits are cut into 4 blocks, and a fingerprint within ``radius`` of an item agrees with it in some block but for at most
``radius // 4`` bits. These flips are shared out: an item is filed under its block values with up to two of them, and a window asks for
its own with the rest, so every item in the radius is found. Windows that share no shingle with any item of their size have similarity 0,
so they aren't fingerprinted.

What the index finds is checked by the weighted Jaccard similarity of the two multisets of five-word shingles, for the windows found and
those around them. At a similarity of 0.8 a fingerprint differs in about 10 of 64 bits, and in more than 15 in a few of a hundred.

A benchmark of up to ``BROADCAST_BLOCKS`` index blocks is broadcast, and documents aren't shuffled. A larger one stays in the shared
folder: documents are sent to those blocks that they share a shingle with, and a task holds one block's index at a time.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidestream.llm.common import WordHashes, arrow_map, lower_words, shingle_hashes, texts
from slidestream.shared import broadcast_if_small, cut, new_folder

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4
#: Flips under which an item is filed; a window asks for the others that the radius allows in a block.
FILED_FLIPS = 2
#: Characters of benchmark text in an index; a larger benchmark is looked up block by block.
BLOCK_CHARS = 2_000_000
#: Blocks that may be broadcast, each with a pass over the documents (``contamination``) or one after the other (``decontaminate``).
BROADCAST_BLOCKS = 4
#: Tasks that share the documents of one block.
BLOCK_SPLITS = 16
_WINDOWS = 4096
_FILTER_BITS = 20


def bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")


def window_fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` shingles: bits that over half of them have."""
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits(hashes), axis=0, dtype=np.int32)))
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1, bitorder="little").view("<u8").ravel()


def similarities(hashes: np.ndarray, size: int, item: Counter) -> Iterator[float]:
    """Weighted Jaccard of each window of ``size`` shingles and the item: shared occurrences over all of them. A step costs two updates."""
    total, shared, own, row = sum(item.values()), 0, Counter(), hashes.tolist()
    for k, x in enumerate(row):
        own[x] += 1
        shared += own[x] <= item.get(x, 0)
        if k >= size:
            y = row[k - size]
            shared -= own[y] <= item.get(y, 0)
            own[y] -= 1
        if k >= size - 1:
            yield shared / (size + total - shared)


def _flips(most: int) -> np.ndarray:
    """All 16-bit patterns of up to so many bits."""
    return np.array([sum(1 << k for k in c) for n in range(most + 1) for c in combinations(range(16), n)], np.int64)


def _block_values(fps: np.ndarray) -> np.ndarray:
    """Each fingerprint's blocks, numbered so that values of different blocks differ."""
    return np.ascontiguousarray(fps).view("<u2").reshape(len(fps), BLOCKS).astype(np.int64) + (np.arange(BLOCKS) << 16)


@dataclass
class SizeClass:
    """The items of one size in words: fingerprints, shingles, and the items filed under each block value, sorted."""

    words: int
    items: list[int]
    fps: np.ndarray
    shingles: list[Counter]
    keys: np.ndarray
    near: np.ndarray
    asked: np.ndarray

    @classmethod
    def build(cls, words: int, items: list[int], hashes: list[np.ndarray], radius: int) -> SizeClass:
        fps = np.array([window_fingerprints(h, len(h))[0] for h in hashes], np.uint64)
        flips = radius // BLOCKS
        keys = _block_values(fps)[:, :, None] ^ _flips(min(flips, FILED_FLIPS))
        item = np.broadcast_to(np.arange(len(fps), dtype=np.int32)[:, None, None], keys.shape).ravel()
        order = np.argsort(keys.ravel(), kind="stable")
        return cls(words, items, fps, [Counter(h.tolist()) for h in hashes], keys.ravel()[order].astype(np.int32), item[order], _flips(max(0, flips - FILED_FLIPS)))

    def lookup(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        asked = (_block_values(fps)[:, :, None] ^ self.asked).reshape(-1).astype(np.int32)
        first, last = np.searchsorted(self.keys, asked, "left"), np.searchsorted(self.keys, asked, "right")
        n = last - first
        hit = np.flatnonzero(n)
        n, first = n[hit], first[hit]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair = np.unique(np.repeat(hit // (len(asked) // len(fps)), n) * len(self.fps) + self.near[at])
        w, k = pair // len(self.fps), pair % len(self.fps)
        distance = np.bitwise_count(fps[w] ^ self.fps[k])
        ok = distance <= radius
        return w[ok], k[ok], distance[ok]


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Stretches first to last, both ascending, joined where they meet."""
    cuts = np.flatnonzero(first[1:] > last[:-1] + 1) + 1
    return list(zip(first[np.concatenate(([0], cuts))].tolist(), last[np.concatenate((cuts - 1, [len(last) - 1]))].tolist()))


class Index:
    """Of a block of the benchmark: all shingles with the sizes of the items that hold them, and the size classes."""

    def __init__(self, items: list[tuple[int, str]], width: int = SHINGLE_WORDS, radius: int = RADIUS):
        self.width, self.radius = width, radius
        hasher, by_size = WordHashes(), defaultdict(list)
        for item, text in items:
            h = hasher.of(lower_words(text or ""))
            if len(h):
                by_size[len(h)].append((item, shingle_hashes(h, width)))
        self.sizes = {n: SizeClass.build(n, [i for i, _ in rows], [h for _, h in rows], radius) for n, rows in sorted(by_size.items())}
        self.own = {n: np.unique(np.concatenate([h for _, h in rows])) for n, rows in by_size.items()}
        self.widths: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]] = {}
        for w in {min(width, n) for n in by_size}:
            sizes_of: dict[int, list[int]] = defaultdict(list)
            for n, own in sorted(self.own.items()):
                if min(width, n) == w:
                    for x in own.tolist():
                        sizes_of[x].append(n)
            known = np.array(sorted(sizes_of), np.uint64)
            mask = np.zeros(1 << _FILTER_BITS, bool)
            mask[(known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.widths[w] = (known, mask, [tuple(sizes_of[x]) for x in known.tolist()])

    def _best(self, shingles: np.ndarray, n: int, m: int, a: int, b: int, similarity: float, best: dict[int, tuple[float, int, int, int]], words: int) -> None:
        """Windows of ``m`` shingles from a to b: those that the index finds, and around them, are compared with the item found."""
        of, found = self.sizes[n], defaultdict(list)
        for x in range(a, b + 1, _WINDOWS):
            to = min(x + _WINDOWS - 1, b)
            for w, k, d in zip(*(c.tolist() for c in of.lookup(window_fingerprints(shingles[x : to + m], m), self.radius))):
                found[k].append((x + w, d))
        for k, rows in found.items():
            at = np.array([p for p, _ in rows])
            for lo, hi in merged(np.maximum(at - m, a), np.minimum(at + m, b)):
                scores = np.fromiter(similarities(shingles[lo : hi + m], m, of.shingles[k]), np.float64, hi - lo + 1)
                top = int(scores.argmax())  # the earliest of equals
                item, score = of.items[k], float(scores[top])
                if score >= similarity and (item not in best or (score, -(lo + top)) > (best[item][0], -best[item][1])):
                    fp = window_fingerprints(shingles[lo + top : lo + top + m], m)[0]
                    best[item] = (score, lo + top, words, int(np.bitwise_count(fp ^ of.fps[k])))

    def matches(self, hashes: np.ndarray, similarity: float) -> Iterator[tuple[int, float, int, int, int]]:
        """(item, similarity, first word, words, distance) of the best window for each item that the document holds. Memory is a few numbers
        for each word, whatever repeats."""
        best: dict[int, tuple[float, int, int, int]] = {}
        for w, (known, mask, sizes) in self.widths.items():
            if len(hashes) < w:
                continue
            shingles = shingle_hashes(hashes, w)
            maybe = np.flatnonzero(mask[(shingles >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
            hit = known[at] == shingles[maybe]
            places, at = maybe[hit], at[hit]
            for n in sorted({n for k in np.unique(at).tolist() for n in sizes[k]}):
                m = min(n, len(hashes)) - w + 1  # shingles of a window
                own = self.own[n]
                p = places[own[np.minimum(np.searchsorted(own, shingles[places]), len(own) - 1)] == shingles[places]]
                last = len(shingles) - m
                for a, b in merged(np.clip(p - m + 1, 0, last), np.clip(p, 0, last)):
                    self._best(shingles, n, m, a, b, similarity, best, m + w - 1)
        for item, (score, s, words, d) in sorted(best.items()):
            yield item, score, s, words, d


# ---------------------------------------------------------------- tables


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()


def _blocks(items: DataFrame, block_chars: int) -> int:
    return -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)


def _block(n: int):
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")


def broadcast_blocks(items: DataFrame, n: int, radius: int) -> Iterator:
    """Indexes of the blocks, for broadcast; the driver holds one block at a time."""
    for k in range(n):
        yield items.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in items.where(_block(n) == k).collect()], radius=radius))


@lru_cache(maxsize=1)
def _stored_index(folder: str, block: int, radius: int) -> Index:
    """One in a worker process."""
    fs, base = pa.fs.FileSystem.from_uri(f"{folder}/block={block}")
    t = pa.parquet.read_table(base, filesystem=fs, columns=["item_id", "text"], partitioning=None)
    return Index(list(zip(t["item_id"].to_pylist(), t["text"].to_pylist())), radius=radius)


_MATCH = "doc_id long, item_id long, similarity double, first_word long, n_words long, distance int"


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[x.split()[0] for x in _MATCH.split(", ")])


def _shingles(rows: DataFrame, key: str, schema: str, widths: tuple[int, ...] | None) -> DataFrame:
    """``(key, s)``: the different shingles of each row's text; of an item in its own width, of a document in each of ``widths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for b in batches:
            keys, out = [], []
            for k, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                h = hasher.of(lower_words(t))
                own = [np.unique(shingle_hashes(h, w)) for w in widths or (SHINGLE_WORDS,) if len(h) and (widths is None or len(h) >= w)]
                for s in own:
                    out.append(s.view(np.int64))
                    keys.append((k, len(s)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, n in keys for _ in range(n)], pa.int32() if schema == "int" else pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *out]))], names=[key, "s"])

    return arrow_map(rows, run, f"{key} {schema}, s long")


def _routed(docs: DataFrame, items: DataFrame, n: int) -> tuple[DataFrame, str]:
    """``(digest, block)`` of the texts that share a shingle with a block, and the folder of the blocks.

    A shingle that a third of all texts hold meets each block that has it once for each different text; adaptive execution splits its join
    partition, or the shingles' table is broadcast behind a count.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "benchmark")
    items.withColumn("block", _block(n)).write.partitionBy("block").parquet(folder)
    stored = spark.read.schema("item_id long, text string, block int").parquet(folder)
    of_blocks = cut(_shingles(stored.select("block", "text"), "block", "int", None).distinct())
    of_texts = _shingles(docs.where("text is not null").select(F.md5("text").alias("digest"), "text").dropDuplicates(["digest"]), "digest", "string", tuple(range(1, SHINGLE_WORDS + 1)))
    return cut(of_texts.join(broadcast_if_small(of_blocks), "s").select("digest", "block").distinct()), folder


def _routed_matches(docs: DataFrame, items: DataFrame, n: int, similarity: float, radius: int) -> DataFrame:
    """``digest`` and the columns of a match but doc_id, for each different text."""
    routes, folder = _routed(docs, items, n)
    one = docs.where("text is not null").select(F.md5("text").alias("digest"), "text").dropDuplicates(["digest"])
    salt = F.pmod(F.xxhash64("digest"), F.lit(BLOCK_SPLITS))
    sent = one.join(routes, "digest").withColumn("salt", salt).repartition("block", "salt").sortWithinPartitions("block")
    schema = "digest string, " + _MATCH.split(", ", 1)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for b in batches:
            found = [(d, *m) for d, t, k in zip(*(c.to_pylist() for c in b.columns)) for m in _stored_index(folder, k, radius).matches(hasher.of(lower_words(t)), similarity)]
            if found:
                out = _batch([(0, *x[1:]) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), *out.columns[1:]], names=[x.split()[0] for x in schema.split(", ")])

    return arrow_map(sent.select("digest", "text", "block"), run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_chars: int = BLOCK_CHARS, most_broadcast: int = BROADCAST_BLOCKS) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words, distance)``: each document with each item that one of its windows holds.

    The window given is the most similar one, the earliest of equals. Words are lower-cased (A-Z) and cut at ASCII white space. Texts
    of fewer words than the item are one window; items of fewer than five words are one shingle. Null or empty texts and items, and
    items without an id, match nothing; repeated rows give repeated results; other columns are ignored; an empty table on either side
    gives no rows. Texts may be of any length and repeat what they will: time and memory are linear in them.
    """
    spark, items = docs.sparkSession, _items(benchmark)
    rows, n = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _blocks(items, block_chars)
    if n > most_broadcast:
        found = _routed_matches(rows, items, n, similarity, radius)
        return rows.where("text is not null").select("doc_id", F.md5("text").alias("digest")).join(found, "digest").drop("digest")
    out = None
    for index in broadcast_blocks(items, n, radius):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hasher = WordHashes()
            for b in batches:
                found = [(d, *m) for d, t in zip(b.column(0).to_pylist(), texts(b.column(1))) for m in index.value.matches(hasher.of(lower_words(t)), similarity)]
                if found:
                    yield _batch(found)

        part = arrow_map(rows, run, _MATCH)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], _MATCH) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_chars: int = BLOCK_CHARS, most_broadcast: int = BROADCAST_BLOCKS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no window holds a benchmark item (see ``contamination``).

    Rows with a null or empty text stay, as do repeated rows; with an empty benchmark all rows stay; an empty table gives no rows.
    """
    at, items = docs.columns.index("text"), _items(benchmark)
    n = _blocks(items, block_chars)
    if n > most_broadcast:
        dirty = _routed_matches(docs.select("text"), items, n, similarity, radius).select(F.col("digest").alias("_digest")).distinct()
        return docs.join(dirty, F.md5(docs["text"]) == dirty["_digest"], "left_anti")
    for index in broadcast_blocks(items, n, radius):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hasher = WordHashes()
            for b in batches:
                clean = [next(index.value.matches(hasher.of(lower_words(t)), similarity), None) is None for t in texts(b.column(at))]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = arrow_map(docs, run, docs.schema)
    return docs


_WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"
#: The same pairs without fingerprints: every window that shares a shingle with an item of its size.
SQL = f"""
WITH i AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
its AS (SELECT item_id, n, k, s, count(*) AS c FROM (SELECT item_id, n, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM i, unnest(range(1, n - k + 2)) AS _(p)) GROUP BY ALL),
d AS (SELECT doc_id, w, len(w) AS len FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL)),
ds AS (SELECT doc_id, len, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM i), unnest(range(1, len - k + 2)) AS _(p)),
windows AS (
  SELECT DISTINCT doc_id, item_id, k, least(n, len) - k + 1 AS m, least(greatest(p - b, 1), len - least(n, len) + 1) AS start
  FROM ds JOIN its USING (k, s), unnest(range(0, least(n, len) - k + 1)) AS _(b)),
inside AS (SELECT doc_id, item_id, start, m, ds.s, count(*) AS c FROM windows JOIN ds USING (doc_id, k) WHERE p BETWEEN start AND start + m - 1 GROUP BY ALL),
shared AS (SELECT doc_id, item_id, start, any_value(m) AS m, sum(least(inside.c, its.c)) AS shared FROM inside JOIN its USING (item_id, s) GROUP BY ALL),
scored AS (SELECT *, shared / (m + (SELECT sum(c) FROM its WHERE its.item_id = shared.item_id) - shared) AS similarity FROM shared)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(start, (-similarity, start)) - 1 AS BIGINT) AS first_word,
       CAST(any_value(m) + (SELECT k FROM i WHERE i.item_id = scored.item_id) - 1 AS BIGINT) AS n_words
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
