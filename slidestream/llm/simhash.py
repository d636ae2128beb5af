"""Near duplicates by SimHash: fingerprints, bit-sliced Hamming comparison inside key buckets, components.

Two fingerprints that differ in at most ``radius`` of 64 bits agree on at least ``BLOCKS - radius`` of ``BLOCKS`` bit blocks, so they
meet in the bucket of one of the C(BLOCKS, BLOCKS - radius) block combinations: no pair is missed. Buckets over ``bucket_rows`` are cut
into parts, and each pair of parts is compared on its own, so the largest task stays bounded whatever share of rows one bucket has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidestream.llm.common import arrow_map, lower_words, quoted, texts
from slidestream.llm.components import connected_components
from slidestream.shared import broadcast_if_small, cut

SHINGLE_WORDS = 3
RADIUS = 3
BLOCKS = 6
#: Fingerprints of a bucket that one task compares with each other; more are split over tasks.
BUCKET_ROWS = 4096
_HASH = xxhash.xxh64_intdigest
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """A bit is set if over half of the shingles' hashes (repeats included) have it; 0 for a text without words."""
    words = lower_words(text)
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return _HASH(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    count = n - width + 1
    hashes = np.fromiter([_HASH(joined[a:b], 42) for a, b in zip(starts[:count].tolist(), ends[width - 1 :].tolist())], np.uint64, count)
    rows = -(-count // 255)
    padded = np.zeros(rows * 255, np.uint64)
    padded[:count] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(rows, 255, 8), axis=2, bitorder="little")
    ones = bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Of each choice of ``blocks - radius`` blocks, the bits they hold."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 x words: bit k of all fingerprints, 64 fingerprints to a word."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _within(planes, take, start: np.ndarray, cells: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save count over 64 bit planes. ``take(k, alive)`` gives plane ``k``'s difference words of the cells in ``alive``.

    Returns the cells left and, for each, the word whose bits mark distances of at most ``radius``. A cell is abandoned as soon as
    all 64 of its counts are beyond the counters' range.
    """
    levels = max(1, radius.bit_length())
    alive = np.arange(cells)
    over = start.copy()
    counts = [np.zeros(cells, np.uint64) for _ in range(levels)]
    for k in range(64):
        carry = take(k, alive)
        for level in range(levels):
            kept = counts[level]
            counts[level], carry = kept ^ carry, kept & carry
        over |= carry
        if k % 8 == 7:
            left = np.flatnonzero(over != _ALL)
            if len(left) < len(alive):
                alive, over, counts = alive[left], over[left], [c[left] for c in counts]
            if not len(alive):
                break
    greater = np.zeros(len(alive), np.uint64)
    equal = np.full(len(alive), _ALL)
    for level in reversed(range(levels)):  # bit-sliced comparison of the counts with the radius
        if radius >> level & 1:
            equal &= counts[level]
        else:
            greater |= equal & counts[level]
            equal &= ~counts[level]
    return alive, ~(over | greater)


def _bits_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, bit = np.nonzero(np.unpackbits(words.view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little"))
    return rows, bit


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS, chunk_cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with ``hamming(left[i], right[j]) <= radius``, a chunk of ``left`` at a time."""
    planes = _planes(right)
    words = planes.shape[1]
    idle = np.zeros(words, np.uint64)  # bits past the end count as too far
    if len(right) % 64:
        idle[-1] = _ALL << np.uint64(len(right) % 64)
    step = max(1, chunk_cells // words)
    for at in range(0, len(left), step):
        part = left[at : at + step]
        qi, wi = np.repeat(np.arange(len(part)), words), np.tile(np.arange(words), len(part))
        signs = [(np.uint64(0) - ((part >> np.uint64(k)) & np.uint64(1))) for k in range(64)]
        alive, marks = _within(planes, lambda k, a: planes[k][wi[a]] ^ signs[k][qi[a]], idle[wi], len(qi), radius)
        rows, bit = _bits_of(marks)
        yield at + qi[alive[rows]], 64 * wi[alive[rows]] + bit


def _near_shifted(fps: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the index pairs (i, j) are near: their differences as bit planes, 64 pairs to a word."""
    planes = _planes(fps[i] ^ fps[j])
    alive, marks = _within(planes, lambda k, a: planes[k][a], np.zeros(planes.shape[1], np.uint64), planes.shape[1], radius)
    rows, bit = _bits_of(marks)
    at = 64 * alive[rows] + bit
    return at[at < len(i)]


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Least label over the pairs, repeated until nothing changes."""
    while len(i):
        low = np.minimum(labels[i], labels[j])
        moved = (labels[i] != low) | (labels[j] != low)
        if not moved.any():
            return
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        while (up := labels[labels]) is not None and (up != labels).any():
            labels[:] = up


def forest(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what is near inside each group: index pairs (i, root). ``group`` is sorted.

    ``side`` is 0 where all of a group is compared with all; groups that are a pair of two different parts have sides 1 and 2, and
    only rows of different sides are compared.
    """
    labels = np.arange(len(fps))
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes = np.diff(edges)
    of_row = np.repeat(sizes, sizes)
    little = np.flatnonzero((of_row <= small) & (of_row > 1))
    for shift in range(1, small):
        i = little[(little + shift < len(fps))]
        i = i[group[i] == group[np.minimum(i + shift, len(fps) - 1)]]
        i = i[(side[i] == 0) | (side[i] != side[i + shift])]
        if not len(i):
            if not (of_row[little] > shift).any():
                break
            continue
        near = _near_shifted(fps, i, i + shift, radius)
        _join(labels, i[near], i[near] + shift)
    for k in np.flatnonzero(sizes > small):
        at, end = edges[k], edges[k + 1]
        if side[at] == 0:
            parts = [(np.arange(at, end), np.arange(at, end))]
        else:
            rows = np.arange(at, end)
            parts = [(rows[side[at:end] == 1], rows[side[at:end] == 2])]
        for one, other in parts:
            if len(one) and len(other):
                for i, j in near_pairs(fps[one], fps[other], radius):
                    _join(labels, one[i], other[j])
    i = np.flatnonzero(labels != np.arange(len(fps)))
    return i, labels[i]


def links(distinct_fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints of ``distinct_fps(fp)`` whose closure is that of all pairs within ``radius``."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for t, m in enumerate(masks(blocks, radius))]))
    rows = distinct_fps.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    hot = cut(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("t", "key", F.ceil(F.col("n") * 2 / bucket_rows).cast("int").alias("parts")))
    rows = rows.join(broadcast_if_small(hot), ["t", "key"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("other", other).select(
        "t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
            t, key, p, q, side, fp = (table.column(k).to_numpy() for k in range(6))
            new = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            group = np.concatenate(([0], np.cumsum(new)))
            i, root = forest(fp.view(np.uint64), group, side, radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[root])], names=["a", "b"])

        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < 32_768:
                continue
            table = pa.Table.from_batches(held)
            last = [table.column(k)[-1].as_py() for k in range(4)]
            same = np.ones(count, bool)
            for k in range(4):
                same &= table.column(k).to_numpy() == last[k]
            whole = count - int(same.sum())  # the last group may go on in the next batch
            if whole:
                yield from compare(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            count -= whole
        if count:
            yield from compare(pa.Table.from_batches(held))

    dealt = rows.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q")
    return arrow_map(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``; ``component_id`` is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows give repeated results. A null doc_id is
    carried and names no component unless the component has no other id (then null). Other columns are ignored. An empty table
    gives no rows.
    """
    own = cut(fingerprints(docs))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = connected_components(links(distinct.select("fp"), radius, blocks, bucket_rows))
    grouped = distinct.join(label, distinct.fp == label.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = cut(grouped.groupBy("component").agg(F.min("least").alias("component_id")))  # so that a large component's rows can be split
    of_fp = grouped.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return own.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the least of their component; of rows that share a doc_id one stays; rows without one stay.

    Null and empty texts are duplicates of each other, as their fingerprint is the same. All columns stay, whatever their names; an empty
    table gives no rows. The joins of documents to fingerprints and to kept ids have a hot key where a third of all texts is one: adaptive
    execution, which must be on, splits it.
    """
    kept = near_duplicates(docs, **options).where("doc_id = component_id").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rank = "_" * (1 + max(map(len, docs.columns)))  # no column has this name
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).drop(rank)
    return named.select(*map(quoted, docs.columns)).union(docs.where("doc_id is null"))
