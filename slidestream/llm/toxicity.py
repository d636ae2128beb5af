"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself, its first four and five and its last four characters. Filters of one, two and three
words slide over the text, the greatest response of each is kept, and a logistic layer turns them into a score, which is calibrated on
rows that training didn't see. For every language the rows of that fold give a threshold; language is no input of the score.

Training takes every labelled row outside the held-out third, whole, of whatever length. Rows are dealt to shards by the hash of their id, and
tasks train a model for each shard from a common start; the mean of their changes is the next start, ``ROUNDS`` times. A feature's change is
weighted by the shard's documents that have it. Counts of features and of scores are sums over all shards, which tasks add up in a tree, so the
driver gets one sum. Scoring is one pass without a shuffle; the model (``BUCKETS`` x ``DIM`` floats) is broadcast.
"""

from __future__ import annotations

import copy
import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidestream.llm.common import arrow_map, texts
from slidestream.shared import BROADCAST_ROWS, cut

#: Rows of a shard, and the shards beyond which rows of a shard grow instead.
SHARD_ROWS = 6000
MAX_SHARDS = 1024
#: Characters that a training task holds at a time; it takes larger shards portion by portion.
MAX_CHARS = 24_000_000
THRESHOLD = 0.7
BUCKETS = 1 << 17
DIM = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Training passes over few rows so often that they are this many in all, over any row at least ``TURNS`` times.
PASSES = 72_000
TURNS = 6
#: Times that shards start anew from their mean.
ROUNDS = 3
#: Spread of first embeddings, and their learning rate.
INIT, RATE = 0.02, 0.1
#: Share of a word's features that a training step doesn't see.
DROP = 0.5
#: Documents of the fitted rows that a feature must occur in; rarer and unseen ones have no embedding.
MIN_DOCS = 3
_EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_=+/\\~^`"
_TAIL = max(WIDTHS) - 1
#: Words of a text that are pooled at a time.
_CHUNK = 50_000
_CACHE = 200_000
#: Logits are counted in steps of 1 / _STEPS between -_SPAN and _SPAN.
_STEPS, _SPAN = 1024, 64
#: Cuts that a language may have.
_CUTS = np.arange(0.5, 0.91, 0.05)
#: Sums that a task adds up.
_FAN = 16


def features(word: bytes) -> list[int]:
    """Buckets of a word; none for punctuation alone."""
    w = word.decode("utf-8", "replace").lower().encode().strip(_EDGE).decode("utf-8", "replace")
    if not w:
        return []
    return [xxhash.xxh64_intdigest(x) % BUCKETS for x in ("w" + w, "4" + w[:4], "5" + w[:5], "s" + w[-4:])]


class Words(dict):
    """Rows of words in a table of features; row 0 is padding and stays empty."""

    def __init__(self) -> None:
        self.table = [[-1, -1, -1, -1]]

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.table)
        self.table.append(features(word) or self.table[0])
        return k


def layout(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows, starts, documents) of segments: each has its windows' first words and ``_TAIL`` rows of what follows or padding."""
    rows, starts, owner, at = [], [], [], 0
    pad = np.zeros(_TAIL, np.int64)
    for k, ids in enumerate(docs):
        ids = np.concatenate((ids if len(ids) else pad[:1], pad))
        for a in range(0, len(ids) - _TAIL, _CHUNK):
            part = ids[a : min(a + _CHUNK, len(ids) - _TAIL) + _TAIL]
            rows.append(part)
            starts.append(at)
            owner.append(k)
            at += len(part)
    return np.concatenate(rows), np.array(starts), np.array(owner)


def parts(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``layout`` in parts of a few chunks, so that what is computed of them is bounded."""
    rows, starts, owner = layout(docs)
    ends = np.append(starts[1:], len(rows))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 4 * _CHUNK, "right")))
        yield rows[starts[at] : ends[to - 1]], starts[at:to] - starts[at], owner[at:to]
        at = to


@dataclass
class Model:
    """``scale`` and ``shift`` calibrate; ``thresholds`` are by language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(table), DIM), np.float32)
        for k in range(table.shape[1]):
            has = table[:, k] >= 0
            out[has] += self.embedding[table[has, k]]
        return out

    def responses(self, x: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each width: filter responses at every row (rows that no window starts at are -inf); and their maxima by segment."""
        outs = []
        ends = np.append(starts[1:], len(x))
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            out = np.full((len(x), FILTERS), -np.inf, np.float32)
            n = len(x) - w + 1
            if n > 0:
                out[:n] = b
                for k in range(w):
                    out[:n] += x[k : n + k] @ f[k]
            for k in range(_TAIL):
                out[ends - 1 - k] = -np.inf
            outs.append(out)
        return outs, np.concatenate([np.maximum.reduceat(o, starts, axis=0) for o in outs], axis=1)

    def logits(self, vectors: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
        pooled = np.full((len(docs), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for rows, starts, owner in parts(docs):
            np.maximum.at(pooled, owner, self.responses(vectors[rows], starts)[1])
        return np.maximum(pooled, 0) @ self.dense + self.offset

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z.astype(np.float64) + self.shift, -30, 30)))


def _new_model(rng: np.random.Generator) -> Model:
    f = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(rng.normal(0, INIT, (BUCKETS, DIM)).astype(np.float32), f, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)


class _Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.m, self.v, self.t = value, rate, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        self.value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-7)


#: Named sums over rows; those of several shards are added by name.
Sums = dict[str, np.ndarray]


def _add(a: Sums, b: Sums) -> Sums:
    for k, v in b.items():
        a[k] = a[k] + v if k in a else v
    return a


@dataclass
class _Portion:
    """Labelled rows that a task holds: their words' rows in ``table``, and which rows ``held`` are for calibration, not for fitting."""

    docs: list[np.ndarray]
    table: np.ndarray
    labels: np.ndarray
    langs: list[str]
    held: np.ndarray

    def of(self, which: np.ndarray) -> list[np.ndarray]:
        return [self.docs[k] for k in np.flatnonzero(which)]


def _packed(a: np.ndarray) -> bytes:
    """32-bit numbers compressed, lowest bytes first."""
    return zstandard.compress(a.astype("<i4").reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def encoded(batch: list[str]) -> Iterator[tuple[bytes, bytes]]:
    """Of each text: the features of its different words, and its words as places among these."""
    words = Words()
    docs = [np.fromiter(map(words.__getitem__, t.encode("utf-8").split()), np.int32) for t in batch]
    table = np.array(words.table, np.int32)
    for ids in docs:
        own, back = np.unique(ids, return_inverse=True)
        yield _packed(table[own]), _packed(back)


def portions(rows: Iterable[tuple[int, str, int, bytes, bytes]], max_chars: int) -> Iterator[_Portion]:
    """(label, language, characters, features, words) of a shard's rows in order, all of them, by portions of about ``max_chars``; each
    fifth row calibrates."""
    padding = np.full((1, 4), -1, np.int32)
    kept, tables, docs, size, n_words = [], [padding], [], 0, 1

    def done() -> _Portion:
        n, labels, langs = zip(*kept)
        return _Portion(docs, np.concatenate(tables), np.array(labels, np.float64), list(langs), np.array(n) % 5 == 4)

    for n, (label, lang, chars, features_, words) in enumerate(rows):
        if kept and size + chars > max_chars:
            yield done()
            kept, tables, docs, size, n_words = [], [padding], [], 0, 1
        tables.append(_unpacked(features_).reshape(-1, 4))
        docs.append(_unpacked(words) + np.int32(n_words))
        n_words += len(tables[-1])
        kept.append((n, label, lang))
        size += chars
    if kept:
        yield done()


@dataclass
class _Start:
    """What every shard starts a round from: the model, Adagrad's squares by row of the embedding, the features that are common enough, and
    whether calibration has rows of its own."""

    model: Model
    squares: np.ndarray
    common: np.ndarray
    apart: bool


def _documents_with(docs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Documents of each feature."""
    seen = np.zeros(BUCKETS, np.int64)
    for ids in docs:
        own = table[np.unique(ids)]
        seen[np.unique(own[own >= 0])] += 1
    return seen


def _tally(_: None, __: int, shard: Iterator[_Portion]) -> Sums:
    """Rows of both labels, fitted and held, and the documents of each feature among them."""
    out: Sums = {}
    for p in shard:
        for kind, which in (("fit", ~p.held), ("held", p.held)):
            _add(out, {kind: np.array([np.sum(p.labels[which] != 1), np.sum(p.labels[which] == 1)], np.int64), kind + " seen": _documents_with(p.of(which), p.table)})
    return out


def _pooled(model: Model, docs: list[np.ndarray], table: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The greatest response of each filter, and the features of the first window that gives it."""
    n = FILTERS * len(WIDTHS)
    pooled = np.full((len(docs), n), -np.inf, np.float32)
    windows = np.full((len(docs), n, max(WIDTHS), table.shape[1]), -1, table.dtype)
    for rows, starts, owner in parts(docs):
        kept = table[rows]
        kept[rng.random(kept.shape) < DROP] = -1  # features are dropped, so that no word is known by its full form alone
        outs, tops = model.responses(model.vectors(kept), starts)
        own = np.full_like(pooled, -np.inf)
        np.maximum.at(own, owner, tops)
        segment_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        place = np.zeros((len(docs), n), np.int64)
        for c, out in enumerate(outs):
            r, k = np.nonzero(out == own[:, c * FILTERS : (c + 1) * FILTERS][owner[segment_of]])
            place[owner[segment_of[r[::-1]]], c * FILTERS + k[::-1]] = r[::-1]  # the first of equals
        d, k = np.nonzero(own > pooled)
        at = np.minimum(place[d, k][:, None] + np.arange(max(WIDTHS)), len(rows) - 1)
        windows[d, k] = kept[at]
        pooled[d, k] = own[d, k]
    return pooled, windows


def _advance(start: _Start, passes: int, rng: np.random.Generator, shard: Iterator[_Portion]) -> Sums:
    """Fits on one shard from ``start``; gives its changes, weighted."""
    model, squares = copy.deepcopy(start.model), start.squares.copy()
    params = (*model.filters, *model.bias, model.dense)
    dense = [_Adam(p, 0.01) for p in params]
    seen, n_rows = np.zeros(BUCKETS, np.int64), 0
    for portion in shard:
        fit = ~portion.held if start.apart else np.ones(len(portion.docs), bool)
        docs, labels = portion.of(fit), portion.labels[fit]
        seen += _documents_with(docs, portion.table)
        n_rows += len(docs)
        table = np.where((portion.table >= 0) & start.common[portion.table], portion.table, np.int32(-1))
        for _ in range(passes):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), 64):
                batch = order[at : at + 64]
                pooled, windows = _pooled(model, [docs[k] for k in batch], table, rng)
                active = np.maximum(pooled, 0)
                p = 1 / (1 + np.exp(-np.clip(active @ model.dense + model.offset, -30, 30)))
                dz = ((p - labels[batch]) / len(batch)).astype(np.float32)
                dpool = dz[:, None] * model.dense * (pooled > 0)
                grads_f, grads_b, touched, values = [], [], [], []
                for c, (w, f) in enumerate(zip(WIDTHS, model.filters)):
                    cols = slice(c * FILTERS, (c + 1) * FILTERS)
                    g = dpool[:, cols]
                    grad = np.zeros_like(f)
                    for j in range(w):
                        own = windows[:, cols, j]
                        near = model.vectors(own.reshape(-1, own.shape[2])).reshape(*own.shape[:2], DIM)
                        grad[j] = np.einsum("bfd,bf->df", near, g)
                        dx = g[:, :, None] * f[j].T[None]
                        for n in range(own.shape[2]):
                            has = (own[:, :, n] >= 0) & (g != 0)
                            touched.append(own[:, :, n][has])
                            values.append(dx[has])
                    grads_f.append(grad)
                    grads_b.append(g.sum(axis=0))
                for opt, grad in zip(dense, (*grads_f, *grads_b, active.T @ dz)):
                    opt.step(grad)
                model.offset -= 0.05 * float(dz.sum())
                which, back = np.unique(np.concatenate(touched), return_inverse=True)
                if len(which):
                    total = np.zeros((len(which), DIM), np.float32)
                    np.add.at(total, back, np.concatenate(values))
                    squares[which] += (total**2).mean(axis=1)
                    model.embedding[which] -= RATE * total / np.sqrt(squares[which])[:, None]
    base, weight = start.model, seen.astype(np.float32)
    out = {"rows": np.array(n_rows), "seen": seen, "offset": np.array((model.offset - base.offset) * n_rows)}
    out |= {"embedding": (model.embedding - base.embedding) * weight[:, None], "squares": (squares - start.squares) * weight}
    return out | {f"dense {k}": (p.astype(np.float64) - q) * n_rows for k, (p, q) in enumerate(zip(params, (*base.filters, *base.bias, base.dense)))}


def _move(start: _Start, change: Sums) -> None:
    """To the weighted mean of what the shards reached."""
    m, rows = start.model, int(change["rows"])
    weight = np.maximum(change["seen"], 1).astype(np.float32)
    m.embedding += change["embedding"] / weight[:, None]
    start.squares += change["squares"] / weight
    m.offset += float(change["offset"]) / rows
    for k, p in enumerate((*m.filters, *m.bias, m.dense)):
        p += (change[f"dense {k}"] / rows).astype(np.float32)


def _logits(start: _Start, shard: Iterator[_Portion]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Logits, labels and languages of the rows that calibrate."""
    for p in shard:
        held = np.flatnonzero(p.held) if start.apart else np.arange(len(p.docs))
        vectors = start.model.vectors(p.table)
        for a in range(0, len(held), 256):
            some = held[a : a + 256]
            yield start.model.logits(vectors, [p.docs[k] for k in some]), p.labels[some], np.array(p.langs, object)[some]


def _histogram(start: _Start, _: int, shard: Iterator[_Portion]) -> Sums:
    """Rows of each label by logit."""
    out = np.zeros((2, 2 * _SPAN * _STEPS + 1), np.int64)
    for z, y, _ in _logits(start, shard):
        np.add.at(out, ((y == 1).astype(int), np.rint((np.clip(z, -_SPAN, _SPAN) + _SPAN) * _STEPS).astype(np.int64)), 1)
    return {"rows": out}


def _by_language(start: _Start, _: int, shard: Iterator[_Portion]) -> Sums:
    """Of each language: rows of both labels, then for each label its rows at or above each cut."""
    out: Sums = {}
    for z, y, langs in _logits(start, shard):
        s = start.model.score(z)
        for lang in sorted({x for x in langs if x is not None}):
            own = langs == lang
            above = s[own][:, None] >= _CUTS
            of = [y[own] != 1, y[own] == 1]
            _add(out, {lang: np.concatenate(([o.sum() for o in of], *(above[o].sum(axis=0) for o in of))).astype(np.int64)})
    return out


def _best(true: np.ndarray, false: np.ndarray, positives: int, cuts: np.ndarray) -> np.ndarray:
    """The cuts with the best F1, given the rows of either label at or above each."""
    f1 = 2 * true / np.maximum(1, true + false + positives)
    return cuts[f1 >= f1.max() - 1e-12]


def _calibrate(model: Model, z: np.ndarray, negatives: np.ndarray, positives: np.ndarray) -> None:
    """Platt scaling with smoothed targets, moved so that the default threshold is the cut with the best F1 of all rows (the middle one of
    equals). ``z`` ascends; each has so many rows of label 0 and 1."""
    pos, neg = positives.sum(), negatives.sum()
    rows = positives + negatives
    target = positives * (pos + 1) / (pos + 2) + negatives / (neg + 2)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = rows * np.maximum(p * (1 - p), 1e-9)
        d = rows * p - target
        h = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-6]])
        step = np.linalg.solve(h, np.array([np.sum(d * z) + 1e-3 * (a - 1), np.sum(d)]))
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    model.scale, model.shift = max(float(a), 1e-3), float(b)
    logit = model.scale * z + model.shift
    above = [np.cumsum(n[::-1])[::-1][1:] for n in (positives, negatives)]
    best = _best(*above, pos, (logit[1:] + logit[:-1]) / 2) if len(logit) > 1 else logit
    model.shift += float(np.log(THRESHOLD / (1 - THRESHOLD)) - (best[0] + best[-1]) / 2)


def _learn(total: Callable[[Callable, object], Sums], shards: int, seed: int) -> Model:
    """A model of all rows; ``total(step, start)`` is the sum of ``step(start, shard, portions)`` over shards. Without rows of both labels
    the score is the smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    model = _new_model(rng)
    tally = total(_tally, None)
    fit, held = (tally.get(k, np.zeros(2, np.int64)) for k in ("fit", "held"))
    rows = fit + held
    if not rows.all():
        model.dense[:] = 0
        p = (rows[1] + 0.5) / (rows.sum() + 1) if rows.any() else 0.0
        model.offset = float(np.log(p / (1 - p))) if p else -30.0
        return model
    apart = bool(fit.all() and held.all())
    common = tally["fit seen"] + (0 if apart else tally["held seen"]) >= MIN_DOCS
    model.embedding[~common] = 0
    start = _Start(model, np.full(BUCKETS, 1e-3, np.float32), common, apart)
    rounds = ROUNDS if shards > 1 else 1
    passes = -(-max(TURNS, -(-PASSES // int(fit.sum() if apart else rows.sum()))) // rounds)
    for k in range(rounds):
        _move(start, total(_round(passes, seed, k), start))
    counts = total(_histogram, start)["rows"]
    found = np.flatnonzero(counts.any(axis=0))
    _calibrate(model, found / _STEPS - _SPAN, *counts[:, found])
    for lang, n in sorted(total(_by_language, start).items()):
        neg, pos, (false, true) = n[0], n[1], n[2:].reshape(2, -1)
        if pos >= 10 and neg >= 10:
            cuts = _best(true, false, pos, _CUTS)
            model.thresholds[lang] = round(float(cuts[np.argmin(np.abs(cuts - THRESHOLD))]), 2)  # the nearest to the default
    return model


def _round(passes: int, seed: int, k: int) -> Callable:
    return lambda start, shard, rows: _advance(start, passes, np.random.default_rng([seed, k, shard]), rows)


def train_rows(rows: list[tuple[str, int, str]], seed: int = 7, max_chars: int = MAX_CHARS) -> Model:
    """A model of (text, label, language) rows, as one shard."""
    own = [(y, lang, len(t or ""), *next(encoded([t or ""]))) for t, y, lang in rows]
    return _learn(lambda step, start: step(start, 0, portions(own, max_chars)), 1, seed)


class Scorer:
    """Scores texts; keeps the vectors of words seen."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.words = Words()
        self.vectors = np.zeros((1, DIM), np.float32)

    def scores(self, batch: list[str]) -> np.ndarray:
        out, group, size = [], [], 0
        for t in batch:
            group.append(np.fromiter(map(self.words.__getitem__, t.encode("utf-8").split()), np.int64))
            size += len(group[-1])
            if size > 2 * _CHUNK:
                out.append(self._group(group))
                group, size = [], 0
        if group:
            out.append(self._group(group))
        if len(self.words) > _CACHE:
            self._clear()
        return self.model.score(np.concatenate(out)) if out else np.zeros(0)

    def _group(self, docs: list[np.ndarray]) -> np.ndarray:
        new = self.words.table[len(self.vectors) :]
        if new:
            self.vectors = np.concatenate((self.vectors, self.model.vectors(np.array(new, np.int64))))
        return self.model.logits(self.vectors, docs)


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _total(table: DataFrame, shards: int, max_chars: int, step: Callable, start: object) -> Sums:
    """The sum of ``step`` over the shards of ``table``, added up in tasks by ``_FAN`` at a time in the order of shards."""
    shared = table.sparkSession.sparkContext.broadcast(start)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))

    def row(k: int, sums: Sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(sums)], pa.binary())], names=["k", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, own in itertools.groupby(rows(batches), lambda r: r[0]):
            yield row(k, step(shared.value, k, portions((r[1:] for r in own), max_chars)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, own in itertools.groupby(rows(batches), lambda r: r[0]):
            out: Sums = {}
            for _, sums in own:
                _add(out, pickle.loads(sums))
            yield row(k, out)

    sums, n = arrow_map(table, run, "k int, sums binary"), shards
    while n > 1:
        n = -(-n // _FAN)
        up = sums.select(F.floor(F.col("k") / _FAN).cast("int").alias("up"), "sums", "k").repartitionById(n, "up")
        sums = arrow_map(up.sortWithinPartitions("up", "k").select("up", "sums"), add, "k int, sums binary")
    found = sums.collect()  # one row at most, of about BUCKETS * DIM * 4 bytes
    shared.unpersist()
    return pickle.loads(found[0].sums) if found else {}


def train(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, max_chars: int = MAX_CHARS, seed: int = 7) -> Model:
    """Fits on all labelled rows outside the held-out third, whatever the partitions: in one task for each shard of about ``shard_rows``,
    which holds ``max_chars`` characters, or one text, at a time.

    Labels that repeat for an id count as 1 if any is, and rows that repeat count once; ids, labels and texts that are null are passed over;
    an empty table gives a model with one score for all. The rows' words are shuffled and kept in the shared folder, as features; beyond
    ``BROADCAST_ROWS`` labels the texts outside the held-out third are shuffled to meet them.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = list(encoded(texts(b.column(0))))
            more = [pa.array([x[k] for x in both], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *more], names=[*b.schema.names[1:], "features", "words"])

    known = cut(labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = known.count()
    shards = min(MAX_SHARDS, max(1, -(-n // shard_rows)))
    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null").where(~held_out(F.col("doc_id"))).withColumn("x", F.xxhash64("text"))
    joined = rows.join(F.broadcast(known) if n <= BROADCAST_ROWS else known.hint("shuffle_hash"), "doc_id")
    once = joined.groupBy("doc_id", "x").agg(F.first("text").alias("text"), F.min("lang").alias("lang"), F.first("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    rows = once.select("text", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "x", "toxic", "lang", F.length("text").alias("chars"))
    dealt = arrow_map(rows, encode, "shard int, h long, x long, toxic int, lang string, chars int, features binary, words binary").repartitionById(shards, "shard")
    table = cut(dealt.sortWithinPartitions("shard", "h", "x").drop("h", "x"))
    return _learn(lambda step, start: _total(table, shards, max_chars, step, start), shards, seed)


def _judged(model, score: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    limit = np.array([model.thresholds.get(x, THRESHOLD) for x in langs], np.float64)
    return limit, score >= limit


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted, lang_threshold, rejected)`` of each row; ``rejected`` is by the language's threshold.

    A null or empty text is scored as a text without words; a null or unknown language has the default threshold. Repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows. Texts of any length are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            score = scorer.scores(texts(b.column(1)))
            limit, rejected = _judged(shared.value, score, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(limit), pa.array(rejected)], names=["doc_id", "score", "predicted", "lang_threshold", "rejected"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", "lang"), run, "doc_id long, score double, predicted int, lang_threshold double, rejected boolean")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns as they are.

    A null or empty text is scored as one without words and, as such, stays unless the model rejects it; repeated rows share their verdict;
    an empty table gives no rows. Texts of any length are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            rejected = _judged(shared.value, scorer.scores(texts(b.column(text))), b.column(lang).to_pylist())[1]
            yield b.filter(pa.array(~rejected))

    return arrow_map(docs, run, docs.schema)
