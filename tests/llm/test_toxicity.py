import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidestream.llm import toxicity as tx
from tests.llm import data

BAD = {"en": ["idiot", "scum", "moron"], "de": ["loweiung", "loweischaft", "loweient"]}


def labelled(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(["en", "de"])
        words = data.prose(rng, rng.randint(20, 120)).split(" ")
        bad = rng.random() < 0.3
        for _ in range(rng.randint(2, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]))
        rows.append((k, " ".join(words), lang, "src", 0, int(bad)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:5] for r in rows], data.SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows] + [(None, 1, 1), (5, 1, None), (999_999, 0, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels, tx.train(docs, labels)


def test_held_out_accuracy(spark, trained):
    rows, docs, _, model = trained
    got = {r.doc_id: r for r in tx.toxicity(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 200
    right = sum(got[r[0]].predicted == r[5] for r in held)
    assert right / len(held) > 0.93
    assert not any(got[r[0]].predicted for r in held if not r[5])


def test_the_held_out_third(spark):
    ids = spark.range(50).select("id", tx.held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids.collect())


def test_training_never_sees_the_held_out_third(spark, trained):
    rows, docs, labels, model = trained
    other = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tx.train(docs, other)
    text = [r[1] for r in rows[:40]]
    assert np.allclose(tx.Scorer(model).scores(text), tx.Scorer(again).scores(text))


def test_score_ignores_language_and_id(spark, trained):
    _, docs, _, model = trained
    moved = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 5000)
    a = {r.doc_id: r.score for r in tx.toxicity(docs, model).collect()}
    b = {r.doc_id - 5000: r.score for r in tx.toxicity(moved, model).collect()}
    assert a == pytest.approx(b)


def test_awkward_documents(spark, trained):
    model = trained[3]
    df, rows = data.documents(spark)
    got = tx.toxicity(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    kept = tx.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.rejected for r in got)
    assert tx.toxicity(data.empty(spark), model).count() == 0


def test_long_texts_are_pooled_whole(trained):
    model = trained[3]
    rng = random.Random(8)
    clean = data.prose(rng, 3000)
    tail = clean + " idiot scum moron"
    one = tx.Scorer(model).scores([clean, tail])
    old = tx._CHUNK
    try:
        tx._CHUNK = 64
        two = tx.Scorer(model).scores([clean, tail])
    finally:
        tx._CHUNK = old
    assert np.allclose(one, two) and one[1] > one[0]


def test_one_label_or_none(spark):
    assert 0 <= tx.Scorer(tx.train_rows([])).scores(["x"])[0] < 0.01
    s = tx.Scorer(tx.train_rows([("a b", 0, "en")] * 9)).scores(["x", ""])
    assert s[0] == s[1] < 0.1
    model = tx.train(data.empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert tx.toxicity(spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string"), model).first().predicted == 0


def test_score_equals_plain_loops(trained):
    """The classifier by its definition, word by word and filter by filter."""
    import math

    model = trained[3]
    rng = random.Random(5)
    for text in ["", "one", "two idiot", "!!! ...", data.prose(rng, 12), "moron " + data.prose(rng, 30) + " scum", "é 漢字 \t x"]:
        vectors = []
        for word in text.encode().split():
            v = [0.0] * tx.DIM
            for bucket in tx.features(word):
                for k in range(tx.DIM):
                    v[k] += float(model.embedding[bucket, k])
            vectors.append(v)
        vectors = (vectors or [[0.0] * tx.DIM]) + [[0.0] * tx.DIM] * 2  # padding after the last word
        z = float(model.offset)
        for i, width in enumerate(tx.WIDTHS):
            for f in range(tx.FILTERS):
                best = max(float(model.bias[i][f]) + sum(vectors[at + j][k] * float(model.filters[i][j, k, f]) for j in range(width) for k in range(tx.DIM)) for at in range(len(vectors) - 2))
                z += max(0.0, best) * float(model.dense[i * tx.FILTERS + f])
        want = 1 / (1 + math.exp(-min(30, max(-30, model.scale * z + model.shift))))
        assert abs(tx.Scorer(model).scores([text])[0] - want) < 1e-4, text


def test_repeated_and_long_rows_of_the_sample(spark):
    """Rows that repeat count once, whatever their number; texts over the bound never reach the task."""
    rows = labelled(120)
    docs = spark.createDataFrame([r[:5] for r in rows] + [r[:5] for r in rows[:10]] * 20 + [(5000, "idiot " * 10_000, "en", "s", 0)], data.SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows] + [(5000, 0, 1)], "doc_id long, quality int, toxic int")
    one = tx.train(spark.createDataFrame([r[:5] for r in rows], data.SCHEMA), labels, max_chars=1_000_000)
    two = tx.train(docs, labels, max_chars=1_000_000)
    texts = [r[1] for r in rows[:20]]
    assert np.allclose(tx.Scorer(one).scores(texts), tx.Scorer(two).scores(texts))


def test_every_labelled_row_is_learned(spark, trained):
    """Rows beyond what a task holds at a time, and texts longer than that, are learned and calibrate like all others."""
    rows, docs, labels, _ = trained
    model = tx.train(docs, labels, max_chars=5_000)  # a twentieth of that is a short text, the whole of it a dozen
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    got = tx.Scorer(model).scores([r[1] for r in held]) >= tx.THRESHOLD
    assert np.mean(got == [r[5] == 1 for r in held]) > 0.93
    assert set(model.thresholds) == {"de", "en"}


def test_sums_over_shards_are_of_all_rows(spark, trained, monkeypatch):
    """Counts over shards, added in two levels, by plain loops over every labelled row; from joins of either kind."""
    rows, docs, labels, model = trained
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    shards = -(-len(seen) // 20)
    assert shards > tx._FAN
    start = tx._Start(model, None, None, False)
    sums = []
    monkeypatch.setattr(tx, "_learn", lambda total, shards, seed: sums.append([total(step, start) for step in (tx._tally, tx._histogram, tx._by_language)] + [shards]))
    for limit in (tx.BROADCAST_ROWS, 0):
        monkeypatch.setattr(tx, "BROADCAST_ROWS", limit)
        tx.train(docs.union(docs.limit(50)), labels, shard_rows=20, max_chars=2_000)
    want = np.zeros(tx.BUCKETS, int)
    for r in seen:
        want[list({f for w in r[1].encode().split() for f in tx.features(w)})] += 1
    scores = tx.Scorer(model).scores([r[1] for r in seen])
    for tally, histogram, languages, n in sums:
        assert n == shards
        assert (tally["fit"] + tally["held"]).tolist() == [sum(not r[5] for r in seen), sum(r[5] for r in seen)]
        assert (tally["fit seen"] + tally["held seen"] == want).all()
        assert histogram["rows"].sum(axis=1).tolist() == (tally["fit"] + tally["held"]).tolist()
        for lang in ("de", "en"):
            own = [(s, r[5]) for s, r in zip(scores, seen) if r[2] == lang]
            assert languages[lang].tolist() == [sum(y == k for _, y in own) for k in (0, 1)] + [sum(y == k and s >= c for s, y in own) for k in (0, 1) for c in tx._CUTS]


def test_many_shards_learn_one_model(spark, trained):
    """The mean of shards judges held-out rows as well as one task does, and doesn't depend on partitions."""
    rows, docs, labels, _ = trained
    one = tx.train(docs, labels, shard_rows=200)
    two = tx.train(docs.repartition(7), labels.repartition(3), shard_rows=200)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    text = [r[1] for r in held]
    a, b = tx.Scorer(one).scores(text), tx.Scorer(two).scores(text)
    assert np.allclose(a, b)
    assert np.mean((a >= tx.THRESHOLD) == [r[5] == 1 for r in held]) > 0.93


def test_long_texts_are_fitted_part_by_part(trained, monkeypatch):
    """Greatest responses and their windows are those of whole texts, however a batch is cut."""
    rng = random.Random(4)
    own = [(0, "en", 0, *next(tx.encoded([t]))) for t in ["", "scum", data.prose(rng, 900), data.prose(rng, 40), "idiot " + data.prose(rng, 300)]]
    portion = next(tx.portions(own, 1 << 20))
    monkeypatch.setattr(tx, "DROP", 0)
    whole = tx._pooled(trained[3], portion.docs, portion.table, np.random.default_rng(1))
    monkeypatch.setattr(tx, "_CHUNK", 16)
    assert len(list(tx.parts(portion.docs))) > 10
    cut = tx._pooled(trained[3], portion.docs, portion.table, np.random.default_rng(1))
    assert np.allclose(whole[0], cut[0], atol=1e-5) and (whole[1] == cut[1]).mean() > 0.99
