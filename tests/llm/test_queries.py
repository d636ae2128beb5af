"""The registered queries over the smallest tables, and the pipeline stage by stage."""

import hashlib

import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from slidestream.llm import bpe, decontaminate, queries, simhash, toxicity
from tests.llm import test_line_dedup, test_simhash
from tests.test_queries import compare

ROWS = {"op1_decontaminate": None, "op10_warc_revisits": "pages"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, small, name):
    compare(spark, duck, name, queries.QUERIES[name], queries.ORACLE_SQL[name], small)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_table(spark, duck, small, name):
    n = queries.QUERIES[name](spark, small).count()
    if (t := ROWS.get(name, "documents")) is not None:
        assert n == duck.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0]


def test_names(spark):
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in entry.queries()


def test_pipeline(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, small).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        out[name] = now
        if name != "bpe":
            assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.toxicity(docs, model).collect() if r.rejected}
    after = {n: {r.doc_id: r for r in df.collect()} for n, df in out.items()}
    assert set(after["toxicity"]) == set(rows) - rejected
    want = {i: (n, h) for i, n, _, h in test_line_dedup.plain([(i, r.text) for i, r in after["toxicity"].items()])}
    import hashlib

    lines = after["line_dedup"]
    assert {str(i): hashlib.sha256(r.text.encode()).hexdigest() for i, r in lines.items()} == {i: h for i, (_, h) in want.items()}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    ids = sorted(lines)
    groups = test_simhash.plain_components([simhash.fingerprint(lines[i].text) for i in ids], ids)
    assert set(after["simhash_near_dedup"]) == set(groups)
    bench = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    from slidestream.llm.common import WordHashes, lower_words

    dirty = {i for i in set(groups) if list(bench.matches(WordHashes().of(lower_words(lines[i].text)), 0.8))}
    assert set(after["decontamination"]) == set(groups) - dirty
    assert {i: r.n_tokens for i, r in after["bpe"].items()} == {i: len(bpe.encode(lines[i].text, bpe.public_tokenizers.path(bpe.RANKS))) for i in set(groups) - dirty}
    assert corpus_pipeline.run(spark, small).count() == len(after["bpe"])


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, empty and long texts, extra columns; and empty tables. Each stage by independent code, but for
    the classifier's verdict."""
    import base64

    import public_tokenizers
    import xxhash

    from tests.llm import data, test_decontaminate

    shared_line = "this very line is found in several documents"
    texts = [t for t in data.texts() if t is None or len(t) < 20_000] + test_decontaminate.planted()[:4] + [f"{shared_line}\nown words of {k} " + data.prose(__import__("random").Random(k), 30) for k in range(5)]
    df, rows = data.documents(spark, texts)
    df = df.withColumn("a.b", df.lang)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], k % 2, int(k % 3 == 0)) for k, r in enumerate(rows) if r[0] is not None] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(test_decontaminate.ITEMS, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now.collect())
        assert name == "bpe" or now.columns == df.columns
    clean, lined, single, decontaminated, encoded = seen
    want = {(i, h) for i, _, _, h in test_line_dedup.plain([(r.doc_id, r.text) for r in clean])}
    assert {(str(r.doc_id), hashlib.sha256(r.text.encode()).hexdigest()) for r in lined} == {(str(i), h) for i, h in want}

    def fingerprint(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
        runs = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
        return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0

    named = [r for r in lined if r.doc_id is not None]
    ids, fps = zip(*{r.doc_id: (r.doc_id, fingerprint(r.text)) for r in named}.values())
    keep = set(test_simhash.plain_components(list(fps), list(ids)))
    assert sorted(r.doc_id for r in single if r.doc_id is not None) == sorted(keep) and sum(r.doc_id is None for r in single) == sum(r.doc_id is None for r in lined)
    dirty = {i for i, _ in test_decontaminate.plain([(r.doc_id, r.text) for r in single])}
    assert sorted(str(r.doc_id) for r in decontaminated) == sorted(str(r.doc_id) for r in single if str(r.doc_id) not in dirty) and dirty
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in encoded) == sorted((str(r.doc_id), len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in decontaminated)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
