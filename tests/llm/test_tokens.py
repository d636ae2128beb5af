"""BPE, token store, token counts: against the libraries on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from slidestream.llm import bpe, token_counts, token_store
from tests.llm import data

MULTI, SINGLE, JSON = (public_tokenizers.path(n) for n in (bpe.RANKS, token_counts.RANKS, token_store.TOKENIZER))


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


# ---------------------------------------------------------------- BPE


def test_round_trip(spark):
    df, rows = data.documents(spark)
    enc = bpe.encoding(MULTI)
    want = []
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df).collect()) == sorted(want)
    encoded = bpe.encode_documents(df)
    assert sorted(bytes(r.text_bytes).decode() for r in bpe.decode_documents(encoded).collect()) == sorted(t or "" for _, t, *_ in rows)
    assert bpe.round_trip(data.empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a' \n\ts!é1　\xa0\x1c'lL漢", max_size=60), st.integers(1, 12))
def test_parts_meet_at_safe_boundaries(text, size):
    assert "".join(bpe.parts(text, size)) == text
    assert bpe.encode(text, MULTI, size).tolist() == bpe.encoding(MULTI).encode_ordinary(text)


def test_decode_of_cut_characters():
    ids = bpe.encode("漢字👩", MULTI)
    assert b"".join(bpe.decode(ids[k : k + 1], MULTI) for k in range(len(ids))) == "漢字👩".encode()


# ---------------------------------------------------------------- token store


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_codes(ids, draw):
    ids = np.array(ids, np.uint32)
    counts = np.array([len(ids) - len(ids) // 3, len(ids) // 3])
    raw = token_store.to_bytes(np.array([5, 9]), counts, ids)
    t = token_store.TokenFile(lambda n, at: raw[at : at + n])
    assert t.slice(0, len(ids)).tolist() == ids.tolist()
    assert t.doc_ids().tolist() == [5, 9] and t.doc_ends().tolist() == np.cumsum(counts).tolist()
    if len(ids):
        k = draw.draw(st.integers(0, len(ids) - 1))
        assert t[k] == ids[k]
        b = draw.draw(st.integers(k, len(ids)))
        assert t.slice(k, b).tolist() == ids[k:b].tolist()


def test_documents_without_id(spark, tmp_path):
    raw = token_store.to_bytes(np.array([0, -(1 << 63)]), np.array([1, 1]), np.array([7, 8], np.uint32), 1)
    assert token_store.TokenFile(lambda n, at: raw[at : at + n]).n_null == 1
    rows = [(-(1 << 63), "least"), (None, "none"), (0, "zero"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_store.read_tokens(token_store.write_tokens(df, f"file://{tmp_path}/ids")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), 0]


def test_random_access_reads_little():
    ids = np.random.default_rng(1).integers(0, 50_000, 200_000).astype(np.uint32)
    raw = token_store.to_bytes(np.array([1]), np.array([len(ids)]), ids)
    read = []
    t = token_store.TokenFile(lambda n, at: read.append(n) or raw[at : at + n])
    read.clear()
    assert t[123_456] == ids[123_456] and sum(read) < 300


def test_encoder(tokenizer):
    e = token_store.PieceEncoder(JSON)
    rng = random.Random(2)
    alphabet = ["a", "b", " ", " ", "\n", "\t", "\r", "'s", "!", "é", "1", "²", "　", "\x1c", "\0", "<|endoftext|>", "漢", "Word"]
    batch = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)] + [t or "" for t in data.texts()]
    for x, y in zip(e.encode(batch), tokenizer.encode_batch(batch, add_special_tokens=False)):
        assert x.tolist() == y.ids


def test_encoder_with_a_small_cache(tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "PIECES", 40)
    e = token_store.PieceEncoder(JSON)
    for t in data.texts():
        if t and len(t) < 5000:
            assert e.encode([t, t])[1].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("file_tokens", [50, 1 << 30])
def test_store(spark, tokenizer, tmp_path, file_tokens):
    df, rows = data.documents(spark)
    manifest = token_store.write_tokens(df, f"file://{tmp_path}/store", file_tokens=file_tokens)
    got = {}
    for r in token_store.read_tokens(manifest).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    at = 0
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0]))
    for i, t, *_ in order:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (at, len(ids), ids) in got[i]
        at += len(ids)
    assert manifest.count() >= (2 if file_tokens == 50 else 1) and sum(len(x) for x in got.values()) == len(rows)
    assert not [p for p in (tmp_path / "store").iterdir() if not p.name.endswith(".dac")]


def test_added_tokens_are_the_librarys(spark, tmp_path):
    """Against a tokenizer as it comes from the file."""
    plain = Tokenizer.from_file(JSON)
    rng = random.Random(3)
    alphabet = ["a", " ", " ", "\n", "\t", "!", "é", "\x1c", "\0", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<", "漢", "Word"]
    batch = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>.", "no literal", ""] + ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(2000)]
    e = token_store.encoder(JSON)
    for _ in range(2):  # the second time from the cache
        for t, x, y in zip(batch, e.encode(batch), plain.encode_batch(batch, add_special_tokens=False)):
            assert x.tolist() == y.ids, t
    df = spark.createDataFrame(list(enumerate(batch[:300])), "doc_id long, text string")
    got = {r.doc_id: (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.read_tokens(token_store.write_tokens(df, f"file://{tmp_path}/added")).collect()}
    at = 0
    for i, t in enumerate(batch[:300]):
        ids = plain.encode(t, add_special_tokens=False).ids + [2]
        assert got[i] == (at, ids), t
        at += len(ids)


def changed(name):
    t = Tokenizer.from_file(JSON)
    if name == "lower case":
        t.normalizer = normalizers.Lowercase()
    elif name == "prefix space":
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    elif name == "no pattern":
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    elif name == "digits":
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.ByteLevel(add_prefix_space=False)])
    elif name == "truncated":
        t.enable_truncation(3)
    elif name == "another file":
        t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t


@pytest.mark.parametrize("name", ["as it is", "lower case", "prefix space", "no pattern", "digits", "truncated", "another file"])
def test_other_tokenizers_encode_whole_texts(tmp_path, name):
    t = changed(name)
    t.save(path := str(tmp_path / "tokenizer.json"))
    e = token_store.PieceEncoder(path, added=True)
    assert e.by_rule == (name == "as it is")
    batch = ["", "Hello World, 12345 times!", "  two  spaces\n\nand lines ", "a <|endoftext|> b", "x.,;12 3"] + [x for x in data.texts() if x and len(x) < 500]
    for x, y in zip(e.encode(batch), Tokenizer.from_file(path).encode_batch(batch, add_special_tokens=False)):
        assert x.tolist() == y.ids


def test_store_of_nothing(spark, tmp_path):
    m = token_store.write_tokens(data.empty(spark), f"file://{tmp_path}/none")
    assert token_store.read_tokens(m).count() == 0


def test_starts_over_many_parts(spark):
    rows = [(p, s, f"{p}/{s}", 1, (p * 7 + s) % 5 + 1) for p in range(0, 700, 3) for s in range(2)]
    m = spark.createDataFrame(rows, "part int, seq int, path string, n_docs long, n_tokens long")
    at = 0
    for r in sorted(token_store.with_starts(m).collect(), key=lambda r: (r.part, r.seq)):
        assert r.start == at
        at += r.n_tokens


# ---------------------------------------------------------------- token counts


def edited(text, edits):
    for a, b, new in reversed(edits):
        text = text[:a] + new + text[b:]
    return text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n'1!é　", max_size=80), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 6), st.sampled_from(["", " ", "x", " y z", "\n", "a b c d e f"])), max_size=5), st.integers(1, 10))
def test_edits_equal_a_new_count(text, raw, leaf):
    enc = bpe.encoding(SINGLE)
    edits, at = [], 0
    for start, size, new in sorted(raw):
        start = max(start, at)
        if start + size <= len(text):
            edits.append((start, start + size, new))
            at = start + size + 1
    tree = token_counts.CountTree(text, lambda s: len(enc.encode_ordinary(s)), leaf)
    assert tree.total == len(enc.encode_ordinary(text))
    tree.apply(edits)
    assert tree.text() == edited(text, edits)
    assert tree.total == len(enc.encode_ordinary(tree.text())) and tree.root.chars == len(tree.text())


def test_an_edit_encodes_little():
    enc = bpe.encoding(SINGLE)
    text = data.prose(random.Random(4), 50_000)
    tree = token_counts.CountTree(text, lambda s: len(enc.encode_ordinary(s)))
    tree.edit(100_000, 100_010, "changed words")
    assert tree.encoded_chars < 3 * token_counts.LEAF_CHARS and tree.total == len(enc.encode_ordinary(tree.text()))


def test_many_edits_of_one_leaf_are_one():
    enc = bpe.encoding(SINGLE)
    text = "12345a" * 50_000  # nowhere to cut
    tree = token_counts.CountTree(text, lambda s: len(enc.encode_ordinary(s)))
    edits = token_counts.mask_edits(text)
    tree.apply(edits)
    assert len(edits) == 50_001 and tree.encoded_chars == len(tree.text()) and tree.total == len(enc.encode_ordinary(edited(text, edits)))


def depth(node):
    return 0 if node.left is None else 1 + max(depth(node.left), depth(node.right))


def test_leaves_stay_short():
    """Edits of all sizes, half of them at one place: leaves, their number and the depth stay in bounds, and counts right."""
    enc, rng = bpe.encoding(SINGLE), random.Random(6)
    text = data.prose(rng, 40_000)
    tree = token_counts.CountTree(text, lambda s: len(enc.encode_ordinary(s)))
    for k in range(1000):
        a = 5000 if k % 2 else rng.randrange(len(text))
        b = min(len(text), a + rng.choice([0, 0, 3, 40, 200]))
        new = rng.choice(["", "x", " word", "\n", data.prose(rng, 5), data.prose(rng, 400) if k % 50 == 0 else " "])
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
    assert tree.text() == text and tree.total == len(enc.encode_ordinary(text)) and tree.root.chars == len(text)
    assert max(map(len, tree.leaves)) <= 4 * token_counts.LEAF_CHARS
    assert len(tree.leaves) < 12 * len(text) / token_counts.LEAF_CHARS and depth(tree.root) < 40
    before = tree.encoded_chars
    tree.edit(5000, 5001, "q")
    assert tree.encoded_chars - before <= 6 * token_counts.LEAF_CHARS
    for _ in range(3):  # a long insert becomes many leaves
        tree.edit(7000, 7000, data.prose(rng, 15_000))
    assert max(map(len, tree.leaves)) <= 4 * token_counts.LEAF_CHARS


def test_mask_edits_are_linear():
    import time

    text = ("a@" + "b" * 5000 + " 1234567 ") * 400 + "x@" + "1" * 2_000_000
    began = time.time()
    edits = token_counts.mask_edits(text)
    assert time.time() - began < 5 and len(edits) == 802


def counted(rows):
    enc = bpe.encoding(SINGLE)
    return sorted((str(i), len(enc.encode_ordinary(t or "")), len(e := token_counts.mask_edits(t or "")), len(enc.encode_ordinary(edited(t or "", e)))) for i, t, *_ in rows)


def test_counts(spark, tmp_path):
    df, rows = data.documents(spark, [*data.texts(), "mail a@b.c and 1234567 here", "@ @x 12345", "12345@67890"])
    got = token_counts.token_counts(df, f"file://{tmp_path}/trees").collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_edits, r.n_tokens_edited) for r in got) == counted(rows)
    assert token_counts.token_counts(data.empty(spark), f"file://{tmp_path}/none").count() == 0
    assert isinstance(bpe.encoding(SINGLE), tiktoken.Encoding)


def test_stored_trees_take_edits(spark, tmp_path):
    """Two rounds of edits on stored trees: the counts of the edited texts, and the texts are never encoded whole."""
    rng, enc = random.Random(8), bpe.encoding(SINGLE)
    texts = {1: data.prose(rng, 5000), 2: "", 3: None, 4: data.prose(rng, 60), 5: "same"}
    rows = [*texts.items(), (5, "same"), (None, "no id")]
    trees = token_counts.build_trees(spark.createDataFrame(rows, "doc_id int, text string"))
    trees.write.parquet(f"{tmp_path}/0")
    edits = [(1, 100, 110, "XX"), (1, 105, 200, "overlaps"), (1, 20_000, 20_000, " word "), (2, 0, 9, "new text"), (3, -5, 0, "a"), (4, 10**9, 10**9, " end"), (4, 3, None, "null"), (9, 0, 0, "nobody"), (None, 0, 0, "x"), (5, 0, 4, "")]
    want = {1: (texts[1][:100] + "XX" + texts[1][110:20_000] + " word " + texts[1][20_000:]), 2: "new text", 3: "a", 4: texts[4] + " end", 5: "", None: "no id"}
    for k in range(2):
        out = token_counts.edit_trees(spark.read.parquet(f"{tmp_path}/{k}"), spark.createDataFrame(edits, "doc_id int, start int, `end` int, new string").withColumn("leaves", F.lit("mine")))
        out.write.parquet(f"{tmp_path}/{k + 1}")
        got = spark.read.parquet(f"{tmp_path}/{k + 1}").collect()
        assert sorted((str(r.doc_id), "".join(r.leaves), r.n_tokens_edited, sum(r.counts)) for r in got) == sorted((str(i), want[i], n := len(enc.encode_ordinary(want[i])), n) for i in [*texts, 5, None])
        assert next(r.n_chars_encoded for r in got if r.doc_id == 1) < 5000
        edits = [(1, 0, 0, "start "), (4, 0, 1, "")]
        want |= {1: "start " + want[1], 4: want[4][1:]}


# ---------------------------------------------------------------- runs of white space


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "\n", "\t", "\u3000", "\xa0", " \n", "\x1c", "a", "!", "é1", "'s"]), st.integers(1, 9)), max_size=12))
def test_runs_are_matches_of_the_pattern(raw):
    text, enc = "".join(s * n for s, n in raw), bpe.encoding(MULTI)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "RUN_CHARS", 3)
        m.setattr(bpe, "_RUN", bpe.re.compile(bpe._RUN.pattern.replace("4096", "3")))
        assert bpe.encode_part(enc, text) == enc.encode_ordinary(text)


LONG_RUNS = [" " * 1_000_000, "\n" * 3_000_000, "a" + " " * 2_000_000 + "b c", "x\n" + " \n\t\u3000" * 400_000 + "\n\ny", (" " * 1_200_000 + "z") * 2 + "\r" * 1_100_000]


@pytest.mark.parametrize("text", LONG_RUNS, ids=range(len(LONG_RUNS)))
def test_runs_of_a_million(text):
    """By the pattern's meaning: a run is one match, less the last character where something follows."""
    import re

    for path in (MULTI, SINGLE):
        enc = bpe.encoding(path)
        want = []
        for m in re.finditer(r"\s+(?!\S)|\s?\S+", text):  # ids of shorter matches are the library's own
            want += enc._encode_single_piece(m.group().encode()) if m.group().isspace() else enc.encode_ordinary(m.group())
        assert bpe.encode(text, path).tolist() == want and bpe.decode(np.array(want, np.uint32), path) == text.encode()


def test_runs_in_tables(spark, tmp_path):
    rows = list(enumerate(LONG_RUNS[:3]))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r.decoded_sha256 for r in bpe.round_trip(df).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, f"file://{tmp_path}/runs").collect()}
    assert counts == {i: len(bpe.encode(t, SINGLE)) for i, t in rows}


def test_decode_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (None, None)], "doc_id long, ids binary")
    assert [bytes(r.text_bytes) for r in bpe.decode_documents(df).collect()] == [b"", b"", b""]
