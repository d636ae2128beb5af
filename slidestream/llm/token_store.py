"""Token ids in binary files of directly addressable codes, in ascending doc_id order.

A file holds whole documents. Ids are split into 8-bit chunks: level 0 has the lowest chunk of every id, level k the k-th chunk of those
ids that have one. A level's bitmap marks the ids that go on in the next level, and a directory has the number of marks before every
block of 512 bits, so the place of an id's next chunk is one rank query and any id is read without decoding others.

Layout, little-endian: magic, n_docs u64, n_null u64 (so many documents, the first ones, have no doc_id and 0 in its place), n_tokens u64,
n_levels u64, n_entries u64 of each level; doc_id i64 [n_docs]; doc_end u64 [n_docs]; then for each level the chunks u8 [n_entries], padded to 8 bytes, the bitmap u64 [ceil(n/64)] and the directory
u64 [ceil(n/512) + 1].
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers, processors

from slidestream.llm.common import arrow_map, texts
from slidestream.shared import cut

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"SLDAC002"
#: A file is closed once it has so many ids; a document is never split over files.
FILE_TOKENS = 2_000_000
#: Pieces that a worker remembers.
PIECES = 400_000
_PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_OTHER_SPACE = re.compile(r"[^\S \n\t\r]")
_RARE = "\x0b\x0c\x1c\x1d\x1e\x1f"
_SPACE_PAIRS = ("  ", "\n ", "\t ", "\r ")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


# ---------------------------------------------------------------- directly addressable codes


def build(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap words, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        n = len(rest)
        padded = np.zeros(-(-n // 64) * 64, bool)
        padded[:n] = more
        words = np.packbits(padded, bitorder="little").view("<u8")
        blocks = np.zeros(-(-len(words) // 8) * 8, np.int64)
        blocks[: len(words)] = np.bitwise_count(words)
        ranks = np.concatenate(([0], np.cumsum(blocks.reshape(-1, 8).sum(axis=1)))).astype("<u8")
        levels.append(((rest & 255).astype(np.uint8), words, ranks))
        rest = rest[more] >> 8
        if not len(rest):
            return levels


def to_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, n_null: int = 0) -> bytes:
    levels = build(ids)
    head = struct.pack(f"<{4 + len(levels)}Q", len(doc_ids), n_null, len(ids), len(levels), *[len(c) for c, _, _ in levels])
    out = [MAGIC, head, doc_ids.astype("<i8").tobytes(), np.cumsum(counts).astype("<u8").tobytes()]
    for chunks, words, ranks in levels:
        out += [chunks.tobytes(), b"\0" * (-len(chunks) % 8), words.tobytes(), ranks.tobytes()]
    return b"".join(out)


class TokenFile:
    """Reads a file by position; ``read_at(size, offset)`` gives bytes."""

    def __init__(self, read_at: Callable[[int, int], bytes]):
        self.read_at = read_at
        head = read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_null, self.n_tokens, n_levels = struct.unpack("<4Q", head[8:])
        sizes = struct.unpack(f"<{n_levels}Q", read_at(8 * n_levels, 40))
        self._docs = at = 40 + 8 * n_levels
        at += 16 * self.n_docs
        self.levels = []
        for n in sizes:
            words, ranks = -(-n // 64), -(-n // 512) + 1
            self.levels.append((at, at + n + -n % 8, at + n + -n % 8 + 8 * words))
            at = self.levels[-1][2] + 8 * ranks

    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self.read_at(8 * self.n_docs, self._docs), "<i8")

    def doc_ends(self) -> np.ndarray:
        return np.frombuffer(self.read_at(8 * self.n_docs, self._docs + 8 * self.n_docs), "<u8").astype(np.int64)

    def _marks(self, level: int, a: int, b: int) -> np.ndarray:
        first, last = a // 64, -(-b // 64)
        words = self.read_at(8 * (last - first), self.levels[level][1] + 8 * first)
        return np.unpackbits(np.frombuffer(words, np.uint8), bitorder="little")[a - 64 * first : b - 64 * first].astype(bool)

    def rank(self, level: int, i: int) -> int:
        """Marks before entry ``i``."""
        block = i // 512
        (before,) = struct.unpack("<Q", self.read_at(8, self.levels[level][2] + 8 * block))
        return before + (int(self._marks(level, 512 * block, i).sum()) if i % 512 else 0)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1."""
        out = np.zeros(max(0, b - a), np.uint32)
        at = np.arange(len(out))
        for level in range(len(self.levels)):
            if a >= b:
                break
            out[at] |= np.frombuffer(self.read_at(b - a, self.levels[level][0] + a), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            marks = self._marks(level, a, b)
            at = at[marks]
            a = self.rank(level, a)
            b = a + len(at)
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])


# ---------------------------------------------------------------- encoding


class Pieces(dict):
    """Numbers of pieces, and their ids as rows end to end. A new piece gets the next number and waits in ``new`` for its ids."""

    def __init__(self, kind: type) -> None:
        self.new: list[str] = []
        self.flat, self.sizes, self.starts = np.zeros(0, kind), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int32)

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.new.append(piece)
        return k

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> Pieces:
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes.astype(np.int32))
        self.flat = np.append(self.flat, flat.astype(self.flat.dtype))
        self.uses = np.append(self.uses, np.zeros(len(sizes), np.int32))
        return self

    def take(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``k`` end to end, and their sizes."""
        n = self.sizes[k].astype(np.int64)
        if not len(n):
            return self.flat[:0], n
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[k] - ends + n, n) + np.arange(ends[-1])], n

    def used(self, k: np.ndarray) -> None:
        self.uses += np.bincount(k, minlength=len(self.uses)).astype(np.int32)

    def shrunk(self, most: int) -> Pieces:
        """At most ``most`` of the pieces that were used more than once, the most used ones."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argpartition(-self.uses[keep], most)[:most]])
        out = Pieces(self.flat.dtype).add(*self.take(keep))
        out.uses = self.uses[keep] // 2
        names = list(self)
        for n, k in enumerate(keep.tolist()):
            out[names[k]] = n
        return out


def splits_by_rule(tokenizer: Tokenizer) -> bool:
    """Whether ids of parts in a row are those of the text: a byte-level BPE that knows every byte, with the usual pattern of pre-tokens,
    that changes neither texts nor ids before or after."""
    t, pre, model = tokenizer, tokenizer.pre_tokenizer, tokenizer.model
    return (
        t.normalizer is None
        and isinstance(pre, pre_tokenizers.ByteLevel)
        and pre.use_regex
        and not pre.add_prefix_space
        and isinstance(model, models.BPE)
        and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
        and t.truncation is None
        and t.padding is None
        and (t.post_processor is None or isinstance(t.post_processor, processors.ByteLevel))
        and set(pre_tokenizers.ByteLevel.alphabet()) <= t.get_vocab(with_added_tokens=False).keys()
    )


class PieceEncoder:
    """Ids by the tokenizers library, with a cache of pieces.

    Pre-tokens of a byte-level tokenizer never cross from a character that isn't white space to a space or line end, nor from a letter
    to ASCII punctuation. So a text's ids are those of its pieces in a row, and a piece's are those of its parts. A piece is what
    stands between two spaces, with the first of them; a part is a run of white space with the letters or other characters after it.
    A text where a space follows other white space is cut by the pattern of parts, and one with white space besides space, tab and line
    ends is one piece. Keys of pieces that don't start with a space are marked by a zero character.

    Other tokenizers (see ``splits_by_rule``) encode whole texts, without a cache.

    With ``added``, a text that holds an added token's literal goes to the library whole, which gives that token as it does by default;
    else such a literal is encoded as any other characters.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.by_rule, self.added = splits_by_rule(self.tokenizer), added
        self.tokenizer.encode_special_tokens = True
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # in the byte-level alphabet a character is a byte
        for token, k in vocab.items():
            self.token_bytes[k] = len(token)
        self.id_type = np.uint16 if len(self.token_bytes) <= 1 << 16 else np.uint32
        self.pieces, self.parts = Pieces(self.id_type), Pieces(self.id_type)

    def _keys(self, text: str) -> list[str] | None:
        """The pieces' keys, or None if they are what stands between the spaces of the text with its mark."""
        if not text:
            return []
        if (any(c in text for c in _RARE) if text.isascii() else _OTHER_SPACE.search(text)) or "\0" in text:
            return ["\0" + text]
        if any(pair in text for pair in _SPACE_PAIRS):
            return ["\0" + p for p in _PIECE.findall(text)]
        return None

    def _numbers(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the batch's pieces, text after text, and where each text's begin and end. Each different piece is looked up once."""
        rows = [self._keys(t) for t in batch]
        cut = pc.split_pattern(pa.array(["\0" + t for t, keys in zip(batch, rows) if keys is None], pa.large_string()), " ")
        # the texts that Arrow cuts come first
        others = pa.array(list(chain.from_iterable(keys for keys in rows if keys)), pa.large_string())
        keys = pa.concat_arrays([cut.flatten(), others]).dictionary_encode()
        names = keys.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        numbers = np.fromiter(map(self.pieces.__getitem__, names), np.int64, len(names))[keys.indices.to_numpy()]
        simple = np.array([k is None for k in rows], bool)
        sizes = np.zeros(len(batch), np.int64)
        sizes[simple] = np.diff(cut.offsets.to_numpy())
        sizes[~simple] = [len(k) for k in rows if k is not None]
        order = np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple)))
        ends = np.empty(len(batch), np.int64)
        ends[order] = np.cumsum(sizes[order])
        return numbers, np.stack((ends - sizes, ends))

    def _learn_parts(self) -> None:
        new, self.parts.new = self.parts.new, []
        if not new:
            return
        chained = [k for k, p in enumerate(new) if p[0] in " \n\t\r" and not p[-1].isspace()]
        single = sorted(set(range(len(new))).difference(chained))
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if chained:  # encoded as one text, and cut apart again by their bytes
            row = np.array(self.tokenizer.encode_batch_fast(["".join([new[k] for k in chained])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(pc.binary_length(pa.array([new[k] for k in chained], pa.large_string())).to_numpy())
            token_ends = np.cumsum(self.token_bytes[row])
            stops = np.searchsorted(token_ends, ends, side="left") + 1
            if not np.array_equal(token_ends[stops - 1], ends):
                raise ValueError("a token crosses a piece boundary")
            ids.append(row)
            sizes.append(np.diff(stops, prepend=0))
        if single:
            rows = [e.ids for e in self.tokenizer.encode_batch_fast([new[k] for k in single], add_special_tokens=False)]
            ids += [np.array(r, np.uint32) for r in rows]
            sizes.append(np.array([len(r) for r in rows], np.int64))
        back = np.argsort(np.array(chained + single))
        flat, n = Pieces(np.uint32).add(np.concatenate(ids), np.concatenate(sizes)).take(back)
        self.parts.add(flat, n)

    def _learn(self) -> None:
        """Ids of new pieces, by their parts."""
        new, self.pieces.new = self.pieces.new, []
        numbers, counts, part = [], [], self.parts.__getitem__
        for key in new:
            if key.isalpha():
                numbers.append(part(" " + key))
                counts.append(1)
                continue
            before = len(numbers)
            if key[:1] == "\0":
                text = key[1:]
                parts = [text] if _OTHER_SPACE.search(text) or "\0" in text else _PIECE.findall(text)
            else:
                text = " " + key
                parts = _PIECE.findall(text) if "\n" in key or "\t" in key or "\r" in key else (text,)
            for p in parts:
                stem = p.rstrip(_PUNCTUATION)
                if len(stem) < len(p) and stem and stem[-1].isalpha():
                    numbers += part(stem), part(p[len(stem) :])
                else:
                    numbers.append(part(p))
            counts.append(len(numbers) - before)
        self._learn_parts()
        part_numbers = np.array(numbers, np.int64)
        self.parts.used(part_numbers)
        flat, n = self.parts.take(part_numbers)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))]
        self.pieces.add(flat, np.diff(ends))

    def _whole(self, batch: list[str]) -> list[np.ndarray]:
        """Ids by the library, by its defaults with ``added``."""
        self.tokenizer.encode_special_tokens = not self.added
        try:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        finally:
            self.tokenizer.encode_special_tokens = True

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        if not self.by_rule:
            return self._whole(batch)
        whole = {k: t for k, t in enumerate(batch) if any(x in t for x in self.literals)}
        if not whole:
            return self._by_pieces(batch)
        out = self._by_pieces(["" if k in whole else t for k, t in enumerate(batch)])
        for k, ids in zip(whole, self._whole(list(whole.values()))):
            out[k] = ids
        return out

    def _by_pieces(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.pieces) > PIECES:
            self.pieces = self.pieces.shrunk(PIECES // 2)
        if len(self.parts) > PIECES:
            self.parts = self.parts.shrunk(PIECES // 2)
        numbers, (starts, ends) = self._numbers(batch)
        if self.pieces.new:
            self._learn()
        self.pieces.used(numbers)
        flat, n = self.pieces.take(numbers)
        at = np.concatenate(([0], np.cumsum(n)))
        return [flat[a:b].astype(np.uint32) for a, b in zip(at[starts], at[ends])]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path, added=True)


# ---------------------------------------------------------------- writing and reading


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes files into ``folder`` (a URI that pyarrow can open) and returns their manifest, computed: ``part, seq, path, n_docs, n_tokens``.

    Ascending (part, seq) is ascending doc_id. Each document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. A null
    doc_id sorts first. Rows that share a doc_id are stored one after the other. Other columns are ignored; an empty table gives no
    files. Ids are the library's by default, so the literal of an added token is that token. A file is written under another name and
    renamed, so a repeated task replaces whole files by equal ones.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        fs, base = pa.fs.FileSystem.from_uri(folder)
        held: list[tuple[int | None, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            name = f"{base}/part-{part:06d}-{seq:05d}.dac"
            n_null = sum(d is None for d, _ in held)  # nulls sort first
            data = to_bytes(np.array([0 if d is None else d for d, _ in held], np.int64), np.array([len(x) for _, x in held]), np.concatenate([x for _, x in held]), n_null)
            with fs.open_output_stream(own := f"{name}.{uuid.uuid4().hex}") as f:
                f.write(data)
            if fs.get_file_info(name).type != pa.fs.FileType.NotFound:  # of an earlier attempt; not every store renames over a file
                fs.delete_file(name)
            fs.move(own, name)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{folder}/part-{part:06d}-{seq:05d}.dac"], "n_docs": pa.array([len(held)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

        for b in batches:
            ids = b.column(0).to_pylist()
            for d, x in zip(ids, encoder(path).encode(texts(b.column(1)))):
                held.append((d, np.append(x, np.uint32(end_id))))
                total += len(x) + 1
                if total >= file_tokens:
                    yield flush()
                    seq, held, total = seq + 1, [], 0
        if held:
            yield flush()

    pa.fs.FileSystem.from_uri(folder)[0].create_dir(pa.fs.FileSystem.from_uri(folder)[1], recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return cut(arrow_map(dealt.select("doc_id", "text"), run, "part int, seq int, path string, n_docs long, n_tokens long"))


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``: ids in all files before. Sums go over groups of 256 parts first, so one task sees a 256th of the parts."""
    grouped = manifest.withColumn("g", F.floor(F.col("part") / 256))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy("g").agg(F.sum("n_tokens").alias("n")).select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("g").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, "g").select(*manifest.columns, (F.col("base") + F.col("inside")).alias("start"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files; ids as little-endian uint32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    t = TokenFile(lambda n, at: f.read_at(n, at))
                    ids, ends = t.doc_ids(), t.doc_ends()
                    for a in range(0, t.n_docs, 512):
                        e = ends[a : a + 512]
                        s = np.concatenate(([ends[a - 1] if a else 0], e[:-1]))
                        tokens = t.slice(int(s[0]), int(e[-1])).astype("<u4")
                        rows = [tokens[x - s[0] : y - s[0]].tobytes() for x, y in zip(s, e)]
                        null = np.arange(a, a + len(e)) < t.n_null
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 512], pa.int64(), mask=null), pa.array(start + s), pa.array(e - s), pa.array(rows, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    spread = with_starts(manifest).select("path", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return arrow_map(spread, run, "doc_id long, start long, n_tokens long, ids binary")


