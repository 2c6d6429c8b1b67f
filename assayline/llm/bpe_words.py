"""Operator 6: BPE encoding and decoding over a table of distinct words.

The vocabulary's pre-tokenizer makes words that are encoded on their own, so
a text's ids are those of its words in order. Blocks of documents (up to
``BLOCK_BYTES`` of text, as they lie in the input) are split into words; a
block lists its distinct words once and holds its documents as word numbers
(frequent words have small ones). The distinct words of all blocks are dealt
by word; each is encoded once, and its ids go back to the blocks that have it,
where they are joined by position. Words, numbers and ids travel as compressed
runs, a row per block and part. Decoding joins ids with the id-to-piece table
(fixed by the vocabulary, about 50,000 rows, so it is broadcast) and puts the
pieces of a document in order.

Splitting follows the file's normalizer and pattern. Plain text (characters
whose treatment is the same in every library) is split by one regular
expression; anything else goes through the tokenizers library's own
normalizer and pre-tokenizer. Strings of added tokens in a text are words of
their own, as in the library.

A very common word is one entry per block, not per occurrence. The documents
are read twice in the same partitions, so the input must be a table of files
(store a computed one first). Defined cases: null and empty texts have no ids
and decode to the empty string; repeated rows and null ids give a row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from assayline.llm.common import extended, partitions, table

BLOCK_BYTES = 24 << 20
#: Documents whose word numbers share a compressed run.
RUN_DOCUMENTS = 256
#: Characters that normalizers and patterns of all libraries treat alike.
_PLAIN = re.compile(r"[\n\r\t -~¡-¨«»¿À-ÖØ-öø-ÿ‘’“”–—…€]*")
_LETTERS = "a-zà-öø-ÿß"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")

_SPLITTERS: dict[str, "Splitter"] = {}


class Splitter:
    """Words of a text for a vocabulary file with word-end suffixes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def __call__(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return _WORD.findall(text.lower())
        out = []
        for k, piece in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                out.append(piece)
            elif piece:
                out += self._exact(piece)
        return out

    def _exact(self, text: str) -> list[str]:
        plain = self.tokenizer.normalizer.normalize_str(text)
        # Places in the normalised text: the byte-level step only renames bytes.
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)
        return [plain[a:b] for _, (a, b) in words]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in
                self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def splitter(path: str) -> Splitter:
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Splitter(path)
    return _SPLITTERS[path]


def _squeeze(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _stretch(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _numbered(batches, path: str, keep_documents: bool):
    """(block number, its words by falling frequency, ids, words per document,
    word numbers) of every block of a partition."""
    words, block, size = splitter(path), 0, 0
    known, ids, lengths, nos = {}, [], [], []

    def done():
        flat = np.concatenate(nos) if nos else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
        rank = np.empty(len(known), np.uint32)
        rank[order] = np.arange(len(known), dtype=np.uint32)
        names = list(known)
        return (block, [] if keep_documents else [names[i] for i in order.tolist()], ids,
                np.array(lengths, np.uint32), rank[flat] if keep_documents else None)

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            if size >= BLOCK_BYTES:
                yield done()
                block, size, known, ids, lengths, nos = block + 1, 0, {}, [], [], []
            t = t.as_py() or ""
            size += len(t)
            own = words(t)
            nos.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.uint32,
                                   len(own)))
            ids.append(i)
            lengths.append(len(own))
    if ids:
        yield done()


def _word_lists(rows: DataFrame, path: str, parts: int) -> DataFrame:
    """(part, block, sizes, words, nos): each block's distinct words, dealt by word."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for block, words, *_ in _numbered(batches, path, False):
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            part = np.fromiter((zlib.crc32(w) % parts for w in raw), np.int64, len(raw))
            out = []
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                own = [raw[i] for i in at]
                out.append((int(k), base + block, _squeeze(np.array([len(w) for w in own])),
                            zstandard.compress(b"".join(own)), _squeeze(at)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5,
                                                (pa.int64(), pa.int64(), *[pa.binary()] * 3))],
                names=["part", "block", "sizes", "words", "nos"])

    return rows.mapInArrow(listed, "part long, block long, sizes binary, words binary, nos binary")


def _encode_part(path: str):
    """Words of one part: each distinct one is encoded once; (block, nos,
    sizes, ids) goes back to every block that has some."""
    def encode(t: pa.Table) -> pa.Table:
        lists, known = [], {}
        for sizes, raw in zip(t.column("sizes"), t.column("words")):
            raw = zstandard.decompress(raw.as_py())
            ends = np.cumsum(_stretch(sizes.as_py()), dtype=np.int64).tolist()
            own = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]
            lists.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64,
                                     len(own)))
        ids = [np.array(x, np.uint32) for x in splitter(path).encode(list(known))]
        gather = _Gather([x.astype("<u4").tobytes() for x in ids])
        return pa.table([t.column("block"), t.column("nos"),
                         pa.array([_squeeze(gather.lengths[x]) for x in lists], pa.binary()),
                         pa.array([_squeeze(gather(x)) for x in lists], pa.binary())],
                        names=["block", "nos", "sizes", "ids"])
    return encode


def _runs(rows: DataFrame, path: str, id_col: str) -> DataFrame:
    """(block, doc, sizes, nos): documents as word numbers, a row a run of them."""
    kind = rows.schema[id_col].dataType.simpleString()
    arrow = pa.list_(to_arrow_type(rows.schema[id_col].dataType))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for block, _, ids, lengths, nos in _numbered(batches, path, True):
            ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
            for lo in range(0, len(ids), RUN_DOCUMENTS):
                hi = min(len(ids), lo + RUN_DOCUMENTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + block], pa.int64()), pa.array([ids[lo:hi]], arrow),
                     pa.array([_squeeze(lengths[lo:hi])], pa.binary()),
                     pa.array([_squeeze(nos[ends[lo]:ends[hi]])], pa.binary())],
                    names=["block", "doc", "sizes", "nos"])

    return rows.mapInArrow(documents, f"block long, doc array<{kind}>, sizes binary, nos binary")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text",
                     emit=None, columns: dict[str, str] | None = None) -> DataFrame:
    """(id, ids) of every document; ``emit`` may turn a document's words into
    other ``columns`` instead."""
    rows = docs.select(id_col, text)
    lists = _word_lists(rows, path, partitions(docs.sparkSession))
    back = lists.groupBy("part").applyInArrow(
        _encode_part(path), "block long, nos binary, sizes binary, ids binary")
    columns = columns or {"ids": "binary"}
    make = emit or _ids

    def join(d: pa.Table, w: pa.Table) -> pa.Table:
        parts = [[_stretch(x.as_py()) for x in w.column(c)] for c in ("nos", "sizes", "ids")]
        count = sum(map(len, parts[0]))
        words: list = [b""] * count
        for nos, sizes, ids in zip(*parts):
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            raw = ids.tobytes()
            for k, a, b in zip(nos.tolist(), [0, *ends], ends):
                words[k] = raw[4 * a:4 * b]
        prepared = make.prepare(words)
        out, found = [], []
        for ids, sizes, nos in zip(d.column("doc").to_pylist(), d.column("sizes"),
                                   d.column("nos")):
            nos = _stretch(nos.as_py())
            ends = np.cumsum(_stretch(sizes.as_py()), dtype=np.int64).tolist()
            found += ids
            out += [make.row(prepared, nos[a:b]) for a, b in zip([0, *ends], ends)]
        cols = list(zip(*out)) or [[]] * len(columns)
        arrow = d.schema.field("doc").type.value_type
        return pa.table([pa.array(found, arrow), *[pa.array(c, t) for c, t in
                                                   zip(cols, make.types)]],
                        names=[id_col, *columns])

    return (_runs(rows, path, id_col).groupBy("block").cogroup(back.groupBy("block"))
            .applyInArrow(join, extended(rows.select(id_col), **columns)))


class _Gather:
    """Word ids of a block as one array, to be gathered by word number."""

    def __init__(self, words: list[bytes]):
        lengths = np.array([len(x) // 4 for x in words], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(words), "<u4")

    def __call__(self, nos: np.ndarray) -> np.ndarray:
        n = self.lengths[nos]
        total = int(n.sum())
        if not total:
            return self.flat[:0]
        first = np.repeat(self.starts[nos] - (np.cumsum(n) - n), n)
        return self.flat[first + np.arange(total)]


class _Ids:
    types = (pa.binary(),)
    prepare = staticmethod(_Gather)

    @staticmethod
    def row(gather, nos):
        return (gather(nos).tobytes(),)


_ids = _Ids()


def id_to_piece(path: str) -> list[str]:
    """Piece of every id of the vocabulary; the file has no decoder, so
    pieces are joined by one space."""
    t = splitter(path).tokenizer
    return [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]


class Decoder:
    """Joins ids with their pieces."""

    def __init__(self, pieces: list[str]):
        self.pieces = np.array(pieces, object)

    def __call__(self, ids: np.ndarray) -> str:
        return " ".join(self.pieces[ids].tolist())


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id",
                     ids: str = "ids") -> DataFrame:
    """(id, text) from little-endian unsigned 32-bit ids."""
    pieces = encoded.sparkSession.sparkContext.broadcast(id_to_piece(path))
    rows = encoded.select(id_col, ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = Decoder(pieces.value)
        for b in batches:
            out = [join(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())],
                                             names=[id_col, "text"])

    return rows.mapInArrow(decode, extended(rows.select(id_col), text="string"))


class _Digest:
    """Counts and digests of ids and of the decoded text, word by word."""

    types = (pa.int64(), pa.string(), pa.string())

    def __init__(self, pieces):
        self.pieces = pieces

    def prepare(self, words: list[bytes]):
        join = Decoder(self.pieces.value)
        gather = _Gather(words)
        decoded = [join(np.frombuffer(x, "<u4")) if x else None for x in words]
        return gather, np.array(decoded, object)

    @staticmethod
    def row(prepared, nos):
        gather, decoded = prepared
        ids = gather(nos)
        text = " ".join([x for x in decoded[nos].tolist() if x is not None])
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(text.encode("utf-8")).hexdigest())


def op6_distinct_word_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = spark.sparkContext.broadcast(id_to_piece(path))
    return encode_documents(
        table(spark, sf_dir, "documents"), path, emit=_Digest(pieces),
        columns={"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
