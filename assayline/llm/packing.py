"""Operator 5: best-fit packing by hierarchical residual packing.

Documents are tokenized where they lie; only piece records (id, lengths,
checksum) move. Pieces are dealt over partitions and each partition packs its
pieces best-fit (longest first). Bins with at most ``slack`` free tokens are
final. The others travel up a tree: ``FAN_IN`` partitions meet in one, their
underfull bins are items of the next best-fit round, and so on to the root.
A bin travels as the records of its pieces.

After a best-fit round no two bins of a node fit together, so at most one of
them is half empty or more; a node passes up its ``CARRY`` emptiest bins (the
fuller ones have the least to gain) and the rest are final, which bounds
every task at CARRY * FAN_IN bins however large the input is.

A document longer than a sequence is cut into full sequences; its first piece
takes the remainder. Defined cases: null or empty text is the end token alone;
repeated rows and null ids are packed as rows of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import extended, stored, table

END_ID, CAPACITY = 0, 2048
#: Pieces a leaf partition packs, on average.
LEAF_PIECES = 100_000
FAN_IN, CARRY, SLACK = 8, 4096, 2

_ENCODERS: dict[str, object] = {}


def _bytes_of_units() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    for the code points from 256 up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_bpe_encoder(path: str):
    """Encoder for a byte-level BPE file of the tokenizers library, without
    added special tokens but with those found in the text, as its encode()."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        unit = _bytes_of_units()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(unit[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()
                 if piece not in added}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                            mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[path]


def encode(encoder, text: str) -> np.ndarray:
    return np.asarray(encoder.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document."""
    rows = docs.select(id_col, text)
    schema = extended(rows.select(id_col), piece="int", start="long", length="long",
                      ids_crc32="long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe_encoder(tokenizer)
        for b in batches:
            at, cols = [], ([], [], [], [])
            for row, t in enumerate(b.column(1)):
                ids = np.append(encode(encoder, t.as_py() or ""), np.uint32(end_id)).astype("<u4")
                raw, n = ids.tobytes(), len(ids)
                first = n % capacity or capacity
                bounds = [0, *range(first, n, capacity), n] if n > capacity else [0, n]
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                    at.append(row)
                    for c, v in zip(cols, (k, lo, hi - lo, zlib.crc32(raw[4 * lo:4 * hi]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in cols[1:]]], names=schema.names)

    return rows.mapInArrow(cut, schema)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item; longest first, each into the fullest bin that
    still holds it, else into a new one. Ties: lowest item, latest bin."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made, where = 0, 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        s = sizes[i]
        fits = mask >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask &= ~(1 << left)
        else:
            left, b, made = capacity, made, made + 1
        where[i] = b
        left -= s
        if left:
            free[left].append(b)
            mask |= 1 << left
    return where


def _packer(capacity: int, slack: int, carry: int):
    return lambda t: _pack_node(t, capacity, slack, carry)


def _pack_node(t: pa.Table, capacity: int, slack: int, carry: int) -> pa.Table:
    """One node: items are the bins in column _bin; its pieces get new bins,
    of which the ``carry`` emptiest with more than ``slack`` free go up."""
    node = t.column("_node")[0].as_py()
    old, off, size = (t.column(c).to_numpy() for c in ("_bin", "_off", "length"))
    order = np.lexsort((off, old))
    new_item = np.r_[True, np.diff(old[order]) != 0]
    item = np.cumsum(new_item) - 1
    fill = np.bincount(item, weights=size[order]).astype(np.int64)
    where = np.array(best_fit(fill.tolist(), capacity), np.int64)
    # Items follow each other in their bin by item number.
    by_bin = np.lexsort((np.arange(len(fill)), where))
    ends = np.cumsum(fill[by_bin])
    starts = ends - fill[by_bin]
    first = np.r_[True, np.diff(where[by_bin]) != 0]
    base = starts[first][np.cumsum(first) - 1]
    shift = np.empty(len(fill), np.int64)
    shift[by_bin] = starts - base
    total = np.bincount(where, weights=fill).astype(np.int64)
    up = np.zeros(len(total), bool)
    open_bins = np.flatnonzero(total < capacity - slack)
    up[open_bins[np.argsort(total[open_bins], kind="stable")[:carry]]] = True
    out = t.take(pa.array(order))
    cols = {"_bin": node * (1 << 32) + where[item], "_off": off[order] + shift[item],
            "_up": up[where[item]]}
    for name, v in cols.items():
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(v))
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, carry: int = CARRY,
         leaf_pieces: int = LEAF_PIECES, fan_in: int = FAN_IN) -> DataFrame:
    """``items`` (with a long ``length`` of at most ``capacity``) plus
    sequence_id and offset. Column names starting with ``_`` are reserved."""
    cols = list(items.columns)
    base = stored(items.withColumn("_bin", F.monotonically_increasing_id()), "pieces")
    n = base.where(F.col("length") < capacity).count()
    nodes = max(1, -(-n // leaf_pieces))
    full = base.where(F.col("length") == capacity)
    done = [full.select(*cols, (-F.col("_bin") - 1).alias("sequence_id"),
                        F.lit(0).cast("long").alias("offset"))]
    todo = (base.where(F.col("length") < capacity)
                .withColumn("_node", F.pmod(F.xxhash64("_bin"), F.lit(nodes)))
                .withColumn("_off", F.lit(0).cast("long")).withColumn("_up", F.lit(False)))
    level = 0
    while True:
        last = nodes == 1
        spec = todo.schema
        packed = stored(todo.groupBy("_node").applyInArrow(
            _packer(capacity, slack, 0 if last else carry), spec), "packed")
        # Bin numbers are told apart by level (24 bits), node and bin.
        done.append(packed.where(~F.col("_up")).select(
            *cols, (F.col("_bin") * 32 + level).alias("sequence_id"),
            F.col("_off").alias("offset")))
        if last:
            break
        nodes = -(-nodes // fan_in)
        level += 1
        todo = (packed.where("_up").withColumn("_node", F.floor(F.col("_node") / fan_in))
                      .withColumn("_up", F.lit(False)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    out = pack(pieces(docs, tokenizer))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op5_hierarchical_best_fit(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), default_tokenizer())
