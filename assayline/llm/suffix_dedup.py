"""Operator 2: suffix-array dedup with a logarithmic index family.

A byte goes when a 100-byte string that covers it also starts earlier (a
smaller document id, or the same document further left).

The suffix index is sparse. Of the 81 twenty-byte grams of a 100-byte window
the one with the least hash is its anchor (ties: the leftmost), so equal
windows have equal anchors at the same offset. Neighbouring windows with the
same anchor form one run; its text (at most 180 bytes) is a context. Only
windows under one anchor hash can be equal, which deals the index over tasks.

1. Each document's contexts are hashed. Occurrences are dealt by anchor; of
   equal contexts every one but the first is covered whole. Each batch of
   rows keeps only its first occurrence of a context, so a passage that a
   third of all rows share reaches a task once a batch.
2. Anchors with different contexts (where repeated passages begin and end)
   need bytes: the first occurrence of each such context is fetched from its
   document.
3. Index family, per anchor range: contexts come in document order in batches.
   A batch gets a suffix array (all its windows, sorted); it is merge-scanned
   against the sorted levels of earlier batches; windows seen for the first
   time become a new level, and levels of like size merge, so there are
   logarithmically many. An anchor with very many different contexts is
   dealt by window instead, so it spreads over tasks too.
4. Spans are merged per document and cut out.

The parts are as many as the bytes of the text, and of the contexts to fetch,
ask for; a family with more than ``FAMILY_WINDOWS`` windows is built class by
class of the windows' hashes. So no task's memory grows with the input.

Documents with nothing to fetch or cut are passed by a bitmap filter of
bounded size and never shuffled. Documents are told apart by id and a hash of
their text: rows that agree in both are one document (each row is returned);
rows that share an id only are ordered by that hash. Other defined cases: null
text is empty; texts under 100 bytes lose nothing; a null id comes before all
others; an empty table gives an empty result; other columns are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import (bit_is_set, bitmaps, extended, partitions, power_of_two, stored,
                                  table, text_or_empty)
from assayline.llm.shingles import _stream, mix, small_columns, utf8

WINDOW, GRAM = 100, 20
SLICE = 1 << 19
#: Different contexts of one anchor in one task from which it is dealt by window.
HOT_CONTEXTS = 50_000
BATCH_CONTEXTS = 4096
#: Bytes of text whose occurrences, and of contexts that, one part holds about.
PART_TEXT, PART_CONTEXTS = 8 << 20, 16 << 20
#: Bytes of rows whose occurrences are held at once, contexts gathered at a time.
PIECE_TEXT, GATHER = 8 << 20, 1 << 15
#: Windows that an index family holds at once.
FAMILY_WINDOWS = 400_000
FILTER_BITS = 1 << 26
_U = np.uint64
_BYTE = _stream(256, 91)
_STEP = _stream(8, 97) | _U(1)
_MIX = _stream(4, 101) | _U(1)
_WORD = _stream(13, 107) | _U(1)
_NONE = np.iinfo(np.int64).min


class _Grams:
    """Hashes of all strings of 20 and (where asked) 100 bytes of a slice."""

    def __init__(self, data: np.ndarray):
        h = _BYTE[data]
        self.h4 = self._pair(self._pair(h, 1, 0), 2, 1)
        h8 = self._pair(self.h4, 4, 2)
        h16 = self._pair(h8, 8, 3)
        self.h32 = self._pair(h16, 16, 4)
        self.h64 = self._pair(self.h32, 32, 5)
        n = len(data) - GRAM + 1
        self.gram = mix(h16[:n] * _STEP[6] + self.h4[16:16 + n])

    @staticmethod
    def _pair(h: np.ndarray, step: int, k: int) -> np.ndarray:
        return h[:-step] * _STEP[k] + h[step:]

    def window(self, at: np.ndarray) -> np.ndarray:
        return mix((self.h64[at] * _STEP[6] + self.h32[at + 64]) * _STEP[7] + self.h4[at + 96])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n, step = len(v) - width + 1, 1
    while step * 2 <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return np.minimum(v[:n], v[width - step:width - step + n])


def runs(data: np.ndarray, off: np.ndarray):
    """Runs of windows with one anchor: (row, anchor, lo, hi, anchor hash,
    context hash); places count from the start of the row, lo and hi being the
    first and last window start. Long rows are worked through in slices."""
    out = []
    row, n_rows = 0, len(off) - 1
    lengths = np.diff(off)
    at = 0  # next window start inside the row
    while row < n_rows:
        if lengths[row] - at < WINDOW:
            row, at = row + 1, 0
            continue
        lo = int(off[row]) + at
        last = row
        if lengths[row] - at > SLICE:
            hi = lo + SLICE
        else:
            # Whole rows up to the slice size.
            last = max(row, int(np.searchsorted(off, lo + SLICE, side="right")) - 2)
            hi = int(off[last + 1])
        part = data[lo:hi]
        bounds = np.minimum(off[row:last + 2] - lo, len(part))
        bounds[0] = 0
        g = _Grams(part)
        bits = max(1, int(len(part)).bit_length())
        place = np.arange(len(g.gram), dtype=np.uint64)
        keyed = (g.gram >> _U(bits) << _U(bits)) | place
        anchor = (_least(keyed, WINDOW - GRAM + 1) & _U((1 << bits) - 1)).astype(np.int64)
        owner = np.repeat(np.arange(last + 1 - row), np.diff(bounds))[:len(anchor)]
        valid = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= bounds[1:][owner])
        if len(valid):
            a, o = anchor[valid], owner[valid]
            cut = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(o) != 0)])
            first, final = valid[cut], valid[np.r_[cut[1:], len(valid)] - 1]
            a, o = a[cut], o[cut]
            ctx = mix(g.window(first) * _MIX[0] + g.window(final) * _MIX[1]
                      + (a - first).astype(np.uint64) * _MIX[2]
                      + (final - first).astype(np.uint64) * _MIX[3])
            base = np.where(o == 0, lo - off[row], lo - off[row + o])
            out.append((row + o, a + base, first + base, final + base, g.gram[a], ctx))
        if hi < off[last + 1]:
            at += len(part) - WINDOW + 1
        else:
            row, at = last + 1, 0
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.astype(np.uint64), e.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _dealt(part: np.ndarray, cols: dict[str, np.ndarray], kind: int) -> list[tuple]:
    """(kind, part, blob of every column) for each part."""
    at = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(part[at]) != 0, True]) if len(at) else [0]
    sorted_ = [c[at] for c in cols.values()]
    return [(kind, int(part[at[lo]]), *[c[lo:hi].tobytes() for c in sorted_])
            for lo, hi in zip(cuts, cuts[1:])]


def _blob(t: pa.Table | pa.RecordBatch, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in t.column(name)), kind)


def _doc_part(doc: np.ndarray, tie: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(np.uint64) + tie.view(np.uint64) * _MIX[0]) % _U(parts)).astype(np.int64)


#: kind 0: spans (dealt by document: doc, tie, lo, hi); kind 1: occurrences (dealt
#: by anchor: with fp, ctx, a); kind 2: contexts to fetch (dealt by document).
_ROWS = ("kind int, part long, doc binary, tie binary, lo binary, hi binary, a binary, "
         "fp binary, ctx binary")
_NAMES = ["kind", "part", "doc", "tie", "lo", "hi", "a", "fp", "ctx"]
_KINDS = (pa.int32(), pa.int64(), *[pa.binary()] * 7)
_ENDS = {"a": np.int64, "fp": np.uint64, "ctx": np.uint64}


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*[r + (None,) * (9 - len(r)) for r in rows])) or [[]] * 9
    return pa.table([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def _spans(doc, tie, lo, hi, parts: int) -> list[tuple]:
    """Rows of kind 0; neighbouring spans of a document are merged first."""
    if not len(doc):
        return []
    doc, tie, lo, hi = merged(doc, tie, lo, hi)
    return _dealt(_doc_part(doc, tie, parts), {"doc": doc, "tie": tie, "lo": lo, "hi": hi}, 0)


def merged(doc, tie, lo, hi):
    """Maximal spans [lo, hi) of every document, sorted."""
    at = np.lexsort((lo, tie, doc))
    doc, tie, lo, hi = doc[at], tie[at], lo[at], hi[at]
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(tie) != 0)]
    group = np.cumsum(new) - 1
    # The furthest end so far inside a document: offset by group keeps them apart.
    # Groups times the longest document stay far from the integers' end.
    span = (hi.max() + 1 if len(hi) else np.int64(1)).astype(np.int64)
    reach = np.maximum.accumulate(hi + group * span) - group * span
    start = new | np.r_[True, lo[1:] > reach[:-1]]
    first = np.flatnonzero(start)
    final = np.r_[first[1:], len(lo)] - 1
    return doc[first], tie[first], lo[first], reach[final]


def _occurrences(docs: DataFrame, parts: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, n, texts in ((b, *piece) for b in batches
                            for piece in small_columns(b.column(2), PIECE_TEXT)):
            ids = b.column(0).fill_null(_NONE).to_numpy()[n:]
            ties = b.column(1).to_numpy()[n:]
            row, a, lo, hi, fp, ctx = runs(*utf8(texts))
            if not len(row):  # short texts only
                continue
            doc, tie = ids[row], ties[row]
            # The first of equal contexts in this piece stands for all of them.
            at = np.lexsort((a, tie, doc, ctx, fp))
            same = np.r_[False, (np.diff(fp[at]) == 0) & (np.diff(ctx[at]) == 0)]
            again, first = at[same], at[~same]
            # Rows that are one document are no repeats of each other.
            if len(again):
                head = at[np.maximum.accumulate(np.where(~same, np.arange(len(at)), 0))][same]
                own = ((doc[head] == doc[again]) & (tie[head] == tie[again])
                       & (a[head] == a[again]))
                again = again[~own]
            rows = _spans(doc[again], tie[again], lo[again], hi[again] + WINDOW, parts)
            part = (mix(fp[first]) % _U(parts)).astype(np.int64)
            rows += _dealt(part, {"doc": doc[first], "tie": tie[first], "lo": lo[first],
                                  "hi": hi[first], "a": a[first], "fp": fp[first],
                                  "ctx": ctx[first]}, 1)
            yield from _table(rows).to_batches()

    return docs.select("_sa_doc", "_sa_tie", "_sa_text").mapInArrow(emit, _ROWS)


def _first_contexts(t: pa.Table, parts: int, hot: int) -> pa.Table:
    """Occurrences under one range of anchors: spans of all but the first of
    equal contexts; the firsts of anchors with several contexts (ctx: 1 when
    the anchor is hot, else 0)."""
    doc, tie, lo, hi, a = (_blob(t, c, np.int64) for c in ("doc", "tie", "lo", "hi", "a"))
    fp, ctx = _blob(t, "fp", np.uint64), _blob(t, "ctx", np.uint64)
    at = np.lexsort((a, tie, doc, ctx, fp))
    doc, tie, lo, hi, a, fp, ctx = (x[at] for x in (doc, tie, lo, hi, a, fp, ctx))
    first = np.r_[True, (np.diff(fp) != 0) | (np.diff(ctx) != 0)]
    head = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
    own = (doc == doc[head]) & (tie == tie[head]) & (a == a[head])
    again = ~own
    rows = _spans(doc[again], tie[again], lo[again], hi[again] + WINDOW, parts)
    anchor = np.flatnonzero(np.r_[True, np.diff(fp) != 0])
    size = np.diff(np.r_[anchor, len(fp)])
    variants = np.add.reduceat(first.astype(np.int64), anchor)
    v = np.repeat(variants, size)
    ask = first & (v > 1)
    if ask.any():
        heat = (v[ask] >= hot).astype(np.uint64)
        rows += _dealt(_doc_part(doc[ask], tie[ask], parts),
                       {"doc": doc[ask], "tie": tie[ask], "lo": lo[ask], "hi": hi[ask],
                        "a": a[ask], "fp": fp[ask], "ctx": heat}, 2)
    return _table(rows)


def _by_document(t: pa.Table) -> pa.Table:
    """One row a document from blobs dealt by document; spans merged, contexts
    to fetch without repeats."""
    doc, tie, lo, hi = (_blob(t, c, np.int64) for c in ("doc", "tie", "lo", "hi"))
    more = [c for c in ("a", "fp", "ctx") if t.column(c).null_count == 0]
    if more:
        rest = [_blob(t, c, _ENDS[c]) for c in more]
        at = np.lexsort((lo, tie, doc))
        doc, tie, lo, hi, *rest = (x[at] for x in (doc, tie, lo, hi, *rest))
    else:
        (doc, tie, lo, hi), rest = merged(doc, tie, lo, hi), []
    cut = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(tie) != 0), True])
    pairs = list(zip(cut, cut[1:]))
    cols = [lo, hi, *rest]
    names = ["_sa_doc", "_sa_tie", "_sa_lo", "_sa_hi", *[f"_sa_{c}" for c in more]]
    arrays = [pa.array(doc[cut[:-1]]), pa.array(tie[cut[:-1]]),
              *[pa.array([c[i:j].tobytes() for i, j in pairs], pa.binary()) for c in cols]]
    for c in ("a", "fp", "ctx"):
        if c not in more:
            arrays.append(pa.nulls(len(pairs), pa.binary()))
            names.append(f"_sa_{c}")
    return pa.table(arrays, names=names)


_PER_DOC = ("_sa_doc long, _sa_tie long, _sa_lo binary, _sa_hi binary, _sa_a binary, "
            "_sa_fp binary, _sa_ctx binary")


def per_document(rows: DataFrame, label: str) -> DataFrame:
    return stored(rows.groupBy("part").applyInArrow(_by_document, _PER_DOC), label)


def with_rows(docs: DataFrame, per_doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents joined with their row of ``per_doc``, the other documents).
    Only documents that pass a bitmap filter are shuffled."""
    bits = power_of_two(16 * per_doc.count(), 1 << 15, FILTER_BITS)
    place = F.pmod(F.xxhash64("_sa_doc", "_sa_tie"), F.lit(bits))
    filt = stored(bitmaps(per_doc.select(place.alias("p"))), "filter")
    filt = F.broadcast(filt.select(F.col("block").alias("_sa_block"),
                                   F.col("bits").alias("_sa_bits")))
    marked = (docs.withColumn("_sa_p", place)
                  .withColumn("_sa_block", F.shiftright("_sa_p", 15))
                  .join(filt, "_sa_block", "left")
                  .withColumn("_sa_maybe", bit_is_set(F.col("_sa_bits"),
                                                      F.col("_sa_p").bitwiseAND(32767))))
    keys = ["_sa_doc", "_sa_tie"]
    maybe = marked.where("_sa_maybe").select(*docs.columns)
    return (maybe.join(per_doc, keys, "left"),
            marked.where(~F.col("_sa_maybe")).select(*docs.columns))


_CONTEXTS = "part long, doc binary, tie binary, lo binary, hi binary, size binary, text binary"
_CONTEXT_NAMES = ["part", "doc", "tie", "lo", "hi", "size", "text"]


def fetched_bytes(asked: DataFrame) -> int:
    """Bytes of all contexts to fetch (one number a batch reaches Spark)."""
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi = (_blob(b, c, np.int64) for c in ("_sa_lo", "_sa_hi"))
            hot = _blob(b, "_sa_ctx", np.uint64) > 0
            n = np.where(hot, (hi - lo + 1) * WINDOW, hi - lo + WINDOW).sum()
            yield pa.RecordBatch.from_arrays([pa.array([int(n)], pa.int64())], names=["n"])

    rows = asked.select("_sa_lo", "_sa_hi", "_sa_ctx").mapInArrow(sizes, "n long")
    return rows.agg(F.sum("n")).first()[0] or 0


def window_hash(windows: np.ndarray) -> np.ndarray:
    """Hash of each row of WINDOW bytes."""
    h = np.zeros(len(windows), np.uint64)
    for k, at in enumerate((*range(0, WINDOW - 8, 8), WINDOW - 8)):
        h += windows[:, at:at + 8].view(np.uint64)[:, 0] * _WORD[k]
    return mix(h)


def _windows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at])


def _inside(count: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _gathered(data: np.ndarray, part: np.ndarray, cols: list[np.ndarray], begin: np.ndarray,
              size: np.ndarray) -> pa.RecordBatch:
    """A row a part: its contexts' columns, sizes and bytes."""
    at = np.argsort(part, kind="stable")
    part, begin, size = part[at], begin[at], size[at]
    text = data[np.repeat(begin, size) + _inside(size)]
    cut = np.flatnonzero(np.r_[True, np.diff(part) != 0, True])
    ends = np.r_[0, np.cumsum(size)][cut]
    arrays = [pa.array(part[cut[:-1]])]
    for c in (*(c[at] for c in cols), size):
        arrays.append(pa.array([c[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()))
    arrays.append(pa.array([text[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=_CONTEXT_NAMES)


def _contexts(asked: DataFrame, parts: int) -> DataFrame:
    """Bytes of the contexts to fetch, dealt by anchor, or by window where the
    anchor is hot."""
    cols = [f"_sa_{c}" for c in ("doc", "tie", "text", "lo", "hi", "fp", "ctx")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            lo, hi = (_blob(b, c, np.int64) for c in ("_sa_lo", "_sa_hi"))
            fp, heat = (_blob(b, c, np.uint64) for c in ("_sa_fp", "_sa_ctx"))
            n = pc.binary_length(b.column(3)).to_numpy() // 8
            doc, tie = (np.repeat(b.column(k).to_numpy(), n) for k in (0, 1))
            begin = np.repeat(off[:-1], n) + lo
            cold, hot = np.flatnonzero(heat == 0), np.flatnonzero(heat)
            for s in range(0, len(cold), GATHER):
                at = cold[s:s + GATHER]
                part = (mix(fp[at]) % _U(parts)).astype(np.int64)
                yield _gathered(data, part, [doc[at], tie[at], lo[at], hi[at]], begin[at],
                                hi[at] - lo[at] + WINDOW)
            step = max(1, GATHER // WINDOW)
            for s in range(0, len(hot), step):
                own = hot[s:s + step]
                count = hi[own] - lo[own] + 1
                at, more = np.repeat(own, count), _inside(count)
                start, w = begin[at] + more, lo[at] + more
                part = (window_hash(_windows(data, start)) % _U(parts)).astype(np.int64)
                yield _gathered(data, part, [doc[at], tie[at], w, w], start,
                                np.full(len(at), WINDOW))

    return asked.select(*cols).mapInArrow(emit, _CONTEXTS)


class IndexFamily:
    """Sorted levels of the 100-byte strings met so far; sizes at least double
    from each level to the next larger one."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, windows: np.ndarray) -> np.ndarray:
        """Whether each window of a batch (in order) was met before, in the
        batch or an earlier one; new ones join the family."""
        array = np.argsort(windows, kind="stable")
        ordered = windows[array]
        old = np.r_[False, ordered[1:] == ordered[:-1]]
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, ordered), len(level) - 1)
            old |= level[at] == ordered
        fresh = ordered[~old]
        if len(fresh):
            self.levels.append(fresh)
            while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
                both = np.concatenate(self.levels[-2:])
                both.sort(kind="stable")
                self.levels[-2:] = [both]
        seen = np.empty(len(windows), bool)
        seen[array] = old
        return seen


def _scan_family(t: pa.Table, parts: int) -> pa.Table:
    """Spans of repeated windows among the contexts of one range of anchors."""
    doc, tie, lo, hi, size = (_blob(t, c, np.int64) for c in ("doc", "tie", "lo", "hi", "size"))
    text = _blob(t, "text", np.uint8)
    begin = np.cumsum(size) - size
    order = np.lexsort((lo, tie, doc))
    # Rows that are one document bring their contexts more than once.
    order = order[np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(tie[order]) != 0)
                        | (np.diff(lo[order]) != 0)]]
    count = hi - lo + 1
    found: list[tuple] = []
    # Equal windows are of one class, so each class has a family of its own.
    classes = max(1, -(-int(count[order].sum()) // FAMILY_WINDOWS))
    known: list[np.ndarray] = []
    for k in range(classes):
        family = IndexFamily()
        for i, s in enumerate(range(0, len(order), BATCH_CONTEXTS)):
            own = order[s:s + BATCH_CONTEXTS]
            ctx, inside = np.repeat(own, count[own]), _inside(count[own])
            if classes > 1:
                if not k:
                    h = mix(window_hash(_windows(text, begin[ctx] + inside)) ^ _WORD[0])
                    known.append((h % _U(classes)).astype(np.uint32))
                some = known[i] == k
                ctx, inside = ctx[some], inside[some]
            if len(ctx):
                windows = _windows(text, begin[ctx] + inside).view(f"S{WINDOW}").ravel()
                seen = family.add(windows)
                at = lo[ctx[seen]] + inside[seen]
                found.append((doc[ctx[seen]], tie[ctx[seen]], at, at + WINDOW))
    return _table(_spans(*[np.concatenate(c) for c in zip(*found)], parts))


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = text_or_empty(text)
    return (docs.withColumn("_sa_doc", F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)))
                .withColumn("_sa_tie", F.xxhash64(t)).withColumn("_sa_text", t))


def repeated_spans(own: DataFrame, parts: int, hot: int = HOT_CONTEXTS) -> DataFrame:
    """(_sa_doc, _sa_tie, _sa_lo, _sa_hi): removed spans of every document that has
    any, as blobs of int64, from rows made by :func:`keyed`."""
    n = own.agg(F.sum(F.octet_length("_sa_text").cast("long"))).first()[0] or 0
    parts = max(parts, -(-n // PART_TEXT))
    met = stored(_occurrences(own, parts), "met")
    judged = stored(met.where("kind = 1").groupBy("part").applyInArrow(
        lambda t: _first_contexts(t, parts, hot), _ROWS), "judged")
    asked = per_document(judged.where("kind = 2"), "asked")
    here, _ = with_rows(own.select("_sa_doc", "_sa_tie", "_sa_text"), asked)
    ranges = max(parts, -(-fetched_bytes(asked) // PART_CONTEXTS))
    contexts = _contexts(here.where("_sa_lo is not null"), ranges)
    edges = stored(contexts.groupBy("part").applyInArrow(lambda t: _scan_family(t, parts), _ROWS),
                   "edges")
    spans = (met.where("kind = 0").union(judged.where("kind = 0")).union(edges))
    return per_document(spans, "spans").select("_sa_doc", "_sa_tie", "_sa_lo", "_sa_hi")


def _cut(raw: bytes, lo, hi) -> tuple[list[bytes], int, int]:
    """(kept pieces, removed bytes, number of spans)."""
    if lo is None:
        return [raw], 0, 0
    lo, hi = np.frombuffer(lo, np.int64).tolist(), np.frombuffer(hi, np.int64).tolist()
    kept = [raw[s:e] for s, e in zip([0, *hi], [*lo, len(raw)])]
    return kept, sum(hi) - sum(lo), len(lo)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus _sa_lo and _sa_hi (null: nothing to cut)."""
    own = keyed(docs, id_col, text)
    spans = repeated_spans(own, partitions(docs.sparkSession))
    cut, clean = with_rows(own, spans)
    none = F.lit(None).cast("binary")
    return cut.select(*own.columns, "_sa_lo", "_sa_hi").union(
        clean.select(*own.columns, none.alias("_sa_lo"), none.alias("_sa_hi")))


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = deduplicated(docs).select("doc_id", "_sa_text", "_sa_lo", "_sa_hi")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, spans, sha = [], [], [], []
            for t, lo, hi in zip(*[b.column(k) for k in (1, 2, 3)]):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                kept, n, k = _cut(raw, lo.as_py(), hi.as_py())
                h = hashlib.sha256()
                for piece in kept:
                    h.update(piece)
                size.append(len(raw))
                gone.append(n)
                spans.append(k)
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in (size, gone, spans)],
                 pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(digest, extended(rows.select("doc_id"), n_bytes="long",
                                            n_removed="long", n_spans="long",
                                            kept_sha256="string"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the text (a character that
    was cut through goes too); null stays null; ``n_chars`` follows."""
    columns = docs.columns
    rows = deduplicated(docs, id_col, text)
    at, lo_at, hi_at = columns.index(text), len(columns), len(columns) + 1
    rows = rows.select(*columns, "_sa_lo", "_sa_hi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, lo, hi in zip(b.column(at), b.column(lo_at), b.column(hi_at)):
                t = t.as_py()
                if t is not None and lo.is_valid:
                    raw = t.encode("utf-8", "surrogatepass")
                    t = b"".join(_cut(raw, lo.as_py(), hi.as_py())[0]).decode("utf-8", "ignore")
                out.append(t)
            cols = list(b.columns[:len(columns)])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    out = rows.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in columns else out
