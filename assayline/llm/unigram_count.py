"""Operator 8: token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary matches of a chunk; the
dynamic program keeps, per end position, only the best score and the piece
count that goes with it (no back pointers, no pieces). Tie rules are those of
the tokenizer library's unigram model: matches are tried by rising start
position and, from one start, by rising length; a later one replaces an
earlier one only when strictly better; a character without a piece of its own
costs the lowest score less 10; neighbouring unknown characters fuse into one
segment, which falls back to one token a UTF-8 byte.

Text preparation: every space becomes U+2581, and one is put in front. No
vocabulary piece has U+2581 after another character, so the best path of a
text is that of its chunks (a run of U+2581 and what follows), and chunks
repeat: each worker keeps the counts of chunks it has met (bounded table).
A chunk without spaces may be a whole long document; the program is linear in
it and keeps a window of the longest piece, whatever the chunk's length (the
automaton reads its own copy of the text, 4 bytes a character). The work is a map over the documents: nothing is shuffled.

The vocabulary is a parameter: pieces and scores of the SentencePiece file
given, taken as unigram scores (control and byte pieces match no text).

Defined cases: null and empty texts have 0 tokens; repeated rows and null ids
give one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from assayline.llm.common import extended, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 1_000_000
CACHED_CHARS = 64
_CHUNK = re.compile("▁+[^▁]*|[^▁]+")


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.byte_fallback = byte_fallback
        self.low = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def chunk(self, text: str) -> int:
        """Tokens of one chunk. The automaton gives matches in order of their
        ends, so scores and counts are kept for a window of the longest piece."""
        w = self.longest + 1
        best, count = [0.0] * w, [0] * w
        matches = self.automaton.iter(text)
        match = next(matches, None)
        # Bytes of the unknown run that ends here (0: the last piece is known).
        run = 0
        for i, letter in enumerate(text):
            found = []
            while match is not None and match[0] == i:
                found.append(match[1])
                match = next(matches, None)
            if len(found) > 1:
                found.sort(reverse=True)
            top, before, unknown = None, -1, False
            # Longest match first is rising start position.
            for size, score in found:
                got = best[(i + 1 - size) % w] + score
                if top is None or got > top:
                    top, before, unknown = got, i + 1 - size, False
            if letter not in self.single:
                got = best[i % w] + self.low
                if top is None or got > top:
                    top, unknown = got, True
            if unknown:
                size = len(letter.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1
                longer = run + size if run and self.byte_fallback else size
                now, run = count[i % w] - run + longer, longer
            else:
                now, run = count[before % w] + 1, 0
            best[(i + 1) % w], count[(i + 1) % w] = top, now
        return count[len(text) % w]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        total, known = 0, self.known
        for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE)):
            k = known.get(c)
            if k is None:
                k = self.chunk(c)
                if len(c) <= CACHED_CHARS:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[c] = k
            total += k
        return total


def sentencepiece_scores(model_file: str) -> list[tuple[str, float]]:
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


_COUNTERS: dict[str, UnigramCounter] = {}


def _counter(model_file: str) -> UnigramCounter:
    if model_file not in _COUNTERS:
        pieces = sentencepiece_scores(model_file)
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece holds a space inside: chunks would not be independent")
        _COUNTERS[model_file] = UnigramCounter(pieces)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(id, n_tokens)."""
    rows = docs.select(id_col, text)
    schema = extended(rows.select(id_col), n_tokens="long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for b in batches:
            n = [counter(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())],
                                             names=[id_col, "n_tokens"])

    return rows.mapInArrow(count, schema)


def op8_unigram_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("piece_bpe_32k.model"))
