"""Operator 10: toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses at ``.``, ``!``, ``?``, ``;``, line ends, and
colons that follow no report word. Transducers run over the tokens of a clause;
all but the lexicon are transition tables (:class:`Machine`):

1. lexicon: token -> symbol (insult, threat, target, negation, report, quote,
   other) with a weight;
2. negation (``NEGATING``): for ``SCOPE`` tokens after a negation, insults and
   threats weigh ``NEGATED`` times as much; any contraction in n't negates,
   with a plain or a typographic apostrophe;
3. reported speech (``REPORTING``): after a report word, also across a colon,
   or between quotation marks, they weigh ``REPORTED`` times as much; an open
   quotation runs on over sentences up to the end of its line;
4. target (``AIMING``): an insult or threat up to ``REACH`` tokens after or
   before a target gains ``AIMED``.

2, 3 and 4 are composed into one machine (``CONTEXT``) that reads a clause
forwards; ``AIMING`` reads it once more backwards.

A clause scores the sum of its weights; the document's score is a logistic of
its strongest clause, its clause total and the share of clauses that matched.
Prose with few punctuation marks counts as several clauses here, one for each
``CLAUSE_TOKENS`` tokens; the transducers run on across these cuts.

Insult weights are learned: words and word beginnings (4 to 6 letters, so that
inflected forms share an entry) that occur significantly more often in toxic
training documents than their share (binomial divergence against the number
of entries tried), weighted by smoothed log odds; a word of more than
``LONG_WORD`` characters is told by a digest of all of them. The logistic is fitted on
the same documents. Training rows: labelled rows whose
crc32(id as text) mod 5 is not 0, at most ``TRAIN_ROWS`` of them, the first by
a hash of the id (documented bound, as small as a broadcast); counting is a
Spark aggregate and at most ``LEXICON`` entries reach the driver. Scores use
the text alone.

Defined cases: null and empty texts have no clause and get the base score;
without training rows of both kinds the seed words alone score; several
labels of one id count as toxic when one does; null ids are never held out or
trained on and are scored; repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import extended, partitions, table

TRAIN_ROWS, LEXICON = 12_000, 5_000
SCOPE, REACH = 3, 4
NEGATED, REPORTED, AIMED, THREAT_WEIGHT = 0.4, 0.7, 0.5, 1.0
STEMS = (4, 5, 6)
LONG_WORD = 40
#: The weights of a long clause are summed per stride of so many tokens.
CLAUSE_TOKENS = 64

#: Seed words of the grammar's closed classes (fixed values).
TARGET = frozenset("you your yours yourself u ya he she they them him her his their du dich dir "
                   "ihr euch dein tu te toi vous ton usted ustedes ti vosotros".split())
NEGATION = frozenset("not no never nor neither without cannot nicht "
                     "kein keine nie pas jamais sans nunca jamás sin tampoco".split())
REPORT = frozenset("said says say saying wrote writes quote quoted quoting reported claims "
                   "claimed called sagte sagt dit disait dijo dice".split())
THREAT = frozenset("kill killing hurt hurting destroy destroying murder murdering töten sterben tuer mourir matar morir".split())
INSULTS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb "
                    "jerk fool imbecile".split())
SEED_WEIGHT = 3.0
QUOTES = frozenset("\"“”«»„")

_CUT = re.compile(r"([.!?;:\n\r]+)")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»„]")
SYMBOLS = OTHER, INSULT, AT, NOT, SAYS, QUOTE = range(6)
#: Marks that the machines write on a token.
IS_NEGATED, IS_REPORTED, IS_AIMED = 1, 2, 4


class Machine(NamedTuple):
    """A transducer as tables [state][symbol]: the next state and the marks
    written on the token. State 0 is the start."""
    follow: list[list[int]]
    marks: list[list[int]]

    def run(self, symbols: list[int], state: int = 0) -> tuple[list[int], int]:
        """Marks of every token, and the last state."""
        out = []
        for k in symbols:
            out.append(self.marks[state][k])
            state = self.follow[state][k]
        return out, state


def countdown(trigger: int, steps: int, mark: int) -> Machine:
    """Marks the ``steps`` tokens after each trigger; a state is what is left."""
    states = range(steps + 1)
    return Machine([[steps if k == trigger else max(0, s - 1) for k in SYMBOLS] for s in states],
                   [[mark if s else 0 for _ in SYMBOLS] for s in states])


def reporting() -> Machine:
    """States: 1 after a report word, 2 inside a quotation, 3 both."""
    step = {SAYS: lambda s: s | 1, QUOTE: lambda s: s ^ 2}
    return Machine([[step[k](s) if k in step else s for k in SYMBOLS] for s in range(4)],
                   [[IS_REPORTED if s else 0 for _ in SYMBOLS] for s in range(4)])


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines at once; a state is (state of a) * (states of b) + (state of b)."""
    pairs = [(x, y) for x in range(len(a.follow)) for y in range(len(b.follow))]
    return Machine([[a.follow[x][k] * len(b.follow) + b.follow[y][k] for k in SYMBOLS]
                    for x, y in pairs],
                   [[a.marks[x][k] | b.marks[y][k] for k in SYMBOLS] for x, y in pairs])


NEGATING = countdown(NOT, SCOPE, IS_NEGATED)
REPORTING = reporting()
AIMING = countdown(AT, REACH, IS_AIMED)
CONTEXT = compose(compose(NEGATING, REPORTING), AIMING)
#: State of CONTEXT at the start of a clause inside a quotation.
IN_QUOTATION = 2 * len(AIMING.follow)


def tokens(clause: str) -> list[str]:
    return _TOKEN.findall(clause)


def entries(word: str) -> list[str]:
    """Lexicon keys of a word: itself and its beginnings (ending in ``*``)."""
    own = word
    if len(word) > LONG_WORD:
        own = "#" + hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=16).hexdigest()
    return [own, *[word[:k] + "*" for k in STEMS if len(word) > k]]


class Grammar:
    def __init__(self, lexicon: dict[str, float], logistic: tuple[float, ...]):
        self.lexicon, self.logistic = lexicon, logistic
        self.read: dict[str, tuple[int, float]] = {}

    def symbol(self, token: str) -> tuple[int, float]:
        """Lexicon transducer."""
        got = self.read.get(token)
        if got is None:
            plain = token.replace("’", "'")
            weight = max((self.lexicon.get(e, 0.0) for e in entries(token)), default=0.0)
            if token in INSULTS:
                weight = max(weight, SEED_WEIGHT)
            if token in QUOTES:
                got = QUOTE, 0.0
            elif plain in NEGATION or plain.endswith("n't"):
                got = NOT, 0.0
            elif token in TARGET:
                got = AT, 0.0
            elif token in REPORT:
                got = SAYS, 0.0
            elif token in THREAT:
                # Said without a target, a threat word is ordinary prose.
                got = INSULT, max(weight, 0.0)
            else:
                got = (INSULT, weight) if weight > 0 else (OTHER, 0.0)
            if len(self.read) >= 500_000:
                self.read.clear()
            self.read[token] = got
        return got

    def clause(self, words: list[str], symbols: list[tuple[int, float]] | None = None,
               quoted: bool = False) -> list[float]:
        """Weights of a clause, summed per stride of ``CLAUSE_TOKENS`` tokens;
        the transducers run over the whole clause, in linear time."""
        sums = [0.0] * -(-len(words) // CLAUSE_TOKENS)
        symbols = [self.symbol(w) for w in words] if symbols is None else symbols
        kinds = [k for k, _ in symbols]
        if INSULT not in kinds:
            return sums
        before, _ = CONTEXT.run(kinds, IN_QUOTATION if quoted else 0)
        after, _ = AIMING.run(kinds[::-1])
        for i, (k, w) in enumerate(symbols):
            if k != INSULT:
                continue
            marks = before[i] | after[-1 - i]
            aimed = bool(marks & IS_AIMED)
            if aimed and words[i] in THREAT:
                w = max(w, THREAT_WEIGHT)
            if w > 0:
                w += AIMED * aimed
                w *= NEGATED if marks & IS_NEGATED else 1.0
                w *= REPORTED if marks & IS_REPORTED else 1.0
                sums[i // CLAUSE_TOKENS] += w
        return sums

    def clauses(self, text: str) -> Iterator[list[float]]:
        """Weights of each clause of a text in lower case."""
        words: list[str] = []
        symbols: list[tuple[int, float]] = []
        quoted = False
        pieces = _CUT.split(text)
        for piece, cut in zip(pieces[::2], [*pieces[1::2], "\n"]):
            new = tokens(piece)
            words += new
            symbols += [self.symbol(w) for w in new]
            if cut.strip(":") == "" and any(k == SAYS for k, _ in symbols):
                continue
            yield self.clause(words, symbols, quoted)
            if "\n" in cut or "\r" in cut:
                quoted = False
            elif sum(k == QUOTE for k, _ in symbols) % 2:
                quoted = not quoted
            words, symbols = [], []

    def features(self, text: str | None) -> tuple[float, float, float]:
        top = total = 0.0
        n = hits = 0
        for sums in self.clauses((text or "").lower()):
            for s in sums:
                n += 1
                if s > 0:
                    hits += 1
                    total += s
                    top = max(top, s)
        return top, math.log1p(total), hits / n if n else 0.0

    def score(self, text: str | None) -> float:
        z = self.logistic[0] + sum(a * b for a, b in zip(self.logistic[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, rows: int) -> DataFrame:
    """(toxic, text) of at most ``rows`` labelled training documents. The
    label side is bounded by ``rows``, so it is broadcast."""
    own = (labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
                 .where(~held_out(id_col)).groupBy(id_col)
                 .agg(F.max("toxic").alias("_tx_toxic"))
                 .orderBy(F.xxhash64(id_col), id_col).limit(rows))
    return docs.select(id_col, "text").join(F.broadcast(own), id_col).select(
        F.col("_tx_toxic").cast("int").alias("toxic"), "text")


def learn_lexicon(train: DataFrame, n_toxic: int, n_clean: int,
                  size: int = LEXICON) -> dict[str, float]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()),
                 *[pa.array([s[k] for k in keys], pa.int64()) for s in (seen[1], seen[0])]],
                names=["entry", "bad", "good"])
            for s in seen:
                s.clear()
            return out

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = set(_TOKEN.findall((t.as_py() or "").lower()))
                seen[int(y == 1)].update({e for w in words for e in entries(w)})
                if len(seen[0]) + len(seen[1]) > 2_000_000:
                    yield flush()
        yield flush()

    counts = (train.mapInArrow(count, "entry string, bad long, good long").groupBy("entry")
              .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
              .where("bad + good >= 3"))
    tried = F.lit(math.log(1e6))  # entries that could be tried, as a logarithm
    share = n_toxic / (n_toxic + n_clean)
    n = (F.col("bad") + F.col("good")).cast("double")
    p = F.col("bad") / n
    part = lambda x, y: F.when(x > 0, x * F.log(x / F.lit(y))).otherwise(0.0)
    divergence = n * (part(p, share) + part(1 - p, 1 - share))
    weight = (F.log((F.col("bad") + 0.5) / F.lit(n_toxic + 1.0))
              - F.log((F.col("good") + 0.5) / F.lit(n_clean + 1.0)))
    kept = (counts.where((p > 3 * share) & (p >= 0.6) & (divergence >= tried))
                  .select("entry", weight.alias("w"), divergence.alias("d"))
                  .orderBy(F.desc("d"), "entry").limit(size).collect())
    return {r["entry"]: min(6.0, r["w"]) for r in kept}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; a few columns only."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    pen = ridge * np.eye(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - pen @ w
        h = (a * (p * (1 - p))[:, None]).T @ a + pen
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def train_grammar(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  rows: int = TRAIN_ROWS) -> Grammar:
    spark = docs.sparkSession
    train = training_rows(docs, labels, id_col, rows)
    train = train.repartition(max(1, partitions(spark) // 4)).persist()
    try:
        n = {r["toxic"]: r["n"] for r in
             train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        bad, good = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
        if not bad or not good:
            return Grammar({}, (-2.5, 1.0, 0.0, 0.0))
        bare = Grammar(learn_lexicon(train, bad, good), (0.0, 0.0, 0.0, 0.0))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = Grammar(bare.lexicon, bare.logistic)
            for b in batches:
                f = [g.features(t.as_py()) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array([v[i] for v in f], pa.float64()) for i in range(3)]],
                    names=["toxic", "a", "b", "c"])

        # At most `rows` rows of four numbers.
        got = train.mapInArrow(features, "toxic int, a double, b double, c double").collect()
        got = sorted(tuple(r) for r in got)
    finally:
        train.unpersist()
    m = np.array(got, float)
    return Grammar(bare.lexicon, fit_logistic(m[:, 1:], (m[:, 0] == 1).astype(float)))


def scored(docs: DataFrame, grammar: Grammar, out: str = "score") -> DataFrame:
    """``docs`` plus a double score from 0 to 1."""
    lexicon, logistic = grammar.lexicon, grammar.logistic
    at = docs.columns.index("text")
    schema = extended(docs, **{out: "double"})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(lexicon, logistic)
        for b in batches:
            s = pa.array([g.score(t.as_py()) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, out])

    return docs.mapInArrow(score, schema)


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that the grammar does not reject, columns unchanged."""
    g = train_grammar(docs, labels)
    return scored(docs, g, "_tx_score").where("_tx_score < 0.5").drop("_tx_score")


def op10_toxicity_grammar(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    g = train_grammar(docs, table(spark, sf_dir, "labels"))
    return scored(docs, g).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                  (F.col("score") >= 0.5).cast("int").alias("predicted"))
