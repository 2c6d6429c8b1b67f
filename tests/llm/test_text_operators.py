import hashlib
import json

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, models, normalizers

from llm_tables import SF001, edge, empty, small_docs  # noqa: F401

from assayline.llm import bpe_words, toxicity_grammar, unigram_count, url_reputation


def test_word_bpe_matches_the_library(edge, empty, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {}
    enc = bpe_words.encode_documents(edge, path)
    for r in enc.collect():
        got.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    for r in edge.collect():
        want = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert want in got[r["doc_id"]], r["doc_id"]
    back = {r["doc_id"]: r["text"] for r in bpe_words.decode_documents(enc, path).collect()}
    for r in edge.where("doc_id is not null").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert back[r["doc_id"]] == t.decode(ids, skip_special_tokens=False)
    assert bpe_words.encode_documents(empty, path).count() == 0


def test_word_bpe_query(spark, small_docs, monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: tuple(r)[1:] for r in
           bpe_words.op6_distinct_word_bpe(spark, SF001).collect()}
    assert len(got) == len(small_docs)
    for i, x in small_docs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(t.decode(ids, skip_special_tokens=False)
                                         .encode()).hexdigest())


def test_plain_path_equals_the_library_path():
    s = bpe_words.splitter(public_tokenizers.path("word_bpe_49k.json"))
    every = "".join(chr(c) for c in range(1, 0x2100)
                    if bpe_words._PLAIN.fullmatch(chr(c)))
    texts = [every, "It's I'LL don't we'Ve 'd 123 a1b2 «x» é-à", *[f"a{c}b {c}1{c}'s" for c in every]]
    for x in texts:
        assert bpe_words._WORD.findall(x.lower()) == s._exact(x), x


def _unigram():
    pieces = unigram_count.sentencepiece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    vocab = [("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    low = min(s for _, s in pieces)
    # Entries that no text matches must not change the lowest score.
    vocab = [(p, low) for p, _ in vocab] + pieces
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_unigram_counts_match_the_library(edge, empty, small_docs):
    t = _unigram()
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = unigram_count.token_counts(edge, model).collect()
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    for r in got:
        x = texts[r["doc_id"]]
        want = len(t.encode(x, add_special_tokens=False).ids) if x else 0
        assert r["n_tokens"] == want, (r["doc_id"], r["n_tokens"], want)
    counter = unigram_count._counter(model)
    for _, x in small_docs[:150]:
        assert counter(x) == (len(t.encode(x, add_special_tokens=False).ids) if x else 0)
    assert unigram_count.token_counts(empty, model).count() == 0


def test_unigram_memory_of_one_long_chunk():
    """A chunk of a million characters needs a window, and the automaton's own
    copy of the text (4 bytes a character), no objects a character."""
    import tracemalloc
    model = public_tokenizers.path("piece_bpe_32k.model")
    counter = unigram_count._counter(model)
    text = "thequickbrownfox日é" * 60_000
    tracemalloc.start()
    n = counter.chunk(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text) + (1 << 16)
    one = counter.chunk("thequickbrownfox日é" * 60)
    two = counter.chunk("thequickbrownfox日é" * 120)
    assert n == one + 999 * (two - one)


def test_unigram_ties():
    """Equal scores: the earlier start (longer last piece) stays."""
    c = unigram_count.UnigramCounter([("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁", -1.0)],
                                     byte_fallback=False)
    vocab = [("<unk>", -3.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("▁", -1.0)]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    for x in ("a", "aa", "aaa", "aaaa", "aaaaaaa", "azza", "zz", "zaz"):
        assert c.chunk(x) == len(t.encode(x).ids), x


def test_url_parts_and_rules(spark):
    urls = [(0, None), (1, ""), (2, "no scheme"), (3, "http://EXAMPLE.com/en/x?q#f"),
            (4, "https://www.example.com/en/1"), (5, "http://a.net/es/2"), (6, "http://net/fr/"),
            (7, "http://x.com"), (8, "http://x.com?y=/z"), (9, "ftp://É.Com/a\nb"),
            (10, "x://y://z/p"), (11, "http://notexample.com/en/q"), (3, "http://EXAMPLE.com/en/")]
    host, path = url_reputation.parts(url_reputation.F.col("url"))
    pages = spark.createDataFrame(urls, "page_id long, url string").select(
        "page_id", host.alias("host"), path.alias("path"))
    none = spark.createDataFrame([], "host string, good int")
    got = {r["page_id"]: r for r in url_reputation.judge(pages, none).collect()}
    assert url_reputation.judge(pages, none).count() == len(urls)
    assert (got[0]["host"], got[0]["path"], got[2]["host"]) == ("", "", "")
    assert got[4]["rule"] == "www.example.com/en/" and got[4]["verdict"] == "allow"
    assert got[5]["rule"] == "net/es/" and got[6]["rule"] == "net/fr/"
    assert (got[7]["host"], got[7]["path"], got[7]["rule"]) == ("x.com", "", None)
    assert (got[8]["host"], got[8]["path"]) == ("x.com", "")
    assert (got[9]["host"], got[9]["path"], got[9]["rule"]) == ("É.com", "/a\nb", "com/")
    assert (got[10]["host"], got[10]["path"]) == ("y:", "//z/p")
    assert got[11]["rule"] == "com/"
    assert url_reputation.judge(pages.limit(0), none).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    """A host with two bad pages in a good domain is judged by the domain's
    rate more than one with forty bad pages."""
    rows = ([("a.good.org", 1)] * 60 + [("b.good.org", 1)] * 50 + [("c.good.org", 0)] * 2
            + [("d.good.org", 0)] * 40 + [("x.bad.net", 0)] * 80)
    outcomes = spark.createDataFrame(rows, "host string, good int")
    h, d, s, world = url_reputation.reputation(outcomes)
    mean = {r["host"]: r["a"] / (r["a"] + r["b"]) for r in h.collect()}
    assert mean["a.good.org"] > mean["c.good.org"] > mean["d.good.org"]
    assert mean["x.bad.net"] < 0.1
    assert all(url_reputation.K_LOW <= world[k] <= url_reputation.K_HIGH for k in ("kh", "kd", "ks"))


def test_grammar_scores_clauses_not_words():
    g = toxicity_grammar.Grammar({"idiot": 4.0, "lowei*": 3.0}, (-2.0, 1.0, 0.0, 0.0))
    plain, denied = g.features("an idiot here")[0], g.features("he is not an idiot")[0]
    quoted, aimed = g.features('the text says "idiot" twice')[0], g.features("you idiot")[0]
    assert aimed > plain > denied > 0 and plain > quoted > 0
    assert g.features("loweiung")[0] == 3.0 and g.features("lowe")[0] == 0.0
    assert g.features("kill the lights")[0] == 0.0 < g.features("i will kill you")[0]
    assert g.score(None) == g.score("") < 0.5 < g.score("idiot")


def test_grammar_runs_on_across_strides():
    """Negation, report, quotation and target act across token 64 of a clause
    as they do inside a stride, and a text's strides share no weight."""
    g = toxicity_grammar.Grammar({"idiot": 4.0}, (-2.0, 1.0, 0.0, 0.0))
    size = toxicity_grammar.CLAUSE_TOKENS
    for phrase in ("kill you", "you will kill", "not an idiot", "said an idiot", '"an idiot',
                   "you an idiot", "idiot of you", "plain idiot"):
        n = len(toxicity_grammar.tokens(phrase))
        want = g.features(phrase)[0]
        for lead in range(size - n, size + 1):
            got = g.features("word " * lead + phrase + " word" * size)
            assert want > 0 and got[0] == want, (phrase, lead)
            assert got[2] == 1 / -(-(lead + n + size) // size)
    assert g.features("kill" + " word" * toxicity_grammar.REACH + " you")[0] == 0.0
    # Far from the cut, an open report still damps.
    assert g.features("said" + " word" * 200 + " idiot")[0] == g.features("said idiot")[0]
    assert g.clause([]) == []


def test_transducers_one_by_one_and_composed():
    import random
    tg = toxicity_grammar
    o, x, at, no, says, q = tg.SYMBOLS
    assert tg.NEGATING.run([no, o, x, x, x])[0] == [0, 1, 1, 1, 0]
    assert tg.NEGATING.run([no, o, no, o, o, o, x])[0] == [0, 1, 1, 1, 1, 1, 0]
    assert tg.REPORTING.run([x, says, x, o, x])[0] == [0, 0, 2, 2, 2]
    assert tg.REPORTING.run([q, x, q, x])[0] == [0, 2, 2, 0]
    assert tg.REPORTING.run([q, says, x, q, x]) == ([0, 2, 2, 2, 2], 1)
    assert tg.AIMING.run([at, x, o, o, x, x])[0] == [0, 4, 4, 4, 4, 0]
    r = random.Random(3)
    for _ in range(200):
        word = [r.choice(tg.SYMBOLS) for _ in range(r.randrange(30))]
        apart = [m.run(word)[0] for m in (tg.NEGATING, tg.REPORTING, tg.AIMING)]
        assert tg.CONTEXT.run(word)[0] == [a | b | c for a, b, c in zip(*apart)]
        inside = tg.REPORTING.run(word, 2)[0]
        assert [m & 2 for m in tg.CONTEXT.run(word, tg.IN_QUOTATION)[0]] == inside


def test_grammar_over_colons_sentences_and_contractions():
    tg = toxicity_grammar
    g = tg.Grammar({"idiot": 4.0}, (-2.0, 1.0, 0.0, 0.0))
    top = lambda text: g.features(text)[0]
    plain, aimed = top("an idiot"), top("you idiot")
    assert top("She said: you idiot") == top("she said you idiot") < aimed
    assert top("Note: you idiot") == aimed
    # A quotation runs on over sentences, to its mark or the end of the line.
    assert top('“Stop it. An idiot. Go.” he thinks') == tg.REPORTED * plain
    assert top('“Stop it. Go.” he thinks. An idiot') == plain
    assert top('a 5" screen.\nAn idiot') == plain
    for no in ("aren't", "aren’t", "can't", "won’t", "cannot", "don't", "isn’t"):
        assert top(f"{no} an idiot") == tg.NEGATED * plain, no
    assert top("I am killing you") > 0 == top("killing time")
    # Two long words that begin alike are two entries.
    a, b = "x" * 50 + "a", "x" * 50 + "b"
    assert tg.entries(a)[0] != tg.entries(b)[0] and tg.entries(a)[1:] == tg.entries(b)[1:]


def test_toxicity_on_held_out_rows(spark, edge, empty, tmp_path):
    """Held-out accuracy; labels never touch held-out rows."""
    import random
    r = random.Random(2)
    clean = [f"w{k}" for k in range(400)]
    bad = ["gribble", "snarkon", "gribbled"]
    rows, labels = [], []
    for i in range(600):
        t = [r.choice(clean) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                t[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(t), 0.5))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    g = toxicity_grammar.train_grammar(docs, marks)
    got = toxicity_grammar.scored(docs.drop("score"), g).select(
        "doc_id", toxicity_grammar.held_out("doc_id").alias("h"), "score").collect()
    held = [x for x in got if x["h"]]
    assert 80 < len(held) < 160
    right = sum((x["score"] >= 0.5) == (x["doc_id"] % 6 == 0) for x in held)
    assert right / len(held) > 0.97
    # Flipping the held-out labels changes nothing.
    ids = {x["doc_id"] for x in held}
    flipped = spark.createDataFrame(
        [(i, q, 1 - t if i in ids else t) for i, q, t in labels], marks.schema)
    assert toxicity_grammar.train_grammar(docs, flipped).lexicon == g.lexicon
    out = toxicity_grammar.clean_rows(edge, marks.limit(0))
    assert out.columns == edge.columns
    assert 16 not in [x["doc_id"] for x in out.collect()]
    assert out.count() == edge.count() - 1
    assert toxicity_grammar.clean_rows(empty, marks).count() == 0


def test_vocabulary_files_are_not_in_the_repository():
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[2]
    names = {p.name for p in root.rglob("*") if ".git" not in p.parts}
    assert not names & {"word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"}
    assert json  # the files are read through their path only
