import math

import pytest
from pyspark.sql import functions as F

from glanage.operators import lexicon, weights

TEXTS = [("d1", "le chat, le chien."), ("d2", "Le chat dort"), ("d3", ""), ("d4", None)]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id string, text string")
    tokens = weights.tokens(docs)
    tf = weights.tf(tokens)
    idf = weights.idf(tf)
    return docs, tokens, tf, idf, weights.tf_idf(tf, idf)


def test_weights(scored):
    _, _, tf, idf, w = scored
    assert {(r["mot"], r["doc_id"]): r["tf"] for r in tf.collect()}[("le", "d1")] == 2
    assert {r["mot"]: r["idft"] for r in idf.collect()} == {"le": 0.0, "chat": 0.0, "chien": pytest.approx(math.log10(2)), "dort": pytest.approx(math.log10(2))}
    assert {(r["doc_id"], r["mot"]) for r in weights.top(w, 2, F.desc("tf_idf"), F.col("mot")).collect()} == {("d1", "chien"), ("d2", "dort")}
    assert weights.n_documents(tf).first()["n"] == 2 and {r["mot"]: r["df"] for r in weights.df(tf).collect()}["le"] == 2


def test_tails(spark):
    s = spark.createDataFrame([("a", "w%d" % i, float(v)) for i, v in enumerate((1, 2, 4, 10))], "doc_id string, mot string, tf_idf double")
    assert weights.quantile(s, "tf_idf", 0.17).first()["cut"] == pytest.approx(1.51)
    assert [r["tf_idf"] for r in weights.low_tail(s, 0.17).collect()] == [1.0] and [r["tf_idf"] for r in weights.high_tail(s, 0.95).collect()] == [10.0]
    assert {r["mot"] for r in weights.stop_words_by_tails(s, 0.17, 9).collect()} == {"w0", "w3"}
    assert max(r["tf_idf"] for r in weights.clipped(s, 0.5).collect()) == 3.0
    assert {(r["bin"], r["n"]) for r in weights.histogram(s, 0, 10, 5).collect()} == {(0, 1), (1, 1), (2, 1), (4, 1)}
    idf = spark.createDataFrame([("w0", 0.1), ("w1", 0.9), ("w2", 0.9), ("w3", 0.9)], "mot string, idft double")
    known = spark.createDataFrame([("w1",)], "mot string")
    assert {r["mot"] for r in weights.stop_words_by_means(s, idf, 0.2, 0.5, known).collect()} == {"w0"}


def test_filtering_keeps_order(spark, scored):
    docs, tokens, *_ = scored
    stop = spark.createDataFrame([("le",)], "mot string")
    assert weights.without_stop_words(tokens, stop).count() == 4
    assert {r["doc_id"]: r["text"] for r in weights.filtered_text(docs, stop).collect()} == {"d1": "chat chien", "d2": "chat dort", "d3": "", "d4": ""}


def test_substitution(spark):
    docs = spark.createDataFrame([("d", "Les chats  voient les souris"), ("e", None)], "doc_id string, text string")
    m = spark.createDataFrame([("chats", "chat", 1), ("chats", "felin", 2), ("les", None, 1)], "mot string, repl string, ord int")
    first = lexicon.substitute(docs, lexicon.first_of(m))
    assert {r["doc_id"]: r["text"] for r in first.collect()} == {"d": "chat voient souris", "e": ""}
    assert {r["repl"] for r in lexicon.last_of(m).collect()} == {"felin", None}


def test_maps_and_report(spark, scored):
    _, tokens, *_ = scored
    both = lexicon.lemma_map(tokens).join(lexicon.stem_map(tokens), "mot")
    assert both.count() == 4
    counts = lexicon.distinct_counts(both)
    assert counts.first()["n_mot"] == 4 and "vocabulary" in lexicon.report(counts)
    assert lexicon.lengths(both).first()["len_mot"] == pytest.approx(3.75)
    fam = lexicon.families(spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b", "b")], "mot string, lemme string"), n=1).first()
    assert (fam["lemme"], fam["n_forms"], fam["forms"]) == ("a", 2, ["a1", "a2"])
    rows = spark.createDataFrame([("x", "aller", "all"), ("y", "z", "z"), (None, "q", "r")], "mot string, lemme string, racine string")
    assert [r["mot"] for r in lexicon.verbs(lexicon.different(rows)).collect()] == ["x"] and lexicon.pair_counts(rows).count() == 3
    assert lexicon.sample_of(rows, "mot", 2).count() == 2 and lexicon.frequencies(tokens, "mot", 1).first()["mot"] == "le"


LEXICON = [("chat", "chat", 1), ("chats", "chat", 2), ("chats", "autre", 9), ("chien", "chien", 3), ("travail", "travaux", 4), ("voiture", "voiture", 5)]


def test_correction(spark):
    lex = spark.createDataFrame(LEXICON, "mot string, lemme string, ord long")
    words = spark.createDataFrame([(w,) for w in ("Chats", "chatz", "chein", "travail", "zzz", " ", "ab")], "mot string")
    got = {r["mot"]: (r["corrected"], r["method"]) for r in lexicon.correct(words, lex).collect()}
    assert got == {"chats": ("chat", "form"), "chatz": ("chat", "nearest"), "chein": ("chien", "nearest"), "travail": ("travail", "form"), "zzz": ("zzz", "kept"), "ab": ("ab", "kept")}


def plain_edits(w):
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1}
    return out | {a + c + b[1:] for a, b in cut if b for c in lexicon.LETTERS} | {a + c + b for a, b in cut for c in lexicon.LETTERS}


def test_edits1_equals_generation(spark):
    import itertools

    alphabet = "abé3"
    every = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product(alphabet, repeat=n)]
    words = every[::7]
    lemmas = spark.createDataFrame([(w, 1, 1) for w in every], "lemme string, freq long, ord long")
    got = {(r["w"], r["lemme"]) for r in lexicon.edits1(spark.createDataFrame([(w,) for w in words], "mot string"), lemmas).collect()}
    assert got == {(w, x) for w in words for x in plain_edits(w) & set(every) if x != w}


def test_cascade_and_sentences(spark):
    lex = spark.createDataFrame([("chats", "chat", 1), ("mangeait", "manger", 2)], "mot string, lemme string, ord long")
    lemmas = spark.createDataFrame([("chat", 5, 1), ("chut", 9, 2), ("manger", 3, 3), ("ordinateur", 2, 4)], "lemme string, freq long, ord long")
    lex = lex.unionByName(spark.createDataFrame([("ordinateurs", "ordinateur", 3), ("mangeaient", "manger", 4), ("mangeaille", "mangeaille", 5)], lex.schema))
    words = spark.createDataFrame([(w,) for w in ("chat", "Chats!", "cht", "ordinatuers", "mangeaietn", "qqq")], "mot string")
    got = {r["mot"]: (r["corrected"], r["method"]) for r in lexicon.cascade(words, lex, lemmas).collect()}
    # The last step looks among forms and gives the lemma of the nearest one.
    assert got == {"chat": ("chat", "lemma"), "chats": ("chat", "form"), "cht": ("chut", "edit"), "ordinatuers": ("ordinateur", "prefix"), "mangeaietn": ("manger", "prefix"), "qqq": (None, "none")}
    s = spark.createDataFrame([(1, "Le cht, mangeait")], "sentence_id int, sentence string")
    assert [(r["pos"], r["mot"], r["corrected"]) for r in lexicon.correct_sentences(s, lex, lemmas).orderBy("pos").collect()] == [(0, "le", None), (1, "cht", "chut"), (2, "mangeait", "manger")]
    assert lexicon.lemmatise_sentences(s, lex).first()["text"] == "le cht, manger"


def test_lexicon_of_a_corpus(scored):
    lex, lemmas = lexicon.lexicon_of(scored[1])
    assert {r["lemme"]: r["freq"] for r in lemmas.collect()}["le"] == 3 and lex.count() == 4


def test_quantile_is_exact(spark):
    import random

    rng = random.Random(1)
    for values in ([3.0], [1.0, 1.0, 1.0], [1.0, 2.0], [rng.random() for _ in range(999)], [float(rng.randrange(5)) for _ in range(500)], [1e300, -1e300, 0.0, 5.0], [2.0] * 400 + [7.5]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        for q in (0.0, 0.02, 0.17, 0.5, 0.9, 0.99, 1.0):
            got, want = weights.quantile(df, "v", q).first()["cut"], df.agg(F.percentile("v", q)).first()[0]
            assert got == pytest.approx(want, rel=1e-12)
    assert weights.quantile(spark.createDataFrame([], "v double"), "v", 0.5).first()["cut"] is None


def test_long_stop_lists_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b. c  a"), (2, "b"), (3, None)], "doc_id int, text string")
    stop = spark.createDataFrame([("b",), ("c",), ("zz",)], "mot string")
    one = sorted(map(tuple, weights.filtered_text(docs, stop).collect()))
    monkeypatch.setattr(weights, "LISTED", 2)
    assert sorted(map(tuple, weights.filtered_text(docs, stop).collect())) == one == [(1, "a a"), (2, ""), (3, "")]


def test_joined_maps(spark):
    a = spark.createDataFrame([("chats", "chat"), ("mangeait", "manger"), ("seul", "seul")], "mot string, lemme string")
    b = spark.createDataFrame([("chats", "chat"), ("mangeait", "mang"), ("autre", "autr")], "mot string, racine string")
    both = lexicon.joined_maps(a, b)
    assert sorted(map(tuple, both.collect())) == [("chats", "chat", "chat"), ("mangeait", "manger", "mang")]
    assert [r["mot"] for r in lexicon.verb_sample(both).collect()] == ["mangeait"]
