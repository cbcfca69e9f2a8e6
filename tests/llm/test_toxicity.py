import random
import zlib

import numpy as np
import pytest

from glanage.llm import toxicity as t

WORDS = ["word%d" % i for i in range(400)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(900):
        words = rng.choices(WORDS, k=rng.randrange(5, 80))
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "wretch", "infamischx", "infamischy"]))
        out.append((i, " ".join(words), rng.choice(["en", "de"]), int(bad)))
    return out


@pytest.fixture(scope="module")
def model(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], 1) for r in rows], "doc_id long, toxic int, text int")
    return t.fit(docs, labels)


def test_held_out_accuracy(model, rows):
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    known = t._WordRows(model.params.buckets)
    s = model.scores(t.word_rows([r[1] for r in test], known))
    assert np.mean((s >= 0.5) == [r[3] == 1 for r in test]) > 0.97


def test_never_learns_from_held_out_rows(spark, rows, model):
    flipped = [(r[0], 1 - r[3] if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[3]) for r in rows]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    other = t.fit(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert np.array_equal(other.table, model.table) and other.thresholds == model.thresholds


def test_scores_do_not_depend_on_batches(model, rows):
    known = t._WordRows(model.params.buckets)
    docs = t.word_rows([r[1] for r in rows[:50]], known)
    one = np.concatenate([model.scores([d]) for d in docs])
    assert np.allclose(one, model.scores(docs), atol=1e-6)


def test_pooled_equals_plain_convolution(model):
    known = t._WordRows(model.params.buckets)
    d = t.word_rows(["one two three four five"], known)[0]
    x = np.concatenate([model.table[d].sum(1), np.zeros((3, model.params.dim))])
    want = []
    for w, k, b in zip(model.params.widths, model.kernels, model.biases, strict=True):
        n = len(d) + 1  # windows begin at the words and right behind them
        xs = np.concatenate([x, np.zeros((3, model.params.dim))])
        want.append(max_over([sum(xs[i + j] @ k[j] for j in range(w)) + b for i in range(n)]))
    assert np.allclose(model.pooled([d])[0][0], np.concatenate(want), atol=1e-5)


def max_over(rows):
    return np.max(np.array(rows), axis=0)


def test_odd_rows(model, documents, odd):
    got = t.score(documents(odd, extra=True), model).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (1, 2, 3, 7)}
    assert len(empty) == 1
    assert t.score(documents([]), model).count() == 0


def test_no_labels(spark, documents):
    model = t.fit(documents([(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert t.score(documents([(1, "a")]), model).first()["score"] == 0.5


def test_thresholds_by_language():
    s = np.concatenate([np.linspace(0, 0.4, 200), np.linspace(0.3, 1, 200)])
    y = np.concatenate([np.zeros(200, int), np.ones(200, int)])
    out = t.calibrate(s, y, ["en"] * 200 + ["de"] * 100 + ["en"] * 100)
    assert set(out) == {"", "en", "de"} and all(0.2 <= v <= 0.8 for v in out.values())


def test_conflicting_labels_and_texts_teach_nothing_new(spark, rows, model):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    more = spark.createDataFrame([(10_001, "~ scoundrel wretch", "en"), (1, "~ later in order", "de")], "doc_id long, text string, lang string")
    labels = [(r[0], r[3]) for r in rows] + [(10_001, 0), (10_001, 1), (1, rows[1][3])]
    other = t.fit(docs.unionByName(more), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert np.array_equal(other.table, model.table) and other.thresholds == model.thresholds


def test_query_keeps_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    got = t.op4_toxicity(spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    known = got.join(labels, how="inner")
    assert (known["predicted"] == known["toxic"])[~known["held_out"]].mean() > 0.9


def letters(i):
    return "q" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "z"


def test_every_labelled_row_teaches(spark):
    # More rows of a class than any one task takes; each word is in two rows, and only words of two rows get a weight.
    n = 7000
    docs = spark.createDataFrame([(i, letters(i // 2), "en") for i in range(n)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i // 2 % 3 == 0)) for i in range(n)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    known = t._WordRows(model.params.buckets)
    learnt = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(f"{model.params.seed}:{i}".encode()) % 1000 >= 250]
    twice = [i for i in learnt if i % 2 == 0 and i + 1 in set(learnt)]
    assert len(twice) > 1000 and all(model.table[t.word_rows([letters(i // 2)], known)[0][0, 0], 0] != 0 for i in twice)


def test_long_texts_teach(spark, rows):
    rng = random.Random(4)
    long = [(20_000 + i, " ".join([*rng.choices(WORDS, k=2300), "vilest", *rng.choices(WORDS, k=2300)]), "en", 1) for i in range(60)]
    docs = spark.createDataFrame([r[:3] for r in rows + long], "doc_id long, text string, lang string")
    model = t.fit(docs, spark.createDataFrame([(r[0], r[3]) for r in rows + long], "doc_id long, toxic int"))
    good, bad = model.scores(t.word_rows(["word1 word2 word3", "word1 vilest word3"], t._WordRows(model.params.buckets)))
    assert good < 0.5 < bad


def test_shards_together_learn_what_one_does(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    params = t.ToxicityParams(shard_rows=150)
    model, again = t.fit(docs, labels, params), t.fit(docs.repartition(7), labels.repartition(3), params)
    assert np.array_equal(model.table, again.table) and np.array_equal(model.out, again.out) and model.thresholds == again.thresholds
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    s = model.scores(t.word_rows([r[1] for r in test], t._WordRows(params.buckets)))
    assert np.mean((s >= 0.5) == [r[3] == 1 for r in test]) > 0.97
