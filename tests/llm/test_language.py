import numpy as np
import pytest

from glanage.llm import language as la

SPEECH = {"xx": "kala mulo tesa rido", "yy": "brangst scholt wicht drunge", "zz": "eau çois réel ment"}
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def docs(spark):
    import random

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(SPEECH[lang].split(), k=20)), lang) for i, lang in enumerate(sorted(SPEECH) * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def page(lang, text):
    return f'<html lang="{lang}"><style>hidden</style><script>var kala;</script><p>{text}</p>' if lang else f"<p>{text}</p>"


def test_evidence_and_odd_rows(spark, docs):
    rows = [(i, f"http://h{i % 3}.example.com/{'xyz'[i % 3] * 2}/p", page("xyz"[i % 3] * 2, SPEECH["xyz"[i % 3] * 2])) for i in range(90)]
    rows += [
        (100, "http://h1.example.com/q", ""),  # only its host speaks
        (101, "http://h2.example.com/zz/q", None),
        (102, "http://h0.example.com/yy/q", page("yy", SPEECH["xx"] * 5)),  # the text wins over the witnesses
        (103, None, page(None, SPEECH["yy"])),
        (104, "http://[bad", page(None, SPEECH["zz"])),
        (104, "http://[bad", page(None, SPEECH["zz"])),
        (None, "", "123 456"),
        (105, "http://h9.example.com/", "word " * 50_000 + SPEECH["zz"]),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    for c in ("lang", "p", "host", "ll", "e", "n_h"):
        pages = pages.withColumn(c, la.F.lit("clash"))
    got = la.identify(pages, docs).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["lang"] == "xyz"[i % 3] * 2 for i in range(90))
    assert (by[100]["lang"], by[101]["lang"], by[102]["lang"], by[103]["lang"], by[104]["lang"]) == ("yy", "zz", "xx", "yy", "zz")
    assert all(0 < r["confidence"] <= 1 + 1e-9 for r in got)
    assert la.identify(pages.limit(0), docs).count() == 0
    assert la.identify(pages, docs.limit(0)).select("lang").distinct().first()["lang"] is None


def test_text_model_equals_plain_naive_bayes(spark, docs):
    p = la.LanguageParams(buckets=1 << 10)
    langs, table = la.fit_text(docs, p)
    counts = {lang: np.full(p.buckets, p.smoothing) for lang in langs}
    for r in docs.collect():
        for g in la.grams(r["text"], p.buckets):
            counts[r["lang"]][g] += 1
    for i, lang in enumerate(langs):
        assert np.allclose(table[i], np.log(counts[lang] / counts[lang].sum()), atol=1e-4)
    text = SPEECH["yy"]
    want = np.array([sum(table[i][g] for g in la.grams(text, p.buckets)) for i in range(3)])
    got = la.text_evidence(text, table, p)
    assert got.argmax() == want.argmax() == langs.index("yy") and got.max() == 0


def test_posteriors_by_hand(spark, docs):
    """The fused posterior of every page against the formulas in plain numpy."""
    p = la.LanguageParams()
    rows = [(i, f"http://h{i % 4}.d{i % 2}.com/{'xyz'[i % 3] * 2}/", page("xyz"[(i // 2) % 3] * 2, SPEECH["xyz"[i % 3] * 2][: 4 + i % 9])) for i in range(60)]
    got = {r["page_id"]: r for r in la.identify(spark.createDataFrame(rows, PAGES), docs, p).collect()}
    langs, table = la.fit_text(docs, p)
    ll = np.array([la.text_evidence(la.visible(h), table, p) for _, _, h in rows])
    soft = lambda x: np.exp(x - x.max(1, keepdims=True)) / np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)
    post = soft(ll)
    words = sorted({*langs, "none", "other"})

    def witness(said):
        counts = np.array([[post[[k for k, s in enumerate(said) if s == w], i].sum() for i in range(3)] for w in words])
        share = (counts.sum(1) + 1) / (counts.sum() + len(words))
        prior = np.array([[0.5 * share[k] + 0.5 * (w == lang) for lang in langs] for k, w in enumerate(words)])
        prior /= prior.sum(0)
        return np.log((counts + p.witness * prior) / (counts.sum(0) + p.witness))

    declared = ["xyz"[(i // 2) % 3] * 2 for i in range(60)]
    suffix = ["xyz"[i % 3] * 2 for i in range(60)]
    wd, ws = witness(declared), witness(suffix)
    e = ll + np.array([wd[words.index(a)] + ws[words.index(b)] for a, b in zip(declared, suffix)])
    q = soft(e)
    host, domain = [i % 4 for i in range(60)], [i % 2 for i in range(60)]
    everywhere = (q.sum(0) + 1) / (60 + 3)
    for i in range(60):
        d = [k for k in range(60) if domain[k] == domain[i]]
        h = [k for k in range(60) if host[k] == host[i]]
        qd = (q[d].sum(0) + p.domain * everywhere) / (len(d) + p.domain)
        prior = (np.maximum(q[h].sum(0) - q[i], 0) + p.host * qd) / (len(h) - 1 + p.host)
        final = soft((e[i] + np.log(prior))[None])[0]
        assert got[i]["lang"] == langs[final.argmax()] and abs(got[i]["confidence"] - final.max()) < 1e-6


def test_visible_and_address():
    assert "kala" not in la.visible('<script>kala</script>a<!-- b -->&eacute;') and "é" in la.visible("&eacute;")
    assert la.address("https://www.site.fr/a") == ("www.site.fr", "site.fr", "fr")
    assert la.address("http://x.com/de/1")[2] == "de" and la.address("http://x.com/page")[2] is None and la.address(None) == ("", "", None)


def test_all_labels_are_languages(spark):
    """More labels than any fixed few, one of them only on long texts; a tie goes to the first in order."""
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:02d}") for i in range(80)] + [(900, "longa " * 5000, "long"), (901, None, "long2"), (901, "zzz", "long2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = la.fit_text(docs, la.LanguageParams())
    assert langs == [f"l{i:02d}" for i in range(80)] + ["long", "long2"]
    assert la.text_evidence("longa longa longa", table, la.LanguageParams()).argmax() == 80
    two = spark.createDataFrame([(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string")
    (got,) = la.identify(spark.createDataFrame([(1, "u", "same")], PAGES), two).collect()
    assert got["lang"] == "a"
    with pytest.raises(ValueError, match="more than 5"):
        la.fit_text(docs, la.LanguageParams(languages=5))
