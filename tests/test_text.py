import pytest
from pyspark.sql import functions as F

from glanage.functions import stem, text


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "fn, value, want",
    [
        (text.clean, "L'eau, lui-même!", "leau luimême"),
        (text.clean, "J’aime", "j’aime"),
        (text.clean_markup, "<b>a.b</b>", "<b>ab</b>"),
        (text.clean_light, "A.b; C-d", "ab c-d"),
        (text.words, " a  b\tc\n", ["a", "b", "c"]),
        (text.words, None, []),
        (text.words, "", []),
        (text.blank_words, "a  b", ["a", "", "b"]),
        (text.elided_words, "J’aime l'eau, lui-même (2012). Où ?", ["j’", "aime", "l'", "eau", "lui-même", "2012", "où"]),
        (text.index_words, "Le projet universitaire, un essai", ["projet", "universitaire", "essai"]),
        (text.index_words, "l'eau à la mer, à l’ombre et à Paris", ["eau", "mer", "ombre", "et", "à", "paris"]),
        (text.index_words_compat, "Le projet universitaire, un essai", ["le", "projet", "iversitaire", "essai"]),
        (text.query_text, "Où est l’eau ?", "où est l'eau "),
        (text.has_letter, "12 é", True),
        (text.has_letter, "12", False),
        (text.has_number, "le 12 mai", True),
        (text.has_number, "1/2/2012", True),
        (text.has_number, "3d", False),
        (text.bare_word, "«Taxibot!»", "«taxibot!»"),
        (text.bare_word, " (Taxibot!) ", "taxibot"),
        (text.without_controls, "a\x07b\x0bc\n", "abc\n"),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, fn, value) == want


@pytest.mark.parametrize("a, b, prefix, score", [("recherche", "rechercher", 9, 90.0), ("abc", "xbc", 0, 0.0), ("abcd", "abxd", 2, 50.0), ("ab", "abc", 2, 0.0), ("abcdefgh", "abc", 3, 0.0), ("", "a", 0, 0.0)])
def test_prefix(spark, a, b, prefix, score):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(text.common_prefix(F.col("a"), F.col("b")), text.prefix_score(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (prefix, score)


def test_earliest(spark):
    r = one(spark, lambda c: text.earliest(c, ("articles", "article", "bulletins")), "les articles des bulletins")
    assert (r["pos"], r["kw"]) == (5, "articles")
    assert one(spark, lambda c: text.earliest(c, ("x",)), "abc") is None


#: Words and stems of the published sample vocabulary.
STEMS = "continu continu continuait continu continuation continu continuellement continuel continuité continu contradictoirement contradictoir contraindre contraindr main main maintenaient mainten maintenue maintenu maison maison maître maîtr majesté majest majestueusement majestu majeure majeur majorité major malades malad maladive malad".split()


def test_stems():
    assert [stem.stem(w) for w in STEMS[::2]] == STEMS[1::2]
    assert stem.stem(None) is None and stem.stem("") == ""


def test_lemmas_and_udfs(spark):
    words = ("chevaux", "maisons", "sont", "les", None, "", "Eaux", "bateaux", "mangées", "finissent", "virus", "genoux", "bijoux", "tuyaux", "yeux", "os")
    want = ["cheval", "maison", "être", "les", None, "", "eau", "bateau", "manger", "finir", "virus", "genoux", "bijoux", "tuyal", "œil", "os"]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", stem.lemma_of(F.col("w")).alias("l")).orderBy("i")
    assert [r["l"] for r in got.collect()] == want
    df = spark.createDataFrame([("maisons",), (None,)], "w string").select(stem.stem_udf(F.col("w")).alias("s"), stem.lemma_of(F.col("w")).alias("l"))
    assert [tuple(r) for r in df.collect()] == [("maison", "maison"), (None, None)]
