import datetime

import pytest
from pyspark.sql import functions as F

from glanage.operators import boolean, evaluate, index, search
from glanage.plans import expression as ex
from glanage.plans import question as nl
from glanage.plans.query import PartialDate, StructuredQuery

#: Five short fables, made so that the nine terms are in them as below.
FABLES = [
    ("Doc1", "Le corbeau tient un fromage, le renard veut en faire son repas et le tromper."),
    ("Doc2", "Un renard et un bouc sont dans un puits ; il a su le tromper."),
    ("Doc3", "Pour son repas le loup chasse."),
    ("Doc4", "La cigogne invite le renard à un repas."),
    ("Doc5", "Le berger crie au loup."),
]
TERMS = ("corbeau", "renard", "cigogne", "bouc", "loup", "berger", "fromage", "repas", "tromper")


@pytest.fixture(scope="module")
def fables(spark):
    docs = spark.createDataFrame(FABLES, "doc_id string, text string")
    found = index.incidence(docs, TERMS)
    return docs, found, found.where("present = 1").select("term", "doc_id")


def test_incidence(fables):
    _, found, _ = fables
    got = {r["term"]: "".join(str(r[d]) for d, _ in FABLES) for r in index.incidence_matrix(found, [d for d, _ in FABLES]).collect()}
    assert got == {t: "".join(str(int(t in text.lower())) for _, text in FABLES) for t in TERMS}
    assert got["renard"] == "11010" and got["loup"] == "00101"


@pytest.mark.parametrize(
    "expression, want",
    [
        ("loup ∧ repas", ["Doc3"]),
        ("bouc ∧ tromper ∨ fromage", ["Doc1", "Doc2"]),
        ("renard ∧ repas ∧ tromper", ["Doc1"]),
        ("renard ∧ ¬ repas", ["Doc2"]),
        ("repas ∧ ¬cigogne", ["Doc1", "Doc3"]),
        ("¬ tromper", ["Doc3", "Doc4", "Doc5"]),
        ("corbeau berger", ["Doc1", "Doc5"]),
        ("unheard", []),
        ("¬ unheard", ["Doc1", "Doc2", "Doc3", "Doc4", "Doc5"]),
        ("", []),
    ],
)
def test_expressions(fables, expression, want):
    docs, _, postings = fables
    assert [r["doc_id"] for r in boolean.evaluate(expression, postings, docs).collect()] == want


@pytest.mark.parametrize("bad", ["∧ a", "a ∧", "¬", "a ∨ ∧ b"])
def test_bad_expressions(bad):
    with pytest.raises(ValueError):
        ex.parse(bad)


def test_vectors_and_sets(spark, fables):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "a int, b int")
    got = df.select(index.vector_or(F.col("a"), F.col("b")), index.vector_and(F.col("a"), F.col("b")), index.vector_not(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0), (1, 0, 0), (0, 0, 1)]
    _, _, p = fables
    of = lambda t: p.where(F.col("term") == t).select("doc_id")
    ids = lambda d: sorted(r["doc_id"] for r in d.collect())
    assert ids(boolean.union(of("renard"), of("loup"))) == ["Doc1", "Doc2", "Doc3", "Doc4", "Doc5"]
    assert ids(boolean.intersect(of("renard"), of("repas"))) == ["Doc1", "Doc4"] and ids(boolean.minus(of("renard"), of("repas"))) == ["Doc2"]


def test_posting_lists(spark):
    docs = spark.createDataFrame([("d2", "a b a."), ("d1", "le b? a"), ("d3", None)], "doc_id string, text string")
    p = index.word_index(docs, "texte", F.col("text"))
    assert {(r["term"], r["doc_id"], r["tf"]) for r in p.collect()} == {("a", "d2", 2), ("a", "d1", 1), ("b", "d2", 1), ("b", "d1", 1)}
    lists = {r["term"]: (r["freq"], r["docs"]) for r in index.posting_lists(p).collect()}
    assert lists == {"a": (2, ["d1", "d2"]), "b": (2, ["d1", "d2"])}


P = PartialDate
#: Our own questions; each has clauses that the analyser must tell apart.
QUESTIONS = [
    ("Montrez les articles de la rubrique Santé parlant de vaccination.", dict(rubriques=("santé",), kw_yes=("vaccination",))),
    ("Donne les rubriques des articles parlant de fromage ou de pain.", dict(target="rubriques", kw_yes=("fromage", "pain"), kw_op="or")),
    ("Les articles sur la voile légère ?", dict(kw_yes=("voile", "légère"))),
    ("Tous les articles qui parlent de barrage ou du pont levis.", dict(kw_yes=("barrage", "pont", "levis"), kw_op="or")),
    ("Tous les bulletins écrits entre 1998 et 2001 mais pas au mois de mars.", dict(date_from=P(year=1998), date_to=P(year=2001), date_not=P(month=3))),
    ("Tous les articles dont le titre contient le terme 'rivière' et le mot 'moulin' ?", dict(titres=("rivière", "moulin"))),
    ("Tous les bulletins dont le titre contient le mot 4x4.", dict(titres=("4x4",))),
    ("Les articles de la rubrique Jardins et publiés entre 02/05/2004 et 17/11/2006.", dict(rubriques=("jardins",), date_from=P(2, 5, 2004), date_to=P(17, 11, 2006))),
    ("Les bulletins parus entre le 9 avril 2002 et le 20 octobre 2003 évoquant les Pays-Bas ?", dict(date_from=P(9, 4, 2002), date_to=P(20, 10, 2003), kw_yes=("pays-bas",))),
    ("Les articles avec des images dont le titre contient le mot oiseau.", dict(images=True, titres=("oiseau",))),
    ('Articles dont la rubrique est "Mers Lointaines" mais qui ne parlent pas de baleines.', dict(rubriques=("mers lointaines",), kw_no=("baleines",))),
    ("Les articles qui parlent soit du blé, soit des vieux moulins, mais pas de grêle tardive.", dict(kw_yes=("blé", "vieux", "moulins"), kw_op="or", kw_no=("grêle", "tardive"))),
    ("Tous les articles provenant de la rubrique marché et contenant le mot olive dans le titre.", dict(rubriques=("marché",), titres=("olive",))),
    ("Un article qui parle de botanique et qui date d’après le 5 mai 2009 ?", dict(kw_yes=("botanique",), date_from=P(5, 5, 2009))),
    ("Les articles qui datent du 1er février 2010 et dont la rubrique est Nouvelles Locales.", dict(rubriques=("nouvelles locales",), date_on=P(1, 2, 2010))),
    ("Dans tous les articles le vieux phare est-il cité ?", dict(kw_yes=("vieux", "phare"))),
    ("Tous les articles dont la rubrique est Jardins et qui ont des images.", dict(rubriques=("jardins",), images=True)),
    ("Les articles parlant de neige et publiés après mars 2011 mais pas en juillet 2012.", dict(kw_yes=("neige",), date_from=P(None, 3, 2011), date_not=P(None, 7, 2012))),
    ("", {}),
]


@pytest.mark.parametrize("question, want", QUESTIONS)
def test_questions(question, want):
    assert nl.analyse(question) == StructuredQuery(**want)


def test_questions_in_batches(spark):
    df = spark.createDataFrame([(q,) for q, _ in QUESTIONS], "q string").select(nl.analysed(F.col("q")).alias("s"))
    assert [r["s"].asDict(recursive=True) for r in df.collect()] == [StructuredQuery(**w).row() for _, w in QUESTIONS]


@pytest.mark.parametrize("text, want", [("30/08/2011", (30, 8, 2011)), ("le 3 mars 2013", (3, 3, 2013)), ("août", (None, 8, None)), ("2012", (None, None, 2012)), ("rien", (None, None, None))])
def test_partial_dates(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(nl.partial_date(F.col("t")).alias("p")).first()["p"]
    assert (r["j"], r["m"], r["a"]) == want


DAY = datetime.date
DOCS = [
    ("1", DAY(2011, 6, 21), "Focus ", True),
    ("2", DAY(2012, 6, 1), "focus", False),
    ("3", DAY(2013, 1, 31), "A lire", True),
    ("4", DAY(2014, 8, 6), None, False),
    ("5", None, "focus", False),
]
POSTINGS = [("texte", "vin", "1"), ("texte", "vin", "2"), ("texte", "eau", "2"), ("texte", "eau", "3"), ("titre", "3d", "4"), ("texte", "vin", "5")]


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, date date, rubrique string, has_image boolean")
    postings = spark.createDataFrame(POSTINGS, "field string, term string, doc_id string")
    lexicon = spark.createDataFrame([("vin", "vin", 1), ("vins", "vin", 2), ("eau", "eau", 3)], "mot string, lemme string, ord long")
    return search.SearchEngine(docs, postings, lexicon)


@pytest.mark.parametrize(
    "q, want",
    [
        (dict(kw_yes=("vin", "eau")), ["2"]),
        (dict(kw_yes=("vin", "eau"), kw_op="or"), ["1", "2", "3", "5"]),
        (dict(kw_yes=("vin", "nowhere")), ["1", "2", "5"]),
        (dict(kw_yes=("nowhere",)), []),
        (dict(kw_yes=("vin",), kw_no=("eau", "nowhere")), ["1", "5"]),
        (dict(titres=("3d",)), ["4"]),
        (dict(rubriques=("FOCUS", "a lire")), ["1", "2", "3", "5"]),
        (dict(rubriques=("FOCUS", "focus "), rub_op="and"), ["1", "2", "5"]),
        (dict(rubriques=("FOCUS", "a lire"), rub_op="and"), []),
        (dict(kw_yes=("vin", "eau"), titres=("3d",)), []),
        (dict(kw_yes=("vin", "eau"), kw_op="or", kw_no=("vin",)), ["3"]),
        (dict(kw_no=("vin",)), ["3", "4"]),
        (dict(images=True), ["1", "3"]),
        (dict(date_from=P(year=2012), date_to=P(year=2013), date_not=P(month=6)), ["3"]),
        (dict(date_from=P(21, 6, 2011), date_to=P(1, 6, 2012)), ["1", "2"]),
        (dict(date_on=P(month=6), date_from=P(year=2014)), ["1", "2"]),
        (dict(date_from=P(month=8)), ["4"]),
        ({}, ["1", "2", "3", "4", "5"]),
    ],
)
def test_search(engine, q, want):
    assert sorted(r["doc_id"] for r in engine.search(StructuredQuery(**q)).collect()) == want


def test_more_terms_than_one_number_has_bits(engine):
    many = tuple(f"absent{i}" for i in range(150))
    assert sorted(r["doc_id"] for r in engine.search(StructuredQuery(kw_yes=(*many, "vin", "eau"))).collect()) == ["2"]
    assert sorted(r["doc_id"] for r in engine.search(StructuredQuery(kw_yes=("vin", "zz"), kw_no=(*many, "eau"))).collect()) == ["1", "5"]


def test_search_shapes_and_compat(engine):
    r = engine.search(StructuredQuery(target="rubriques", kw_yes=("eau",)))
    assert sorted(x["rubrique"] for x in r.collect()) == ["a lire", "focus"]
    got = engine.search(StructuredQuery(kw_yes=("nowhere",), rubriques=("a lire",)), compat=True)
    assert [x["doc_id"] for x in got.collect()] == ["3"]


def test_search_by_question(engine):
    assert engine.plan("Je veux les articles parlant de vinz.").kw_yes == ("vin",)
    assert sorted(r["doc_id"] for r in engine.search("Je veux les articles de la rubrique Focus parlant de vins mais pas de l'eau.").collect()) == ["1", "5"]


def test_evaluation(spark):
    queries = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id int")
    predicted = spark.createDataFrame([(1, "a"), (1, "b"), (3, "z"), (1, "b")], "query_id int, doc_id string")
    relevant = spark.createDataFrame([(1, "b"), (1, "c"), (2, "a")], "query_id int, doc_id string")
    got = {r["query_id"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.precision_recall(queries, predicted, relevant).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (1.0, 0.0, 0.0), 3: (0.0, 1.0, 0.0), 4: (1.0, 1.0, 1.0)}
    assert evaluate.mean_latency(lambda q: None, [1, 2], 3) >= 0
