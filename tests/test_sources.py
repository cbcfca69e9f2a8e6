import datetime

from pyspark.sql import functions as F

from glanage.operators import index
from glanage.sources import files, html, schemas

PAGE = """<html><head><title>2011/10/19 &gt;&nbsp;BE France 262&nbsp;&gt; Prix de m&eacute;decine</title><meta name="author" content="x"></head><body>
<span class="style42">Accueil/Focus</span><span class="style42">Focus</span>
<table><tr><td><span class="style17">Prix</span><span class="style95">Le prix est beau. <b>Oui.</b> sans fin</span><span class="style95">R&eacute;dacteurs : x</span></td></tr>
<tr><td>Pour en savoir plus, contacts :</td><td><span class="style85">Centre - tel</span><span class="style85">R&eacute;dacteur - y</span></td></tr></table>
<span class="style95">ADIT - Jean Dupont - email : a@b</span>
<div style="text-align: center"><img src="a.jpg"><br><span class="style21">Une image</span></div>
<div style="text-align: center"><img src="b.jpg"><span class="style21">Cr&eacute;dits : z</span></div></body></html>"""


def fields(spark, page=PAGE):
    return spark.createDataFrame([("C:\\\\x\\67937.htm", page)], "path string, html string").select("path", html.pieces(F.col("html")).alias("p"))


def test_html_fields(spark):
    p = F.col("p")
    t = html.title_parts(p["title"])
    r = (
        fields(spark)
        .select(
            html.document_id(F.col("path")).alias("id"), t.alias("t"), html.rubriques(p).alias("rubriques"), html.rubrique(p).alias("rubrique"), html.author(p).alias("author"),
            html.author_of_contact(p).alias("author2"), html.body(p).alias("body"), html.body_scoped(p).alias("scoped"), html.images(p).alias("images"),
            html.images_by_number(p, F.lit("67937")).alias("numbered"), html.contacts(p).alias("contacts"), html.contact(p).alias("contact"),
        )
        .first()
    )
    assert r["id"] == "67937" and tuple(r["t"]) == (datetime.date(2011, 10, 19), 262, "Prix de médecine")
    assert r["rubriques"] == ["Focus"] and r["rubrique"] == "Focus" and r["author"] == "Jean Dupont - email : a@b"
    assert r["author2"] == "Jean Dupont" and r["body"] == "Le prix est beau. Oui." and r["scoped"] == "Le prix est beau. Oui. sans fin"
    assert [tuple(i) for i in r["images"]] == [("a.jpg", "Une image"), ("b.jpg", "Crédits : z")]
    assert [tuple(i) for i in r["numbered"]] == [("../BULLETINS/IMAGESWEB/67937_01.jpg", "Une image"), ("../BULLETINS/IMAGESWEB/67937_02.jpg", None)]
    assert r["contacts"] == ["Centre - tel", "Rédacteur - y"] and r["contact"] == "Centre - tel Rédacteur - y"


def test_contact_ends_at_a_label_of_editors(spark):
    cell = '<table><tr><td>Pour en savoir plus, contacts :</td><td><span class="style85">Centre</span><span class="style85">tel 1</span><span class="style28">R&eacute;dacteurs :</span><span class="style85">Z - y</span></td></tr></table>'
    of = lambda page: fields(spark, page).select(html.contact(F.col("p"))).first()[0]
    assert of(f"<html><body>{cell}</body></html>") == "Centre tel 1"
    assert of(f'<html><body><span class="style28">R&eacute;dacteur</span>{cell}</body></html>') is None
    assert of(f'<html><body><span class="style28">Autre</span>{cell}<span class="style28">R&eacute;dacteur</span></body></html>') == "Centre tel 1"


def test_lexicon_reader(spark, tmp_path):
    (tmp_path / "lex.tsv").write_text("mot\tlemme\nMangea\tmanger\nnull\tnul\nmangea\tmangea\n\tx\n", encoding="utf-8")
    lex = files.read_lexicon(spark, f"file://{tmp_path}/lex.tsv")
    from glanage.operators import lexicon

    assert [tuple(r) for r in lex.orderBy("ord").select("mot", "lemme").collect()] == [("mangea", "manger"), ("null", "nul"), ("mangea", "mangea")]
    words = spark.createDataFrame([("mangea",), ("chevaux",), ("12",)], "mot string")
    assert {r["mot"]: r["lemme"] for r in lexicon.lemmas_by(words, lex).collect()} == {"mangea": "manger", "chevaux": "cheval"}


def test_bad_pages(spark):
    pages = spark.createDataFrame([("a.htm", None), ("b.htm", "<title>2012/02/31 > x"), ("b.htm", "<title>2012/02/31 > x"), ("c.html", "")], "path string, html string")
    found = html.bulletins(pages)
    assert {r["fichier"]: (r["date"], r["numero"], r["error"]) for r in found.collect()} == {"a": (None, None, "no page"), "b": (None, None, None), "c": (None, None, None)}
    assert tuple(html.ingest_counts(found).first()) == (3, 2, 1)


def test_folder_to_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("67937.htm", "67938.html", "readme.txt"):
        (tmp_path / "in" / name).write_text(PAGE, encoding="utf-8")
    pages = html.read_pages(spark, str(tmp_path / "in"), "*.{htm,html}")
    assert pages.count() == 2 and html.read_pages(spark, str(tmp_path / "in")).count() == 3
    found = html.bulletins(pages).drop("error")
    files.write_bulletins(found, str(tmp_path / "xml"))
    back = files.read_bulletins(spark, str(tmp_path / "xml"))
    assert back.schema.names == schemas.BULLETIN.names
    assert sorted(map(str, back.collect())) == sorted(map(str, found.collect()))
    p = index.index_bulletins(back)
    got = {(r["field"], r["term"], r["doc_id"], r["tf"]) for r in p.collect()}
    assert {("image", "yes", "67937", 1), ("date", "19/10/2011", "67938", 1), ("rubrique", "focus", "67937", 1), ("titre", "prix", "67937", 1), ("texte", "beau", "67938", 1)} <= got


def test_xml_escapes_and_missing_ids(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<corpus><bulletin><fichier> 1 </fichier><date>21/06/2011 </date><titre>A &amp; B</titre></bulletin><bulletin><titre>none</titre></bulletin></corpus>")
    (r,) = files.read_bulletins(spark, str(tmp_path / "c.xml")).collect()
    assert (r["fichier"], r["titre"], r["date"], r["images"], r["auteur"]) == ("1", "A & B", datetime.date(2011, 6, 21), [], None)


def test_tsv_and_indexes(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("mot\tdocs\nfocus\t['1', '2', '1']\nFocus \t['3']\nnull\t['4']\n", encoding="utf-8")
    got = {(r["field"], r["term"], r["doc_id"], r["tf"]) for r in files.read_index(spark, str(path), "rubrique").collect()}
    assert got == {("rubrique", "focus", "1", 2), ("rubrique", "focus", "2", 1), ("rubrique", "focus", "3", 1), ("rubrique", "null", "4", 1)}
    assert files.read_tsv(spark, str(path), schemas.INDEX_LIST, ["mot"]).columns == ["mot"]
    files.write_tsv(spark.createDataFrame([("a", "1")], schemas.TOKENS), str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "out"), schemas.TOKENS).collect()] == [("a", "1")]


def test_text_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("un ?\n\ndeux ?\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_questions(spark, str(tmp_path / "q.txt")).collect()] == [(1, "un ?"), (3, "deux ?")]
    files.write_words(spark.createDataFrame([("b",), ("a",), ("b",)], "mot string"), str(tmp_path / "w"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "w")).collect()] == ["a", "b"]
    assert files.without_blank_lines(spark.createDataFrame([("a",), (" \t",), ("",)], "value string")).count() == 1
    assert files.in_memory(spark, [("d", "t")], "doc_id string, text string").count() == 1
