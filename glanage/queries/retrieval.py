"""Queries over indexes, boolean expressions, searches, spelling and evaluation, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.functions import text
from glanage.operators import boolean, evaluate, index, lexicon, search
from glanage.plans import question
from glanage.plans.query import PartialDate, StructuredQuery
from glanage.queries import common as c
from glanage.sources import files, html

TERMS = ("the", "for", "licens", "moron", "que", "und")
#: Expressions over common words of the tables.
AND, OR, AND_NOT, MIXED = "that ∧ with ∧ from", "the ∨ und", "the ∧ ¬ with", "for ∧ ¬ that ∨ und ∧ mit ∨ que"


def postings_tf(spark: SparkSession, sf: str) -> DataFrame:
    return c.postings(spark, sf).select("term", "doc_id", "tf")


def posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of ids, as joined text."""
    p = index.posting_lists(c.postings(spark, sf))
    return p.select("term", "freq", F.array_join(F.transform("docs", lambda d: d.cast("string")), ",").alias("docs"))


def list_decode(spark: SparkSession, sf: str) -> DataFrame:
    """List literals, written and read again."""
    lists = c.documents(spark, sf).groupBy("source").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("d"))
    literal = lists.select("source", F.concat(F.lit("['"), F.array_join("d", "', '"), F.lit("']")).alias("docs"))
    return literal.select("source", F.size(files.decode_list(F.col("docs"))).cast("long").alias("n"))


def facet_index(spark: SparkSession, sf: str) -> DataFrame:
    return index.value_index(c.documents(spark, sf), "rubrique", F.col("source"))


def date_index(spark: SparkSession, sf: str) -> DataFrame:
    orders = c.table(spark, sf, "orders")
    return index.value_index(orders, "date", F.date_format("o_orderdate", "dd/MM/yyyy"), "o_orderkey")


def flag_index(spark: SparkSession, sf: str) -> DataFrame:
    return index.flag_index(c.table(spark, sf, "pages"), "ad", F.contains("html", F.lit('<div class="ad">')), "page_id")


def combined_index(spark: SparkSession, sf: str) -> DataFrame:
    p = c.postings(spark, sf).unionByName(index.value_index(c.documents(spark, sf), "rubrique", F.col("source")))
    return index.combined(p, ["texte", "rubrique"])


def title_index_compat(spark: SparkSession, sf: str) -> DataFrame:
    return index.word_index(c.documents(spark, sf), "titre", F.col("text"), compat=True).groupBy("term").agg(F.count("*").alias("n"))


def incidence(spark: SparkSession, sf: str) -> DataFrame:
    return index.incidence(c.documents(spark, sf), TERMS)


def incidence_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix over languages as documents: a language has a term if one of its texts has."""
    d = c.documents(spark, sf)
    found = index.incidence(d, TERMS).join(d.select("doc_id", "lang"), "doc_id").select("term", F.col("lang").alias("doc_id"), "present")
    return index.incidence_matrix(found, ["de", "en", "es", "fr"])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    m = index.incidence_matrix(index.incidence(c.documents(spark, sf).withColumn("one", F.lit(1)), TERMS).select(F.col("doc_id").alias("term"), F.col("term").alias("doc_id"), "present"), TERMS)
    a, b = F.col("the"), F.col("for")
    return m.select(F.col("term").alias("doc_id"), index.vector_or(a, b).alias("either"), index.vector_and(a, b).alias("both"), index.vector_and(a, index.vector_not(b)).alias("only"))


def title_index(spark: SparkSession, sf: str) -> DataFrame:
    return c.titles(spark, sf).select("term", "doc_id", "tf")


def _expression(e: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: boolean.evaluate(e, c.postings(spark, sf), c.documents(spark, sf))


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    p = c.postings(spark, sf)
    the, with_, und = (p.where(F.col("term") == t).select("doc_id") for t in ("the", "with", "und"))
    sets = {"union": boolean.union(the, und), "intersect": boolean.intersect(the, with_), "minus": boolean.minus(the, with_)}
    out = None
    for name, s in sets.items():
        part = s.select(F.lit(name).alias("op"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


def _search(q: StructuredQuery, **more: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: search.search(q, c.bulletins(spark, sf), c.postings(spark, sf), **more)


def _title_search(q: StructuredQuery | str) -> Callable[[SparkSession, str], DataFrame]:
    """A search in texts and titles; a question is analysed first."""
    return lambda spark, sf: search.SearchEngine(c.bulletins(spark, sf), c.postings(spark, sf).unionByName(c.titles(spark, sf))).search(q)


def nl_search(spark: SparkSession, sf: str) -> DataFrame:
    """A question in French, from text to documents."""
    engine = search.SearchEngine(c.bulletins(spark, sf), c.postings(spark, sf))
    return engine.search("Je voudrais les articles de la rubrique src3 ou src7 qui parlent de with ou from mais pas de that.")


def _templates() -> list[tuple[int, str]]:
    words = ["that", "with", "from", "was", "are", "for", "und", "mit", "los", "para"]
    return [(i, f"Quels sont les articles de la rubrique src{i} qui parlent de {w} ?") for i, w in enumerate(words)]


def question_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn read as a question."""
    turns = c.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"))
    q = turns.select("conv_id", "turn", question.analysed(F.col("q")).alias("s"))
    return q.select("conv_id", "turn", "s.target", F.size("s.kw_yes").alias("n_yes"), F.size("s.kw_no").alias("n_no"), "s.kw_op", F.size("s.rubriques").alias("n_rub"), "s.images", F.col("s.date_on.a").alias("year"))


def question_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    """Texts read as questions, without the words that are never keywords."""
    kept = text.without_words(text.query_text(F.col("text")), sorted(question.NOISE))
    return c.documents(spark, sf).select("doc_id", kept.alias("rest"))


def question_words(spark: SparkSession, sf: str) -> DataFrame:
    """Return word and image flag of questions made of every document's section, in built-in functions only."""
    d = c.documents(spark, sf)
    q = d.select("doc_id", F.concat(F.lit("je cherche les "), F.when(F.col("doc_id") % 3 == 0, "rubriques des articles ").otherwise("bulletins "), F.when(F.col("doc_id") % 5 == 0, "avec des images ").otherwise(""), F.lit("de "), F.col("source")).alias("q"))
    return q.select("doc_id", question.return_word(F.col("q")).alias("word"), F.coalesce(question.image_flag(F.col("q")), F.lit(False)).alias("images"), F.length(question.without_image_phrase(F.col("q"))).cast("long").alias("n"))


def partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    months = F.array(*(F.lit(m) for m in question.MONTHS))
    o = c.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    named = F.concat_ws(" ", F.dayofmonth("d").cast("string"), F.element_at(months, F.month("d")), F.year("d").cast("string"))
    t = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("d", "dd/MM/yyyy")).otherwise(named)
    return o.select("o_orderkey", question.partial_date(t).alias("p")).select("o_orderkey", "p.j", "p.m", "p.a")


def _orders_where(q: StructuredQuery) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return c.table(spark, sf, "orders").where(search.date_condition(F.col("o_orderdate"), q)).select("o_orderkey")

    return run


def prefix_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = c.parts(spark, sf)
    found = lexicon.candidates(p, p)
    return found.select("w", "mot", F.round("score", 6).alias("score"), F.col("dist").cast("long").alias("dist"))


def _misspelled(spark: SparkSession, sf: str) -> DataFrame:
    """Part words without their second letter."""
    return c.parts(spark, sf).where(F.length("mot") > 3).select(F.concat(F.substring("mot", 1, 1), F.substring("mot", 3, 100)).alias("mot")).distinct()


def nearest_words(spark: SparkSession, sf: str) -> DataFrame:
    found = lexicon.nearest(lexicon.candidates(_misspelled(spark, sf), c.parts(spark, sf)))
    return found.select("w", "mot", F.col("dist").cast("long").alias("dist"))


def correct_words(spark: SparkSession, sf: str) -> DataFrame:
    p = c.parts(spark, sf)
    words = _misspelled(spark, sf).unionByName(p.select("mot")).unionByName(spark.createDataFrame([("zzzzz",), ("  ",)], "mot string"))
    return lexicon.correct(words, p.select("mot", F.upper("mot").alias("lemme"), "ord"))


def edits1(spark: SparkSession, sf: str) -> DataFrame:
    p = c.parts(spark, sf).select(F.col("mot").alias("lemme"), "ord", F.length("mot").cast("long").alias("freq"))
    swapped = F.concat(F.substring("mot", 2, 1), F.substring("mot", 1, 1), F.substring("mot", 3, 100))
    words = _misspelled(spark, sf).unionByName(c.parts(spark, sf).select(swapped.alias("mot")))
    return lexicon.edits1(words, p)


def cascade(spark: SparkSession, sf: str) -> DataFrame:
    p = c.parts(spark, sf)
    lemmas = p.select(F.col("mot").alias("lemme"), F.length("mot").alias("freq"), "ord")
    forms = p.select(F.concat("mot", F.lit("s")).alias("mot"), F.col("mot").alias("lemme"), "ord")
    words = _misspelled(spark, sf).unionByName(p.select("mot")).unionByName(forms.select("mot")).unionByName(p.select(F.concat("mot", F.lit("ing")).alias("mot")))
    return lexicon.cascade(words, forms, lemmas)


def correct_sentences(spark: SparkSession, sf: str) -> DataFrame:
    p = c.parts(spark, sf)
    lemmas = p.select(F.col("mot").alias("lemme"), F.length("mot").alias("freq"), "ord")
    sentences = c.table(spark, sf, "part").select(F.col("p_partkey").alias("sentence_id"), F.regexp_replace("p_name", "[aeiou](?=[a-z]$)", "").alias("sentence"))
    return lexicon.correct_sentences(sentences, p.select("mot", F.col("mot").alias("lemme"), "ord"), lemmas)


def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Ten questions by section and word, judged by the quality labels."""
    d = c.documents(spark, sf)
    asked = spark.createDataFrame(_templates(), "query_id int, question string")
    analysed = asked.select("query_id", question.analysed(F.col("question")).alias("s")).select("query_id", F.get("s.rubriques", F.lit(0)).alias("source"), F.get("s.kw_yes", F.lit(0)).alias("term"))
    analysed = F.broadcast(analysed)  # ten rows
    # Only words that are asked for are counted: the index is made of no others.
    words = d.select("doc_id", F.explode(F.array_distinct(text.index_words(F.col("text")))).alias("term")).join(analysed.select("term").distinct().hint("broadcast"), "term", "left_semi")
    predicted = d.join(analysed, "source").select("query_id", "doc_id", "term").join(words, ["term", "doc_id"]).select("query_id", "doc_id")
    good = c.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    relevant = d.join(analysed, "source").join(good, "doc_id", "left_semi").select("query_id", "doc_id")
    scored = evaluate.precision_recall(asked, predicted, relevant)
    return scored.select("query_id", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


def mean_quality(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.means(precision_recall(spark, sf))
    return m.select(*(F.round(x, 6).alias(x) for x in m.columns))


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Title fields of pages, their titles put into the form of a bulletin's."""
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    dated = F.concat(F.date_format(F.date_add(F.lit("2011-01-01").cast("date"), (F.col("page_id") % 1000).cast("int")), "yyyy/MM/dd"), F.lit(" > BE France "), (F.col("page_id") % 300).cast("string"), F.lit(" > "), F.translate(t, ">", ""))
    f = c.table(spark, sf, "pages").select("page_id", html.title_parts(dated).alias("f"))
    return f.select("page_id", F.date_format("f.date", "dd/MM/yyyy").alias("date"), "f.numero", "f.titre")


def page_ids(spark: SparkSession, sf: str) -> DataFrame:
    return c.table(spark, sf, "pages").select("page_id", html.document_id(F.regexp_extract("url", "^[^?#]*", 0)).alias("fichier"))


def page_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The HTML pass over every page."""
    p = c.table(spark, sf, "pages").select("page_id", html.pieces(F.col("html")).alias("p"))
    return p.select("page_id", F.length("p.title").alias("n_title"), "p.has_author", F.size("p.spans").alias("n_spans"), F.size("p.cells").alias("n_cells"), "p.error")


def page_bulletins(spark: SparkSession, sf: str) -> DataFrame:
    """Bulletins of pages that are wrapped as the old ones were; images and text in their classes."""
    pages = c.table(spark, sf, "pages")
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    body = F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "<[^>]*>", " ")
    page = F.concat(
        F.lit("<html><head><title>2012/03/0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit(" > BE France 27 > "), t,
        F.lit('</title></head><body><span class="style42">Focus</span><table><tr><td><span class="style17">'), t,
        F.lit('</span><span class="style95">'), body, F.lit('</span></td></tr></table><div style="text-align: center"><img src="x.jpg"><span class="style21">l</span></div></body></html>'),
    )
    found = html.bulletins(pages.select(F.concat(F.lit("/b/"), F.col("page_id").cast("string"), F.lit(".htm")).alias("path"), page.alias("html")))
    return found.select("fichier", "numero", "date", "rubrique", F.size("images").alias("n_images"), F.length("texte").alias("n_texte"), "error")


def _k(*terms: str, **more: object) -> StructuredQuery:
    return StructuredQuery(kw_yes=terms, **more)


_P = f"with {c.POSTINGS}"
_HAS = "doc_id {} (select doc_id from idx where term = '{}')"
has = lambda t: _HAS.format("in", t)
hasnt = lambda t: _HAS.format("not in", t)
_D = f"{_P} select distinct doc_id from documents where "
_B = f"{_P}, {c.BULLETINS} select distinct doc_id from b where "
_BAD = f"{c.PARTS}, bad as (select distinct substr(mot, 1, 1) || substr(mot, 3) as w from lex where length(mot) > 3)"
_PREFIX = "list_aggregate(list_transform(range(1, least(length(a.w), length(b.mot)) + 1), lambda i: case when substr(a.w, 1, i) = substr(b.mot, 1, i) then i else 0 end), 'max')"
_SCORE = f"case when length(a.w) >= 3 and length(b.mot) >= 3 and abs(length(a.w) - length(b.mot)) <= 4 then 100.0 * {_PREFIX} / greatest(length(a.w), length(b.mot)) else 0 end"
_NEAR = f"{_BAD}, cand as (select a.w, b.mot, b.ord, levenshtein(a.w, b.mot) as dist from bad a, lex b where {_SCORE} > 0)"
_QRELS = ", ".join(f"({i}, 'src{i}', '{q.split(' de ')[-1][:-2]}')" for i, q in _templates())
_PR = (
    f"{c.POSTINGS}, q(query_id, source, term) as (values {_QRELS}), p as (select query_id, doc_id from q join documents using (source) join idx using (term, doc_id)), "
    "r as (select query_id, doc_id from q join documents using (source) where doc_id in (select doc_id from labels where quality = 1)), "
    "n as (select query_id, (select count(*) from p where p.query_id = q.query_id) as np, (select count(*) from r where r.query_id = q.query_id) as nr, "
    "(select count(*) from p join r using (query_id, doc_id) where p.query_id = q.query_id) as nb from q), "
    "s as (select query_id, case when np > 0 then nb / np else 1 end as precision, case when nr > 0 then nb / nr else 1 end as recall from n), "
    "f as (select query_id, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from s)"
)
Y, M = PartialDate, "('janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre')"



def _compat_sql() -> str:
    """Signs blanked, then every article cut wherever it begins a word."""
    out = "translate(text, '.,?:' || chr(10) || '\"!', '       ')"
    for a in text.ARTICLES:
        out = f"replace({out}, ' {a.replace(chr(39), chr(39) * 2)}', ' ')"
    return out


def _cascade_sql(words: str, forms: str) -> str:
    """The correction of every word of ``words`` (w), over lemmas lem (mot, freq, ord) and forms (mot, lemme, ord)."""
    return (
        f"lem as (select mot, length(mot) as freq, ord from lex), forms as ({forms}), words as ({words}), al as (select unnest(string_split('{lexicon.LETTERS}', '')) as x), "
        "e as (select w, substr(w, 1, i - 1) || substr(w, i + 1) as v from (select w, unnest(range(1, length(w) + 1)) as i from words) union "
        "select w, substr(w, 1, i - 1) || substr(w, i + 1, 1) || substr(w, i, 1) || substr(w, i + 2) from (select w, unnest(range(1, length(w))) as i from words) union "
        "select w, substr(w, 1, i - 1) || x || substr(w, i + 1) from (select w, unnest(range(1, length(w) + 1)) as i from words), al union "
        "select w, substr(w, 1, i - 1) || x || substr(w, i) from (select w, unnest(range(1, length(w) + 2)) as i from words), al), "
        "one as (select w, arg_min(mot, (-freq, mot)) as edit from e join lem on mot = v where w <> v group by 1), "
        f"near as (select *, levenshtein(w, mot) as dist, row_number() over (partition by w order by score desc, ord) as r from (select a.w, b.mot, b.lemme, b.ord, {_SCORE} as score from words a, forms b) where score >= 60), "
        "pre as (select w, arg_min(lemme, (dist, -score, ord)) as prefix from near where r <= 10 and dist <= 2 group by 1), "
        "fixed as (select w as mot, coalesce(lem.mot, forms.lemme, edit, prefix) as corrected, case when lem.mot is not null then 'lemma' when forms.lemme is not null then 'form' "
        "when edit is not null then 'edit' when prefix is not null then 'prefix' else 'none' end as method "
        "from words left join lem on lem.mot = w left join forms on forms.mot = w left join one using (w) left join pre using (w))"
    )


_CASCADE = _cascade_sql(
    "select w from bad union select mot from lex union select mot || 's' from lex union select mot || 'ing' from lex", "select mot || 's' as mot, mot as lemme, ord from lex"
)
_SENTENCES = _cascade_sql("select distinct mot as w from placed", "select mot, mot as lemme, ord from lex")
_PLACED = (
    "placed as (select p_partkey as sentence_id, i - 1 as pos, a[i] as mot from (select p_partkey, a, unnest(range(1, len(a) + 1)) as i from "
    "(select p_partkey, string_split(regexp_replace(lower(p_name), '[aeiou]([a-z])$', '\\1'), ' ') as a from part)))"
)

QUERIES = {
    "postings_tf": (postings_tf, f"{_P} select * from idx"),
    "posting_lists": (posting_lists, f"{_P} select term, count(*) as freq, array_to_string(list_sort(list(doc_id)), ',') as docs from idx group by 1"),
    "list_decode": (list_decode, "select source, count(*) as n from documents group by 1"),
    "facet_index": (facet_index, "select 'rubrique' as field, lower(source) as term, doc_id, cast(1 as int) as tf from documents"),
    "date_index": (date_index, "select 'date' as field, strftime(o_orderdate, '%d/%m/%Y') as term, o_orderkey as doc_id, cast(1 as int) as tf from orders"),
    "flag_index": (flag_index, "select 'ad' as field, case when contains(html, '<div class=\"ad\">') then 'yes' else 'no' end as term, page_id as doc_id, cast(1 as int) as tf from pages"),
    "combined_index": (combined_index, f"{_P} select term, doc_id, cast(sum(tf) as int) as tf from (select term, doc_id, tf from idx union all select lower(source), doc_id, 1 from documents) group by 1, 2"),
    "title_index": (title_index, f"with {c.TITLES} select * from titles"),
    "title_index_compat": (title_index_compat, f"select term, count(*) as n from (select distinct doc_id, unnest(list_filter(regexp_split_to_array(lower({_compat_sql()}), '\\s+'), lambda x: x <> '')) as term from documents) group by 1"),
    "incidence": (incidence, "select term, doc_id, cast(contains(lower(text), term) as int) as present from documents, (select unnest(['the','for','licens','moron','que','und']) as term)"),
    "incidence_by_lang": (
        incidence_by_lang,
        "select term, " + ", ".join(f"max(case when lang = '{x}' and contains(lower(text), term) then 1 else 0 end) as {x}" for x in ("de", "en", "es", "fr"))
        + " from documents, (select unnest(['the','for','licens','moron','que','und']) as term) group by 1",
    ),
    "vectors": (
        vectors,
        "select doc_id, cast(greatest(a, b) as int) as either, cast(least(a, b) as int) as both, cast(least(a, 1 - b) as int) as only from "
        "(select doc_id, contains(lower(text), 'the')::int as a, contains(lower(text), 'for')::int as b from documents)",
    ),
    "bool_and": (_expression(AND), _D + f"{has('that')} and {has('with')} and {has('from')}"),
    "bool_or": (_expression(OR), _D + f"{has('the')} or {has('und')}"),
    "bool_and_not": (_expression(AND_NOT), _D + f"{has('the')} and {hasnt('with')}"),
    "bool_not": (_expression("¬ the"), _D + hasnt("the")),
    "bool_expression": (_expression(MIXED), _D + f"{has('for')} and {hasnt('that')} or {has('und')} and {has('mit')} or {has('que')}"),
    "set_operations": (
        set_operations,
        f"{_P} select 'union' as op, doc_id from documents where {has('the')} or {has('und')} union all select 'intersect', doc_id from documents where {has('the')} and {has('with')} "
        f"union all select 'minus', doc_id from documents where {has('the')} and {hasnt('with')}",
    ),
    "search_keywords_or": (_search(_k("moron", "idiot", kw_op="or")), _B + f"{has('moron')} or {has('idiot')}"),
    "search_unknown_ignored": (_search(_k("that", "nosuchword")), _B + has("that")),
    "search_none_known": (_search(_k("nosuchword")), _B + "false"),
    "search_facet_not": (_search(_k("that", rubriques=("src3", "SRC7 "), kw_no=("with",))), _B + f"rubrique in ('src3', 'src7') and {has('that')} and {hasnt('with')}"),
    "search_title_and": (_title_search(_k(titres=("the", "of", "nosuchword"))), f"with {c.TITLES} select doc_id from titles where term = 'the' intersect select doc_id from titles where term = 'of'"),
    "search_title_or_text": (
        _title_search(_k("that", titres=("die", "the"), titre_op="or", kw_no=("moron",))),
        f"with {c.POSTINGS}, {c.TITLES} select distinct doc_id from documents where doc_id in (select doc_id from titles where term in ('die', 'the')) and {has('that')} and {hasnt('moron')}",
    ),
    "search_question_title": (
        _title_search("Quels sont les bulletins dont le titre contient les mots 'the' ou 'die' ?"),
        f"with {c.TITLES} select distinct doc_id from titles where term in ('the', 'die')",
    ),
    "search_question_images": (
        _title_search("Je cherche les articles avec des images qui parlent de that et de with, écrits entre janvier 1994 et décembre 1998 mais pas en juin 1996."),
        _B + f"has_image and {has('that')} and {has('with')} and year(date) between 1994 and 1998 and not (year(date) = 1996 and month(date) = 6)",
    ),
    "search_sections_and": (_search(_k("that", rubriques=("src3", "SRC3 "), rub_op="and")), _B + f"rubrique = 'src3' and {has('that')}"),
    "search_two_sections_and": (_search(_k("that", rubriques=("src3", "src7"), rub_op="and")), _B + "false"),
    "search_images": (_search(_k(images=True)), _B + "has_image"),
    "search_compat": (_search(_k("nosuchword", rubriques=("src3",)), compat=True), _B + "rubrique = 'src3'"),
    "search_dates": (
        _search(_k("the", date_from=Y(year=1996), date_to=Y(month=6, year=1999), date_not=Y(month=6))),
        _B + f"{has('the')} and year(date) >= 1996 and year(date) * 100 + month(date) <= 199906 and month(date) <> 6",
    ),
    "search_return_facets": (_search(_k("moron", target="rubriques")), f"{_P}, {c.BULLETINS} select distinct lower(rubrique) as rubrique from b where {has('moron')}"),
    "nl_search": (nl_search, _B + f"rubrique in ('src3', 'src7') and ({has('with')} or {has('from')}) and {hasnt('that')}"),
    "question_batch": (question_batch, None),
    "question_stop_words": (
        question_stop_words,
        "select doc_id, array_to_string(list_filter(regexp_split_to_array(lower(translate(text, '’?.', chr(39))), '\\s+'), lambda x: x <> '' and x not in ("
        + ", ".join(f"'{w}'" for w in sorted(question.NOISE))
        + ")), ' ') as rest from documents",
    ),
    "question_words": (
        question_words,
        "select doc_id, case when doc_id % 3 = 0 then 'rubriques' else 'bulletins' end as word, doc_id % 5 = 0 as images, "
        "length('je cherche les ') + case when doc_id % 3 = 0 then length('rubriques des articles ') else length('bulletins ') end + case when doc_id % 5 = 0 then 2 else 0 end + 3 + length(source) as n from documents",
    ),
    "partial_dates": (partial_dates, "select o_orderkey, cast(day(o_orderdate) as int) as j, cast(month(o_orderdate) as int) as m, cast(year(o_orderdate) as int) as a from orders"),
    "date_between_not_month": (_orders_where(_k(date_from=Y(year=1996), date_to=Y(year=1997), date_not=Y(month=6))), "select o_orderkey from orders where year(o_orderdate) between 1996 and 1997 and month(o_orderdate) <> 6"),
    "date_precise_partial": (_orders_where(_k(date_on=Y(month=3, year=1998), date_from=Y(year=2000))), "select o_orderkey from orders where year(o_orderdate) = 1998 and month(o_orderdate) = 3"),
    "date_from_inclusive": (_orders_where(_k(date_from=Y(15, 7, 2000))), "select o_orderkey from orders where o_orderdate >= date '2000-07-15'"),
    "date_to_full": (_orders_where(_k(date_to=Y(15, 7, 1996))), "select o_orderkey from orders where cast(o_orderdate as date) <= date '1996-07-15'"),
    "prefix_scores": (
        prefix_scores,
        f"with {c.PARTS} select a.w, b.mot, round({_SCORE}, 6) as score, levenshtein(a.w, b.mot) as dist from (select mot as w from lex) a, lex b where {_SCORE} > 0",
    ),
    "nearest_words": (nearest_words, f"with {_NEAR} select w, arg_min(mot, (dist, ord)) as mot, min(dist) as dist from cand group by 1"),
    "correct_words": (
        correct_words,
        f"with {_BAD}, words as (select w from bad union select mot from lex union select 'zzzzz'), "
        f"cand as (select a.w, b.mot, b.ord, levenshtein(a.w, b.mot) as dist from words a, lex b where {_SCORE} > 0 and a.w not in (select mot from lex)), "
        "near as (select w, arg_min(upper(mot), (dist, ord)) as near from cand group by 1) "
        "select words.w as mot, coalesce(case when lex.mot is not null then upper(lex.mot) end, near, words.w) as corrected, "
        "case when lex.mot is not null then 'form' when near is not null then 'nearest' else 'kept' end as method from words left join lex on lex.mot = words.w left join near on near.w = words.w",
    ),
    "edits1": (
        edits1,
        f"with {_BAD}, words as (select w from bad union select substr(mot, 2, 1) || substr(mot, 1, 1) || substr(mot, 3) from lex), al as (select unnest(string_split('{lexicon.LETTERS}', '')) as x), "
        "e as (select w, substr(w, 1, i - 1) || substr(w, i + 1) as v from (select w, unnest(range(1, length(w) + 1)) as i from words) union "
        "select w, substr(w, 1, i - 1) || substr(w, i + 1, 1) || substr(w, i, 1) || substr(w, i + 2) from (select w, unnest(range(1, length(w))) as i from words) union "
        "select w, substr(w, 1, i - 1) || x || substr(w, i + 1) from (select w, unnest(range(1, length(w) + 1)) as i from words), al union "
        "select w, substr(w, 1, i - 1) || x || substr(w, i) from (select w, unnest(range(1, length(w) + 2)) as i from words), al) "
        "select distinct w, mot as lemme, length(mot) as freq from e join lex on mot = v where w <> v",
    ),
    "correct_cascade": (cascade, f"with {_BAD}, {_CASCADE} select * from fixed"),
    "correct_sentences": (correct_sentences, f"with {c.PARTS}, {_PLACED}, {_SENTENCES} select sentence_id, cast(pos as int) as pos, mot, corrected, method from placed join fixed using (mot)"),
    "precision_recall_f1": (precision_recall, f"with {_PR} select * from f"),
    "mean_quality": (mean_quality, f"with {_PR} select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1 from f"),
    "page_titles": (
        page_titles,
        "select page_id, strftime(date '2011-01-01' + cast(page_id % 1000 as int), '%d/%m/%Y') as date, cast(page_id % 300 as int) as numero, "
        "trim(translate(translate(regexp_extract(html, '<title>([^<]*)</title>', 1), '>', ''), chr(160), ' ')) as titre from pages",
    ),
    "page_ids": (page_ids, "select page_id, regexp_extract(regexp_extract(url, '^[^?#]*'), '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1) as fichier from pages"),
    "page_pieces": (page_pieces, None),
    "page_bulletins": (page_bulletins, None),
}
