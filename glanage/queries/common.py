"""Inputs of the registered queries: the driver's tables in the roles of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.functions import stem, text
from glanage.operators import index, weights


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def french(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("lang = 'fr'")


def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.tf(weights.tokens(documents(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tf(spark, sf_dir)
    return weights.tf_idf(t, weights.idf(t))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.word_index(documents(spark, sf_dir), "texte", F.col("text"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of titles: the first twelve words of a text."""
    return index.word_index(documents(spark, sf_dir), "titre", F.array_join(F.slice(text.words(F.col("text")), 1, 12), " "))


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs of the search: a document with its source as section and the date of the order of the same number."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("date"))
    d = documents(spark, sf_dir).select("doc_id", F.col("source").alias("rubrique"), F.contains(F.lower("text"), F.lit("licens")).alias("has_image"))
    return d.join(orders, "doc_id", "left")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mot, ord): words of part names, the first part that has one giving its place."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("mot"), F.col("p_partkey").alias("ord"))
    return words.where("mot <> ''").groupBy("mot").agg(F.min("ord").alias("ord"))


# --- the same in SQL ---------------------------------------------------------------------------------------------

PUNCTUATION = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
_CLEAN = f"lower(translate(coalesce(text, ''), {PUNCTUATION}, ''))"
TOKENS = f"tok as (select doc_id, unnest(list_filter(regexp_split_to_array({_CLEAN}, '\\s+'), lambda x: x <> '')) as mot, lang from documents)"
TF = f"{TOKENS}, tf as (select mot, doc_id, count(*) as tf from tok group by 1, 2)"
IDF = f"{TF}, idf as (select mot, log10((select count(distinct doc_id) from tf) / count(*)) as idft from tf group by 1)"
SCORED = f"{IDF}, w as (select doc_id, tf.mot, tf * idft as tf_idf from tf join idf using (mot))"
_ARTICLES = "'le','la','les','un','une','des','du','de','d''','l’','l''','au','aux'"


def _postings(words: str, idx: str, content: str) -> str:
    return (
        f"{words} as (select doc_id, list_filter(regexp_split_to_array(lower("
        f"translate({content}, '.,?:' || chr(10) || '\"!', '       ')), '\\s+'), lambda x: x <> '') as w from documents), "
        f"{idx} as (select term, doc_id, cast(count(*) as int) as tf from (select doc_id, unnest(list_transform(list_filter(w, lambda t, i: "
        f"t not in ({_ARTICLES}) and not (t = 'à' and coalesce(w[i + 1] = 'la' or regexp_matches(w[i + 1], '^l[''’]'), false))), "
        f"lambda t: regexp_replace(t, '^(?:d''|l[''’])', ''))) as term from {words}) where term <> '' group by 1, 2)"
    )


POSTINGS = _postings("words", "idx", "coalesce(text, '')")
TITLES = _postings("heads", "titles", "array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')[1:12], ' ')")
BULLETINS = (
    "b as (select doc_id, source as rubrique, contains(lower(text), 'licens') as has_image, cast(o_orderdate as date) as date "
    "from documents left join orders on o_orderkey = doc_id)"
)
PARTS = "lex as (select mot, min(p_partkey) as ord from (select p_partkey, unnest(regexp_split_to_array(lower(p_name), '\\s+')) as mot from part) where mot <> '' group by 1)"


def _lemma() -> str:
    """The lemma rules over a lower-case column mot."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    ends = lambda these: "(" + " or ".join(f"suffix(mot, {quoted(x)})" for x in these) + ")"
    cut = lambda n: f"left(mot, length(mot) - {n})"
    irregular = " ".join(f"when mot = {quoted(k)} then {quoted(v)}" for k, v in stem.IRREGULAR.items())
    endings = " ".join(f"when {ends([e])} and length(mot) > {len(e) + 2} then {cut(len(e))} || {quoted(p)}" for e, p in stem.ENDINGS)
    return f"case {irregular} when length(mot) <= 3 then mot {endings} when {ends(['s'])} and not {ends(stem.KEPT_S)} then {cut(1)} when {ends(['ux'])} and not {ends(stem.KEPT_X)} then {cut(1)} else mot end"


LEMMA = _lemma()
