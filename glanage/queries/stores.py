"""Queries that write through the sinks and read back through the sources, with their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.operators import index, lexicon, weights
from glanage.queries import common as c
from glanage.sources import files, schemas

_LOCAL: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode only, deleted at the end."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="glanage-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        shared = f"file://{_LOCAL[0]}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bulletins_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as bulletins in XML, and back."""
    d = c.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("fichier"), (F.col("doc_id") % 300).cast("int").alias("numero"), F.date_add(F.lit("2011-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")).alias("date"),
        F.col("source").alias("rubrique"), F.col("lang").alias("titre"), F.lit(None).cast("string").alias("auteur"), F.col("text").alias("texte"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.struct(F.concat("lang", F.lit(".jpg")).alias("urlImage"), F.col("source").alias("legendeImage")))).alias("images"), F.lit(" ").alias("contact"),
    )
    path = folder(spark, "bulletins")
    files.write_bulletins(d, path)
    got = files.read_bulletins(spark, path)
    return got.select("fichier", "numero", F.date_format("date", "yyyy-MM-dd").alias("date"), "rubrique", "titre", "auteur", F.length(F.regexp_replace("texte", r"(?U)\s", "")).cast("long").alias("n"), F.size("images").cast("long").alias("n_images"), "contact")


def weights_tsv(spark: SparkSession, sf: str) -> DataFrame:
    """Term frequencies as a tab-separated file, and two of its columns back."""
    path = folder(spark, "tf")
    files.write_tsv(c.tf(spark, sf).select("mot", F.col("doc_id").cast("string").alias("doc_id"), "tf"), path)
    return files.read_tsv(spark, path, schemas.TF, ["mot", "tf"]).groupBy("mot").agg(F.sum("tf").alias("n"))


def index_lists(spark: SparkSession, sf: str) -> DataFrame:
    """An index of sections as lists in a file, read as postings."""
    lists = c.documents(spark, sf).groupBy("source").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("d"))
    path = folder(spark, "index")
    files.write_tsv(lists.select(F.concat(F.upper("source"), F.lit(" ")).alias("mot"), F.concat(F.lit("['"), F.array_join("d", "', '"), F.lit("']")).alias("docs")), path)
    return files.read_index(spark, path, "rubrique")


def word_list(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words as a text file in order, read without blank lines."""
    path = folder(spark, "words")
    words = weights.tokens(c.documents(spark, sf)).select("mot")
    files.write_words(words.unionByName(spark.createDataFrame([(" ",)], "mot string")), path)
    return files.without_blank_lines(spark.read.text(path)).select(F.col("value").alias("mot"))


def question_file(spark: SparkSession, sf: str) -> DataFrame:
    """A file of questions with blank lines between, one about each nation."""
    lines = c.table(spark, sf, "nation").select(F.struct("n_nationkey", F.concat(F.lit("Quels articles parlent de "), F.lower("n_name"), F.lit(" ?")).alias("q")).alias("s"))
    path = folder(spark, "questions")
    lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["q"]), "\n\n").alias("value")).write.text(path)  # a row per nation
    return files.read_questions(spark, path)


def lexicon_file(spark: SparkSession, sf: str) -> DataFrame:
    """A lexicon of forms and lemmas in a file, applied to the words of the documents before any rule."""
    words = lexicon.distinct_words(weights.tokens(c.documents(spark, sf)))
    path = folder(spark, "lexicon")
    files.write_tsv(words.where(F.length("mot") % 2 == 0).select(F.concat("mot", F.lit(" ")).alias("mot"), F.concat(F.lit("l"), F.substring("mot", 1, 4)).alias("lemme")), path)
    return lexicon.lemmas_by(words, files.read_lexicon(spark, path))


def stored_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings stored in ranges, and how many documents each term of a few has."""
    kept = index.write_postings(c.postings(spark, sf), folder(spark, "postings"), 4)
    return kept.where((F.col("field") == "texte") & F.col("term").isin("the", "und", "moron")).groupBy("term").agg(F.count("*").alias("n"))


QUERIES = {
    "bulletins_xml": (
        bulletins_xml,
        "select cast(doc_id as varchar) as fichier, cast(doc_id % 300 as int) as numero, strftime(date '2011-01-01' + cast(doc_id % 900 as int), '%Y-%m-%d') as date, source as rubrique, lang as titre, "
        "cast(null as varchar) as auteur, length(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[\\s\\x0B\\x85\\pZ]', '', 'g')) as n, case when doc_id % 4 = 0 then 1 else 0 end as n_images, cast(null as varchar) as contact from documents",
    ),
    "weights_tsv": (weights_tsv, f"with {c.TOKENS} select mot, count(*) as n from tok group by 1"),
    "index_lists": (index_lists, "select 'rubrique' as field, lower(source) as term, cast(doc_id as varchar) as doc_id, cast(1 as int) as tf from documents"),
    "word_list": (word_list, f"with {c.TOKENS} select distinct mot from tok"),
    "questions": (question_file, "select 2 * row_number() over (order by n_nationkey) - 1 as line_no, 'Quels articles parlent de ' || lower(n_name) || ' ?' as question from nation"),
    "lexicon_file": (lexicon_file, f"with {c.TOKENS}, w as (select distinct mot from tok where regexp_matches(mot, '\\p{{L}}')) select mot, case when length(mot) % 2 = 0 then 'l' || substr(mot, 1, 4) else {c.LEMMA} end as lemme from w"),
    "stored_postings": (stored_postings, f"with {c.POSTINGS} select term, count(*) as n from idx where term in ('the', 'und', 'moron') group by 1"),
}
