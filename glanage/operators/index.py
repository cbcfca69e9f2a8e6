"""Inverted indexes as one table of postings (field, term, doc_id, tf)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glanage.functions import text


def _postings(field: str, rows: DataFrame) -> DataFrame:
    """rows has term and doc_id, one row per occurrence."""
    counted = rows.where("term is not null and term <> ''").groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"))
    return counted.select(F.lit(field).alias("field"), "term", "doc_id", "tf")


def word_index(docs: DataFrame, field: str, content: Column, doc_id: str = "doc_id", articles: Sequence[str] = text.ARTICLES, compat: bool = False) -> DataFrame:
    """Words of a text or title field."""
    rule = text.index_words_compat if compat else text.index_words
    return _postings(field, docs.select(F.explode(rule(content, articles)).alias("term"), F.col(doc_id).alias("doc_id")))


def value_index(docs: DataFrame, field: str, value: Column, doc_id: str = "doc_id") -> DataFrame:
    """Whole values of a field (section, date), trimmed and in lower case before they are grouped."""
    return _postings(field, docs.select(F.lower(F.trim(value.cast("string"))).alias("term"), F.col(doc_id).alias("doc_id")))


def flag_index(docs: DataFrame, field: str, flag: Column, doc_id: str = "doc_id") -> DataFrame:
    return _postings(field, docs.select(F.when(flag, "yes").otherwise("no").alias("term"), F.col(doc_id).alias("doc_id")))


def write_postings(postings: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Stores postings in order of field and term, and reads them back.

    A lookup then reads only the row groups that may hold its terms. Ranges
    include the document, so that the postings of a frequent term spread over
    files like any others.
    """
    keys = ["field", "term", "doc_id"]
    placed = postings.repartitionByRange(partitions, *keys) if partitions else postings.repartitionByRange(*keys)
    placed.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return postings.sparkSession.read.schema(postings.schema).parquet(path)


def index_bulletins(bulletins: DataFrame, compat: bool = False) -> DataFrame:
    """All five indexes of bulletins."""
    b = bulletins.withColumn("doc_id", F.col("fichier"))
    parts = [
        word_index(b, "texte", F.col("texte"), compat=compat),
        word_index(b, "titre", F.col("titre"), compat=compat),
        value_index(b, "rubrique", F.col("rubrique")),
        value_index(b, "date", F.date_format("date", "dd/MM/yyyy")),
        flag_index(b, "image", F.coalesce(F.size("images") > 0, F.lit(False))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def combined(postings: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One index over several fields."""
    return postings.where(F.col("field").isin(*fields)).groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))


def posting_lists(postings: DataFrame) -> DataFrame:
    """term, freq (documents) and docs in order. A list is as long as its term is frequent: for display and export."""
    return postings.groupBy("term").agg(F.count_distinct("doc_id").alias("freq"), F.array_sort(F.collect_set("doc_id")).alias("docs"))


def incidence(docs: DataFrame, terms: Sequence[str], content: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(term, doc_id, present) for every given term and document: present is 1 if the text holds the term anywhere."""
    found = F.array(*(F.struct(F.lit(t).alias("term"), F.contains(F.coalesce(F.lower(content), F.lit("")), F.lit(t)).cast("int").alias("present")) for t in terms))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("f")).select("f.term", "doc_id", "f.present")


def incidence_matrix(incidence: DataFrame, doc_ids: Sequence[object]) -> DataFrame:
    """One row per term and one 0/1 column per given document."""
    return incidence.groupBy("term").pivot("doc_id", list(doc_ids)).agg(F.max("present")).na.fill(0)


def vector_or(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def vector_and(a: Column, b: Column) -> Column:
    return F.least(a, b)


def vector_not(a: Column) -> Column:
    return 1 - a
