"""XML, tab-separated and text files, in and out, through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glanage.functions.text import without_controls
from glanage.sources import schemas


def read_bulletins(spark: SparkSession, path: str) -> DataFrame:
    """Bulletins of XML files; those without id are skipped and ids come once."""
    raw = spark.read.format("xml").option("rowTag", "bulletin").schema(schemas.BULLETIN_XML).load(path)
    return (
        raw.select(
            F.trim("fichier").alias("fichier"),
            F.col("numero").cast("int").alias("numero"),
            F.to_date(F.trim("date"), "dd/MM/yyyy").alias("date"),
            "rubrique",
            "titre",
            "auteur",
            "texte",
            F.coalesce("images.image", F.array().cast(schemas.BULLETIN["images"].dataType)).alias("images"),
            "contact",
        )
        .where("fichier <> ''")
        .dropDuplicates(["fichier"])
    )


def write_bulletins(bulletins: DataFrame, path: str) -> None:
    """Bulletins as XML; blank fields are left out, characters XML forbids are scrubbed, the rest is escaped."""
    text = lambda c: F.nullif(F.trim(without_controls(F.col(c).cast("string"))), F.lit(""))
    out = bulletins.select(
        text("fichier").alias("fichier"),
        text("numero").alias("numero"),
        F.date_format("date", "dd/MM/yyyy").alias("date"),
        *(text(c).alias(c) for c in ("rubrique", "titre", "auteur", "texte")),
        F.when(F.size("images") > 0, F.struct(F.col("images").alias("image"))).alias("images"),
        text("contact").alias("contact"),
    )
    out.write.mode("overwrite").format("xml").option("rootTag", "corpus").option("rowTag", "bulletin").save(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated file with header; words such as ``null`` stay words."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="\u0000", emptyValue="")
    return df.select(columns) if columns else df


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(mot, lemme, ord) of tab-separated files of forms and lemmas, with header; ord is the place in the files, so the first lemma of a form can be told.

    Forms are in lower case; rows without form or lemma are left out.
    """
    rows = read_tsv(spark, path, schemas.SUBSTITUTION)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    found = rows.select(F.lower(F.trim("mot")).alias("mot"), F.trim("lemme").alias("lemme"), place.alias("ord"))
    return found.where("mot <> '' and lemme <> ''")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def decode_list(docs: Column) -> Column:
    """``['67068', '72934']`` as an array; used at import only."""
    return F.from_json(F.replace(docs, F.lit("'"), F.lit('"')), "array<string>")


def read_index(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Postings (field, term, doc_id, tf) of an index file with lists; keys are trimmed and in lower case, so duplicates merge."""
    rows = read_tsv(spark, path, schemas.INDEX_LIST).select(F.lower(F.trim("mot")).alias("term"), F.explode(decode_list(F.col("docs"))).alias("doc_id"))
    return rows.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf")).select(F.lit(field).alias("field"), "term", "doc_id", "tf")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a text file, numbered from 1 in file order; blank lines are no questions."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "question"))
    return lines.where(F.col("question").rlike(r"\S")).select((F.col("i") + 1).cast("long").alias("line_no"), "question")


def write_words(words: DataFrame, path: str, column: str = "mot") -> None:
    """A word list in order, one per line."""
    words.select(F.col(column).alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def without_blank_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.where(F.col(column).rlike(r"\S"))


def in_memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small corpus given in the program."""
    return spark.createDataFrame(rows, schema)
