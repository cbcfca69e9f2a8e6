"""Queries over tokens, weights, stop lists and word maps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.functions import text
from glanage.operators import lexicon, weights
from glanage.queries import common as c

R = 6


def tokens_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return c.documents(spark, sf).select("doc_id", F.size(text.words(text.clean(F.col("text")))).cast("long").alias("n_tokens"))


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    """The scalar rules side by side, over questions made of document texts."""
    t = F.col("text")
    return c.documents(spark, sf).select(
        "doc_id",
        F.length(text.clean_markup(t)).cast("long").alias("markup"),
        F.length(text.clean_light(t)).cast("long").alias("light"),
        F.size(text.blank_words(text.clean_light(t))).cast("long").alias("blanks"),
        F.length(text.query_text(t)).cast("long").alias("query"),
        F.size(text.words(text.without_words(F.lower(t)))).cast("long").alias("content"),
        text.has_letter(t).alias("letter"),
        text.has_number(t).alias("number"),
        F.length(text.without_controls(t)).cast("long").alias("printable"),
        F.size(text.elided_words(t)).cast("long").alias("elided"),
    )


def title_concat(spark: SparkSession, sf: str) -> DataFrame:
    return c.documents(spark, sf).select("doc_id", F.length(text.title_and_text(F.col("source"), F.col("text"))).cast("long").alias("n"))


def tf(spark: SparkSession, sf: str) -> DataFrame:
    return c.tf(spark, sf)


def idf(spark: SparkSession, sf: str) -> DataFrame:
    return weights.idf(c.tf(spark, sf)).select("mot", F.round("idft", R).alias("idft"))


def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return weights.df(c.tf(spark, sf))


def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return c.scored(spark, sf).select("doc_id", "mot", F.round("tf_idf", R).alias("tf_idf"))


def tfidf_top(spark: SparkSession, sf: str) -> DataFrame:
    rounded = c.scored(spark, sf).withColumn("tf_idf", F.round("tf_idf", R))
    return weights.top(rounded, 100, F.desc("tf_idf"), F.col("mot"), F.col("doc_id"))


def tfidf_low(spark: SparkSession, sf: str) -> DataFrame:
    rounded = c.scored(spark, sf).withColumn("tf_idf", F.round("tf_idf", R))
    return weights.low_tail(rounded, 0.17)


def tfidf_high(spark: SparkSession, sf: str) -> DataFrame:
    rounded = c.scored(spark, sf).withColumn("tf_idf", F.round("tf_idf", R))
    return weights.high_tail(rounded, 0.95)


def tfidf_clipped(spark: SparkSession, sf: str) -> DataFrame:
    rounded = c.scored(spark, sf).withColumn("tf_idf", F.round("tf_idf", R))
    return weights.clipped(rounded).groupBy("doc_id").agg(F.round(F.max("tf_idf"), R).alias("most"))


def mean_weights(spark: SparkSession, sf: str) -> DataFrame:
    return weights.mean_per_word(c.scored(spark, sf)).select("mot", F.round("avg_tf_idf", R).alias("avg_tf_idf"))


def tfidf_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rounded = c.scored(spark, sf).withColumn("tf_idf", F.round("tf_idf", R))
    return weights.histogram(rounded, 0.0, 10.0, 20)


def stop_words_tails(spark: SparkSession, sf: str) -> DataFrame:
    rounded = c.scored(spark, sf).withColumn("tf_idf", F.round("tf_idf", R))
    return weights.stop_words_by_tails(rounded)


def stop_words_means(spark: SparkSession, sf: str) -> DataFrame:
    t = c.tf(spark, sf)
    i = weights.idf(t).withColumn("idft", F.round("idft", R))
    return weights.stop_words_by_means(weights.tf_idf(t, i), i, idf_below=0.3)


def stop_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences left per document when the hundred most frequent words are out."""
    tokens = weights.tokens(c.documents(spark, sf))
    stop = lexicon.frequencies(tokens, "mot", 100)
    return weights.without_stop_words(tokens, stop).groupBy("doc_id").agg(F.count("*").alias("n"))


def filtered_text(spark: SparkSession, sf: str) -> DataFrame:
    d = c.documents(spark, sf)
    stop = lexicon.frequencies(weights.tokens(d), "mot", 20)
    return weights.filtered_text(d, stop)


def frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.frequencies(weights.tokens(c.documents(spark, sf)), "mot", 10)


def _both(spark: SparkSession, sf: str) -> DataFrame:
    """Words with their lemmas and with a simple map that SQL has too in place of stems: the first five letters."""
    tokens = weights.tokens(c.documents(spark, sf))
    short = lexicon.distinct_words(tokens).select("mot", F.substring("mot", 1, 5).alias("racine"))
    return lexicon.joined_maps(lexicon.lemma_map(tokens), short)


def map_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Lemmas beside true stems of the French words: how much each reduces, and by how many letters."""
    tokens = weights.tokens(c.french(spark, sf))
    both = lexicon.joined_maps(lexicon.lemma_map(tokens), lexicon.stem_map(tokens))
    return lexicon.distinct_counts(both).crossJoin(F.broadcast(lexicon.lengths(both)))  # one row each


def map_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = lexicon.distinct_counts(_both(spark, sf))
    return d.select("n_mot", "n_lemme", "n_racine", F.round("reduction_lemme", R).alias("reduction_lemme"), F.round("reduction_racine", R).alias("reduction_racine"))


def map_families(spark: SparkSession, sf: str) -> DataFrame:
    f = lexicon.families(_both(spark, sf), base="racine")
    return f.select("racine", "n_forms", F.array_join("forms", ",").alias("forms"))


def map_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.pair_counts(_both(spark, sf))


def map_lengths(spark: SparkSession, sf: str) -> DataFrame:
    d = lexicon.lengths(_both(spark, sf))
    return d.select(*(F.round(x, R).alias(x) for x in d.columns))


def map_different(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.different(_both(spark, sf))


def verb_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.verbs(lexicon.different(_both(spark, sf))).select("mot", "lemme")


def verb_sample(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.verb_sample(_both(spark, sf)).select("mot", "lemme")


def lemma_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """How often each lemma of the corpus occurs, in any of its forms."""
    return lexicon.lexicon_of(weights.tokens(c.documents(spark, sf)))[1].select("lemme", "freq")


def lemmatised(spark: SparkSession, sf: str) -> DataFrame:
    """Part names with every word put to a lemma by a lexicon."""
    p = c.parts(spark, sf).select("mot", F.concat(F.substring("mot", 1, 3), F.lit("-")).alias("lemme"), "ord")
    return lexicon.lemmatise_sentences(c.table(spark, sf, "part").select(F.col("p_partkey").alias("sentence_id"), F.col("p_name").alias("sentence")), p)


def word_sample(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.sample_of(lexicon.distinct_words(weights.tokens(c.documents(spark, sf))), "mot", 15)


def substituted(spark: SparkSession, sf: str) -> DataFrame:
    """French texts with every word of five letters or more cut to five; the map is made of the words themselves."""
    d = c.documents(spark, sf)
    w = d.select(F.explode(text.words(F.lower("text"))).alias("mot")).distinct()
    return lexicon.substitute(d, w.where(F.length("mot") > 5).select("mot", F.substring("mot", 1, 5).alias("repl")))


def stems(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.stem_map(weights.tokens(c.french(spark, sf)))


def lemmas(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.lemma_map(weights.tokens(c.french(spark, sf)))


def map_report(spark: SparkSession, sf: str) -> DataFrame:
    r = lexicon.report(lexicon.distinct_counts(_both(spark, sf)))
    return spark.createDataFrame([(r,)], "report string")


_ROUNDED = f"{c.SCORED}, r as (select doc_id, mot, round(tf_idf, 6) as tf_idf from w)"
_BOTH = f"{c.TOKENS}, m as (select mot, {c.LEMMA} as lemme, substr(mot, 1, 5) as racine from (select distinct mot from tok where regexp_matches(mot, '\\p{{L}}')))"
_WORDS = "regexp_split_to_array({}, '\\s+')"
_NOISE = c._ARTICLES

QUERIES = {
    "tokens_per_doc": (tokens_per_doc, f"with {c.TOKENS} select d.doc_id, count(mot) as n_tokens from documents d left join tok using (doc_id) group by 1"),
    "normalised": (
        normalised,
        "select doc_id, length(translate(text, '!#$%&''()*+,-.:;=?@[\\]^_`{|}~', '')) as markup, length(translate(text, '.,;:', '')) as light, "
        "len(string_split(translate(text, '.,;:', ''), ' ')) as blanks, length(translate(text, '?.', '')) as query, "
        f"len(list_filter({_WORDS.format('lower(text)')}, lambda x: x <> '' and x not in ({_NOISE}))) as content, "
        "regexp_matches(text, '\\p{L}') as letter, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_full_match(x, '[0-9]+') or contains(x, '/'))) > 0 as number, "
        "length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) as printable, "
        "len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[-.][\\p{L}\\p{N}]+)*[''’]?')) as elided from documents",
    ),
    "title_concat": (title_concat, "select doc_id, length(concat_ws(' ', source, text)) as n from documents"),
    "tf": (tf, f"with {c.TF} select * from tf"),
    "document_frequency": (document_frequency, f"with {c.TF} select mot, count(*) as df from tf group by 1"),
    "idf": (idf, f"with {c.IDF} select mot, round(idft, 6) as idft from idf"),
    "tfidf": (tfidf, f"with {_ROUNDED} select * from r"),
    "tfidf_top": (tfidf_top, f"with {_ROUNDED} select * from r order by tf_idf desc, mot, doc_id limit 100"),
    "tfidf_low_quantile": (tfidf_low, f"with {_ROUNDED} select * from r where tf_idf <= (select quantile_cont(tf_idf, 0.17) from r)"),
    "tfidf_high_quantile": (tfidf_high, f"with {_ROUNDED} select * from r where tf_idf >= (select quantile_cont(tf_idf, 0.95) from r)"),
    "tfidf_clipped": (tfidf_clipped, f"with {_ROUNDED} select doc_id, round(max(least(tf_idf, (select quantile_cont(tf_idf, 0.99) from r))), 6) as most from r group by 1"),
    "mean_weights": (mean_weights, f"with {c.SCORED} select mot, round(avg(tf_idf), 6) as avg_tf_idf from w group by 1"),
    "tfidf_histogram": (tfidf_histogram, f"with {_ROUNDED} select cast(least(floor(tf_idf / 0.5), 19) as int) as bin, count(*) as n from r where tf_idf between 0 and 10 group by 1"),
    "stop_words_tails": (stop_words_tails, f"with {_ROUNDED} select distinct mot from r where tf_idf <= (select quantile_cont(tf_idf, 0.17) from r) or tf_idf >= 15"),
    "stop_words_means": (
        stop_words_means,
        f"with {c.IDF}, i as (select mot, round(idft, 6) as idft from idf), r as (select mot, round(avg(tf * idft), 6) as m from tf join i using (mot) group by 1) "
        "select mot from i where idft < 0.3 union select mot from r where m < (select quantile_cont(m, 0.02) from r)",
    ),
    "stop_filtered": (stop_filtered, f"with {c.TOKENS}, s as (select mot from tok group by 1 order by count(*) desc, mot limit 100) select doc_id, count(*) as n from tok where mot not in (select mot from s) group by 1"),
    "filtered_text": (
        filtered_text,
        f"with {c.TOKENS}, s as (select mot from tok group by 1 order by count(*) desc, mot limit 20), t as (select list(mot) as s from s) "
        f"select doc_id, array_to_string(list_filter(regexp_split_to_array({c._CLEAN}, '\\s+'), lambda x: x <> '' and not list_contains(t.s, x)), ' ') as text from documents, t",
    ),
    "frequent_words": (frequent_words, f"with {c.TOKENS} select mot, count(*) as n from tok group by 1 order by n desc, mot limit 10"),
    "map_counts": (
        map_counts,
        f"with {_BOTH} select count(distinct mot) as n_mot, count(distinct lemme) as n_lemme, count(distinct racine) as n_racine, "
        "round((1 - count(distinct lemme) / count(distinct mot)) * 100, 6) as reduction_lemme, round((1 - count(distinct racine) / count(distinct mot)) * 100, 6) as reduction_racine from m",
    ),
    "map_families": (map_families, f"with {_BOTH} select racine, count(*) as n_forms, array_to_string(list_sort(list(mot))[1:5], ',') as forms from m group by 1 order by 2 desc, 1 limit 10"),
    "map_pairs": (map_pairs, f"with {_BOTH} select lemme, racine, count(*) as n from m group by 1, 2"),
    "map_lengths": (
        map_lengths,
        f"with {_BOTH} select round(avg(length(mot)), 6) as len_mot, round(avg(length(lemme)), 6) as len_lemme, round(avg(length(racine)), 6) as len_racine, "
        "round(avg(length(mot) - length(lemme)), 6) as cut_lemme, round(avg(length(mot) - length(racine)), 6) as cut_racine from m",
    ),
    "map_different": (map_different, f"with {_BOTH} select * from m where lemme <> racine"),
    "verb_lemmas": (verb_lemmas, f"with {_BOTH} select mot, lemme from m where lemme <> racine and regexp_matches(lemme, '(er|ir|oir|re)$')"),
    "verb_sample": (verb_sample, f"with {_BOTH} select mot, lemme from m where lemme <> racine and regexp_matches(lemme, '(er|ir|oir|re)$') order by md5(mot), mot limit 15"),
    "word_sample": (word_sample, f"with {_BOTH} select mot from m order by md5(mot), mot limit 15"),
    "lemma_frequencies": (lemma_frequencies, f"with {c.TOKENS} select {c.LEMMA} as lemme, count(*) as freq from tok where regexp_matches(mot, '\\p{{L}}') group by 1"),
    "lemmatised": (
        lemmatised,
        "select p_partkey as doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> ''), lambda x: substr(x, 1, 3) || '-'), ' ') as text from part",
    ),
    "substituted": (
        substituted,
        f"select doc_id, array_to_string(list_transform(list_filter({_WORDS.format('lower(text)')}, lambda x: x <> ''), lambda x: case when length(x) > 5 then substr(x, 1, 5) else x end), ' ') as text from documents",
    ),
    "stems": (stems, None),
    "lemmas": (lemmas, f"with {c.TOKENS} select mot, {c.LEMMA} as lemme from (select distinct mot from tok where lang = 'fr' and regexp_matches(mot, '\\p{{L}}'))"),
    "map_stems": (map_stems, None),
    "map_report": (
        map_report,
        f"with {_BOTH}, k as (select count(distinct mot) as w, count(distinct lemme) as l, count(distinct racine) as r from m) select '# Lemmas and stems' || chr(10) || chr(10) || '| | distinct | reduction (%) |' || chr(10) || "
        "'| - | - | - |' || chr(10) || '| words | ' || w || ' | |' || chr(10) || '| lemmas | ' || l || ' | ' || printf('%.2f', (1 - l / w) * 100) || ' |' || chr(10) || "
        "'| stems | ' || r || ' | ' || printf('%.2f', (1 - r / w) * 100) || ' |' || chr(10) || chr(10) || case when r < l then 'stemming' else 'lemmatisation' end || ' reduces the vocabulary more.' || chr(10) as report from k",
    ),
}
