"""Word maps (lemmas, stems), their statistics, substitution and spelling correction.

A map has mot, repl and ord; of several rows for a word the one of least ord
counts. Rules that run in Python are applied to distinct words only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glanage.functions import stem as rules
from glanage.functions import text

#: Letters that an edit may insert or put in place of another, as fixed values.
LETTERS = "abcdefghijklmnopqrstuvwxyzéàèùâêîôûçëïüœæ"


def distinct_words(tokens: DataFrame, column: str = "mot") -> DataFrame:
    return tokens.select(F.col(column).alias("mot")).where(text.has_letter(F.col(column))).distinct()


def lemma_map(tokens: DataFrame) -> DataFrame:
    """(mot, lemme) of every word with a letter, by rules; ``lemmas_by`` takes a full lexicon first."""
    return distinct_words(tokens).select("mot", rules.lemma_of(F.col("mot")).alias("lemme"))


def lemmas_by(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(mot, lemme) of every word with a letter: the first lemma that the lexicon (mot, lemme, ord) has for it, else the one by rules."""
    known = lexicon.groupBy("mot").agg(F.min_by("lemme", "ord").alias("own"))
    return distinct_words(tokens).join(known, "mot", "left").select("mot", F.coalesce("own", rules.lemma_of(F.col("mot"))).alias("lemme"))


def joined_maps(lemmas: DataFrame, stems: DataFrame) -> DataFrame:
    """(mot, lemme, racine) of the words that both maps have."""
    return lemmas.select("mot", "lemme").join(stems.select("mot", "racine"), "mot")


def verb_sample(both: DataFrame, n: int = 15) -> DataFrame:
    """A sample of the words whose lemma looks like a verb's and differs from their stem."""
    return sample_of(verbs(different(both)), "mot", n)


def stem_map(tokens: DataFrame) -> DataFrame:
    """(mot, racine) of every word with a letter."""
    return distinct_words(tokens).select("mot", rules.stem_udf(F.col("mot")).alias("racine"))


def first_of(mapping: DataFrame) -> DataFrame:
    """One row per word: the replacement that came first."""
    return mapping.groupBy("mot").agg(F.min_by("repl", "ord").alias("repl"))


def last_of(mapping: DataFrame) -> DataFrame:
    """One row per word: the replacement that came last."""
    return mapping.groupBy("mot").agg(F.max_by("repl", "ord").alias("repl"))


def substitute(docs: DataFrame, mapping: DataFrame, column: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text): words with a replacement replaced, in their order; a null replacement deletes the word."""
    placed = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(text.words(F.lower(column))).alias("pos", "mot"))
    known = mapping.select("mot", "repl", F.lit(True).alias("known"))
    put = placed.join(known, "mot", "left").withColumn("w", F.when(F.col("known"), F.col("repl")).otherwise(F.col("mot")))
    built = put.where("w is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("a"))
    whole = docs.select(F.col(doc_id).alias("doc_id")).join(built, "doc_id", "left")
    return whole.select("doc_id", F.coalesce(F.array_join("a.w", " "), F.lit("")).alias("text"))


# --- statistics --------------------------------------------------------------------------------------------------


def distinct_counts(both: DataFrame) -> DataFrame:
    """Distinct words, lemmas and stems, and how much the two maps reduce them, in percent; both has mot, lemme, racine."""
    c = both.agg(*(F.count_distinct(x).alias(f"n_{x}") for x in ("mot", "lemme", "racine")))
    rate = lambda x: (1 - F.col(f"n_{x}") / F.col("n_mot")) * 100
    return c.select("n_mot", "n_lemme", "n_racine", rate("lemme").alias("reduction_lemme"), rate("racine").alias("reduction_racine"))


def frequencies(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values; the value breaks ties."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def families(mapping: DataFrame, form: str = "mot", base: str = "lemme", n: int = 10, shown: int = 5) -> DataFrame:
    """The n bases of most forms, with their first forms."""
    sizes = mapping.groupBy(base).agg(F.count_distinct(form).alias("n_forms")).orderBy(F.desc("n_forms"), base).limit(n)
    few = mapping.join(F.broadcast(sizes), base).select(base, "n_forms", form).distinct()  # n rows at most
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy(base).orderBy(form))).where(F.col("r") <= shown)
    return ranked.groupBy(base, "n_forms").agg(F.array_sort(F.collect_list(form)).alias("forms"))


def pair_counts(both: DataFrame) -> DataFrame:
    return both.groupBy("lemme", "racine").agg(F.count("*").alias("n"))


def lengths(both: DataFrame) -> DataFrame:
    """Mean lengths of words, lemmas and stems, and the mean reduction by each."""
    mean = lambda x: F.avg(F.length(x))
    return both.agg(
        mean("mot").alias("len_mot"),
        mean("lemme").alias("len_lemme"),
        mean("racine").alias("len_racine"),
        F.avg(F.length("mot") - F.length("lemme")).alias("cut_lemme"),
        F.avg(F.length("mot") - F.length("racine")).alias("cut_racine"),
    )


def different(both: DataFrame) -> DataFrame:
    return both.na.drop().where(F.col("lemme") != F.col("racine"))


def verbs(both: DataFrame, column: str = "lemme") -> DataFrame:
    return both.where(F.col(column).rlike("(er|ir|oir|re)$"))


def sample_of(df: DataFrame, column: str, n: int) -> DataFrame:
    """A sample that is the same each time: the rows of least hash."""
    return df.orderBy(F.md5(F.col(column).cast("binary")), column).limit(n)


def report(counts: DataFrame) -> str:
    """A comparison of the two maps as Markdown, from the one row of distinct_counts."""
    r = counts.first()
    better = "stemming" if r["n_racine"] < r["n_lemme"] else "lemmatisation"
    lines = ["# Lemmas and stems", "", "| | distinct | reduction (%) |", "| - | - | - |", f"| words | {r['n_mot']} | |"]
    lines += [f"| {name} | {r[f'n_{c}']} | {r[f'reduction_{c}']:.2f} |" for name, c in (("lemmas", "lemme"), ("stems", "racine"))]
    return "\n".join([*lines, "", f"{better} reduces the vocabulary more.", ""])


# --- spelling ----------------------------------------------------------------------------------------------------


def candidates(words: DataFrame, lexicon: DataFrame, least_score: float = 0.0) -> DataFrame:
    """(w, mot, ord, score, dist): forms that begin like the word.

    Only such forms have a score, and words of under three letters have none: so
    many first letters as the least score asks for of three, one at least, are
    the join key.
    """
    shared = max(1, min(3, math.ceil(least_score * 3 / 100 - 1e-9)))
    a = words.select(F.col("mot").alias("w"), F.substring("mot", 1, shared).alias("c")).distinct()
    b = lexicon.select("mot", "ord", F.substring("mot", 1, shared).alias("c"))
    near = F.abs(F.length("w") - F.length("mot")) <= 4
    met = a.join(b, "c").where(near).withColumn("score", text.prefix_score(F.col("w"), F.col("mot")))
    met = met.where((F.col("score") > 0) & (F.col("score") >= least_score))
    return met.select("w", "mot", "ord", "score", F.levenshtein("w", "mot").alias("dist"))


def nearest(found: DataFrame) -> DataFrame:
    """(w, mot, dist): the candidate of least distance, the first in the lexicon at a tie."""
    return found.groupBy("w").agg(F.min_by("mot", F.struct("dist", "ord")).alias("mot"), F.min("dist").alias("dist"))


def correct(words: DataFrame, lexicon: DataFrame, keep: tuple[str, ...] = ("travaux",)) -> DataFrame:
    """(mot, corrected, method): a known form gives its first lemma, another one that of the nearest form, else the word stays.

    ``lexicon`` has mot, lemme and ord. Blank words are dropped; lemmas in
    ``keep`` are not used, the word stays instead.
    """
    w = words.select(F.lower(F.trim("mot")).alias("mot")).where(F.col("mot").rlike(r"\S")).distinct()
    first = lexicon.groupBy("mot").agg(F.min_by("lemme", "ord").alias("lemme"), F.min("ord").alias("ord"))
    exact = w.join(first.select("mot", F.col("lemme").alias("exact")), "mot", "left")
    open_ = exact.where("exact is null").select("mot")
    near = nearest(candidates(open_, first)).join(first.select("mot", "lemme"), "mot").select(F.col("w").alias("mot"), F.col("lemme").alias("near"))
    out = exact.join(near, "mot", "left")
    found = F.coalesce("exact", "near")
    return out.select(
        "mot",
        F.when(found.isNull() | found.isin(*keep), F.col("mot")).otherwise(found).alias("corrected"),
        F.when(F.col("exact").isNotNull(), "form").when(F.col("near").isNotNull(), "nearest").otherwise("kept").alias("method"),
    )


def edits1(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(w, lemme, freq): known lemmas one deletion, swap, replacement or insertion away.

    Words one edit apart are equal after at most one deletion on either side,
    so each word and lemma is joined by itself and all that one deletion makes
    of it: as many rows as letters, on keys that few words share.
    """
    shorter = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    keys = lambda c: F.explode(F.when(F.length(c) > 0, F.array_distinct(F.concat(F.array(c), shorter(F.col(c))))).otherwise(F.array(c)))
    a = words.select(F.col("mot").alias("w")).distinct().select("w", keys("w").alias("k"))
    b = lemmas.select("lemme", "freq").distinct().select("lemme", "freq", keys("lemme").alias("k"))
    pairs = a.join(b, "k").drop("k").distinct()
    return pairs.where(_one_edit(F.col("w"), F.col("lemme")))


def _one_edit(w: Column, lemme: Column) -> Column:
    """One edit turns w into lemme, new letters being of the alphabet."""
    p = text.common_prefix(w, lemme)
    d = F.length(lemme) - F.length(w)
    rest = lambda c, skip: F.substring(c, p + 1 + skip, F.lit(1 << 30))
    new = F.contains(F.lit(LETTERS), F.substring(lemme, p + 1, F.lit(1)))
    swapped = F.concat(F.substring(w, p + 2, F.lit(1)), F.substring(w, p + 1, F.lit(1)), rest(w, 2))
    replaced = (d == 0) & (w != lemme) & (((rest(w, 1) == rest(lemme, 1)) & new) | (swapped == rest(lemme, 0)))
    return replaced | ((d == 1) & (rest(w, 0) == rest(lemme, 1)) & new) | ((d == -1) & (rest(w, 1) == rest(lemme, 0)))


def cascade(words: DataFrame, lexicon: DataFrame, lemmas: DataFrame, least_score: float = 60.0, most: int = 10, most_dist: int = 2) -> DataFrame:
    """(mot, corrected, method): known lemma, lemma of a known form, lemma one edit away (most frequent), or lemma of the nearest of the
    forms likeliest by prefix; else null.

    ``lexicon`` has mot, lemme and ord; ``lemmas`` has lemme, freq and ord.
    """
    w = words.select(text.bare_word(F.col("mot")).alias("mot")).where("mot <> ''").distinct()
    forms = lexicon.groupBy("mot").agg(F.min_by("lemme", "ord").alias("form"))
    known = w.join(lemmas.select(F.col("lemme").alias("mot"), F.col("lemme").alias("own")), "mot", "left").join(forms, "mot", "left")
    open_ = known.where("own is null and form is null").select("mot")
    one = edits1(open_, lemmas).groupBy(F.col("w").alias("mot")).agg(F.min_by("lemme", F.struct(-F.col("freq"), "lemme")).alias("edit"))
    left = open_.join(one.select("mot"), "mot", "left_anti")
    first = lexicon.groupBy("mot").agg(F.min_by("lemme", "ord").alias("lemme"), F.min("ord").alias("ord"))
    near = candidates(left, first.select("mot", "ord"), least_score)
    order = Window.partitionBy("w").orderBy(F.desc("score"), "ord")
    near = near.withColumn("r", F.row_number().over(order)).where((F.col("r") <= most) & (F.col("dist") <= most_dist))
    best = near.groupBy("w").agg(F.min_by("mot", F.struct("dist", -F.col("score"), "ord")).alias("mot"))
    prefix = best.join(first, "mot").select(F.col("w").alias("mot"), F.col("lemme").alias("prefix"))
    out = known.join(one, "mot", "left").join(prefix, "mot", "left")
    method = F.when(F.col("own").isNotNull(), "lemma").when(F.col("form").isNotNull(), "form").when(F.col("edit").isNotNull(), "edit").when(F.col("prefix").isNotNull(), "prefix")
    return out.select("mot", F.coalesce("own", "form", "edit", "prefix").alias("corrected"), method.otherwise("none").alias("method"))


def correct_sentences(sentences: DataFrame, lexicon: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(sentence_id, pos, mot, corrected, method) of every word of the sentences (sentence_id, sentence)."""
    placed = sentences.select("sentence_id", F.posexplode(text.elided_words(F.col("sentence"))).alias("pos", "raw")).withColumn("mot", text.bare_word(F.col("raw")))
    return placed.join(cascade(placed, lexicon, lemmas), "mot").select("sentence_id", "pos", "mot", "corrected", "method")


def lemmatise_sentences(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, text): every word replaced by its first lemma, word by word."""
    mapping = lexicon.groupBy("mot").agg(F.min_by("lemme", "ord").alias("repl"))
    return substitute(sentences.select(F.col("sentence_id").alias("doc_id"), F.col("sentence").alias("text")), mapping)


def lexicon_of(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lexicon, lemmas) of a corpus: forms with their lemma, and lemma frequencies over all occurrences."""
    lemmas = lemma_map(tokens)
    counts = tokens.groupBy("mot").agg(F.count("*").alias("n"))
    lexicon = lemmas.select("mot", "lemme", F.xxhash64("mot").alias("ord"))
    freq = counts.join(lemmas, "mot").groupBy("lemme").agg(F.sum("n").alias("freq"))
    return lexicon, freq.select("lemme", "freq", F.xxhash64("lemme").alias("ord"))
