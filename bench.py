"""Times the headline queries and prints one line of JSON.

The baseline is the mean response time of ten questions over stored indexes;
``value`` is that mean here: each question is parsed, its postings are looked
up in the stored index, and the answer is collected. Index builds and corpus
statistics are timed beside it.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glanage.functions import text
from glanage.operators import index, search
from glanage.queries import registry

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))

#: The ten questions of the baseline, in words of the tables.
QUESTIONS = {
    "q1": "Je veux les articles de la rubrique src3 parlant d'innovation ou de that.",
    "q2": "Je souhaite les rubriques des articles parlant de moron ou de idiot.",
    "q3": "Quels sont les articles sur that with ?",
    "q4": "Je voudrais les articles qui parlent de scum ou du projet clown.",
    "q5": "Je cherche les recherches sur worthless.",
    "q6": "Article traitant des nosuch game et de la nosuch virtuelle.",
    "q7": "Je voudrais tous les bulletins écrits entre 1996 et 1997 mais pas au mois de juin.",
    "q8": "Quels sont les articles dont le titre contient le terme 'that' et le mot 'with'?",
    "q9": "je voudrais les articles dont le titre contient le mot from.",
    "q10": "je veux voir les articles de la rubrique src3 et publiés entre 30/08/1996 et 29/09/1998.",
}
STATISTICS = ("tf", "idf", "tfidf_high_quantile", "stop_words_means", "bool_expression", "precision_recall_f1", "edits1", "page_bulletins")


def best(run, repeats: int) -> float:
    times = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return statistics.median(times)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as folder:
        read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
        dates = read("orders").select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("date"))
        source = read("documents").select("doc_id", "text", F.col("source").alias("rubrique"))
        title = F.array_join(F.slice(text.words(F.col("text")), 1, 12), " ")
        began = time.perf_counter()
        rows = index.word_index(source, "texte", F.col("text")).unionByName(index.word_index(source, "titre", title))
        postings = index.write_postings(rows, f"{folder}/postings", int(CPUS))
        source.join(dates, "doc_id", "left").select("doc_id", "date", "rubrique", F.lit(False).alias("has_image")).write.parquet(f"{folder}/docs")
        took = {"index_build": time.perf_counter() - began}
        engine = search.SearchEngine(spark.read.parquet(f"{folder}/docs"), postings)
        ask = lambda q: engine.search(q).collect()
        for q in QUESTIONS.values():
            ask(q)
        for name, q in QUESTIONS.items():
            took[name] = best(lambda q=q: ask(q), REPEATS)
        run = lambda df: df.write.format("noop").mode("overwrite").save()
        every: dict[str, object] = registry.queries()
        for name in STATISTICS:
            q = every[name]
            took[name] = best(lambda q=q: run(q(spark, SF)), 2)
    mean = statistics.mean(took[q] for q in QUESTIONS)
    print(json.dumps({"metric": "mean response time of ten questions", "value": round(mean, 4), "unit": "sec", "queries": {k: round(v, 4) for k, v in took.items()}, "sf": SF, "baseline": 0.1773}))
    spark.stop()


if __name__ == "__main__":
    main()
