"""Language ID by Bayesian fusion of four kinds of evidence.

text     naive Bayes over hashed character trigrams and bigrams of the visible
         text, tempered so that a long text counts as ``evidence`` n-grams
markup   the language declared in the page's markup, as a noisy witness
suffix   the country suffix of the address or a language code in its path,
         as another noisy witness
host     what the other pages of the host speak, smoothed towards those of its
         domain, which are smoothed towards all pages

How far to trust each witness is estimated by grouped aggregation of the text
posteriors over all pages, with a weak prior that declarations tell the truth;
the host counts are sums of the fused posteriors per host and per domain, and a
page's own share is taken out of its host's before it is used. Witness tables
have a row per known language at most and are collected; host counts are
summed before they are shuffled and joined back by host.

The text model is fitted on a bounded sample of labelled documents
(``rows_per_lang`` of each language, lowest hash first; of a language that has
only long documents some of the shortest); everything else covers all pages.
Every label that occurs is a language; more than ``languages`` are an error.

Cases: a null or empty html, or one without letters, is decided by the other
evidence; a null or odd url has an empty host, shared with all such pages;
undeclared and unknown languages are witnesses of their own kind; repeated rows
each get a result; at a tie the language that sorts first wins; without labelled
documents the language is null; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glanage.llm.common import mapped, pick, place, saved


@dataclass(frozen=True)
class LanguageParams:
    buckets: int = 1 << 15
    #: Bound of the training sample.
    rows_per_lang: int = 400
    #: More labels than this are no languages: an error, not a cut.
    languages: int = 500
    #: Labelled documents with more characters are not sampled (bounds the driver's memory) ...
    train_chars: int = 20_000
    #: ... unless a language has no others: then so many of its shortest are.
    rows_if_long: int = 20
    smoothing: float = 0.2
    #: N-grams that a text counts as, at most: neighbours are far from independent.
    evidence: float = 60.0
    #: Pseudo-counts: of a truthful witness, of the domain in a host's prior, of all pages in a domain's.
    witness: float = 5.0
    host: float = 5.0
    domain: float = 20.0
    seed: int = 5


#: Country suffixes and the language most written there, as fixed values.
SUFFIXES = {"fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv"}
_HIDDEN = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b""")
_CODE = re.compile(r"^[a-z]{2}$")


def visible(page: str | None) -> str:
    return markup.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def grams(text: str, buckets: int) -> np.ndarray:
    """Hashed character bigrams and trigrams; what is no letter separates words."""
    flat = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two = c[:-1] * np.uint64(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint64(0x85EBCA6B) + c[2:]
    h = np.concatenate([two, three]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int64) % buckets


def address(url: str | None) -> tuple[str, str, str | None]:
    """Host, domain (its last two labels), and the language that suffix or path name."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
    except ValueError:
        return "", "", None
    labels = host.split(".")
    path = next((p for p in parts.path.lower().split("/") if p), "")
    return host, ".".join(labels[-2:]), SUFFIXES.get(labels[-1]) or (path if _CODE.match(path) else None)


def fit_text(docs: DataFrame, params: LanguageParams) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each bucket under each."""
    rows = pick(docs, id="doc_id", text="text", lang="lang").where("lang is not null and id is not null")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = size <= params.train_chars
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("count")).limit(params.languages + 1).collect()
    if len(counts) > params.languages:
        raise ValueError(f"documents have more than {params.languages} languages")
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return [], np.zeros((0, params.buckets), np.float32)
    placed = rows.where(short).select("id", "lang", place(params.seed, "id").alias("o"))
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], 2 * params.rows_per_lang / max(1, r["count"]))))
    early = placed.where(F.col("o") < F.element_at(share, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("o", "id")
    chosen = early.withColumn("r", F.row_number().over(order)).where(F.col("r") <= params.rows_per_lang).select("id")
    wordy = [r["lang"] for r in counts if not r["count"]]
    if wordy:
        order = Window.partitionBy("lang").orderBy("o", "id")
        shortest = rows.where(F.col("lang").isin(wordy)).select("id", "lang", size.alias("o"))
        chosen = chosen.unionByName(shortest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= params.rows_if_long).select("id"))
    chosen = chosen.distinct()
    # languages x rows_per_lang ids, each with its least row: bounded
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("v")).select("v.*").toPandas()
    table = np.full((len(langs), params.buckets), params.smoothing)
    for lang, text in zip(sample["lang"], sample["text"], strict=True):
        if lang in langs:
            np.add.at(table[langs.index(lang)], grams(text or "", params.buckets), 1)
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def text_evidence(text: str, table: np.ndarray, params: LanguageParams) -> np.ndarray:
    """Tempered log-likelihood of each language, the largest being 0."""
    g = grams(text, table.shape[1])
    if not len(g) or not len(table):
        return np.zeros(len(table))
    ll = table[:, g].sum(1, dtype=np.float64) * min(1.0, params.evidence / len(g))
    return ll - ll.max()


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(p: str, n: int) -> Column:
    return F.array(*(F.sum(F.element_at(p, i + 1)) for i in range(n)))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _witness(counts: dict[str, list[float]], langs: list[str], params: LanguageParams) -> Column:
    """Map from a witness's word to log P(word | language), for each language."""
    words = sorted({*langs, "none", "other"})
    total = np.array([np.asarray(counts.get(w, [0.0] * len(langs))) for w in words])
    share = (total.sum(1) + 1) / (total.sum() + len(words))  # how often the word is said at all
    prior = np.array([[0.5 * share[i] + 0.5 * (w == lang) for lang in langs] for i, w in enumerate(words)])
    prior /= prior.sum(0, keepdims=True)
    p = (total + params.witness * prior) / (total.sum(0, keepdims=True) + params.witness)
    return F.create_map(*(x for i, w in enumerate(words) for x in (F.lit(w), F.array(*(F.lit(float(v)) for v in np.log(p[i]))))))


def identify(pages: DataFrame, docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """page_id, lang, confidence, and what the evidence was, for each row of ``pages`` (page_id, url, html)."""
    langs, table = fit_text(docs, params)
    n = len(langs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, url, page in zip(b["page_id"], b["url"], b["html"], strict=True):
                found = _DECLARED.search(page or "")
                said = found[1].lower()[:2] if found else None
                host, domain, suffix = address(url)
                word = lambda x: "none" if x is None else x if x in langs else "other"
                rows.append((key, host, domain, word(said), word(suffix), text_evidence(visible(page), table, params)))
            yield pd.DataFrame(rows, columns=["page_id", "host", "domain", "declared", "suffix", "ll"]).astype({"page_id": "Int64"})

    columns = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], pages["html"])
    seen = mapped(columns, run, "page_id long, host string, domain string, declared string, suffix string, ll array<double>")
    if not n:
        return seen.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")
    seen = saved(seen.withColumn("p", _softmax(F.col("ll"))), "pages")

    def said(column: str) -> dict[str, list[float]]:
        return {r[0]: r[1] for r in seen.groupBy(column).agg(_sums("p", n)).collect()}

    # The model with three kinds of evidence, and from it the host counts.
    markup_table, suffix_table = _witness(said("declared"), langs, params), _witness(said("suffix"), langs, params)
    fused = seen.withColumn("e", _plus(_plus(F.col("ll"), F.element_at(markup_table, F.col("declared"))), F.element_at(suffix_table, F.col("suffix"))))
    fused = fused.withColumn("p", _softmax(F.col("e")))
    hosts = fused.groupBy("host", "domain").agg(_sums("p", n).alias("h"), F.count("*").alias("n_h"))
    domains = hosts.groupBy("domain").agg(_sums("h", n).alias("d"), F.sum("n_h").alias("n_d"))
    total = domains.agg(_sums("d", n).alias("a"), F.sum("n_d").alias("n_a")).first()
    everywhere = F.array(*(F.lit((x + 1) / ((total["n_a"] or 0) + n)) for x in (total["a"] if total["n_a"] else [0.0] * n)))
    domains = domains.select("domain", F.zip_with("d", everywhere, lambda c, q: (c + params.domain * q) / (F.col("n_d") + params.domain)).alias("q"))
    # Kept apart, so that Spark can split the rows of a large host in the join.
    hosts = saved(hosts.join(domains, "domain").select("host", "domain", "h", "n_h", "q"), "hosts")
    joined = fused.join(hosts, ["host", "domain"])
    others = F.zip_with("h", "p", lambda c, own: F.greatest(c - own, F.lit(0.0)))
    prior = F.zip_with(others, "q", lambda c, q: F.log((c + params.host * q) / (F.col("n_h") - 1 + params.host)))
    post = _softmax(_plus(F.col("e"), prior))
    names = F.array(*(F.lit(x) for x in langs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return joined.withColumn("post", post).select("page_id", best(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"), best(F.col("ll")).alias("text_lang"), "declared", "suffix", "host")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
