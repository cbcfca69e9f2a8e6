"""Toxicity: a convolutional text classifier over hashed word embeddings.

Every word is embedded as the sum of rows of one hashed table: two hashes of
the word (so that one colliding bucket is not enough to mistake it) and hashes
of its first three, four and five letters (so that inflected forms share
evidence). Filters of several widths slide over the whole text, their maximum
over time is pooled, and a logistic unit gives the score. Training is numpy, over
every labelled row and the whole of its text; only the positions that won the
pooling carry gradient, so a step costs little more than its forward pass.

Labelled rows fall by a hash into a share that trains and one that calibrates
thresholds. The embedding starts from word counts over all training rows. These
are split by a hash of their id into shards that bound a task's memory; each
shard trains a copy of the start on its rows, and the copies' moves are
averaged: dense weights over all shards, a row of the table over the shards that
moved it. Counts and moves are summed as whole numbers, so neither the order of
tasks nor their number matters. Thresholds come from the counts of all
calibration rows by score in steps of 0.001.

Cases: a null text counts as empty; an empty text (or one without letters) is
scored from padding alone, like any other row; rows repeated in the input are
scored again and give equal scores; a table without any labelled row gives an
untrained model that scores every row with the prior, and an empty table gives
an empty result. A doc_id labelled both toxic and not teaches nothing; one with
several texts is learnt from the least of them; long texts teach whole. Ties: a
score equal to the threshold is flagged, and of thresholds with equal F1 the one
next to 0.5 is taken. Extra columns are ignored.
"""

from __future__ import annotations

import copy
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.llm.common import chunks, forget, held_out, mapped, pick, saved

LETTERS = re.compile(r"[^\W\d_]+")
#: Hash rows per word: two of the word, one of each prefix length.
PREFIXES = (3, 4, 5)
PARTS = 2 + len(PREFIXES)


@dataclass(frozen=True)
class ToxicityParams:
    buckets: int = 1 << 18
    dim: int = 6
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    batch: int = 64
    rate: float = 0.08
    #: Rows and characters of a shard, about: they bound a task's memory, and every row is in a shard.
    shard_rows: int = 5000
    shard_chars: int = 32_000_000
    #: Share of the labelled rows that trains nothing and calibrates the thresholds.
    calibration: float = 0.25
    seed: int = 17


class _WordRows(dict):
    """Word -> its rows of the table as packed integers; remembers a bounded number of words."""

    def __init__(self, buckets: int, most: int = 150_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        rows = (zlib.crc32(raw) % self.buckets, zlib.adler32(raw[::-1], zlib.crc32(raw, 77)) * 2654435761 % self.buckets)
        rows += tuple(zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) % self.buckets for n in PREFIXES)
        rows = struct.pack(f"={PARTS}i", *rows)
        if len(self) < self.most:
            self[word] = rows
        return rows


def word_rows(texts: list[str | None], known: _WordRows) -> list[np.ndarray]:
    """For each text an array (words, PARTS) of table rows."""
    out = []
    for text in texts:
        words = LETTERS.findall((text or "").lower())
        out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32).reshape(len(words), PARTS))
    return out


@dataclass
class ToxicityModel:
    params: ToxicityParams
    table: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    shift: float
    #: Score from which a document of that language is flagged; "" is for all others.
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.5})

    def dense(self) -> list[np.ndarray]:
        """All weights but the table's."""
        return [*self.kernels, *self.biases, self.out]

    def pooled(self, docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Max-pooled filter answers, all answers by width, the padded rows, and each text's bounds in turn.

        A text's last window begins right behind its last word, so no window
        reaches into the next text.
        """
        pad = max(self.params.widths)
        sizes = [len(d) + pad for d in docs]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        rows = np.full((sum(sizes) + pad, PARTS), self.params.buckets, dtype=np.int32)
        for at, d in zip(starts, docs, strict=True):
            rows[at : at + len(d)] = d
        x = self.table[rows[:, 0]]
        for part in range(1, PARTS):
            x = x + self.table[rows[:, part]]
        bounds = np.stack([starts, starts + np.array([len(d) + 1 for d in docs])], axis=1).ravel()
        tops, at = [], []
        for width, kernel, bias in zip(self.params.widths, self.kernels, self.biases, strict=True):
            n = len(x) - pad
            answer = sum(x[j : j + n] @ kernel[j] for j in range(width)) + bias
            top = np.maximum.reduceat(answer, bounds, axis=0)[::2]
            tops.append(top)
            at.append(answer)
        return np.concatenate(tops, axis=1), at, rows, bounds

    def scores(self, docs: list[np.ndarray], most: int = 60_000) -> np.ndarray:
        out = np.zeros(len(docs))
        for part in chunks([len(d) for d in docs], most):
            top = np.maximum(self.pooled(docs[part])[0], 0)
            out[part] = top @ self.out[:-1] + self.out[-1] + self.shift
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def start(counts: np.ndarray, sizes: np.ndarray, params: ToxicityParams) -> ToxicityModel:
    """An untrained model whose embedding's first axis holds each bucket's log-odds.

    ``counts`` has the texts of each class that hold a bucket, ``sizes`` all texts of each class.
    """
    rng = np.random.default_rng(params.seed)
    table = rng.normal(0, 0.02, (params.buckets + 1, params.dim)).astype(np.float32)
    total = np.maximum(1, sizes)[:, None]
    odds = np.log((counts[1] + 0.3) / (total[1] + 0.6)) - np.log((counts[0] + 0.3) / (total[0] + 0.6))
    table[:, 0] = np.where(counts.sum(0) > 1, odds * np.minimum(1, counts.sum(0) / 8), 0) / PARTS
    table[-1] = 0
    kernels = [rng.normal(0, 0.3, (w, params.dim, params.filters)).astype(np.float32) for w in params.widths]
    for k in kernels:
        k[0, 0] = np.abs(k[0, 0]) + 0.3
    biases = [np.full(params.filters, -0.3, np.float32) for _ in params.widths]
    out = np.concatenate([np.full(params.filters * len(params.widths), 0.15), [-1.0]])
    if not sizes.sum():
        out[:] = 0
    return ToxicityModel(params, table, kernels, biases, out, 0.0)


def train(model: ToxicityModel, docs: list[np.ndarray], toxic: np.ndarray, sizes: np.ndarray, stream: int = 0) -> None:
    """Fit ``model`` to these texts by Adagrad; classes weigh as their ``sizes`` in the whole table say."""
    params, table, kernels, biases, out = model.params, model.table, model.kernels, model.biases, model.out
    rng = np.random.default_rng([params.seed, stream])
    sums = [np.full_like(a, 1e-3) for a in (table, *model.dense())]
    weight = sizes.sum() / 2 / np.maximum(1, sizes)

    def step(k: int, value: np.ndarray, grad: np.ndarray, where: np.ndarray | slice = slice(None)) -> None:
        sums[k][where] += grad**2
        value[where] -= params.rate * grad / np.sqrt(sums[k][where])

    def forward(batch: list[np.ndarray], most: int = 60_000) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled answers, and for each width the table rows (docs, filters, width, PARTS) that won; a bounded number of words at a time."""
        tops, wins = [], []
        for part in chunks([len(d) for d in batch], most):
            top, answers, rows, bounds = model.pooled(batch[part])
            tops.append(top)
            won = [np.array([s + a[s:e].argmax(0) for s, e in bounds.reshape(-1, 2)]) for a in answers]
            wins.append([rows[at[:, :, None] + np.arange(width)] for width, at in zip(params.widths, won, strict=True)])
        return np.concatenate(tops), [np.concatenate(x) for x in zip(*wins, strict=True)]

    n_kernels = len(kernels)
    for _ in range(params.epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), params.batch):
            ids = order[at : at + params.batch]
            top, wins = forward([docs[i] for i in ids])
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ out[:-1] + out[-1], -30, 30)))
            error = (p - toxic[ids]) * weight[toxic[ids]] / len(ids)
            g_hidden = np.outer(error, out[:-1]) * (top > 0)
            touched, g_rows, g_kernels, g_biases = [], [], [], []
            for w, (width, won) in enumerate(zip(params.widths, wins, strict=True)):
                g = g_hidden[:, w * params.filters : (w + 1) * params.filters]
                g_k = np.zeros_like(kernels[w])
                for j in range(width):
                    r = won[:, :, j]
                    x = table[r].sum(2)
                    g_k[j] = np.einsum("dfe,df->ef", x, g)
                    g_x = g[:, :, None] * kernels[w][j].T[None]
                    keep = np.abs(g) > 0
                    touched.append(r[keep].ravel())
                    g_rows.append(np.repeat(g_x[keep], PARTS, axis=0))
                g_kernels.append(g_k)
                g_biases.append(g.sum(0))
            touched_all = np.concatenate(touched)
            if len(touched_all):
                unique, back = np.unique(touched_all, return_inverse=True)
                g_table = np.zeros((len(unique), params.dim), np.float32)
                np.add.at(g_table, back, np.concatenate(g_rows))
                real = unique < params.buckets
                step(0, table, g_table[real], unique[real])
            for w in range(n_kernels):
                step(1 + w, kernels[w], g_kernels[w])
                step(1 + n_kernels + w, biases[w], g_biases[w])
            step(1 + 2 * n_kernels, out, np.append(hidden.T @ error, error.sum()) + 1e-5 * np.append(out[:-1], 0))


#: Moves are summed as multiples of 1 / SCALE.
SCALE = 2.0**40


def moves(old: ToxicityModel, new: ToxicityModel) -> pd.DataFrame:
    """What training changed: the table's moved rows, then every dense weight as a row of its own behind the table."""
    dim = old.params.dim
    change = new.table.astype(np.float64) - old.table
    rows = np.flatnonzero(change.any(1))
    dense = np.concatenate([(b.astype(np.float64) - a).ravel() for a, b in zip(old.dense(), new.dense(), strict=True)])
    values = np.zeros((len(rows) + len(dense), dim))
    values[: len(rows)] = change[rows]
    values[len(rows) :, 0] = dense
    values = np.rint(values * SCALE).astype(np.int64)
    own = {"row": np.concatenate([rows, len(old.table) + np.arange(len(dense))])}
    return pd.DataFrame(own | {f"d{j}": values[:, j] for j in range(dim)})


def move(model: ToxicityModel, sums: pd.DataFrame) -> None:
    """Apply summed moves (row, n shards, d0, d1, ...): the mean of the shards that have the row."""
    rows = sums["row"].to_numpy()
    values = sums[[f"d{j}" for j in range(model.params.dim)]].to_numpy(np.float64) / SCALE / sums["n"].to_numpy()[:, None]
    in_table = rows < len(model.table)
    model.table[rows[in_table]] += values[in_table].astype(np.float32)
    flat = np.zeros(sum(a.size for a in model.dense()))
    flat[rows[~in_table] - len(model.table)] = values[~in_table, 0]
    at = 0
    for a in model.dense():
        a += flat[at : at + a.size].reshape(a.shape).astype(a.dtype)
        at += a.size


#: Thresholds that calibration chooses from.
CUTS = np.arange(200, 801) / 1000


def reached(scores: np.ndarray) -> np.ndarray:
    """How many of the cuts each score reaches."""
    return np.searchsorted(CUTS, scores, side="right")


def thresholds(counts: pd.DataFrame, least: int = 40, pull: float = 10.0) -> dict[str, float]:
    """A threshold for each language from counts (lang, toxic, cuts reached, n): best F1, pulled to the one for all."""

    def best(own: pd.DataFrame) -> float:
        flagged = []
        for y in (0, 1):
            part = own[own["toxic"] == y]
            n = np.bincount(part["reached"], part["n"], len(CUTS) + 1)
            flagged.append(np.cumsum(n[::-1])[::-1])
        f1 = 2 * flagged[1][1:] / np.maximum(1, flagged[1][0] + flagged[0][1:] + flagged[1][1:])
        good = CUTS[f1 >= f1.max() - 1e-9]
        return float(good[np.argmin(np.abs(good - 0.5))])

    bad = counts[counts["toxic"] == 1].groupby("lang")["n"].sum()
    if not bad.sum():
        return {"": 0.5}
    out = {"": best(counts)}
    for lang, n in sorted(bad.items()):
        if lang and n >= least:
            out[lang] = float((n * best(counts[counts["lang"] == lang]) + pull * out[""]) / (n + pull))
    return out


def calibrate(scores: np.ndarray, toxic: np.ndarray, langs: list[str], least: int = 40, pull: float = 10.0) -> dict[str, float]:
    """Thresholds from scored rows."""
    return thresholds(pd.DataFrame({"lang": langs, "toxic": toxic, "reached": reached(scores), "n": 1}), least, pull)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from all labelled rows but the held-out ones.

    ``docs`` has doc_id, text and lang; ``labels`` has doc_id and toxic. The
    language serves only the calibration of thresholds.
    """
    known = pick(labels, id="doc_id", toxic="toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    # What is labelled both ways teaches nothing.
    known = known.groupBy("id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    # Of different texts under one doc_id the least one counts.
    texts = pick(docs, id="doc_id", text="text", lang="lang").join(known, "id")
    texts = texts.groupBy("id").agg(F.min("toxic").alias("toxic"), F.min(F.struct("text", "lang")).alias("v"))
    spare = F.crc32(F.concat(F.lit(f"{params.seed}:"), F.col("id").cast("string")).cast("binary")) % 1000 < params.calibration * 1000
    rows = saved(texts.select("id", "toxic", spare.alias("spare"), "v.*"), "labelled")
    found = rows.groupBy("toxic", "spare").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    sizes = np.array([sum(r["n"] for r in found if r["toxic"] == y and not r["spare"]) for y in (0, 1)])
    chars = sum(r["chars"] or 0 for r in found if not r["spare"])
    shards = int(max(-(-sizes.sum() // params.shard_rows), -(-chars // params.shard_chars)))
    learnt, buckets = rows.where("not spare"), params.buckets

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, counts = _WordRows(buckets), np.zeros((2, buckets + 1), np.int64)
        for b in batches:
            for y, d in zip(b["toxic"], word_rows(b["text"].tolist(), memory), strict=True):
                counts[y, np.unique(d)] += 1
        hit = np.flatnonzero(counts.any(0))
        yield pd.DataFrame({"row": hit, "n0": counts[0, hit], "n1": counts[1, hit]})

    got = mapped(learnt.select("toxic", "text"), tally, "row int, n0 long, n1 long").groupBy("row").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.zeros((2, buckets + 1))
    counts[:, got["row"].to_numpy(np.int64)] = got[["n0", "n1"]].to_numpy(np.float64).T
    model = start(counts, sizes, params)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = _WordRows(buckets)
        shard, own, toxic = None, [], []

        def moved() -> pd.DataFrame:
            new = copy.deepcopy(model)
            train(new, own, np.array(toxic, np.int64), sizes, shard)
            return moves(model, new)

        for b in batches:  # in order of shards
            for s, y, d in zip(b["shard"], b["toxic"], word_rows(b["text"].tolist(), memory), strict=True):
                if s != shard and own:
                    yield moved()
                    own, toxic = [], []
                shard = s
                own.append(d)
                toxic.append(y)
        if own:
            yield moved()

    if shards:
        split = learnt.select(F.pmod(F.xxhash64(F.lit(params.seed), "id"), F.lit(shards)).cast("int").alias("shard"), "id", "toxic", "text")
        values = [f"d{j}" for j in range(params.dim)]
        parts = mapped(split.repartition("shard").sortWithinPartitions("shard", "id"), local, "row int, " + ", ".join(f"{v} long" for v in values))
        move(model, parts.groupBy("row").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values)).toPandas())
    # Training weighs the classes alike; shift the logit to the share of labels in the whole table.
    share = [sum(r["n"] for r in found if r["toxic"] == y) for y in (0, 1)]
    if all(share):
        model.shift = float(np.log(share[1] / share[0]) / 2)

    def graded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, parts = _WordRows(buckets), []
        for b in batches:
            cuts = reached(model.scores(word_rows(b["text"].tolist(), memory)))
            own = pd.DataFrame({"lang": [x or "" for x in b["lang"]], "toxic": b["toxic"].to_numpy(), "reached": cuts, "n": 1})
            parts = [pd.concat([*parts, own]).groupby(["lang", "toxic", "reached"], as_index=False)["n"].sum()]
        yield from parts

    if shards and any(r["spare"] for r in found):
        graded_rows = mapped(rows.where("spare").select("toxic", "text", "lang"), graded, "lang string, toxic int, reached int, n long")
        model.thresholds = thresholds(graded_rows.groupBy("lang", "toxic", "reached").agg(F.sum("n").alias("n")).toPandas())
    forget(rows)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, threshold and flagged (score reaches the language's threshold) of every row."""
    schema = "doc_id long, score double, threshold double, flagged int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = _WordRows(model.params.buckets)
        for b in batches:
            texts, scores = b["text"].tolist(), []
            for part in chunks([len(t or "") for t in texts], 400_000):
                scores.append(model.scores(word_rows(texts[part], memory)))
            s = np.concatenate(scores) if scores else np.zeros(0)
            limit = np.array([model.thresholds.get(x or "", model.thresholds[""]) for x in b["lang"]], dtype=float)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "threshold": limit, "flagged": (s >= limit).astype("int32")})

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["lang"]), run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, fit(docs, labels))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "flagged",
    )


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score reaches their language's threshold."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    schema = docs.select("doc_id", "text", "lang", "source", "n_chars").schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = _WordRows(model.params.buckets)
        for b in batches:
            keep = np.ones(len(b), dtype=bool)
            texts, langs = b["text"].tolist(), b["lang"].tolist()
            for part in chunks([len(t or "") for t in texts], 400_000):
                limit = np.array([model.thresholds.get(x or "", model.thresholds[""]) for x in langs[part]])
                keep[part] = model.scores(word_rows(texts[part], memory)) < limit
            yield b[keep]

    return mapped(docs.select(*schema.names), run, schema)
