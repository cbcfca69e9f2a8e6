"""Near-duplicate detection by Order MinHash.

A text is its sequence of five-word shingles, each labelled with how many
times it has occurred before, so that labelled shingles are unique in a text.
A sketch takes the ``ell`` labelled shingles of least hash and keeps them in
text order; two texts agree in a sketch when they share these shingles in the
same order, so agreement follows edit similarity and not just set overlap.
Texts that agree in a sketch fall in one bucket and become candidates.

Candidates are verified by banded alignment of their labelled shingles: with L
the length of the longest common subsequence, the edit similarity of two texts
of n and m shingles is L / max(n, m); from 0.8 they are linked. Such an alignment
never leaves a band of max(n, m) / 5 around the diagonal, so only matches inside
the band are used. A document's class is its connected component.

How the work stays bounded: equal texts collapse first. In a bucket of few
texts all pairs are candidates. In a larger one every text first meets a few
pivots, those that are in the largest buckets elsewhere: in a group of copies
these are the ones with the fewest changes, which are near all others. Texts
that this leaves outside their bucket's largest component then meet all others
of the bucket, block by block: a matrix product counts the shingles that the
texts of two blocks share, and of the pairs that share enough, the best first,
those that nothing connects yet are aligned. So every two texts that share a
bucket end in one class or have been compared. Alignments grow with the number
of texts; only the counts grow with the square of the texts that a bucket's
pivots leave open, and no pair of them leaves its task unless it is a new link.
What joins by bucket is dealt by parts of the bucket, or by sides whose skew
Spark can split, so no task gets a large bucket whole.

Probability of missing a link of edit similarity s, which has a share
j = s / (2 - s) of shingles in common, is (1 - j^ell)^sketches: under 1e-3 for
texts right at the threshold, 1e-4 from 0.84, and less above. Texts of at most 40 shingles also get
shorter sketches, as four shingles are many of theirs.

Cases: a null or empty text, or one without words, is only grouped with equal
texts; texts of under five words have one shingle of all their words; long
texts are sketched whole, in blocks. There is one row for each doc_id: rows
repeated count once, and of different texts under one doc_id the one of least
digest counts. A row without doc_id gets no class and is kept. Ties: the least
doc_id names a class, the least of equally central texts is the pivot, and of
the rows of one kept doc_id the stage keeps the least. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.llm.common import mapped, pick, saved
from glanage.llm.components import components


@dataclass(frozen=True)
class OmhParams:
    shingle: int = 5
    similarity: float = 0.8
    #: (shingles in a sketch, sketches, least and most shingles of a text that gets them)
    families: tuple[tuple[int, int, int, int], ...] = ((2, 14, 2, 40), (4, 32, 20, 1 << 40))
    #: Buckets of at most so many texts compare all pairs.
    small: int = 12
    #: Pivots that a larger bucket elects.
    pivots: int = 4
    #: Texts, and shingles, of a block of those that pivots leave open.
    block: int = 512
    block_shingles: int = 1 << 20
    #: Texts of a bucket that are dealt together where facts about it are joined.
    part: int = 256
    seed: int = 11


_SPLIT = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: 64-bit sums of a sketch's hashes are held for so many of them at once.
_BLOCK = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def labelled(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of the k-word shingles, each labelled with its occurrence number; unique within the text."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        s = _mix(s)
        order = np.argsort(s, kind="stable")
        ranked = s[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        if not new.all():
            at = np.arange(n)
            occurrence = np.empty(n, np.uint64)
            occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
            s = _mix(s + occurrence * np.uint64(0xD6E8FEB86659FD93))
    return s


def sketches(labels: np.ndarray, params: OmhParams) -> np.ndarray:
    """One bucket number per sketch; none for texts of a single shingle."""
    found = []
    with np.errstate(over="ignore"):
        for f, (ell, count, least, most) in enumerate(params.families):
            n = len(labels)
            if not least <= n <= most:
                continue
            seeds = _mix(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(params.seed * 1000 + f * 100))
            step = max(1, _BLOCK // n)
            for at in range(0, count, step):
                part = seeds[at : at + step, None]
                v = (labels[None] ^ part) * _M1
                v ^= v >> np.uint64(29)
                v *= _M2
                take = np.sort(np.argpartition(v, ell - 1, axis=1)[:, :ell], axis=1) if n > ell else np.broadcast_to(np.arange(n), (len(part), n))
                chosen = labels[take]
                b = part[:, 0].copy()
                for j in range(chosen.shape[1]):
                    b = _mix(b * np.uint64(0x9E3779B97F4A7C15) + chosen[:, j])
                found.append(b)
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """L / max(n, m) of two labelled sequences by banded alignment; 0 if surely under ``least``."""
    n, m = len(a), len(b)
    most = max(n, m)
    if not n or not m or min(n, m) < least * most:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < least * most - 1e-9:
        return 0.0
    inside = np.abs(ia - ib) <= (1 - least) * most + 1e-9
    ia, ib = ia[inside], ib[inside]
    ib = ib[np.argsort(ia, kind="stable")]
    if (ib[1:] > ib[:-1]).all():
        length = len(ib)
    else:
        tails: list[int] = []
        for j in ib.tolist():
            at = bisect.bisect_left(tails, j)
            tails[at : at + 1] = [j]
        length = len(tails)
    return length / most


def signatures(docs: DataFrame, params: OmhParams) -> DataFrame:
    """id, th (hash of the text), key (digest of the word sequence), n (shingles) and sk (bucket numbers) of every row with an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, ns, sk = [], [], []
            for text in b["text"]:
                words = words_of(text)
                labels = labelled(words, params.shingle)
                raw = b"w" + b" ".join(words) if words else b"t" + (text or "").encode("utf-8", "surrogatepass")
                keys.append(xxhash.xxh3_128_hexdigest(raw))
                ns.append(len(labels))
                sk.append(sketches(labels, params))
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "key": keys, "n": np.array(ns, dtype=np.int64), "sk": sk})

    return mapped(docs.where("id is not null").select("id", "th", "text"), run, "id long, th long, key string, n long, sk array<long>")


def verify(pairs: DataFrame, texts: DataFrame, params: OmhParams) -> DataFrame:
    """Those of the pairs (a, b) whose texts align with enough similarity."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def of(i: int, text: str) -> np.ndarray:
            if i not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[i] = labelled(words_of(text), params.shingle)
            return known[i]

        for p in batches:
            good = [similarity(of(a, x), of(b, y), params.similarity) >= params.similarity for a, x, b, y in zip(p["a"], p["text_a"], p["b"], p["text_b"], strict=True)]
            yield p.loc[np.array(good, dtype=bool), ["a", "b"]]

    return mapped(pairs.join(one, "a").join(two, "b"), run, "a long, b long")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each array of ``left`` shares with each of ``right``; every array's are distinct."""
    flat, rows = [np.concatenate(x) for x in (left, right)], [np.repeat(np.arange(len(x)), [len(a) for a in x]) for x in (left, right)]
    known = np.intersect1d(*flat)
    both = []
    for x, r in zip(flat, rows, strict=True):
        at = np.minimum(np.searchsorted(known, x), max(len(known) - 1, 0))
        there = known[at] == x if len(known) else np.zeros(len(x), bool)
        order = np.argsort(at[there], kind="stable")
        both.append((at[there][order], r[there][order]))
    count = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(known), 4096):
        parts = []
        for (at, r), size in zip(both, count.shape, strict=True):
            a, b = np.searchsorted(at, (lo, lo + 4096))
            part = np.zeros((size, min(4096, len(known) - lo)), np.float32)
            part[r[a:b], at[a:b] - lo] = 1
            parts.append(part)
        count += parts[0] @ parts[1].T
    return count


def rest(members: DataFrame, texts: DataFrame, params: OmhParams) -> DataFrame:
    """Links (a, b) that connect what is linked among the texts of each bucket and has different labels.

    ``members`` has bucket, id, n, label, open and whole; texts that aren't open have their bucket's one label.
    A bucket that is whole is one cell, a larger one has cells by open, length and a hash of the id.
    """

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "s": [labelled(words_of(t), params.shingle).view(np.int64) for t in b["text"]]})

    known = saved(mapped(texts.join(members.select("id").distinct(), "id", "left_semi"), shingled, "id long, s array<long>"), "shingles")
    # Lengths of linked texts differ by one class at most.
    length = F.floor(F.log("n") / float(np.log(1.001 / params.similarity)))
    placed = members.select("bucket", "id", "n", "label", (F.col("whole") | F.col("open")).alias("open"), F.when(F.col("whole"), 0).otherwise(length).alias("len"))
    cells = placed.groupBy("bucket", "open", "len").agg(F.ceil(F.greatest(F.count("*") / params.block, F.sum("n") / params.block_shingles)).alias("k"))
    placed = saved(placed.join(saved(cells, "counts"), ["bucket", "open", "len"]).withColumn("k", F.pmod(F.xxhash64("id"), "k")), "cells")
    cells = placed.select("bucket", "open", "len", "k").distinct()
    one = cells.where("open").select("bucket", F.col("len").alias("l1"), F.col("k").alias("k1"))
    two = cells.select("bucket", F.col("open").alias("o2"), F.col("len").alias("l2"), F.col("k").alias("k2"))
    met = one.join(two, "bucket").where((F.abs(F.col("l1") - F.col("l2")) <= 1) & (~F.col("o2") | (F.struct("l1", "k1") <= F.struct("l2", "k2"))))
    met = saved(met, "meetings")
    keys = ["bucket", "l1", "k1", "o2", "l2", "k2"]
    own = F.col("o2") & (F.col("l1") == F.col("l2")) & (F.col("k1") == F.col("k2"))
    first = placed.where("open").select("bucket", "id", "n", "label", F.col("len").alias("l1"), F.col("k").alias("k1")).join(met, ["bucket", "l1", "k1"])
    second = placed.select("bucket", "id", "n", "label", F.col("open").alias("o2"), F.col("len").alias("l2"), F.col("k").alias("k2")).join(met.where(~own), ["bucket", "o2", "l2", "k2"])
    rows = first.select(*keys, "id", "n", "label", F.lit(True).alias("left")).unionByName(second.select(*keys, "id", "n", "label", F.lit(False).alias("left")))

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p[p["left"]], p[~p["left"]]
        alone = not len(y)
        if alone:
            y = x
        sx, sy = list(x["s"]), list(y["s"])
        share = shared(sx, sy)
        n, m = x["n"].to_numpy()[:, None], y["n"].to_numpy()[None]
        most = np.maximum(n, m)
        good = (share >= params.similarity * most - 1e-3) & (np.minimum(n, m) >= params.similarity * most)
        lx, ly = x["label"].to_numpy(), y["label"].to_numpy()
        good &= lx[:, None] != ly[None]
        i, j = np.nonzero(np.triu(good, 1) if alone else good)
        order = np.argsort(-(share / most)[i, j], kind="stable")
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (u := root.get(v, v)) != v:
                root[v] = root.get(u, u)
                v = root[v]
            return v

        links = []
        ids, others, lx, ly = x["id"].tolist(), y["id"].tolist(), lx.tolist(), ly.tolist()
        for i, j in zip(i[order].tolist(), j[order].tolist(), strict=True):
            u, v = find(lx[i]), find(ly[j])
            if u != v and similarity(sx[i], sy[j], params.similarity) >= params.similarity:
                root[u] = v
                links.append((ids[i], others[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.join(known, "id").groupBy(*keys).applyInPandas(compare, "a long, b long")


def spread(facts: DataFrame) -> DataFrame:
    """A row for each part of a bucket, so that a large bucket's rows needn't meet in one task."""
    return facts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def classes(docs: DataFrame, params: OmhParams = OmhParams()) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every doc_id of ``docs``."""
    rows = pick(docs, id="doc_id", text="text").select(F.col("id").cast("long").alias("id"), "text").withColumn("th", F.xxhash64("text"))
    sig = saved(signatures(rows, params), "sketches")
    repeated = sig.groupBy("id").agg(F.min(F.struct("key", "th")).alias("v"), F.count("*").alias("c")).where("c > 1").select("id", "v.*")
    repeated = saved(repeated, "repeated")
    if not repeated.isEmpty():
        once = sig.join(repeated, ["id", "key", "th"], "left_semi").dropDuplicates(["id"])
        sig = saved(sig.join(repeated, "id", "left_anti").unionByName(once), "sketches")
    nodes = saved(sig.groupBy("key").agg(F.min("id").alias("id")), "texts")
    bands = sig.join(nodes, ["id", "key"], "left_semi").select("id", "th", "n", F.explode("sk").alias("bucket"))
    # Kept apart, so that Spark can split a large bucket's rows in the join.
    large = saved(bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = saved(bands.join(large, "bucket"), "members")
    central = saved(members.groupBy("id").agg(F.sum(F.log2("size")).alias("w"), F.first("th").alias("own")), "central")
    texts = saved(rows.join(central.hint("merge"), "id").where("th = own").groupBy("id").agg(F.first("text").alias("text")), "candidates")

    ratio = F.least("n", "m") >= params.similarity * F.greatest("n", "m")
    few = members.where(F.col("size") <= params.small)
    pairs = (
        few.select("bucket", F.col("id").alias("a"), "n")
        .join(few.select("bucket", F.col("id").alias("b"), F.col("n").alias("m")), "bucket")
        .where((F.col("a") < F.col("b")) & ratio)
        .select("a", "b")
    )
    parts = F.ceil(F.col("size") / params.part)
    many = members.where(F.col("size") > params.small).join(central.select("id", "w").hint("merge"), "id")
    many = saved(many.select("bucket", "id", "n", "w", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).alias("part")), "large")
    # The most central text of each of so many shares of a bucket: found by partial aggregates, whatever the bucket's size.
    best = many.groupBy("bucket", F.pmod(F.xxhash64("id", F.lit(params.seed)), F.lit(params.pivots)).alias("share"))
    best = best.agg(F.max(F.struct("w", (-F.col("id")).alias("i"), "n")).alias("p"), F.first("parts").alias("parts"))
    lists = best.groupBy("bucket").agg(F.collect_list(F.struct((-F.col("p.i")).alias("id"), F.col("p.n").alias("n"))).alias("p"), F.first("parts").alias("parts"))
    met = many.join(spread(saved(lists, "pivots")), ["bucket", "part"]).groupBy("id", "n").agg(F.array_distinct(F.flatten(F.collect_set("p"))).alias("p"))
    met = met.select("id", "n", F.explode("p").alias("q")).select(F.col("id").alias("a"), "n", F.col("q.id").alias("b"), F.col("q.n").alias("m")).where((F.col("a") != F.col("b")) & ratio)
    pairs = pairs.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    label = saved(components(verify(pairs, texts, params)), "components")

    now = many.join(label.withColumnRenamed("root", "label"), "id", "left").select("bucket", "id", "n", "parts", "part", F.coalesce("label", "id").alias("label"))
    top = now.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("t"), F.first("parts").alias("parts"))
    top = top.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("c"), F.sum("t").alias("t"), F.first("parts").alias("parts"))
    whole = (F.col("c") <= params.block) & (F.col("t") <= params.block_shingles)
    top = top.where("labels > 1").select("bucket", "parts", F.col("top.label").alias("main"), whole.alias("whole"))
    left = now.drop("parts").join(spread(saved(top, "tops")), ["bucket", "part"])
    left = saved(left.select("bucket", "id", "n", "label", "whole", (F.col("label") != F.col("main")).alias("open")), "open")
    if not left.isEmpty():
        more = saved(rest(left, texts, params), "links")
        if not more.isEmpty():
            of = lambda c: label.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
            joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
            joined = components(joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))).toDF("root", "least")
            alone = more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(label, "id", "left_anti").withColumn("root", F.col("id"))
            label = saved(label.unionByName(alone).join(joined, "root", "left").select("id", F.coalesce("least", "root").alias("root")), "components")
    root = saved(nodes.join(label, "id", "left").select("key", F.coalesce("root", "id").alias("class_id")), "classes")
    return sig.select(F.col("id").alias("doc_id"), "key").join(root, "key").select("doc_id", "class_id")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class; ``kept`` marks the one that stands for it."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class; of the rows of one doc_id the least."""
    gone = classes(docs).where("doc_id <> class_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")
    again = saved(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    least = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("v"))
    return kept.join(again, "doc_id", "left_anti").unionByName(least.select("doc_id", "v.*"))
