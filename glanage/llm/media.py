"""Media columns: content-defined chunking with a deduplicated chunk store.

A payload is cut where a rolling gear hash of its last 64 bytes has zero top
bits, so equal stretches are cut alike wherever they stand. Spark joins choose
one owner for each chunk digest; the store holds a chunk only with its owner,
and a payload is stored as its manifest, the ordered list of chunk digests and
lengths. Reading back takes the stored manifest, fetches borrowed chunks from
their owners by digest, puts the chunks in order and verifies every digest and
that of the payload. The stored form that results describe is the manifest.

Digests and lengths decide everything before a payload moves. Payloads that
occur once and share no chunk, by far the most, are written where they are
read: a bitmap of fixed size, over the first bits of the payload digest, tells
them from those that may be special. Only the latter move, compressed, to meet
what was decided about them, and equal ones collapse. (A full bitmap would just
send all of them that way.) Joins are told to sort and merge, so that small
inputs are handled as large ones are. A chunk digest shared by many payloads is a key of
joins only, whose large partitions Spark splits.

Cases: a null text is an empty payload; payloads are zero-padded to a positive
multiple of 64 bytes; long texts are chunked whole; repeated rows (equal ids or
texts) each get their row; null ids stay null and count as the least; of the
chunks with one digest, the one at the first place of the payload of least
digest is the owner; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glanage.llm.common import HEX, bitmap, mapped, marked, saved

UNIT = 64
_WINDOW = 64


@dataclass(frozen=True)
class ChunkParams:
    least: int = 512
    most: int = 8192
    #: A cut is made on average every 2 ** bits bytes beyond the least size.
    bits: int = 11


def _gear() -> np.ndarray:
    """256 pseudo-random 64-bit numbers, by rule."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8, person=b"gear").digest(), "big") for b in range(256)], np.uint64)


GEAR = _gear()


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length and the zero-padded bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


def cuts(data: bytes, params: ChunkParams = ChunkParams()) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    if n <= params.least:
        return [n]
    # h[i] = sum of GEAR[data[i - j]] << j for j < 64, by doubling the window.
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    with np.errstate(over="ignore"):
        while width < _WINDOW:
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
            width *= 2
    marks = np.flatnonzero(h >> np.uint64(64 - params.bits) == 0) + 1
    out, start = [], 0
    while n - start > params.least:
        at = int(np.searchsorted(marks, start + params.least))
        stop = min(n, start + params.most, int(marks[at]) if at < len(marks) else n)
        out.append(stop)
        start = stop
    if start < n:
        out.append(n)
    return out


def chunked(data: bytes, params: ChunkParams = ChunkParams()) -> list[bytes]:
    ends = cuts(data, params)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def manifest(digests: list[bytes], lengths: list[int]) -> bytes:
    """The stored form of one payload: a header, then digest and length of each chunk in order."""
    return struct.pack(">4sI", b"CDC1", len(digests)) + b"".join(d + struct.pack(">I", n) for d, n in zip(digests, lengths, strict=True))


def entries(stored: bytes) -> list[tuple[bytes, int]]:
    """Digest and length of each chunk of a stored manifest."""
    magic, n = struct.unpack_from(">4sI", stored)
    if magic != b"CDC1" or len(stored) != 8 + 36 * n:
        raise ValueError("damaged manifest")
    return list(struct.iter_unpack(">32sI", stored[8:]))


def _digest_at(at: Column) -> Column:
    """The digest of chunk ``at`` in the column manifest."""
    return F.substring("manifest", F.lit(9) + 36 * at, F.lit(32))


def feature(samples: bytes, n_chunks: int) -> str:
    """Mean, deviation, sign changes around the middle and entropy of the 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    changes = int((np.diff((x >= 128).astype(np.int8)) != 0).sum())
    return f"chunks={n_chunks};mean={x.mean():.4f};std={x.std():.4f};changes={changes};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f}"


def _described(docs: DataFrame, params: ChunkParams) -> DataFrame:
    """doc_id, n_bytes, sha (of the payload) and digests (of its chunks) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                n, data = payload(text)
                rows.append((key, n, hashlib.sha256(data).hexdigest(), [hashlib.sha256(p).digest() for p in chunked(data, params)]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "sha", "digests"]).astype({"doc_id": "Int64"})

    return mapped(docs, run, "doc_id long, n_bytes long, sha string, digests array<binary>")


def _full(docs: DataFrame, special: bytes, holders: bytes, moving: bool, params: ChunkParams) -> DataFrame:
    """doc_id, sha, manifest and blobs (compressed chunks): of ``moving``, those that the bitmaps call special and holders, else those that aren't special."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                data = payload(text)[1]
                sha = hashlib.sha256(data).hexdigest()
                if marked(special, sha) != moving or (moving and not marked(holders, _held(sha, key))):
                    continue
                parts = chunked(data, params)
                rows.append((key, sha, manifest([hashlib.sha256(p).digest() for p in parts], [len(p) for p in parts]), [zlib.compress(p, 3) for p in parts]))
            yield pd.DataFrame(rows, columns=["doc_id", "sha", "manifest", "blobs"]).astype({"doc_id": "Int64"})

    return mapped(docs, run, "doc_id long, sha string, manifest binary, blobs array<binary>")


def _held(sha: str, key: int | None) -> str:
    return hashlib.sha256(f"{sha}:{-1 if pd.isna(key) else int(key)}".encode()).hexdigest()


def write_store(docs: DataFrame, params: ChunkParams = ChunkParams()) -> tuple[DataFrame, DataFrame]:
    """(rows, store): the payload of each row of ``docs`` by digest, and one stored row per distinct payload.

    store has sha, manifest, blobs (null where borrowed), borrowed and lent (places in the manifest).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(_described(docs, params), "payloads")
    holder = F.coalesce("doc_id", F.lit(-1))
    distinct = rows.groupBy("sha").agg(F.first("digests").alias("digests"), F.min(holder).alias("holder"), F.count("*").alias("copies"))
    chunks = distinct.select("sha", F.posexplode("digests").alias("at", "digest"))
    # What is joined by a key of many rows is kept apart, so that Spark can split these rows.
    owners = saved(chunks.groupBy("digest").agg(F.min(F.struct("sha", "at")).alias("owner"), F.count("*").alias("n")).where("n > 1"), "owners")
    shared = chunks.join(owners.hint("merge"), "digest").withColumn("own", (F.col("owner.sha") == F.col("sha")) & (F.col("owner.at") == F.col("at")))
    roles = shared.groupBy("sha").agg(
        F.collect_list(F.when(~F.col("own"), F.col("at"))).alias("borrowed"), F.collect_list(F.when(F.col("own"), F.col("at"))).alias("lent")
    )
    special = distinct.select("sha", "holder", "copies").join(roles.hint("merge"), "sha", "left").where("copies > 1 or borrowed is not null")
    special = saved(special, "special")
    # Payloads that only look special move as well, so their holders are in the second bitmap too.
    first = F.substring("sha", 1, HEX)
    alike = distinct.select("sha", F.col("holder").alias("h")).join(special.select(first.alias("first")).distinct().hint("merge"), first == F.col("first"), "left_semi")
    held = F.sha2(F.concat("sha", F.lit(":"), F.col("h").cast("string")), 256)
    bits, holders = bitmap(special.select(F.col("sha").alias("d"))), bitmap(alike.select(held.alias("d")))
    none = F.array().cast("array<int>")
    columns = ["sha", "manifest", "blobs", "borrowed", "lent"]
    plain = _full(docs, bits, holders, False, params).withColumn("borrowed", none).withColumn("lent", none).select(columns)
    met = _full(docs, bits, holders, True, params).join(special.hint("merge"), "sha", "left").where(F.col("holder").isNull() | (holder == F.col("holder")))
    met = met.select(
        "sha",
        "manifest",
        F.transform("blobs", lambda x, i: F.when(~F.array_contains(F.coalesce("borrowed", none), i), x)).alias("blobs"),
        F.coalesce("borrowed", none).alias("borrowed"),
        F.coalesce("lent", none).alias("lent"),
    )
    return rows.drop("digests"), saved(plain.unionByName(met), "chunks")


def read_store(store: DataFrame) -> DataFrame:
    """sha, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each stored payload, from the stored bytes."""
    lent = store.where(F.size("lent") > 0).select("manifest", "blobs", F.explode("lent").alias("at"))
    lent = lent.select(_digest_at(F.col("at")).alias("digest"), F.element_at("blobs", F.col("at") + 1).alias("blob"))
    lent = saved(lent.groupBy("digest").agg(F.first("blob").alias("blob")), "lent")
    wanted = store.where(F.size("borrowed") > 0).select("sha", "manifest", F.explode("borrowed").alias("at"))
    wanted = wanted.select("sha", "at", _digest_at(F.col("at")).alias("digest"))
    fetched = wanted.join(lent.hint("merge"), "digest").groupBy("sha").agg(F.collect_set(F.struct("at", "blob")).alias("fetched"))
    whole = store.where(F.size("borrowed") == 0).withColumn("fetched", F.lit(None).cast(fetched.schema["fetched"].dataType))
    joined = store.where(F.size("borrowed") > 0).join(fetched.hint("merge"), "sha")
    columns = ["sha", "manifest", "blobs", "fetched"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for sha, stored, blobs, more in zip(*(b[c] for c in columns), strict=True):
                stored = bytes(stored)
                chunks = entries(stored)
                parts = dict(enumerate(blobs)) | {x["at"]: x["blob"] for x in (more if more is not None else ())}
                data = [zlib.decompress(parts[i]) for i in range(len(chunks))]
                for x, (d, n) in zip(data, chunks, strict=True):
                    if hashlib.sha256(x).digest() != d or len(x) != n:
                        raise ValueError(f"a chunk of {sha} is damaged")
                samples = b"".join(data)
                got = hashlib.sha256(samples).hexdigest()
                if got != sha:
                    raise ValueError(f"payload {sha} came back as {got}")
                rows.append((sha, len(samples), got, zlib.crc32(samples[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples, len(data))))
            yield pd.DataFrame(rows, columns=["sha", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "sha string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return mapped(whole.select(columns).unionByName(joined.select(columns)), run, schema)


def media(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """Stores every text as chunks, reads it back, and describes what was read, one row per row of ``docs``."""
    rows, store = write_store(docs, params)
    found = saved(read_store(store).dropDuplicates(["sha"]), "found")
    return rows.select("doc_id", "n_bytes", "sha").join(found.hint("merge"), "sha").drop("sha")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
