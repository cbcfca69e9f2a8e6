import hashlib
import random
import zlib

from glanage.llm import media as m

P = m.ChunkParams()


def naive(data):
    out, start = [], 0
    while len(data) - start > P.least:
        end = start + P.least
        while True:
            h = 0
            for j in range(max(0, end - 64), end):
                h = ((h << 1) + int(m.GEAR[data[j]])) & ((1 << 64) - 1)
            if h >> (64 - P.bits) == 0 or end - start >= P.most or end >= len(data):
                break
            end += 1
        out.append(end)
        start = end
    return out + ([len(data)] if start < len(data) else [])


def test_cuts_equal_a_rolling_hash():
    data = random.Random(1).randbytes(30_000)
    assert m.cuts(data) == naive(data)
    assert m.cuts(b"\0" * 20_000) == naive(b"\0" * 20_000)


def test_chunks_survive_shifts():
    rng = random.Random(2)
    data = rng.randbytes(100_000)
    a, b = set(m.chunked(data)), set(m.chunked(rng.randbytes(777) + data))
    assert len(a & b) > 0.9 * len(a)


def plain_feature(data):
    import math
    from collections import Counter

    n, counts = len(data), Counter(data)
    mean = sum(data) / n
    std = math.sqrt(sum(c * (x - mean) ** 2 for x, c in counts.items()) / n)
    changes = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) + 0.0
    return f"chunks={len(m.chunked(data))};mean={mean:.4f};std={std:.4f};changes={changes};entropy={entropy:.4f}"


def test_reads_back_what_was_written(documents, odd):
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh é", k=30_000))
    rows = [*odd, (40, passage), (41, "x" * 100 + passage), (42, passage), (43, passage + passage), (44, passage[:15_000])]
    docs = documents(rows, extra=True)
    _, store = m.write_store(docs)
    stored = store.collect()
    kept = sum(sum(n for (_, n), x in zip(m.entries(bytes(r["manifest"])), r["blobs"]) if x is not None) for r in stored)
    manifests = {r["sha"]: bytes(r["manifest"]) for r in stored}
    assert kept < 3.5 * 33_000 + len(dict(odd)[6]) + 20_000  # shared chunks are stored once
    got = m.media(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        n, data = m.payload(t)
        for r in by[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
            assert len(data) % 64 == 0 and len(data) > 0
            media = manifests[r["payload_sha256"]]
            assert media == m.manifest([hashlib.sha256(x).digest() for x in m.chunked(data)], [len(x) for x in m.chunked(data)])
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
            assert r["feature"] == plain_feature(data)
    assert by[40][0]["media_sha256"] == by[42][0]["media_sha256"] and by[40][0]["feature"] == by[42][0]["feature"]
    assert m.media(documents([])).count() == 0


def test_damage_is_noticed(spark, documents):
    import pytest
    from pyspark.sql import functions as F

    _, store = m.write_store(documents([(1, "text")]))
    bad = store.withColumn("blobs", F.array(F.lit(zlib.compress(b"other" + bytes(59)))))
    with pytest.raises(Exception, match="damaged"):
        m.read_store(bad).collect()
