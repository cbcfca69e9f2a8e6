import itertools
import random

import numpy as np

from glanage.llm import minhash as m
from glanage.llm.components import components

P = m.OmhParams()


def brute(rows):
    """Classes by comparing all pairs with a plain dynamic programme."""
    labels = {}
    for i, t in rows:
        labels[i] = m.labelled(m.words_of(t), 5).tolist()
    root = {i: i for i in labels}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(labels.items(), 2):
        n, k = len(a), len(b)
        if n and k:
            row = [0] * (k + 1)
            for x in a:
                before = row[:]
                for y in range(k):
                    row[y + 1] = before[y] + 1 if x == b[y] else max(before[y + 1], row[y])
            same = row[k] / max(n, k) >= 0.8
        else:
            same = dict(rows)[i] == dict(rows)[j] and n == k
        if same:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in labels}


def mutated(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice(([], ["new%d" % rng.randrange(10**6)], [words[at], "more%d" % rng.randrange(10**6)]))
    return words


def corpus(seed, groups=12):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = ["w%d" % rng.randrange(3000) for _ in range(rng.choice((6, 12, 40, 120)))]
        for edits in (0, 0, 1, 1, 2, 3, 6):
            rows.append((i, " ".join(mutated(rng, base, edits))))
            i += 1
    return rows


def test_classes_equal_brute_force(documents):
    for seed in (1, 2):
        rows = corpus(seed)
        got = {r["doc_id"]: r["class_id"] for r in m.classes(documents(rows)).collect()}
        assert got == brute(rows)


def test_large_group_meets_its_original(documents):
    rng = random.Random(5)
    base = ["w%d" % i for i in range(150)]
    rows = [(1000, " ".join(base))] + [(i, " ".join(mutated(rng, base, 1))) for i in range(60)]
    got = {r["doc_id"]: r["class_id"] for r in m.classes(documents(rows)).collect()}
    want = brute(rows)
    assert got == want


def all_pairs(rows):
    """Classes by counting the common shingles of all pairs and aligning those that share enough."""
    labels = [m.labelled(m.words_of(t), 5) for _, t in rows]
    vocabulary, at = np.unique(np.concatenate(labels), return_inverse=True)
    times = np.bincount(at)
    column = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in labels])
    there = np.zeros((len(rows), int((times > 1).sum())), np.float32)
    there[owner[times[at] > 1], column[at[times[at] > 1]]] = 1
    n = np.array([len(x) for x in labels])
    likely = np.argwhere(np.triu(there @ there.T >= 0.8 * np.maximum(n[:, None], n) - 1e-3, 1))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in likely.tolist():
        if m.similarity(labels[i], labels[j], 0.8) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def substituted(seed, copies, changes=6):
    """Copies of a text that isn't there; most pairs of them are a little under the threshold."""
    rng = random.Random(seed)
    base = ["w%d" % i for i in range(250)]
    rows = []
    for i in range(copies):
        words = list(base)
        for at in rng.sample(range(250), changes):
            words[at] = "new%d" % rng.randrange(10**9)
        rows.append((i, " ".join(words)))
    return rows


def test_large_group_without_its_original(documents):
    rows = substituted(1, 2000)
    want = all_pairs(rows)
    assert {r["doc_id"]: r["class_id"] for r in m.classes(documents(rows)).collect()} == want


def test_blocks_of_a_large_bucket(documents):
    rows = substituted(2, 300) + [(1000 + i, t + " x%d" % i * (i % 60)) for i, t in substituted(3, 300)]
    want = all_pairs(rows)
    assert {r["doc_id"]: r["class_id"] for r in m.classes(documents(rows), m.OmhParams(block=32)).collect()} == want


def test_order_matters():
    a = m.labelled([b"w%d" % i for i in range(100)], 5)
    b = np.concatenate([a[50:], a[:50]])
    assert m.similarity(a, a, 0.8) == 1.0
    assert m.similarity(a, b, 0.8) < 0.8
    assert not set(m.sketches(a, P)) & set(m.sketches(a[::-1], P))


def test_banded_alignment_is_exact():
    rng = random.Random(7)
    for _ in range(200):
        a = np.array(rng.sample(range(60), rng.randrange(1, 40)), np.uint64)
        b = np.array(mutated_numbers(rng, a.tolist()), np.uint64)
        if len(b) == 0:
            continue
        n, k = len(a), len(b)
        t = np.zeros((n + 1, k + 1), int)
        for i in range(n):
            for j in range(k):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        full = t[n, k] / max(n, k)
        got = m.similarity(a, b, 0.8)
        assert (got >= 0.8) == (full >= 0.8) and (full < 0.8 or abs(got - full) < 1e-12)


def mutated_numbers(rng, a):
    a = [x for x in a if rng.random() > 0.1]
    if len(a) > 3 and rng.random() < 0.5:
        i, j = rng.sample(range(len(a)), 2)
        a[i], a[j] = a[j], a[i]
    return a


def test_odd_rows(documents, odd):
    got = m.classes(documents(odd, extra=True)).collect()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}
    kept = m.stage_near_duplicates(documents(odd).sparkSession, documents(odd, extra=True), "").collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 1, 3, 4, 6, 7, 8, 9]
    assert m.classes(documents([])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, 9), (9, 5), (5, 5), (2, 9)] + [(1000, rng.randrange(1001, 1100)) for _ in range(80)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 131)) and got[9] == got[5] == got[2] == 2
    assert {v for k, v in got.items() if k >= 1000} == {1000}


def test_different_texts_under_one_id(documents):
    rng = random.Random(8)
    base = ["w%d" % i for i in range(60)]
    rows = [(1, "a few words that stand alone here"), (1, " ".join(base)), (1, " ".join(base)), (2, " ".join(mutated(rng, base, 1))), (3, " ".join(mutated(rng, base, 1))), (3, None), (None, " ".join(base))]
    keys = {r["key"]: r["id"] for r in m.signatures(documents(rows).selectExpr("doc_id as id", "text", "xxhash64(text) as th"), P).collect()}
    got = {r["doc_id"]: r["class_id"] for r in m.classes(documents(rows)).collect()}
    least = {i: min(k for k, j in keys.items() if j == i) for i in (1, 2, 3)}
    near = {i for i in (1, 2, 3) if any(least[i] == x["key"] and x["n"] > 10 for x in m.signatures(documents(rows).selectExpr("doc_id as id", "text", "xxhash64(text) as th"), P).collect())}
    assert got == {i: min(near) if i in near else i for i in (1, 2, 3)}
    kept = m.stage_near_duplicates(documents(rows).sparkSession, documents(rows), "").collect()
    ids = sorted(r["doc_id"] or -1 for r in kept)
    assert ids == sorted([-1, *{got[i] for i in got}])


def test_pairs_that_share_a_passage_with_all(documents):
    """Links of few texts among many that share as many sketches."""
    rng = random.Random(6)
    passage = ["p%d" % i for i in range(14)]
    rows = []
    for i in range(120):
        words = passage + ["t%d" % rng.randrange(10**6) for _ in range(26)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "more%d" % i]))]
    assert {r["doc_id"]: r["class_id"] for r in m.classes(documents(rows)).collect()} == all_pairs(rows)
