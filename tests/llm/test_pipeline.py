"""The pipeline against a plain version of each stage, and its stages on odd rows."""

import itertools
import os
import re

import numpy as np
import pytest

import corpus_pipeline
from glanage.llm import decontamination as dec
from glanage.llm import minhash, pii, segmentation, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rejected(model, row):
    """One text at a time, window by window."""
    p = model.params
    d = toxicity.word_rows([row["text"]], toxicity._WordRows(p.buckets))[0]
    x = np.concatenate([model.table[d].sum(1), np.zeros((4, p.dim))])
    tops = [np.max([sum(x[i + j] @ k[j] for j in range(w)) + b for i in range(len(d) + 1)], axis=0) for w, k, b in zip(p.widths, model.kernels, model.biases)]
    logit = np.maximum(np.concatenate(tops), 0) @ model.out[:-1] + model.out[-1] + model.shift
    return 1 / (1 + np.exp(-logit)) >= model.thresholds.get(row["lang"], model.thresholds[""])


def one_of_each(rows):
    """All pairs."""
    labels = {r["doc_id"]: minhash.labelled(minhash.words_of(r["text"]), 5) for r in rows}
    root = {i: i for i in labels}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(labels), 2):
        if minhash.similarity(labels[a], labels[b], 0.8) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def template(text):
    """Words, and template tokens with the words they stand for, read one by one."""
    words, tokens, before = [], [], None
    for x in re.findall(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+", text or ""):
        low = x.lower()
        if x[0].isdigit():
            t = "<num>"
        elif before and before[0].isdigit() and low in dec.UNITS:
            t = "<unit>"
        elif low != x and len(x) > 1 and x[1:] == x[1:].lower():
            t = "<name>"
        else:
            t = low
        if t == "<name>" and tokens and tokens[-1][0] == t:
            tokens[-1][2] += 1
        else:
            tokens.append([t, len(words), len(words) + 1])
        words.append(low)
        before = x
    return words, [(t, lo, " ".join(words[lo:hi])) for t, lo, hi in tokens]


def starts(words, tokens):
    return [lo for _, lo, _ in tokens] + [len(words)]


def leaked(text, items):
    words, tokens = template(text)
    for item_words, item_tokens in items:
        met = []
        w = min(8, len(item_words))
        for i in range(len(words) - w + 1):
            met += [(i - j, j, j + w, ()) for j in range(len(item_words) - w + 1) if words[i : i + w] == item_words[j : j + w]]
        w = min(8, len(item_tokens))
        ends, item_ends = starts(words, tokens), starts(item_words, item_tokens)
        for i in range(len(tokens) - w + 1):
            for j in range(len(item_tokens) - w + 1):
                own, given = item_tokens[j : j + w], tokens[i : i + w]
                if [x[0] for x in own] == [x[0] for x in given] and sum(x[0][0] != "<" for x in own) >= min(4, w):
                    pairs = tuple((x[1], x[2], y[2]) for x, y in zip(own, given) if x[0][0] == "<")
                    met.append((ends[i] - item_ends[j], item_ends[j], item_ends[j + w], pairs))
        met.sort()
        while met:
            n = next((k for k in range(1, len(met)) if met[k][0] - met[k - 1][0] > dec.BAND), len(met))
            part, met = met[:n], met[n:]
            votes = {}
            for _, _, _, pairs in part:
                for p, x, y in pairs:
                    votes.setdefault((x, y), set()).add(p)
            good = {
                (x, y) for (x, y), v in votes.items()
                if (x, y) == min((k for k in votes if k[0] == x), key=lambda k: (-len(votes[k]), k[1])) == min((k for k in votes if k[1] == y), key=lambda k: (-len(votes[k]), k[0]))
            }
            covered = {q for _, lo, hi, pairs in part if all((x, y) in good for _, x, y in pairs) for q in range(lo, hi)}
            if covered and len(covered) >= min(0.5 * len(item_words), 13):
                return True
    return False


def test_pipeline_equals_plain_stages(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    rows = read("documents").collect()
    model = toxicity.fit(read("documents"), read("labels"))
    rows = [r for r in rows if not rejected(model, r)]
    rows = one_of_each(rows)
    items = [x for r in read("benchmark").collect() if (x := template(r["text"]))[0]]
    rows = [r for r in rows if not leaked(r["text"], items)]
    texts = {r["doc_id"]: pii.pseudonymise(r["text"])[0] for r in rows}
    with open(segmentation.MODEL, "rb") as f:
        voc = segmentation.vocabulary(f.read(), 1.0)
    want = {(i, k): s[0].tolist() for i, t in texts.items() for k, s in enumerate(segmentation.sample([t], [i], voc, segmentation.SampleParams())[0])}
    got = {(r["doc_id"], r["rank"]): r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(texts) > 100


def test_stages_keep_the_columns(spark, documents, odd):
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, documents(odd, extra=True), SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r["doc_id"] for r in out.collect()}
        assert {1, 3, 4, 6, 7, 8, 9, None} <= kept
        assert stage(spark, documents([]), SF).count() == 0
