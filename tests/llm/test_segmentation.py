import math
from collections import Counter

import numpy as np
import pytest

from glanage.llm import segmentation as s

KEYS = range(3000)


@pytest.fixture(scope="module")
def voc():
    with open(s.MODEL, "rb") as f:
        return s.vocabulary(f.read(), 1.0)


def brute(text, voc):
    """Log-probability of every segmentation."""
    data = (s.MARK + text.replace(" ", s.MARK)).encode()
    ids = {p: i for i, p in enumerate(voc.pieces) if p and i not in set(voc.byte_ids.tolist())}
    out = {}

    def go(at, path, weight):
        if at == len(data):
            out[path] = weight
            return
        for end in range(at + 1, len(data) + 1):
            if (i := ids.get(data[at:end])) is not None:
                go(end, (*path, i), weight + voc.weight[i])

    go(0, (), 0.0)
    z = math.log(sum(math.exp(w) for w in out.values()))
    return {k: w - z for k, w in out.items()}


def test_samples_follow_the_distribution(voc):
    text, n = "the cat sat", len(KEYS)
    exact = brute(text, voc)
    p = {k: math.exp(v) for k, v in exact.items()}
    got = s.sample([text] * n, list(KEYS), voc, s.SampleParams(k=3))
    paths = [[tuple(x[0].tolist()) for x in row] for row in got]
    for row, found in zip(paths, got):
        assert len(set(row)) == 3
        assert found[0][2] > found[1][2] > found[2][2]
        assert all(abs(exact[k] - x[1]) < 1e-9 for k, x in zip(row, found))
    first, second = Counter(r[0] for r in paths), Counter(r[1] for r in paths)
    for k in sorted(p, key=p.get)[-4:]:
        assert abs(first[k] / n - p[k]) < 4 * math.sqrt(p[k] / n) + 0.002
        want = sum(p[j] * p[k] / (1 - p[j]) for j in p if j != k)
        assert abs(second[k] / n - want) < 4 * math.sqrt(want / n) + 0.002
    # Weighted by their inclusion scores, samples estimate sums without bias.
    assert abs(np.mean([sum(math.exp(x[1]) / x[3] for x in row) for row in got]) - 1) < 0.05


def test_all_segmentations_of_a_short_text(voc):
    exact = brute("ab", voc)
    (row,) = s.sample(["ab"], [1], voc, s.SampleParams(k=50))
    assert {tuple(x[0].tolist()) for x in row} == set(exact) and all(x[3] == 1.0 for x in row)


def test_seed_and_batches(voc):
    texts = ["some words here", "another text, longer than the first", "é✨ \n\t mixed 漢字龘", "x" * 300]
    alone = [s.sample([t], [i], voc, s.SampleParams())[0] for i, t in enumerate(texts)]
    together = s.sample(texts, list(range(4)), voc, s.SampleParams())
    for a, b in zip(alone, together):
        assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
    other = s.sample(texts, list(range(4)), voc, s.SampleParams(seed=99))
    assert any(a[0][0].tolist() != b[0][0].tolist() for a, b in zip(together, other))


@pytest.mark.parametrize("text", ["a", " ", "  two  blanks ", "tab\tline\n", "漢字龘✨", "no▁mark", "\0null\0byte"])
def test_round_trip(voc, text):
    for x in s.sample([text], [1], voc, s.SampleParams(k=4))[0]:
        assert voc.decode(x[0].tolist()) == text.replace(s.MARK, " ")
        (spelled,) = voc.spelled(x[0], np.array([0, len(x[0])]))
        assert spelled == (s.MARK + text).replace(" ", s.MARK).encode()


def test_pieces_are_the_tokenizers_own(voc):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=s.MODEL)
    for x in s.sample(["the quick brown fox"], [3], voc, s.SampleParams(k=3))[0]:
        assert sp.decode(x[0].tolist()) == "the quick brown fox"


def test_odd_rows(documents, odd):
    got = s.segmentations(documents(odd, extra=True)).collect()
    counts = Counter(r["doc_id"] for r in got)
    assert counts[1] == counts[2] == 0 and counts[4] == 4 and counts[None] == 2 and counts[6] == 2
    assert all(r["round_trip"] for r in got)
    same = [(r["rank"], r["ids"]) for r in got if r["doc_id"] == 4]
    assert sorted(same)[0] == sorted(same)[1]
    assert s.segmentations(documents([])).count() == 0


def test_known_words_are_not_worked_out_again(voc, monkeypatch):
    built, plain = [], s.Lattice
    monkeypatch.setattr(s, "Lattice", lambda words, voc: built.extend(words) or plain(words, voc))
    lat = s.Lattices(voc)
    s.sample(["some words here", "words"], [1, 2], voc, s.SampleParams(), lat)
    s.sample(["here are some words", "some"], [3, 4], voc, s.SampleParams(), lat)
    assert sorted(built) == sorted((s.MARK + w).encode() for w in ("some", "words", "here", "are"))


@pytest.mark.parametrize("most", [0, 300, 2000, s.KEPT])
def test_kept_lattices_change_no_sample(voc, most):
    lat = s.Lattices(voc, most)
    for block in range(30):
        texts = [" ".join(f"w{(block * i) % 37} common{i % 5} é✨{i}" for i in range(n)) for n in (0, 1, 7, 40)] + ["", None, "  two  blanks ", "\0null\0byte"]
        keys = [block * 10 + i for i in range(len(texts))]
        for a, b in zip(s.sample(texts, keys, voc, s.SampleParams(), lat), s.sample(texts, keys, voc, s.SampleParams())):
            assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b]
            assert np.allclose([x[1:] for x in a], [x[1:] for x in b], atol=1e-9)
