import re

import pytest

from glanage.llm import licenses as li


@pytest.fixture(scope="module")
def scanner():
    return li.Scanner()


def plain_base(text):
    words = li.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [(p, i) for p in li.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]


@pytest.mark.parametrize("text", ["MIT License MIT License", "the mit-license; Apache\nLicense", "general public license general public", "émit license mit licenses", "mit  license é mit license", ""])
def test_base(scanner, text):
    assert scanner.scan(text)[:2] == plain_base(text)


def distance(pattern, text):
    """Least edits between the pattern and a stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("edits", range(6))
def test_fuzzy_equals_brute_force(scanner, edits):
    import random

    rng = random.Random(edits)
    for notice, label in li.NOTICES:
        t = list(notice)
        for _ in range(edits):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice(([], [t[at], "q"], ["q"]))
        text = f"zzz {''.join(t)} zzz"
        joined = " ".join(text.split())
        want = {i for i, (n, _, k) in enumerate(scanner.notices) if distance(n, joined) <= k}
        found = scanner.fuzzy(joined)
        assert {f[0] for f in found} == want
        for i, a, b, e in found:
            assert e <= scanner.notices[i][2] and distance(scanner.notices[i][0], joined[a:b]) <= e


def test_spans(scanner):
    text = "Intro. Licensd under the Apache-License,  Version 2.0! Outro"
    (f,) = scanner.scan(text)[2]
    assert text[f.start : f.stop] == "Licensd under the Apache-License,  Version 2.0" and f.edits == 1 and (f.first, f.last) == (1, 8)


def test_odd_rows(documents, odd):
    rows = [*odd, (30, "Released under the MIT License."), (31, "x " * 20000 + "apache license")]
    got = {r["doc_id"]: r for r in li.license_scan(documents(rows, extra=True)).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (0, 0, None, "", 0.0)
    assert got[7]["n_words"] == 0 and got[30]["base_labels"] == "mit" and got[30]["score"] == 1.0
    assert got[31]["first_word"] == got[31]["last_word"] == 20000
    assert li.license_scan(documents(odd)).count() == len(odd) and li.license_scan(documents([])).count() == 0


def test_edited_lines_before_a_better_one(scanner):
    edited, exact = "released under the mit lisense", "released under the mit license"
    finds = [f for f in scanner.fuzzy(" ".join([edited] * 5 + [exact] + [edited] * 2)) if f[0] == 0]
    assert [f[3] for f in finds] == [1] * 5 + [0] + [1] * 2
    assert all(a[2] <= b[1] for a, b in zip(finds, finds[1:]))


def edited(rng, notice, edits):
    """The notice with letters replaced, at places apart."""
    t = list(notice)
    for at in rng.sample([i for i in range(2, len(t) - 2) if t[i] != " "], edits):
        t[at] = "q"
    return "".join(t)


def test_adjacent_notices_in_any_order(scanner):
    import random

    rng = random.Random(2)
    for i, (notice, _, k) in enumerate(scanner.notices):
        for gap in (" ", " and "):
            edits = [rng.randrange(k + 1) for _ in range(12)]
            finds = [f for f in scanner.fuzzy(gap.join(edited(rng, notice, e) for e in edits)) if f[0] == i]
            assert len(finds) == len(edits) and all(f[3] <= e for f, e in zip(finds, edits)), (notice, edits, finds)
            assert all(a[2] <= b[1] for a, b in zip(finds, finds[1:]))


def test_two_copies_of_which_one_is_edited(scanner):
    for a, b in (("licensd under the mit license", "licensed under the mit license"), (li.NOTICES[2][0].replace("hereby", "herebi"), li.NOTICES[2][0])):
        for text in (f"{a} {b}", f"{b} {a}"):
            spans = [f for f in scanner.scan(text)[2] if f.label == "mit" and f.size == len(b)]
            assert sorted(f.edits for f in spans) == [0, 1]


def test_many_hits_take_linear_time():
    import time

    for line in ("mit license ", "licensed under the mit license "):
        scanner = li.Scanner()
        start = time.perf_counter()
        n, base, found = scanner.scan(line * 80_000)
        assert len(base) == 80_000 and base[-1][1] == n - 2
        assert (time.perf_counter() - start) < (1.5 if line.startswith("mit") else 12)
