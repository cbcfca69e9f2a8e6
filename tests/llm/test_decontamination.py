import re

from glanage.llm import decontamination as d

ITEM = "What is the total weight of seven boxes that weigh 12 kg each when Alice adds 12 more kg to the cart"


def found(spark, documents, docs, items):
    df = d.contamination(documents(docs, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_copies_and_parameters(spark, documents):
    other = ITEM.replace("12", "35").replace("Alice", "Bob")
    unequal = ITEM.replace("12", "35", 1)
    docs = [(1, f"Some words before. {ITEM} and some after."), (2, f"before {other} after"), (3, f"before {unequal} after"), (4, "nothing of the kind is in here at all, not a bit of it")]
    # In 3 both 12s of the item would have to be one number: windows that say otherwise drop out, the others are a copy.
    rows = d.contamination(documents(docs), spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["covered"], r["slots"]) for r in rows} == {(1, 22, 5), (2, 22, 5), (3, 21, 4)}


def test_inconsistent_slots(spark, documents):
    item = "if Ann gives Bob 3 of her 9 red pens then how many do Ann and Bob have when Bob had 3 red pens and Ann had 9 at first"
    same = item.replace("Ann", "Mary Jane").replace("Bob", "Al").replace("3", "4").replace("9", "11")
    fixed = same
    for old, new in (("Mary Jane had", "Sue had"), ("Al have", "Tim have"), ("Al had", "Zoe had"), ("how many do Mary Jane", "how many do Lee")):
        fixed = fixed.replace(old, new)
    mixed = "if Cat gives Cat 3 of her 3 red pens then how many do Cat and Cat have when Cat had 3 red pens and Cat had 3 at first"
    got = d.contamination(documents([(1, same), (2, fixed), (3, mixed)]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    got = {r["doc_id"]: r["covered"] for r in got}
    assert got[1] == 30 and got.get(2, 0) < 30 and got.get(3, 0) < 30


def test_items_rich_in_placeholders(spark, documents):
    sums = "Compute 12 + 15 + 27, 4 x 31 = 124 and 8 x 9 = 72"
    battle = "the battle of hastings was fought by william of normandy"
    items = [(1, sums), (2, battle.title()), (3, battle)]
    docs = [(1, f"see: {sums}."), (2, battle), (3, battle.upper()), (4, battle.title()), (5, "Compute 13 + 16 + 28, 5 x 32 = 125 and 9 x 10 = 73")]
    assert found(spark, documents, docs, items) == {(1, 1)} | {(i, j) for i in (2, 3, 4) for j in (2, 3)}


def test_names_of_other_lengths(spark, documents):
    item = "Ann paid 12 dollars to Bob and then Bob paid 5 dollars to Cy so that in the end Cy had what Ann had paid"
    other = item.replace("Ann", "Mary Jane").replace("Bob", "Bob Lee Ray").replace("12", "1,400").replace("5", "7")
    assert found(spark, documents, [(1, f"x. {other}"), (2, other.replace("Cy", "Ed"))], [(1, item)]) == {(1, 1), (2, 1)}


def test_words_put_in_or_left_out(spark, documents):
    import random

    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60))) for i in range(40)]
    docs = []
    for i, text in items:
        words = text.split()
        for at in sorted(rng.sample(range(60), 4), reverse=True):
            words[at : at + 1] = rng.choice(([], [words[at], "extra"]))
        docs.append((i, " ".join(["before"] * 30 + words + ["after"] * 30)))
    assert found(spark, documents, docs, items) == {(i, i) for i, _ in items}


def test_texts_under_one_id_and_passes(spark, documents, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", 7)
    half = ITEM.split()
    docs = [(1, " ".join(half[:9])), (1, " ".join(half[9:18])), (2, ITEM), (2, " ".join(half[:12]))]
    rows = d.contamination(documents(docs), spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["covered"]) for r in rows] == [(2, 22)]


def test_equal_templates_and_short_items(spark, documents):
    items = [(1, ITEM), (2, ITEM.replace("12", "99")), (2, ITEM.replace("12", "99")), (3, "only four words here"), (4, ""), (5, None), (6, "<>")]
    docs = [(1, "x " + ITEM.lower().replace("alice", "Carol")), (2, "yes only four words here indeed"), (3, "four words here only")]
    assert found(spark, documents, docs, items) == {(1, 1), (1, 2), (2, 3)}


def test_excerpts(spark, documents):
    item = " ".join("w" + "abcdefgh"[i % 8] * (i // 8 + 1) for i in range(60))
    words = item.split()
    docs = [(n, "before " + " ".join(words[20 : 20 + n]) + " after") for n in (7, 12, 13, 20)]
    assert found(spark, documents, docs, [(1, item)]) == {(13, 1), (20, 1)}


def test_odd_rows(spark, documents, odd):
    assert found(spark, documents, odd, [(1, ITEM)]) == set()
    assert found(spark, documents, [], [(1, ITEM)]) == set()
    assert found(spark, documents, odd, []) == set()
    long = "noise " * 5000 + ITEM + " noise" * 5000
    assert found(spark, documents, [(1, long), (1, long)], [(1, ITEM)]) == {(1, 1)}


def test_windows_by_brute_force(spark, documents):
    """Plain words only: an item counts if a stretch of half its words is in the text."""
    import random

    rng = random.Random(4)
    items = [(i, " ".join("w%s" % "abcdefghij"[rng.randrange(10)] + "xyz"[rng.randrange(3)] * rng.randrange(1, 5) for _ in range(20))) for i in range(6)]
    docs = []
    for j in range(40):
        words = ["q%s" % "klmnop"[rng.randrange(6)] * 2 for _ in range(30)]
        i, a = rng.randrange(6), rng.randrange(0, 12)
        n = rng.randrange(4, 21)
        docs.append((j, " ".join(words[:10] + items[i][1].split()[a : a + n] + words[10:])))
    want = set()
    for j, t in docs:
        words = re.findall(r"[a-z]+", t)
        for i, x in items:
            y = re.findall(r"[a-z]+", x)
            for shift in range(-len(y), len(words)):
                hit = [p for p in range(len(y)) if 0 <= p + shift < len(words) and words[p + shift] == y[p]]
                covered = {q for p in hit if all(p + k in hit for k in range(8)) for q in range(p, p + 8)}
                if len(covered) >= 10:
                    want.add((j, i))
    assert found(spark, documents, docs, items) == want


def test_plan_has_no_python(spark, documents):
    df = d.contamination(documents([(1, ITEM)]), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
