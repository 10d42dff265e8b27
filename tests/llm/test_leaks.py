"""Decontamination against a brute-force walk over every window of the item's length."""

import random

from test_queries import plain_leaks

from boutline.llm import decontaminate


def found(spark, docs, items):
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    i = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {(r["id"], r["item"]): round(r["similarity"], 6) for r in decontaminate.find_leaks(spark, d, i).collect()}


def edited(n, ends, inserted):
    """An item of n words, and it with `ends` words changed at both ends and `inserted` words put into the middle, in other prose."""
    item = [f"w{k}" for k in range(n)]
    body = [f"x{k}" for k in range(ends)] + item[ends : n // 2] + [f"y{k}" for k in range(inserted)] + item[n // 2 : n - ends] + [f"z{k}" for k in range(ends)]
    return " ".join(item), " ".join([f"before{k}" for k in range(150)] + body + [f"after{k}" for k in range(150)])


def test_window_between_seeded_starts(spark):
    (a, in_a), (b, in_b), (c, in_c) = edited(100, 3, 6), edited(200, 8, 16), edited(400, 18, 36)
    b, in_b, c, in_c = (t.replace("w", p) for t, p in ((b, "bw"), (in_b, "bw"), (c, "cw"), (in_c, "cw")))
    docs, items = {1: in_a, 2: in_b, 3: in_c}, {10: a, 20: b, 30: c}
    got = found(spark, docs, items)
    assert got == plain_leaks(docs, items)
    assert {k: round(v, 3) for k, v in got.items()} == {(1, 10): 0.811, (2, 20): 0.815, (3, 30): 0.817}


def test_windows_of_random_texts(spark):
    """Few words, so that shingles repeat in items and documents; windows over both edges; items shorter than a shingle."""
    rng = random.Random(3)
    text = lambda n: [rng.choice("abc") for _ in range(n)]
    items = {k: text(rng.choice([1, 2, 3, 4, 5, 6, 9, 14, 30])) for k in range(40)}
    docs = {}
    for d in range(60):
        body = list(items[rng.randrange(40)])
        for _ in range(rng.randrange(3)):
            body.insert(rng.randrange(len(body) + 1), rng.choice("abc"))
        docs[d] = (text(rng.randrange(12)) + body + text(rng.randrange(12)))[rng.randrange(3) :]
    docs, items = ({k: " ".join(v) for k, v in x.items()} for x in (docs, items))
    got = found(spark, docs, items)
    assert got and {p for p in got} == plain_leaks(docs, items).keys()
    assert got == plain_leaks(docs, items)


def test_repeats_move_many_bits(spark):
    """A run of one word is another one in the passage: over 0.8 alike by weight, and far apart as SimHashes."""
    words = [f"w{k}" for k in range(164)]
    items = {n: " ".join(words + [f"run{n}"] * 18) for n in range(8)}
    docs = {n: " ".join(["before"] * 9 + words + ["other"] * 18 + ["after"] * 9) for n in range(1)}
    got = found(spark, docs, items)
    assert len(got) == 8 and got == plain_leaks(docs, items)
