"""Empty tables, nulls in any column, repeated rows and clashing names: each operator's defined result."""

import pytest
from pyspark.sql import functions as F

from boutline.llm import decontaminate, embeddings, hilbert, quality, queries, repair, secrets, sentencepieces, simhash, suffixes, toxicity
from boutline.llm.components import connected_components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, fp string, rep string, component string, spans string, hit string, item string, w string, carry string, found string, owner string, class string, h string, p string, label string, y string, kept_id string, known string, fresh string, size string, place string"
EXTRA = ["x"] * (SHAPE.count(",") - 4)
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, *rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SHAPE)


def odd(spark):
    a, b = (1, "some words are here now", "en", "web", 3), (None, None, None, None, None)
    return frame(spark, a, a, b, b, (2, None, None, "web", None), (3, "", "de", None, 0), (None, "some words are here now", "en", "web", 1))


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], LABELS)
    items = spark.createDataFrame([(1, "some words are here now"), (2, None), (3, ""), (None, "x"), (4, "hi")], "item_id long, text string")
    piece, tok = sentencepieces.load(spark, queries.SENTENCEPIECE_MODEL), sentencepieces.load(spark, queries.TOKENIZER).decode()
    return {
        "toxicity": lambda d: toxicity.toxicity(spark, d, labels),
        "secrets": lambda d: secrets.scan_secrets(spark, d),
        "simhash": lambda d: simhash.near_duplicates(spark, d),
        "repair": lambda d: repair.encode_corpus(spark, d, tok),
        "quality": lambda d: quality.quality(spark, d, labels),
        "hilbert": lambda d: hilbert.shard_documents(spark, d),
        "suffixes": lambda d: suffixes.remove_repeats(spark, d),
        "pieces": lambda d: sentencepieces.id_digest(d, piece),
        "leaks": lambda d: decontaminate.find_leaks(spark, d, items),
    }, {
        "toxic": lambda d: toxicity.without_toxic(d, labels),
        "near": lambda d: simhash.without_near_duplicates(spark, d),
        "leaks": lambda d: decontaminate.without_leaks(spark, d, items),
        "redact": lambda d: secrets.redact_documents(spark, d),
        "encode": lambda d: sentencepieces.encode(d, piece, out="ids", decoded="decoded"),
    }


@pytest.mark.parametrize("name", ["toxicity", "secrets", "simhash", "repair", "quality", "hilbert", "suffixes", "pieces", "leaks"])
def test_tables(spark, name):
    run = operators(spark)[0][name]
    assert run(frame(spark)).count() == 0
    got = run(odd(spark)).collect()
    assert len(got) == (2 if name == "leaks" else 7)


def test_values_of_the_odd_rows(spark):
    """What each operator returns for the rows of `odd`, by value: the text twice under id 1, and once without an id; null texts twice without an id, once under 2;
    the empty text under 3."""
    run = {name: [r.asDict(recursive=True) for r in f(odd(spark)).collect()] for name, f in operators(spark)[0].items()}
    rows = lambda name, *columns: sorted(((str(r["id"]), *(r[c] for c in columns)) for r in run[name]), key=str)
    n = len("some words are here now")
    assert rows("toxicity", "clauses", "top") == sorted([("1", 0, 0.0)] * 2 + [("2", 0, 0.0), ("3", 0, 0.0)] + [("None", 0, 0.0)] * 3, key=str) and len({r["score"] for r in run["toxicity"]}) == 1
    assert rows("quality", "score", "distance") == sorted([("1", 0.5, 0.0)] * 2 + [("2", 0.5, 0.0), ("3", 0.5, 0.0)] + [("None", 0.5, 0.0)] * 3, key=str)
    assert rows("secrets", "spans") == sorted([("1", [])] * 2 + [("2", []), ("3", [])] + [("None", [])] * 3, key=str)
    fp = simhash.fingerprint("some words are here now")
    fp -= (fp >> 63) << 64
    assert rows("simhash", "fp", "component") == sorted([("1", fp, 1)] * 2 + [("2", 0, 2), ("3", 0, 2), ("None", fp, 1)] + [("None", 0, 2)] * 2, key=str)
    tokens = {r["n_tokens"] for r in run["repair"] if r["id"] == 1}.pop()
    assert rows("repair", "n_tokens") == sorted([("1", tokens)] * 2 + [("2", 1), ("3", 1), ("None", 1), ("None", 1), ("None", tokens)], key=str)
    assert sorted(r["start"] for r in run["repair"] if r["id"] is not None) == [tokens + 2, 2 * tokens + 2, 3 * tokens + 2, 3 * tokens + 3] and rows("repair", "start")[2][1] == 3 * tokens + 2
    assert rows("hilbert", "size") == sorted([("1", n + 8)] * 2 + [("2", 8), ("3", 8), ("None", 8), ("None", 8), ("None", n + 8)], key=str)
    assert all(r["slot"] == 0 for r in run["hilbert"]) and len({r["shard"] for r in run["hilbert"]}) == 7 and len({(r["size"], r["curve"]) for r in run["hilbert"]}) == 2
    assert rows("suffixes", "n_bytes", "n_removed", "n_spans") == sorted([("1", n, 0, 0)] * 2 + [("2", 0, 0, 0), ("3", 0, 0, 0), ("None", 0, 0, 0), ("None", 0, 0, 0), ("None", n, 0, 0)], key=str)
    pieces = {r["n_tokens"] for r in run["pieces"] if r["id"] == 1}.pop()
    assert rows("pieces", "n_tokens", "round_trip") == sorted([("1", pieces, True)] * 2 + [("2", 0, True), ("3", 0, True), ("None", 0, True), ("None", 0, True), ("None", pieces, True)], key=str)
    assert rows("leaks", "item", "similarity", "start", "hamming") == sorted([("1", 1, 1.0, 0, 0), ("None", 1, 1.0, 0, 0)], key=str)


def test_ties_and_rows_that_share_an_id(spark):
    """Equal windows: the first counts. Equal ids with different texts: each row has the result of its own text, and neither removes the other's bytes."""
    item = " ".join(f"w{k}" for k in range(30))
    got = decontaminate.find_leaks(spark, frame(spark, (1, f"a b {item} c d {item}", "en", "s", 1)), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["start"], r["similarity"]) for r in got] == [(2, 1.0)]
    one, other = "x" * 150, "y" * 120 + "x" * 130
    got = suffixes.remove_repeats(spark, frame(spark, (5, one, "en", "s", 1), (5, other, "en", "s", 1), (6, other, "en", "s", 1))).collect()
    assert sorted((r["id"], r["n_bytes"], r["n_removed"]) for r in got) == [(5, 150, 149), (5, 250, 129 + 119), (6, 250, 250)]
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], LABELS)
    docs = frame(spark, *((k, "you idiot." if k % 2 else "a plain text.", "en", "s", 1) for k in range(40)), (50, "you idiot.", "en", "s", 1), (50, "a plain text.", "en", "s", 1), (51, "you idiot.", "en", "s", 1))
    scores = {}
    for r in toxicity.toxicity(spark, docs, labels).collect():
        scores.setdefault(r["id"], []).append(r["score"])
    assert len(set(scores[50])) == 2 and scores[51][0] in scores[50] and max(scores[50]) == scores[51][0]


@pytest.mark.parametrize("name, left", [("toxic", 7), ("near", 2), ("leaks", 4), ("redact", 7), ("encode", 7)])
def test_filters(spark, name, left):
    run = operators(spark)[1][name]
    assert run(frame(spark)).count() == 0
    d = odd(spark)
    got = run(d)
    assert got.columns[: len(d.columns)] == d.columns
    assert got.count() == left


def test_embeddings(spark):
    shape = "vec_id long, embedding array<float>, label int, id string, rep string, code string, vec string"
    assert embeddings.near_duplicates(spark, spark.createDataFrame([], shape)).count() == 0
    v = [1.0, 2.0, 3.0]
    data = [(1, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (4, None, 1), (5, v, None), (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 1.0, 1.0], 1), (8, [], 1), (9, v, 2)]
    got = embeddings.near_duplicates(spark, spark.createDataFrame([(*r, "x", "x", "x", "x") for r in data], shape))
    assert sorted((r["id"] or 0, r["n_links"], r["component"] or 0) for r in got.collect()) == [(0, 0, 0), (1, 2, 1), (2, 2, 1), (2, 2, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9)]


def test_large_bucket_is_cut(spark):
    """More near vectors than a block holds: each links with all others."""
    n = 60
    data = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(1.0), F.col("id") / 1e6).alias("embedding"), F.lit(1).alias("label"))
    got = embeddings.near_duplicates(spark, data, block=8).collect()
    assert {(r["n_links"], r["component"]) for r in got} == {(n - 1, 0)}


def test_components(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = connected_components(spark, spark.createDataFrame(chain, "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


def test_redaction_keeps_copied_examples(spark):
    docs = frame(spark, *((k, f"token=sharedexample123 and password=ownsecret{k}xyz", "en", f"s{k}", 1) for k in range(4)))
    got = [r["text"] for r in secrets.redact_documents(spark, docs).collect()]
    assert sorted(got) == ["token=sharedexample123 and <SECRET>"] * 4


def test_rows_that_share_an_id_are_spread_over_blocks(spark, tmp_path):
    """A third of the rows without an id, a third under one: no task writes them all, and the digests are those of their texts, in order."""
    tok = sentencepieces.load(spark, queries.TOKENIZER).decode()
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, 5_000).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts as small as these would be put together
    try:
        blocks = repair.write_ids(spark, docs, tok, f"file://{tmp_path}/blocks")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["n"] for r in blocks.groupBy("part").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(parts) == 900 and len(parts) >= 6 and max(parts) < 250
    got = repair.read_digest(blocks).orderBy("start").collect()
    assert [r["id"] for r in got] == [None] * 300 + [*range(0, 900, 3)] + [5000] * 300
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_blocks_decode_one_document():
    import numpy as np

    rng = np.random.default_rng(1)
    docs = [np.r_[rng.choice([7, 8, 9, 500], n), 1].astype("<u4") for n in (0, 5, 4000, 1, 900)]
    block = repair.Block(repair.write_block([d.tobytes() for d in docs], 600))
    assert len(block.rules) > 10
    for k, d in enumerate(docs):
        assert (block.document(k) == d).all() and block.start(k) == sum(map(len, docs[:k]))


def test_hilbert_neighbours(spark):
    """The curve visits each cell once, and next cells differ by one in one coordinate."""
    bits, n = 3, 8
    cells = spark.range(n**3).select(*((F.floor(F.col("id") / n**k) % n).cast("int").alias(c) for k, c in enumerate("xyz")))
    got = cells.select("*", hilbert.hilbert_index([F.col(c) for c in "xyz"], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in got] == list(range(n**3))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(got, got[1:]))
