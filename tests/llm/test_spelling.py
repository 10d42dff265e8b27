"""Spelling variants against SQL and against all pairs, tries against plain comparison, odd rows."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boutline.llm import queries, spelling
from test_queries import same_as_sql

DATA = "/root/testdata"


def plain_apart(a, b):
    """By all edits of a."""
    letters = sorted({*a, *b})
    made = {a[:k] + a[k + 1 :] for k in range(len(a))} | {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in letters} | {a[:k] + c + a[k + 1 :] for k in range(len(a)) for c in letters}
    return a != b and b in made


def plain(counts, least=5, times=5):
    words = {w: n for w, n in counts.items() if n >= least}
    out = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and plain_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= times * n else None, n, len(near)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row += [root, words.get(row[0])]
    return {(w, form, root, n, near, form_n) for w, (form, n, near, root, form_n) in out.items()}


def found(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("scale", ["small", f"{DATA}/sf0.01"])
def test_query_equals_sql(spark, small, scale):
    sf_dir = small if scale == "small" else scale
    got = [r.asDict() for r in queries.QUERIES["op13_spelling"](spark, sf_dir).collect()]
    same_as_sql(got, "op13_spelling", sf_dir, "documents")
    assert sum(r["form"] is not None for r in got) > 20 and any(r["root"] not in (r["word"], r["form"]) for r in got) or scale == "small"


def test_query_equals_all_pairs(spark, small, documents):
    counts = Counter()
    for i, text in documents.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = "".join(c for k, c in enumerate(run) if k != h % len(run))
            if len(run) >= 6:
                counts[run] += 1
    assert found(queries.QUERIES["op13_spelling"](spark, small)) == plain(counts)


WORDS = st.text("abé", min_size=0, max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.sets(WORDS.filter(bool), max_size=40), WORDS)
def test_trie_equals_all_edits(words, word):
    words = sorted(words)
    trie = spelling.Trie(words, list(range(len(words))))
    assert [trie.word(k) for k in range(len(words))] == words
    assert {trie.word(k) for k in trie.near(word)} == {w for w in words if plain_apart(word, w)}
    assert all(spelling.one_apart(word, w) == plain_apart(word, w) for w in words)


def test_shards_groups_chains_and_ties(spark):
    """Small shards and one shard a group give the same as one trie; forms are followed over several steps; ties go to the first word."""
    rows = [("abcdef", 9000), ("abcdeg", 1500), ("abcdegh", 200), ("abcdeghi", 30), ("abcdeghij", 5), ("zbcdef", 9000), ("xbcdef", 100), ("lonely", 7), ("rarely", 4), ("rarelyx", 6)]
    rows += [("word" + a + b, 5 + k) for k, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "stuvwxyzé")] + [("lonely", 1), (None, 50), ("", 50), ("é" * 3000, 5), ("é" * 2999, 25)]
    words = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "word string, n long, form string, root string, trie string")
    counts = Counter()
    for w, n in rows:
        if w:
            counts[w] += n
    want = plain(counts)
    by_word = {r[0]: r for r in want}
    assert by_word["abcdeghij"][2] == "abcdef" and by_word["xbcdef"][1] == "abcdef" and by_word["é" * 3000][1] == "é" * 2999
    for options in ({}, {"shard": 7, "group": 1}, {"shard": 3, "group": 5000}):
        assert found(spelling.variants(spark, words, **options)) == want
    assert spelling.variants(spark, words.limit(0)).count() == 0


def test_counts_of_odd_rows(spark):
    rows = [(1, "Banana BANANA banana, bananaÉ bananaé été"), (1, "Banana"), (None, "banana"), (2, None), (3, ""), (4, "×÷×÷×÷ ÿÀÿÀÿÀ short ſſſſſſ İstanbul K kelvin")]
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, id string, n string")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()}
    assert got == {"banana": 5, "bananaÉ": 1, "bananaé": 1, "×÷×÷×÷": 1, "ÿÀÿÀÿÀ": 1, "stanbul": 1, "kelvin": 1}
    slips = {r["word"]: r["n"] for r in spelling.word_counts(docs.where("doc_id IS NULL"), slip_every=1).collect()}
    assert slips == {} and spelling.word_counts(docs.limit(0)).count() == 0
    long = {r["word"]: r["n"] for r in spelling.word_counts(docs.where("doc_id IS NULL"), slip_every=1, least_length=5).collect()}
    h = zlib.crc32(b":banana") % 6
    assert long == {"banana"[:h] + "banana"[h + 1 :]: 1}
