"""Byte-level BPE against the rank file's own library, offsets against the tokenizers library's, and decoding of split characters."""

import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from boutline.llm import bytebpe, queries

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def made_of(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def library(file):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.parse_ranks(file), special_tokens={})


@pytest.fixture(scope="module")
def made():
    return bytebpe.rebuild(made_of(FILES[0]), public_tokenizers.PATTERN)


def test_query_equals_the_library(spark, small, documents):
    plain = library(made_of(FILES[0]))
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op11_bytebpe"](spark, small).collect()}
    assert set(got) == set(documents)
    for i, text in documents.items():
        ids = plain.encode_ordinary(text or "")
        r = got[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() and r["round_trip"]
    assert sum(r["split_chars"] for r in got.values()) > 0


@pytest.mark.parametrize("name", FILES)
def test_every_character_and_hard_runs(name):
    """All assigned characters beside letters, digits, spaces and themselves; runs in which equal ranks overlap."""
    file = made_of(name)
    plain, own = library(file), bytebpe.Coder(bytebpe.rebuild(file, public_tokenizers.PATTERN))
    chars = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) != "Cs"] + [chr(c) for c in range(0x3000, 0x110000, 61) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}2 {c}! {c}{c}  {c}x\n{c} " for c in chars]
    texts += ["a" * n for n in range(1, 40)] + [" " * n + "x" for n in range(1, 40)] + ["=-" * 3000, "\n" * 500, "<|endoftext|>", "ab" * 100_000, "it's we'll I'D 'tis"]
    assert own.ids(texts) == [plain.encode_ordinary(t) for t in texts]
    assert all(own.joined(ids) == t.encode() for t, ids in zip(texts, own.ids(texts)))


def test_unreachable_tokens_and_gaps():
    """A token that no merge makes is found when it is a whole match; a rank file without some byte is refused."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"abab": 258}
    import base64

    file = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    own, plain = bytebpe.Coder(bytebpe.rebuild(file, public_tokenizers.PATTERN)), library(file)
    texts = ["xyz", "xyzxyz", "abab", "ababab", " xyz", "aab"]
    assert own.ids(texts) == [plain.encode_ordinary(t) for t in texts] and own.ids(["xyz"]) == [[257]]
    with pytest.raises(ValueError):
        bytebpe.rebuild(file.split(b"\n", 1)[1], public_tokenizers.PATTERN)


TEXTS = ["", "plain words, 12 of them", "É ß 東京 🙂 tail", "🙂🙂𝔘ñ́ x", "  two  spaces \n\t end ", "꙳ꙮ﻿z"]


def test_encode_and_decode(spark, made):
    rows = [(n, t, "kept", [1], "x") for n, t in enumerate([*TEXTS, None])] + [(1, TEXTS[1], "kept", [1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, ids array<int>, spans string")
    coded = bytebpe.encode(docs, made, offsets="spans")
    assert coded.columns == docs.columns
    own, theirs = bytebpe.Coder(made), Tokenizer.from_str(made)
    got = coded.collect()
    assert len(got) == len(rows) and all(r["extra"] == "kept" for r in got)
    for r in got:
        text = r["text"] or ""
        e = theirs.encode(text, add_special_tokens=False)
        assert (list(r["ids"]), [tuple(s) for s in r["spans"]]) == (e.ids, e.offsets)
        assert all(own.joined([i]).decode("utf-8", "ignore") in text[a:b] for i, (a, b) in zip(r["ids"], r["spans"]))
    back = bytebpe.decode(coded, made, raw="raw", pieces="spans").collect()
    for r in back:
        want = dict((n, t) for n, t, *_ in rows)[r["doc_id"]] or ""
        assert (r["text"], bytes(r["raw"]), "".join(r["spans"]), len(r["spans"])) == (want, want.encode(), want, len(r["ids"]))
    empty = bytebpe.encode(docs.limit(0), made, offsets="spans")
    assert empty.count() == 0 and bytebpe.decode(empty, made).count() == 0 and bytebpe.id_digest(docs.limit(0), made).count() == 0


def test_decode_of_odd_ids(spark, made):
    own = bytebpe.Coder(made)
    smile = own.ids(["🙂"])[0]
    assert len(smile) > 1
    rows = [(1, None), (2, []), (3, [None, 10**6, -5, *own.ids(["ok"])[0]]), (4, smile[:-1]), (5, [*smile[:-1], *own.ids(["a"])[0]]), (6, smile)]
    got = {r["n"]: r for r in bytebpe.decode(spark.createDataFrame(rows, "n long, ids array<int>"), made, raw="raw", pieces="pieces").collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 6)] == ["", "", "ok", "🙂"] and bytes(got[4]["raw"]) == "🙂".encode()[: len(own.joined(smile[:-1]))]
    assert got[4]["text"].strip("�") == "" and got[5]["text"].endswith("a") and "�" in got[5]["text"]
    assert list(got[6]["pieces"]) == [""] * (len(smile) - 1) + ["🙂"] and all("".join(r["pieces"]) == r["text"] for r in got.values())


def test_digest_of_odd_rows(spark, made):
    docs = spark.createDataFrame([(None, "a b", "x"), (1, None, "x"), (1, None, "x"), (2, "", "x"), (2, "東", "x")], "doc_id long, text string, id string")
    got = sorted(((str(r["id"]), r["n_tokens"], r["round_trip"]) for r in bytebpe.id_digest(docs, made).collect()))
    n = len(bytebpe.Coder(made).ids(["東"])[0])
    assert got == [("1", 0, True), ("1", 0, True), ("2", 0, True), ("2", n, True), ("None", 2, True)]
