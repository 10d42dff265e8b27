"""The word encoder of the token-id files against the library on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from boutline.llm import repair

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def made(encoder, texts):
    return [list(memoryview(x).cast("I")) for x in encoder.encode(texts)]


def whole(library, texts):
    return [library.encode(t, add_special_tokens=False).ids for t in texts]


def fresh():
    with open(PATH, encoding="utf-8") as f:
        return repair.WordEncoder(f.read())


def test_ends_of_words_are_cut_off(library):
    """Only the runs of punctuation go through the whole tokenizer: words go by the letters before them, once each."""
    texts = ["hollow### hollow&&& Hollow,*** hollow.", "éclat%%% éclat$$$, éclat", "", "hollow###"]
    encoder, asked, letters = fresh(), [], []
    others, plain = encoder._others, encoder._letters
    encoder._others = lambda words: asked.extend(words) or others(words)
    encoder._letters = lambda words: letters.extend(words) or plain(words)
    assert made(encoder, texts) == whole(library, texts)
    assert sorted(asked) == sorted(["###", "&&&", ",***", ".", "%%%", "$$$,"])
    assert sorted(letters) == ["hollow", "éclat"]


def test_odd_texts_as_the_library(library, monkeypatch):
    """Added tokens, marks, control characters, letters with several lower-case forms, every kind of white space; and generations of few words."""
    parts = ["a", "Zoë", "don't", "x'", "'s", "İstanbul", "ΑΣ", "ﬁn", "é", "≠", "a≠", "a≮", "<|endoftext|>", "a<|endoftext|>b.", "x<|start", "_a_", "a_", "3rd", "²", "a²!", "٣", "漢字。", "漢字.", "…", "​", "a\x1cb", "\x1e", "a-b-", "(x)", "|", "{}", "`~", "퟿", "😀!", "w" * 300]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1d", "\x85", "\xa0", " ", " ", " ", " ", "　", ""]
    dice = random.Random(7)
    texts = ["".join(dice.choice(gaps) + dice.choice(parts) for _ in range(dice.randrange(1, 30))) for _ in range(600)]
    want = whole(library, texts)
    encoder = fresh()
    assert encoder.by_word
    assert made(encoder, texts) == want
    assert [made(encoder, [t])[0] for t in texts] == want
    monkeypatch.setattr(repair.WordEncoder, "BOUND", 20)
    few = fresh()
    assert [i for at in range(0, len(texts), 7) for i in made(few, texts[at : at + 7])] == want


def test_words_part_at_every_white_space():
    """Texts are cut by Arrow: at the characters where Python cuts."""
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not 0x1C <= c < 0x20]
    # none of these is lower-cased away: the letter beside them is what is looked at
    got = repair.WordEncoder.split([f"a{c}b" for c in signs]).to_pylist()
    assert [len(x) > 1 for x in got] == [c.isspace() for c in signs]


def test_block_with_rules_of_rules():
    """Documents of a block, one by one and together, whichever symbols they hold."""
    import numpy as np

    one = np.tile(np.array([5, 6, 7, 5, 6], "<u4"), 200)
    docs = [np.append(x, 1).astype("<u4").tobytes() for x in (one, one[:3], one[:0], one[7:90], np.array([1, 9, 1]))]
    block = repair.Block(repair.write_block(docs, 50))
    assert len(block.rules) and block.all() == docs
    assert [repair.Block(repair.write_block(docs, 50)).ids(k) for k in range(5)] == docs
