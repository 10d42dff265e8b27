"""Token-id files with Re-Pair grammar compression.

A block holds the ids of a run of documents.  Frequent id pairs are replaced by nonterminals, round after round until none is frequent; the block keeps
the rules, each rule's expansion length, and where each document's symbols begin, so a document is decoded without the others.  No pair reaches over the
end id, so documents begin at symbols.  Symbols, terminals included, take 16 bits where vocabulary and rules fit, else 32.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from boutline.llm.arrows import SLICE, cut_at
from boutline.llm.bytebpe import byte_table
from boutline.llm.scratch import Scratch

END = 1
MAGIC = b"RPG1"
HEADER = struct.Struct("<4sIIIQ")
#: Unicode's white space, where the tokenizer cuts and nothing is kept.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")


#: The pattern of the tokenizers that cut texts at white space, keep runs of letters whole and lower-case first.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Punctuation that ends words: behind a letter or digit a run of it is a token of its own.  The apostrophe, which begins tokens of its own, isn't in it.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What lower-cases in one way only, letter by letter: ASCII and the Latin letters but the dotted capital I.
PLAIN = re.compile("[\x00-\x7f\u00a1-\u00bf\u00c0-\u012f\u0131-\u017e]*")
#: A character between words that are encoded together.
MARK = "\x1e"


def joins_no_words(tok: Tokenizer) -> bool:
    """Whether a tokenizer drops white space, lets nothing reach over it, and cuts letters and punctuation apart, by what its parts say of themselves."""
    if tok.normalizer is None or tok.pre_tokenizer is None or not isinstance(tok.model, models.BPE):
        return False
    normal, cut = (json.loads(part.__getstate__()) for part in (tok.normalizer, tok.pre_tokenizer))
    split, *rest = cut.get("pretokenizers", [cut])
    whole = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split.get("pattern") == {"Regex": WORD_PATTERN}
    bytes_only = rest == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    steps = [n["type"] for n in normal.get("normalizers", [normal])]
    return bool(whole and bytes_only and steps == ["NFC", "Replace", "Lowercase"] and tok.model.end_of_word_suffix and not tok.model.dropout)


class WordEncoder:
    """Whole texts to id bytes.  With a tokenizer that never joins over white space each word is encoded once by the library and kept, in two generations
    of BOUND words; any other tokenizer gets whole texts."""

    BOUND = 400_000

    def __init__(self, tokenizer: str):
        self.tok = Tokenizer.from_str(tokenizer)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.by_word = joins_no_words(self.tok)
        self.words: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        if self.by_word:
            suffix = self.tok.model.end_of_word_suffix
            self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
            self.ends[[n for t, n in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
            alone = self.tok.encode(MARK, add_special_tokens=False).ids
            self.mark = alone[0] if len(alone) == 1 else None
            # lower-case words of letters need no normaliser, and white space is all that cuts them; both tokenizers share one model
            self.bare = Tokenizer(self.tok.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            #: How bytes are spelt in the vocabulary; the space stays, as it only parts words here.
            self.spelt = {b: c for b, c in enumerate(byte_table()) if b != 32}
            #: What ends words, without what an added token holds, as those are found before texts are cut.
            self.tail = "".join(c for c in TAIL if not any(c in t.content for t in self.tok.get_added_tokens_decoder().values()))

    @staticmethod
    def split(texts: list[str]) -> pa.ListArray:
        """The words of each text, with the same ids as the text: lower-cased where that is safe.  There may be empty ones."""
        lower = [t.lower() if t.isascii() or PLAIN.fullmatch(t) else t for t in texts]
        if any(map(ODD_SPACE.search, lower)):
            return pa.array([SPACE.split(t) for t in lower], pa.list_(pa.string()))
        return pc.utf8_split_whitespace(pa.array(lower, pa.string()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        collects = gc.isenabled()
        gc.disable()  # what is made here holds no cycles, and the collector would walk the kept words again and again
        try:
            return self._by_word(texts)
        finally:
            if collects:
                gc.enable()

    def _by_word(self, texts: list[str]) -> list[bytes]:
        split = self.split(texts)
        coded = split.flatten().dictionary_encode()
        found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > self.BOUND:
            self.old, self.words = self.words, {"": b""}
        known = list(map(self.words.get, found))
        new = [k for k, ids in enumerate(known) if ids is None]
        if new:
            self._learn([found[k] for k in new])
            for k in new:
                known[k] = self.words[found[k]]
        # the words' ids one behind the other, and from there those of each place in the texts
        pool = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        data = pool[np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[at] - ends[:-1], n)].tobytes()
        cut = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:])]

    def _learn(self, found: list[str]) -> None:
        """Keep the ids of these different words, none of which is in the new generation."""
        words, tail = self.words, self.tail
        ends: list[tuple[str, str, str]] = []
        plain: list[str] = []
        other: list[str] = []

        def deal(some: Iterable[str]) -> None:
            old = self.old.get
            for w in some:
                ids = old(w)
                if ids is not None:
                    words[w] = ids
                elif w.isalpha() and w.islower() and (w.isascii() or PLAIN.fullmatch(w)):
                    plain.append(w)
                elif w[-1] in tail and (core := w.rstrip(tail)) and core[-1].isalnum():
                    ends.append((w, core, w[len(core) :]))
                else:
                    other.append(w)

        deal(found)
        deal({x for _, *parts in ends for x in parts}.difference(words, plain, other))
        self._others([*other, *self._letters(plain)])
        words.update([(w, words[core] + words[end]) for w, core, end in ends])

    def _letters(self, fresh: list[str]) -> list[str]:
        """Encode lower-case words of letters, many in one text: a word's last id is one that ends words.  Returns those that could not be told apart."""
        runs, left = [fresh[at : at + 128] for at in range(0, len(fresh), 128)], []
        for run, e in zip(runs, self.bare.encode_batch_fast([self._spell(" ".join(r)) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cut) != len(run):
                left += run
                continue
            data = ids.tobytes()
            self.words.update(zip(run, [data[4 * a : 4 * b] for a, b in zip([0, *cut], cut)]))
        return left

    def _spell(self, text: str) -> str:
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.spelt)

    def _others(self, fresh: list[str]) -> None:
        """Encode any words, many in one text with a mark between them; a word that holds the mark goes alone."""
        alone = [w for w in fresh if self.mark is None or MARK in w]
        plain = [w for w in fresh if self.mark is not None and MARK not in w]
        runs = [plain[at : at + 256] for at in range(0, len(plain), 256)]
        for run, e in zip(runs, self.tok.encode_batch_fast([f" {MARK} ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(run) - 1:
                alone += run
                continue
            self.words.update((w, ids[a:b].tobytes()) for w, a, b in zip(run, np.r_[0, cut + 1].tolist(), [*cut.tolist(), len(ids)]))
        self.words.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(alone, self.tok.encode_batch_fast(alone, add_special_tokens=False)))


@lru_cache(maxsize=1)
def encoder_of(tokenizer: str) -> WordEncoder:
    """A worker's encoder, kept from task to task."""
    return WordEncoder(tokenizer)


def build_grammar(ids: np.ndarray, base: int, *, least: int = 16, share: int = 64, end: int = END):
    """Symbols (uint32) and rules (n, 2) of an id sequence.  Until no pair has `least` uses, a round replaces every pair that has them and at least
    1/`share` of the most frequent pair's, from left to right without overlaps, and numbers the rules from `base` up.  The end id is in no pair.

    A pair under `least` can't come to have more uses, so a round looks only at pairs that were frequent in the one before and at those
    that its replacements made."""
    s = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    total = 0
    free = s != end
    able = np.zeros(len(s), bool)  # whether the pair that begins here may be frequent
    able[:-1] = free[:-1] & free[1:]
    while True:
        at = np.flatnonzero(able)
        if not len(at):
            break
        if base + total <= 1 << 16:
            code, names = (s[at] << np.uint32(16)) | s[at + 1], None
        else:
            names, code = np.unique((s[at].astype(np.uint64) << np.uint64(32)) | s[at + 1], return_inverse=True)
        # pair and place in one number: sorting it brings a pair's places together
        ordered = (code.astype(np.uint64) << np.uint64(32)) | at.view(np.uint64)
        ordered.sort()
        pair = (ordered >> np.uint64(32)).astype(np.uint32)
        head = np.flatnonzero(pair[1:] != pair[:-1]) + 1
        head = np.concatenate([[0], head])
        uses = np.diff(head, append=len(pair))
        often = uses >= least
        if not often.any():
            break
        ordered = ordered[np.repeat(often, uses)]  # from here on frequent pairs only
        place = (ordered & np.uint64(0xFFFFFFFF)).view(np.int64)
        pair, uses = pair[head[often]], uses[often]
        able = np.zeros(len(s), bool)
        able[place] = True
        chosen = uses >= max(least, int(uses.max()) // share)
        rank = np.repeat(np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32), uses)
        put = np.full(len(s), -1, np.int32)
        put[place] = rank
        at = np.flatnonzero(put >= 0)
        # of neighbouring hits, the first, third, ... of each run: from left to right
        step = np.diff(at, prepend=-2) > 1
        count = np.arange(len(at))
        at = at[(count - np.maximum.accumulate(np.where(step, count, 0))) & 1 == 0]
        s[at] = (base + total + put[at]).astype(np.uint32)
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        able[at] = able[np.maximum(at - 1, 0)] = True
        stay = np.flatnonzero(stay)
        s, able = s[stay], able[stay]
        free = s != end
        able[-1] = False
        able[:-1] &= free[:-1] & free[1:]
        made = pair[chosen] if names is None else names[pair[chosen]]
        half, low = (16, 0xFFFF) if names is None else (32, 0xFFFFFFFF)
        rules.append(np.column_stack([made >> made.dtype.type(half), made & made.dtype.type(low)]).astype(np.uint32))
        total += len(made)
    return s, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


@lru_cache(maxsize=2)
def _terminals(base: int) -> list[bytes]:
    data = np.arange(base, dtype="<u4").tobytes()
    return [data[k : k + 4] for k in range(0, 4 * base, 4)]


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every symbol one behind the other, and where those of each begin, the end of the last included; a rule's two sides come before it."""
    table = _terminals(base).copy()
    for a, b in rules.tolist():
        table.append(table[a] + table[b])
    return np.frombuffer(b"".join(table), "<u4"), np.concatenate([[0], np.cumsum(np.fromiter(map(len, table), np.int64, len(table)))]) // 4


def write_block(ids: list[bytes], base: int, end: int = END) -> bytes:
    """A block of documents, each with its end id already appended.  base: the vocabulary's size, first nonterminal."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    symbols, rules = build_grammar(flat, base, end=end)
    lengths = [1] * base
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    # no rule holds an end id, so the n-th of them among the ids is the n-th among the symbols, and documents begin behind theirs
    last = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64) - 1
    nth = np.searchsorted(np.flatnonzero(flat == end), last)
    first = np.concatenate([[0], np.flatnonzero(symbols == end)[nth] + 1]).astype("<u4")
    wide = base + len(rules) > 65536
    parts = [first, rules.astype("<u4"), np.array(lengths[base:], "<u4"), symbols.astype("<u4" if wide else "<u2")]
    return HEADER.pack(MAGIC, len(ids), len(rules), base, len(symbols)) + b"".join(p.tobytes() for p in parts)


class Block:
    """A written block: `document(k)` decodes one document, `start(k)` counts the ids before it, `all()` gives each document's ids as bytes."""

    def __init__(self, data: bytes):
        magic, self.docs, n, self.base, m = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair block")
        at = HEADER.size
        self.first = np.frombuffer(data, "<u4", self.docs + 1, at)
        at += self.first.nbytes
        self.rules = np.frombuffer(data, "<u4", 2 * n, at).reshape(n, 2)
        at += self.rules.nbytes
        self.rule_lengths = np.frombuffer(data, "<u4", n, at)
        at += self.rule_lengths.nbytes
        self.table: tuple[np.ndarray, np.ndarray] | None = None
        self.symbols = np.frombuffer(data, "<u4" if self.base + n > 65536 else "<u2", m, at)

    def lengths(self) -> np.ndarray:
        s, out = self.symbols.astype(np.int64), np.ones(len(self.symbols), np.int64)
        rule = s >= self.base
        out[rule] = self.rule_lengths[s[rule] - self.base]
        return out

    def start(self, k: int) -> int:
        return int(self.lengths()[: self.first[k]].sum())

    def document(self, k: int) -> np.ndarray:
        """Ids of one document: nothing before it is expanded."""
        return np.frombuffer(self.ids(k), "<u4")

    def ids(self, k: int) -> bytes:
        return self._expanded(self.symbols[self.first[k] : self.first[k + 1]])[0].tobytes()

    def _expanded(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these symbols, and where those of each begin, the end of the last included."""
        if self.table is None:
            self.table = expansions(self.rules, self.base)
        pool, begin = self.table
        start = begin[symbols]
        n = begin[1:][symbols] - start
        ends = np.concatenate([[0], np.cumsum(n)])
        return pool[np.arange(ends[-1]) + np.repeat(start - ends[:-1], n)], ends

    def all(self) -> list[bytes]:
        ids, ends = self._expanded(self.symbols)
        data, cut = ids.tobytes(), (4 * ends[self.first]).tolist()
        return [data[a:b] for a, b in zip(cut, cut[1:])]


BLOCK = "part int, seq int, n_docs long, n_ids long, ids array<long>, nulls array<boolean>, payload binary"


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END, block_ids: int = 1_000_000) -> DataFrame:
    """Encode `docs` into blocks under `path`, ascending by id over (part, seq); returns the written table.

    tokenizer: the tokenizer's JSON.  Null texts are empty (the end id alone), null ids come first, equal ids are ordered by crc32 and length of the text.
    A block ends once it has `block_ids` ids.  Each task writes its own blocks by Spark's committed writer, so a lost executor's are written again."""
    base = _vocabulary(tokenizer)
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, part, seq = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        held, keys, size = [], [], 0
        for b in batches:
            texts, ids = [t or "" for t in b["text"]], b["id"].tolist()
            for at, to in cut_at(np.array([len(t) for t in texts], np.int64), 2 * SLICE):
                for key, data in zip(ids[at:to], encoder.encode(texts[at:to])):
                    held.append(data + tail)
                    keys.append(key)
                    size += len(held[-1]) // 4
                    if size >= block_ids:
                        yield _block(part, seq, keys, held, size, base, end)
                        held, keys, size, seq = [], [], 0, seq + 1
        if held:
            yield _block(part, seq, keys, held, size, base, end)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the range goes by the whole order: rows that share an id, or have none, are spread by their texts
    order = ["id", "crc", "length"]
    ordered = rows.withColumns({"crc": F.crc32("text"), "length": F.length("text")}).repartitionByRange(*order).sortWithinPartitions(*order)
    # an id is a string on its way through pandas: null ids would make the others floats
    ranged = ordered.select(F.col("id").cast("string").alias("id"), "text")
    ranged.mapInPandas(run, BLOCK).write.parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


def _vocabulary(tokenizer: str) -> int:
    return Tokenizer.from_str(tokenizer).get_vocab_size(with_added_tokens=True)


def _block(part: int, seq: int, keys: list, held: list[bytes], size: int, base: int, end: int) -> pd.DataFrame:
    ids, nulls = [int(k) if k is not None else 0 for k in keys], [k is None for k in keys]
    return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(held)], "n_ids": [size], "ids": [ids], "nulls": [nulls], "payload": [write_block(held, base, end)]})


def read_digest(blocks: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) for each document, decoded from the written blocks."""
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a partition
    before = by_part.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = blocks.select("part", "seq", "n_ids").withColumn("inside", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = inside.join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("block_start"))

    def run(batches):
        for b in batches:
            for data, ids, nulls, start in zip(b["payload"], b["ids"], b["nulls"], b["block_start"]):
                docs = Block(data).all()
                n = np.array([len(d) // 4 for d in docs], np.int64)
                yield pd.DataFrame({"id": [None if z else str(i) for i, z in zip(ids, nulls)], "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(d) for d in docs]})

    got = blocks.join(starts, ["part", "seq"]).select("payload", "ids", "nulls", "block_start").mapInPandas(run, "id string, start long, n_tokens long, ids_crc32 long")
    return got.withColumn("id", F.col("id").cast("long"))


def encode_corpus(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write `docs` as blocks into the shared folder and read the digest of every document back."""
    return read_digest(write_ids(spark, docs, tokenizer, Scratch(spark, "repair").path("blocks"), **options))
