"""Byte-level BPE on the tokenizers library, over Arrow batches.

A rank file holds byte strings and their ranks.  The library merges pairs of characters by a list, so every byte gets a printable character, and
the list is recovered from the ranks: the merge that makes a token is the last one left when its own bytes are merged by the lower ranks alone.  No other pair
can ever make it: two neighbours are only joined once no lower rank is left inside them, and then they are what their bytes alone give.
Ids are therefore those of the rank file's own library.  Texts are cut by the pattern outside the library, whose own cutting takes most of its time.

Offsets go from bytes to characters: an id that holds some bytes of a character covers that character.  Decoding reverses the byte table, joins the bytes
and only then reads characters, so a character split over ids comes back whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from boutline.llm.arrows import SLICE, cut_at, sliced, texts_of, with_columns


#: Different matches whose ids a worker keeps, and characters from which on a match isn't kept.
KEPT, LONG = 200_000, 100


def byte_table() -> list[str]:
    """The character of each byte: itself if it is printable in Latin-1, else the next free one from U+0100 up."""
    table, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 255 and b != 173:
            table.append(chr(b))
        else:
            table.append(chr(free))
            free += 1
    return table


def parse_ranks(file: bytes) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64, then its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the ranks below the token's own leave of it; None if they leave more, and no merge makes it."""
    own, parts = ranks[token], [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, own), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def rebuild(file: bytes, pattern: str) -> str:
    """The rank file and the pattern that cuts texts, as the JSON of a Tokenizer.  Every byte must have a rank of its own.  The driver does this once."""
    ranks, table = parse_ranks(file), byte_table()
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte without a rank")
    spelt = lambda token: "".join(table[b] for b in token)
    parts = [halves(token, ranks) for token in sorted(ranks, key=ranks.__getitem__) if len(token) > 1]
    tok = Tokenizer(models.BPE(vocab={spelt(t): r for t, r in ranks.items()}, merges=[(spelt(a), spelt(b)) for a, b in filter(None, parts)], ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok.to_str()


class Coder:
    """A worker's tokenizer and the bytes of each id.

    A match of the pattern is merged by itself, so each different match goes through the library once, spelt by the byte table, and its ids are kept."""

    def __init__(self, made: str):
        self.tok = Tokenizer.from_str(made)
        self.cut = regex.compile(json.loads(made)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.tok.pre_tokenizer = None  # texts are cut and spelt before
        table = byte_table()
        self.spelt = dict(enumerate(table))
        back = {c: b for b, c in enumerate(table)}
        vocab = self.tok.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, n in vocab.items():
            self.bytes[n] = bytes(back[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.known: dict[str, bytes] = {}

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cuts = [self.cut(t) for t in texts]
        new = {w for words in cuts for w in words if w not in self.known}
        if len(self.known) + len(new) > KEPT:
            self.known = {}
            new = {w for words in cuts for w in words}
        self.known |= self._merged(list(new))
        known = self.known
        out = [b"".join([known[w] for w in words]) for words in cuts]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def _merged(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of each word, from the library, which takes them by the thousand."""
        spelt = [w.encode().decode("latin-1").translate(self.spelt) for w in words]
        found = {}
        at = range(0, len(words), 1000)
        for a, e in zip(at, self.tok.encode_batch_fast([spelt[k : k + 1000] for k in at], is_pretokenized=True, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            word_ends = np.cumsum([len(w) for w in spelt[a : a + 1000]])  # in bytes, as the ids' own ends
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), word_ends) + 1
            data, start = ids.tobytes(), 0
            for w, end in zip(words[a : a + 1000], (ends * 4).tolist()):
                found[w] = data[start:end]
                start = end
        return found

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(p, "<u4").tolist() for p in self.packed(texts)]

    def joined(self, ids: Iterable[int]) -> bytes:
        """The bytes of a run of ids.  Ids that aren't in the vocabulary have none."""
        known, n = self.bytes, len(self.bytes)
        return b"".join([known[i] for i in ids if i is not None and 0 <= i < n])

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The first character of each id, and the one after its last."""
        data = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[np.array(ids, np.int64)])
        return char_of[np.concatenate([[0], ends[:-1]])] if len(ids) else ends, char_of[ends - 1] + 1

    def pieces(self, ids: Iterable[int]) -> list[str]:
        """For each id the characters that are complete with it; bytes of an unfinished character wait for the next id.  Bytes that are no character become
        U+FFFD, those left at the end with the last id."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = [reader.decode(self.joined((i,))) for i in ids]
        if out:
            out[-1] += reader.decode(b"", True)
        return out


@lru_cache(maxsize=4)
def coder(made: str, threads: int = 1) -> Coder:
    """A worker's coder, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    return Coder(made)


def _list_array(values: np.ndarray | pa.Array, lengths: list[int]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values))


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def encode(docs: DataFrame, made: str, *, text_col: str = "text", out: str = "ids", offsets: str | None = None, threads: int = 1) -> DataFrame:
    """`docs` with `out` array<int>, the ids of the whole text, and `offsets` (if named) array<struct<start, end>>, the characters that each id covers
    (from 0, end exclusive; ids that share a character both cover it).

    `made` is the result of `rebuild`.  Null and empty texts have no ids.  All other columns and repeated rows are kept; a column that already has an output's
    name is replaced.  Texts go to the library in batches of about 1 MB, and leave the worker before the next is read."""
    new = {out: T.ArrayType(T.IntegerType())} | ({offsets: T.ArrayType(SPAN)} if offsets else {})
    columns = {f.name: f.dataType for f in docs.schema.fields} | new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(made, threads)
        for batch in sliced(batches, text_col):
            texts = texts_of(batch, text_col)
            ids = c.ids(texts)
            lengths = [len(x) for x in ids]
            found = {out: _list_array(np.array([i for x in ids for i in x], np.int32), lengths)}
            if offsets:
                spans = [c.offsets(t, x) for t, x in zip(texts, ids)]
                at = [pa.array(np.concatenate([s[k] for s in spans]).astype(np.int32)) for k in (0, 1)]
                found[offsets] = _list_array(pa.StructArray.from_arrays(at, names=["start", "end"]), lengths)
            yield with_columns(batch, found)

    return docs.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in columns.items()]))


def decode(df: DataFrame, made: str, *, ids_col: str = "ids", out: str = "text", raw: str | None = None, pieces: str | None = None) -> DataFrame:
    """`df` with `out`, the text of the ids; `raw` (if named) their bytes as they are; `pieces` (if named) array<string>, the characters that each id completes,
    which joined give the text.

    Null or empty lists give "", no bytes and no pieces; null ids and ids outside the vocabulary have no bytes.  Bytes that are no UTF-8 become U+FFFD in texts.
    All other columns and repeated rows are kept; a column that already has an output's name is replaced."""
    new = {out: T.StringType()} | ({raw: T.BinaryType()} if raw else {}) | ({pieces: T.ArrayType(T.StringType())} if pieces else {})
    columns = {f.name: f.dataType for f in df.schema.fields} | new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(made)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            sizes = np.array([len(x) * 4 if x.is_valid else 0 for x in batch.column(at)], np.int64)
            for a, b in cut_at(sizes, SLICE):
                part = batch.slice(a, b - a)
                ids = [x or [] for x in part.column(at).to_pylist()]
                data = [c.joined(x) for x in ids]
                found = {out: pa.array([d.decode("utf-8", "replace") for d in data], pa.string())}
                found |= {raw: pa.array(data, pa.binary())} if raw else {}
                found |= {pieces: pa.array([c.pieces(x) for x in ids], pa.list_(pa.string()))} if pieces else {}
                yield with_columns(part, found)

    return df.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in columns.items()]))


def id_digest(docs: DataFrame, made: str, *, id_col: str = "doc_id", text_col: str = "text", threads: int = 1) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip, split_chars): per row the number of ids, the SHA-256 of the ids as little-endian unsigned 32-bit
    integers and of the bytes that they decode to, whether those are the text's, and the number of ids that end inside a character.

    Ids never leave the task.  Null texts are empty; repeated rows each come back; other columns are never read; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(made, threads)
        for batch in sliced(batches, "text"):
            found = []
            texts = texts_of(batch, "text")
            for text, packed in zip(texts, c.packed(texts)):
                ids = np.frombuffer(packed, "<u4")
                data = c.joined(ids.tolist())
                ends = np.cumsum(c.lengths[ids])[:-1]
                inside = int(((np.frombuffer(data, np.uint8)[ends] & 0xC0) == 0x80).sum()) if len(ends) else 0
                found.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(data).hexdigest(), data == text.encode(), inside))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64())
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "split_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*found), kinds))], names=names)

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, split_chars long")
