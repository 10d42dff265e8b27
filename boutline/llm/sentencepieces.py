"""SentencePiece models on the tokenizers library.

The model protobuf is parsed, and the normaliser (character map, white-space rules, dummy prefix), the metaspace marker, the unigram
scores or BPE merges, and byte fallback are rebuilt as one Tokenizer, which encodes batches with several threads.  `parity` compares
it with the sentencepiece library itself.

The file is read by the driver and shipped to the tasks as bytes, so executors need no common path.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from boutline.llm.arrows import sliced, texts_of, with_columns

MARK = "▁"
#: Piece kinds and model kinds of the public protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def parse(model: bytes):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return proto


def merges(scores: dict[str, float]) -> list[tuple[str, str]]:
    """Every way to put a piece together from two others, in the order in which SentencePiece would: by the score of the whole."""
    ids = {p: n for n, p in enumerate(scores)}
    found = []
    for piece, score in scores.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in ids and b in ids:
                found.append((-score, ids[piece], ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def spelt_cuts(pieces) -> list[str]:
    """Patterns after which a text is cut that spells out a control, unknown or byte piece, which a lattice would take for the piece.  The cut is before a
    character that is a piece of its own (so that no run of unknown ones, which is one id, is cut), and where no piece lies across it."""
    normal = {p.piece for p in pieces if p.type == NORMAL}
    across = {x for p in normal for x in zip(p, p[1:])}
    found = []
    for p in pieces:
        if p.type in (CONTROL, UNKNOWN, BYTE):
            at = next((k for k in range(1, len(p.piece)) if p.piece[k] in normal and tuple(p.piece[k - 1 : k + 1]) not in across), None)
            if at:
                found.append(f"{re.escape(p.piece[:at])}(?={re.escape(p.piece[at:])})")
    return found


def build(model: bytes) -> Tokenizer:
    """The Tokenizer with the behaviour of a SentencePiece model (unigram or BPE).  Models with user-defined pieces are refused: the library cuts
    texts at them before anything else, and no part of a Tokenizer does so within one normalised text."""
    proto = parse(model)
    pieces = list(proto.pieces)
    if any(p.type == USER_DEFINED for p in pieces):
        raise ValueError("user-defined pieces are not supported")
    fallback = proto.trainer_spec.byte_fallback
    unk = next(n for n, p in enumerate(pieces) if p.type == UNKNOWN)
    if proto.trainer_spec.model_type == UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in pieces], unk_id=unk, byte_fallback=fallback)
    elif proto.trainer_spec.model_type == BPE:
        vocab = {p.piece: n for n, p in enumerate(pieces)}
        usable = {p.piece: p.score for p in pieces if p.type == NORMAL}
        core = models.BPE(vocab=vocab, merges=merges(usable), unk_token=pieces[unk].piece, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tok = Tokenizer(core)
    spec = proto.normalizer_spec
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("\\A +| +\\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Replace(Regex("\\A(?=[\\s\\S])"), " "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    inner = any(MARK in p.piece.lstrip(MARK) for p in pieces if p.type == NORMAL)
    if not inner and proto.trainer_spec.model_type == BPE:
        # no piece goes on past a marker, so words can be encoded (and cached) one by one
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+\\z"), "isolated")
    if proto.trainer_spec.model_type == UNIGRAM:
        cuts = spelt_cuts(pieces)
        if cuts:
            tok.pre_tokenizer = pre_tokenizers.Split(Regex("|".join(cuts)), "merged_with_previous")
    tok.decoder = decoders.Sequence([decoders.Replace(pieces[unk].piece, proto.trainer_spec.unk_surface), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else [])])
    tok.add_special_tokens([AddedToken(p.piece, normalized=False, special=True) for p in pieces if p.type == CONTROL])
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    return tok


@lru_cache(maxsize=4)
def _built(model: bytes) -> Tokenizer:
    return build(model)


def parity(model: bytes, texts: list[str]) -> list[int]:
    """Indices of the texts that the rebuilt tokenizer and the sentencepiece library encode or decode in different ways."""
    import sentencepiece

    own, theirs = _built(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    bad = []
    for n, (text, got) in enumerate(zip(texts, own.encode_batch(texts, add_special_tokens=False))):
        ids = theirs.encode(text)
        if got.ids != ids or own.decode(ids, skip_special_tokens=False) != theirs.decode(ids):
            bad.append(n)
    return bad


class Coder:
    """A worker's tokenizer with what is needed to compare decoded texts."""

    def __init__(self, model: bytes, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        spec = parse(model).normalizer_spec
        self.tok, self.squeeze, self.plain = _built(model), spec.remove_extra_whitespaces, not spec.precompiled_charsmap

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def texts(self, ids: list[np.ndarray]) -> list[str]:
        return self.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def came_back(self, texts: list[str], decoded: list[str]) -> list[bool]:
        """Whether each decoded text is the text as the model normalises it."""
        out = []
        for want, got in zip(texts, decoded):
            if self.squeeze:
                want = " ".join(x for x in want.split(" ") if x)
            out.append(got == want if self.plain else got == self.tok.normalizer.normalize_str(want).replace(MARK, " ").removeprefix(" "))
        return out


def encode(
    docs: DataFrame,
    model: bytes,
    *,
    text_col: str = "text",
    out: str = "ids",
    threads: int = 2,
    decoded: str | None = None,
    round_trip: str | None = None,
) -> DataFrame:
    """`docs` with `out` array<int>, the ids of the whole text; `decoded` (if named) the text that they decode to; `round_trip` (if named) whether that
    is the text as the model normalises it.

    Null texts have no ids, as empty ones do, and decode to "".  All other columns are kept as they are; a column that already has an
    output's name is replaced.  Texts go to the tokenizer in batches of about 1 MB, and a batch's ids leave the worker before the next is read."""
    new = {out: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {}) | ({round_trip: T.BooleanType()} if round_trip else {})
    columns = {f.name: f.dataType for f in docs.schema.fields} | new

    def run(batches):
        coder = Coder(model, threads)
        for batch in sliced(batches, text_col):
            texts = texts_of(batch, text_col)
            ids = coder.ids(texts)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            made = {out: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))}
            if decoded or round_trip:
                back = coder.texts(ids)
                made |= {decoded: pa.array(back, pa.string())} if decoded else {}
                made |= {round_trip: pa.array(coder.came_back(texts, back))} if round_trip else {}
            yield with_columns(batch, made)

    return docs.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in columns.items()]))


def decode(df: DataFrame, model: bytes, *, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """`df` with `out`, the text that the ids decode to; null or empty ids give ""."""

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return pd.Series(_built(model).decode_batch([[] if x is None else list(x) for x in ids], skip_special_tokens=False), dtype=object)

    return df.withColumn(out, text_of(F.col(ids_col)))


def id_digest(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", threads: int = 2) -> DataFrame:
    """(id, n_tokens, ids_crc32, round_trip): per row the number of ids, their crc32 as little-endian unsigned 32-bit integers, and whether the
    ids decode to the text as the model normalises it.  Whole ids never leave the task.  Null texts are empty; repeated rows each come back; other columns
    are never read; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        coder = Coder(model, threads)
        for batch in sliced(batches, "text"):
            texts = texts_of(batch, "text")
            ids = coder.ids(texts)
            same = coder.came_back(texts, coder.texts(ids))
            columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_crc32", "round_trip"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_crc32 long, round_trip boolean")


def load(spark: SparkSession, path: str) -> bytes:
    """The model file, from a local path of the driver or any store that Spark reads."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
