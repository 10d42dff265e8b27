"""SimHash near-dedup by anchor-point covering.

Anchors are the codewords of the Hamming code of length 63 (covering radius 1).  Two fingerprints at most t bits
apart have a point halfway between them, and an anchor within the covering radius of that point; so it is enough
to put each fingerprint under every anchor within the covering radius plus half the threshold (rounded up): the two
halves add up to covering radius plus threshold across a pair.  At t = 2 that is radius 2, 32 anchors at most,
where one-sided replication to radius 3 would take 652.  The 64th bit isn't part of the code; the comparison under each
anchor is over all 64 bits.  An anchor holds distinct fingerprints within 2 of it, 4,034 at most, so no group grows
with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutline.llm.arrows import sliced, texts_of, with_columns
from boutline.llm.components import connected_components, local_roots
from boutline.llm.scratch import Scratch

LENGTH = 63
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles: A-Z lower-cased, words between ASCII white space, repeats counted; a bit is 1 if set
    in over half of the shingles' XXH64.  Fewer words than `shingle`: the whole sequence; none (or null): 0."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    last = ends[shingle - 1 :] - 1 if len(words) >= shingle else ends[-1:] - 1
    first = np.concatenate([[0], ends])[: len(last)]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(last), CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist())], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits((2 * total > len(last)).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = 3) -> DataFrame:
    """`docs` with a signed long column `name`, the fingerprint of `text`, in place of `text`."""

    def run(batches):
        for batch in sliced(batches, text):
            made = np.array([fingerprint(t, shingle) for t in texts_of(batch, text)], dtype=np.uint64).view(np.int64)
            yield with_columns(batch, {name: pa.array(made)}, drop=(text,))

    kept = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.LongType())]))


def anchor_masks(radius: int) -> list[np.ndarray]:
    """For each syndrome, the bit flips (at most `radius`) that lead to a codeword."""
    if radius not in (1, 2):
        raise ValueError("thresholds over 2 bits would need more than 650 anchors a fingerprint")
    bit = [np.uint64(0), *(np.uint64(1) << np.uint64(p - 1) for p in range(1, LENGTH + 1))]
    found: list[list] = [[bit[s]] for s in range(LENGTH + 1)]
    if radius == 2:
        for s in range(1, LENGTH + 1):
            found[s] += [bit[a] | bit[a ^ s] for a in range(1, LENGTH + 1) if a < a ^ s]
    return [np.array(x, np.uint64) for x in found]


def syndromes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for p in range(1, LENGTH + 1):
        out ^= ((x >> np.uint64(p - 1)) & np.uint64(1)) * np.uint64(p)
    return out


def _under_anchors(radius: int):
    masks = anchor_masks(radius)
    low = np.uint64((1 << LENGTH) - 1)

    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            s = syndromes(fp)
            for k in np.unique(s).tolist():
                at = np.flatnonzero(s == k)
                m = masks[k]
                anchors = ((fp[at] & low)[:, None] ^ m[None, :]).ravel()
                yield pd.DataFrame({"anchor": anchors.view(np.int64), "fp": np.repeat(batch["fp"].to_numpy()[at], len(m)), "rep": np.repeat(batch["rep"].to_numpy()[at], len(m))})

    return run


def linked_stars(fp: np.ndarray, rep: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) of the parts that links of at most `threshold` bits join."""
    a, b = [], []
    for at in range(0, len(fp), 512):
        near = np.bitwise_count(fp[at : at + 512, None] ^ fp[None, :]) <= threshold
        i, j = np.nonzero(near)
        keep = i + at < j
        a.append(i[keep] + at)
        b.append(j[keep])
    i, j = np.concatenate(a), np.concatenate(b)
    nodes, root = local_roots(rep[i], rep[j])
    moved = nodes != root
    return nodes[moved], root[moved]


def _compare(threshold: int):
    def run(batches):
        for batch in batches:
            src, dst = [], []
            for members in batch["members"]:
                fp = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
                s, d = linked_stars(fp, np.array([m["rep"] for m in members], np.int64), threshold)
                src.append(s)
                dst.append(d)
            if src:
                yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """(id, fp, component) for each row of `docs`: its fingerprint as a signed long, and the smallest id reachable over links of at most `threshold` bits.

    Null or wordless texts have fingerprint 0 and link like any other.  Rows with a null id keep their fingerprint, take
    the component of that fingerprint if another row has one, and start no link.  Repeated rows each come back.  Other columns, whatever
    their names, are ignored.  An empty table gives no rows.  Thresholds of 1 and 2 bits are supported; others raise, as they would need over 650
    anchors a fingerprint.
    """
    scratch = Scratch(spark, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = scratch.table(with_fingerprint(rows, "text", "fp", shingle).select("id", "fp"), "prints")
    classes = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("rep")).where("rep IS NOT NULL"), "classes")
    labels = scratch.table(_labels(spark, classes, threshold, scratch), "labels")
    return prints.join(labels, prints.fp == labels.of, "left").select("id", "fp", "component")


def _labels(spark: SparkSession, classes: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """(of, component) for each (fp, rep): the smallest rep reachable over links of at most `threshold` bits."""
    spread = classes.mapInPandas(_under_anchors(1 + (threshold + 1) // 2), "anchor long, fp long, rep long")
    groups = spread.groupBy("anchor").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).where("size(members) > 1").select("members")
    edges = groups.mapInPandas(_compare(threshold), "src long, dst long")
    parts = connected_components(spark, edges, scratch)
    return classes.join(parts, classes.rep == parts.node, "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one with the smallest id (of equal ids, the smallest hash of id and text).

    Fingerprints are linked, not ids, so texts that share an id are told apart.  Rows without an id link like any other and stay only
    where their group has no row with an id."""
    scratch = Scratch(spark, "near")
    key = F.xxhash64(docs[id_col], docs[text_col])
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), key.alias("key"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    prints = with_fingerprint(rows, "text", "fp", shingle).select("fp", first.alias("first"))
    firsts = scratch.table(prints.groupBy("fp").agg(F.min("first").alias("first")), "firsts")
    labels = _labels(spark, firsts.select("fp", F.col("fp").alias("rep")), threshold, scratch)
    kept = firsts.join(labels, firsts.fp == labels.of).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.id").alias("kept_id"), F.col("first.key").alias("kept_key"))
    kept = scratch.table(kept, "kept")
    # by id and hash: a hash that another row shares by chance keeps and drops nothing
    rows = docs.select(F.struct("*").alias("doc"), docs[id_col].cast("long").alias("id"), key.alias("key"))
    return rows.join(kept, (F.col("key") == F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["id", "key"]).select("doc.*")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
