"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification, connected components.

Equal vectors of a label are one class first, so copies cost one row.  A bucket (label, table, code) with more classes than a block is cut into blocks,
and each pair of blocks is a task's group, so no bucket is ever gathered whole.  A pair is counted in the first table where its codes meet;
tasks return counts and star edges, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.components import connected_components, local_roots
from boutline.llm.scratch import Scratch


def hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def sign_codes(vectors: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits))


def choose_bits(n: int, cosine: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bits, tables) for `n` vectors of a label: a code that random vectors share with a quarter of another one on average, and the tables with which a pair at
    `cosine` escapes all with probability `miss` at most."""
    bits = min(30, max(8, math.ceil(math.log2(4 * max(n, 1)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def scaled(vec: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no digit of a cosine and keeps squares from overflowing or vanishing."""
    return np.ldexp(vec, -np.frexp(np.abs(vec).max(1))[1][:, None])


def _coder(tables: int, bits: int, seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b["vec"].map(len).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, tables, bits, seed)
                codes = sign_codes(scaled(np.stack(b["vec"].to_numpy()[at]).astype(float)), planes[dim], tables, bits)
                yield b.iloc[at].assign(codes=list(codes.astype(np.int32)))

    return run


#: Groups up to this size are compared together, pair by pair, in one array operation.
SMALL = 48
PAIRS = 1 << 15


def compare_small(rep, copies, vec, codes, block, tab, sizes, starts, cosine: float):
    """Links of many small groups (rows `starts` to `starts` + `sizes`): (row, vectors linked), and the linked rows a, b."""
    links, a, b = np.zeros(len(rep), np.int64), [], []
    norm = np.sqrt((vec * vec).sum(1))
    for size in np.unique(sizes).tolist():
        x, y = np.triu_indices(size, 1)
        first = starts[sizes == size]
        for at in range(0, len(first), max(1, PAIRS // len(x))):
            part = first[at : at + max(1, PAIRS // len(x)), None]
            i, j = (part + x).ravel(), (part + y).ravel()
            i, j = (z[(block[i] != block[j]) | ~_across(block, part, size, len(x))] for z in (i, j))
            near = np.einsum("ij,ij->i", vec[i], vec[j]) / (norm[i] * norm[j]) >= cosine
            i, j = i[near], j[near]
            new = (codes[i] == codes[j]).argmax(1) == tab[i] if len(i) else np.zeros(0, bool)
            i, j = i[new], j[new]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            a.append(rep[i])
            b.append(rep[j])
    return links, np.concatenate(a), np.concatenate(b)


def _across(block: np.ndarray, part: np.ndarray, size: int, pairs: int) -> np.ndarray:
    """For each pair of the groups, whether the group is one of two blocks (which are compared with each other only)."""
    rows = block[part + np.arange(size)]
    return np.repeat((rows != rows[:, :1]).any(1), pairs)


def compare(rep: np.ndarray, copies: np.ndarray, vec: np.ndarray, codes: np.ndarray, block: np.ndarray, table: int, cosine: float):
    """Links of a group: per class the vectors linked (of other classes), and the class's root among the group."""
    n, across = len(rep), len(np.unique(block)) > 1
    norm = np.sqrt((vec * vec).sum(1))
    links, a, b = np.zeros(n, np.int64), [], []
    for at in range(0, n, 512):
        part = slice(at, min(n, at + 512))
        close = (vec[part] @ vec.T) / (norm[part, None] * norm[None, :]) >= cosine
        close[np.arange(part.stop - at), np.arange(at, part.stop)] = False
        if across:
            close &= block[part, None] != block[None, :]
        i, j = np.nonzero(close)
        if table and len(i):
            new = ~(codes[i + at, :table] == codes[j, :table]).any(1)
            i, j = i[new], j[new]
        np.add.at(links, i + at, copies[j])
        keep = i + at < j
        a.append(rep[i[keep] + at])
        b.append(rep[j[keep]])
    root = rep.copy()
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        nodes, roots = local_roots(a, b)
        at = np.searchsorted(nodes, rep)
        at[at == len(nodes)] = 0
        known = nodes[at] == rep
        root[known] = roots[at[known]]
    return links, root


def _compare(cosine: float):
    columns = ["label", "dim", "tab", "code", "b1", "b2"]

    def run(batches):
        """Groups arrive sorted by key; one may go on in the next batch."""
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[columns].to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if not len(cut):
                continue
            yield from groups(rest.iloc[: cut[-1]], [0, *cut.tolist()])
            rest = rest.iloc[cut[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from groups(rest, [0, len(rest)])

    def groups(df, cuts):
        for dim in np.unique(df["dim"]).tolist():
            yield from of_one_dimension(df, [(x, y) for x, y in zip(cuts[:-1], cuts[1:]) if y - x > 1 and df["dim"].iat[x] == dim])

    def of_one_dimension(df, spans):
        if not spans:
            return
        rep, copies, block, tab = (df[c].to_numpy() for c in ("rep", "copies", "block", "tab"))
        starts, sizes = np.array([x for x, _ in spans]), np.array([y - x for x, y in spans])
        small = sizes <= SMALL
        if small.any():
            rows = np.concatenate([np.arange(x, y) for (x, y), s in zip(spans, small) if s])
            vec, codes = scaled(np.stack(df["vec"].to_numpy()[rows]).astype(float)), np.stack(df["codes"].to_numpy()[rows])
            begin = np.cumsum(sizes[small]) - sizes[small]
            links, a, b = compare_small(rep[rows], copies[rows], vec, codes, block[rows], tab[rows], sizes[small], begin, cosine)
            some = links > 0
            if some.any():
                nodes, roots = local_roots(a, b)
                yield pd.DataFrame({"rep": rep[rows][some], "links": links[some], "root": roots[np.searchsorted(nodes, rep[rows][some])]})
        for x, y in zip(starts[~small].tolist(), (starts + sizes)[~small].tolist()):
            vec, codes = scaled(np.stack(df["vec"].to_numpy()[x:y]).astype(float)), np.stack(df["codes"].to_numpy()[x:y])
            links, root = compare(rep[x:y], copies[x:y], vec, codes, block[x:y], int(tab[x]), cosine)
            some = links > 0
            yield pd.DataFrame({"rep": rep[x:y][some], "links": links[some], "root": root[some]})

    return run


def near_duplicates(
    spark: SparkSession,
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    tables: int | None = None,
    bits: int | None = None,
    block: int = 1024,
    seed: int = 11,
) -> DataFrame:
    """(id, n_links, component) for each row: how many other rows link with it directly, and the smallest id reachable over links.

    Two rows link if their labels are equal and not null, their vectors as long as each other, and a table finds them with cosine >= `cosine` in double precision.
    `bits` and `tables` follow from the largest label (`choose_bits`), so buckets do not grow with the table; a pair at the limit escapes all tables once in a
    million.  Null, empty and zero vectors, vectors with null or non-finite
    parts, and rows with a null id or label link with nothing.  Copies of a vector link with each other.  Repeated rows each come back and count.
    """
    scratch = Scratch(spark, "embeddings")
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    rows = scratch.table(rows.withColumn("digest", F.when(F.col("ok"), F.xxhash64("vec"))), "rows")
    if bits is None or tables is None:
        sizes = rows.where("ok").groupBy("label").agg(F.approx_count_distinct("digest").alias("n")).agg(F.max("n").alias("n"))
        bits, tables = choose_bits(sizes.first()["n"] or 1, cosine)
    classes = rows.where("ok").groupBy("label", "digest", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    shape = "label long, digest long, vec array<double>, rep long, copies long, codes array<int>"
    classes = scratch.table(classes.mapInPandas(_coder(tables, bits, seed), shape), "classes")

    key = ["label", "dim", "tab", "code"]
    spread = classes.select("rep", "label", F.size("vec").alias("dim"), F.posexplode("codes").alias("tab", "code"))
    full = scratch.table(spread.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "buckets")
    members = spread.join(full, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("b1"), F.greatest(F.col("block"), o).alias("b2")))
    members = members.select("rep", *key, "block", F.explode(pairs).alias("p")).select("rep", *key, "block", "p.b1", "p.b2")
    members = members.join(classes.select("rep", "copies", "vec", "codes"), "rep")
    group = [*key, "b1", "b2"]
    found = members.repartition(*group).sortWithinPartitions(*group).select(*group, "block", "rep", "copies", "vec", "codes")
    found = scratch.table(found.mapInPandas(_compare(cosine), "rep long, links long, root long"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(spark, found.select(F.col("rep").alias("src"), F.col("root").alias("dst")), scratch)
    of_class = classes.select("rep", "copies", F.col("label").alias("l"), F.col("digest").alias("d"), F.col("vec").alias("v")).join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = scratch.table(of_class.select("l", "d", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("part")), "parts")
    linked = rows.where("ok").join(of_class, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")) & (F.col("vec") == F.col("v"))).select("id", "n_links", F.col("part").alias("component"))
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)
