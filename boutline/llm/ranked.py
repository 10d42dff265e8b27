"""Ranked lexical search by Fagin's threshold algorithm, over an index that is split by document.

1. The queries' terms are numbered, in blocks of bounded size, and every document becomes a row of the forward index: its length, and the
   terms it shares with the block with their counts.  The rows are written once; counts over all of them give each term's weight.
2. A task takes the rows of its part in chunks.  A chunk's postings, sorted by term and falling impact, are its impact-sorted lists.  For a query the lists
   are read in turn, a document that comes up for the first time is looked up in the forward index and gets its whole score, and reading ends when the sum of the
   next unread entries falls strictly below the k-th score so far, which the chunks before have raised already.  A round reads as many entries of each list as
   all rounds before it.
3. The parts' k best rows a query are merged, first by groups of parts, then all.

Weights and scores are whole numbers, so ties are exact; they go to the smaller id.  Postings never cross the network: the only shuffles are
counts by term and k rows a query and part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from boutline.llm.arrows import sliced
from boutline.llm.scratch import Scratch

#: Distinct (query, term) pairs of a block of queries, whose terms and weights are broadcast (at most about 30 MB); a longer query is a block of its own.
BLOCK = 200_000
#: Postings of a chunk, about 60 MB with its lists.
CHUNK = 1_000_000
#: Entries of each list that the first round reads.
FIRST = 16
#: Groups of parts whose best rows are merged first.
GROUPS = 64

#: Letters A-Z lower-cased, digits and all bytes of characters beyond ASCII as they are, spaces for the rest.
_FOLD = bytes(b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text, in order: runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased.  Null has none."""
    return (text or b"").translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Queries whose terms are numbered together: `terms` by number, and for each query its id, its terms' numbers and their repeats."""

    terms: dict[bytes, int] = field(default_factory=dict)
    queries: list[tuple[object, np.ndarray, np.ndarray]] = field(default_factory=list)
    size: int = 0

    def add(self, item: object, counts: Counter[bytes]) -> None:
        numbers = [self.terms.setdefault(t, len(self.terms)) for t in counts]
        self.queries.append((item, np.array(numbers, np.int64), np.array(list(counts.values()), np.int64)))
        self.size += len(numbers)


def blocks(rows: Iterable, limit: int = BLOCK) -> Iterator[Block]:
    """The rows (item, text) as blocks of `limit` (query, term) pairs at most, or one query."""
    now = Block()
    for item, text in rows:
        counts = Counter(terms_of(text.encode()))
        if now.queries and now.size + len(counts) > limit:
            yield now
            now = Block()
        if counts:
            now.add(item, counts)
    if now.queries:
        yield now


class Chunk:
    """An index of some documents: rows `start[d]:start[d + 1]` of (term, impact) are document d's, and `by_impact` holds the impact-sorted lists."""

    def __init__(self, ids: list, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, n_docs: int, n_all: int, n_terms: int):
        self.ids, self.start, self.term = ids, np.concatenate([[0], np.cumsum(sizes)]), terms
        m = 100 - 75 + (75 * lengths * n_docs) // max(n_all, 1)
        doc = np.repeat(np.arange(len(ids)), sizes)
        self.impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc])
        order = np.lexsort((-self.impact, terms))
        self.doc_by_impact, self.by_impact = doc[order], self.impact[order]
        self.list_at = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])
        self.seen = np.zeros(len(ids), np.int32)
        self.turn = 0

    def scores(self, docs: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """The whole scores of documents, from the forward index; worth: by term its weight times its repeats in the query."""
        first, size = self.start[docs], self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
        return np.add.reduceat(worth[self.term[at]] * self.impact[at], ends - size)

    def search(self, numbers: np.ndarray, worth: np.ndarray, best: list, k: int) -> int:
        """Put the chunk's documents into `best`, the query's k best keys (-score, null id, id) so far, in order.  Returns how many were looked up."""
        self.turn += 1
        weights, low, high = worth[numbers], self.list_at[numbers], self.list_at[numbers + 1]
        use = (weights > 0) & (high > low)
        weights, low, high = weights[use], low[use], high[use]
        depth, step, looked_up = 0, FIRST, 0
        while len(low):
            # sorted access: the next entries of each list
            heads = [self.doc_by_impact[a + depth : min(a + depth + step, b)] for a, b in zip(low, high) if a + depth < b]
            docs = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            docs = np.unique(docs[self.seen[docs] != self.turn])
            if len(docs):  # random access
                self.seen[docs] = self.turn
                looked_up += len(docs)
                found = self.scores(docs, worth)
                least = -best[-1][0] if len(best) == k else 1
                keep = np.flatnonzero(found >= least)
                best += [(-int(found[j]), self.ids[docs[j]] is None, self.ids[docs[j]] if self.ids[docs[j]] is not None else 0) for j in keep]
                best.sort()
                del best[k:]
            depth += step
            step = depth
            unread = low + depth < high
            threshold = int((weights[unread] * self.by_impact[(low + depth)[unread]]).sum())
            if threshold == 0 or len(best) == k and threshold < -best[-1][0]:
                break
        return looked_up


def top_documents(
    spark: SparkSession,
    docs: DataFrame,
    queries: DataFrame,
    *,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block: int = BLOCK,
    chunk: int = CHUNK,
) -> DataFrame:
    """(item, rank, id, score, looked_up): for each query its k best documents with a score above 0, all if there are fewer.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), N the documents with a term and df those with this one; a document's score is the sum over the query's
    terms, repeats included, of weight * (10^9 tf div (1000 tf + 8 m)), with m = 25 + (75 n N div L), n its terms and L all terms.  Equal scores rank by id, null
    ids last.  looked_up: documents whose whole score was read for the query.

    Every row is a document and every query row a query, repeated ids and rows included (their ranks are given row by row, so a repeated query has its k rows each
    time); queries with a null id or no terms and documents without terms find nothing.  Other columns are ignored.  Empty tables give no rows."""
    scratch = Scratch(spark, "ranked")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    id_kind, item_kind = dict(rows.dtypes)["id"], dict(asked.dtypes)["item"]
    shape = f"item {item_kind}, query int, part int, id {id_kind}, score long, looked_up long"
    paths: list[str] = []
    for number, now in enumerate(blocks(asked.toLocalIterator(), block)):
        forward = scratch.table(_forward(spark, rows, now, id_kind), f"forward-{number}")
        found = scratch.table(_search(spark, forward, now, shape, k, chunk), f"found-{number}")
        paths.append(scratch.table(_merged(found, k), f"best-{number}").scratch_path)
        scratch.drop(forward, found)
    if not paths:
        return spark.createDataFrame([], f"item {item_kind}, rank int, id {id_kind}, score long, looked_up long")
    return spark.read.parquet(*paths)


def _forward(spark: SparkSession, rows: DataFrame, block: Block, id_kind: str) -> DataFrame:
    """(id, n, terms, tfs) for every document with a term: how many it has, and the block's terms in it with their counts."""
    shared = spark.sparkContext.broadcast(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        known = numbers.__contains__
        for batch in sliced(batches, "text"):
            keep, lengths, sizes, terms, tfs = [], [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = terms_of(text)
                if words:
                    counts = Counter(filter(known, words))
                    keep.append(row)
                    lengths.append(len(words))
                    sizes.append(len(counts))
                    terms += [numbers[t] for t in counts]
                    tfs += counts.values()
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, f"id {id_kind}, n long, terms array<int>, tfs array<int>")


def _search(spark: SparkSession, forward: DataFrame, block: Block, shape: str, k: int, chunk: int) -> DataFrame:
    """The k best rows of each query and part of the forward index."""
    total = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    df = np.zeros(len(block.terms), np.int64)
    for term, n in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():  # a row a term of the block
        df[term] = n
    weights = np.array([weight(total["docs"], int(n)) for n in df], np.int64)
    n_docs, n_all = int(total["docs"]), int(total["words"])
    shared = spark.sparkContext.broadcast((block.queries, weights))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                size += len(part.column(2).flatten())
                if size >= chunk:
                    yield made(held)
                    held, size = [], 0
        if size:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> Chunk:
        table = pa.Table.from_batches(held)
        flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in table.column(c).chunks]).astype(np.int64)
        sizes = np.concatenate([x.value_lengths().to_numpy() for x in table.column("terms").chunks])
        return Chunk(table.column("id").to_pylist(), sizes, flat("terms"), flat("tfs"), table.column("n").to_numpy(), n_docs, n_all, len(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, by_term = shared.value
        best: list[list] = [[] for _ in asked]
        looked_up = [0] * len(asked)
        worth = np.zeros(len(by_term), np.int64)
        for index in chunks(batches):
            for q, (_, numbers, repeats) in enumerate(asked):
                worth[numbers] = by_term[numbers] * repeats
                looked_up[q] += index.search(numbers, worth, best[q], k)
                worth[numbers] = 0
        part = TaskContext.get().partitionId()
        rows = [(asked[q][0], q, part, None if none else i, -score, looked_up[q] if rank == 0 else 0) for q, keys in enumerate(best) for rank, (score, none, i) in enumerate(keys)]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "query", "part", "id", "score", "looked_up"), r)) for r in rows], kind)

    kind = to_arrow_schema(spark.createDataFrame([], shape).schema)
    return forward.mapInArrow(run, shape)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of all parts: first by query and group of parts, so that no task gets more than k rows from each group."""
    order = [F.desc("score"), F.asc_nulls_last("id"), "part"]
    best = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    last = best(best(found.withColumn("group", F.pmod("part", F.lit(GROUPS))), "query", "group"), "query")
    looked_up = found.groupBy("query").agg(F.sum("looked_up").alias("looked_up"))
    return last.drop("looked_up").join(looked_up, "query").select("item", "rank", "id", "score", "looked_up")
