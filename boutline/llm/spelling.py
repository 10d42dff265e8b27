"""Spelling variants: words one edit apart, by Levenshtein automata over broadcast trie shards.

1. Words are counted over whole texts, in the tasks first, then by a shuffle of (word, n).
2. The counted words are sorted, and each sorted run of bounded size becomes one compact trie: nodes in breadth-first order, so that a node's children are
   neighbours; labels, first children and word numbers are flat arrays, and where only one word is left its rest is a stored tail.
3. A group of shards of bounded size is broadcast at a time.  Each word's distance-one automaton is run through every shard of the group depth-first: before
   the edit a node stands for a prefix of the word, after it only the word's own next character goes on.  A shard whose words all differ from the
   word in the first two characters is left at its root.
4. Accepted neighbours are reduced at once to their number and the best of them, by word over all shards; forms are followed by pointer doubling.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.arrows import sliced
from boutline.llm.scratch import Scratch

#: Different words that a task counts before it hands the counts on.
HELD = 200_000
#: Words of a trie shard (about 40 bytes each).
SHARD = 100_000
#: Bytes of the shards that are broadcast together; a shard of very long words may be larger, and then goes alone.
GROUP = 32 << 20
#: Characters of a word run, after A-Z are lower-cased.
RUN = "[a-z\u00C0-\u00FF]+"


class Trie:
    """A compact trie of sorted words with their counts.

    Node v's children are the nodes first[v] to first[v + 1], their labels the characters of `labels` at the same places.  ends[v] is the number of the word that
    ends at v, or -1.  A node with tails[v] >= 0 has no children: one word goes through it, that number, and its rest is read from the words themselves."""

    def __init__(self, words: list[str], counts: list[int]):
        labels, first, ends, tails = ["\0"], array("i"), array("i"), array("i")
        level = [(0, len(words), 0)]  # words from, to, and depth, of each node of a level
        while level:
            below = []
            for a, b, depth in level:
                first.append(len(labels))
                alone = b - a == 1 and depth > 0
                tails.append(a if alone else -1)
                ends.append(a if not alone and a < b and len(words[a]) == depth else -1)
                at = b if alone else a + (ends[-1] >= 0)
                while at < b:
                    c, to = words[at][depth], at
                    while to < b and words[to][depth] == c:
                        to += 1
                    labels.append(c)
                    below.append((at, to, depth + 1))
                    at = to
            level = below
        first.append(len(labels))
        self.labels, self.first, self.ends, self.tails = "".join(labels), first, ends, tails
        self.text, self.starts = "".join(words), array("q", np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64).tobytes())
        self.counts = array("q", counts)

    def word(self, k: int) -> str:
        return self.text[self.starts[k] : self.starts[k + 1]]

    def near(self, word: str) -> set[int]:
        """Numbers of the words that differ from `word` by exactly one inserted, deleted or replaced character."""
        found: set[int] = set()
        labels, first, ends, tails, n = self.labels, self.first, self.ends, self.tails, len(word)
        find, text, starts = labels.find, self.text, self.starts

        def follow(node: int, depth: int, at: int) -> None:
            """The edit is made: the node spells `depth` characters, and word[at:] must follow."""
            while tails[node] < 0:
                if at == n:
                    if ends[node] >= 0:
                        found.add(ends[node])
                    return
                node = find(word[at], first[node], first[node + 1])
                if node < 0:
                    return
                depth += 1
                at += 1
            k = tails[node]
            if starts[k + 1] - starts[k] - depth == n - at and text.startswith(word[at:], starts[k] + depth):
                found.add(k)

        node, depth = 0, 0
        while tails[node] < 0:  # the node spells word[:depth]
            own, here, after = -1, word[depth : depth + 1], word[depth + 1 : depth + 2]
            if here:
                own = find(here, first[node], first[node + 1])
                follow(node, depth, depth + 1)  # word[depth] is left out
            for child in range(first[node], first[node + 1]):
                if tails[child] >= 0 or not after:
                    follow(child, depth + 1, depth)  # a character is put in
                    if here and child != own:
                        follow(child, depth + 1, depth + 1)  # another stands for word[depth]
                else:  # the same, by the child's own children
                    low, high = first[child], first[child + 1]
                    if (below := find(here, low, high)) >= 0:
                        follow(below, depth + 2, depth + 1)
                    if child != own and (below := find(after, low, high)) >= 0:
                        follow(below, depth + 2, depth + 2)
            if own < 0:
                return found
            node, depth = own, depth + 1
        if one_apart(self.word(tails[node]), word):
            found.add(tails[node])
        return found


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character turns one into the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def slipped(word: str, h: int, every: int) -> str:
    """The word as it stands, or, if `every` divides h, without its character number h modulo its length."""
    return word if h % every else word[: (at := h % len(word))] + word[at + 1 :]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, slip_every: int | None = None) -> DataFrame:
    """(word, n): how often each run of letters (A-Z lower-cased, a-z, U+00C0 to U+00FF) of `least_length` characters or more is in the whole texts.

    With `slip_every`, runs whose crc32 with their row's id it divides lose a character first (see `slipped`), which plants misspellings.  Null texts have no runs, a
    null id counts as the empty string, and every row counts."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    runs = re.compile(RUN.replace("+", f"{{{least_length},}}")).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in sliced(batches, "text"):
            texts = batch.column(1).cast(pa.binary())
            for i, text in zip(batch.column(0).to_pylist(), texts.to_pylist()):
                found = runs(text.lower().decode()) if text else []  # bytes lower only A-Z
                if not slip_every:
                    held.update(found)
                    continue
                seed = zlib.crc32(f"{i or ''}:".encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % slip_every == 0:
                        word = slipped(word, h, slip_every)
                        if len(word) < least_length:
                            continue
                    held[word] += n
            if len(held) >= HELD:
                yield counted(held)
                held.clear()
        if held:
            yield counted(held)

    def counted(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shards(words: DataFrame, size: int) -> DataFrame:
    """(shard, bytes, trie) of sorted words, `size` words at most each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = [], []
        for batch in batches:
            held += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            while len(held) >= size:
                yield packed(held[:size], counts[:size])
                held, counts = held[size:], counts[size:]
        if held:
            yield packed(held, counts)

    def packed(held: list[str], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"trie": [pickle.dumps(Trie(held, counts))]})

    made = words.sortWithinPartitions("word").select("word", "n").mapInArrow(run, "trie binary")
    return made.select(F.monotonically_increasing_id().alias("shard"), F.length("trie").alias("bytes"), "trie")


def _groups(sizes: Iterable, limit: int) -> Iterator[list[int]]:
    """Shard numbers, as many at a time as have `limit` bytes, or one."""
    now, total = [], 0
    for shard, size in sizes:
        if now and total + size > limit:
            yield now
            now, total = [], 0
        now.append(shard)
        total += size
    if now:
        yield now


def _neighbours(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """(word, n, n_near, form_n, form): for each word with neighbours in these shards their number, and the one with the largest count, the first of equals."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [pickle.loads(t) for t in shared.value]
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                n_near, best = 0, None
                for trie in shards:
                    found = trie.near(word)
                    if found:
                        n_near += len(found)
                        top = max(trie.counts[k] for k in found)
                        if best is None or top >= -best[0]:
                            here = (-top, min(trie.word(k) for k in found if trie.counts[k] == top))
                            best = here if best is None else min(best, here)
                if best:
                    rows.append((word, n_near, -best[0], best[1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "form_n", "form"])

    return words.select("word").mapInArrow(run, "word string, n_near long, form_n long, form string")


def variants(
    spark: SparkSession,
    words: DataFrame,
    *,
    least_count: int = 5,
    times: int = 5,
    shard: int = SHARD,
    group: int = GROUP,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `words` (word, n) that occurs `least_count` times or more in all.

    n_near: other such words that one edit apart; form: the one of them with the largest count (of equals the first in code-point order), if that is `times` times the
    word's own or more, else null, and form_n its count, else null; root: the word reached by following forms to the last.  Rows of one word are added up; null
    and empty words are left out; other columns are ignored; an empty table gives no rows."""
    scratch = Scratch(spark, "spelling")
    clean = words.where("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= least_count)
    kept = scratch.table(clean, "words")
    parts = max(1, -(-kept.count() // shard))
    tries = scratch.table(_shards(kept.repartitionByRange(parts, "word"), shard), "shards")
    sizes = [(r["shard"], r["bytes"]) for r in tries.select("shard", "bytes").orderBy("shard").collect()]  # two numbers a shard
    found = [kept.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))]
    for number, chosen in enumerate(_groups(sizes, group)):
        blobs = [bytes(r["trie"]) for r in tries.where(F.col("shard").isin(chosen)).select("trie").collect()]  # GROUP bytes at most, or one shard
        near = scratch.table(_neighbours(kept, blobs), f"near-{number}")
        found.append(near.select("word", F.lit(0).cast("long").alias("n"), "n_near", "form_n", "form"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.when(F.col("form_n").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))).alias("best")
    reduced = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    has_form = -F.col("best.less") >= times * F.col("n")
    table = scratch.table(reduced.select("word", "n", "n_near", F.when(has_form, F.col("best.form")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(scratch, table.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(word, root) with each root followed to its end.  Each round doubles the steps that a link stands for; counts grow along links, so there is no circle."""
    now = scratch.table(links, "links")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        further = scratch.table(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "further")
        scratch.drop(now)
        now = further
        if further.where("moved").isEmpty():
            return further.select("word", "root")
