"""Duplicate passages by a sparse, distributed suffix sort that never re-compares known prefixes.

A repeated string of `match` bytes has the same content-defined sample inside wherever it stands: the gram of GRAM bytes with the least hash
(leftmost of equals).  So only suffixes at samples are sorted, each with the bytes to its left that its windows need.

1. Duplicate detection: hashes of samples' grams are exchanged first, as in distributed prefix-doubling string sorting; a gram that occurs
   once cannot be part of a repeat, and its suffix isn't exchanged.
2. Runs: each task sorts its suffixes, folds equal ones to the first, and sends front-coded runs (length of the prefix shared with the
   string before, and the rest) to the bucket of the gram.  A gram with over HOT occurrences is cut up: each of its windows becomes a suffix of its own, in the bucket of
   the window's hash, so that no bucket gathers a hot gram.
3. A loser tree merges a bucket's runs.  Each string carries the length of the prefix it shares with the last winner; unequal lengths decide a
   match without a look at bytes, equal ones are compared from there on.  The shared lengths that come out are the LCP array.
4. A window that takes r bytes left of its sample equals another if the LCP between them is `match` - r at least and the r bytes are the
   same.  What isn't first is removed.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.scratch import Scratch

MATCH = 100
GRAM = 32
HOT = 1000
CHUNK = 1 << 21
RUN = 200_000
_RANDOM = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k bytes, k a power of two."""
    h, size = _RANDOM[b], 1
    while size < k:
        n = len(h) - size
        h, size = h[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:], size * 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def samples(b: np.ndarray, ends: np.ndarray, match: int = MATCH, k: int = GRAM):
    """Samples of documents laid end to end (`ends`: where each ends): gram hash, place, and the windows [first, last) that each stands for."""
    none = np.zeros(0, np.int64)
    if len(b) < match:
        return none.astype(np.uint64), none, none, none
    h, width = gram_hashes(b, k), match - k + 1
    n = len(b) - match + 1
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        key, size = np.minimum(key[: len(key) - size], key[size:]), size * 2
    if size < width:
        key = np.minimum(key[:n], key[width - size : width - size + n])
    place = (key[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n + 1, bool)
    starts = np.r_[0, ends[:-1]]
    step = np.zeros(n + 2, np.int32)
    long = ends - starts >= match
    np.add.at(step, starts[long], 1)
    np.add.at(step, ends[long] - match + 1, -1)
    valid[:n] = np.cumsum(step[:n]) > 0
    begin = np.zeros(n, bool)  # a document's first window begins anew
    begin[starts[long]] = True
    fresh = valid[:n] & (begin | np.r_[True, place[1:] != place[:-1]])
    first = np.flatnonzero(fresh)
    stop = np.flatnonzero(~valid)
    last = np.minimum(np.r_[first[1:], n], stop[np.searchsorted(stop, first)]) if len(first) else first
    return h[place[first]], place[first], first, last


def _laid(texts: list[bytes]):
    """Texts end to end in chunks: (indices of the texts, bytes, ends)."""
    at, size, held = 0, 0, []
    for n, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= CHUNK or n == len(texts) - 1:
            yield at, b"".join(held), np.cumsum([len(x) for x in held])
            at, size, held = n + 1, 0, []


def _grams(batches):
    """(gram, row, more): each distinct gram of a chunk with one row that has it, and the others packed."""
    for batch in batches:
        rows = batch["row"].to_numpy()
        for at, data, ends in _laid([t.encode("utf-8", "surrogatepass") for t in batch["text"]]):
            h, place, _, _ = samples(np.frombuffer(data, np.uint8), ends)
            row = rows[at + np.searchsorted(ends, place, side="right")]
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.r_[head, len(h)])
            more = np.full(len(head), None, object)
            for x in np.flatnonzero(size > 1).tolist():
                more[x] = row[head[x] + 1 : head[x] + size[x]].tobytes()
            yield pd.DataFrame({"gram": h[head].view(np.int64), "row": row[head], "more": more})


def _repeated(batches):
    """From rows sorted by gram, (row, gram, hot) of the grams with two occurrences or more.  A hot gram's rows stream through."""
    held, gram, count = [], None, 0
    for batch in batches:
        out: list[tuple] = []
        grams, rows, more = batch["gram"].tolist(), batch["row"].tolist(), batch["more"].tolist()
        for g, r, m in zip(grams, rows, more):
            if g != gram:
                held, gram, count = [], g, 0
            packed = [r] if m is None else [r, *np.frombuffer(m, np.int64).tolist()]
            before, count = count, count + len(packed)
            if count < 2:
                held = packed
            elif count <= HOT:
                held += packed
            else:
                out += [(x, gram, True) for x in set(held + packed)]
                held = []
                continue
            if before < 2 <= count or count >= 2:
                out += [(x, gram, False) for x in set(held if before < 2 else packed)]
        if out:
            yield pd.DataFrame(out, columns=["row", "gram", "hot"])


def lcp(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that share `at` bytes already."""
    low, high = at, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Run:
    """A sorted run: strings, the LCP of each with the one before, and a payload index."""

    def __init__(self, strings: list[bytes], shared: list[int]):
        self.strings, self.shared = strings, shared


def front_code(strings: list[bytes]) -> tuple[list[int], bytes]:
    """LCPs of a sorted list and what is left of its strings."""
    shared, rest, last = [], [], b""
    for s in strings:
        n = lcp(last, s, 0)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, b"".join(rest)


def front_decode(shared: list[int], lengths: list[int], rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for n, size in zip(shared, lengths):
        last = last[:n] + rest[at : at + size - n]
        at += size - n
        out.append(last)
    return out


def merge(runs: list[Run]):
    """Merge sorted runs by a loser tree: yields (run, index in run, LCP with what came before).

    node[k] holds the loser of a match and the prefix it shares with that match's winner.  A string that shares more with the last winner is the
    smaller; at equal lengths the bytes from there on decide, and the loser keeps the length found."""
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r.strings for r in runs] + [[]] * (k - len(runs))
    shared = [r.shared for r in runs]
    at = [0] * k
    node: list[tuple[int, int]] = [(0, 0)] * k

    def play(x: int, lx: int, y: int, ly: int):
        """(winner, its lcp, loser, its lcp); an ended run loses."""
        sx, sy = strings[x], strings[y]
        if at[x] >= len(sx):
            return y, ly, x, lx
        if at[y] >= len(sy):
            return x, lx, y, ly
        if lx > ly:
            return x, lx, y, ly
        if ly > lx:
            return y, ly, x, lx
        a, b = sx[at[x]], sy[at[y]]
        h = lcp(a, b, lx)
        if a[h:] <= b[h:]:
            return x, lx, y, h
        return y, ly, x, h

    def build(n: int) -> tuple[int, int]:
        if n >= k:
            return n - k, 0
        (x, lx), (y, ly) = build(2 * n), build(2 * n + 1)
        x, lx, y, ly = play(x, lx, y, ly)
        node[n] = (y, ly)
        return x, lx

    x, lx = build(1) if k > 1 else (0, 0)
    while at[x] < len(strings[x]):
        yield x, at[x], lx
        at[x] += 1
        lx = shared[x][at[x]] if at[x] < len(strings[x]) else 0
        n = (x + k) // 2
        while n:
            y, ly = node[n]
            x, lx, y, ly = play(x, lx, y, ly)
            node[n] = (y, ly)
            n //= 2


#: id, row, place of the sample, and: bytes of right and left part, LCP, windows
ENTRY = np.dtype([("id", "<i8"), ("row", "<i8"), ("place", "<i4"), ("shared", "u1"), ("right", "u1"), ("left", "u1"), ("windows", "u1")])


def write_run(entries: list[tuple]) -> bytes:
    """entries: sorted (right, left, windows, id, row, place)."""
    shared, rest = front_code([e[0] for e in entries])
    table = np.array([(e[3], e[4], e[5], n, len(e[0]), len(e[1]), e[2]) for e, n in zip(entries, shared)], ENTRY)
    return zstandard.compress(struct.pack("<II", len(entries), len(rest)) + table.tobytes() + rest + b"".join(e[1] for e in entries), 1)


def read_run(data: bytes):
    data = zstandard.decompress(data)
    n, size = struct.unpack_from("<II", data)
    table = np.frombuffer(data, ENTRY, n, 8)
    at = 8 + table.nbytes
    return table, front_decode(table["shared"].tolist(), table["right"].tolist(), data[at : at + size]), data[at + size :]


def _runs(buckets: int, match: int):
    """(bucket, kind, id, row, data): front-coded runs (kind 0), and what a task can already tell is removed (kind 1: packed from, to)."""

    def flush(entries, known):
        entries.sort()
        covers: dict[tuple[int, int], list[int]] = {}
        out, now, bucket = [], [], None
        last = first_id = None
        rows: set[int] = set()
        for e in entries:
            if e[0] != bucket:
                if now:
                    out.append((bucket, 0, 0, 0, write_run(now)))
                bucket, now = e[0], []
            same = e[:4]
            if same != last:
                last, first_id, rows = same, e[4], {e[5]}
            elif e[4] != first_id or e[5] in rows:
                begin = e[6] - len(e[2])
                covers.setdefault(e[4:6], []).extend((begin, begin + e[3] - 1 + match))
                continue
            else:
                rows.add(e[5])
            now.append(e[1:])
        if now:
            out.append((bucket, 0, 0, 0, write_run(now)))
        for (ident, row), x in covers.items():
            out.append((row % buckets, 1, ident, row, np.array(x, "<i4").tobytes()))
        return pd.DataFrame(out, columns=["bucket", "kind", "id", "row", "data"])

    def run(batches):
        entries: list[tuple] = []
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fresh = [n for n, r in enumerate(zip(batch["id"].tolist(), batch["row"].tolist())) if not (r in seen or seen.add(r))]
            batch = batch.iloc[fresh]
            if not len(batch):
                continue
            grams = np.unique(np.concatenate([np.asarray(x, np.int64) for x in batch["grams"]])).view(np.uint64)
            hot = [np.asarray(x, np.int64) for x in batch["hot"] if x is not None and len(x)]
            hot = set(np.concatenate(hot).view(np.uint64).tolist()) if hot else set()
            grams = np.sort(grams)
            ids, rows = batch["id"].tolist(), batch["row"].tolist()
            for at, data, ends in _laid([zstandard.decompress(z) for z in batch["packed"]]):
                h, place, first, last = samples(np.frombuffer(data, np.uint8), ends, match)
                found = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
                keep = grams[found] == h
                doc = np.searchsorted(ends, place[keep], side="right")
                starts = np.r_[0, ends[:-1]][doc]
                for g, p, a, e, d, s in zip(h[keep].tolist(), place[keep].tolist(), first[keep].tolist(), last[keep].tolist(), (doc + at).tolist(), starts.tolist()):
                    if g in hot:
                        for w in range(a, e):
                            right = data[w : w + match]
                            entries.append((xxhash.xxh64_intdigest(right) % buckets, right, b"", 1, ids[d], rows[d], w - s))
                    else:
                        entries.append((g % buckets, data[p : e - 1 + match], data[a:p], e - a, ids[d], rows[d], p - s))
                if len(entries) >= RUN:
                    yield flush(entries, seen)
                    entries = []
        if entries:
            yield flush(entries, seen)

    return run


def ranks(values: list[bytes]) -> np.ndarray:
    """The place of each among the distinct values."""
    at = {v: n for n, v in enumerate(sorted(set(values)))}
    return np.array([at[v] for v in values], np.uint64)


def resolve(table: np.ndarray, shared: np.ndarray, lefts: list[bytes], match: int = MATCH) -> list[tuple[int, int, int, int]]:
    """What is removed, as (id, row, from, to), given a bucket's suffixes in order (`shared`: LCP of each with the one before)."""
    n = len(table)
    if n < 2:
        return []
    ident, row, place = table["id"], table["row"], table["place"].astype(np.int64)
    left, windows, right = table["left"].astype(np.int64), table["windows"].astype(np.int64), table["right"]
    out: list[tuple[int, int, int, int]] = []
    # equal suffixes with equal left parts are one class: its first stays
    cut = (shared < right) | (np.r_[0, right[:-1]] != right)
    equal = np.cumsum(cut)
    same = lambda *cols: np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in cols])
    for digest in (np.array([xxhash.xxh64_intdigest(x) for x in lefts], np.uint64), None):
        digest = ranks(lefts) if digest is None else digest
        order = np.lexsort((place, row, ident, windows, digest, left, equal))
        twin = np.r_[False, same(equal, left, digest, windows)]
        at = np.flatnonzero(twin)
        if all(lefts[a] == lefts[b] for a, b in zip(order[at].tolist(), order[at - 1].tolist())):
            break  # no two left parts had one hash; else once more by the bytes themselves
    again = np.r_[False, same(equal, left, digest, windows, ident, row, place)]
    head = np.maximum.accumulate(np.where(~twin, np.arange(n), 0))
    late = twin & ~again & ((ident[order] != ident[order][head]) | np.r_[False, same(equal, left, digest, windows, ident, row)])
    gone = np.zeros(n, bool)
    gone[order[again]] = True
    covered = order[late]
    gone[covered] = True
    for i, r, p, x, w in zip(ident[covered].tolist(), row[covered].tolist(), place[covered].tolist(), left[covered].tolist(), windows[covered].tolist()):
        out.append((i, r, p - x, p - x + w - 1 + match))
    # grams with one class are done; of the others, each number of bytes taken from the left is a level of its own
    keep = np.flatnonzero(~gone)
    low = np.minimum.reduceat(shared, np.r_[0, keep[:-1] + 1])[: len(keep)] if len(keep) else shared[:0]
    gram = np.cumsum(low < GRAM)
    several = np.bincount(gram, minlength=gram[-1] + 1)[gram] > 1 if len(gram) else np.zeros(0, bool)
    if not several.any():
        return out
    first = np.flatnonzero(several)
    low, keep = low[first], keep[first]  # whole grams go, so the LCPs of those that stay hold
    order = np.lexsort((place[keep], row[keep], ident[keep]))
    least, most = np.full(len(keep), 1 << 30), np.full(len(keep), -1)
    hashed = np.zeros(len(keep), np.uint64)
    reach, few = left[keep], left[keep] - windows[keep] + 1
    pad = np.zeros((len(keep), int(reach.max()) + 1), np.uint8)
    for n_, x in enumerate(keep.tolist()):
        b = lefts[x]
        pad[n_, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
    own_id, own_row = ident[keep], row[keep]
    for r in range(int(reach.max()) + 1):
        if r:
            hashed = hashed * np.uint64(_BASE) + _RANDOM[pad[:, r - 1]]
        at = order[((few <= r) & (r <= reach))[order]]
        if len(at) < 2:
            continue
        group = np.cumsum(low < match - r).astype(np.uint64)
        key = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) ^ (group * np.uint64(0xBF58476D1CE4E5B9))
        by = at[np.argsort(key[at], kind="stable")]
        twin = np.r_[False, key[by][1:] == key[by][:-1]]
        one = np.flatnonzero(twin)
        if (group[by[one]] != group[by[one - 1]]).any() or (pad[by[one], :r] != pad[by[one - 1], :r]).any():
            key = np.zeros(len(keep), np.uint64)  # a hash met by chance: by the bytes themselves
            key[at] = ranks([g.tobytes() + p.tobytes() for g, p in zip(group[at], pad[at, :r])])
            by = at[np.argsort(key[at], kind="stable")]
            twin = np.r_[False, key[by][1:] == key[by][:-1]]
        head = np.maximum.accumulate(np.where(~twin, np.arange(len(by)), 0))
        late = by[twin & ((own_id[by] != own_id[by][head]) | np.r_[False, own_row[by][1:] == own_row[by][:-1]])]
        least[late] = np.minimum(least[late], r)
        most[late] = np.maximum(most[late], r)
    for x in np.flatnonzero(most >= 0).tolist():
        p = int(place[keep[x]])
        out.append((int(own_id[x]), int(own_row[x]), p - int(most[x]), p - int(least[x]) + match))
    return out


def _merge_buckets(match: int):
    """(id, row, spans): what each bucket removes, packed; runs arrive sorted by bucket."""

    def solve(runs: list[bytes]) -> pd.DataFrame:
        read = [read_run(x) for x in runs]
        order = list(merge([Run(strings, table["shared"].tolist()) for table, strings, _ in read]))
        if not order:
            return packed([])
        base = np.cumsum([0] + [len(t) for t, _, _ in read])
        which = np.array([base[x] + i for x, i, _ in order])
        table = np.concatenate([t for t, _, _ in read])[which]
        lefts: list[bytes] = []
        for t, _, blob in read:
            ends = np.cumsum(t["left"].astype(np.int64)).tolist()
            lefts += [blob[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        return packed(resolve(table, np.array([s for *_, s in order]), [lefts[x] for x in which.tolist()], match))

    def packed(found: list[tuple[int, int, int, int]]) -> pd.DataFrame:
        by: dict[tuple[int, int], list[int]] = {}
        for i, r, a, b in found:
            by.setdefault((i, r), []).extend((a, b))
        return pd.DataFrame({"id": [i for i, _ in by], "row": [r for _, r in by], "spans": [np.array(x, "<i4").tobytes() for x in by.values()]})

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            known = batch["kind"].to_numpy() == 1
            if known.any():
                yield pd.DataFrame({"id": batch["id"][known], "row": batch["row"][known], "spans": batch["data"][known]})
            for b, data in zip(batch["bucket"][~known].tolist(), batch["data"][~known].tolist()):
                if b != bucket:
                    if held:
                        yield solve(held)
                    bucket, held = b, []
                held.append(data)
        if held:
            yield solve(held)

    return run


def removed(data: bytes, spans: list[bytes] | None) -> tuple[int, int, bytes]:
    """Number of removed bytes, of maximal removed runs, and the bytes that remain."""
    if spans is None or not len(spans):
        return 0, 0, data
    x = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, x[:, 0], 1)
    np.add.at(depth, x[:, 1], -1)
    gone = np.cumsum(depth[:-1]) > 0
    return int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()


def _pack(batches):
    for b in batches:
        yield pd.DataFrame({"row": b["row"], "id": b["id"], "packed": [zstandard.compress(t.encode("utf-8", "surrogatepass"), 3) for t in b["text"]]})


def _digest(batches):
    for b in batches:
        out = []
        for z, spans in zip(b["packed"], b["spans"]):
            data = zstandard.decompress(z)
            n, k, rest = removed(data, spans)
            out.append((len(data), n, k, hashlib.sha256(rest).hexdigest()))
        yield pd.DataFrame({"id": b["id"], **{c: [x[n] for x in out] for n, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256"))}})


def remove_repeats(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`, without each byte that a `match`-byte string covers which also starts earlier.

    Null texts are empty; a null id comes before all others and comes back as null; rows of one id with different texts don't count as earlier than
    each other; repeated rows each come back with one result; texts under `match` bytes lose nothing; other columns are ignored; an
    empty table gives no rows.  Rows are told apart by id and a hash of the text; window contents are compared by their bytes.  There are as many
    buckets as keep one at about `bucket_bytes` of suffixes, however large the table.
    """
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(ident.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    grams = rows.where(F.octet_length("text") >= match).select("row", "text").mapInPandas(_grams, "gram long, row long, more binary")
    flags = grams.repartition("gram").sortWithinPartitions("gram").mapInPandas(_repeated, "row long, gram long, hot boolean")
    flags = flags.groupBy(F.col("row").alias("of")).agg(F.collect_set("gram").alias("grams"), F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("hot"))
    flags = Scratch(spark, "suffixes").table(flags, "grams")
    n, hot = flags.agg(F.sum(F.size("grams")), F.sum(F.size("hot"))).first()  # a suffix has about 160 bytes, a hot gram's windows some thousand
    buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), (160 * (n or 0) + 4000 * (hot or 0)) // bucket_bytes)
    packed = rows.mapInPandas(_pack, "row long, id long, packed binary")
    with_grams = packed.join(flags, packed.row == flags.of).select("row", "id", "packed", "grams", "hot")
    runs = with_grams.mapInPandas(_runs(buckets, match), "bucket long, kind int, id long, row long, data binary")
    spans = runs.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_merge_buckets(match), "id long, row long, spans binary")
    spans = spans.groupBy(F.col("id").alias("whose"), F.col("row").alias("of")).agg(F.collect_list("spans").alias("spans"))
    joined = packed.join(spans, (packed.row == spans.of) & (packed.id == spans.whose), "left").select("id", "packed", "spans")
    digest = joined.mapInPandas(_digest, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return digest.withColumn("id", F.nullif("id", F.lit(-(1 << 63))))
