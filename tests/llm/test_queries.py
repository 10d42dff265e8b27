"""Each registered query against a plain brute-force version on small tables, or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from boutline.llm import queries, sentencepieces

DATA = "/root/testdata"


def rows(spark, name, sf_dir):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()]


def same_as_sql(got, name, sf_dir, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    plain = lambda rs: Counter(tuple(str(r[c]) for c in names) for r in rs)
    assert plain(got) == plain([dict(zip(names, r)) for r in want.fetchall()])


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    count = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(runs))


def test_op3(spark, small, documents):
    got = rows(spark, "op3_simhash", small)
    fp = {i: plain_fingerprint(t) for i, t in documents.items()}
    ids = list(fp)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    part = smallest_reachable(ids, links)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", part[i]) for i in ids}


def test_op4(spark, small, documents):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, {}
    for i in sorted(documents):
        ids = tok.encode(documents[i] or "", add_special_tokens=False).ids + [1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op4_repair", small)} == want


def test_op6(spark, small, documents):
    got = rows(spark, "op6_hilbert", small)
    assert len(got) == len(documents)
    for r in got:
        data = (documents[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ordered] == sorted(r["curve"] for r in got)
    # equal texts are one run: only a group at the border of two shards is cut
    groups = {}
    for rank, r in enumerate(ordered):
        groups.setdefault(documents[r["doc_id"]] or "", []).append(rank)
    assert all(g[-1] - g[0] == len(g) - 1 for g in groups.values()) and max(map(len, groups.values())) > 1


def test_op7(spark, small, documents):
    seen, want = set(), {}
    for i in sorted(documents):
        b = (documents[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        spans = len(re.findall(rb"\x01+", gone))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op7_suffixes", small)}
    assert got == want and sum(w[1] for w in want.values()) > 1000


PATTERNS = {
    "assign": (re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8),
    "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 16),
    "hex": (re.compile(r"([0-9a-f]+)"), 32),
}


def test_op2(spark, small, documents):
    got = {r["doc_id"]: r for r in rows(spark, "op2_secrets", small)}
    assert got.keys() == documents.keys()
    for i, text in documents.items():
        spans = {k: [m.span() for m in p.finditer(text or "") if len(m[1]) >= n] for k, (p, n) in PATTERNS.items()}
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, list(PATTERNS).index(k), k, b) for k, s in spans.items() for a, b in s))
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [len(s) for s in spans.values()]
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert not joined or set(joined.split(",")) <= set(got[i]["spans"].split(","))
    same_as_sql(got.values(), "op2_secrets", small, "documents")


def test_op8(spark, small, documents):
    theirs = sentencepiece.SentencePieceProcessor(model_file=queries.SENTENCEPIECE_MODEL)
    for r in rows(spark, "op8_sentencepiece", small):
        ids = theirs.encode(documents[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r["doc_id"]
    model = open(queries.SENTENCEPIECE_MODEL, "rb").read()
    assert sentencepieces.parity(model, [t or "" for t in documents.values()]) == []


def plain_leaks(docs, items):
    """For each document and item, the best similarity over all windows of the item's length (cut at the edges)."""
    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    out = {}
    for i, text in docs.items():
        w = words(text)
        for item, body in items.items():
            v = words(body)
            k, n = min(5, len(v)), len(v)
            target = Counter(tuple(v[a : a + k]) for a in range(n - k + 1))
            have = [tuple(w[a : a + k]) for a in range(len(w) - k + 1)]
            if not set(have) & target.keys():
                continue
            best = 0
            for a in range(-n + 1, len(w)):
                run = Counter(have[max(a, 0) : max(0, min(a + n, len(w)) - k + 1)])
                shared = sum((run & target).values())
                best = max(best, shared / max(1, sum(run.values()) + sum(target.values()) - shared))
            if best >= 0.8:
                out[i, item] = round(best, 6)
    return out


def test_op9(spark, small, documents):
    got = rows(spark, "op9_decontaminate", small)
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()}
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == plain_leaks(documents, items)
    same_as_sql(got, "op9_decontaminate", small, "documents", "benchmark")


def test_op10(spark, small):
    same_as_sql(rows(spark, "op10_embeddings", small), "op10_embeddings", small, "embeddings")


@pytest.mark.parametrize("name, label, held, limit, least", [("op1_toxicity", "toxic", lambda c: c % 5 == 0, 0.5, 0.96), ("op5_quality", "quality", lambda c: c % 4 == 2, 0.7, 0.98)])
def test_held_out_accuracy(spark, name, label, held, limit, least):
    sf_dir = f"{DATA}/sf0.1"
    got = {r["doc_id"]: r for r in rows(spark, name, sf_dir)}
    assert len(got) == pq.read_table(f"{sf_dir}/documents.parquet").num_rows
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    for i, r in got.items():
        assert r["held_out"] == held(zlib.crc32(str(i).encode())) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= limit)
    out = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    right = sum((s >= limit) == bool(y) for s, y in out) / len(out)
    print(name, len(out), f"auc {auc:.4f} accuracy {right:.4f}")
    assert auc >= least


def test_pipeline(spark, small, documents):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, cols = documents, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == cols, name
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert now.keys() <= before.keys()
        gone = before.keys() - now.keys()
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in queries.QUERIES["op1_toxicity"](spark, small).collect()}
            assert gone == {i for i, s in scores.items() if s >= 0.5} and gone
            assert all(now[i] == before[i] for i in now)
        elif name == "simhash":
            fp = {i: plain_fingerprint(t) for i, t in before.items()}
            ids = list(fp)
            part = smallest_reachable(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
            assert now.keys() == {i for i in ids if part[i] == i}
        elif name == "decontaminate":
            items = {r["item_id"]: r["text"] for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()}
            assert gone == {i for i, _ in plain_leaks(before, items)} and gone
        elif name == "secrets":
            assert not gone and any(now[i] != before[i] for i in now) and all(now[i] == before[i] or "<SECRET>" in now[i] for i in now)
        before = now
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    theirs = sentencepiece.SentencePieceProcessor(model_file=queries.SENTENCEPIECE_MODEL)
    assert {i: r["ids"] for i, r in last.items()} == {i: theirs.encode(t or "") for i, t in before.items()}
