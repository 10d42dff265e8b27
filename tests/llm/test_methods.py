"""The methods inside the operators, each against a plain version of itself."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from boutline.llm import hilbert, quality, sentencepieces, simhash, toxicity

O, I, T, G, N, R = range(6)


def plain_paths(symbols):
    """Paths of one clause, looked up around each piece of evidence."""
    kinds, out = [s for s, _ in symbols], {}
    for p, (kind, weight) in enumerate(symbols):
        if kind not in (I, T):
            continue
        before, after = kinds[max(0, p - 5) : p], kinds[p + 1 : p + 6]
        ahead = next((k for k in after if k in (I, T, G) and not (kind == I and k == T)), None)
        if G in before:
            way = "aimed"
        elif kind == I and (I in before or ahead == I):
            way = "piled"
        else:
            way = "aimed" if ahead == G or (kind == T and ahead == I) else "lone"
        mark = "reported " if R in kinds else "negated " if N in kinds[max(0, p - 3) : p] else ""
        path = f"{mark}{way} {'insult' if kind == I else 'threat'}"
        out[path] = out.get(path, 0) + weight
    return out


def test_composed_transducer_walks_as_the_five_do():
    rng, table = random.Random(4), toxicity.compose(toxicity.cascade())
    seen = set()
    for _ in range(20_000):
        symbols = [(rng.choice([O, O, O, I, T, G, N, R] if rng.random() < 0.7 else [O, O, O, O, I]), rng.randrange(1, 9)) for _ in range(rng.randrange(14))]
        got, want = toxicity.clause_paths(symbols, table), plain_paths(symbols)
        assert got == want, symbols
        seen |= want.keys()
    assert seen == set(toxicity.PATHS)
    for symbols in ([I, G], [G, O, I], [R, I], [I, O, R], [N, O, I], [T, O, I], [I] * 9):  # the composed table against the cascade, step by step
        state, states, steps = 0, ((),) * 5, toxicity.cascade()
        for s in symbols:
            state, events = table[state][s]
            states, want = toxicity.step_all(steps, states, s)
            assert events == want


def auc(scores, y):
    scores, y = np.array(scores), np.array(y)
    p, q = scores[y == 1], scores[y == 0]
    return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / len(p) / len(q)


def word_sum(texts, lexicon):
    out = []
    for t in texts:
        words = toxicity.WORD.findall(t.lower())
        total = sum(g[1] for g in map(lexicon.__getitem__, words) if g and g[0] in (I, T))
        out.append([np.log1p(total), np.log1p(1000 * total / (len(words) + 50))])
    return np.array(out)


def both_aucs(words, beginnings, train, test):
    model = toxicity.Model(words, beginnings, None)
    read, lexicon = model.reader(), toxicity.Lexicon(words, beginnings)
    y = np.array([k for _, k in train], float)
    model.weights = toxicity.logistic(read([t for t, _ in train])[0], y)
    w = toxicity.logistic(word_sum([t for t, _ in train], lexicon), y)
    plain = word_sum([t for t, _ in test], lexicon) @ np.array(w[1:])
    return auc(model.scores(read([t for t, _ in test])[0]), [k for _, k in test]), auc(plain, [k for _, k in test])


def test_grammar_tells_clauses_apart_that_hold_the_same_words():
    rng = random.Random(2)
    bad = "you are an {i}.|{i}, that is what they are.|he will {t} you.|we {t} them, the {i}.".split("|")
    good = "she said you are an {i}.|you are not an {i}.|the word {i} has letters in it, as many words do.|he never said he would {t} you.|the sun will {t} the weeds in the garden by noon.".split("|")

    def text(y):
        parts = ["The meeting was long.", rng.choice(bad if y else good), "It rained, too."]
        return " ".join(parts).format(i=rng.choice(toxicity.INSULTS[:8]), t=rng.choice(toxicity.THREATS[:4])), y

    grammar, plain = both_aucs({}, {}, [text(k % 2) for k in range(400)], [text(k % 2) for k in range(400)])
    assert grammar > 0.97 and plain < 0.8


def test_grammar_adds_to_the_words_on_held_out_rows():
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = [(docs[r["doc_id"]], r["toxic"], zlib.crc32(str(r["doc_id"]).encode()) % 5) for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()]
    train, test = [(t, y) for t, y, k in labels if k], [(t, y) for t, y, k in labels if not k]
    counts = ({}, {})
    for t, y in train:
        words = set(toxicity.WORD.findall(t.lower()))
        for w in words | {w[:n] + "*" for w in words for n in toxicity.PREFIXES if len(w) > n}:
            counts[y][w] = counts[y].get(w, 0) + 1
    n1 = sum(y for _, y in train)
    words, beginnings = toxicity.choose_terms([(w, k, counts[0].get(w, 0)) for w, k in counts[1].items() if k >= 3], n1, len(train) - n1, least_odds=2.2, least_evidence=15.0)
    grammar, plain = both_aucs(words, beginnings, train, test)
    print(f"held-out AUC {grammar:.4f}, of the sum of word weights {plain:.4f}")
    assert grammar > plain


@pytest.mark.parametrize("threshold", [1, 2])
def test_every_pair_within_the_threshold_meets_at_an_anchor(threshold):
    radius, rng = 1 + (threshold + 1) // 2, random.Random(9)
    flips = [0, *(1 << a for a in range(64)), *((1 << a | 1 << b for a in range(64) for b in range(a)) if threshold == 2 else ())]
    for x in (0, (1 << 64) - 1, rng.getrandbits(64), rng.getrandbits(64)):
        fp = np.array([x ^ f for f in flips], np.uint64)
        import pandas as pd

        found = {}
        for part in simhash._under_anchors(radius)([pd.DataFrame({"fp": fp.view(np.int64), "rep": np.arange(len(fp))})]):
            for anchor, rep in zip(part["anchor"].tolist(), part["rep"].tolist()):
                found.setdefault(rep, set()).add(anchor)
        assert all(found[0] & found[k] for k in range(len(flips)))
        assert max(map(len, found.values())) <= (64 if threshold == 2 else 32) + 1


def test_discriminant_against_inverse_and_determinant():
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.4).astype(float)
    x = rng.normal(size=(600, 4)) @ rng.normal(size=(4, 4)) + y[:, None] * [0.5, -1, 0, 2]
    got = quality.Discriminant(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    sizes = [(y == k).sum() for k in (0, 1)]
    pooled = (sizes[0] * covs[0] + sizes[1] * covs[1]) / 600
    logs = []
    for k in (0, 1):
        w = min(1.0, 0.2 + 4 / sizes[k])
        s = (1 - w) * covs[k] + w * pooled
        s = 0.98 * s + (0.02 * np.trace(s) / 4 + 1e-4) * np.eye(4)
        m = z - z[y == k].mean(0)
        logs.append(np.log(sizes[k] / 600) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", m, np.linalg.inv(s), m))
    d = logs[1] - logs[0]
    assert np.allclose(got.difference(x), np.sign(d) * np.log1p(np.abs(d)))
    # equal rows tie, and the order of the rows changes nothing
    twice, back = got.score(np.r_[x, x]), np.random.default_rng(1).permutation(600)
    assert (twice[:600] == twice[600:]).all() and np.allclose(quality.Discriminant(x[back], y[back]).score(x), got.score(x))


def unigram_model(byte_fallback):
    """A small unigram model by rule: all letters, all pairs of some of them, and some words, with scores that fall with the hash of the piece."""
    proto = sentencepiece_model_pb2.ModelProto()

    def add(piece, score, kind):
        p = proto.pieces.add()
        p.piece, p.score, p.type = piece, score, kind

    add("<unk>", 0, sentencepieces.UNKNOWN)
    add("<s>", 0, sentencepieces.CONTROL)
    add("</s>", 0, sentencepieces.CONTROL)
    if byte_fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", 0, sentencepieces.BYTE)
    letters = "abcdefghijklmnopqrstuvwxyz▁.,éü"
    pieces = [*letters, *(a + b for a in "aeiout▁" for b in "nrsthe"), *"▁the ing tion ▁an er▁ ▁of▁ ess ent ▁▁".split(" ")]
    for n, p in enumerate(dict.fromkeys(pieces)):
        add(p, -3 - 0.37 * len(p) - zlib.crc32(p.encode()) % 1000 / 300 + n * 1e-5, sentencepieces.NORMAL)
    proto.trainer_spec.model_type = sentencepieces.UNIGRAM
    proto.trainer_spec.byte_fallback = byte_fallback
    proto.trainer_spec.vocab_size = len(proto.pieces)
    proto.normalizer_spec.name = "identity"
    return proto.SerializeToString()


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_scores_against_the_library(documents, byte_fallback):
    model = unigram_model(byte_fallback)
    texts = [t or "" for t in documents.values()] + ["", " ", "  the  end ", "<s> the </s>", "東京 tower", "\x00\x01", "a" * 5000, "the " * 20_000]
    assert sentencepieces.parity(model, texts) == []
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert any(len(theirs.encode(t)) > 1 for t in texts)


def test_user_defined_pieces_are_refused():
    proto = sentencepieces.parse(unigram_model(True))
    p = proto.pieces.add()
    p.piece, p.score, p.type = "<tool>", 0, sentencepieces.USER_DEFINED
    with pytest.raises(ValueError):
        sentencepieces.build(proto.SerializeToString())


def test_shards_prune_by_every_dimension(spark, tmp_path):
    """A range over one dimension leaves fewer than half of the shards; laid out by id it leaves nearly all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    path = str(tmp_path / "shards")
    shards = hilbert.write_shards(spark, docs, path, shards=64).cache()
    back = spark.read.parquet(path)
    assert back.drop("shard").columns == docs.columns and back.count() == docs.count()
    assert {(r["shard"], r["rows"]) for r in shards.collect()} == {(r["shard"], r["count"]) for r in back.groupBy("shard").count().collect()}
    placed = hilbert.shard_documents(spark, docs, shards=64)
    by_id = hilbert.manifest(placed.withColumn("shard", F.ntile(64).over(__import__("pyspark").sql.Window.orderBy("id")) - 1)).cache()
    langs = [r[0] for r in placed.select("lang_level").distinct().collect()]
    for dimension, values in (("lang_level", langs), ("source_level", range(32)), ("size", [200, 1000, 3000, 12_000])):
        left, flat = (np.mean([hilbert.may_hold(m, dimension, v, v).count() for v in values]) / 64 for m in (shards, by_id))
        print(dimension, round(left, 2), round(flat, 2))
        assert left < 0.5 < flat


def test_small_groups_are_compared_as_large_ones(spark, monkeypatch):
    """Links and components with all groups compared one by one, and with the small ones together, are those of all pairs."""
    from boutline.llm import embeddings

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    vec = np.concatenate([c + rng.normal(size=(n, 8)) * s for c, n, s in zip(centres, [1, 2, 3, 5, 9, 30, 60, 70, 2, 2, 1, 4], [0.05, 0.1, 0.15] * 4)])
    vec[3], vec[4] = vec[2], vec[2] * 1e200
    unit = vec / np.abs(vec).max(1)[:, None]
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    near = unit @ unit.T >= 0.98
    want = {k: int(near[k].sum() - 1) for k in range(len(vec))}
    data = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(vec)], "vec_id long, embedding array<double>, label int").repartition(1).cache()
    for small, block in ((48, 1024), (0, 1024), (48, 8)):
        monkeypatch.setattr(embeddings, "SMALL", small)
        got = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.near_duplicates(spark, data, block=block).collect()}
        assert {k: n for k, (n, _) in got.items()} == want, (small, block)
        assert all(got[a][1] == got[b][1] for a, b in zip(*np.nonzero(near)))


def test_hashes_that_meet_do_not_remove_bytes(monkeypatch):
    """With a hash that is the same for all left parts, suffix resolution goes by the bytes."""
    from boutline.llm import suffixes

    rng = random.Random(8)
    body = bytes(rng.choice(b"abcdefgh") for _ in range(90))
    texts = [bytes([a]) * 20 + body + bytes([b]) * 20 for a, b in ((65, 66), (67, 66), (65, 66), (65, 68))]
    entries = sorted((t[20:119], t[:20], 20, n, n + 100, 20) for n, t in enumerate(texts))
    table, rights, blob = suffixes.read_run(suffixes.write_run(entries))
    shared = np.array([suffixes.lcp(a, b, 0) for a, b in zip([b"", *rights], rights)], np.uint8)
    lefts = [e[1] for e in entries]
    want = sorted(suffixes.resolve(table, shared, lefts))
    seen, plain = {}, {}
    for n, t in enumerate(texts):
        for w in range(20):  # the windows that these suffixes stand for
            if t[w : w + 100] in seen:
                plain.setdefault(n, set()).update(range(w, w + 100))
            seen.setdefault(t[w : w + 100], n)
    removed = lambda spans: {i: set().union(*(range(a, b) for j, _, a, b in spans if j == i)) for i in {s[0] for s in spans}}
    assert removed(want) == plain
    monkeypatch.setattr(suffixes.xxhash, "xxh64_intdigest", lambda *a, **k: 7)
    monkeypatch.setattr(suffixes, "_RANDOM", np.zeros(256, np.uint64))
    assert removed(suffixes.resolve(table, shared, lefts)) == removed(want)
