"""The registered queries of this subpackage: each applies one operator to its whole table, and shapes the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm import bytebpe, decontaminate, embeddings, hilbert, quality, ranked, repair, secrets, sentencepieces, simhash, spelling, suffixes, toxicity


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash.near_duplicates(spark, docs)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secrets.scan_secrets(spark, docs, owner="source", repo=F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(_of_kind(k)).alias(f"n_{name}") for k, name in enumerate(secrets.BASE)),
        F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("spans")).alias("spans"),
        count(lambda s: s["class"] == "live").alias("n_live"),
        count(lambda s: s["class"] == "copied").alias("n_copied"),
    )


def _sql_spans(kind: str) -> str:
    pattern, group, least = secrets.PATTERNS[kind]
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, {secrets.KINDS.index(kind)} AS kind,
      CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS INT) AS start_at, length(hits[i]) AS n, vals[i] AS v
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {group}) AS vals, string_split_regex(t, {p}) AS gaps FROM d))
    WHERE length(vals[i]) >= {least}"""


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
base AS ({" UNION ALL ".join(_sql_spans(k) for k in secrets.BASE)}),
more AS (SELECT * FROM ({_sql_spans("opaque")}) m WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = m.rid AND b.start_at < m.start_at + m.n AND m.start_at < b.start_at + b.n)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more),
counts AS (SELECT v, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repo)) AS n_repos FROM spans JOIN d USING (rid) GROUP BY v),
classed AS (SELECT s.*, CASE WHEN n_owners >= 3 OR (n_owners >= 2 AND n_repos >= 5) THEN 'copied' WHEN n_owners = 1 AND len(list_distinct(string_split(v, ''))) >= 8 THEN 'live' ELSE 'unclear' END AS class
  FROM spans s JOIN counts USING (v)),
kept AS (SELECT *, ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || start_at || ':' || (start_at + n) AS name FROM classed WHERE kind < 3 OR class = 'live'),
listed AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(name, ',' ORDER BY start_at, kind) FILTER (WHERE kind < 3) AS base_spans, string_agg(name, ',' ORDER BY start_at, kind) AS spans,
  count(*) FILTER (WHERE class = 'live') AS n_live, count(*) FILTER (WHERE class = 'copied') AS n_copied FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN listed USING (rid)"""


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(spark, docs, labels)
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("clauses").alias("n_clauses"), F.col("top").alias("top_clause"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate.find_leaks(spark, docs, items)
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max(F.round("similarity", 6)).alias("similarity"))


OP9_SQL = """
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, string_split(t, ' ') AS w FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM documents) WHERE t <> ''),
it AS (SELECT item_id, len(w) AS n, least(5, len(w)) AS k, w FROM (SELECT item_id, string_split(t, ' ') AS w FROM (SELECT item_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM benchmark) WHERE t <> '' AND item_id IS NOT NULL)),
it2 AS (SELECT DISTINCT ON (item_id, w) row_number() OVER () AS it, * FROM it),
ic AS (SELECT it, n, k, s, count(*) AS c FROM (SELECT it, n, k, unnest(list_transform(range(1, n - k + 2), lambda q: array_to_string(w[q:q + k - 1], ' '))) AS s FROM it2) GROUP BY ALL),
dsh AS (SELECT r, len, k, x.p AS p, x.s AS s FROM (SELECT r, len(w) AS len, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: {'p': p - 1, 's': array_to_string(w[p:p + k - 1], ' ')})) AS x
  FROM dw, (SELECT DISTINCT k FROM it) WHERE len(w) >= k)),
hit AS (SELECT r, it, len, n, dsh.k AS k, c, dsh.s AS s, p, row_number() OVER (PARTITION BY r, it, dsh.s ORDER BY p) AS j FROM dsh JOIN ic ON ic.k = dsh.k AND ic.s = dsh.s),
ends AS (SELECT a.r, a.it, a.len, a.n, a.k, greatest(a.p - a.n + a.k, b.p + 1) AS lo, a.p + 1 AS hi FROM hit a LEFT JOIN hit b ON b.r = a.r AND b.it = a.it AND b.s = a.s AND b.j = a.j - a.c),
sweep AS (SELECT r, it, len, n, k, lo AS s, 1 AS d FROM ends UNION ALL SELECT r, it, len, n, k, hi, -1 FROM ends),
spans AS (SELECT *, sum(d) OVER z AS shared, lead(s) OVER z AS next FROM sweep WINDOW z AS (PARTITION BY r, it ORDER BY s)),
sims AS (SELECT r, it, shared / (least(begun + n, len) - greatest(begun, 0) + n - 2 * (k - 1) - shared) AS similarity FROM (SELECT *, unnest([s, next - 1]) AS begun FROM spans WHERE shared > 0 AND next > s))
SELECT doc_id, item_id, max(round(similarity, 6)) AS similarity FROM sims JOIN dw USING (r) JOIN it2 USING (it) WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""


#: File of the SentencePiece model; read by the driver.
SENTENCEPIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sentencepieces.id_digest(docs, sentencepieces.load(spark, SENTENCEPIECE_MODEL)).withColumnRenamed("id", "doc_id")


#: File of the tokenizer that op4 encodes with; read by the driver.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = sentencepieces.load(spark, TOKENIZER).decode()
    return repair.encode_corpus(spark, docs, tokenizer).withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality(spark, docs, labels)
    return scored.select(F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "distance")


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = hilbert.shard_documents(spark, docs, shards=24)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: coalesce(x, CAST('nan' AS DOUBLE))) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, v.vec_id = c AS kept FROM v JOIN m ON m.vec_id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffixes.remove_repeats(spark, docs).withColumnRenamed("id", "doc_id")


#: Rank file of the byte-level tokenizer; read by the driver.
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op11_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = bytebpe.rebuild(sentencepieces.load(spark, BYTE_RANKS), public_tokenizers.PATTERN)
    return bytebpe.id_digest(docs, made).withColumnRenamed("id", "doc_id")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked.top_documents(spark, docs, items, k=10).withColumnsRenamed({"item": "item_id", "id": "doc_id"}).drop("looked_up")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_all FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * n_docs) // n_all AS m FROM d, s WHERE len(w) > 0),
scored AS (SELECT q, item_id, doc_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY q, item_id, doc_id, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling.variants(spark, spelling.word_counts(docs, slip_every=199))


OP13_SQL = """
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, r, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY doc_id, r),
spelt AS (SELECT r, k, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r) AS x FROM runs),
coded AS (SELECT r, k, list_transform(range(0, len(x) // 2), lambda j: 16 * (strpos('0123456789ABCDEF', x[2 * j + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * j + 2]) - 1) AS b FROM spelt),
hashed AS (SELECT r, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)])), 4294967295) AS h FROM coded, tab),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
one AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cuts c JOIN words w ON w.word = c.d),
near AS (SELECT a, b FROM one UNION SELECT b, a FROM one UNION SELECT x.word, y.word FROM cuts x JOIN cuts y ON x.i = y.i AND x.d = y.d AND x.word <> y.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS top, min(b) FILTER (WHERE n = m) AS form FROM (SELECT a, b, n, max(n) OVER (PARTITION BY a) AS m FROM near JOIN words ON word = b) GROUP BY a),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN form END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM words LEFT JOIN best ON a = word),
chain AS (SELECT word, word AS last, form AS next FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT word, form, last AS root, n, n_near, form_n FROM forms JOIN (SELECT word, last FROM chain WHERE next IS NULL) USING (word)"""


QUERIES = {"op13_spelling": op13_spelling, "op12_ranked": op12_ranked, "op11_bytebpe": op11_bytebpe, "op7_suffixes": op7_suffixes, "op4_repair": op4_repair, "op5_quality": op5_quality, "op6_hilbert": op6_hilbert, "op10_embeddings": op10_embeddings, "op8_sentencepiece": op8_sentencepiece, "op9_decontaminate": op9_decontaminate, "op1_toxicity": op1_toxicity, "op2_secrets": op2_secrets, "op3_simhash": op3_simhash}
ORACLE_SQL: dict[str, str] = {"op13_spelling": OP13_SQL, "op12_ranked": OP12_SQL, "op2_secrets": OP2_SQL, "op9_decontaminate": OP9_SQL, "op10_embeddings": OP10_SQL}
