"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Every candidate value is hashed, and each hash is counted by distinct repositories and owners over the whole corpus.  A value
held by one owner alone looks live, in however many of the owner's repositories (forks) it stands; one held by many owners, or by two in many repositories,
is a widely copied example.  Spans are code point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.scratch import Scratch

KINDS = ("assign", "access", "hex", "opaque")
BASE = KINDS[:3]


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = f"""({"|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: pattern, group of the value, least length of the value.  For access and hex the quantifier is the least length: their matches are whole runs.
PATTERNS = {"assign": (ASSIGN, 2, 8), "access": ("(AKIA[A-Z0-9]{12,})", 1, 16), "hex": ("([0-9a-f]{32,})", 1, 32), "opaque": ("([A-Za-z0-9+/_-]{20,})", 1, 20)}
SPAN_LIST = "array<struct<start:int,kind:int,end:int,value:string>>"
CHUNK = 64
MIXED = "(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])"


def kind_spans(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end, value>> of one kind: leftmost matches that don't overlap, short values dropped."""
    pattern, group, least = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))

    def step(state: Column, part: Column) -> Column:
        start = state["pos"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("pos"), F.concat(state["found"], F.array(span)).alias("found"))

    def chunk(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["pos"].alias("pos"), F.array().cast(SPAN_LIST).alias("found")), step)
        return F.struct(inner["pos"].alias("pos"), F.concat(state["found"], F.array(inner["found"])).alias("found"))

    # a fold copies its list at each step: hits are folded CHUNK at a time, so a text full of them costs little more a hit
    last = F.floor(F.greatest(F.size(parts) - 1, F.lit(0)) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(parts, k * CHUNK + 1, F.lit(CHUNK)))
    begin = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN_LIST}>").alias("found"))
    walked = F.aggregate(chunks, begin, chunk, lambda state: F.flatten(state["found"]))
    kept = F.filter(walked, lambda s: F.length(s["value"]) >= least)
    if kind == "opaque":
        kept = F.filter(kept, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
        return F.when(text.rlike(MIXED + pattern), kept).otherwise(F.array().cast(SPAN_LIST))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(SPAN_LIST))


def text_spans(text: Column) -> Column:
    """Base spans and, where they overlap none of these, opaque tokens of letters and digits."""
    base = F.concat(*(kind_spans(text, k) for k in BASE))
    return F.struct(base.alias("base"), kind_spans(text, "opaque").alias("more"))


def _apart(found: Column) -> Column:
    """All candidate spans: the opaque ones only where no base span overlaps."""
    more = F.filter(found["more"], lambda m: ~F.exists(found["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return F.concat(found["base"], more)


def ownership(candidates: DataFrame) -> DataFrame:
    """Per hash the numbers of documents, repositories and owners; candidates: hash, repo, owner.  A repository belongs to its owner.
    Each level groups with partial sums, so a value that a third of the rows share costs one row a task."""
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_uses"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan_secrets(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: str | Column = "source",
    repo: str | Column | None = None,
    copied_owners: int = 3,
    copied_repos: int = 5,
    carry: Column | None = None,
) -> DataFrame:
    """One row for each row of `docs`: row, id (, carry: a column to come along), spans array<struct<start, kind, end, class, n_owners, n_repos>> by start and kind.

    owner and repo: who holds a document, and in what collection of theirs; on a corpus without repositories the queries take `source` as owner and
    (source, lang) as its repositories.  class: `live` for a value of one owner with 8 distinct characters at least, `copied` for one of `copied_owners`
    owners or more, or of two owners or more in `copied_repos` repositories or more, else `unclear`.  Opaque tokens (letters and digits, 20 characters or more, outside base spans) count as spans only if live.
    Null texts are empty; null owners or repositories are one owner or repository; repeated rows each come back; other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "secrets")
    owner = F.col(owner) if isinstance(owner, str) else owner
    repo = owner if repo is None else F.col(repo) if isinstance(repo, str) else repo
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [] if carry is None else [carry.alias("carry")]
    rows = docs.select(*kept, F.col(id_col).alias("id"), text.alias("text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"))
    found = rows.select(F.monotonically_increasing_id().alias("row"), "*").withColumn("found", text_spans(F.col("text")))
    spans = F.transform(
        _apart(F.col("found")),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), (F.size(F.array_distinct(F.split(s["value"], ""))) >= 8).alias("mixed")),
    )
    found = scratch.table(found.select("row", "id", *(["carry"] if kept else []), "owner", "repo", spans.alias("spans")), "found")
    used = found.where("size(spans) > 0").select("row", "id", "owner", "repo", F.explode("spans").alias("s"))
    counts = scratch.table(ownership(used.select(F.col("s.hash").alias("hash"), "owner", "repo")), "counts")
    sort = F.when((F.col("n_owners") >= copied_owners) | ((F.col("n_owners") >= 2) & (F.col("n_repos") >= copied_repos)), "copied").when((F.col("n_owners") == 1) & F.col("s.mixed"), "live").otherwise("unclear")
    classed = used.select("row", "id", "s", F.col("s.hash").alias("hash")).join(counts, "hash").withColumn("class", sort).where((F.col("s.kind") < len(BASE)) | (F.col("class") == "live"))
    item = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("class"), F.col("n_owners"), F.col("n_repos"))
    listed = classed.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("got"))
    some = found.where("size(spans) > 0").drop("spans", "owner", "repo").join(listed, "row", "left")
    none = found.where("size(spans) = 0").drop("spans", "owner", "repo").withColumn("got", F.lit(None).cast(listed.schema["got"].dataType))
    return some.unionByName(none).withColumn("spans", F.coalesce("got", F.array().cast(listed.schema["got"].dataType))).drop("got")


def may_hold_secrets(text: Column) -> Column:
    """Whether a text matches a pattern at all; false for null."""
    tests = [text.rlike((MIXED if k == "opaque" else "") + pattern) for k, (pattern, _, _) in PATTERNS.items()]
    return F.coalesce(tests[0] | tests[1] | tests[2] | tests[3], F.lit(False))


def redact_documents(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """`docs`, same rows and columns, with each secret that isn't a widely copied example replaced in its text (and the new length in `length_col`, if
    there is one).  Texts that hold none are left as they are, null ones too."""
    hit = may_hold_secrets(F.col(text_col))
    found = scan_secrets(spark, docs.where(hit), id_col=id_col, text_col=text_col, carry=F.struct("*"), **options)
    text = redacted(F.col(f"carry.`{text_col}`"), F.filter("spans", lambda s: s["class"] != "copied"))
    fresh = found.select(text.alias("fresh"), "carry")
    kind = dict(docs.dtypes).get(length_col)
    new = {text_col: F.col("fresh")} | ({length_col: F.length("fresh").cast(kind)} if kind else {})
    return docs.where(~hit).unionByName(fresh.select(*(new.get(c, F.col(f"carry.`{c}`")).alias(c) for c in docs.columns)))


def joined_spans(spans: Column) -> Column:
    """`kind:start:end` by start and kind, with commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """`text` with the spans (by start; overlaps are joined) replaced by `mark`."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        add = F.when(fresh, F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], add).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, step, lambda st: F.concat(st["out"], F.substring(text, st["at"] + 1, F.length(text)))))
