"""Matching names to candidates by tiers, and claims to targets.

Candidates are found by equality on blocking keys that every tier implies, so no pair outside a block is formed. Rows with equal word lists are
one class while tiers are compared; the classes' ids are attached at the end. A null or empty name matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions.text import name_level, name_words, normalize_name

#: Tiers: equal name, alias, then those of name_level.
EXACT, ALIAS = -2, -1


def _blocks(words: Column, mine: str, theirs: str) -> Column:
    """Keys of which two names that match at any tier share one: the words joined, the words sorted, first three letters plus all but the first word, and for
    subsequences the shorter name's first two words, which stand in this order in the longer one. As the shorter name one has one such key (`mine`), as
    the longer one a key for each pair of its words (`theirs`); a block of a common single word, which would pair all its names, does not exist."""
    rest = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    fixed = F.array(F.concat(F.lit("j:"), F.array_join(words, "")), F.concat(F.lit("s:"), F.array_join(F.array_sort(words), " ")), F.concat(F.lit("f:"), F.substring(F.get(words, F.lit(0)), 1, 3), F.lit(" "), rest))
    pair = lambda tag, a, b: F.concat(F.lit(f"{tag}:"), a, F.lit(" "), b)
    after = lambda i: F.slice(words, i + 2, F.greatest(F.size(words) - i - 1, F.lit(0)))
    longer = F.flatten(F.transform(words, lambda a, i: F.transform(after(i), lambda b: pair(theirs, a, b))))
    shorter = F.when(F.size(words) >= 2, F.array(pair(mine, F.get(words, F.lit(0)), F.get(words, F.lit(1))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(fixed, shorter, longer))


def tiered_match(names: DataFrame, candidates: DataFrame, name: str, ident: str, candidate: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """name, level, match: for each distinct `name`, the candidate of the first tier that has any; null where it has several (J23). At the exact tier the
    smallest id wins, as names that are equal are one person; an alias counts where it names one candidate."""
    wanted = names.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct().withColumn("norm", normalize_name(F.col("name"))).withColumn("words", name_words(F.col("name"))).where("norm != ''")
    found = candidates.select(F.col(ident).alias("id"), F.col(candidate).alias("cand")).where(F.col(candidate).isNotNull())
    found = found.withColumn("norm", normalize_name(F.col("cand"))).withColumn("words", name_words(F.col("cand"))).where("norm != ''")
    by_norm = found.groupBy("norm").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    exact = wanted.join(by_norm, "norm").select("name", F.lit(EXACT).alias("level"), "id", F.lit(1).cast("long").alias("n"))
    tiers = exact
    if aliases:
        table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
        tiers = tiers.unionByName(wanted.select("name", table[F.col("norm")].alias("norm")).join(by_norm, "norm").where("n = 1").select("name", F.lit(ALIAS).alias("level"), "id", "n"))
    mine = wanted.where(F.size("words") > 0).groupBy("words").agg(F.count("*").alias("_")).select(F.col("words").alias("a"))
    theirs = found.where(F.size("words") > 0).groupBy("words").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumnRenamed("words", "b")
    pairs = mine.withColumn("k", F.explode(_blocks(F.col("a"), "x", "y"))).join(theirs.withColumn("k", F.explode(_blocks(F.col("b"), "y", "x"))), "k").select("a", "b", "id", "n").distinct()
    level = pairs.withColumn("level", name_level(F.col("a"), F.col("b"))).where("level IS NOT NULL").groupBy("a", "level").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    tiers = tiers.unionByName(wanted.join(level, F.col("words") == F.col("a")).select("name", "level", "id", "n"))
    best = tiers.groupBy("name").agg(F.min_by(F.struct("level", "id", "n"), "level").alias("_m")).select("name", "_m.*")
    return best.select(F.col("name").alias(name), "level", F.when(F.col("n") == 1, F.col("id")).alias("match"))


def resolve_claims(exact: DataFrame, fuzzy: DataFrame, claimant: str, target: str) -> DataFrame:
    """Exact claims, and fuzzy ones on targets that no exact claim holds and a single claimant claims (J24); claimants with an exact claim make no other."""
    held = exact.select(claimant, target).where(F.col(claimant).isNotNull() & F.col(target).isNotNull()).distinct()
    rest = fuzzy.select(claimant, target).where(F.col(claimant).isNotNull() & F.col(target).isNotNull()).distinct()
    rest = rest.join(held.select(target).distinct(), target, "left_anti").join(held.select(claimant).distinct(), claimant, "left_anti")
    single = rest.groupBy(target).agg(F.count("*").alias("_n"), F.min(claimant).alias(claimant)).where("_n = 1").select(claimant, target)
    return held.withColumn("by", F.lit("exact")).unionByName(single.withColumn("by", F.lit("fuzzy")))
