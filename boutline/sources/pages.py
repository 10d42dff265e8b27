"""Columns read from HTML and XML text (S05-S17): links, tables, attributes, figures, feeds. All are built-in expressions; null text gives null or an
empty array, and malformed markup gives what still matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def all_of(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def plain_text(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(html: Column) -> Column:
    """array<struct<href, text>> in the document's order."""
    tag = r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'
    return F.zip_with(all_of(html, tag, 1), all_of(html, tag, 2), lambda h, t: F.struct(h.alias("href"), plain_text(t).alias("text")))


def absolute(href: Column, base: str) -> Column:
    return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("/"), F.concat(F.lit(base.rstrip("/")), href)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))


def table_urls(html: Column, pattern: str, base: str) -> Column:
    """Distinct absolute links that match, first seen first."""
    return F.array_distinct(F.transform(F.filter(links(html), lambda a: a["href"].rlike(pattern)), lambda a: absolute(a["href"], base)))


def next_page(html: Column, label: str, base: str) -> Column:
    """The first link whose text is `label`, as a pager has it (S05); null on the last page."""
    found = F.filter(links(html), lambda a: F.lower(a["text"]).contains(label.lower()))
    return F.when(F.size(found) > 0, absolute(F.get(found, F.lit(0))["href"], base))


def tables(html: Column) -> Column:
    """array of tables, each an array of rows of cell texts."""
    rows = lambda t: F.transform(all_of(t, r"(?is)<tr\b[^>]*>(.*?)</tr>"), lambda r: F.transform(all_of(r, r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), plain_text))
    return F.transform(all_of(html, r"(?is)<table\b[^>]*>(.*?)</table>"), rows)


def table_records(df: DataFrame, html: str, header: list[str], names: list[str]) -> DataFrame:
    """A row for each row of the tables whose first row is `header` (S04, S06): the columns of df but the markup, `row_number` and `names`."""
    rest = [c for c in df.columns if c != html]
    lower = F.array(*(F.lit(h.lower()) for h in header))
    found = F.filter(tables(F.col(html)), lambda t: F.transform(F.get(t, F.lit(0)), lambda c: F.lower(c)) == lower)
    body = F.flatten(F.transform(found, lambda t: F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))))
    return df.select(*rest, F.posexplode(body).alias("row_number", "_c")).select(*rest, "row_number", *(F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(names)))


def x_of_y(c: Column) -> Column:
    """struct<landed, attempted> of "n of m" (S07)."""
    part = lambda k: F.regexp_extract(c, r"(\d+)\s+of\s+(\d+)", k).try_cast("int")
    return F.when(c.rlike(r"\d+\s+of\s+\d+"), F.struct(part(1).alias("landed"), part(2).alias("attempted")))


def bonuses(html: Column) -> Column:
    """struct<fight, performance>: which bonus icons a page shows."""
    icons = F.transform(all_of(html, r'(?is)<img\b[^>]*\bsrc="([^"]*)"'), lambda s: F.element_at(F.split(s, "/"), -1))
    return F.struct(F.array_contains(icons, "fight.png").alias("fight"), F.exists(icons, lambda i: i.isin("perf.png", "sub.png", "ko.png")).alias("performance"))


def imperial_cm(c: Column) -> Column:
    """Centimetres of 5' 11" or 72" (S09)."""
    feet, inches = F.regexp_extract(c, r"(\d+)'", 1).try_cast("int"), F.regexp_extract(c, r'([\d.]+)\s*"', 1).try_cast("double")
    total = F.coalesce(feet, F.lit(0)) * 12 + F.coalesce(inches, F.lit(0.0))
    return F.when(total > 0, F.round(total * 2.54).cast("int"))


def ranking_lists(df: DataFrame, ident: str, html: str) -> DataFrame:
    """ident, caption, rank, name (S10): a caption's first table counts; the head of a list is its champion (rank 0), unless the list is across divisions."""
    block = r"(?is)<table\b[^>]*>(.*?)</table>"
    caption = lambda t: plain_text(F.regexp_extract(t, r"(?is)<caption[^>]*>(.*?)</caption>", 1))
    lists = df.select(ident, F.posexplode(all_of(F.col(html), block)).alias("_at", "_t")).withColumn("caption", caption(F.col("_t"))).where("caption != ''")
    first = lists.withColumn("_k", F.row_number().over(W.partitionBy(ident, "caption").orderBy("_at"))).where("_k = 1")
    names = first.select(ident, "caption", F.posexplode(F.transform(all_of(F.col("_t"), r"(?is)<a\b[^>]*>(.*?)</a>"), plain_text)).alias("_r", "name"))
    return names.select(ident, "caption", F.when(F.col("caption").rlike("(?i)pound-for-pound"), F.col("_r") + 1).otherwise(F.col("_r")).alias("rank"), "name")


def broadcast_times(html: Column) -> Column:
    """struct<first, last>: the first and last distinct data-timestamp in the document's order."""
    seen = F.array_distinct(all_of(html, r'data-timestamp="(\d+)"'))
    at = lambda k: F.timestamp_seconds(F.try_element_at(seen, F.lit(k)).cast("long"))
    return F.struct(at(1).alias("first"), at(-1).alias("last"))


def event_path(name: Column, day: Column, prefix: str) -> Column:
    """prefix-<number> of a numbered event, else prefix-fight-night-month-dd-yyyy."""
    number = F.regexp_extract(name, rf"(?i)^{prefix}\s+(\d+)", 1)
    return F.when(number != "", F.concat(F.lit(prefix.lower() + "-"), number)).otherwise(F.concat(F.lit(f"{prefix.lower()}-fight-night-"), F.lower(F.date_format(day, "MMMM-dd-yyyy"))))


FEED = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, pubDate: STRING, description: STRING, enclosure: STRUCT<_url: STRING>>>>"


def feed_items(df: DataFrame, xml: str, most: int = 990) -> DataFrame:
    """title, url, published_at, excerpt, image_url of a feed's items that have title, http(s) link of `most` characters at most, and date (S13); malformed
    feeds give no items, and long links drop the item, as a cut link leads elsewhere."""
    return feeds(df, xml, most)[0]


def feeds(df: DataFrame, xml: str, most: int = 990) -> tuple[DataFrame, DataFrame]:
    """(items, report) of a column of feeds (S35): the items of `feed_items` from all feeds that can be read, and for each feed its other columns with `items`, how many were
    taken, `dropped`, how many lack a part, and `error`: null, or why it gave nothing.  One bad feed doesn't stop the rest, and says so in its own row."""
    rest = [c for c in df.columns if c != xml]
    read = df.select(*rest, F.from_xml(xml, f"{FEED}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("f"), F.coalesce(F.trim(xml), F.lit("")).alias("_text"))
    good = lambda i: F.coalesce((F.trim(i["title"]) != "") & i["link"].rlike("(?i)^https?://") & (F.length(i["link"]) <= most) & _published(i).isNotNull(), F.lit(False))
    listed = F.coalesce("f.channel.item", F.array())
    read = read.withColumn("i", F.filter(listed, good))
    items = read.select(*rest, F.explode("i").alias("i")).select(*rest, F.trim("i.title").alias("title"), F.col("i.link").alias("url"), _published(F.col("i")).alias("published_at"), plain_text(F.col("i.description")).alias("excerpt"), F.col("i.enclosure._url").alias("image_url"))
    error = F.when(F.col("_text") == "", "empty feed").when(F.col("f._bad").isNotNull() | F.col("f").isNull(), "malformed feed").when(F.col("f.channel").isNull(), "no channel")
    report = read.select(*rest, F.when(error.isNull(), F.size("i")).otherwise(0).alias("items"), F.when(error.isNull(), F.size(listed) - F.size("i")).otherwise(0).alias("dropped"), error.alias("error"))
    return items, report


def _published(item: Column) -> Column:
    day = F.regexp_replace(item["pubDate"], r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(item["pubDate"], F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")))


ATOM = "entry ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, published: STRING, updated: STRING, summary: STRING, content: STRING>>"


def atom_items(df: DataFrame, xml: str, most: int = 990) -> DataFrame:
    """The same of Atom feeds (S13): the alternate link, else the first; when published, else when updated; the summary, else the content, as excerpt."""
    rest = [c for c in df.columns if c != xml]
    items = df.select(*rest, F.explode(F.from_xml(xml, ATOM, {"mode": "PERMISSIVE"})["entry"]).alias("i"))
    best = F.coalesce(F.get(F.filter("i.link", lambda a: a["_rel"] == "alternate"), F.lit(0)), F.get("i.link", F.lit(0)))["_href"]
    date = F.coalesce(*(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")) for c in ("i.published", "i.updated")))
    d = items.select(*rest, F.trim("i.title").alias("title"), best.alias("url"), date.alias("published_at"), plain_text(F.coalesce("i.summary", "i.content")).alias("excerpt"))
    return d.where((F.col("title") != "") & F.col("url").rlike("(?i)^https?://") & (F.length("url") <= most) & F.col("published_at").isNotNull())


def scraped_result(first: Column, first_result: Column, second: Column, second_result: Column) -> tuple[Column, Column]:
    """Whether a bout is over, and its winner's name (S20): over once either side's result isn't not_finished."""
    over = (first_result != "not_finished") | (second_result != "not_finished")
    return over, F.when(first_result == "win", first).when(second_result == "win", second)


def record_string(wins: Column, losses: Column, draws: Column) -> Column:
    return F.concat_ws("-", *(x.cast("string") for x in (wins, losses, draws)))


def collected_items(df: DataFrame, ident: str, sets: list[str], single: list[str]) -> DataFrame:
    """One row an item (S14): the sorted distinct values of `sets`, and the value of each of `single` where there is exactly one."""
    one = [F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in single]
    return df.groupBy(ident).agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in sets), *one)


def chained_lookup(titles: DataFrame, title_: str, steps: list[DataFrame], images: DataFrame) -> DataFrame:
    """title, page, image (S15, J26): a title goes through each step's (source, target) where it has one, then finds its image (page, image)."""
    d = titles.select(F.col(title_).alias("title")).distinct().withColumn("page", F.col("title"))
    for step in steps:
        one = step.groupBy(F.col("source").alias("page")).agg(F.min("target").alias("_t"))
        d = d.join(one, "page", "left").select("title", F.coalesce("_t", "page").alias("page"))
    return d.join(images.groupBy("page").agg(F.min("image").alias("image")), "page", "left").select("title", "page", "image")


def chosen_photo(override: Column, own: Column, by_language: Column, languages: list[str]) -> Column:
    """The override, else the item's own file, else the first of the languages' pages that has one (S16). `by_language` is a map."""
    return F.coalesce(override, own, *(F.try_element_at(by_language, F.lit(x)) for x in languages))


def flag_country(src: Column) -> Column:
    """Two-letter code of a flag image's path; the code sct is SC, other codes of three letters give null."""
    code = F.upper(F.regexp_extract(src, r"(?i)/([a-z]{2,3})\.(?:png|svg|gif)$", 1))
    return F.when(code == "SCT", "SC").when(F.length(code) == 2, code)
