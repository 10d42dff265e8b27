"""Whole pages read into rows (S04, S06-S09): event, fighter, fight-detail, event-list and bio pages, by rules over `html.extract`.

Each reader takes a frame with a column of markup and gives the frame's other columns with what it read.  What a page lacks is null, an empty string or 0 as the
docstring says; a page of another kind gives no bouts, or a row without values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions.bouts import result_of
from boutline.functions.dates import long_date
from boutline.sources.html import Field, Rows, extract
from boutline.sources.pages import imperial_cm


def resolved(href: Column, base: str) -> Column:
    """An absolute http(s) address, or "" for a missing link or one of another scheme."""
    root = base.rstrip("/")
    scheme = F.regexp_extract(href, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    host = F.concat(F.lit(root.split("://")[0] + ":"), href)
    whole = F.when(F.lower(scheme).isin("http", "https"), href).when(scheme != "", "").when(href.startswith("//"), host).when(href.startswith("/"), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(root + "/"), href))
    return F.when(F.coalesce(href, F.lit("")) == "", "").otherwise(whole)


def whole_number(c: Column) -> Column:
    """The digits that a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(F.trim(c), r"^[+-]?\d+", 0).try_cast("int"), F.lit(0))


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _at(*steps: str | int, **what) -> Field:
    """A field's path from selectors, each followed by the number of the match where it isn't the first."""
    path: list[tuple[str, int]] = []
    for step in steps:
        if isinstance(step, int):
            path[-1] = (path[-1][0], step)
        else:
            path.append((step, 0))
    return Field(tuple(path), **what)


def _read(df: DataFrame, html: str, selector: str | None, fields: dict[str, Field], first: bool = False) -> DataFrame:
    return extract(df, html, {"all": Rows(selector, fields, first)}).drop("rule")


# ---- event pages

def events(df: DataFrame, html: str) -> DataFrame:
    """name, date (ISO), start_time, location of each event page; a start that isn't an ISO date and time leaves date and start_time null."""
    fields = {"name": _at('h1 span[itemprop="name"]'), "_start": _at('.info meta[itemprop="startDate"]', attr="content"), "location": _at('.info span[itemprop="location"]')}
    date, moment = (F.nullif(F.regexp_extract(F.trim("_start"), p, 1), F.lit("")) for p in (r"^(\d{4}-\d{2}-\d{2})T", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.*)$"))
    d = _read(df, html, None, fields)
    return d.withColumns({"name": _or_empty("name"), "date": date, "start_time": moment, "location": _or_empty("location")}).drop("_start", "position")


_BOUTS = 'table.new_table.result tr[itemprop="subEvent"], table.new_table.upcoming tr[itemprop="subEvent"]'


def _main_side(side: str) -> dict[str, Field]:
    own = f".fighter.{side}_side"
    return {f"{side}_name": _at(f'{own} h3 span[itemprop="name"]'), f"{side}_href": _at(f'{own} a[href^="/fighter/"]', attr="href"), f"{side}_badge": _at(f"{own} .final_result", attr="class")}


def _row_side(side: str, cell: str) -> dict[str, Field]:
    return {f"{side}_name": _at(cell, 'a[itemprop="url"] span[itemprop="name"]', breaks=True), f"{side}_href": _at(cell, 'a[itemprop="url"]', attr="href"), f"{side}_badge": _at(cell, ".final_result", attr="class")}


def bouts(df: DataFrame, html: str, base: str) -> DataFrame:
    """bout (from 0, the main event first), weight_class, first, second (structs of name, url, result), method, round, time, is_main, is_title of each bout of an
    event page.  Bouts without both names are left out; without a badge, or with one of no result, a bout isn't finished; a missing or odd round is 0, other
    missing values are empty."""
    resume = "/table.fight_card_resume tr"
    main = {
        "weight_class": _at(".versus span.weight_class"), "titles": _at(".versus span.title_fight", count=True), **_main_side("left"), **_main_side("right"),
        **{name: _at(resume, "td", k, without="em") for k, name in ((1, "method"), (3, "round"), (4, "time"))},
    }
    row = {
        "weight_class": _at("td.text_center span.weight_class"), "titles": _at("td.text_center span.title_fight", count=True), **_row_side("left", "td.text_right"), **_row_side("right", "td.text_left"),
        "method": _at("td.winby b"), "round": _at("td", -2), "time": _at("td", -1),
    }
    d = extract(df, html, {"main": Rows(".fight_card", main, first=True), "row": Rows(_BOUTS, row)})
    side = lambda s: F.struct(_or_empty(f"{s}_name").alias("name"), resolved(F.col(f"{s}_href"), base).alias("url"), F.coalesce(result_of(F.col(f"{s}_badge")), F.lit("not_finished")).alias("result"))
    is_main = F.col("rule") == "main"
    kept = [c for c in df.columns if c != html]
    read = d.select(
        *kept, F.when(is_main, 0).otherwise(F.col("position") + 1).alias("bout"), _or_empty("weight_class").alias("weight_class"), side("left").alias("first"), side("right").alias("second"), _or_empty("method").alias("method"),
        whole_number(F.col("round")).alias("round"), _or_empty("time").alias("time"), is_main.alias("is_main"), (F.col("titles") > 0).alias("is_title"),
    )
    return read.where("first.name <> '' AND second.name <> ''")


# ---- fighter pages

def fighters(df: DataFrame, html: str, base: str) -> DataFrame:
    """name, image_url, weight_class, wins, losses, draws, height_cm, birth_date (ISO) of each fighter page; counts that are missing are 0, height and birth date
    null, the rest empty."""
    fields = {
        "name": _at('h1[itemprop="name"] span.fn'), "_image": _at('.fighter-info img[itemprop="image"]', attr="src"), "weight_class": _at('.association-class a[href*="weightclass="]'),
        **{f"_{kind}": _at(f".winloses.{kind} span", 1) for kind in ("win", "lose", "draw")}, "_height": _at('.bio-holder b[itemprop="height"]', ".."), "_born": _at('.bio-holder [itemprop="birthDate"]'),
    }
    cm = F.regexp_extract("_height", r"(\d+(?:\.\d+)?)\s*cm", 1).try_cast("double")
    born = F.when(F.col("_born").rlike(r"^[A-Za-z]{3,}\.?\s+\d{1,2},\s*\d{4}$"), long_date(F.regexp_replace("_born", r"\.", "")))
    d = _read(df, html, None, fields)
    return d.select(
        *(c for c in df.columns if c != html), _or_empty("name").alias("name"), resolved(F.col("_image"), base).alias("image_url"), _or_empty("weight_class").alias("weight_class"),
        *(whole_number(F.col(f"_{kind}")).alias(name) for kind, name in (("win", "wins"), ("lose", "losses"), ("draw", "draws"))), F.when(F.round(cm) > 0, F.round(cm).cast("int")).alias("height_cm"), born.alias("birth_date"),
    )


def histories(df: DataFrame, html: str, base: str) -> DataFrame:
    """position, opponent_name, opponent_url, event_name, event_url, date, result, method, referee, round, time: the rows of the first fight history of a fighter page
    (smaller lists further down repeat it).  Head rows, rows of under six cells and rows without opponent or event are left out; a date that isn't "May / 16 /
    2026" is empty."""
    line = "table.new_table.fighter tbody tr"
    row = {
        "_cells": _at("td", count=True), "_class": Field(attr="class"), "opponent_name": _at("td", 1, "a"), "opponent_url": _at("td", 1, "a", attr="href"), "event_name": _at("td", 2, "a", without=".sub_line"), "event_url": _at("td", 2, "a", attr="href"),
        "date": _at("td", 2, ".sub_line"), "result": _at("td", 0, ".final_result"), "method": _at("td", 3, "b"), "referee": _at("td", 3, ".sub_line"), "round": _at("td", 4), "time": _at("td", 5),
        "_in_first": _at("/.module.fight_history", line, count=True),  # rows of later histories come after those of the first
    }
    d = _read(df, html, f".module.fight_history {line}", row).where("position < _in_first AND _cells >= 6")
    d = d.where(~F.array_contains(F.split(_or_empty("_class"), r"\s+"), "table_head")).drop("_cells", "_class", "_in_first")
    date = F.when(F.col("date").rlike(r"^[A-Za-z]{3,}\s*/\s*\d{1,2}\s*/\s*\d{4}$"), long_date(F.col("date")))
    read = d.withColumns(
        {"opponent_url": resolved(F.col("opponent_url"), base), "event_url": resolved(F.col("event_url"), base), "date": _or_empty(date), "result": F.lower(_or_empty("result")), "method": _or_empty("method"), "referee": _or_empty("referee"), "round": whole_number(F.col("round")), "time": _or_empty("time")}
    )
    return read.where("opponent_name <> '' AND event_name <> ''")


# ---- statistics pages

def _of(c: Column) -> Column:
    """struct<landed, attempted> of "n of m"; anything else counts as none of none."""
    part = lambda k: F.coalesce(F.regexp_extract(c, r"(\d+)\s+of\s+(\d+)", k).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("landed"), part(2).alias("attempted"))


def _seconds(c: Column) -> Column:
    """Seconds of "m:ss", null for anything else (such as "--")."""
    part = lambda k: F.regexp_extract(c, r"^(\d+):(\d{2})$", k).try_cast("int")
    return part(1) * 60 + part(2)


# Columns of the two tables of a fight's page, and the marks of results.
TOTALS = {"knockdowns": (1, whole_number), "significant": (2, _of), "total": (4, _of), "takedowns": (5, _of), "submissions": (7, whole_number), "reversals": (8, whole_number), "control": (9, _seconds)}
STRIKES = {"head": (3, _of), "body": (4, _of), "leg": (5, _of), "distance": (6, _of), "clinch": (7, _of), "ground": (8, _of)}
STATUS = {"W": "win", "L": "loss", "D": "draw", "NC": "nc"}


def _cells(columns: dict, *row: str | int) -> dict[str, Field]:
    """A table row's cells, each with a paragraph a side."""
    return {name: _at(*row, "td", k, "p", every=True) for name, (k, _) in columns.items()}


def _by_side(d: DataFrame, columns: dict) -> DataFrame:
    """A row a side (0, 1), with the values of its paragraphs."""
    sides = d.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    return sides.withColumns({name: read(_or_empty(F.get(name, F.col("side")))) for name, (_, read) in columns.items()})


def fight_sides(df: DataFrame, html: str) -> DataFrame:
    """side (0, 1), name, url, result, the totals and the strikes by target and position of each corner of a fight's page.  The tables for the whole fight are those without
    the mark of the round tables: the first has the totals, the second the strikes.  A missing table or cell counts as 0, a control time that isn't m:ss as null."""
    whole = "table:not(.js-fight-table)"
    person = lambda k, *steps, **what: _at(".b-fight-details__person", k, *steps, **what)
    link = ".b-fight-details__person-name a"
    fields = {
        "_persons": _at(".b-fight-details__person", count=True), **{f"_name{k}": person(k, link) for k in (0, 1)}, **{f"_url{k}": person(k, link, attr="href") for k in (0, 1)},
        **{f"_status{k}": person(k, ".b-fight-details__person-status") for k in (0, 1)}, **_cells(TOTALS, whole, 0, "tbody tr"), **_cells(STRIKES, whole, 1, "tbody tr"),
    }
    d = _by_side(_read(df, html, None, fields).where("_persons > 0"), TOTALS | STRIKES)
    own = lambda c: F.get(F.array(f"_{c}0", f"_{c}1"), F.col("side"))
    status = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return d.select(*(c for c in df.columns if c != html), "side", _or_empty(own("name")).alias("name"), _or_empty(own("url")).alias("url"), status[_or_empty(own("status"))].alias("result"), *TOTALS, *STRIKES)


def fight_rounds(df: DataFrame, html: str) -> DataFrame:
    """side, round (from 1, in the page's order) and the totals of each round fought: the rows of the first round table, whatever sections they stand in."""
    row = "tbody tr.b-fight-details__table-row"
    fields = {"_in_first": _at("/table.js-fight-table", 0, row, count=True), **_cells(TOTALS)}
    d = _read(df, html, f"table.js-fight-table {row}", fields).where("position < _in_first")
    return _by_side(d, TOTALS).select(*(c for c in df.columns if c != html), "side", (F.col("position") + 1).alias("round"), *TOTALS)


def fight_meta(df: DataFrame, html: str) -> DataFrame:
    """weight_class, is_title, method, round, time, scheduled of each fight's page: the division without "UFC", "Title" and "Bout"; what the first line of
    details doesn't say is empty or 0."""
    d = _read(df, html, None, {"_title": _at(".b-fight-details__fight-title"), "_line": _at(".b-fight-details__content .b-fight-details__text")}).withColumns({c: _or_empty(c) for c in ("_title", "_line")})
    found = lambda p: F.regexp_extract("_line", p, 1)
    division = F.trim(F.regexp_replace(F.regexp_replace("_title", r"(?i)^UFC\s+", ""), r"(?i)\s+(?:Title\s+)?Bout$", ""))
    return d.select(
        *(c for c in df.columns if c != html), division.alias("weight_class"), F.col("_title").rlike(r"(?i)\btitle\b").alias("is_title"), F.trim(found(r"(?i)Method:\s*(.+?)\s*Round:")).alias("method"), whole_number(found(r"(?i)Round:\s*(\d+)\s*Time:")).alias("round"),
        found(r"(?i)Time:\s*([\d:]+)\s*Time format:").alias("time"), whole_number(found(r"(?i)Time format:\s*(\d+)\s*Rnd")).alias("scheduled"),
    )


# ---- event lists

def _iso(c: Column) -> Column:
    """ISO date of "August 15, 2026", else null."""
    return F.when(c.rlike(r"^[A-Za-z]{3,}\s+\d{1,2},\s*\d{4}$"), long_date(c))


def event_meta(df: DataFrame, html: str) -> DataFrame:
    """name, date (ISO, or empty), location of a statistics event page."""
    d = _read(df, html, None, {"name": _at(".b-content__title"), "_info": _at(".b-list__box-list")})
    info = _or_empty("_info")
    date, place = F.regexp_extract(info, r"Date:\s*(.+?)\s*(?:Location:|$)", 1), F.regexp_extract(info, r"Location:\s*(.+?)\s*$", 1)
    return d.withColumns({"name": _or_empty("name"), "date": _or_empty(_iso(date)), "location": place}).drop("_info", "position")


def completed_events(df: DataFrame, html: str) -> DataFrame:
    """position, url, name of each linked row of a list of completed events."""
    d = _read(df, html, "table.b-statistics__table-events tbody tr.b-statistics__table-row", {"url": _at("a", attr="href"), "name": _at("a")})
    return d.where("url <> ''").withColumn("name", _or_empty("name"))


def fight_links(df: DataFrame, html: str) -> DataFrame:
    """url, fight_of_the_night, performance of each fight of an event page, a row a url: the bonuses by the icons of its rows (belts are none)."""
    d = _read(df, html, "tr.b-fight-details__table-row[data-link]", {"url": Field(attr="data-link"), "_icons": _at("img", attr="src", every=True)}).where("url <> ''")
    icons = F.transform("_icons", lambda i: F.element_at(F.split(F.coalesce(i, F.lit("")), "/"), -1))
    # The icons' file names.
    best = F.exists(icons, lambda i: i.isin("perf.png", "sub.png", "ko.png"))
    return d.groupBy(*(c for c in df.columns if c != html), "url").agg(F.max(F.array_contains(icons, "fight.png")).alias("fight_of_the_night"), F.max(best).alias("performance"))


def physiques(df: DataFrame, html: str) -> DataFrame:
    """height_cm, reach_cm, birth_date (ISO) of a bio box, a row a page; what isn't a measure in feet or inches, or a date, is null."""
    box = ".b-list__info-box_style_small-width li"
    d = _read(df, html, None, {"_labels": _at(box, every=True), "_values": _at(box, every=True, without="i")})
    value = lambda name: F.get(F.filter(F.arrays_zip("_labels", "_values"), lambda x: F.lower(x["_labels"]).startswith(f"{name}:")), F.lit(0))["_values"]
    cm = lambda c: F.when(c.rlike(r"^(?:\d+'\s*)?\d+(?:\.\d+)?\"$"), imperial_cm(c))
    return d.select(*(c for c in df.columns if c != html), cm(value("height")).alias("height_cm"), cm(value("reach")).alias("reach_cm"), _iso(value("dob")).alias("birth_date"))
