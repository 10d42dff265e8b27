"""Schema.org descriptions as JSON texts (F34).  Fields without a value are left out, and "<" is escaped, so that no value can end a script element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutline.functions.text import display_event_name

CONTEXT = "https://schema.org"


def serialized(thing: Column) -> Column:
    """A struct as JSON: null fields and empty arrays (pass them as null) are left out."""
    return F.replace(F.to_json(thing), F.lit("<"), F.lit("\\u003c"))


def if_absolute(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url)


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _thing(kind: str, **parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *(c.alias(n) for n, c in parts.items()))


def _page(kind: str, parts: dict[str, Column]) -> Column:
    return F.struct(F.lit(CONTEXT).alias("@context"), F.lit(kind).alias("@type"), *(c.alias(n) for n, c in parts.items()))


def start_date(times: list[Column], day: Column) -> Column:
    """The first time that is known, in UTC with milliseconds, else the day; midnight UTC stands for unknown."""
    known = [F.when(F.date_format(t, "HH:mm:ss") != "00:00:00", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")) for t in times]
    return F.coalesce(*known, day)


def distinct_people(names: Column, urls: Column) -> Column:
    """array<struct<@type, name, url>> of those with a name, a url once, at its first place with its last name; null if there is none."""
    pairs = F.filter(F.arrays_zip(names.alias("name"), urls.alias("url")), lambda p: F.coalesce(p["name"] != "", F.lit(False)))
    seen = F.array_distinct(F.transform(pairs, lambda p: p["url"]))
    people = F.transform(seen, lambda u: F.struct(F.lit("Person").alias("@type"), F.element_at(F.filter(pairs, lambda p: p["url"] == u), -1)["name"].alias("name"), u.alias("url")))
    return F.when(F.size(people) > 0, people)


def sports_event(base: str, ident: Column, name: Column, description: Column, start: Column, poster: Column, place: Column, org_id: Column, org: Column, people: Column) -> Column:
    """An event's description: name without a redundant promotion, address, start, poster and place if known, organiser, competitors."""
    where = F.when(_given(place).isNotNull(), _thing("Place", name=place, address=place))
    poster = F.when(if_absolute(poster).isNotNull(), F.array(poster))
    url = lambda kind, i: F.concat(F.lit(f"{base}/{kind}/"), i.cast("string"))
    parts = {
        "name": display_event_name(name), "description": description, "url": url("events", ident), "startDate": start, "sport": F.lit("Mixed Martial Arts"), "eventStatus": F.lit(f"{CONTEXT}/EventScheduled"),
        "eventAttendanceMode": F.lit(f"{CONTEXT}/OfflineEventAttendanceMode"), "image": poster, "location": where, "organizer": _thing("SportsOrganization", name=org, url=url("organizations", org_id)), "competitor": people,
    }
    return serialized(_page("SportsEvent", parts))


def profile(base: str, path: Column, name: Column, description: Column, image: Column, is_women: Column, birth: Column, nationality: Column, height_cm: Column, org_id: Column, org: Column) -> Column:
    """A person's profile page: what isn't known is left out; a birth date is cut to its day."""
    url = F.concat(F.lit(base), path)
    day = F.nullif(F.regexp_extract(birth, r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))
    person = F.struct(
        F.lit("Person").alias("@type"), F.concat(url, F.lit("#person")).alias("@id"), name.alias("name"), url.alias("url"), description.alias("description"), if_absolute(image).alias("image"), F.lit("Combattant de MMA").alias("jobTitle"),
        F.when(is_women, f"{CONTEXT}/Female").when(~is_women, f"{CONTEXT}/Male").alias("gender"), day.alias("birthDate"), F.when(_given(nationality).isNotNull(), _thing("Country", name=F.upper(nationality))).alias("nationality"),
        F.when(height_cm > 0, F.struct(F.lit("QuantitativeValue").alias("@type"), height_cm.alias("value"), F.lit("CMT").alias("unitCode"))).alias("height"),
        F.when(_given(org).isNotNull(), _thing("SportsOrganization", name=org, url=F.concat(F.lit(f"{base}/organizations/"), org_id.cast("string")))).alias("memberOf"),
    )
    return serialized(_page("ProfilePage", {"url": url, "inLanguage": F.lit("fr-FR"), "mainEntity": person}))


def organization(base: str, ident: Column, name: Column, short: Column, description: Column, logo: Column) -> Column:
    """An organisation; a short name that is the name itself is left out."""
    parts = {"name": name, "alternateName": F.when(_given(short) != name, short), "description": description, "url": F.concat(F.lit(f"{base}/organizations/"), ident.cast("string")), "logo": if_absolute(logo), "sport": F.lit("Mixed Martial Arts")}
    return serialized(_page("SportsOrganization", parts))


def breadcrumbs(base: str, labels: Column, paths: Column) -> Column:
    """The way to a page: the start page, then labels with their paths."""
    crumbs = F.concat(F.array(F.struct(F.lit("Accueil").alias("name"), F.lit("/").alias("path"))), F.zip_with(labels, paths, lambda n, p: F.struct(n.alias("name"), p.alias("path"))))
    items = F.transform(crumbs, lambda c, k: F.struct(F.lit("ListItem").alias("@type"), (k + 1).alias("position"), c["name"].alias("name"), F.concat(F.lit(base), c["path"]).alias("item")))
    return serialized(_page("BreadcrumbList", {"itemListElement": items}))
