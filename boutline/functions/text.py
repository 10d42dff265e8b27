"""String functions as Columns: slugs, names, titles, truncation, guards."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Every letter of the Latin blocks whose decomposition starts with an ASCII letter, and that letter; lower and upper case, built from Unicode's own rule."""
    pairs = {}
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for c in map(chr, block):
            plain = unicodedata.normalize("NFD", c)[0]
            if plain != c and plain.isascii() and plain.isalpha():
                pairs[c] = plain
    # Letters without a decomposition.
    pairs |= {"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i"}
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), "[̀-ͯ]", "")


def slugify(c: Column) -> Column:
    """Accents off, apostrophes deleted, lower case, other runs to one hyphen, no hyphen at the ends."""
    plain = F.lower(F.regexp_replace(strip_accents(c), "['‘’`´]", ""))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_numeric_slug(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def href(base: str, name: Column, ident: Column) -> Column:
    """Link by slug, by id where the slug is empty or a number."""
    s = slugify(F.coalesce(name, F.lit("")))
    return F.concat(F.lit(f"/{base}/"), F.when((s == "") | is_numeric_slug(s), ident.cast("string")).otherwise(s))


def normalize_name(c: Column) -> Column:
    """No accents, lower case, letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9\s]", ""), r"\s+", " "))


# Name suffixes that don't count.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")


# Ring names whose bearers are listed under another name.
ALIASES = {
    "renato moicano": "renato carneiro", "patricio pitbull": "patricio freire", "loopy godinez": "lupita godinez", "shara magomedov": "sharabutdin magomedov", "jacare souza": "ronaldo souza",
    "bia mesquita": "beatriz mesquita", "daria zhelezniakova": "darya zheleznyakova", "viktoriia dudakova": "victoria dudakova", "chepe mariscal": "jose mariscal", "tuco tokkos": "george tokkos",
    "ozzy diaz": "osman diaz", "ollie schmid": "oliver schmid", "tommy gantt": "thomas gantt", "gigi canuto": "giovanna canuto", "timmy cuamba": "timothy cuamba", "maheshate": "maheshate hayisaer", "mizuki": "mizuki inoue",
}


def alias(c: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The normalised name, or the one it stands for."""
    plain = normalize_name(c)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[plain], plain)


def name_words(c: Column) -> Column:
    """Words of a name: hyphens and dashes are spaces, suffixes dropped, st is saint."""
    words = F.split(normalize_name(F.regexp_replace(c, "[-\u2010\u2011\u2013]", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*SUFFIXES))
    return F.transform(kept, lambda w: F.when(w == "st", "saint").otherwise(w))


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the words of `short` stand in `long` in their order."""
    hit = F.aggregate(long, F.lit(0), lambda at, w: F.when(w == F.get(short, at), at + 1).otherwise(at))
    return hit == F.size(short)


def name_level(a: Column, b: Column) -> Column:
    """0 to 4, the strictest level at which two word lists match, else null (F06): equal, equal joined, equal sorted, one a subsequence of the other (two words or
    more), first words that differ but share three letters, and the same words after them."""
    shorter, longer = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    one, other = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    tail = lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    shortened = (one != other) & (F.length(one) >= 3) & (F.length(other) >= 3) & (F.substring(one, 1, 3) == F.substring(other, 1, 3)) & (tail(a) == tail(b))
    return (
        F.when(a == b, 0)
        .when(F.array_join(a, "") == F.array_join(b, ""), 1)
        .when(F.array_sort(a) == F.array_sort(b), 2)
        .when((F.size(shorter) >= 2) & is_subsequence(shorter, longer), 3)
        .when((F.size(a) >= 2) & (F.size(a) == F.size(b)) & shortened, 4)
    )


def normalize_title(c: Column) -> Column:
    """Lower case, anything but letters and digits a space, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def truncate_words(c: Column, most: int) -> Column:
    """Cut at a word's end and mark with an ellipsis."""
    cut = F.regexp_replace(F.substring(c, 1, most), r"\s+\S*\z", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def like_escape(text: str) -> str:
    """A literal for LIKE."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def to_number(c: Column) -> Column:
    """Number or null; what isn't finite is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def search_query(c: Column, least: int = 2, most: int = 80) -> Column:
    """Single spaces, trimmed, cut; null if too short."""
    q = F.trim(F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most))
    return F.when(F.length(q) >= least, q)


def wrap_index(i: Column, n: Column) -> Column:
    return F.when(n > 0, F.pmod(i, n)).otherwise(-1)


def country_flag(code: Column) -> Column:
    """Two letters to the two regional indicators."""
    one = lambda k: F.decode(F.unhex(F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(F.upper(code), k, 1)) + 0xA6 - 65))), "UTF-8")
    return F.when(code.rlike("^[A-Za-z]{2}$"), F.concat(one(1), one(2))).otherwise("")


def display_event_name(name: Column) -> Column:
    """A name without a leading "<promotion> - " that says nothing new (F10): one with a number goes if the rest repeats the number as a word, one without goes unless the rest
    is a bare matchup (" vs. " without a ":" before it)."""
    clean = F.trim(F.regexp_replace(name, r"\s+", " "))
    head, rest = F.substring_index(clean, " - ", 1), F.regexp_replace(clean, "^.*? - ", "")
    number, versus, colon = F.regexp_extract(head, r"\d+", 0), F.instr(rest, " vs. "), F.instr(rest, ":")
    repeats = F.regexp_like(rest, F.concat(F.lit(r"\b"), number, F.lit(r"\b")))
    goes = F.when(number != "", repeats).otherwise((versus == 0) | (colon > 0) & (colon < versus))
    return F.when(clean.contains(" - ") & goes, rest).otherwise(clean)


def physique(height_cm: Column, reach_cm: Column) -> Column:
    """"1,93 m \u00b7 Allonge 215 cm", what is missing left out; null for neither."""
    height = F.when(height_cm > 0, F.replace(F.format_string("%.2f m", height_cm / 100), F.lit("."), F.lit(",")))
    both = F.concat_ws(" \u00b7 ", height, F.when(reach_cm > 0, F.concat(F.lit("Allonge "), reach_cm.cast("string"), F.lit(" cm"))))
    return F.nullif(both, F.lit(""))


def sharper_image(url: Column, width: int = 400, height: int = 600) -> Column:
    """An image address that asks for a larger crop, where its path names one."""
    return F.regexp_replace(url, r"^(.*?)/image_crop/\d+/\d+/", f"$1/image_crop/{width}/{height}/")


def listing_path(path: str, org: Column, page: Column) -> Column:
    """The canonical address of a list (F33): a numeric organisation and a page past the first are kept, all else is dropped."""
    number = F.when(page.rlike(r"^\s*\d+\s*$"), F.trim(page).try_cast("int"))
    query = F.concat_ws("&", F.when(org.rlike(r"^\d+$"), F.concat(F.lit("org="), org)), F.when(number > 1, F.concat(F.lit("page="), number.cast("string"))))
    return F.when(query == "", F.lit(path)).otherwise(F.concat(F.lit(path + "?"), query))


def from_entities(c: Column) -> Column:
    """The few HTML entities that titles carry."""
    # Fixed values.
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def strip_tracking(url: Column) -> Column:
    """A URL without utm_* and fbclid parameters."""
    u = F.regexp_replace(url, r"([?&])(utm_[a-z]+|fbclid)=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"&{2,}", "&"), r"\?&", "?"), r"[?&](?=$|#)", "")
